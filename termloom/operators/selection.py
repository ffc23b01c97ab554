"""Selection and synthesis of term rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_filter(df: DataFrame, models: list[str], labels: list[str]) -> DataFrame:
    """Rows marked by hand with a probability of 0.05 or more, others above 0.34; not of the models or labels named. Null models and labels stay."""
    kept = ((F.col("manual") == 1) & (F.col("prob") >= 0.05)) | ((F.col("manual") == 0) & (F.col("prob") > 0.34))
    named = lambda c, xs: F.coalesce(F.col(c).isin(*xs), F.lit(False))
    return df.where(kept & ~named("model_name", models) & ~named("label", labels))


def gate(df: DataFrame, least: float) -> DataFrame:
    """Without rows that are not marked and less probable than least."""
    return df.where(~((F.col("manual") == 0) & (F.col("prob") < least)))


def with_one_word_terms(base: DataFrame, contexts: DataFrame, divisor: int, model: str) -> DataFrame:
    """base and a row for each noun (contexts: a row a context): capitalised, one word, frequency by the corpus's divisor; columns that either lacks are null."""
    n = contexts.groupBy("noun").agg(F.count("*").alias("n"))
    one = n.select(F.concat(F.upper(F.left("noun", F.lit(1))), F.substr("noun", F.lit(2))).alias("key"), F.lit(1).alias("size"), F.lit(model).alias("model_name"), F.round(F.col("n") / divisor, 4).alias("frequency"))
    return base.unionByName(one, allowMissingColumns=True)
