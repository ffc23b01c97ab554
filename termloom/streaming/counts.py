"""Word counts over a stream of documents (an extension; batch results are the same)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T


def word_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Running counts of words as parquet files of documents arrive; for output mode complete or update."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    return docs.select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("wf"))
