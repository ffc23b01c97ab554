"""Term classification: features, balancing, stacked models, out-of-fold probabilities."""

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.evaluation import folds


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """features from numeric columns, null and NaN as 0."""
    clean = df.select("*", *(F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_{c}") for c in columns))
    return VectorAssembler(inputCols=[f"_{c}" for c in columns], outputCol="features").transform(clean).drop(*(f"_{c}" for c in columns))


def prob(c: str = "probability"):
    return F.get(vector_to_array(c), F.lit(1))


def undersample(df: DataFrame, label: str, key: str, ratio: float = 1.0) -> DataFrame:
    """The larger class thinned by hash to about ratio times the smaller one."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return df
    least = min(n.values())
    share = F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, min(1.0, ratio * least / v))))
    return df.where(F.pmod(F.xxhash64(F.lit("under"), key), F.lit(10**6)) < share[F.col(label)] * 10**6)


def smote(minority: DataFrame, seed: int = 1) -> DataFrame:
    """(key, v) between each vector and its nearest neighbour of the minority's bucket of similar vectors, at a hashed fraction.

    Neighbours are looked for among the next rows in the order of a random projection.
    """
    from pyspark.sql import Window

    w = F.aggregate(F.transform("v", lambda x, i: x * F.sin((i + 1) * seed * 12.9898)), F.lit(0.0), lambda a, x: a + x)
    near = F.lead("v").over(Window.partitionBy(F.pmod(F.floor(w * 4), F.lit(64))).orderBy(w, "key"))
    t = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1000)) / 1000.0
    return minority.withColumn("near", near).where("near is not null").select("key", F.zip_with("v", "near", lambda a, b: a + t * (b - a)).alias("v"))


def stacked_oof(df: DataFrame, label: str, key: str, columns: list[str], k: int = 3, seed: int = 1, hidden: tuple[int, ...] = (256, 128, 64)) -> DataFrame:
    """key, label, prob: forest, boosted trees and a perceptron fitted outside each fold, joined by a logistic regression fitted outside it too."""
    data = folds(assemble(df, columns), label, key, k).select(key, F.col(label).cast("double").alias("y"), "features", "fold").persist()
    base = None
    for f in range(k):
        fit, out = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        rf = RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=5, seed=seed).fit(fit).transform(out).select(key, prob().alias("p1"))
        gb = GBTClassifier(labelCol="y", maxIter=10, maxDepth=3, seed=seed).fit(fit).transform(out).select(key, prob().alias("p2"))
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(fit)
        mlp = MultilayerPerceptronClassifier(labelCol="y", featuresCol="scaled", layers=[len(columns), *hidden, 2], maxIter=50, seed=seed).fit(scaler.transform(fit)).transform(scaler.transform(out)).select(key, prob().alias("p3"))
        part = out.select(key, "y", "fold").join(rf, key).join(gb, key).join(mlp, key)
        base = part if base is None else base.unionAll(part)
    meta = VectorAssembler(inputCols=["p1", "p2", "p3"], outputCol="features").transform(base).persist()
    out = None
    for f in range(k):
        part = LogisticRegression(labelCol="y").fit(meta.where(F.col("fold") != f)).transform(meta.where(F.col("fold") == f)).select(key, F.col("y").cast("int").alias(label), prob().alias("prob"))
        out = part if out is None else out.unionAll(part)
    return out
