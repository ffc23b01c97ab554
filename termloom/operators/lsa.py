"""Latent semantic analysis, projections and word vectors with Spark's own solvers."""

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators import corpus


def term_doc(docs: DataFrame, min_bytes: int = 6, min_count: int = 2) -> DataFrame:
    """w, doc_id, n of words that pass the length, shape and count gates."""
    keep = corpus.filter_stats(corpus.word_stats(docs)).where((F.octet_length("w") >= min_bytes) & (F.col("wf") >= min_count)).select("w")
    return corpus.tokens(docs).groupBy("w", "doc_id").agg(F.count("*").alias("n")).join(keep, "w", "left_semi")


#: Columns of the term matrix at most.
WIDTH = 2048

#: Singular values below this share of the largest are none, as in Spark's solver.
LEAST = 1e-9


def svd(counts: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(w, u) with u the first k left singular directions times sigma, and the singular values.

    Rows stay sparse and distributed.  Up to WIDTH documents have a column each; more are
    hashed into WIDTH columns, so the Gram matrix keeps a bounded size. Signs: each
    direction's largest component is positive.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)  # read twice
    own, docs = counts, counts.select("doc_id").distinct()
    n = docs.limit(WIDTH + 1).count()
    if n <= WIDTH:
        width = max(k, n)  # columns without documents add nothing
        at = docs.select(F.col("doc_id"), (F.row_number().over(Window.orderBy("doc_id")) - 1).alias("col"))
        counts = counts.join(F.broadcast(at), "doc_id")
    else:
        width = WIDTH
        counts = counts.withColumn("col", F.pmod(F.xxhash64("doc_id"), F.lit(width)).cast("int"))
    cells = counts.groupBy("w", "col").agg(F.sum("n").cast("double").alias("n"))
    rows = cells.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("col", "n"))).alias("cells"))
    rdd = rows.rdd.map(lambda r: (r["w"], Vectors.sparse(width, [c["col"] for c in r["cells"]], [c["n"] for c in r["cells"]]))).cache()
    # One pass over the rows: Spark's own solver for this width takes one for each of its steps.
    values, vectors = np.linalg.eigh(RowMatrix(rdd.map(lambda x: x[1]), numCols=width).computeGramianMatrix().toArray())
    own.unpersist()
    s, v = np.sqrt(np.maximum(values[::-1][:k], 0)), vectors[:, ::-1][:, :k]
    kept = s > LEAST * s[0]
    s, v = s[kept], v[:, kept]
    v = v * [1 if c[abs(c).argmax()] > 0 else -1 for c in v.T]
    sent = rows.sparkSession.sparkContext.broadcast(v)
    u = rdd.map(lambda x: (x[0], [float(a) for a in x[1].values @ sent.value[x[1].indices]]))
    return u.toDF("w string, u array<double>"), [float(x) for x in s]


def topics(u: DataFrame, n_topics: int = 5, n_words: int = 30) -> DataFrame:
    """topic, rank, w: the words of the largest components; ties to the later word."""
    x = u.select("w", F.posexplode(F.slice("u", 1, n_topics)).alias("topic", "x"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("x"), F.desc("w")))
    return x.withColumn("rank", rank).where(F.col("rank") <= n_words).select("topic", "rank", "w")


def pca(vectors: DataFrame, k: int = 2) -> DataFrame:
    f = vectors.select("id", array_to_vector("v").alias("f"))
    return PCA(k=k, inputCol="f", outputCol="p").fit(f).transform(f).select("id", vector_to_array("p").alias("p"))


def word_vectors(sentences: DataFrame, size: int = 32, epochs: int = 1, seed: int = 1) -> DataFrame:
    """w and v of words in (words array) by skip-gram; no subword pieces."""
    m = Word2Vec(vectorSize=size, minCount=5, maxIter=epochs, stepSize=0.02, seed=seed, inputCol="words", outputCol="x").fit(sentences)
    return m.getVectors().select(F.col("word").alias("w"), vector_to_array("vector").alias("v"))
