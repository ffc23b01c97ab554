"""Nearest neighbours, topics and centrality over vectors."""

import math
import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from termloom.functions import vectors as V

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the repository

#: Queries that are sent out at once; vectors multiplied with them at once.
BLOCK, STRIP = 5_000, 1_000

#: Queries of one product.
FEW = 250

#: Vectors of a group, up to 8 groups (up to four times as many beyond); candidate pairs that are held at once.
GROUP, PAIRS = 8_192, 100_000


class Best:
    """The k nearest vectors of each query so far, by cosine to six places, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int, own: bool):
        self.ids, self.units, self.k, self.own = ids, units, k, own
        self.least = np.full(len(ids), -np.inf)
        self.held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query's place, similarity, id
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, ids: np.ndarray, units: np.ndarray) -> None:
        sims = np.floor(self.units @ units.T * 1e6 + 0.5) / 1e6
        near = sims >= self.least[:, None]
        if not self.own:
            near &= self.ids[:, None] != ids
        q, c = np.nonzero(near)
        self.new.append((q, sims[q, c], ids[c]))
        self.waiting += len(q)
        if self.waiting > 2 * self.k * len(self.ids):
            self.cut()

    def cut(self) -> None:
        q, sim, ids = (np.concatenate([x, *y]) for x, y in zip(self.held, zip(*self.new, strict=True) if self.new else ([],) * 3, strict=True))
        order = np.lexsort((ids, -sim, q))
        q, sim, ids = q[order], sim[order], ids[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.held, self.new, self.waiting = [q[keep], sim[keep], ids[keep]], [], 0
        full = np.arange(len(q)) - first == self.k - 1
        self.least[q[full]] = sim[full]


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors of one length, each of length one, or zero where it has none."""
    x = np.array(vectors, dtype=np.float64)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest(ids: np.ndarray, units: np.ndarray, k: int, own: bool, strips: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """query, id and similarity of the k nearest of all strips; a product has FEW queries, as at first every pair is a find."""
    bests = [Best(ids[i : i + FEW], units[i : i + FEW], k, own) for i in range(0, len(ids), FEW)]
    for found, vectors in strips:
        for best in bests:
            best.offer(found, vectors)
    for best in bests:
        best.cut()
        at, sim, found = best.held
        yield best.ids[at], found, sim


def knn(queries: DataFrame, vectors: DataFrame, k: int, own: bool = False) -> DataFrame:
    """query_id, id, sim: the k nearest rows of (id, v) by cosine for each query row; ties to the smaller id.

    Queries go out in blocks of BLOCK; a task multiplies them with its vectors and keeps k
    a query, so that is what is shuffled.  Null ids and vectors take no part; vectors are of
    one length, a whole number is an id.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.select(F.col("id").cast("long"), V.doubles(F.col("v")).alias("v")).where("id is not null and v is not null")
    queries, vectors = usable(queries), usable(vectors)
    blocks = max(1, -(-queries.count() // BLOCK))
    out = None
    for i in range(blocks):
        q = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in q], np.int64), unit_rows([r["v"] for r in q]) if q else None))

        def run(batches, sent=sent):
            import pyarrow as pa

            ids, units = sent.value
            if units is None:
                return
            parts = (b.slice(at, STRIP) for b in batches for at in range(0, b.num_rows, STRIP))
            for query, found, sim in nearest(ids, units, k, own, ((np.array(p.column(0), dtype=np.int64), unit_rows(p.column(1).to_pylist())) for p in parts)):
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(sim)], names=["query_id", "id", "sim"])

        part = vectors.mapInArrow(run, "query_id long, id long, sim double")
        out = part if out is None else out.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return out.withColumn("sim", F.round("sim", 6)).withColumn("rank", rank).where(F.col("rank") <= k)


def vector_matrix(column) -> np.ndarray:
    """The vectors of an Arrow column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def groups_of(n: int) -> int:
    """Into how many groups n vectors are dealt: each two of them meet in a task, so a vector is sent once a group."""
    return max(min(-(-n // GROUP), 8), -(-n // (4 * GROUP)), 1)


def close_pairs(ids: np.ndarray, x: np.ndarray, buckets: np.ndarray, at: np.ndarray, others: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a < b and their distance for unit vectors within the radius that share a bucket, one of the rows `at` and one of `others`.

    Products in single precision find the candidates, with room for their error; distances are
    summed in doubles, component by component.
    """
    least = 1 - radius * radius / 2 - x.shape[1] * 1e-6
    single = x.astype(np.float32)
    for i in range(0, len(at), STRIP):
        for j in range(0, len(others), 4 * STRIP):
            left, right = at[i : i + STRIP], others[j : j + 4 * STRIP]
            p, q = np.nonzero(single[left] @ single[right].T >= least)
            p, q = left[p], right[q]
            for cut in range(0, len(p), PAIRS):
                a, b = p[cut : cut + PAIRS], q[cut : cut + PAIRS]
                keep = (ids[a] < ids[b]) if at is others else (ids[a] != ids[b])
                keep &= (buckets[a] == buckets[b]).any(1)
                a, b = a[keep], b[keep]
                sq = np.zeros(len(a))
                for k in range(x.shape[1]):
                    sq += (x[a, k] - x[b, k]) ** 2
                dist = np.sqrt(sq)
                near = dist < radius
                a, b, dist = ids[a[near]], ids[b[near]], dist[near]
                yield np.where(a < b, a, b), np.where(a < b, b, a), dist


def lsh_pairs(vectors: DataFrame, radius: float, bucket: float = 1.0, tables: int = 3, seed: int = 1) -> DataFrame:
    """Pairs a < b of unit vectors within a Euclidean radius that share a random-projection bucket (approximate).

    Unit vectors fall into few buckets, which hold most pairs; so vectors are dealt into
    groups, and a task takes the matrix products of two groups: the pairs of the buckets'
    join, without a row for each candidate.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    unit = vectors.withColumn("n", V.norm(F.col("v"))).where("n > 0").select("id", array_to_vector(F.transform("v", lambda x: x / F.col("n"))).alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    groups = groups_of(vectors.count())
    hashes = F.array(*(vector_to_array(F.get("h", F.lit(i)))[0] for i in range(tables)))
    rows = model.transform(unit).where("id is not null").select("id", vector_to_array("f").alias("x"), hashes.alias("h")).distinct()
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.withColumn("task", (high * (high + 1) / 2).cast("int") + low).withColumn("first", F.col("own") == low).drop("own", "other")
    kind = vectors.schema["id"].dataType

    def run(batches):
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        tasks = t.column("task").to_numpy()
        for task in np.unique(tasks):
            part = t.filter(pa.array(tasks == task)).combine_chunks()
            column = part.column("id").combine_chunks()
            ids, x, buckets = column.to_numpy(zero_copy_only=False), vector_matrix(part.column("x").combine_chunks()), vector_matrix(part.column("h").combine_chunks())
            first = part.column("first").to_numpy()
            at = np.flatnonzero(first)
            others = at if first.all() and diagonal(int(task)) else np.flatnonzero(~first)
            for a, b, dist in close_pairs(ids, x, buckets, at, others, radius):
                yield pa.RecordBatch.from_arrays([pa.array(a, column.type), pa.array(b, column.type), pa.array(dist)], names=["a", "b", "dist"])

    return dealt.repartitionById(groups * (groups + 1) // 2, "task").mapInArrow(run, StructType([StructField("a", kind), StructField("b", kind), StructField("dist", DoubleType())]))


def diagonal(task: int) -> bool:
    """Whether a task, numbered by its groups low <= high as high (high + 1) / 2 + low, is one of a group with itself."""
    high = (math.isqrt(8 * task + 1) - 1) // 2
    return task == high * (high + 1) // 2 + high


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """by and c, the mean vector of each group: summed per dimension, so no group meets in one task."""
    dims = vectors.select(by, F.posexplode("v").alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("m"))
    return dims.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c"))


def matches(vectors: DataFrame, topics: DataFrame, threshold: float) -> DataFrame:
    """id, topic, score of vectors whose combined score with a topic (topic, c) is above the threshold; topics are few."""
    score = V.combined(F.col("v"), F.col("c"))
    return vectors.join(F.broadcast(topics), F.lit(True)).select("id", "topic", F.round(score, 6).alias("score")).where(F.col("score") > threshold)


def topic_counts(matched: DataFrame, vectors: DataFrame, share: float, limit: int) -> DataFrame:
    """id, n topics and tag_match (0 < n < limit) after topics matched by more than a share of the rows are dropped."""
    most = F.floor(F.count("*") * share).alias("most")
    common = matched.groupBy("topic").agg(F.count("*").alias("n")).join(F.broadcast(vectors.agg(most)), F.col("n") > F.col("most"), "left_semi").select("topic")
    left = matched.join(common, "topic", "left_anti").groupBy("id").agg(F.count("*").alias("n"))
    return vectors.select("id").join(left, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)).between(1, limit - 1)).alias("tag_match"))


def centrality(vectors: DataFrame, by: str) -> DataFrame:
    """Mean cosine with, and mean closeness 1 / (1 + distance) to, the group's centroid."""
    j = vectors.join(centroids(vectors, by), by)
    return j.groupBy(by).agg(F.round(F.avg(V.cosine(F.col("v"), F.col("c"))), 6).alias("cos"), F.round(F.avg(1 / (1 + V.euclidean(F.col("v"), F.col("c")))), 6).alias("closeness"))


def topic_relevance(vectors: DataFrame, by: str, sigma: list[float] | None = None, dims: int = 50) -> DataFrame:
    """Mean over a group's vectors of the largest squared component's share of all, of the first dims (times sigma)."""
    v = F.slice("v", 1, dims)
    if sigma:
        v = F.zip_with(v, F.array(*map(F.lit, sigma[:dims])), lambda x, s: x * s)
    sq = F.transform(v, lambda x: x * x)
    rel = F.when(V.total(sq) >= 1e-15, F.array_max(sq) / V.total(sq))
    return vectors.groupBy(by).agg(F.round(F.coalesce(F.avg(rel), F.lit(0.0)), 6).alias("relevance"))


def mean_vectors(items: DataFrame, words: DataFrame, by: str) -> DataFrame:
    """by and v, the weighted mean of the known words' vectors (items: by, w, weight; words: w, v); items without any are left out."""
    x = items.join(words, "w").select(by, "weight", F.posexplode("v").alias("dim", "x")).groupBy(by, "dim").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("m"))
    return x.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("v"))


def phrase_vectors(phrases: DataFrame, words: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """phrase and the mean of its words' vectors, weighted by idf (w, idf) if given."""
    items = phrases.select("phrase", F.explode(F.split("phrase", " ")).alias("w"))
    if idf is None:
        return mean_vectors(items.withColumn("weight", F.lit(1.0)), words, "phrase")
    return mean_vectors(items.join(idf, "w").withColumnRenamed("idf", "weight"), words, "phrase")


def context_vectors(contexts: DataFrame, words: DataFrame) -> DataFrame:
    """phrase and the mean of its context's parts (cut at |) weighted by their words; parts without a known word don't count."""
    parts = contexts.select("phrase", F.posexplode(F.split("context", r"\|")).alias("no", "part")).select("phrase", "no", F.split(F.trim("part"), r"\s+").alias("ws")).withColumn("id", F.struct("phrase", "no"))
    v = mean_vectors(parts.select("id", F.explode("ws").alias("w"), F.lit(1.0).alias("weight")), words, "id")
    weighted = parts.select("id", F.size("ws").cast("double").alias("weight")).join(v, "id").select(F.col("id.phrase").alias("phrase"), "weight", F.posexplode("v").alias("dim", "x"))
    m = weighted.groupBy("phrase", "dim").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("m"))
    return m.groupBy("phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("v"))


def alignment(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """a, b, score: mean over a's known words of the best cosine with a word of b."""
    x = pairs.select("a", "b", F.explode(F.array_distinct(F.split("a", " "))).alias("w")).join(words.select("w", F.col("v").alias("va")), "w").withColumnRenamed("w", "wa")
    y = pairs.select("a", "b", F.explode(F.array_distinct(F.split("b", " "))).alias("w")).join(words.select("w", F.col("v").alias("vb")), "w")
    best = x.join(y, ["a", "b"]).groupBy("a", "b", "wa").agg(F.max(V.cosine(F.col("va"), F.col("vb"))).alias("best"))
    return best.groupBy("a", "b").agg(F.round(F.avg("best"), 6).alias("score"))


def mean_pair_cosine(vectors: DataFrame, by: str) -> DataFrame:
    """Mean cosine of all pairs of a group, from the sum of its unit vectors: (|sum|^2 - n) / (n (n - 1))."""
    unit = vectors.withColumn("n", V.norm(F.col("v"))).where("n > 0").select(by, F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("dim", "x"))
    dims = unit.groupBy(by, "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return dims.groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n")).where("n > 1").select(by, F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("cos"))


def topic_share(phrases: DataFrame, topic_words: DataFrame, n_topics: int) -> DataFrame:
    """phrase, share of its words that are a top word of any topic, hits (topic, word) over the topics."""
    w = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "w"))
    n = topic_words.select("topic", "w").distinct().groupBy("w").agg(F.count("*").alias("topics"))
    j = w.join(n, "w", "left")
    return j.groupBy("phrase").agg(F.round(F.avg(F.col("topics").isNotNull().cast("int")), 6).alias("share"), F.round(F.sum(F.coalesce("topics", F.lit(0))) / n_topics, 6).alias("relevance"))
