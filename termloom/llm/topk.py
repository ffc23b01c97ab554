"""Exact top-k inner products with multi-resolution segment statistics.

For vectors cut into segments, the means m and deviations d of the segments give a
lower bound of a squared distance: sum of len * ((mq - mc)^2 + (dq - dc)^2).  In terms of
the inner product, that is q.c <= sum of len * (mq * mc + dq * dc): one product of the
segments' features.  Bounds go coarse to fine over LEVELS; a pair whose bound falls below
the query's threshold is done, each level takes only the queries and candidates that
still have open pairs, and the last survivors get their exact product.  Segments are cut
from the components in order of their variance in the seed, so that like ones share one.
The threshold starts at the k-th best score in a bounded seed block and rises with each
task's own finds.

Queries go out in blocks of at most BLOCK vectors (a bounded broadcast); every block
meets every candidate partition.  The seed only sets thresholds and the order of
components: every candidate is bounded or scored, so results are exact at any size.

Vectors that are null, empty, or hold null or non-finite components (after scaling, too)
take no part, nor do rows without an id; vectors of another length than the query's are
no candidates.  A query meets no row of its own id.  Repeated rows are candidates of
their own, ties go to the smaller vec_id.  Products that doubles can't hold are worked
out in whole numbers of any size; a score beyond a long is given as the nearest long.
Other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import cut

#: Segments at each level, coarse first.
LEVELS = (4, 8, 16, 32)
#: Queries that are sent out at once, candidates compared at once, rows of the seed.
BLOCK, STRIP, SEED = 16_384, 2048, 4096
LONG = 2**63 - 1
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: Below this bound on a product, doubles hold every sum of products exactly.
EXACT = 2.0**52


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) times mean and deviation of each segment; the product of two rows is no less than that of their vectors."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.concatenate([np.stack([np.sqrt(p.shape[1]) * p.mean(1), np.sqrt(p.shape[1]) * p.std(1)], 1) for p in parts], axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of the rows of a with those of b, within the bounds of a long."""
    with np.errstate(over="ignore"):
        large = len(a) and not float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT
    if large:
        return np.array([max(-LONG - 1, min(LONG, sum(int(x) * int(y) for x, y in zip(r, c, strict=True)))) for r, c in zip(a, b, strict=True)], dtype=np.int64)
    return np.einsum("ij,ij->i", a, b).astype(np.int64)


class Block:
    """Queries of one length with their features, and the best finds so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, order: np.ndarray, least: np.ndarray | None = None):
        self.ids, self.x, self.k, self.order = ids, x, k, order
        self.f = self._features(x)
        self.least = np.full(len(ids), -np.inf) if least is None else least.astype(float)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), best first

    def _features(self, x: np.ndarray) -> list[np.ndarray]:
        x = x[:, self.order]
        return [features(x, s) for s in LEVELS if s < x.shape[1]]

    def offer(self, ids: np.ndarray, x: np.ndarray) -> int:
        """Take candidates in; returns the number of pairs that were scored exactly."""
        return sum(self._strip(ids[at : at + STRIP], x[at : at + STRIP]) for at in range(0, len(ids), STRIP))

    def _strip(self, ids: np.ndarray, x: np.ndarray) -> int:
        with np.errstate(over="ignore", invalid="ignore"):
            norm_q, norm_c = (np.sqrt((y * y).sum(1)) for y in (self.x, x))
            q, c = np.arange(len(self.ids)), np.arange(len(ids))
            open_ = None
            for own, other in zip(self.f, self._features(x), strict=True):
                bound = own[q] @ other[c].T
                bound += 1e-9 * (1 + norm_q[q, None] * norm_c[c])
                left = ~(bound < self.least[q, None])  # what can't be compared stays
                if open_ is not None:
                    left &= open_
                rows, cols = left.any(1), left.any(0)
                q, c, open_ = q[rows], c[cols], left[np.ix_(rows, cols)]
                if not len(q):
                    return 0
        if open_ is None:
            open_ = np.ones((len(q), len(c)), bool)
        open_ &= self.ids[q, None] != ids[c]
        i, j = np.nonzero(open_)
        for at in range(0, len(i), 1 << 18):
            self._score(q[i[at : at + (1 << 18)]], c[j[at : at + (1 << 18)]], ids, x)
        return len(i)

    def _score(self, q: np.ndarray, c: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Exact scores of pairs, sorted by query."""
        found = product(x[c], self.x[q])
        good = found >= self.least[q]
        q, c, found = q[good], c[good], found[good]
        first = np.concatenate([[0], np.nonzero(q[1:] != q[:-1])[0] + 1, [len(q)]])
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if a == z:
                continue
            k, own, at = int(q[a]), found[a:z], c[a:z]
            if len(own) > self.k:
                keep = own >= np.partition(own, -self.k)[-self.k]
                own, at = own[keep], at[keep]
            best = sorted(self.best[k] + [(-s, i) for s, i in zip(own.tolist(), ids[at].tolist(), strict=True)])[: self.k]
            self.best[k] = best
            if len(best) == self.k:
                self.least[k] = max(self.least[k], float(-best[-1][0]))

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"query_id": int(q), "vec_id": i, "score": -s} for q, best in zip(self.ids, self.best, strict=True) for s, i in best], OUT)


def usable(df: DataFrame, id_col: str, vec_col: str, scale: float | None) -> DataFrame:
    """id and x, an array of finite doubles, of the rows that take part; floored multiples of scale if given."""
    x = F.col("x")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    if scale is None:
        return out
    # From 2**53 on, every double is a whole number.
    scaled = F.transform(x, lambda v: F.when(F.abs(v * F.lit(scale)) < 2**60, F.floor(v * F.lit(scale)).cast("double")).otherwise(v * F.lit(scale)))
    return out.withColumn("x", scaled).where(F.forall("x", lambda v: F.abs(v) < F.lit(float("inf"))))


def by_length(ids: list[int], vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    kinds: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        kinds.setdefault(len(v), []).append(i)
    return {n: (np.array([ids[i] for i in at], dtype=np.int64), np.array([vectors[i] for i in at], dtype=np.float64)) for n, at in kinds.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score from tables of (id, x); queries and vectors as usable() gives them."""
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // block))
    seed = vectors.limit(SEED).collect()
    seed = by_length([r["id"] for r in seed], [r["x"] for r in seed])
    parts = []
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        kinds = by_length([r["id"] for r in own], [r["x"] for r in own])
        ready = []
        for size, (ids, x) in kinds.items():
            order = np.argsort(-np.nan_to_num(seed[size][1].var(0)), kind="stable") if size in seed else np.arange(size)
            b = Block(ids, x, k, order)
            if size in seed:
                b.offer(*seed[size])
            ready.append((size, ids, x, order, b.least))
        sent = spark.sparkContext.broadcast(ready)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = {size: Block(ids, x, k, order, least) for size, ids, x, order, least in sent.value}
            for b in batches:
                for size, (ids, x) in by_length(b.column(0).to_pylist(), b.column(1).to_pylist()).items():
                    if size in held:
                        held[size].offer(ids, x)
            for x in held.values():
                if len(rows := x.rows()):
                    yield rows

        found = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
        parts.append(cut(found) if blocks > 1 else found)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
