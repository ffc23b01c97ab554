"""Mixing sources to target weights by temperature.

A source's share of the tokens is raised to an exponent between 0 (all sources alike)
and 1 (as they are) and normalised.  The exponent is bisected to the smallest that
keeps a repetition limit (no source is repeated more often), or to the one that meets
a target entropy.  The budget of tokens is the smallest that takes every source whole
at least once, unless one is given.

The weights are realised as budgeted block permutations: for each pass over a source,
a keyed hash of (seed, pass, doc_id) puts its documents into blocks and orders them
inside; blocks are taken in order until the source's budget is met.  Full passes take
all blocks.  The last, partial pass takes whole blocks while they fit, then documents
of one more block up to the one that reaches the budget.  A document's place in the
mixture is the fraction of its source's schedule before it, so that any stretch of the
mixture holds the sources in their weights.

Block sums are pre-aggregated and only one block of each source is ordered, so a source
that holds most rows is spread over all tasks.  Tokens are words (runs of characters
other than space and tab to carriage return).  Null and empty texts have none; they are
taken in every full pass.  Null sources are a source of their own.  Documents with equal
hashes (repeated ids) are taken or left together, null ids hash as an empty id.  Other
columns pass through mix(); an empty table gives no rows.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import SPACE, cut

MAX_REPEATS = 2.0
BLOCKS = 1024
#: Sources that are sent out at once; more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def n_tokens(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.regexp_count(t, F.lit(r"[ \t-\r]+")) + 1).cast("long")


def place(seed: int, turn: Column, doc: Column) -> Column:
    """Where a pass puts a document: 32 hex digits, of which the first three are the block."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), F.coalesce(doc.cast("string"), F.lit(""))))


def block_of(key: Column) -> Column:
    return (F.conv(F.substring(key, 1, 4), 16, 10).cast("long") * BLOCKS / 65536).cast("int")


def weights(tokens: list[float], exponent: float) -> list[float]:
    top = max(tokens)
    raw = [(t / top) ** exponent for t in tokens]
    return [x / sum(raw) for x in raw]


def entropy(shares: list[float]) -> float:
    return -sum(x * math.log(x) for x in shares if x > 0)


def solve(tokens: list[float], max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: float | None = None) -> tuple[float, list[float], float]:
    """(exponent, weights, budget) for sources of so many tokens each (more than 0)."""

    def state(e: float) -> tuple[list[float], float]:
        w = weights(tokens, e)
        return w, budget or max(t / x for t, x in zip(tokens, w, strict=True))

    def too_flat(e: float) -> bool:
        w, b = state(e)
        if target_entropy is not None:
            return entropy(w) > target_entropy
        return max(b * x / t for t, x in zip(tokens, w, strict=True)) > max_repeats

    low, high = 0.0, 1.0
    if not too_flat(low):
        high = low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high, *state(high)


def schedule(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """mix_source, mix_weight, mix_exponent, mix_quota, mix_passes, mix_last: what each source gives.

    mix_passes full passes, then of one more pass the documents whose place is up to
    mix_last.  One row for each source; sources without tokens give their rows once.
    """
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    size = cut(df.select(F.col(id_col).alias("doc"), src.alias("mix_source"), n_tokens(F.col(text_col).cast("string")).alias("n")))
    spark = df.sparkSession
    totals = size.groupBy("mix_source").agg(F.sum("n").alias("tokens"))
    # Sources are few beside documents; the solver needs one number of each.
    rows = totals.orderBy("mix_source").collect()
    full = [r for r in rows if r["tokens"]]
    out = []
    if full:
        exponent, w, b = solve([float(r["tokens"]) for r in full], max_repeats, target_entropy, budget)
        for r, x in zip(full, w, strict=True):
            quota = max(1, round(b * x))
            out.append((r["mix_source"], x, exponent, quota, quota // r["tokens"], quota % r["tokens"]))
    out += [(r["mix_source"], 0.0, 1.0, 0, 1, 0) for r in rows if not r["tokens"]]
    plan = spark.createDataFrame(out, "mix_source string, mix_weight double, mix_exponent double, mix_quota long, mix_passes long, rest long")
    last = joined(size, plan.where("rest > 0")).withColumn("key", place(seed, F.col("mix_passes"), F.col("doc"))).select("mix_source", "rest", "n", "key", block_of(F.col("key")).alias("block"))
    sums = last.groupBy("mix_source", "rest", "block").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("mix_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).select("mix_source", "block", "before")
    inside = last.join(F.broadcast(edge) if len(rows) <= BROADCAST_SOURCES else edge, ["mix_source", "block"])
    sofar = F.col("before") + F.coalesce(F.sum("n").over(Window.partitionBy("mix_source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    reach = inside.withColumn("sofar", sofar).where(F.col("sofar") >= F.col("rest")).groupBy("mix_source").agg(F.min("key").alias("mix_last"))
    return cut(plan.join(reach, "mix_source", "left").drop("rest"))


def joined(df: DataFrame, plan: DataFrame, on: str = "mix_source") -> DataFrame:
    """df with its sources' rows of plan; plan is sent out only while it is short."""
    return df.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, on)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **how) -> DataFrame:
    """df's rows as often as the mixture takes them, with mix_pass, mix_block, mix_place (0 to 1) and mix_weight."""
    plan = schedule(df, id_col, text_col, source_col, seed, **how)
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = joined(df.withColumn("mix_source", src), plan)
    partial = F.coalesce(place(seed, F.col("mix_passes"), F.col(id_col)) <= F.col("mix_last"), F.lit(False))
    passes = F.col("mix_passes") + partial.cast("long")
    turns = F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes - 1)).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("mix_pass", F.explode(turns))
    key = place(seed, F.col("mix_pass"), F.col(id_col))
    whole = F.col("mix_passes") + F.coalesce(F.conv(F.substring("mix_last", 1, 8), 16, 10).cast("double") / 2**32, F.lit(0.0))
    at = (F.col("mix_pass") + F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2**32) / whole
    return rows.withColumn("mix_block", block_of(key)).withColumn("mix_place", at).drop("mix_source", "mix_exponent", "mix_quota", "mix_passes", "mix_last")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), "mix_pass", "mix_block", F.round("mix_place", 9).alias("mix_place"), F.round("mix_weight", 9).alias("mix_weight"))
