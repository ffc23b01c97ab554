"""Evaluation and feature statistics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prf(gold: Column, pred: Column) -> list[Column]:
    """Precision, recall, F1 and counts of 0/1 columns as aggregates."""
    tp, fp, fn = (F.count_if(c) for c in ((gold == 1) & (pred == 1), (gold == 0) & (pred == 1), (gold == 1) & (pred == 0)))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 8)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1")]


def sweep(scored: DataFrame, steps: int = 100) -> DataFrame:
    """P, R, F1 at thresholds 0, 1/steps, ..., 1 of (y, score in [0, 1]).

    Rows are counted into steps first, so the thresholds meet a histogram and not the rows.
    """
    hist = scored.groupBy(F.floor(F.col("score") * steps).cast("long").alias("s")).agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    t = hist.sparkSession.range(steps + 1).select(F.col("id").alias("step"))
    j = F.broadcast(hist).crossJoin(t).groupBy("step").agg(F.sum(F.when(F.col("s") >= F.col("step"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s") >= F.col("step"), F.col("n")).otherwise(0)).alias("pred"), F.sum("pos").alias("gold"))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 8)
    return j.select("step", part(F.col("tp"), F.col("pred")).alias("precision"), part(F.col("tp"), F.col("gold")).alias("recall"), part(2 * F.col("tp"), F.col("pred") + F.col("gold")).alias("f1"))


#: Score ranges that running sums are taken over first; only their sums meet in one task.
RANGES = 4096


def running(scored: DataFrame) -> DataFrame:
    """score, pos, neg and above_pos, above_neg, the sums over higher scores, one row for each distinct score of (y, score in [0, 1])."""
    g = scored.groupBy("score").agg(F.sum("y").alias("pos"), (F.count("*") - F.sum("y")).alias("neg")).withColumn("range", F.floor(F.col("score") * RANGES))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ranges = g.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select("range", total("p", above).alias("p"), total("n", above).alias("n"))
    j = g.join(F.broadcast(ranges), "range")
    return j.select("score", "pos", "neg", (F.col("p") + total("pos", inside)).alias("above_pos"), (F.col("n") + total("neg", inside)).alias("above_neg"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of (y, score in [0, 1]): for each negative the positives above it, and half of those beside it."""
    won = F.sum(F.col("neg") * (F.col("above_pos") + F.col("pos") / 2))
    return running(scored).agg(F.round(won / (F.sum("pos") * F.sum("neg")), 8).alias("auc"))


#: A sketch's error is 1 / ACCURACY of a group's rows; groups of no more rows are sorted whole.
ACCURACY = 10_000


def quantiles(df: DataFrame, by: str, x: str, shares: list[float]) -> DataFrame:
    """by and q0, q1, ...: exact interpolated quantiles of each group's values that are not null.

    A sketch bounds each quantile, then the rows below the bounds are counted and only
    the distinct values between them are put in order: some ten-thousandths of the group.
    """
    rows = df.select(F.col(by).alias("_g"), F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL")
    at = lambda p: F.percentile_approx("_x", F.lit(min(1.0, max(0.0, p))), F.lit(ACCURACY))
    slack = 3 / ACCURACY
    few = F.count("*") <= ACCURACY
    ends = [F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.when(~few, at(p - slack)).alias("low"), F.when(~few, at(p + slack)).alias("high")) for i, p in enumerate(shares)]
    bounds = rows.groupBy(F.col("_g").alias("_h")).agg(F.count("*").alias("_n"), F.array(*ends).alias("_ends"))
    # Values below a bound fall together before the shuffle, as one value a quantile.
    near = rows.join(bounds, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_x", "_n", F.explode(F.filter("_ends", lambda e: e["high"].isNull() | (F.col("_x") <= e["high"]))).alias("_e"))
    value = F.when(F.col("_e.low").isNull() | (F.col("_x") >= F.col("_e.low")), F.col("_x"))
    counts = near.groupBy("_g", F.col("_e.i").alias("i"), value.alias("v")).agg(F.count("*").alias("c"), F.first("_n").alias("n"), F.first("_e.p").alias("p"))
    upto = F.sum("c").over(Window.partitionBy("_g", "i").orderBy(F.asc_nulls_first("v")))
    place = F.col("p") * (F.col("n") - 1)
    ranked = counts.withColumn("upto", upto).where("v IS NOT NULL").withColumn("place", place)
    nth = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    part = F.first(F.col("place") - F.floor("place"))
    one = ranked.groupBy("_g", "i").agg((nth(F.floor("place")) * (1 - part) + nth(F.ceil("place")) * part).alias("q"))
    return one.groupBy(F.col("_g").alias(by)).agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(shares))))


def describe(df: DataFrame, by: str, x: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each group."""
    plain = df.groupBy(by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("sd"), F.round(F.min(x), 6).alias("low"), F.round(F.max(x), 6).alias("high"))
    q = quantiles(df, by, x, [0.25, 0.5, 0.75]).withColumnRenamed(by, "_by")
    return plain.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "sd", "low", *(F.round(f"q{i}", 6).alias(f"q{i + 1}") for i in range(3)), "high")


def inliers(df: DataFrame, by: str, x: str) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles of their group."""
    q = quantiles(df, by, x, [0.25, 0.75]).withColumnRenamed(by, "_by")
    reach = 1.5 * (F.col("q1") - F.col("q0"))
    return df.join(q, F.col(by) == F.col("_by")).where(F.col(x).between(F.col("q0") - reach, F.col("q1") + reach)).drop("q0", "q1", "_by")


def folds(df: DataFrame, label: str, key: str, n: int = 10) -> DataFrame:
    """A stratified fold for each row, by hash: shares of a label differ by chance alone and no label meets in one task."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col(label), F.col(key)), F.lit(n)).cast("int"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over distinct scores, falling, of precision times the gain in recall, of (y, score in [0, 1])."""
    tp = F.col("above_pos") + F.col("pos")
    return running(scored).agg(F.round(F.sum(F.col("pos") * tp / (tp + F.col("above_neg") + F.col("neg"))) / F.sum("pos"), 8).alias("average_precision"))


def best_threshold(scored: DataFrame, steps: int = 100) -> DataFrame:
    """The step of the sweep with the highest F1, the first of equal ones, and the accuracy there."""
    top = sweep(scored, steps).orderBy(F.desc("f1"), "step").limit(1)
    hit = (F.floor(F.col("score") * steps) >= F.col("step")).cast("int") == F.col("y")
    return scored.crossJoin(F.broadcast(top)).groupBy("step", "f1").agg(F.round(F.avg(hit.cast("int")), 8).alias("accuracy"))


def pair_prf(gold: DataFrame, pred: DataFrame, on: tuple[str, str] = ("key", "phrase")) -> DataFrame:
    """Precision, recall and F1 of sets of pairs, and how many wrong predictions are gold pairs turned round."""
    a, b = on
    g, p = (x.select(*on).distinct().withColumn(n, F.lit(1)) for x, n in ((gold, "gold"), (pred, "pred")))
    turned = g.select(F.col(b).alias(a), F.col(a).alias(b), F.lit(1).alias("turned"))
    j = g.join(p, [*on], "full_outer").join(turned, [*on], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.agg(*prf(zero("gold"), zero("pred")), F.count_if((zero("pred") == 1) & (zero("gold") == 0) & (zero("turned") == 1)).alias("reversed"))


def misclassified(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.where((F.col("score") >= threshold).cast("int") != F.col("y"))


def small_classes(df: DataFrame, by: str, least: int) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") < least)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: Pearson's r of each pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"{i}"), 6).alias("r")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def micro_prf(gold: DataFrame, found: DataFrame) -> DataFrame:
    """tp, fp, fn and the ratios over the (key, phrase) pairs of all keys of either side; 0 where a ratio has no base."""
    g, f = (x.select("key", "phrase").distinct().withColumn(n, F.lit(1)) for x, n in ((gold, "g"), (found, "f")))
    n = g.join(f, ["key", "phrase"], "full_outer").agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    ratio = lambda a, b: F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 8)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return n.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
