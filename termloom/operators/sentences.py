"""Relations found inside sentences: pairs of keys, trigger words, contexts of single words."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_pairs(keys: DataFrame, sentence: list[str]) -> DataFrame:
    """hyper, hypo of keys (columns sentence, i, key) that share a sentence; the one of fewer words is hyper, the earlier one if equal."""
    n = lambda c: F.size(F.split(c, " "))
    a = keys.select(*sentence, F.col("i").alias("i1"), F.col("key").alias("k1"))
    b = keys.select(*sentence, F.col("i").alias("i2"), F.col("key").alias("k2"))
    pairs = a.join(b, sentence).where((F.col("i1") < F.col("i2")) & (F.col("k1") != F.col("k2")))
    first = n(F.col("k1")) <= n(F.col("k2"))
    return pairs.select(*sentence, F.when(first, F.col("k1")).otherwise(F.col("k2")).alias("hyper"), F.when(first, F.col("k2")).otherwise(F.col("k1")).alias("hypo")).distinct()


def words_in(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def last_of(text: Column, key: Column) -> Column:
    """Where key starts last in text, from 1; 0 if it isn't there."""
    at = F.position(F.reverse(key), F.reverse(text))
    return F.when(at > 0, F.length(text) - F.length(key) - at + 2).otherwise(F.lit(0))


def first_trigger(text: Column, triggers: list[str]) -> Column:
    """The first trigger of the list that stands in text."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in triggers))


def before(text: Column, trigger: Column, key: Column, gap: int = 2) -> Column:
    """key ends before the trigger with at most gap words between."""
    head = F.left(text, F.position(trigger, text) - 1)
    at = last_of(head, key)
    return (at > 0) & (words_in(F.substr(head, at + F.length(key))) <= gap)


def after(text: Column, trigger: Column, key: Column, gap: int = 2) -> Column:
    """key starts behind the trigger with at most gap words between; a key that isn't there may straddle the trigger's end."""
    start = F.position(trigger, text) + F.length(trigger)
    tail = F.substr(text, start)
    at, full = F.position(key, tail), F.position(key, text)
    return F.when(at > 0, words_in(F.left(tail, at - 1)) <= gap).otherwise((full > 0) & (full < start) & (full + F.length(key) > start))


def triggered(keys: DataFrame, triggers: list[str], least: float = 0.05, top: int | None = 2) -> DataFrame:
    """sent_id, trigger, subject, predicate of sentences (sent_id, text, key, prob, manual; a row a key).

    Subjects stand before the trigger and predicates behind it; pairs with a key that is
    neither marked by hand nor at least as probable as `least` go.  Of a sentence's
    pairs the top ones by probability, then marks, then name stay.
    """
    t = keys.withColumn("trigger", first_trigger(F.lower("text"), triggers)).where("trigger is not null and not (manual = 0 and prob < %r)" % least)
    low, key = F.lower("text"), F.lower("key")
    side = lambda cond, name: t.where(cond).select("sent_id", "trigger", F.col("key").alias(name), F.col("prob").alias(f"{name}_p"), F.col("manual").alias(f"{name}_m"))
    left, right = side(before(low, F.col("trigger"), key), "subject"), side(after(low, F.col("trigger"), key), "predicate")
    pairs = left.join(right, ["sent_id", "trigger"])
    if top is not None:
        order = [F.desc(F.round(F.col("subject_p") + F.col("predicate_p"), 9)), F.desc(F.col("subject_m") + F.col("predicate_m")), "subject", "predicate"]
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("sent_id").orderBy(*order))).where(F.col("rank") <= top)
    return pairs.select("sent_id", "trigger", "subject", "predicate")


def last_keys(keys: DataFrame) -> DataFrame:
    """sent_id, subject: of a sentence's keys the one that ends last; of those that end together, the longest."""
    low, key = F.lower("text"), F.lower("key")
    at = last_of(low, key)
    ends = keys.withColumn("at", at).where("at > 0").withColumn("end", F.col("at") + F.length("key"))
    best = ends.groupBy("sent_id").agg(F.max(F.struct("end", F.length("key").alias("n"))).alias("best"))
    return ends.join(best, "sent_id").where((F.col("end") == F.col("best.end")) & (F.length("key") == F.col("best.n"))).select("sent_id", F.col("key").alias("subject")).distinct()


def across(sentences: DataFrame, keys: DataFrame, triggers: list[str]) -> DataFrame:
    """sent_id, subject, predicate where a sentence (sent_id, prev_id, text) starts with a trigger: its predicates and the last key of the sentence before."""
    starts = F.coalesce(*(F.when(F.startswith(F.lower("text"), F.lit(t)), F.lit(t)) for t in triggers))
    own = sentences.withColumn("trigger", starts).where("trigger is not null")
    right = own.join(keys.select("sent_id", "key"), "sent_id").where(after(F.lower("text"), F.col("trigger"), F.lower("key"))).select("sent_id", "prev_id", F.col("key").alias("predicate")).distinct()
    return right.join(last_keys(keys).withColumnRenamed("sent_id", "prev_id"), "prev_id").select("sent_id", "subject", "predicate")


def keys_of_sentences(sentences: DataFrame, features: DataFrame) -> DataFrame:
    """sent_id, keys: the keys of features (key, context) whose context, cut at |, holds the sentence."""
    parts = features.select("key", F.explode(F.split("context", r"\|")).alias("part")).select("key", F.trim("part").alias("part")).where("part <> ''")
    found = sentences.select("sent_id", F.trim("text").alias("part")).join(parts, "part")
    return found.groupBy("sent_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))


def noun_contexts(nouns: DataFrame, sentences: DataFrame, words: int = 5, spread: int = 3) -> DataFrame:
    """noun, contexts, docs: sentences (sent_id, doc, text) with a token like the noun.

    Nouns under five letters are looked for as they are, others without their last letter
    anywhere in a token of about the same length.  Of several contexts only those of more
    than `words` words count.  A token gives the few substrings that such a noun can
    have, so the look-up is a join on equality.
    """
    n = nouns.select("noun", F.when(F.length("noun") < 5, F.col("noun")).otherwise(F.left("noun", F.length("noun") - 1)).alias("k"), (F.length("noun") < 5).alias("whole"), F.length("noun").alias("n"))
    t = sentences.select("sent_id", "doc", words_in(F.col("text")).alias("size"), F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("t"))
    token = t.select("t").where("t <> ''").distinct()
    size = F.length("t")
    lengths = F.sequence(F.greatest(F.lit(4), size - spread - 1), F.least(size, size + spread - 1))
    subs = F.when(size >= 4, F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.substr(F.col("t"), i, m))))).otherwise(F.array().cast("array<string>"))
    near = F.abs(size - F.col("n")) <= spread
    inside = token.select("t", F.explode(F.array_distinct(subs)).alias("k")).join(n.where("not whole"), "k").where(near).select("t", "noun")
    equal = token.join(n.where("whole"), F.col("t") == F.col("k")).select("t", "noun")
    hits = t.join(inside.unionAll(equal).distinct(), "t").select("noun", "sent_id", "doc", "size").distinct()
    total = hits.groupBy("noun").agg(F.count("*").alias("n"))
    kept = hits.join(total, "noun").where((F.col("n") == 1) | (F.col("size") > words))
    return kept.groupBy("noun").agg(F.count("*").alias("contexts"), F.countDistinct("doc").alias("docs"))
