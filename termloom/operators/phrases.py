"""Phrase tables: rarity, grouping, similar keys, prefixes, containment, votes."""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators.ordered import in_ranges, running_count, with_neighbour


def inverse_rarity(phrases: DataFrame) -> DataFrame:
    """For each phrase the sum over its distinct words of 1 / (phrases that hold the word)."""
    words = phrases.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("w"))
    n = words.groupBy("w").agg(F.count("*").alias("n"))
    return words.join(n, "w").groupBy("phrase").agg(F.sum(1 / F.col("n")).alias("rarity"))


def grouped(phrases: DataFrame) -> DataFrame:
    """Phrases of the same words in any order, groups of two or more."""
    key = F.array_join(F.array_sort(F.split("phrase", " ")), " ")
    return phrases.groupBy(key.alias("words")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("phrase")), "|").alias("phrases")).where("n > 1")


def merge_similar(clusters: DataFrame) -> DataFrame:
    """Islands of neighbouring similar keys, named by their first: head, n keys, summed count."""
    parts = with_neighbour(in_ranges(clusters.select("key", "cnt"), "key"), "key", ["key"], "prev")
    island = running_count(parts, "key", ~F.coalesce(T.keys_similar(F.col("prev.key"), F.col("key")), F.lit(False)))
    return island.groupBy("_run").agg(F.min("key").alias("head"), F.count("*").alias("n"), F.sum("cnt").alias("cnt")).select("head", "n", "cnt")


def prefix_roots(keys: DataFrame) -> DataFrame:
    """key and root, the shortest other key that is a prefix of it; roots and single keys have none.

    Every prefix of a key is looked up, so the join is on equality.
    """
    heads = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.left(F.col("key"), i))).alias("head"))
    hit = heads.where("head <> key").join(keys.select(F.col("key").alias("head")), "head")
    return hit.groupBy("key").agg(F.min_by("head", F.length("head")).alias("root"))


def sub_ngrams(phrase):
    """All runs of words of a phrase, strictly shorter than it."""
    w = F.split(phrase, " ")
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(w, i, k), " ")))
    return F.filter(F.array_distinct(F.flatten(runs)), lambda g: g != phrase)


def sub_phrases(phrases: DataFrame) -> DataFrame:
    """phrase, part: shorter phrases of the table that are runs of its words; an equality join on n-grams."""
    parts = phrases.select("phrase", F.explode(sub_ngrams(F.col("phrase"))).alias("part"))
    return parts.join(phrases.select(F.col("phrase").alias("part")), "part").select("phrase", "part")


def stem(phrase):
    return F.array_join(F.transform(F.split(phrase, " "), T.cut_stem), " ")


def stemmed_sub_phrases(parents: DataFrame, phrases: DataFrame) -> DataFrame:
    """parent, phrase: the parent's words, each cut by two characters, stand in a row among the phrase's."""
    p = parents.select(F.col("phrase").alias("parent"), stem(F.col("phrase")).alias("part"))
    c = phrases.select("phrase", F.explode(F.array_union(sub_ngrams(stem(F.col("phrase"))), F.array(stem(F.col("phrase"))))).alias("part"))
    return c.join(p, "part").where("parent <> phrase").select("parent", "phrase")


def usage_variants(base: DataFrame, phrases: DataFrame) -> DataFrame:
    """base, variant: a two-word phrase stands as a substring in a longer phrase.

    A hit inside words starts with a suffix of one word and ends with a prefix of the
    next, so both sides are keyed by (last letter before, first letter after) a space;
    the substring test follows.
    """
    b = base.select(F.col("phrase").alias("base"), F.concat(F.right(F.element_at(F.split("phrase", " "), 1), F.lit(1)), F.lit(" "), F.left(F.element_at(F.split("phrase", " "), 2), F.lit(1))).alias("k"))
    w = F.split("phrase", " ")
    around = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.right(F.element_at(w, i), F.lit(1)), F.lit(" "), F.left(F.element_at(w, i + 1), F.lit(1))))
    v = phrases.where(F.size(w) > 2).select(F.col("phrase").alias("variant"), F.explode(F.array_distinct(around)).alias("k"))
    return v.join(b, "k").where(F.expr("contains(variant, base)")).select("base", "variant").distinct()


def votes(neighbours: DataFrame, taxonomy: DataFrame, first: float = 1.0, second: float = 0.5, top: int = 10) -> DataFrame:
    """query, hypernym, vote from (query, phrase, sim): a neighbour that is in the taxonomy votes for itself, and for its parts, whose own parts get half."""
    tax = taxonomy.select(F.col("phrase").alias("part"))
    own = neighbours.select("query", F.explode(F.array_union(sub_ngrams(F.col("phrase")), F.array("phrase"))).alias("part"), "sim")
    hit = own.join(tax, "part")
    one = hit.select("query", F.col("part").alias("hypernym"), (F.col("sim") * first).alias("vote"))
    two = hit.select("query", F.explode(sub_ngrams(F.col("part"))).alias("part"), (F.col("sim") * second).alias("vote")).join(tax, "part").select("query", F.col("part").alias("hypernym"), "vote")
    summed = one.unionAll(two).where("hypernym <> query").groupBy("query", "hypernym").agg(F.round(F.sum("vote"), 6).alias("vote"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("vote"), "hypernym"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= top)


def by_stripped_noun(words: DataFrame) -> DataFrame:
    """Single words (noun, n, tf_idf, mean, high, low, is_term) grouped without their plural ending."""
    avg = lambda c: F.round(F.avg(c), 6).alias(c)
    return words.groupBy(T.suffix_strip(F.col("noun")).alias("noun")).agg(F.sum("n").alias("n"), *map(avg, ("tf_idf", "mean", "high", "low")), F.max("is_term").alias("is_term"))


#: Endings that stand for each other, and the one that is kept. Fixed values.
ENDINGS = (("ой", "ый", "ый"), ("а", "", ""), ("и", "", ""), ("ов", "", ""))


def merge_endings(phrases: DataFrame, endings: tuple = ENDINGS, rounds: int = 20) -> DataFrame:
    """phrase, canonical: phrases that differ in the ending of one word alone take one form.

    Each phrase gives a key for every word and ending: the word's place, its root and the
    rest; phrases of different endings under one key are the same.  A round is one
    aggregation; a form that changes can meet others in the next round.  It ends when none
    does: forms only get shorter, or go from one ending to another, so the rounds are few.
    """
    def cases(end: str, rule: str, keep: str) -> Column:
        """Each word that ends so, by its place."""
        root = lambda x: F.when(F.endswith(x, F.lit(end)), F.left(x, F.length(x) - len(end)))
        return F.transform(F.split("canonical", " "), lambda x, i: F.struct(i.alias("at"), root(x).alias("root"), F.lit(rule).alias("rule"), F.lit(end).alias("end"), F.lit(keep).alias("keep")))

    every = F.concat(*(cases(e, f"{a}/{b}", keep) for a, b, keep in endings for e in (a, b)))
    out = phrases.select("phrase", F.col("phrase").alias("canonical")).distinct()
    for _ in range(rounds):
        keyed = out.select("canonical").distinct().withColumn("k", F.explode(F.filter(every, lambda s: s["root"].isNotNull()))).select("canonical", "k.*")
        rest = F.transform(F.split("canonical", " "), lambda x, i: F.when(i == F.col("at"), F.concat("root", F.lit("\x01"))).otherwise(x))
        form = F.transform(F.split("canonical", " "), lambda x, i: F.when(i == F.col("at"), F.concat("root", "keep")).otherwise(x))
        keyed = keyed.select("canonical", "rule", "at", "end", F.array_join(rest, " ").alias("key"), F.array_join(form, " ").alias("form"))
        met = keyed.groupBy("rule", "at", "key").agg(F.min("end").alias("e1"), F.max("end").alias("e2")).where("e1 <> e2").select("rule", "at", "key")
        new = keyed.join(met, ["rule", "at", "key"]).groupBy("canonical").agg(F.min("form").alias("form"))
        new = new.where("form <> canonical").persist(StorageLevel.MEMORY_AND_DISK)
        if new.isEmpty():
            return out
        out = out.join(new, "canonical", "left").select("phrase", F.coalesce("form", "canonical").alias("canonical"))
    raise RuntimeError(f"forms still change after {rounds} rounds")


def canonical_rows(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows (phrase, n, score, tag) by canonical phrase: sum, largest and mean score, tags in order."""
    j = rows.join(merged, "phrase")
    return j.groupBy(F.col("canonical").alias("phrase")).agg(F.sum("n").alias("n"), F.max("score").alias("top"), F.round(F.avg("score"), 6).alias("mean"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def without_repeats(spans: DataFrame, text: str = "text_form") -> DataFrame:
    """Spans of a sentence without those whose text is that of the one before."""
    w = Window.partitionBy("doc_id", "sent_no").orderBy("start", "end", "model")
    return spans.withColumn("_before", F.lag(text).over(w)).where(~F.col(text).eqNullSafe(F.col("_before"))).drop("_before")


def normalized(phrase: Column, tags: Column, allowed: tuple[str, ...]) -> Column:
    """The lemmas of a phrase's tokens (w, lemma, pos), of the allowed parts of speech or of none, joined; empty if a preposition stands first or last."""
    kept = F.filter(tags, lambda t: t["pos"].isNull() | t["pos"].isin(*allowed))
    edge = lambda i: F.coalesce(F.try_element_at(kept, F.lit(i))["pos"] == "ADP", F.lit(False))
    return F.when(phrase.isNull() | edge(1) | edge(-1), F.lit("")).otherwise(F.array_join(F.transform(kept, lambda t: t["lemma"]), " "))


def head_noun(tags: Column) -> Column:
    """The first noun of a phrase's tokens (w, lemma, pos): no parser is at hand, and it is the root of most terms."""
    return F.try_element_at(F.filter(tags, lambda t: t["pos"] == "NOUN"), F.lit(1))["lemma"]


def prefix_exclusion(clusters: DataFrame, first: tuple, second: tuple, third: str, low_centrality: float = 0.15, low_tfidf: float = 8.8e-6) -> DataFrame:
    """Clusters (key, model, centrality, tfidf, frequency) without weak pairs of a phrase and its extension.

    A key of a model in `first` goes, with its right neighbour in sorted order, if that
    one starts with it, is of the paired model, has a rest (without its first word) of
    model `third` among the keys, the key is off-centre, and one of the three is rare by
    tf-idf.
    """
    nxt = with_neighbour(in_ranges(clusters, "key"), "key", ["key", "model", "tfidf"], "n", after=True)
    paired = F.lit(False)
    for a, b in zip(first, second, strict=True):
        paired = paired | ((F.col("model") == a) & (F.col("n.model") == b))
    cand = nxt.where(paired & F.startswith(F.col("n.key"), F.col("key")) & (F.col("centrality") < low_centrality))
    rest = F.substr(F.col("n.key"), F.position(F.lit(" "), F.col("n.key")) + 1)
    t = clusters.where(F.col("model") == third).select(F.col("key").alias("rest"), F.col("tfidf").alias("tfidf3"))
    weak = cand.withColumn("rest", rest).join(t, "rest").where(F.least("tfidf", "n.tfidf", "tfidf3") < low_tfidf)
    gone = weak.select(F.explode(F.array("key", "n.key")).alias("key")).distinct()
    return clusters.join(gone, "key", "left_anti")
