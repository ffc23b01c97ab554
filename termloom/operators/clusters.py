"""Phrase clusters: grouping of occurrences, contexts, lemma statistics, term selection."""

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T


def clusters(occ: DataFrame, docs: DataFrame) -> DataFrame:
    """One row a key: occurrences, frequency by document of the corpus, the first occurrence's model, documents."""
    by_doc = occ.groupBy("key", "doc_id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "sent_no", "start", "end", "model")).alias("at"))
    return with_frequency(by_doc.groupBy("key").agg(F.sum("n").alias("cnt"), F.min("at")["model"].alias("model"), F.count("*").alias("docs")), docs)


def with_frequency(keys: DataFrame, docs: DataFrame) -> DataFrame:
    n = docs.select("doc_id").distinct().agg(F.count("*").alias("n_docs"))
    return keys.crossJoin(F.broadcast(n)).select("key", "cnt", F.round(F.col("cnt") / F.col("n_docs"), 8).alias("frequency"), "model", "docs")


def clusters_of(by_doc: DataFrame, docs: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """clusters() from the counts by key and document (patterns.counted), model giving a model's name from its number."""
    return with_frequency(by_doc.groupBy("key").agg(F.sum("n").alias("cnt"), model(F.min_by("m", "doc_id")).alias("model"), F.count("*").alias("docs")), docs)


def context_links(occ: DataFrame, sentences: DataFrame) -> DataFrame:
    """key, sha, head of the distinct sentences of each key: a sentence goes by its sha256, as a long one has many keys."""
    s = sentences.select("doc_id", "sent_no", F.sha2("sentence", 256).alias("sha"), T.leading_bits(F.col("sentence")).alias("head"))
    return occ.join(s, ["doc_id", "sent_no"]).select("key", "sha", "head").distinct()


def contexts(occ: DataFrame, sentences: DataFrame) -> DataFrame:
    """key, sentence: the distinct sentences of each key, one a row, as a frequent key has too many for one.

    The links are in front of a merge, so that a text is not held once for each of its keys.
    """
    texts = sentences.select(F.sha2("sentence", 256).alias("sha"), "sentence").dropDuplicates(["sha"])
    return context_links(occ, sentences).hint("merge").join(texts, "sha").select("key", "sentence")


def context_digests(contexts: DataFrame) -> DataFrame:
    """key, the number of its contexts (or links to them) and a digest of them in any order: the sum of the leading 48 bits of their md5."""
    head = F.col("head") if "head" in contexts.columns else T.leading_bits(F.col("sentence"))
    return contexts.groupBy("key").agg(F.sum(head.cast("decimal(38,0)")).cast("string").alias("context"), F.count("*").alias("n"))


#: What stands for a key where its words are looked up: 128 bits, as a key can be long and have many words.
ID = ("_h1", "_h2")


def identified(keys: DataFrame) -> DataFrame:
    return keys.withColumn("_h1", F.xxhash64("key")).withColumn("_h2", F.xxhash64(F.lit("key"), "key"))


def key_words(keys: DataFrame) -> DataFrame:
    """The id of each key and its words, each once."""
    return identified(keys).select(*ID, F.explode(F.array_distinct(F.split("key", " "))).alias("w"))


def select_terms(clusters: DataFrame, tfidf: DataFrame, threshold: float = 0.0000088, max_frequency: float = 1.0) -> DataFrame:
    """Clusters but for those with a lemma of low tf-idf that are rare, and those with a roman numeral.

    The clusters are kept, as they are read twice, until the caller clears the cache.
    """
    kept = clusters.where(~T.roman(F.col("key"))).select("key", "cnt", "frequency").persist(StorageLevel.MEMORY_AND_DISK)
    lemmas = key_words(kept).join(tfidf.select("w", "tfidf"), "w", "left")
    low = lemmas.groupBy(*ID).agg(F.round(F.min(F.coalesce("tfidf", F.lit(0.0))), 9).alias("low"))
    return identified(kept).join(low, [*ID]).where(~((F.col("low") < threshold) & (F.col("frequency") <= max_frequency))).select("key", "cnt", "low")


def label_filter(clusters: DataFrame) -> DataFrame:
    """Drops everyday and colloquial phrases of weak relevance, and general ones that are rare and weak throughout."""
    weak = (F.col("topic_relevance") < 0.5) & ~F.col("tag_match")
    colloquial = F.col("label").isin("colloquial phrase", "everyday expression") & (weak | ((F.col("label") == "everyday expression") & (F.col("centrality") < 0.2)))
    general = (F.col("label") == "general phrase") & (F.col("frequency") < 0.0032) & (F.col("topic_relevance") <= 0.5) & (F.col("centrality") < 0.5)
    return clusters.where(~F.coalesce(colloquial | general, F.lit(False)))


def one_word_terms(clusters: DataFrame) -> DataFrame:
    """Words of two or more clusters with the spread of the clusters' frequencies."""
    w = clusters.select(F.explode(F.array_distinct(F.split("key", " "))).alias("noun"), "frequency")
    return w.groupBy("noun").agg(F.count("*").alias("phrases"), *(F.round(f("frequency"), 8).alias(n) for f, n in ((F.avg, "mean_f"), (F.max, "max_f"), (F.min, "min_f")))).where("phrases > 1")


def low_tfidf_phrases(clusters: DataFrame, tfidf: DataFrame, threshold: float) -> DataFrame:
    """Phrases with a lemma of low tf-idf, marked # if they occur more than once or are relevant.

    The clusters are kept, as they are read twice, until the caller clears the cache.
    """
    kept = clusters.persist(StorageLevel.MEMORY_AND_DISK)
    low = key_words(kept).join(tfidf.where(F.col("tfidf") < threshold).select("w"), "w", "left_semi").select(*ID).distinct()
    mark = F.when((F.col("cnt") > 1) | (F.col("topic_relevance") > 0.4), F.lit("#")).otherwise(F.lit(""))
    return identified(kept).join(low, [*ID], "left_semi").select(F.concat(mark, "key").alias("phrase"))


def with_lemma(clusters: DataFrame, lemma: str) -> DataFrame:
    """Clusters of which the lemma is a word."""
    return clusters.where(F.array_contains(F.split("key", " "), lemma))


def combined_topics(topics: DataFrame, most: int | None = None) -> DataFrame:
    """key and the topics of its words (key, word, topic, sim), each once, by their best similarity."""
    best = topics.groupBy("key", "topic").agg(F.max("sim").alias("sim"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("a"), "topic")))
    return best.groupBy("key").agg(F.transform(F.slice(order, 1, most) if most else order, lambda x: x["topic"]).alias("topics"))
