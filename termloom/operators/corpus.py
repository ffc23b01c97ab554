"""Corpus tables and statistics: paragraphs, sentences, tokens, frequencies, TF-IDF."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("para_no", "para"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_no (from 0, blank ones not counted) and sentence."""
    kept = F.filter(T.sentences(F.col("text")), lambda s: F.trim(s) != "")
    return docs.select("doc_id", F.posexplode(kept).alias("sent_no", "sentence"))


def tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w"))


def sentence_tokens(docs: DataFrame) -> DataFrame:
    return sentences(docs).select("doc_id", "sent_no", F.posexplode(T.tokens(F.col("sentence"))).alias("pos", "w"))


def digested_tokens(docs: DataFrame) -> DataFrame:
    """sentence_tokens with sha, the sentence's sha256, and head, the leading bits of its md5, at its first token."""
    t = sentences(docs).select("doc_id", "sent_no", "sentence", F.posexplode(T.tokens(F.col("sentence"))).alias("pos", "w"))
    first = lambda c: F.when(F.col("pos") == 0, c)
    return t.select("doc_id", "sent_no", "pos", "w", first(F.unhex(F.sha2("sentence", 256))).alias("sha"), first(T.leading_bits(F.col("sentence"))).alias("head"))


def word_stats(docs: DataFrame) -> DataFrame:
    """w, wf (occurrences) and df (documents): one aggregation by (word, document), one by word."""
    return tokens(docs).groupBy("w", "doc_id").agg(F.count("*").alias("n")).groupBy("w").agg(F.sum("n").alias("wf"), F.count("*").alias("df"))


def totals(docs: DataFrame) -> DataFrame:
    return docs.agg(F.countDistinct("doc_id").alias("total_docs"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))).cast("long").alias("total_texts"), F.sum(F.size(T.tokens(F.col("text")))).cast("long").alias("total_words"))


def tfidf(docs: DataFrame) -> DataFrame:
    """tf = wf / words, idf = ln(documents / (1 + df)), their product."""
    t = totals(docs)  # one row
    return word_stats(docs).crossJoin(F.broadcast(t)).select("w", "wf", "df", (F.col("wf") / F.col("total_words")).alias("tf"), F.log(F.col("total_docs") / (1 + F.col("df"))).alias("idf")).withColumn("tfidf", F.col("tf") * F.col("idf"))


def filter_texts(docs: DataFrame, min_bytes: int = 40) -> DataFrame:
    """Paragraphs with a space and enough bytes; documents without any go."""
    return paragraphs(docs).where((F.instr("para", " ") > 0) & (F.octet_length("para") >= min_bytes))


def filter_stats(stats: DataFrame) -> DataFrame:
    """Frequencies of words that the text filters keep; totals stay as they were."""
    return stats.where(~T.should_filter_out(F.col("w")))


def without_stop_words(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    return tokens.join(stop, "w", "left_anti")


def joined_texts(parts: DataFrame, by: str, order: str) -> DataFrame:
    """by and text: the lower-cased parts in order, joined by spaces."""
    one = F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text"))))
    return parts.groupBy(by).agg(F.lower(F.array_join(F.transform(one, lambda x: x["text"]), " ")).alias("text"))


def substring_idf(words: DataFrame, docs: DataFrame) -> DataFrame:
    """w and ln(documents / (1 + documents that hold w anywhere, inside words too)).

    A text is scanned for each word of the list, which is meant to be short; the words
    found are counted before the shuffle.
    """
    n = docs.agg(F.count("*").alias("n"))
    hits = docs.join(F.broadcast(words), F.contains(F.col("text"), F.col("w"))).groupBy("w").agg(F.count("*").alias("df"))
    return words.join(hits, "w", "left").crossJoin(F.broadcast(n)).select("w", F.round(F.log(F.col("n") / (1 + F.coalesce("df", F.lit(0)))), 8).alias("idf"))
