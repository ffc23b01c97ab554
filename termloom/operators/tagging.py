"""A rule tagger by suffix: stands in where no morphological analyser is plugged in."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and endings of the tagger. Fixed values.
ADP = ("of", "to", "in", "for", "on", "with", "by", "at", "from")
CONJ = ("and", "or")
OTHER = ("the", "a", "is", "it", "this", "that", "are", "was", "be", "as")
ADJ_END, VERB_END, GEN_END = ("ble", "ly"), ("ing", "ed", "er"), ("tion", "s")


def ends(w: Column, endings: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.endswith(w, F.lit(e)) for e in endings))


def pos_of(w: Column) -> Column:
    return F.when(w.isin(*ADP), "ADP").when(w.isin(*CONJ), "CONJ").when(w.isin(*OTHER), "X").when(ends(w, ADJ_END), "ADJ").when(ends(w, VERB_END), "VERB").otherwise("NOUN")


def case_of(w: Column) -> Column:
    return F.when(ends(w, GEN_END), "Gen").otherwise("Nom")


def tag_plain(tokens: DataFrame) -> DataFrame:
    """tag() with its one reading in two columns, tag and gram, of tokens that come in the order of their sentences."""
    w = F.col("w")
    return tokens.select("doc_id", "sent_no", "pos", w.alias("form"), w.alias("lemma"), pos_of(w).alias("tag"), case_of(w).alias("gram"), *(c for c in ("sha", "head") if c in tokens.columns))


def tag(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_no, pos, w) with form, lemma and one reading each."""
    w = F.col("w")
    reading = F.struct(pos_of(w).alias("pos"), F.create_map(F.lit("Case"), case_of(w)).alias("feats"))
    return tokens.select("doc_id", "sent_no", "pos", w.alias("form"), w.alias("lemma"), F.array(reading).alias("readings"))


def tag_by_lexicon(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tag() with readings from a lexicon (form, lemma, pos, feats, prob); words that it lacks are tagged by suffix.

    The lemma is that of the most probable reading, the first by name of equal ones.
    """
    reading = F.struct("pos", "feats")
    known = lexicon.groupBy(F.lower("form").alias("w")).agg(F.collect_list(reading).alias("lex_readings"), F.min_by("lemma", F.struct(-F.col("prob"), "lemma")).alias("lex_lemma"))
    t = tag(tokens).withColumn("w", F.lower("form")).join(known, "w", "left")
    return t.select("doc_id", "sent_no", "pos", "form", F.lower(F.coalesce("lex_lemma", "lemma")).alias("lemma"), F.coalesce("lex_readings", "readings").alias("readings"))
