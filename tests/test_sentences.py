from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import lexicon, phrases, relations, selection, sentences


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def keyed(spark, sid, text, keys):
    return spark.createDataFrame([(sid, text, k, p, m) for k, p, m in keys], "sent_id string, text string, key string, prob double, manual int")


def test_triggered_takes_near_keys_of_both_sides(spark):
    k = keyed(spark, "s", "red rod far far far iron is a metal of earth", [("iron", 0.5, 0), ("metal", 0.5, 0), ("red rod", 0.9, 0), ("earth", 0.01, 0)])
    assert rows(sentences.triggered(k, [" is "])) == [("s", " is ", "iron", "metal")]


def test_triggered_keeps_the_best_two_and_weak_keys_marked_by_hand(spark):
    k = keyed(spark, "s", "iron is metal ore", [("iron", 0.0, 1), ("metal", 0.3, 0), ("ore", 0.9, 0), ("metal ore", 0.2, 0)])
    assert rows(sentences.triggered(k, [" is "])) == [("s", " is ", "iron", "metal"), ("s", " is ", "iron", "ore")]


def test_last_keys_and_across(spark):
    s = spark.createDataFrame([("a", None, "a rod of cast iron"), ("b", "a", "is a metal")], "sent_id string, prev_id string, text string")
    k = s.select("sent_id", "text").join(spark.createDataFrame([("a", "rod"), ("a", "iron"), ("a", "cast iron"), ("b", "metal")], "sent_id string, key string"), "sent_id")
    assert rows(sentences.last_keys(k)) == [("a", "cast iron"), ("b", "metal")]
    assert rows(sentences.across(s, k, ["is "])) == [("b", "cast iron", "metal")]


def test_key_pairs_prefers_the_shorter_then_the_earlier(spark):
    k = spark.createDataFrame([(1, 0, "big rod"), (1, 1, "rod"), (1, 2, "ring"), (2, 0, "rod")], "s int, i int, key string")
    assert rows(sentences.key_pairs(k, ["s"])) == [(1, "ring", "big rod"), (1, "rod", "big rod"), (1, "rod", "ring")]


def test_noun_contexts_by_stem_and_length(spark):
    s = spark.createDataFrame([(1, 1, "rods and metals lie here in rows"), (2, 1, "metallurgical works"), (3, 2, "rod metal"), (4, 2, "")], "sent_id int, doc int, text string")
    n = spark.createDataFrame([("rod",), ("metal",)], "noun string")
    assert rows(sentences.noun_contexts(n, s)) == [("metal", 1, 1), ("rod", 1, 1)]


def test_related_words(spark):
    senses = spark.createDataFrame([("rod", 1), ("bar", 1), ("tool", 2), ("ring", 3)], "lemma string, synset int")
    links = spark.createDataFrame([(1, 2), (3, 2)], "synset int, hypernym int")
    got = rows(lexicon.related_words(spark.createDataFrame([("rod",)], "lemma string"), senses, links))
    assert got == [("rod", "hypernym", "tool"), ("rod", "sibling", "bar"), ("rod", "sibling", "ring"), ("rod", "synonym", "bar")]


def test_merge_endings(spark):
    p = spark.createDataFrame([("тест большой",), ("тест большый",), ("ряды чиселов",), ("ряды чисела",), ("ряды чисел",), ("ряд",), (None,)], "phrase string")
    got = {r["phrase"]: r["canonical"] for r in phrases.merge_endings(p).collect()}
    assert got == {"тест большой": "тест большый", "тест большый": "тест большый", "ряды чиселов": "ряды чисел", "ряды чисела": "ряды чисел", "ряды чисел": "ряды чисел", "ряд": "ряд", None: None}


def test_best_by_phrase_takes_the_first_source_of_ties(spark):
    c = spark.createDataFrame([("k", "p", 0.5, "b"), ("k", "p", 0.5, "a"), ("k", "p", 0.1, "c")], "key string, phrase string, sim double, source string")
    assert rows(relations.best_by_phrase(c)) == [("k", "p", 0.5, "a")]


def test_dataset_filter_keeps_null_labels(spark):
    c = spark.createDataFrame([(1, 0.05, None, None), (0, 0.34, "m", "x"), (0, 0.5, "bad", "x"), (1, 0.9, "m", "gone")], "manual int, prob double, model_name string, label string")
    assert rows(selection.dataset_filter(c, ["bad"], ["gone"])) == [(1, 0.05, None, None)]


def test_text_functions(spark):
    one = spark.range(1)
    got = one.select(T.wiki_examples(F.lit("x {{пример|Он [[шёл]]&nbsp;сам|автор}} {{пример|}}")).alias("e"), T.word_context(F.lit("key (lock, door)")).alias("w"), T.word_context(F.lit("key")).alias("n"), T.between_bars(F.lit("1|| put on top ||3")).alias("b"), T.preposition(F.lit("put on top"), ["in", "on"]).alias("p")).first()
    assert got["e"] == ["Он шёл сам"] and tuple(got["w"]) == ("key", "lock") and tuple(got["n"]) == ("key", None) and got["b"] == "put on top" and got["p"] == "on"
