"""Readers, sinks and operators that have no query of their own."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from termloom.functions import vectors as V
from termloom.operators import learning, lsa, phrases, publish, relations, tagging
from termloom.sources import files


def test_vectors_text(spark, tmp_path):
    (tmp_path / "a.vec").write_text("2 3\nдом 0.5 -1 2\ncat 1 0 1e-3\n")
    got = {r["w"]: r["v"] for r in files.vectors_text(spark, str(tmp_path / "a.vec")).collect()}
    assert got == {"дом": [0.5, -1.0, 2.0], "cat": [1.0, 0.0, 0.001]}
    lines = {r["value"] for r in publish.vector_lines(files.vectors_text(spark, str(tmp_path / "a.vec"))).collect()}
    assert lines == {"дом 0.500000 -1.000000 2.000000", "cat 1.000000 0.000000 0.001000"}
    assert publish.vector_lines(spark.createDataFrame([("x", [12345.5])], "w string, v array<double>")).first()["value"] == "x 12345.500000"


def test_phrase_labels(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"общее место": "general phrase", "b": "term"}')
    (tmp_path / "bad.json").write_text("{oops")
    assert {tuple(r) for r in files.phrase_labels(spark, str(tmp_path / "l.json")).collect()} == {("общее место", "general phrase"), ("b", "term")}
    assert files.phrase_labels(spark, str(tmp_path / "bad.json")).count() == 0
    assert files.phrase_labels(spark, str(tmp_path / "none.json")).count() == 0


def test_decoded(spark, tmp_path):
    for name, raw in (("u", "текст".encode()), ("m", b"\xef\xbb\xbf" + "текст".encode()), ("w", "текст".encode("cp1251")), ("x", "текст".encode("utf-16"))):
        (tmp_path / name).write_bytes(raw)
    assert [r["text"] for r in files.decoded(spark, str(tmp_path)).collect()] == ["текст"] * 4


def test_wordnet_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "w.db")
    con.execute("create table links (a text, b text, kind text)")
    con.executemany("insert into links values (?, ?, ?)", [("дом", "здание", "hypernym"), ("кот", "зверь", "hypernym"), ("дом", "жильё", None)])
    con.commit()
    got = files.wordnet_sqlite(spark, str(tmp_path / "w.db"), "select a, b, kind from links", "a string, b string, kind string")
    assert {tuple(r) for r in got.collect()} == {("дом", "здание", "hypernym"), ("кот", "зверь", "hypernym"), ("дом", "жильё", None)}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 'say "x", y', ["p", "q"], 1)], "k string, t string, a array<string>, n int")
    files.write_csv(df, str(tmp_path / "o"))
    r = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o")).first()
    assert tuple(r) == ("a;b", 'say "x", y', "p;q", "1")


def test_line_counts(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (None,)], "tags array<string>")
    assert [tuple(r) for r in files.line_counts(df, "tags").collect()] == [("a", 2), ("b", 1)]


def test_tag_by_lexicon(spark):
    t = spark.createDataFrame([(1, 0, 0, "Стали"), (1, 0, 1, "table")], "doc_id long, sent_no int, pos int, w string")
    lex = spark.createDataFrame([("стали", "сталь", "NOUN", {"Case": "Gen"}, 0.4), ("стали", "стать", "VERB", {"Number": "Plur"}, 0.6)], "form string, lemma string, pos string, feats map<string,string>, prob double")
    got = {r["form"]: r for r in tagging.tag_by_lexicon(t, lex).collect()}
    assert got["Стали"]["lemma"] == "стать" and len(got["Стали"]["readings"]) == 2
    assert got["table"]["lemma"] == "table" and got["table"]["readings"][0]["pos"] == "ADJ"


def test_usage_variants_of_one_letter_words(spark):
    b = spark.createDataFrame([("a b",), ("big cat",)], "phrase string")
    p = spark.createDataFrame([("xa bc d",), ("a big cats",), ("ab c d",)], "phrase string")
    assert {tuple(r) for r in phrases.usage_variants(b, p).collect()} == {("a b", "xa bc d"), ("a b", "a big cats"), ("big cat", "a big cats")}


def test_best_of_equal_similarities_is_the_first_source(spark):
    df = spark.createDataFrame([("k", "p", 0.5, "abc"), ("k", "p", 0.5, "ab"), ("k", "q", 0.5, "яма"), ("k", "q", 0.5, "баз"), ("k", "q", 0.4, "а")], "key string, phrase string, sim double, source string")
    assert {(r["phrase"], r["source"]) for r in relations.best_by_phrase(df).collect()} == {("p", "ab"), ("q", "баз")}


def test_merged_endings_go_on_until_nothing_changes(spark):
    df = spark.createDataFrame([("новой дома",), ("новый дом",), ("новый домов",), ("старый кот",)], "phrase string")
    got = {r["phrase"]: r["canonical"] for r in phrases.merge_endings(df).collect()}
    assert got["старый кот"] == "старый кот" and len({got[p] for p in ("новый дом", "новый домов")}) == 1
    again = phrases.merge_endings(spark.createDataFrame([(c,) for c in set(got.values())], "phrase string"))
    assert all(r["phrase"] == r["canonical"] for r in again.collect())


def test_undersample(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in learning.undersample(df, "y", "k").groupBy("y").count().collect()}
    assert n[1] == 200 and 140 < n[0] < 260


def test_word_vectors(spark):
    df = spark.createDataFrame([(["cat", "dog"] * 5,)] * 10, "words array<string>")
    got = {r["w"]: r["v"] for r in lsa.word_vectors(df, size=8).collect()}
    assert set(got) == {"cat", "dog"} and all(len(v) == 8 for v in got.values())


def test_normalized_levenshtein(spark):
    r = spark.range(1).select(V.normalized_levenshtein(F.lit("kitten"), F.lit("sitting")).alias("a"), V.normalized_levenshtein(F.lit(""), F.lit("")).alias("b")).first()
    assert r["a"] == pytest.approx(3 / 7) and r["b"] == 0


def test_knn_ties_and_own(spark):
    from termloom.operators import vectors as O

    df = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(40)] + [(99, [0.0, 0.0]), (None, [1.0, 0.0]), (98, None)], "id long, v array<double>").repartition(3)
    for own in (False, True):
        got = O.knn(df.where("id in (0, 1)"), df, 5, own).orderBy("query_id", "rank").collect()
        for q in (0, 1):
            same = [i for i in range(q, 40, 3) if own or i != q][:5]
            assert [(r["id"], r["sim"]) for r in got if r["query_id"] == q] == [(i, 1.0) for i in same]
    assert O.knn(df.limit(0), df, 5).count() == 0
