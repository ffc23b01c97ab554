import pytest
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import patterns as P
from termloom.operators import relations as R


@pytest.mark.parametrize(("a", "b", "same"), [("embeddings model", "embedding model", True), ("text models", "text model", False), ("embedding", "embeddingness", False), ("abcdefghij", "abcdefwxyz", True), ("longtokenaa abcdefghij", "longtokenaa abcdefwxyz", False), ("языковой модель", "языковый модель", True), ("a b", "a b c", False)])
def test_keys_similar(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.keys_similar(F.col("a"), F.col("b"))).first()[0] is same


def tokens(spark, tags):
    rows = [(1, 0, i, w, w, [(p, {"Case": c})]) for i, (w, p, c) in enumerate(tags)]
    return spark.createDataFrame(rows, "doc_id long, sent_no int, pos int, form string, lemma string, readings array<struct<pos:string,feats:map<string,string>>>")


PATTERNS = P.parse('''
name: "A + N" body: {
  w:d ADJ | rec
  w:h NOUN
}
name: "N + Gen" body: {
  w:h NOUN
  w:d NOUN [Case=Gen] | rec
}
name: "(A + N) + Gen" body: {
  m:h "A + N"
  w:d NOUN [Case=Gen]
}
name: "N + P + (A + N)" body: {
  w:h NOUN
  w:i ADP
  m:d "A + N"
}
''')


def spans(df):
    return sorted(tuple(r) for r in df.select("start", "end", "model").collect())


def test_simple_runs(spark):
    t = P.usable(tokens(spark, [("a1", "ADJ", "Nom"), ("a2", "ADJ", "Nom"), ("n1", "NOUN", "Nom")]))
    assert spans(P.simple_spans(t, PATTERNS)) == [(0, 2, "A + N"), (1, 2, "A + N")]
    t = P.usable(tokens(spark, [("n1", "NOUN", "Nom"), ("n2", "NOUN", "Gen"), ("n3", "NOUN", "Gen")]))
    assert spans(P.simple_spans(t, PATTERNS)) == [(0, 1, "N + Gen"), (0, 2, "N + Gen"), (1, 2, "N + Gen")]


def test_stop_words_and_complex(spark):
    tags = [("xx", "X", "Nom"), ("n1", "NOUN", "Nom"), ("for", "ADP", "Nom"), ("a1", "ADJ", "Nom"), ("n2", "NOUN", "Nom")]
    t = P.usable(tokens(spark, tags))
    s = P.simple_spans(t, PATTERNS)
    assert spans(P.complex_spans(t, s, PATTERNS)) == [(1, 4, "N + P + (A + N)")]
    # The leftmost word can't be a sentence's first token.
    t = P.usable(tokens(spark, tags[1:]))
    assert spans(P.complex_spans(t, P.simple_spans(t, PATTERNS), PATTERNS)) == []
    stop = spark.createDataFrame([("a1",)], "w string")
    assert spans(P.simple_spans(P.usable(tokens(spark, tags), stop), PATTERNS)) == []


def test_longest(spark):
    df = lambda rows: spark.createDataFrame([(1, 0, *r) for r in rows], "doc_id long, sent_no int, start int, end int, model string")
    assert spans(P.longest(df([(0, 2, "a"), (0, 3, "b")]))) == [(0, 3, "b")]
    assert spans(P.longest(df([(0, 3, "a"), (1, 3, "b")]))) == [(0, 3, "a"), (1, 3, "b")]
    assert spans(P.longest(df([(0, 3, "a"), (0, 3, "b")]))) == []


def test_undefined_inner_pattern():
    with pytest.raises(ValueError, match="not defined"):
        P.parse('name: "x" body: {\n m:h "y"\n}')


def test_symmetric_closure_is_idempotent(spark):
    e = spark.createDataFrame([("A", "B", "hypernym"), ("A", "C", "synonym"), ("B", "Z", "related")], "key string, phrase string, relation string")
    once = R.symmetric_closure(e)
    assert {("B", "A", "hyponym")} == {tuple(r) for r in once.collect()} - {tuple(r) for r in e.collect()}
    assert {tuple(r) for r in R.symmetric_closure(once).collect()} == {tuple(r) for r in once.collect()}


def test_negated_antonyms(spark):
    p = spark.createDataFrame([("линейный модель", "нелинейный модель"), ("линейный", "нелинейный")], "key string, phrase string")
    assert [r["key"] for r in R.negated_antonyms(p).collect()] == ["линейный модель"]


@pytest.mark.parametrize(("line", "clean"), [("https://a.b/c", None), ("see https://a.b/c", "see link"), ("plain", "plain")])
def test_strip_urls(spark, line, clean):
    assert spark.createDataFrame([(line,)], "x string").select(T.strip_urls(F.col("x"))).first()[0] == clean


def test_slug(spark):
    got = spark.createDataFrame([("Word2Vec модель!",), ("***",)], "x string").select(T.slugify(F.col("x"))).collect()
    assert [r[0] for r in got] == ["word2vec-модель", "phrase"]
