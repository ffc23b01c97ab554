"""Work that has to grow no faster than its input, on small tables."""

import numpy as np

from termloom.operators import vectors as O


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lsh_pairs_makes_no_row_for_a_candidate(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    monkeypatch.setattr(O, "GROUP", 20)  # several groups
    x = np.random.default_rng(4).normal(size=(150, 6))
    x[7] = x[3]
    rows = [(i * 3 - 50, list(map(float, v))) for i, v in enumerate(x)] + [(2000, [0.0] * 6), (2001, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = O.lsh_pairs(df, 0.7)
    assert "Join" not in plan(got)
    unit = spark.createDataFrame([(i, list(map(float, np.array(v) / np.linalg.norm(v)))) for i, v in rows[:150]], "id long, v array<double>").select("id", array_to_vector("v").alias("f"))
    joined = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=1.0, numHashTables=3, seed=1).fit(unit).approxSimilarityJoin(unit, unit, 0.7, "dist")
    want = joined.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), "dist").where("a < b").collect()
    assert len(want) > 100
    assert sorted((r["a"], r["b"], round(r["dist"], 9)) for r in got.collect()) == sorted((r["a"], r["b"], round(r["dist"], 9)) for r in want)


def test_lsh_pairs_of_other_ids(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("a", [1.0, 0.1]), ("c", [-1.0, 0.0]), (None, [1.0, 0.0])], "id string, v array<double>")
    assert [(r["a"], r["b"]) for r in O.lsh_pairs(df, 0.5).collect()] == [("a", "b")]


def test_phrases_move_no_token(spark):
    """Spans come from the sentences where they are read: no exchange but of the keys, no window, no join of tokens."""
    from termloom.plans import catalogue, registry  # noqa: F401

    sf = "/root/testdata/sf0.001"
    for name in ("simple_phrases", "complex_phrases", "pattern_shapes", "without_repeats"):
        p = plan(registry.QUERIES[name](spark, sf))
        assert "Exchange" not in p and "Window" not in p and "Join" not in p, name
    p = plan(registry.QUERIES["clusters"](spark, sf))
    assert "SortAggregate" not in p and "SortMergeJoin" not in p and "Window" not in p
    spark.catalog.clearCache()


def test_matcher_equals_the_steps_by_windows_and_joins(spark, monkeypatch):
    import random

    from termloom.operators import matching, patterns, tagging

    monkeypatch.setattr(matching, "SPANS", 5)  # many pieces
    monkeypatch.setattr(matching, "BYTES", 40)
    draw = random.Random(9)
    words = ["able", "ugly", "cats", "dog", "nation", "of", "in", "the", "x", "running"]
    rows = [(d, s, p, draw.choice(words)) for d in range(40) for s in range(3) for p in range(draw.randrange(1, 14))]
    tokens = spark.createDataFrame(rows, "doc_id long, sent_no int, pos int, w string").coalesce(1)
    own = patterns.parse("""
    name: "A + N" body: {
      w:d ADJ | rec
      w:h NOUN
    }
    name: "N + Gen" body: {
      w:h NOUN
      w:d NOUN [Case=Gen] | rec
    }
    name: "N + P + N + Gen" body: {
      w:h NOUN
      w:i ADP
      m:d "N + Gen"
    }
    name: "(A + N) + Gen" body: {
      m:h "A + N"
      w:d NOUN [Case=Gen] | rec
    }
    name: "(A + N) + P + (N + Gen)" body: {
      m:h "A + N"
      w:i ADP
      m:d "N + Gen"
    }
    """)
    t = patterns.usable(tagging.tag(tokens))
    simple = patterns.simple_spans(t, own)
    wide = patterns.complex_spans(t, simple, own)
    plain = lambda df: sorted(tuple(r[c] for c in ("doc_id", "sent_no", "start", "end", "model")) for r in df.collect())
    ready = tagging.tag_plain(tokens)
    assert plain(patterns.spans(ready, own, wide=False)) == plain(simple)
    assert plain(patterns.spans(ready, own, simple=False, validate=False)) == plain(wide)
    longest = patterns.longest(wide)
    assert len(plain(longest)) > 5
    assert plain(patterns.spans(ready, own, simple=False)) == plain(longest)
    full = patterns.occurrences(t, simple.unionByName(longest))
    for got in (patterns.keyed(ready, own), patterns.collect_phrases(tagging.tag(tokens), own)):
        assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, full.select(sorted(full.columns)).collect()))


def test_knn_holds_little_of_many_queries():
    import tracemalloc

    draw = np.random.default_rng(2)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(draw.normal(size=(n, 8)))
    queries, vectors = unit(5000), unit(3000)
    tracemalloc.start()
    got = list(O.nearest(np.arange(5000), queries, 10, False, ((np.arange(i, i + 1000) + 10_000, vectors[i : i + 1000]) for i in range(0, 3000, 1000))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    query, found, sim = (np.concatenate(c) for c in zip(*got, strict=True))
    at = query == 4321
    sims = np.floor(vectors @ queries[4321] * 1e6 + 0.5) / 1e6
    assert sorted(found[at]) == sorted(np.lexsort((np.arange(3000), -sims))[:10] + 10_000)


def test_length_correlation_moves_no_text(spark):
    from termloom.plans import catalogue, registry  # noqa: F401

    p = plan(registry.QUERIES["length_correlation"](spark, "/root/testdata/sf0.001"))
    assert "min(text" not in p and "SortAggregate" not in p
    below = [line for line in p.splitlines() if "Exchange" in line]
    assert below and not any("text#" in line for line in below)


def test_svd_makes_one_pass(spark, monkeypatch):
    from pyspark.mllib.linalg.distributed import RowMatrix
    from termloom.operators import lsa

    monkeypatch.delattr(RowMatrix, "computeSVD")
    u, s = lsa.svd(spark.createDataFrame([("a", 1, 2), ("b", 2, 1)], "w string, doc_id long, n long"), 2)
    assert np.allclose(s, [2, 1]) and {r["w"]: [round(x, 9) for x in r["u"]] for r in u.collect()} == {"a": [2.0, 0.0], "b": [0.0, 1.0]}
