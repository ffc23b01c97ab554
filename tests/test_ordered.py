import random

import numpy as np
import pytest

from termloom.operators import clusters, evaluation, ordered, phrases


@pytest.mark.parametrize("after", [False, True])
def test_neighbours_cross_range_borders(spark, after):
    keys = sorted({f"k{random.Random(1).randrange(10**6)}-{i % 97}" for i in range(500)})
    parts = ordered.in_ranges(spark.createDataFrame([(k,) for k in random.Random(2).sample(keys, len(keys))], "key string").repartition(5), "key")
    assert parts.select(ordered.PART).distinct().count() >= 1
    got = {r["key"]: r["n"] and r["n"]["key"] for r in ordered.with_neighbour(parts, "key", ["key"], "n", after).collect()}
    assert got == dict(zip(keys, keys[1:] + [None] if after else [None] + keys[:-1], strict=True))
    spark.catalog.clearCache()


def test_running_count_over_many_ranges(spark):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordered.in_ranges(spark.range(1000).select("id"), "id")
        assert parts.select(ordered.PART).distinct().count() > 1
        got = {r["id"]: r["_run"] for r in ordered.running_count(parts, "id", F.col("id") % 7 == 0).collect()}
        both = {r["id"]: r["n"] and r["n"]["id"] for r in ordered.with_neighbour(parts, "id", ["id"], "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: i // 7 + 1 for i in range(1000)}
    assert both == {i: i - 1 if i else None for i in range(1000)}
    spark.catalog.clearCache()


def test_merge_similar_of_an_empty_table(spark):
    assert phrases.merge_similar(spark.createDataFrame([], "key string, cnt long")).collect() == []


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_quantiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(evaluation, "ACCURACY", accuracy)
    draw = random.Random(3)
    values = {"wide": [draw.lognormvariate(0, 3) for _ in range(3001)], "ties": [float(draw.randrange(4)) for _ in range(2500)], "few": [2.5, 1.0], "one": [7.0], None: [1.0, 2.0, 4.0], "same": [5.0] * 900}
    data = [(g, x) for g, xs in values.items() for x in xs] + [("wide", None), ("nulls", None)]
    draw.shuffle(data)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: list(r)[1:] for r in evaluation.quantiles(spark.createDataFrame(data, "g string, x double"), "g", "x", shares).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        assert np.allclose(got[g], np.quantile(xs, shares), rtol=1e-12)


def test_contexts_are_rows(spark):
    occ = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("a", 2, 0), ("b", 2, 0)], "key string, doc_id long, sent_no int")
    s = spark.createDataFrame([(1, 0, "x"), (2, 0, "x")], "doc_id long, sent_no int, sentence string")
    c = clusters.contexts(occ, s)
    assert sorted(map(tuple, c.collect())) == [("a", "x"), ("b", "x")]
    assert {r["key"]: r["n"] for r in clusters.context_digests(c).collect()} == {"a": 1, "b": 1}
