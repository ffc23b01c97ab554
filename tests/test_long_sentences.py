import json
import subprocess
import sys
from itertools import product
from pathlib import Path
from string import ascii_lowercase

import duckdb
import pytest

from tests.oracle import by_spark, by_sql, rows
from termloom.operators import clusters, patterns, publish, tagging
from termloom.plans import catalogue, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_sentence(tmp_path_factory):
    """The tables with one sentence of 4,000 words in documents, of which 300 nouns in a row give 44,850 spans.

    The other documents make the tokens too large to be broadcast, as they are in a corpus.
    """
    d = tmp_path_factory.mktemp("long")
    for t in Path(SF).iterdir():
        (d / t.name).symlink_to(t)
    (d / "documents.parquet").unlink()
    run = [f"q{a}{b}s" for a, b in product(ascii_lowercase, repeat=2)][:300]
    text = " ".join(["the"] * 3700 + run)
    duckdb.sql(f"COPY (SELECT i::BIGINT AS doc_id, t AS text, 'en' AS lang, 'x' AS source, length(t)::BIGINT AS n_chars FROM (VALUES (1, '{text}'), (2, 'qaas qabs')) v(i, t) UNION ALL SELECT i, repeat('the ', 1000), 'en', 'x', 4000 FROM range(3, 203) r(i)) TO '{d / 'documents.parquet'}' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["cluster_contexts", "cluster_json"])
def test_a_long_sentence_of_many_spans(spark, long_sentence, name):
    got = by_spark(registry.QUERIES[name](spark, long_sentence))
    spark.catalog.clearCache()
    assert len(got[1]) == 44_850
    assert got == by_sql(registry.ORACLE_SQL[name], long_sentence)


#: Writes a query's rows of a directory as parquet to another, by a driver of its own with a small heap.
SMALL = """
import sys
from pyspark.sql import SparkSession
from termloom.plans import catalogue, registry
name, d, out = sys.argv[1:]
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "1g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
registry.QUERIES[name](spark, d).write.parquet(out)
"""


def test_clusters_of_a_long_sentence_become_json_in_a_small_heap(long_sentence, tmp_path):
    out = tmp_path / "out.parquet"
    run = subprocess.run([sys.executable, "-c", SMALL, "cluster_json", long_sentence, str(out)], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    r = duckdb.sql(f"FROM '{out}/*.parquet'")
    assert (sorted(r.columns), rows(r.columns, r.fetchall())) == by_sql(registry.ORACLE_SQL["cluster_json"], long_sentence)


@pytest.fixture
def few(spark):
    """Three occurrences, few enough to be broadcast."""
    tokens = tagging.tag(spark.createDataFrame([(1, 0, 0, "red"), (1, 0, 1, "cats"), (2, 0, 0, "cats")], "doc_id long, sent_no int, pos int, w string"))
    spans = spark.createDataFrame([(1, 0, 0, 1, "m"), (1, 0, 1, 1, "m"), (2, 0, 0, 0, "m")], "doc_id long, sent_no int, start int, end int, model string")
    return patterns.occurrences(tokens, spans)


def merged(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_spans_are_not_broadcast(few):
    assert sorted((r["key"], r["text_form"], r["doc_id"], r["start"]) for r in few.collect()) == [("cats", "cats", 1, 1), ("cats", "cats", 2, 0), ("red cats", "red cats", 1, 0)]
    assert merged(few)


def test_json_of_clusters_broadcasts_no_spans(few):
    j = publish.cluster_json(few)
    got = {r["key"]: json.loads(r["json"]) for r in j.collect()}
    at = lambda d, s, e: {"start": s, "end": e, "doc_id": d, "sent_no": 0}
    phrase = lambda t, *where: {"phrases_count": len(where), "phrases": [{"text_form": t, "position": at(*w)} for w in where]}
    assert got == {"cats": phrase("cats", (2, 0, 0), (1, 1, 1)), "red cats": phrase("red cats", (1, 0, 1))}
    assert merged(j)


def test_links_hold_no_sentence(spark):
    occ = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("a", 2, 0), ("a", 2, 1), ("b", 2, 0)], "key string, doc_id long, sent_no int")
    s = spark.createDataFrame([(1, 0, "x"), (2, 0, "x"), (2, 1, "y")], "doc_id long, sent_no int, sentence string")
    links = clusters.context_links(occ, s)
    assert links.columns == ["key", "sha", "head"]
    texts = clusters.contexts(occ, s)
    assert sorted(map(tuple, texts.collect())) == [("a", "x"), ("a", "y"), ("b", "x")]
    assert "SortMergeJoin [sha" in texts._jdf.queryExecution().executedPlan().toString()
    assert by_spark(clusters.context_digests(links)) == by_spark(clusters.context_digests(texts))
