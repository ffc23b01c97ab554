from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.sources import files
from termloom.streaming import counts


def test_articles(spark, tmp_path):
    for name, text in (("art7_text.txt", "First line.\nSecond."), ("art7_title.txt", "Title\nrest"), ("art7_tags.txt", "a\nb\n"), ("art12_text.txt", "Other")):
        (tmp_path / name).write_text(text)
    got = {r["doc_id"]: r for r in files.articles(spark, str(tmp_path)).collect()}
    assert got[7]["title"] == "Title" and got[7]["tags"] == ["a", "b"] and got[12]["title"] is None


def test_occurrences_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a b", "A b", "m", 1, 2, 3, 4, ["a", "b_c"])], "key string, text_form string, model string, doc_id long, sent_no long, start int, end int, lemmas array<string>")
    files.write_occurrences(df.coalesce(1), str(tmp_path / "o"))
    for f in (tmp_path / "o").glob("part-*.json"):
        f.rename(tmp_path / "res1_text.json")
    assert files.occurrences(spark, str(tmp_path)).collect() == df.collect()


def test_repaired_json_and_lists(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a": 2}')
    assert sorted(r["a"] for r in files.repaired_json(spark, str(tmp_path / "x.json"), "a int").collect()) == [1, 2]
    (tmp_path / "t").write_text("Машинное обучение 242\nnlp 249\nии 5\nя 1\nвеб 2 30\n")
    assert sorted(r["topic"] for r in files.topics(spark, str(tmp_path / "t")).collect()) == ["веб 2", "ии", "машинное обучение"]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    q = counts.word_counts(spark, str(tmp_path / "in"), "doc_id long, text string").writeStream.format("memory").queryName("wc").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    batch = docs.select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").count()
    assert {tuple(r) for r in spark.sql("select * from wc").collect()} == {tuple(r) for r in batch.collect()}


def test_corpus_sentences_and_clusters(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"0_totalDocuments": 1, "1_totalTexts": 2, "2_totalWords": 3, "3_documentFrequency": {"a": 1}, "4_wordFrequency": {"a": 2, "b": 1}, "5_documents": [{"filename": "t", "texts": ["a a", "b"]}]}')
    texts, stats, totals = files.corpus(spark, str(tmp_path / "c.json"))
    assert sorted(map(tuple, texts.collect())) == [("t", "a a"), ("t", "b")] and sorted(map(tuple, stats.collect())) == [("a", 2, 1), ("b", 1, None)] and tuple(totals.first()) == (1, 2, 3)
    (tmp_path / "s.json").write_text('{"totalSentences": 2, "sentences": [{"docNum": 1, "sentNum": 0, "originalStr": "X", "normalizedStr": "' + "y" * 50 + '"}, {"docNum": 1, "sentNum": 1, "originalStr": "Z", "normalizedStr": "z"}]}')
    assert [r["sentence"] for r in files.tokenized_sentences(spark, str(tmp_path / "s.json")).collect()] == ["X"]
    (tmp_path / "k.json").write_text('{"a b": {"0_phrase_size": 2, "1_frequency": 0.5, "4_tag_match": true, "5_model_name": "m"}}')
    assert tuple(files.clusters(spark, str(tmp_path / "k.json")).first()) == ("a b", 2, 0.5, None, None, True, "m")
