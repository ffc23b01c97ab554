"""The size of slices and what is remembered change the work, never the pieces."""

from termloom.llm import pieces


def test_slices_change_no_result(spark):
    words = "the quick brown fox jumps over unbelievable neighbourhoods".split()
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(40))) for i in range(60)] + [(60, None), (61, ""), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [sorted((str(r["doc_id"]), r["pieces"], r["lossless"]) for r in pieces.encode_documents(docs, with_text=False, keep_runs=keep, slice_bytes=most).collect()) for keep, most in ((pieces.KEEP_RUNS, pieces.SLICE), (20, 100))]
    assert got[0] == got[1] and all(x[2] for x in got[0])
