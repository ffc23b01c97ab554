"""From raw documents to pieces: quality rules, line dedup, near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all the rows that its predecessor
kept, and but for the last returns the columns of documents.  Columns that a stage
adds for itself never leave it.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import linededup, mixing, pieces, quality, simhash
from termloom.llm.common import cut, delete, passing, scratch, shared_dir

#: Name of the row key that a stage sets for itself.
ROW = "pipeline_row"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows. Every document stays."""
    out = linededup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of texts with a five-word Jaccard similarity of 0.8 or more; of equal ids, or none, one row."""
    rows = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    # The rows that go, not those that stay: most documents are never looked up.
    gone = cut(simhash.near_copies(rows, ROW).where(F.col(ROW) != F.col("first")).select(ROW))
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their temperature weights: every document once or more, smaller sources repeated up to the limit."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of each row, and whether they decode to its text."""
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())  # repeats of a document get segmentations of their own
    out = pieces.encode_documents(rows, with_text=False, turn_col=ROW, keep_runs=150_000, slice_bytes=500_000)
    return out.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mix_sources), ("sentencepiece", encode)]

#: SQL has no XXH64 with a seed and no piece model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    A stage's tables go when the next one is written, the last one's when the driver ends.
    """
    base = passing(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
