"""Files of the term pipeline as tables: article texts with titles and tags, JSON results, sinks."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of the files. Fixed values.
OCCURRENCE = "0_key STRING, 1_textForm STRING, 2_modelName STRING, 3_docNum BIGINT, 4_sentNum BIGINT, 5_start_ind BIGINT, 6_end_ind BIGINT, 7_lemmas ARRAY<STRING>"


def _whole(spark: SparkSession, path: str, glob: str) -> DataFrame:
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.regexp_extract(name, r"(\d+)", 1).cast("long").alias("doc_id"), F.col("value"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, title (first line), tags and hubs (one a line) from art<id>_{text,title,tags,hubs}.txt."""
    out = _whole(spark, path, "art*_text.txt").withColumnRenamed("value", "text")
    title = _whole(spark, path, "art*_title.txt").select("doc_id", F.get(F.split("value", "\n"), F.lit(0)).alias("title"))
    lists = [_whole(spark, path, f"art*_{k}.txt").select("doc_id", F.filter(F.split("value", r"\r?\n"), lambda x: x != "").alias(k)) for k in ("tags", "hubs")]
    for other in (title, *lists):
        out = out.join(other, "doc_id", "left")
    return out


def line_counts(lists: DataFrame, column: str) -> DataFrame:
    return lists.select(F.explode(column).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of res*_text.json files; files that can't be read count as empty. Lemmas lose their number."""
    r = spark.read.schema(OCCURRENCE).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "res*_text.json").json(path)
    lemma = F.transform("7_lemmas", lambda x: F.substring(x, F.instr(x, "_") + 1, F.length(x)))
    return r.select(F.col("0_key").alias("key"), F.col("1_textForm").alias("text_form"), F.col("2_modelName").alias("model"), F.col("3_docNum").alias("doc_id"), F.col("4_sentNum").alias("sent_no"), F.col("5_start_ind").cast("int").alias("start"), F.col("6_end_ind").cast("int").alias("end"), lemma.alias("lemmas"))


def write_occurrences(occ: DataFrame, path: str) -> None:
    numbered = F.transform("lemmas", lambda x, i: F.concat(i.cast("string"), F.lit("_"), x))
    occ.select(F.col("key").alias("0_key"), F.col("text_form").alias("1_textForm"), F.col("model").alias("2_modelName"), F.col("doc_id").alias("3_docNum"), F.col("sent_no").alias("4_sentNum"), F.col("start").alias("5_start_ind"), F.col("end").alias("6_end_ind"), numbered.alias("7_lemmas")).write.mode("overwrite").json(path)


def repaired_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that hold several JSON objects in a row."""
    whole = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    one = whole.select(F.explode(F.split(F.regexp_replace("value", r"\}\s*\n\s*\{", "}\u0001{"), "\u0001")).alias("value"))
    return one.select(F.from_json("value", schema).alias("x")).where("x is not null").select("x.*")


def words(spark: SparkSession, path: str) -> DataFrame:
    """A word list, in lower case, one a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct()


def topics(spark: SparkSession, path: str) -> DataFrame:
    """Topic lines without Latin letters, their trailing count cut off, more than three bytes."""
    t = F.trim(F.regexp_replace(F.lower("value"), r"\d+$", ""))
    return spark.read.text(path).where(~F.col("value").rlike("[A-Za-z]")).select(t.alias("topic")).where(F.octet_length("topic") > 3).distinct()


#: Fixed values.
SENTENCES = "totalSentences INT, sentences ARRAY<STRUCT<docNum: BIGINT, sentNum: BIGINT, originalStr: STRING, normalizedStr: STRING>>"


def tokenized_sentences(spark: SparkSession, path: str, min_bytes: int = 50) -> DataFrame:
    """doc_id, sent_no, sentence, normalized of a sentence file; normalised forms of too few bytes are left out."""
    s = spark.read.schema(SENTENCES).option("multiLine", True).json(path).select(F.explode("sentences").alias("s"))
    return s.select(F.col("s.docNum").alias("doc_id"), F.col("s.sentNum").alias("sent_no"), F.col("s.originalStr").alias("sentence"), F.col("s.normalizedStr").alias("normalized")).where(F.octet_length("normalized") >= min_bytes)


#: Fixed values.
CORPUS = "0_totalDocuments INT, 1_totalTexts INT, 2_totalWords INT, 3_documentFrequency MAP<STRING, INT>, 4_wordFrequency MAP<STRING, INT>, 5_documents ARRAY<STRUCT<filename: STRING, texts: ARRAY<STRING>>>"


def corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A corpus file as texts (title, para), word statistics (w, wf, df) and totals (one row)."""
    c = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    texts = c.select(F.explode("5_documents").alias("d")).select(F.col("d.filename").alias("title"), F.explode("d.texts").alias("para"))
    wf, df = (c.select(F.explode(k).alias("w", n)) for k, n in (("4_wordFrequency", "wf"), ("3_documentFrequency", "df")))
    return texts, wf.join(df, "w", "left"), c.select(F.col("0_totalDocuments").alias("total_docs"), F.col("1_totalTexts").alias("total_texts"), F.col("2_totalWords").alias("total_words"))


#: Fixed values.
CLUSTER = "MAP<STRING, STRUCT<`0_phrase_size`: INT, `1_frequency`: DOUBLE, `2_topic_relevance`: DOUBLE, `3_centrality_score`: DOUBLE, `4_tag_match`: BOOLEAN, `5_model_name`: STRING>>"


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """key and measures of a file of clusters, an object with a member for each key."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CLUSTER)).alias("key", "c"))
    return whole.select("key", *(F.col(f"c.{i}_{n}").alias(n) for i, n in enumerate(("phrase_size", "frequency", "topic_relevance", "centrality_score", "tag_match", "model_name"))))


def vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """w and v of a text file of word vectors: a word and its components a line; a first line of two numbers is a header."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") > 2) | ((F.size("p") == 2) & ~F.get("p", F.lit(0)).rlike("^[0-9]+$")))
    return rows.select(F.get("p", F.lit(0)).alias("w"), F.transform(F.slice("p", 2, 1_000_000), lambda x: x.cast("double")).alias("v"))


def phrase_labels(spark: SparkSession, path: str) -> DataFrame:
    """key and label of a file that is one object of labels; a file that can't be read, or isn't there, has none."""
    none = spark.createDataFrame([], "key string, label string")
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return none
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "label")).unionByName(none)


def decoded(spark: SparkSession, path: str, others: tuple[str, ...] = ("windows-1251",)) -> DataFrame:
    """path and text of files: UTF-8 (a byte order mark is dropped), UTF-16 by its mark, else the first of the other encodings that has all their characters; null if none has."""

    def text(raw: bytes) -> str | None:
        if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
            return raw.decode("utf-16", "replace")
        for name in ("utf-8-sig", *others):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text(x) for x in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def wordnet_sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows of a statement over a wordnet's SQLite file, read in pieces by one task; the file has to be where executors can read it."""

    def run(batches):
        import sqlite3

        import pyarrow as pa

        for _ in batches:
            con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
            rows = con.execute(sql)
            names = [c[0] for c in rows.description]
            while part := rows.fetchmany(10_000):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in part])
            con.close()

    return spark.range(1).coalesce(1).mapInArrow(run, schema)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Flat columns with a header; arrays joined by semicolons."""
    flat = [F.array_join(F.transform(f.name, lambda x: x.cast("string")), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)
