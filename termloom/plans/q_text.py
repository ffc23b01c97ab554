"""Queries over texts: sources, filters, cleaning, corpus statistics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import corpus
from termloom.plans.registry import register

TOKENS = r"SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS w FROM documents"
SENTENCES = r"SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_no FROM (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents)"
PARAS = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS para FROM documents"
UNWANTED = r"'[\p{Nd}\p{Han}\p{Devanagari}\p{Arabic}\p{Sm}\p{So}]'"
ASCII_RUN = r"'^[a-zA-Z0-9!-/:-@\[-`{-~]*$'"
FILTER_OUT = rf"(regexp_matches(w, '[%*_#$]') OR NOT regexp_matches(w, '\p{{L}}') OR (strlen(w) > 25 AND regexp_matches(w, {ASCII_RUN})) OR regexp_matches(w, {UNWANTED}))"
STATS = f"SELECT w, count(*) AS wf, count(DISTINCT doc_id) AS df FROM ({TOKENS}) GROUP BY w"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@register(f"SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS total_docs, (SELECT count(*) FROM ({PARAS})) AS total_texts, (SELECT count(*) FROM ({TOKENS})) AS total_words")
def corpus_totals(spark, d):
    return corpus.totals(read(spark, d, "documents"))


@register(STATS)
def word_stats(spark, d):
    return corpus.word_stats(read(spark, d, "documents"))


TFIDF = f"SELECT w, wf, df, wf / tw AS tf, ln(n / (1 + df)) AS idf, (wf / tw) * ln(n / (1 + df)) AS tfidf FROM ({STATS}), (SELECT sum(wf) AS tw FROM ({STATS})), (SELECT count(DISTINCT doc_id) AS n FROM documents)"


@register(f"SELECT w, wf, df, round(tf, 10) AS tf, round(idf, 8) AS idf, round(tfidf, 9) AS tfidf FROM ({TFIDF})")
def tfidf(spark, d):
    return corpus.tfidf(read(spark, d, "documents")).select("w", "wf", "df", F.round("tf", 10).alias("tf"), F.round("idf", 8).alias("idf"), F.round("tfidf", 9).alias("tfidf"))


@register(f"SELECT w, round(tfidf, 9) AS tfidf FROM ({TFIDF}) ORDER BY round(tfidf, 9) DESC, w LIMIT 50")
def tfidf_top(spark, d):
    return corpus.tfidf(read(spark, d, "documents")).select("w", F.round("tfidf", 9).alias("tfidf")).orderBy(F.desc("tfidf"), "w").limit(50)


@register(f"SELECT w, round(ln((tw + 1) / (wf + 1)), 8) AS idf FROM ({STATS}), (SELECT sum(wf) AS tw FROM ({STATS}))")
def idf_by_words(spark, d):
    docs = read(spark, d, "documents")
    n = corpus.totals(docs).select("total_words")
    return corpus.word_stats(docs).crossJoin(F.broadcast(n)).select("w", F.round(F.log((F.col("total_words") + 1) / (F.col("wf") + 1)), 8).alias("idf"))


@register(f"SELECT w, wf FROM ({STATS}) ORDER BY wf DESC, w LIMIT 50")
def top_lemmas(spark, d):
    return corpus.tokens(read(spark, d, "documents")).groupBy("w").agg(F.count("*").alias("wf")).orderBy(F.desc("wf"), "w").limit(50)


@register(f"SELECT doc_id, sent_no::INTEGER AS sent_no, sentence FROM ({SENTENCES}) WHERE length(sentence) > 25")
def sentences(spark, d):
    return corpus.sentences(read(spark, d, "documents")).where(F.length("sentence") > 25)


@register(rf"SELECT doc_id, sent_no::INTEGER AS sent_no, array_to_string(regexp_extract_all(lower(sentence), '\p{{L}}+'), ' ') AS normalized FROM ({SENTENCES}) WHERE strlen(array_to_string(regexp_extract_all(lower(sentence), '\p{{L}}+'), ' ')) >= 50")
def normalized_sentences(spark, d):
    s = corpus.sentences(read(spark, d, "documents"))
    return s.select("doc_id", "sent_no", F.array_join(T.tokens(F.col("sentence")), " ").alias("normalized")).where(F.octet_length("normalized") >= 50)


@register(f"SELECT doc_id, count(*) AS n FROM ({PARAS}) WHERE contains(para, ' ') AND strlen(para) >= 40 GROUP BY doc_id")
def paragraph_filter(spark, d):
    return corpus.filter_texts(read(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))


WORDS = r"SELECT doc_id, unnest(regexp_extract_all(text, '[^\s]+')) AS w FROM documents"


def raw_words(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\f\r]+"), F.lit(0))).alias("w"))


@register(rf"SELECT w, count(*) AS n, regexp_matches(w, {UNWANTED}) AS unwanted, {FILTER_OUT} AS filtered, regexp_matches(w, '^[0-9!-/:-@\[-`{{-~]*$') AS misclassified FROM ({WORDS}) GROUP BY w")
def word_filters(spark, d):
    w = F.col("w")
    return raw_words(spark, d).groupBy("w").agg(F.count("*").alias("n")).select("w", "n", T.unwanted(w).alias("unwanted"), T.should_filter_out(w).alias("filtered"), T.misclassified(w).alias("misclassified"))


STOP = f"SELECT w FROM ({STATS}) ORDER BY df DESC, w LIMIT 100"


@register(f"SELECT doc_id, count(*) AS n FROM ({TOKENS}) WHERE w NOT IN ({STOP}) GROUP BY doc_id")
def stop_words_anti(spark, d):
    docs = read(spark, d, "documents")
    stop = corpus.word_stats(docs).orderBy(F.desc("df"), "w").limit(100).select("w")
    return corpus.without_stop_words(corpus.tokens(docs), F.broadcast(stop)).groupBy("doc_id").agg(F.count("*").alias("n"))


@register(rf"SELECT w, wf FROM ({STATS}) WHERE strlen(w) > 5 AND wf > 1 AND NOT {FILTER_OUT}")
def lsa_word_gate(spark, d):
    return corpus.filter_stats(corpus.word_stats(read(spark, d, "documents"))).where((F.octet_length("w") > 5) & (F.col("wf") > 1)).select("w", "wf")


CLEAN = r"'\.{2,}', '.', 'g'), ',{2,}', ',', 'g'), '!{2,}', '!', 'g'), '\?{2,}', '?', 'g'), '\s+([.,;:!?])', '\1', 'g'), '[,;:]+([.!?])', '\1', 'g'), '([.!?])[.,;:]+', '\1', 'g'), '\s{2,}', ' ', 'g')"


@register(rf"SELECT doc_id, md5(string_agg(CASE WHEN regexp_matches(c, '[.!?:;]$') THEN c ELSE c || '.' END, chr(10) ORDER BY i)) AS cleaned FROM (SELECT doc_id, i, {'regexp_replace(' * 8}line, {CLEAN} AS c FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)) WHERE line <> '') GROUP BY doc_id")
def clean_lines(spark, d):
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != "")
    out = F.transform(lines, lambda x: T.terminal_period(T.clean_punctuation(x)))
    return read(spark, d, "documents").where(F.size(lines) > 0).select("doc_id", F.md5(F.array_join(out, "\n")).alias("cleaned"))


@register(r"SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS article, CASE WHEN s = '' THEN 'phrase' ELSE s END AS slug, regexp_replace('see ' || url, 'https?://\S+$', 'link') AS linked FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '-') AS s FROM pages)")
def urls(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"/([0-9]+)", 1).alias("article"), T.slugify(F.col("url")).alias("slug"), T.strip_urls(F.concat(F.lit("see "), F.col("url"))).alias("linked"))


DROPPED = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<table.*?</table>|<pre.*?</pre>|<figure.*?</figure>"


@register(rf"SELECT page_id, b[1] AS title, len(bs) AS n_blocks, md5(array_to_string(list_transform(bs, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), chr(10))) AS blocks FROM (SELECT page_id, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) AS b, regexp_extract_all(regexp_replace(html, '{DROPPED}', '', 'g'), '(?s)<(?:p|h[1-6])>(.*?)</(?:p|h[1-6])>', 1) AS bs FROM pages WHERE regexp_matches(html, '<p[ >]'))")
def html_blocks(spark, d):
    body = F.regexp_replace("html", DROPPED, "")
    blocks = F.regexp_extract_all(body, F.lit(r"(?s)<(?:p|h[1-6])>(.*?)</(?:p|h[1-6])>"), F.lit(1))
    plain = F.transform(blocks, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
    return read(spark, d, "pages").where(F.col("html").rlike("<p[ >]")).select("page_id", F.get(F.regexp_extract_all("html", F.lit(r"(?s)<title>(.*?)</title>"), F.lit(1)), F.lit(0)).alias("title"), F.size(blocks).cast("long").alias("n_blocks"), F.md5(F.array_join(plain, "\n")).alias("blocks"))


@register("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@register(rf"SELECT w, count(*) AS n FROM ({TOKENS}) WHERE regexp_matches(w, '(?i)^[ivxlcd]+$') GROUP BY w")
def roman_words(spark, d):
    return corpus.tokens(read(spark, d, "documents")).where(T.roman(F.col("w"))).groupBy("w").agg(F.count("*").alias("n"))


@register("SELECT event_id, event_type, replace(props, ': ', ':') AS packed, (props IS NOT NULL) AS has FROM events")
def json_codec(spark, d):
    """props parsed into a map and written back as the same JSON."""
    e = read(spark, d, "events")
    return e.select("event_id", "event_type", F.to_json(F.from_json("props", "map<string,bigint>")).alias("packed"), F.from_json("props", "map<string,bigint>").isNotNull().alias("has"))


@register("SELECT trim(regexp_replace(lower(line), '[0-9]+$', '')) AS topic, count(*) AS n FROM (SELECT e.event_type || ' ' || (event_id % 5) AS line FROM events e) WHERE strlen(trim(regexp_replace(lower(line), '[0-9]+$', ''))) > 3 GROUP BY 1")
def topic_lines(spark, d):
    """Topic lines: trailing counts stripped, lower case, more than three bytes."""
    line = F.concat_ws(" ", "event_type", (F.col("event_id") % 5).cast("string"))
    topic = F.trim(F.regexp_replace(F.lower(line), "[0-9]+$", ""))
    return read(spark, d, "events").select(topic.alias("topic")).where(F.octet_length("topic") > 3).groupBy("topic").agg(F.count("*").alias("n"))
