"""The operators as registered queries, with the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import chat, html, linededup, lm, mixing, pieces, quality, secrets, simhash, topk
from termloom.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_metrics(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    return chat.digest(chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256.0)
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.line_dedup(table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode_documents(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.digest(html.extract(table(spark, sf_dir, "pages")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_chat_format, op4_exact_topk, op5_lm_score, op6_line_dedup, op7_simhash, op8_sentencepiece, op9_mixing, op10_html_extract, pipeline)}

SPACES = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {SPACES}) <> '' GROUP BY r),
m AS (SELECT w.r, doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR (n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * len(string_split(t, chr(10))))
  OR 100 * len(regexp_extract_all(t, '\p{{Lu}}{{2,}}')) > 30 * n_words OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words) AS kept
FROM f"""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p
QUALIFY rank <= 5"""

OP6 = f"""
WITH l AS (SELECT r, doc_id, i, line, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING min(coalesce(doc_id, 9223372036854775807)) <> max(coalesce(doc_id, 9223372036854775807)))
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL AND f.first IS DISTINCT FROM l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL OR f.first IS NOT DISTINCT FROM l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY l.r"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": OP2, "op4_exact_topk": OP4, "op6_line_dedup": OP6}
