"""Queries over tagged tokens: patterns, clusters, contexts, term selection."""

from pyspark.sql import functions as F

from termloom.operators import clusters as C
from termloom.operators import corpus, patterns, tagging
from termloom.operators import phrases as P
from termloom.plans.q_text import SENTENCES, read
from termloom.plans.registry import register

PATTERNS = patterns.parse('''
name: "A + N" body: {
  w:d ADJ | rec
  w:h NOUN
}
name: "N + Gen" body: {
  w:h NOUN
  w:d NOUN [Case=Gen] | rec
}
name: "N + of + N" body: {
  w:h NOUN
  w:i ADP | exlex:"of"
  w:d NOUN
}
name: "(A + N) + Gen" body: {
  m:h "A + N"
  w:d NOUN [Case=Gen] | rec
}
name: "N + P + (A + N)" body: {
  w:h NOUN
  w:i ADP
  m:d "A + N"
}
name: "(A + N) + (A + N)" body: {
  m:h "A + N"
  m:d "A + N"
}
''')

TAGGED = rf"""SELECT doc_id, sent_no::INTEGER AS sent_no, (pos - 1)::INTEGER AS pos, w, CASE WHEN w IN ('of', 'to', 'in', 'for', 'on', 'with', 'by', 'at', 'from') THEN 'ADP' WHEN w IN ('and', 'or') THEN 'CONJ'
  WHEN w IN ('the', 'a', 'is', 'it', 'this', 'that', 'are', 'was', 'be', 'as') THEN 'X' WHEN regexp_matches(w, '(ble|ly)$') THEN 'ADJ' WHEN regexp_matches(w, '(ing|ed|er)$') THEN 'VERB' ELSE 'NOUN' END AS p,
  CASE WHEN regexp_matches(w, '(tion|es|s)$') THEN 'Gen' ELSE 'Nom' END AS c
  FROM (SELECT doc_id, sent_no, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, sent_no, regexp_extract_all(lower(sentence), '\p{{L}}+') AS ws FROM ({SENTENCES})))"""


def tagged(spark, d):
    """One reading a token, in the order of the sentences: phrases are found without moving a token."""
    return tagging.tag_plain(corpus.sentence_tokens(read(spark, d, "documents")))


@register(f"SELECT p AS tag, c AS gram, count(*) AS n, count(DISTINCT w) AS words FROM ({TAGGED}) GROUP BY ALL")
def tagged_tokens(spark, d):
    w = F.col("w")
    return corpus.sentence_tokens(read(spark, d, "documents")).groupBy(tagging.pos_of(w).alias("tag"), tagging.case_of(w).alias("gram")).agg(F.count("*").alias("n"), F.countDistinct("w").alias("words"))


SPANS = f"""WITH t AS MATERIALIZED (SELECT *, length(w) > 1 OR p NOT IN ('ADJ', 'NOUN', 'VERB') AS ok FROM ({TAGGED})),
r AS MATERIALIZED (SELECT *, ok AND p = 'ADJ' AS adj, ok AND p = 'NOUN' AS noun, ok AND p = 'NOUN' AND c = 'Gen' AS gen, ok AND p = 'ADP' AS adp FROM t),
k AS MATERIALIZED (SELECT *, pos - 1 - coalesce(max(CASE WHEN NOT adj THEN pos END) OVER (PARTITION BY doc_id, sent_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS l,
  coalesce(min(CASE WHEN NOT gen THEN pos END) OVER f, max(pos) OVER f + 1, pos + 1) - 1 - pos AS g,
  lead(adp AND w = 'of') OVER s AND lead(noun, 2) OVER s AS ofn FROM r
  WINDOW f AS (PARTITION BY doc_id, sent_no ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), s AS (PARTITION BY doc_id, sent_no ORDER BY pos)),
an AS MATERIALIZED (SELECT doc_id, sent_no, (pos - unnest(range(1, l + 1)))::INTEGER AS "start", pos AS "end" FROM k WHERE noun),
s AS (SELECT *, 'A + N' AS model FROM an UNION ALL SELECT doc_id, sent_no, pos, (pos + unnest(range(1, g + 1)))::INTEGER, 'N + Gen' FROM k WHERE noun UNION ALL SELECT doc_id, sent_no, pos, pos + 2, 'N + of + N' FROM k WHERE noun AND ofn),
x AS (SELECT a.doc_id, a.sent_no, a."start", (a."end" + unnest(range(1, k.g + 1)))::INTEGER AS "end", '(A + N) + Gen' AS model FROM an a JOIN k ON a.doc_id = k.doc_id AND a.sent_no = k.sent_no AND a."end" = k.pos
  UNION SELECT a.doc_id, a.sent_no, a."start" - 2, a."end", 'N + P + (A + N)' FROM an a JOIN k u ON a.doc_id = u.doc_id AND a.sent_no = u.sent_no AND a."start" - 1 = u.pos AND u.adp JOIN k v ON a.doc_id = v.doc_id AND a.sent_no = v.sent_no AND a."start" - 2 = v.pos AND v.noun WHERE v.pos > 0
  UNION SELECT a.doc_id, a.sent_no, a."start", b."end", '(A + N) + (A + N)' FROM an a JOIN an b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND a."end" + 1 = b."start"),
y AS (SELECT *, max("end") OVER z AS top FROM x WINDOW z AS (PARTITION BY doc_id, sent_no, "start")),
v AS (SELECT doc_id, sent_no, "start", "end", any_value(model) AS model FROM y WHERE "end" = top GROUP BY ALL HAVING count(*) = 1),
o AS (SELECT doc_id, sent_no, "start", "end", model FROM s UNION ALL SELECT doc_id, sent_no, "start", "end", model FROM v)"""
SPANS = SPANS.replace('v AS (SELECT doc_id, sent_no, "start", "end", any_value(model) AS model FROM y WHERE "end" = top GROUP BY ALL HAVING count(*) = 1)', 'v AS (SELECT doc_id, sent_no, "start", "end", any_value(model) AS model FROM y WHERE "end" = top GROUP BY doc_id, sent_no, "start", "end" HAVING count(*) = 1)')


@register(f'{SPANS} SELECT doc_id, sent_no, "start", "end", model FROM s')
def simple_phrases(spark, d):
    return patterns.spans(tagged(spark, d), PATTERNS, wide=False)


@register(f'{SPANS} SELECT doc_id, sent_no, "start", "end", model FROM v')
def complex_phrases(spark, d):
    return patterns.spans(tagged(spark, d), PATTERNS, simple=False)


KEYS = f"""{SPANS}, e AS (SELECT *, unnest(range("start", "end" + 1))::INTEGER AS pos FROM o),
q AS MATERIALIZED (SELECT e.doc_id, e.sent_no, e."start", e."end", e.model, string_agg(t.w, ' ' ORDER BY e.pos) AS key FROM e JOIN t ON e.doc_id = t.doc_id AND e.sent_no = t.sent_no AND e.pos = t.pos GROUP BY ALL)"""
CLUSTERS = f"""{KEYS}, c AS MATERIALIZED (SELECT key, count(*) AS cnt, round(count(*) / (SELECT count(DISTINCT doc_id) FROM documents), 8) AS frequency,
  arg_min(model, (doc_id, sent_no, "start", "end", model)) AS model, count(DISTINCT doc_id) AS docs FROM q GROUP BY key)"""


def key_clusters(spark, d):
    return C.clusters_of(patterns.counted(tagged(spark, d), PATTERNS), read(spark, d, "documents"), lambda m: patterns.model(PATTERNS, m))


@register(f"{CLUSTERS} SELECT key, cnt, frequency, model, docs FROM c")
def clusters(spark, d):
    return key_clusters(spark, d)


@register(f"{CLUSTERS} SELECT key, sum(('0x' || left(md5(sentence), 12))::BIGINT)::VARCHAR AS context, count(*) AS n FROM (SELECT DISTINCT q.key, sentence FROM q JOIN ({SENTENCES}) u ON q.doc_id = u.doc_id AND q.sent_no = u.sent_no) GROUP BY key")
def cluster_contexts(spark, d):
    tokens = tagging.tag_plain(corpus.digested_tokens(read(spark, d, "documents")))
    return C.context_digests(patterns.in_contexts(tokens, PATTERNS))


LEMMAS = "WITH d AS (SELECT count(DISTINCT doc_id) AS n FROM documents)"
STATS = f"SELECT w, count(*) AS wf, count(DISTINCT doc_id) AS df FROM ({TAGGED}) GROUP BY w"


@register(f"""{CLUSTERS}, m AS MATERIALIZED ({STATS}), z AS (SELECT sum(wf) AS tw, (SELECT count(DISTINCT doc_id) FROM documents) AS n FROM m),
l AS (SELECT key, min((wf / tw) * ln(n / (1 + df))) AS low FROM (SELECT key, unnest(string_split(key, ' ')) AS w FROM c) JOIN m USING (w), z GROUP BY key)
SELECT key, cnt, round(low, 9) AS low FROM c JOIN l USING (key) WHERE NOT (round(low, 9) < 0.0000088 AND frequency <= 0.002) AND len(list_filter(string_split(key, ' '), lambda x: regexp_matches(x, '(?i)^[ivxlcd]+$'))) = 0""")
def term_select(spark, d):
    docs = read(spark, d, "documents")
    return C.select_terms(key_clusters(spark, d), corpus.tfidf(docs), max_frequency=0.002)


def similar_sql(most, ending, first_only):
    """prev and key differ in inflection alone, in hex digits of their bytes."""
    pairs = "list_zip(string_split(prev, ' '), string_split(key, ' '))"
    cut = lambda x: f"left(hex(encode({x})), 2 * (least(strlen(p[1]), strlen(p[2])) - {ending}))"
    unlike = f"p[1] <> p[2] AND NOT (strlen(p[1]) > 8 AND strlen(p[2]) > 8 AND abs(strlen(p[1]) - strlen(p[2])) < {most} AND {cut('p[1]')} = {cut('p[2]')})"
    rest = f" AND len(list_filter({pairs}[2:], lambda p: p[1] <> p[2])) = 0" if first_only else ""
    return f"(len(list_filter({pairs}, lambda p: {unlike})) = 0 AND len(list_filter({pairs}, lambda p: p[1] <> p[2])) <= {most}{rest})"


SIMILAR = f"len(string_split(prev, ' ')) = len(string_split(key, ' ')) AND ({similar_sql(3, 2, False)} OR {similar_sql(2, 4, True)})"


@register(f"{CLUSTERS}, l AS (SELECT key, cnt, lag(key) OVER (ORDER BY key) AS prev FROM c), m AS (SELECT key, cnt, sum((NOT coalesce({SIMILAR}, false))::INT) OVER (ORDER BY key) AS island FROM l) SELECT min(key) AS head, count(*) AS n, sum(cnt)::BIGINT AS cnt FROM m GROUP BY island")
def merge_similar(spark, d):
    """Islands of similar keys; the fixtures of the key test are in the unit tests."""
    return P.merge_similar(key_clusters(spark, d).select("key", "cnt"))


@register(f"SELECT t.noun, count(*) AS phrases, round(avg(t.f), 8) AS mean_f, round(max(t.f), 8) AS max_f, round(min(t.f), 8) AS min_f FROM (SELECT unnest(list_distinct(string_split(key, ' '))) AS noun, frequency AS f FROM ({CLUSTERS} SELECT key, frequency FROM c)) t GROUP BY t.noun HAVING count(*) > 1")
def one_word_terms(spark, d):
    return C.one_word_terms(key_clusters(spark, d))


SHAPES = patterns.parse('''
name: "A + N" body: {
  w:d ADJ | rec
  w:h NOUN
}
name: "P + (A + N)" body: {
  w:i ADP
  m:h "A + N"
}
name: "(A + N) + P + (A + N)" body: {
  m:h "A + N"
  w:i ADP
  m:d "A + N"
}
name: "(A + N) + P + N" body: {
  m:h "A + N"
  w:i ADP
  w:d NOUN
}
''')


@register(f"""{SPANS} SELECT a.doc_id, a.sent_no, a."start" - 1 AS "start", a."end", 'P + (A + N)' AS model FROM an a JOIN k u ON a.doc_id = u.doc_id AND a.sent_no = u.sent_no AND a."start" - 1 = u.pos AND u.adp WHERE u.pos > 0
UNION SELECT a.doc_id, a.sent_no, a."start", b."end", '(A + N) + P + (A + N)' FROM an a JOIN k u ON a.doc_id = u.doc_id AND a.sent_no = u.sent_no AND a."end" + 1 = u.pos AND u.adp JOIN an b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND a."end" + 2 = b."start"
UNION SELECT a.doc_id, a.sent_no, a."start", v.pos, '(A + N) + P + N' FROM an a JOIN k u ON a.doc_id = u.doc_id AND a.sent_no = u.sent_no AND a."end" + 1 = u.pos AND u.adp JOIN k v ON a.doc_id = v.doc_id AND a.sent_no = v.sent_no AND a."end" + 2 = v.pos AND v.noun""")
def pattern_shapes(spark, d):
    """The other shapes of a pattern with an inner one: word first, word between, words behind."""
    return patterns.spans(tagged(spark, d), SHAPES, simple=False, validate=False)
