"""Queries over phrases, their words and vectors."""

from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.functions import vectors as V
from termloom.operators import corpus
from termloom.operators import phrases as P
from termloom.operators import vectors as O
from termloom.plans.q_text import PARAS, STATS, TOKENS, read
from termloom.plans.q_vectors import VEC, vectors
from termloom.plans.registry import register

#: Words with vectors are `w` and a vec_id; phrases come from orders.
WORDS = "SELECT 'w' || vec_id AS w, embedding::DOUBLE[] AS v FROM embeddings"
PAIRS = "SELECT DISTINCT 'w' || o_custkey % 61 || ' w' || o_orderkey % 53 AS a, 'w' || o_orderkey % 47 || ' x' AS b FROM orders"


def words(spark, d):
    return vectors(spark, d).select(F.concat(F.lit("w"), "id").alias("w"), "v")


def pairs(spark, d):
    o = read(spark, d, "orders")
    w = lambda c, n: F.concat(F.lit("w"), F.col(c) % n)
    return o.select(F.concat_ws(" ", w("o_custkey", 61), w("o_orderkey", 53)).alias("a"), F.concat(w("o_orderkey", 47), F.lit(" x")).alias("b")).distinct()


def length_of(v):
    """A vector as two numbers, its length and its components weighted by place."""
    return F.round(V.norm(v), 6).alias("norm"), F.round(V.total(F.transform(v, lambda x, i: x * (i + 1))), 6).alias("spread")


SIZE = "round(sqrt(sum(m * m)), 6) AS norm, round(sum(m * i), 6) AS spread"


@register(f"WITH p AS (SELECT DISTINCT a AS phrase FROM ({PAIRS})), x AS (SELECT phrase, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS w FROM p) JOIN ({WORDS}) USING (w)), m AS (SELECT phrase, i, avg(x) AS m FROM x GROUP BY ALL) SELECT phrase, {SIZE} FROM m GROUP BY phrase")
def phrase_vectors(spark, d):
    return O.phrase_vectors(pairs(spark, d).select(F.col("a").alias("phrase")).distinct(), words(spark, d)).select("phrase", *length_of(F.col("v")))


IDF = "SELECT 'w' || vec_id AS w, (1 + vec_id % 5)::DOUBLE AS idf FROM embeddings"


@register(f"WITH p AS (SELECT DISTINCT a AS phrase FROM ({PAIRS})), x AS (SELECT phrase, idf, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS w FROM p) JOIN ({WORDS}) USING (w) JOIN ({IDF}) USING (w)), m AS (SELECT phrase, i, sum(x * idf) / sum(idf) AS m FROM x GROUP BY ALL) SELECT phrase, {SIZE} FROM m GROUP BY phrase")
def weighted_phrase_vectors(spark, d):
    idf = vectors(spark, d).select(F.concat(F.lit("w"), "id").alias("w"), (1 + F.col("id") % 5).cast("double").alias("idf"))
    return O.phrase_vectors(pairs(spark, d).select(F.col("a").alias("phrase")).distinct(), words(spark, d), idf).select("phrase", *length_of(F.col("v")))


@register(f"""WITH c AS (SELECT b AS phrase, string_agg(a, ' | ' ORDER BY a) AS context FROM ({PAIRS}) GROUP BY b), q AS (SELECT phrase, ps, unnest(ps) AS part, generate_subscripts(ps, 1) AS no FROM (SELECT phrase, string_split(context, '|') AS ps FROM c)),
w AS (SELECT phrase, no, string_split(trim(part), ' ') AS ws FROM q), x AS (SELECT phrase, no, len(ws) AS n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT phrase, no, ws, unnest(ws) AS w FROM w) JOIN ({WORDS}) USING (w)),
p AS (SELECT phrase, no, n, i, avg(x) AS x FROM x GROUP BY ALL), m AS (SELECT phrase, i, sum(x * n) / sum(n) AS m FROM p GROUP BY ALL) SELECT phrase, {SIZE} FROM m GROUP BY phrase""")
def context_vectors(spark, d):
    c = pairs(spark, d).groupBy(F.col("b").alias("phrase")).agg(F.array_join(F.array_sort(F.collect_list("a")), " | ").alias("context"))
    return O.context_vectors(c, words(spark, d)).select("phrase", *length_of(F.col("v")))


@register(f"WITH p AS ({PAIRS}), x AS (SELECT DISTINCT a, b, unnest(string_split(a, ' ')) AS wa FROM p), y AS (SELECT DISTINCT a, b, unnest(string_split(b, ' ')) AS wb FROM p), v AS ({WORDS}), m AS (SELECT a, b, wa, max(list_cosine_similarity(va.v, vb.v)) AS best FROM x JOIN y USING (a, b) JOIN v va ON va.w = wa JOIN v vb ON vb.w = wb GROUP BY ALL) SELECT a, b, round(avg(best), 6) AS score FROM m GROUP BY a, b")
def alignment(spark, d):
    return O.alignment(pairs(spark, d), words(spark, d))


@register(f"WITH v AS ({VEC}) SELECT a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS cos FROM v a JOIN v b ON a.label = b.label AND a.id < b.id GROUP BY a.label")
def pair_centrality(spark, d):
    return O.mean_pair_cosine(vectors(spark, d), "label")


@register("WITH t AS (SELECT DISTINCT p_type AS topic, string_split(p_name, ' ')[1] AS w FROM part WHERE p_size > 20), p AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS phrase FROM part), w AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS w FROM p), n AS (SELECT w, count(*) AS n FROM t GROUP BY w) SELECT phrase, round(avg((n IS NOT NULL)::INT), 6) AS share, round((sum(coalesce(n, 0)) / 6)::DOUBLE, 6) AS relevance FROM w LEFT JOIN n USING (w) GROUP BY phrase")
def topic_share(spark, d):
    part = read(spark, d, "part")
    topics = part.where("p_size > 20").select(F.col("p_type").alias("topic"), F.get(F.split("p_name", " "), F.lit(0)).alias("w"))
    return O.topic_share(part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("phrase")).distinct(), topics, 6)


@register("SELECT CASE WHEN p_partkey % 3 = 0 THEN regexp_replace(string_split(p_name, ' ')[2], '(а|и|ов|s|es)$', '') ELSE regexp_replace(string_split(p_name, ' ')[2] || 's', '(а|и|ов|s|es)$', '') END AS noun, sum(p_size)::BIGINT AS n, round(avg(p_retailprice), 6) AS tf_idf, round(avg(p_size / 10), 6) AS mean, round(avg(p_size), 6) AS high, round(avg(p_partkey), 6) AS low, max(p_size % 2) AS is_term FROM part GROUP BY 1")
def stripped_nouns(spark, d):
    noun = F.get(F.split("p_name", " "), F.lit(1))
    w = read(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, noun).otherwise(F.concat(noun, F.lit("s"))).alias("noun"), F.col("p_size").alias("n"), F.col("p_retailprice").alias("tf_idf"), (F.col("p_size") / 10).alias("mean"), F.col("p_size").alias("high"), F.col("p_partkey").alias("low"), (F.col("p_size") % 2).alias("is_term"))
    return P.by_stripped_noun(w)


ENDED = "SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' ELSE p_brand || ' ' || p_name END AS phrase FROM part"


@register(f"WITH p AS ({ENDED}) SELECT phrase, CASE WHEN phrase LIKE '%s' AND phrase[:-2] IN (SELECT phrase FROM p) THEN phrase[:-2] ELSE phrase END AS canonical FROM p")
def merged_endings(spark, d):
    size = F.col("p_size") % 3
    p = read(spark, d, "part").select(F.when(size == 0, F.col("p_name")).when(size == 1, F.concat("p_name", F.lit("s"))).otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("phrase")).distinct()
    return P.merge_endings(p, (("s", "", ""),))


NESTED = "SELECT key, min(model) AS model, min(centrality) AS centrality, min(tfidf) AS tfidf, min(frequency) AS frequency FROM (SELECT unnest([p_name, p_name || ' ' || lower(p_type), string_split(p_name, ' ')[2] || ' ' || lower(p_type)]) AS key, unnest(['AN', 'ANG', 'NG']) AS model, p_size % 10 / 20 AS centrality, p_partkey % 7 / 1000000 AS tfidf, 1 AS frequency FROM part) GROUP BY key"


@register(f"WITH c AS ({NESTED}), n AS (SELECT *, lead(key) OVER (ORDER BY key) AS k2 FROM c), g AS (SELECT n.key, b.key AS k2 FROM n JOIN c b ON b.key = n.k2 JOIN c t ON t.key = b.key[strpos(b.key, ' ') + 1:] WHERE n.model = 'AN' AND b.model = 'ANG' AND t.model = 'NG' AND starts_with(b.key, n.key) AND n.centrality < 0.15 AND least(n.tfidf, b.tfidf, t.tfidf) < 0.0000088) SELECT key, model FROM c WHERE key NOT IN (SELECT key FROM g UNION SELECT k2 FROM g)")
def prefix_exclusion(spark, d):
    w = F.split("p_name", " ")
    rows = F.array(*(F.struct(k.alias("key"), F.lit(m).alias("model")) for k, m in ((F.col("p_name"), "AN"), (F.concat_ws(" ", "p_name", F.lower("p_type")), "ANG"), (F.concat_ws(" ", F.get(w, F.lit(1)), F.lower("p_type")), "NG"))))
    c = read(spark, d, "part").select(F.explode(rows).alias("x"), (F.col("p_size") % 10 / 20).alias("centrality"), (F.col("p_partkey") % 7 / 1000000).alias("tfidf")).select("x.*", "centrality", "tfidf").groupBy("key").agg(F.min("model").alias("model"), F.min("centrality").alias("centrality"), F.min("tfidf").alias("tfidf"))
    return P.prefix_exclusion(c, ("AN",), ("ANG",), "NG").select("key", "model")


@register("SELECT doc_id, w, count(*) AS n FROM (" + TOKENS + ") WHERE strlen(w) > 5 GROUP BY ALL")
def term_document_counts(spark, d):
    return corpus.tokens(read(spark, d, "documents")).where(F.octet_length("w") > 5).groupBy("doc_id", "w").agg(F.count("*").alias("n"))


@register(f"WITH m AS ({STATS}), r AS (SELECT w FROM m ORDER BY df DESC, w LIMIT 40), c AS (SELECT conv_id, lower(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id) SELECT w, round(ln((SELECT count(*) FROM c) / (1 + count(*) FILTER (contains(text, w)))), 8) AS idf FROM r, c GROUP BY w")
def substring_idf(spark, d):
    """Inverse frequency of conversations that hold a word as a substring: the words are a short list."""
    docs = corpus.joined_texts(read(spark, d, "conversations"), "conv_id", "turn")
    return corpus.substring_idf(corpus.word_stats(read(spark, d, "documents")).orderBy(F.desc("df"), "w").limit(40).select("w"), docs)


@register("SELECT conv_id, md5(lower(string_agg(coalesce(text, ''), ' ' ORDER BY turn))) AS text FROM conversations GROUP BY conv_id")
def joined_texts(spark, d):
    return corpus.joined_texts(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", F.md5("text").alias("text"))


PREPS = ("de", "la", "the", "in", "of")


@register("SELECT p AS preposition, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(line, ' {p} ') THEN '{p}'" for p in PREPS) + f" ELSE 'others' END AS p FROM (SELECT trim(string_split('x||' || para || '||y', '||')[2], ' ') AS line FROM ({PARAS}))) GROUP BY 1")
def prepositions(spark, d):
    line = T.between_bars(F.concat(F.lit("x||"), "para", F.lit("||y")))
    return corpus.paragraphs(read(spark, d, "documents")).groupBy(T.preposition(line, list(PREPS)).alias("preposition")).agg(F.count("*").alias("n"))


@register("SELECT DISTINCT p_name || ' (' || lower(p_type) || ', x)' AS entry, p_name AS word, lower(p_type) AS context, list_filter([p_name, p_type], lambda x: NOT contains(x, 'bolt')) AS kept, [p_name || ' is ' || p_brand, p_brand || ' holds ' || p_name] AS hypotheses, len(list_intersect(string_split(p_name, ' '), ['red', 'bolt', 'ring'])) >= 2 AS two_common FROM part")
def entry_functions(spark, d):
    entry = F.format_string("%s (%s, x)", "p_name", F.lower("p_type"))
    x = T.word_context(entry)
    return read(spark, d, "part").select(entry.alias("entry"), x["word"].alias("word"), x["context"].alias("context"), T.without_containing(F.array("p_name", "p_type"), ["bolt"]).alias("kept"), T.hypotheses(F.col("p_brand"), F.col("p_name"), ["%1$s is %2$s", "%2$s holds %1$s"]).alias("hypotheses"), (T.common_words(F.col("p_name"), F.lit("red bolt ring")) >= 2).alias("two_common")).distinct()


@register("SELECT page_id, list_filter(list_transform(regexp_extract_all('{{example|' || url || '|x}} {{example|}}', '\\{\\{(?:пример|example)\\|([^|}]*)', 1), lambda x: trim(x)), lambda x: x <> '') AS examples, regexp_replace(url || ' .', '\\s+([.,;:!?])$', '\\1') AS line, regexp_matches(url, '^[A-Za-z]') AS latin FROM pages")
def page_functions(spark, d):
    return read(spark, d, "pages").select("page_id", T.wiki_examples(F.concat(F.lit("{{example|"), "url", F.lit("|x}} {{example|}}"))).alias("examples"), T.before_mark(F.concat("url", F.lit(" ."))).alias("line"), T.starts_latin(F.col("url")).alias("latin"))
