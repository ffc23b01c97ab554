"""Queries over relation rules, pair features, labels and small thesaurus steps."""

from pyspark.sql import functions as F

from termloom.operators import clusters as C
from termloom.operators import evaluation as E
from termloom.operators import patterns
from termloom.operators import phrases as P
from termloom.operators import relations as R
from termloom.plans.q_phrases import CLUSTERS, KEYS, PATTERNS, STATS, key_clusters, tagged
from termloom.plans.q_relations import EDGES, edges
from termloom.plans.q_text import read
from termloom.plans.q_vectors import VEC, vectors
from termloom.plans.registry import register

RULES = {"narrowing": ["kind of", "small"], "linking": ["part of", "red"], "adjectives": ["hot", "old"], "twins": [("ring", "gear"), ("cold", "new")], "soft": ["blue"], "actions": ["making"], "classes": ["class"], "places": ["large"]}


PHRASES = "SELECT DISTINCT unnest([p_name, string_split(p_name, ' ')[2], 'part of ' || p_name, 'making ' || p_name, 'class ' || p_name, 'large ' || p_name, 'blue ' || p_name, string_split(p_name, ' ')[2] || ' large']) AS x, string_split(p_name, ' ')[2] AS last FROM part"
PAIRS = f"SELECT a.x AS key, b.x AS phrase, 'as it was' AS relation FROM ({PHRASES}) a JOIN ({PHRASES}) b ON a.x <> b.x AND (a.last = b.last OR (a.last = 'ring' AND b.last = 'gear'))"


def pairs(spark, d):
    n = F.element_at(F.split("p_name", " "), 2)
    own = [F.col("p_name"), n, *(F.concat_ws(" ", F.lit(w), "p_name") for w in ("part of", "making", "class", "large", "blue")), F.concat_ws(" ", n, F.lit("large"))]
    x = read(spark, d, "part").select(F.explode(F.array(*own)).alias("x"), n.alias("last")).distinct()
    also = x.select(F.col("x").alias("key"), F.explode(F.when(F.col("last") == "ring", F.array("last", F.lit("gear"))).otherwise(F.array("last"))).alias("last"))
    return also.join(x.select(F.col("x").alias("phrase"), "last"), "last").where("key <> phrase").select("key", "phrase", F.lit("as it was").alias("relation"))


def sql_list(name):
    return "[" + ", ".join(f"'{w}'" for w in RULES[name]) + "]"


def before(a, b):
    return f"CASE WHEN ends_with({a}, ' ' || {b}) THEN left({a}, length({a}) - length({b}) - 1) END"


TWINS = " OR ".join(f"phrase = replace(key, '{a}', '{b}') OR phrase = replace(key, '{b}', '{a}')" for a, b in RULES["twins"])
RULED = f"""WITH p AS ({PAIRS}), w AS (SELECT *, {before("key", "phrase")} AS down, {before("phrase", "key")} AS up,
  list_filter(list_distinct(string_split(key, ' ')), lambda x: NOT list_contains(string_split(phrase, ' '), x)) AS ok, list_filter(list_distinct(string_split(phrase, ' ')), lambda x: NOT list_contains(string_split(key, ' '), x)) AS op FROM p),
m AS (SELECT *, CASE WHEN len(ok) = 1 AND len(op) = 0 THEN ok[1] END AS more_k, CASE WHEN len(op) = 1 AND len(ok) = 0 THEN op[1] END AS more_p FROM w)
SELECT key, phrase, CASE WHEN list_contains({sql_list("narrowing")}, down) THEN 'hypernym' WHEN list_contains({sql_list("linking")}, down) THEN 'related' WHEN list_contains({sql_list("narrowing")}, up) THEN 'hyponym' WHEN list_contains({sql_list("linking")}, up) THEN 'related'
  WHEN list_contains({sql_list("adjectives")}, down) THEN 'hypernym' WHEN {TWINS} THEN 'synonym' WHEN list_contains({sql_list("soft")}, more_k) OR list_contains({sql_list("soft")}, more_p) THEN 'synonym'
  WHEN list_contains({sql_list("actions")}, down) OR list_contains({sql_list("actions")}, up) THEN 'related' WHEN list_contains({sql_list("classes")}, down) THEN 'hypernym' WHEN list_contains({sql_list("classes")}, up) THEN 'hyponym'
  WHEN list_contains({sql_list("places")}, more_k) THEN 'hypernym' WHEN list_contains({sql_list("places")}, more_p) THEN 'hyponym' ELSE relation END AS relation FROM m"""


@register(RULED)
def corrected_relations(spark, d):
    """All rules in their order."""
    return R.corrected(pairs(spark, d), RULES)


@register(f"WITH r AS ({RULED}) SELECT relation, count(*) AS n FROM r GROUP BY relation")
def corrected_counts(spark, d):
    return R.corrected(pairs(spark, d), RULES).groupBy("relation").agg(F.count("*").alias("n"))


RANK = "CASE {0} WHEN 'synonym' THEN 0 WHEN 'hypernym' THEN 1 WHEN 'hyponym' THEN 2 ELSE 3 END"


@register(f"""WITH e AS ({EDGES}), b AS (SELECT phrase AS key, key AS phrase, CASE relation WHEN 'hypernym' THEN 'hyponym' WHEN 'hyponym' THEN 'hypernym' ELSE relation END AS back FROM e)
SELECT key, phrase, CASE WHEN back IS NOT NULL AND ({RANK.format("back")} < {RANK.format("relation")} OR ({RANK.format("back")} = {RANK.format("relation")} AND back < relation)) THEN back ELSE relation END AS relation FROM e LEFT JOIN b USING (key, phrase)""")
def enforced_symmetry(spark, d):
    return R.enforce_symmetry(edges(spark, d))


@register(f"WITH e AS ({EDGES}) SELECT * FROM e UNION ALL SELECT DISTINCT phrase, key, relation FROM e a WHERE relation = 'antonym' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.key = a.phrase AND b.phrase = a.key)")
def antonyms_both_ways(spark, d):
    return R.with_reverse(edges(spark, d))


@register(f"WITH e AS ({EDGES}) SELECT * FROM e WHERE NOT starts_with(key, 'p1') AND NOT starts_with(phrase, 'p1')")
def without_prefix(spark, d):
    return R.without_prefix(edges(spark, d), "p1")


@register(f"WITH e AS ({EDGES}) SELECT * FROM e WHERE key <= 'p50'")
def keys_up_to(spark, d):
    """Keys up to a last one, compared by their bytes."""
    return edges(spark, d).where(F.col("key") <= "p50")


TERMS = "SELECT ' ' || p_brand AS noun, list_distinct(list(p_name) FILTER (p_size % 4 = 0)) AS hypernyms, list_distinct(list(p_name) FILTER (p_size % 4 = 1)) AS hyponyms, list_distinct(list(p_name) FILTER (p_size % 4 = 2)) AS synonyms, list_distinct(list(p_name) FILTER (p_size % 8 = 3)) AS related_terms FROM part GROUP BY p_brand"


@register(f"WITH t AS ({TERMS}) SELECT trim(noun) AS key, unnest(hypernyms) AS phrase, 'hypernym' AS relation FROM t UNION ALL SELECT trim(noun), unnest(hyponyms), 'hyponym' FROM t UNION ALL SELECT trim(noun), unnest(synonyms), 'synonym' FROM t UNION ALL SELECT trim(noun), unnest(related_terms), 'related' FROM t")
def one_word_edges(spark, d):
    some = lambda c, n: F.collect_set(F.when(c, F.col("p_name"))).alias(n)
    s = F.col("p_size")
    return R.one_word_edges(read(spark, d, "part").groupBy(F.concat(F.lit(" "), "p_brand").alias("noun")).agg(some(s % 4 == 0, "hypernyms"), some(s % 4 == 1, "hyponyms"), some(s % 4 == 2, "synonyms"), some(s % 8 == 3, "related_terms")))


MODELS = f"e AS ({EDGES}), a AS (SELECT DISTINCT key, phrase FROM e WHERE relation IN ('synonym', 'related')), b AS (SELECT DISTINCT key, phrase FROM e WHERE relation IN ('synonym', 'antonym'))"


def models(spark, d):
    e = edges(spark, d)
    return e.where("relation in ('synonym', 'related')"), e.where("relation in ('synonym', 'antonym')")


@register(f"WITH {MODELS}, j AS (SELECT key, count(*) FILTER (ina) AS na, count(*) FILTER (inb) AS nb, count(*) FILTER (ina AND inb) AS c FROM (SELECT coalesce(a.key, b.key) AS key, a.key IS NOT NULL AS ina, b.key IS NOT NULL AS inb FROM a FULL JOIN b ON a.key = b.key AND a.phrase = b.phrase) GROUP BY key) SELECT sum(na)::BIGINT AS n_a, sum(nb)::BIGINT AS n_b, sum(c)::BIGINT AS common, round(sum(na) / count(*) FILTER (na > 0), 6) AS mean_a, round(sum(nb) / count(*) FILTER (nb > 0), 6) AS mean_b FROM j")
def overlap_totals(spark, d):
    return R.overlap_totals(*models(spark, d))


@register(f"WITH {MODELS}, n AS (SELECT (SELECT count(*) FROM a JOIN b USING (key, phrase)) AS tp, (SELECT count(*) FROM a) AS g, (SELECT count(*) FROM b) AS f) SELECT tp, f - tp AS fp, g - tp AS fn, round(tp / f, 8) AS precision, round(tp / g, 8) AS recall, round(2 * tp / (f + g), 8) AS f1 FROM n")
def micro_prf(spark, d):
    return E.micro_prf(*models(spark, d))


FEATURES = "SELECT 'p' || (vec_id % 97) AS word, avg(label)::DOUBLE AS size, count(*)::DOUBLE AS n, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings WHERE vec_id % 97 < 80 GROUP BY 1"


@register(f"""WITH e AS ({EDGES}), f AS ({FEATURES}) SELECT e.key, e.phrase, relation, coalesce(a.size, 0) AS size, coalesce(a.n, 0) AS n, coalesce(b.size, 0) AS size_main, coalesce(b.n, 0) AS n_main,
  round(coalesce(sqrt(list_dot_product(a.v, a.v)), 0), 6) AS norm, round(coalesce(sqrt(list_dot_product(b.v, b.v)), 0), 6) AS norm_main, round(coalesce(list_cosine_similarity(a.v, b.v), 0), 6) AS cos
  FROM e LEFT JOIN f a ON a.word = e.phrase LEFT JOIN f b ON b.word = e.key""")
def pair_features(spark, d):
    e = read(spark, d, "embeddings").where("vec_id % 97 < 80").groupBy(F.concat(F.lit("p"), F.col("vec_id") % 97).alias("word")).agg(F.avg("label").alias("size"), F.count("*").cast("double").alias("n"), F.min_by("embedding", "vec_id").cast("array<double>").alias("v"))
    out = R.pair_features(edges(spark, d), e.withColumn("model", F.col("size").cast("string")), ["size", "n"], ["model"])
    return out.select("key", "phrase", "relation", "size", "n", "size_main", "n_main", *(F.round(c, 6).alias(c) for c in ("norm", "norm_main", "cos")))


ITEMS = "SELECT 'w' || (vec_id - vec_id % 10) AS head, CASE WHEN vec_id % 3 = 0 THEN 'w' || vec_id || ' (w' || (vec_id + 1) || ')' ELSE 'w' || vec_id END AS item FROM embeddings"


@register(f"""WITH u AS (SELECT 'w' || id AS w, v FROM ({VEC})), i AS ({ITEMS}), c AS (SELECT head, trim(regexp_extract(item, '^([^(]*)', 1)) AS word, nullif(trim(regexp_extract(item, '\\(([^)]*)\\)', 1)), '') AS context FROM i),
s AS (SELECT c.*, round(CASE WHEN context IS NULL THEN list_cosine_similarity(h.v, w.v) ELSE (list_cosine_similarity(h.v, w.v) + list_cosine_similarity(h.v, x.v)) / 2 END, 6) AS sim FROM c JOIN u h ON h.w = head LEFT JOIN u w ON w.w = word LEFT JOIN u x ON x.w = context)
SELECT * FROM s WHERE sim >= 0.1 AND sim < 1""")
def candidate_similarity(spark, d):
    v = vectors(spark, d).select(F.concat(F.lit("w"), "id").alias("w"), "v", "id")
    n = F.col("id")
    items = v.select(F.concat(F.lit("w"), n - n % 10).alias("head"), F.when(n % 3 == 0, F.concat("w", F.lit(" (w"), n + 1, F.lit(")"))).otherwise(F.col("w")).alias("item"))
    return R.candidate_similarity(items, v.select("w", "v"), 0.1)


@register("WITH c AS (SELECT DISTINCT p_brand AS key, p_name AS word FROM part), s AS (SELECT key FROM c GROUP BY key HAVING count(*) < 30) SELECT key, word FROM c WHERE key IN (SELECT key FROM s) AND word IN (SELECT p_name FROM part WHERE p_size > 45)")
def sane_hyponyms(spark, d):
    p = read(spark, d, "part")
    return R.sane_hyponyms(p.select(F.col("p_brand").alias("key"), F.col("p_name").alias("word")).distinct(), p.where("p_size > 45").select(F.col("p_name").alias("word")), 30)


@register("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS is_term FROM customer")
def existence_flag(spark, d):
    """Whether a left row has any partner."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("found")).distinct()
    return read(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("found", F.lit(False)).alias("is_term"))


@register("SELECT DISTINCT p_name, p_brand FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x IN ('ring', 'hot'))) > 0")
def with_any_word(spark, d):
    """Rows of which a word stands in a list of words."""
    p = read(spark, d, "part").select("p_name", "p_brand").distinct()
    words = spark.createDataFrame([("ring",), ("hot",)], "w string")
    hit = p.select("p_name", F.explode(F.split("p_name", " ")).alias("w")).join(words, "w", "left_semi").select("p_name").distinct()
    return p.join(hit, "p_name", "left_semi")


@register("SELECT lang, quality, count(*) AS n, round(avg(n_chars), 6) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def group_means(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    return j.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("chars"))


@register("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_type FROM events")
def flattened_json(spark, d):
    """Members of a nested object as columns of their own."""
    e = read(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"), "event_type")
    return e.select("event_id", "p.k", "event_type")


LABELLED = "SELECT p_partkey AS key, ['colloquial phrase', 'everyday expression', 'general phrase', NULL][p_partkey % 4 + 1] AS label, p_size % 10 / 10 AS topic_relevance, p_size % 3 = 0 AS tag_match, p_size % 7 / 10 AS centrality, p_size % 5 / 1000 AS frequency FROM part"


@register(f"SELECT key, label FROM ({LABELLED}) WHERE NOT coalesce((label IN ('colloquial phrase', 'everyday expression') AND ((topic_relevance < 0.5 AND NOT tag_match) OR (label = 'everyday expression' AND centrality < 0.2))) OR (label = 'general phrase' AND frequency < 0.0032 AND topic_relevance <= 0.5 AND centrality < 0.5), false)")
def label_filter(spark, d):
    s = F.col("p_size")
    label = F.get(F.array(F.lit("colloquial phrase"), F.lit("everyday expression"), F.lit("general phrase"), F.lit(None)), (F.col("p_partkey") % 4).cast("int"))
    c = read(spark, d, "part").select(F.col("p_partkey").alias("key"), label.alias("label"), (s % 10 / 10).alias("topic_relevance"), (s % 3 == 0).alias("tag_match"), (s % 7 / 10).alias("centrality"), (s % 5 / 1000).alias("frequency"))
    return C.label_filter(c).select("key", "label")


TOPICS = "SELECT p_brand AS key, p_name AS word, lower(p_type) AS topic, p_size / 100 AS sim FROM part"


@register(f"WITH b AS (SELECT key, topic, max(sim) AS sim FROM ({TOPICS}) GROUP BY ALL) SELECT key, array_to_string(list(topic ORDER BY sim DESC, topic), ',') AS topics FROM b GROUP BY key")
def combined_topics(spark, d):
    t = read(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("word"), F.lower("p_type").alias("topic"), (F.col("p_size") / 100).alias("sim"))
    return C.combined_topics(t).select("key", F.array_join("topics", ",").alias("topics"))


@register(f"WITH {CLUSTERS[5:]}, m AS MATERIALIZED ({STATS}), z AS (SELECT sum(wf) AS tw, (SELECT count(DISTINCT doc_id) FROM documents) AS n FROM m), l AS (SELECT DISTINCT key FROM (SELECT key, unnest(string_split(key, ' ')) AS w FROM c) JOIN m USING (w), z WHERE (wf / tw) * ln(n / (1 + df)) < 0.0001) SELECT CASE WHEN cnt > 1 THEN '#' || key ELSE key END AS phrase FROM c WHERE key IN (SELECT key FROM l)")
def low_tfidf_phrases(spark, d):
    from termloom.operators import corpus

    docs = read(spark, d, "documents")
    c = key_clusters(spark, d).select("key", "cnt", F.lit(0.0).alias("topic_relevance"))
    return C.low_tfidf_phrases(c, corpus.tfidf(docs), 0.0001)


@register(f"{CLUSTERS} SELECT key, cnt FROM c WHERE list_contains(string_split(key, ' '), 'of')")
def lemma_search(spark, d):
    return C.with_lemma(key_clusters(spark, d), "of").select("key", "cnt")


@register(f"{KEYS}, l AS (SELECT doc_id, sent_no, \"start\", \"end\", model, key, lag(key) OVER (PARTITION BY doc_id, sent_no ORDER BY \"start\", \"end\", model) AS prev FROM q) SELECT doc_id, sent_no, \"start\", \"end\", model, key FROM l WHERE key IS DISTINCT FROM prev")
def without_repeats(spark, d):
    return patterns.keyed(tagged(spark, d), PATTERNS, repeats=False).select("doc_id", "sent_no", "start", "end", "model", "key")


ROWS = "SELECT CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' ELSE p_brand || ' ' || p_name END AS phrase, p_size AS n, p_retailprice AS score, p_brand AS tag FROM part"


@register(f"WITH r AS ({ROWS}), p AS (SELECT DISTINCT phrase FROM r), m AS (SELECT phrase, CASE WHEN phrase LIKE '%s' AND phrase[:-2] IN (SELECT phrase FROM p) THEN phrase[:-2] ELSE phrase END AS canonical FROM p) SELECT canonical AS phrase, sum(n)::BIGINT AS n, max(score) AS top, round(avg(score), 6) AS mean, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM r JOIN m USING (phrase) GROUP BY canonical")
def canonical_rows(spark, d):
    size = F.col("p_size") % 3
    r = read(spark, d, "part").select(F.when(size == 0, F.col("p_name")).when(size == 1, F.concat("p_name", F.lit("s"))).otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("phrase"), F.col("p_size").alias("n"), F.col("p_retailprice").alias("score"), F.col("p_brand").alias("tag"))
    return P.canonical_rows(r, P.merge_endings(r.select("phrase"), (("s", "", ""),)))


TAGS = "list_transform(string_split(p_name || ' of ' || lower(p_type), ' '), lambda w: {'w': w, 'pos': CASE WHEN w = 'of' THEN 'ADP' WHEN w IN ('hot', 'cold', 'new', 'old') THEN 'ADJ' WHEN w IN ('small', 'large') THEN 'VERB' WHEN w = 'blue' THEN NULL ELSE 'NOUN' END})"


@register(f"WITH t AS (SELECT DISTINCT p_name || ' ' || p_type AS name, {TAGS} AS t FROM part), k AS (SELECT name, t, list_filter(t, lambda x: x.pos IS NULL OR x.pos IN ('NOUN', 'ADJ', 'ADP')) AS s FROM t) SELECT name, CASE WHEN s[1].pos = 'ADP' OR s[-1].pos = 'ADP' THEN '' ELSE array_to_string(list_transform(s, lambda x: x.w), ' ') END AS phrase, list_filter(t, lambda x: x.pos = 'NOUN')[1].w AS head FROM k")
def normalized_phrases(spark, d):
    words = F.split(F.concat(F.col("p_name"), F.lit(" of "), F.lower("p_type")), " ")
    pos = lambda w: F.when(w == "of", "ADP").when(w.isin("hot", "cold", "new", "old"), "ADJ").when(w.isin("small", "large"), "VERB").when(w == "blue", F.lit(None)).otherwise("NOUN")
    t = read(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name"), F.transform(words, lambda w: F.struct(w.alias("w"), w.alias("lemma"), pos(w).alias("pos"))).alias("t")).distinct()
    return t.select("name", P.normalized(F.col("name"), F.col("t"), ("NOUN", "ADJ", "ADP")).alias("phrase"), P.head_noun(F.col("t")).alias("head"))
