"""Queries over vectors: neighbours, topics, centrality, votes."""

from pyspark.sql import functions as F

from termloom.functions import vectors as V
from termloom.operators import phrases as P
from termloom.operators import vectors as O
from termloom.plans.q_text import read
from termloom.plans.registry import register

VEC = "SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings"


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", V.doubles(F.col("embedding")).alias("v"))


KNN = f"SELECT query_id, id, sim, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id))::INTEGER AS rank FROM (SELECT q.id AS query_id, x.id, round(list_cosine_similarity(q.v, x.v), 6) AS sim FROM ({VEC}) q, ({VEC}) x WHERE q.id % 50 = 0 AND q.id <> x.id)"


@register(f"SELECT query_id, id, sim, rank FROM ({KNN}) WHERE rank <= 100")
def knn_top100(spark, d):
    v = vectors(spark, d).select("id", "v")
    return O.knn(v.where("id % 50 = 0"), v, 100)


@register(f"SELECT query_id, id, sim, rank FROM ({KNN}) WHERE rank <= 10 AND sim >= 0.2")
def similar_terms(spark, d):
    v = vectors(spark, d).select("id", "v")
    return O.knn(v.where("id % 50 = 0"), v, 10).where("sim >= 0.2")


CENTROIDS = f"SELECT label, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM ({VEC})) GROUP BY ALL) GROUP BY label"


@register(f"SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS cos, round(list_distance(a.c, b.c), 6) AS dist FROM ({CENTROIDS}) a JOIN ({CENTROIDS}) b ON a.label < b.label")
def topic_pairs(spark, d):
    c = O.centroids(vectors(spark, d), "label")
    a, b = c.select(F.col("label").alias("a"), F.col("c").alias("x")), c.select(F.col("label").alias("b"), F.col("c").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cos"), F.round(V.euclidean(F.col("x"), F.col("y")), 6).alias("dist"))


MANHATTAN = "list_sum(list_transform(list_zip(v, c), lambda p: abs(p[1] - p[2])))"
SCORE = f"round(0.6 * list_cosine_similarity(v, c) + 0.2 / (1 + list_distance(v, c)) + 0.2 / (1 + {MANHATTAN}), 6)"
MATCH = f"SELECT id, topic, score FROM (SELECT id, t.label AS topic, {SCORE} AS score FROM ({VEC}) e, ({CENTROIDS}) t) WHERE score > 0.3"


def matched(spark, d):
    v = vectors(spark, d)
    return O.matches(v, O.centroids(v, "label").withColumnRenamed("label", "topic"), 0.3)


@register(MATCH)
def topic_match(spark, d):
    return matched(spark, d)


@register(f"WITH m AS ({MATCH}), c AS (SELECT topic FROM m GROUP BY topic HAVING count(*) > (SELECT floor(count(*) * 0.12) FROM embeddings)), n AS (SELECT id, count(*) AS n FROM m WHERE topic NOT IN (SELECT topic FROM c) GROUP BY id) SELECT vec_id AS id, coalesce(n, 0) AS n, coalesce(n, 0) BETWEEN 1 AND 6 AS tag_match FROM embeddings LEFT JOIN n ON vec_id = id")
def topic_penalty(spark, d):
    return O.topic_counts(matched(spark, d), vectors(spark, d), 0.12, 7)


@register(f"SELECT label, round(avg(list_cosine_similarity(v, c)), 6) AS cos, round(avg(1 / (1 + list_distance(v, c))), 6) AS closeness FROM ({VEC}) JOIN ({CENTROIDS}) USING (label) GROUP BY label")
def centrality(spark, d):
    return O.centrality(vectors(spark, d), "label")


@register(f"SELECT label, round(avg(list_max(s) / list_sum(s)), 6) AS relevance FROM (SELECT label, list_transform(v[1:50], lambda x: x * x) AS s FROM ({VEC})) GROUP BY label")
def topic_relevance(spark, d):
    return O.topic_relevance(vectors(spark, d), "label")


@register(f"SELECT label, round(avg(list_transform(v[1:5], lambda x: abs(x)).list_sum() / 5), 6) AS relevance FROM ({VEC}) GROUP BY label")
def term_relevance(spark, d):
    return vectors(spark, d).groupBy("label").agg(F.round(F.avg(V.total(F.transform(F.slice("v", 1, 5), F.abs)) / 5), 6).alias("relevance"))


@register(f"SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1, round(list_sum(list_transform(v, lambda x: least(abs(x), 0.1))) / list_sum(list_transform(v, lambda x: greatest(abs(x), 0.1))), 6) AS jaccard FROM ({VEC})")
def vector_norms(spark, d):
    zero, tenth = F.transform("v", lambda x: x * 0), F.transform("v", lambda x: x * 0 + 0.1)
    return vectors(spark, d).select("id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(V.manhattan(F.col("v"), zero), 6).alias("l1"), F.round(V.jaccard(F.transform("v", F.abs), tenth), 6).alias("jaccard"))


@register(None)
def lsh_pairs(spark, d):
    """Approximate neighbours by random projections; no SQL."""
    return O.lsh_pairs(vectors(spark, d).select("id", "v"), 1.1).select("a", "b", F.round("dist", 6).alias("dist"))


NAMES = "SELECT DISTINCT p_name AS phrase FROM part"
GRAMS = "list_filter(list_distinct(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, len(w) + 1), lambda k: array_to_string(w[i:k], ' '))))), lambda g: g <> phrase)"


def names(spark, d):
    return read(spark, d, "part").select(F.col("p_name").alias("phrase")).distinct()


TAXONOMY = "SELECT DISTINCT unnest([string_split(p_name, ' ')[1], p_name]) AS phrase FROM part"


@register(f"WITH t AS ({TAXONOMY}), s AS (SELECT phrase, unnest({GRAMS}) AS part FROM (SELECT phrase, string_split(phrase, ' ') AS w FROM t)) SELECT s.phrase, s.part FROM s JOIN t ON s.part = t.phrase")
def sub_phrases(spark, d):
    return P.sub_phrases(taxonomy(spark, d))


def taxonomy(spark, d):
    return read(spark, d, "part").select(F.explode(F.array(F.get(F.split("p_name", " "), F.lit(0)), "p_name")).alias("phrase")).distinct()


@register(f"""WITH t AS ({TAXONOMY}), n AS (SELECT DISTINCT p_brand AS query, p_name AS phrase, 0.9 AS sim FROM part),
g AS (SELECT DISTINCT phrase, part FROM (SELECT phrase, unnest({GRAMS}) AS part FROM (SELECT phrase, string_split(phrase, ' ') AS w FROM (SELECT phrase FROM n UNION SELECT phrase FROM t))) WHERE part IN (SELECT phrase FROM t)),
h AS (SELECT query, phrase AS part, sim FROM n WHERE phrase IN (SELECT phrase FROM t) UNION ALL SELECT query, part, sim FROM n JOIN g USING (phrase)),
v AS (SELECT query, part AS hypernym, sim AS vote FROM h UNION ALL SELECT query, g.part, sim * 0.5 FROM h JOIN g ON h.part = g.phrase),
s AS (SELECT query, hypernym, round(sum(vote)::DOUBLE, 6) AS vote FROM v WHERE hypernym <> query GROUP BY ALL)
SELECT query, hypernym, vote, (row_number() OVER (PARTITION BY query ORDER BY vote DESC, hypernym))::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def hypernym_votes(spark, d):
    n = read(spark, d, "part").select(F.col("p_brand").alias("query"), F.col("p_name").alias("phrase")).distinct().withColumn("sim", F.lit(0.9))
    return P.votes(n, taxonomy(spark, d))


@register(f"WITH w AS (SELECT phrase, unnest(list_distinct(string_split(phrase, ' '))) AS w FROM ({NAMES})), n AS (SELECT w, count(*) AS n FROM w GROUP BY w) SELECT phrase, round(sum(1 / n), 8) AS rarity FROM w JOIN n USING (w) GROUP BY phrase")
def inverse_rarity(spark, d):
    return P.inverse_rarity(names(spark, d)).select("phrase", F.round("rarity", 8).alias("rarity"))


@register("SELECT array_to_string(list_sort(string_split(phrase, ' ')), ' ') AS words, count(*) AS n, string_agg(DISTINCT phrase, '|' ORDER BY phrase) AS phrases FROM (SELECT p_name || ' ' || p_type AS phrase FROM part) GROUP BY 1 HAVING count(*) > 1")
def grouped_phrases(spark, d):
    return P.grouped(read(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("phrase")))


STEM = "CASE WHEN length(x) > 2 THEN left(x, length(x) - 2) ELSE x END"


@register(f"WITH t AS (SELECT phrase, array_to_string(list_transform(string_split(phrase, ' '), lambda x: {STEM}), ' ') AS s FROM ({TAXONOMY})) SELECT p.phrase AS parent, c.phrase FROM t p JOIN t c ON contains(' ' || c.s || ' ', ' ' || p.s || ' ') WHERE p.phrase <> c.phrase")
def sub_phrase_index(spark, d):
    t = taxonomy(spark, d)
    return P.stemmed_sub_phrases(t, t)


@register(f"WITH n AS (SELECT DISTINCT p_name || ' ' || p_type AS phrase FROM part), b AS ({NAMES}) SELECT b.phrase AS base, n.phrase AS variant FROM b JOIN n ON contains(n.phrase, b.phrase) WHERE len(string_split(b.phrase, ' ')) = 2 AND len(string_split(n.phrase, ' ')) > 2")
def usage_variants(spark, d):
    longer = read(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("phrase")).distinct()
    return P.usage_variants(names(spark, d).where(F.size(F.split("phrase", " ")) == 2), longer)


PREFIX = "SELECT DISTINCT unnest([p_brand, p_brand || ' ' || p_size, p_brand || ' ' || p_size || ' ' || p_name]) AS key FROM part"


@register(f"WITH k AS ({PREFIX}) SELECT a.key, arg_min(b.key, length(b.key)) AS root FROM k a JOIN k b ON starts_with(a.key, b.key) AND a.key <> b.key GROUP BY a.key")
def prefix_nesting(spark, d):
    key = F.explode(F.array("p_brand", F.concat_ws(" ", "p_brand", "p_size"), F.concat_ws(" ", "p_brand", "p_size", "p_name"))).alias("key")
    return P.prefix_roots(read(spark, d, "part").select(key).distinct())
