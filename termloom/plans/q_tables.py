"""Queries over scored tables and edges: filters, merging, comparison, evaluation."""

from pyspark.sql import functions as F

from termloom.operators import evaluation as E
from termloom.operators import relations as R
from termloom.operators import selection as S
from termloom.plans.q_relations import EDGES, SCORED, edges, scored
from termloom.plans.q_text import read
from termloom.plans.registry import register

#: Candidates for terms, from part. Fixed for the query and its SQL.
CANDS = "SELECT p_partkey AS key, p_type AS model_name, p_size % 2 AS manual, p_partkey % 100 / 100 AS prob, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'general phrase' WHEN 2 THEN 'term' ELSE 'everyday expression' END AS label FROM part"


def candidates(spark, d):
    size = F.col("p_size") % 4
    label = F.when(size == 0, F.lit(None)).when(size == 1, "general phrase").when(size == 2, "term").otherwise("everyday expression")
    return read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("model_name"), (F.col("p_size") % 2).alias("manual"), (F.col("p_partkey") % 100 / 100).alias("prob"), label.alias("label"))


@register(f"SELECT key, prob, label FROM ({CANDS}) WHERE ((manual = 1 AND prob >= 0.05) OR (manual = 0 AND prob > 0.34)) AND model_name NOT IN ('PROMO', 'SMALL') AND coalesce(label, '') NOT IN ('general phrase')")
def dataset_filter(spark, d):
    return S.dataset_filter(candidates(spark, d), ["PROMO", "SMALL"], ["general phrase"]).select("key", "prob", "label")


@register(f"SELECT key FROM ({CANDS}) WHERE NOT (manual = 0 AND prob < 0.05)")
def candidate_gate(spark, d):
    return S.gate(candidates(spark, d), 0.05).select("key")


@register(f"SELECT key, coalesce(CASE WHEN l_quantity > 25 THEN 'checked' END, label) AS label FROM ({CANDS}) LEFT JOIN (SELECT l_partkey AS key, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) USING (key)")
def label_override(spark, d):
    new = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.when(F.max("l_quantity") > 25, "checked").alias("label"))
    return R.override(candidates(spark, d), new, "key", "label").select("key", "label")


MARKED = f"SELECT *, (length(key) + length(phrase)) % 7 / 10 AS prob, (length(phrase) % 2 = 1 AND relation = 'antonym')::INTEGER AS manual FROM ({EDGES})"


def marked(spark, d):
    n = F.length("phrase")
    return edges(spark, d).withColumn("prob", (F.length("key") + n) % 7 / 10).withColumn("manual", ((n % 2 == 1) & (F.col("relation") == "antonym")).cast("int"))


@register(f"WITH m AS ({MARKED}) SELECT key, phrase, relation FROM m WHERE key IN (SELECT key FROM m WHERE manual <> 0 OR prob >= 0.6)")
def strong_entries(spark, d):
    return R.strong_entries(marked(spark, d), 0.6).select("key", "phrase", "relation")


@register(f"WITH e AS ({EDGES}), s AS (SELECT * FROM e WHERE relation = 'synonym') SELECT * FROM s UNION ALL SELECT phrase, key, relation FROM s b WHERE phrase IN (SELECT key FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.key = b.phrase AND s.phrase = b.key)")
def mutual_synonyms(spark, d):
    return R.complete_mutual(edges(spark, d).where("relation = 'synonym'"))


@register(f"WITH e AS ({EDGES}), p AS (SELECT phrase AS key, key AS phrase FROM e), k AS (SELECT * FROM e WHERE relation <> 'related') SELECT p.key, p.phrase, coalesce(a.relation, b.relation || ' (reversed)') AS relation FROM p LEFT JOIN k a ON a.key = p.key AND a.phrase = p.phrase LEFT JOIN k b ON b.key = p.phrase AND b.phrase = p.key")
def lookup_either_way(spark, d):
    e = edges(spark, d)
    return R.lookup_either_way(e.select(F.col("phrase").alias("key"), F.col("key").alias("phrase")), e.where("relation <> 'related'"))


@register(f"WITH e AS ({EDGES}), a AS (SELECT key, phrase FROM e WHERE relation IN ('synonym', 'related')), b AS (SELECT key, phrase FROM e WHERE relation IN ('related', 'hypernym')) SELECT key, count(*) FILTER (ia) AS n_a, count(*) FILTER (ib) AS n_b, count(*) FILTER (ia AND ib) AS common FROM (SELECT key, phrase, bool_or(x = 1) AS ia, bool_or(x = 2) AS ib FROM (SELECT *, 1 AS x FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY key, phrase) GROUP BY key")
def compare_models(spark, d):
    e = edges(spark, d)
    return R.compare_models(e.where("relation in ('synonym', 'related')"), e.where("relation in ('related', 'hypernym')"))


@register("SELECT p_brand AS key, p_name AS phrase, arg_max(round(p_retailprice, 5), p_retailprice) AS sim, min(lower(p_type)) FILTER (p_retailprice = m) AS source FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand, p_name) AS m FROM part) GROUP BY ALL")
def best_by_phrase(spark, d):
    return R.best_by_phrase(read(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("phrase"), F.col("p_retailprice").alias("sim"), F.lower("p_type").alias("source")))


@register("WITH s AS (SELECT 'c' || l_suppkey AS hyper, 'p' || l_partkey AS hypo, 0.5 + l_quantity / 100 AS ent, l_discount * 5 AS contr, l_tax * 10 AS neutral FROM lineitem), m AS (SELECT hyper, hypo, round(avg(ent), 6) AS ent, round(avg(contr), 6) AS contr, round(avg(neutral), 6) AS neutral FROM s GROUP BY ALL) SELECT *, ent >= 0.8 AND round(ent - contr, 6) >= 0.01 AND neutral <= ent AS is_hyper FROM m")
def nli_decisions(spark, d):
    li = read(spark, d, "lineitem")
    return R.nli_decisions(li.select(F.concat(F.lit("c"), "l_suppkey").alias("hyper"), F.concat(F.lit("p"), "l_partkey").alias("hypo"), (0.5 + F.col("l_quantity") / 100).alias("ent"), (F.col("l_discount") * 5).alias("contr"), (F.col("l_tax") * 10).alias("neutral")))


@register("SELECT p_brand AS head, p_type AS relation, p_name AS word, round(avg(p_retailprice), 6) AS sim, string_agg(DISTINCT 'size ' || p_size, '; ' ORDER BY 'size ' || p_size) AS contexts, string_agg(DISTINCT p_brand || ' ' || p_name, ',' ORDER BY p_brand || ' ' || p_name) AS terms FROM part GROUP BY ALL")
def head_nouns(spark, d):
    return R.head_nouns(read(spark, d, "part").select(F.col("p_brand").alias("head"), F.col("p_type").alias("relation"), F.col("p_name").alias("word"), F.col("p_retailprice").alias("sim"), F.concat(F.lit("size "), "p_size").alias("context"), F.concat_ws(" ", "p_brand", "p_name").alias("term")))


@register(f"WITH e AS ({EDGES}), g AS (SELECT key, phrase FROM e WHERE relation IN ('hypernym', 'synonym')), p AS (SELECT phrase AS key, key AS phrase FROM e WHERE relation = 'hypernym' UNION SELECT key, phrase FROM e WHERE relation IN ('synonym', 'related')), n AS (SELECT (SELECT count(*) FROM (FROM g INTERSECT FROM p)) AS tp, (SELECT count(*) FROM (FROM p EXCEPT FROM g)) AS fp, (SELECT count(*) FROM (FROM g EXCEPT FROM p)) AS fn) SELECT tp, fp, fn, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, (SELECT count(*) FROM ((FROM p EXCEPT FROM g) INTERSECT SELECT phrase, key FROM g)) AS reversed FROM n")
def pair_prf(spark, d):
    e = edges(spark, d)
    gold = e.where("relation in ('hypernym', 'synonym')")
    pred = e.where("relation = 'hypernym'").select(F.col("phrase").alias("key"), F.col("key").alias("phrase")).union(e.where("relation in ('synonym', 'related')").select("key", "phrase"))
    return E.pair_prf(gold, pred)


@register(f"WITH s AS (SELECT score, sum(y) AS pos, count(*) AS n FROM ({SCORED}) GROUP BY score), r AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round((sum(pos * tp / seen) / sum(pos))::DOUBLE, 8) AS average_precision FROM r")
def average_precision(spark, d):
    return E.average_precision(scored(spark, d))


@register(f"WITH s AS ({SCORED}), t AS (SELECT t, sum((floor(score * 100) >= t)::INT * y) AS tp, sum((floor(score * 100) >= t)::INT) AS p, sum(y) AS g FROM s, (SELECT unnest(range(101)) AS t) GROUP BY t), b AS (SELECT t AS step, round(coalesce(2 * tp / nullif(p + g, 0), 0)::DOUBLE, 8) AS f1 FROM t ORDER BY 2 DESC, 1 LIMIT 1) SELECT step, f1, round(avg(((floor(score * 100) >= step)::INT = y)::INT), 8) AS accuracy FROM s, b GROUP BY step, f1")
def best_threshold(spark, d):
    return E.best_threshold(scored(spark, d))


@register(f"SELECT doc_id, y FROM ({SCORED}) WHERE (score >= 0.5)::INT <> y")
def misclassified(spark, d):
    return E.misclassified(scored(spark, d)).select("doc_id", "y")


@register("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) < 30")
def small_classes(spark, d):
    return E.small_classes(read(spark, d, "part"), "p_name", 30)


COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1 :]))
def correlations(spark, d):
    return E.correlations(read(spark, d, "lineitem"), list(COLS))


@register(f"WITH e AS ({EDGES}), v AS (SELECT key, count(*) AS n FROM e WHERE relation = 'related' GROUP BY key) SELECT round(avg(n), 6) AS mean, max(n) AS high, min(n) AS low FROM v")
def variant_counts(spark, d):
    return edges(spark, d).where("relation = 'related'").groupBy("key").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("high"), F.min("n").alias("low"))


@register("SELECT p_name AS key, p_type || ' ' || p_name AS phrase FROM (SELECT p_name, p_size, p_partkey, CASE WHEN p_brand > 'Brand#2' THEN string_split(p_name, ' ')[1][:5] || 'ish' ELSE p_type END AS p_type FROM part) WHERE NOT (p_size % 2 = 0 AND p_partkey % 3 = 0 AND starts_with(p_type || ' ' || p_name, string_split(p_name, ' ')[1][:5]))")
def paraphrase_filter(spark, d):
    kind = F.when(F.col("p_brand") > "Brand#2", F.concat(F.left(F.element_at(F.split("p_name", " "), 1), F.lit(5)), F.lit("ish"))).otherwise(F.col("p_type"))
    p = read(spark, d, "part").select(F.col("p_name").alias("key"), F.concat_ws(" ", kind, "p_name").alias("phrase"), F.when(F.col("p_size") % 2 == 0, "NOUN NOUN").otherwise("ADJ NOUN").alias("key_tags"), F.when(F.col("p_partkey") % 3 == 0, "ADJ NOUN").otherwise("NOUN NOUN").alias("phrase_tags"))
    return R.paraphrases(p).select("key", "phrase")


@register("SELECT c_name AS key, c_nationkey AS size, NULL::VARCHAR AS model_name, round(c_acctbal, 4) AS frequency FROM customer UNION ALL SELECT upper(p_name[1]) || p_name[2:], 1, 'N', round(count(*) / 300, 4) FROM part GROUP BY p_name")
def enriched_rows(spark, d):
    base = read(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_nationkey").cast("int").alias("size"), F.round("c_acctbal", 4).alias("frequency"))
    return S.with_one_word_terms(base, read(spark, d, "part").select(F.col("p_name").alias("noun")), 300, "N")


FLAG_SCORES = "SELECT key, phrase, " + ", ".join(f"(length(key) * {3 + i} + length(phrase) * {5 + 2 * i} + key[2:]::INT * {7 + i}) % 10 / 10 AS {f}" for i, f in enumerate(R.FLAGS)) + f" FROM ({EDGES})"
YES = f"SELECT key, phrase, {', '.join(f'{f} > 0.5 AS {f}' for f in R.FLAGS)}, round(({' + '.join(f'abs({f} - 0.5)' for f in R.FLAGS)}) / 5, 6) AS confidence FROM ({FLAG_SCORES})"


@register(f"""WITH y AS ({YES}), j AS (SELECT y.*, y.is_hypernym OR (coalesce(b.is_hyponym, false) AND NOT y.is_hyponym) AS h1, y.is_hyponym OR (coalesce(b.is_hypernym, false) AND NOT y.is_hypernym) AS h2 FROM y LEFT JOIN y b ON y.key = b.phrase AND y.phrase = b.key)
SELECT key, phrase, CASE WHEN is_related THEN 'related' WHEN is_synonym THEN 'synonym' WHEN is_usage_variant THEN 'usage_variant' WHEN h1 AND NOT is_synonym THEN 'hypernym' WHEN h2 AND NOT is_synonym THEN 'hyponym' ELSE 'not_related' END AS relation, confidence FROM j""")
def consistent_predictions(spark, d):
    n = F.substr("key", F.lit(2)).cast("int")
    return R.consistent_predictions(edges(spark, d).select("key", "phrase", *((((F.length("key") * (3 + i) + F.length("phrase") * (5 + 2 * i) + n * (7 + i)) % 10) / 10).alias(f) for i, f in enumerate(R.FLAGS))))
