"""Queries over sentences: key pairs, triggers, contexts, a wordnet in tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import lexicon, sentences
from termloom.plans.q_text import read
from termloom.plans.registry import register

#: Words that join a term and its explanation in the test prose. Fixed values.
TRIGGERS = (" la ", " the ", " de ", " and ")


@register("WITH k AS (SELECT l_orderkey, l_linenumber AS i, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || lower(p_type) END AS key FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT DISTINCT a.l_orderkey, CASE WHEN len(string_split(a.key, ' ')) <= len(string_split(b.key, ' ')) THEN a.key ELSE b.key END AS hyper, CASE WHEN len(string_split(a.key, ' ')) <= len(string_split(b.key, ' ')) THEN b.key ELSE a.key END AS hypo FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.i < b.i AND a.key <> b.key")
def key_pairs(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", F.lower("p_type")))
    keys = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("l_linenumber").alias("i"), name.alias("key"))
    return sentences.key_pairs(keys, ["l_orderkey"])


SENT = r"SELECT conv_id, turn, generate_subscripts(s, 1) - 1 AS no, unnest(s) AS text FROM (SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM conversations)"
SENT_ID = f"SELECT conv_id || ':' || turn || ':' || no AS sent_id, conv_id, turn, no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM ({SENT})"
KEYS = rf"SELECT sent_id, text, key, length(key) % 10 / 10 AS prob, (length(key) % 3 = 0)::INTEGER AS manual FROM (SELECT DISTINCT sent_id, text, unnest(regexp_extract_all(lower(text), '\p{{L}}{{4,}}')) AS key FROM ({SENT_ID}))"


def conversation_sentences(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("no", "text"))
    return c.select(F.concat_ws(":", "conv_id", "turn", "no").alias("sent_id"), "conv_id", "turn", "no", T.squeeze(F.col("text")).alias("text"))


def sentence_keys(spark, d):
    """Words of four or more letters as keys, with a made-up probability and mark."""
    keys = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0))))
    n = F.length("key")
    return conversation_sentences(spark, d).select("sent_id", "text", keys.alias("key")).withColumn("prob", n % 10 / 10).withColumn("manual", (n % 3 == 0).cast("int"))


def gap_sql(text):
    return f"len(list_filter(string_split(trim({text}), ' '), lambda x: x <> ''))"


LAST = "CASE WHEN strpos(reverse(h), reverse(key)) > 0 THEN length(h) - length(key) - strpos(reverse(h), reverse(key)) + 2 ELSE 0 END"


def placed_sql(trigger):
    """Keys with where they stand before and behind the trigger."""
    return f"""SELECT *, {LAST} AS l, strpos(r, key) AS p, strpos(low, key) AS f FROM (SELECT *, substr(low, 1, strpos(low, tr) - 1) AS h, strpos(low, tr) + length(tr) AS st, substr(low, strpos(low, tr) + length(tr)) AS r
    FROM (SELECT *, lower(text) AS low, {trigger} AS tr FROM k)) WHERE tr IS NOT NULL"""


AFTER = f"CASE WHEN p > 0 THEN {gap_sql('substr(r, 1, p - 1)')} <= 2 ELSE f > 0 AND f < st AND f + length(key) > st END"
INSIDE = "CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN '{t}'" for t in TRIGGERS) + " END"
AT_START = "CASE " + " ".join(f"WHEN starts_with(lower(text), '{t.strip()} ') THEN '{t.strip()} '" for t in TRIGGERS) + " END"


@register(f"""WITH k AS ({KEYS}), x AS (SELECT * FROM ({placed_sql(INSIDE)}) WHERE NOT (manual = 0 AND prob < 0.05)),
a AS (SELECT * FROM x WHERE l > 0 AND {gap_sql('substr(h, l + length(key))')} <= 2), b AS (SELECT * FROM x WHERE {AFTER})
SELECT a.sent_id, a.tr AS "trigger", a.key AS subject, b.key AS predicate FROM a JOIN b ON a.sent_id = b.sent_id
QUALIFY row_number() OVER (PARTITION BY a.sent_id ORDER BY round(a.prob + b.prob, 9) DESC, a.manual + b.manual DESC, a.key, b.key) <= 2""")
def trigger_relations(spark, d):
    return sentences.triggered(sentence_keys(spark, d), list(TRIGGERS))


@register(f"""WITH s AS (SELECT *, lag(sent_id) OVER (PARTITION BY conv_id ORDER BY turn, no) AS prev_id FROM ({SENT_ID})), k AS ({KEYS}),
e AS (SELECT *, l + length(key) AS e FROM (SELECT *, {LAST} AS l FROM (SELECT *, lower(text) AS h FROM k))),
g AS (SELECT sent_id, key FROM e QUALIFY rank() OVER (PARTITION BY sent_id ORDER BY e DESC, length(key) DESC) = 1)
SELECT x.sent_id, subject, x.key AS predicate FROM ({placed_sql(AT_START)}) x JOIN s ON s.sent_id = x.sent_id JOIN (SELECT sent_id AS id, key AS subject FROM g) g ON g.id = s.prev_id WHERE {AFTER}""")
def cross_sentence_relations(spark, d):
    s = conversation_sentences(spark, d).withColumn("prev_id", F.lag("sent_id").over(Window.partitionBy("conv_id").orderBy("turn", "no")))
    return sentences.across(s, sentence_keys(spark, d), [f"{t.strip()} " for t in TRIGGERS])


@register(f"WITH s AS ({SENT_ID}), f AS (SELECT key, trim(unnest(string_split(context, '|'))) AS part FROM (SELECT role || conv_id % 5 AS key, string_agg(text, ' | ' ORDER BY conv_id, turn, no) AS context FROM s JOIN (SELECT conv_id, turn, role FROM conversations) USING (conv_id, turn) GROUP BY 1)) SELECT sent_id, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM s JOIN f ON trim(s.text) = f.part WHERE part <> '' GROUP BY sent_id")
def sentence_keys_by_context(spark, d):
    s = conversation_sentences(spark, d)
    c = s.join(read(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    features = c.groupBy(F.concat("role", F.col("conv_id") % 5).alias("key")).agg(F.array_join(F.collect_list("text"), " | ").alias("context"))
    return sentences.keys_of_sentences(s, features)


NOUNS = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) AS noun FROM benchmark"


@register(rf"""WITH n AS MATERIALIZED ({NOUNS}), s AS MATERIALIZED (SELECT sent_id, conv_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS size, string_split(lower(text), ' ') AS ts FROM ({SENT_ID})),
t AS MATERIALIZED (SELECT DISTINCT sent_id, conv_id, size, unnest(ts) AS t FROM s), w AS (SELECT DISTINCT t FROM t),
m AS MATERIALIZED (SELECT t, noun FROM w JOIN n ON abs(length(t) - length(noun)) <= 3 AND (CASE WHEN length(noun) < 5 THEN t = noun ELSE contains(t, noun[:-2]) END)),
h AS (SELECT DISTINCT noun, sent_id, conv_id, size FROM t JOIN m USING (t)), c AS (SELECT *, count(*) OVER (PARTITION BY noun) AS n FROM h)
SELECT noun, count(*) AS contexts, count(DISTINCT conv_id) AS docs FROM c WHERE n = 1 OR size > 5 GROUP BY noun""")
def noun_contexts(spark, d):
    nouns = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("noun")).distinct()
    return sentences.noun_contexts(nouns, conversation_sentences(spark, d).select("sent_id", F.col("conv_id").alias("doc"), "text"))


WORDNET = "s AS (SELECT DISTINCT p_name AS lemma, p_brand AS synset FROM part UNION SELECT DISTINCT lower(p_type), p_type FROM part), l AS (SELECT DISTINCT p_brand AS synset, p_type AS hypernym FROM part)"


@register(f"""WITH {WORDNET}, o AS (SELECT * FROM s), a AS (SELECT lemma, hypernym AS synset FROM s JOIN l USING (synset)), b AS (SELECT lemma, l.synset FROM s JOIN l ON s.synset = l.hypernym), c AS (SELECT lemma, l.synset FROM a JOIN l ON a.synset = l.hypernym),
r AS (SELECT DISTINCT *, 'synonym' AS relation FROM o UNION ALL SELECT DISTINCT *, 'hypernym' FROM a UNION ALL SELECT DISTINCT *, 'hyponym' FROM b UNION ALL SELECT DISTINCT *, 'sibling' FROM c)
SELECT DISTINCT r.lemma, relation, s.lemma AS other FROM r JOIN s ON r.synset = s.synset WHERE s.lemma <> r.lemma AND NOT starts_with(s.lemma, 'old')""")
def wordnet_relations(spark, d):
    part = read(spark, d, "part")
    senses = part.select(F.col("p_name").alias("lemma"), F.col("p_brand").alias("synset")).union(part.select(F.lower("p_type"), "p_type")).distinct()
    links = part.select(F.col("p_brand").alias("synset"), F.col("p_type").alias("hypernym"))
    return lexicon.related_words(senses, senses, links, senses.where("lemma like 'old%'"))
