"""Queries with fitted models and publication; where a solver decides, there is no SQL."""

from pyspark.sql import functions as F

from termloom.operators import learning, lsa, patterns, publish
from termloom.plans.q_phrases import KEYS, PATTERNS, tagged
from termloom.plans.q_relations import EDGES, edges
from termloom.plans.q_text import read
from termloom.plans.q_vectors import vectors
from termloom.plans.registry import register


@register(None)
def lsa_topics(spark, d):
    u, _ = lsa.svd(lsa.term_doc(read(spark, d, "documents")), 10)
    return lsa.topics(u)


@register(None)
def pca(spark, d):
    return lsa.pca(vectors(spark, d).select("id", "v"))


def features(spark, d):
    t = F.col("text")
    docs = read(spark, d, "documents").select("doc_id", F.length(t).alias("chars"), F.size(F.split(t, " ")).alias("words"), F.size(F.split(t, "\n")).alias("lines"), F.regexp_count(t, F.lit(r"[#$%&*|]")).alias("symbols"))
    return read(spark, d, "labels").join(docs, "doc_id")


@register(None)
def stacked_oof(spark, d):
    return learning.stacked_oof(features(spark, d), "quality", "doc_id", ["chars", "words", "lines", "symbols"], hidden=(16, 8))


@register(None)
def smote(spark, d):
    v = features(spark, d).where("quality = 0").select(F.col("doc_id").alias("key"), F.array("chars", "words", "lines", "symbols").cast("array<double>").alias("v"))
    return learning.smote(v)


@register(f"WITH e AS ({EDGES}) SELECT key, key AS slug, '<h1>' || key || '</h1><ul>' || string_agg('<li><a href=\"' || phrase || '.html\">' || phrase || '</a> (' || relation || ')</li>', '' ORDER BY relation, phrase) || '</ul>' AS html FROM e GROUP BY key")
def html_pages(spark, d):
    return publish.pages(edges(spark, d))


@register(f"{KEYS} SELECT key, count(*) AS n FROM q GROUP BY key")
def cluster_json(spark, d):
    """Clusters through their JSON form and back."""
    j = publish.grouped_json(patterns.placed(tagged(spark, d), PATTERNS))
    back = F.from_json("json", "phrases_count long, phrases array<struct<text_form string, position struct<start int, `end` int, doc_id long, sent_no int>>>")
    return j.select("key", F.size(back["phrases"]).cast("long").alias("n"))
