"""Publication: nested JSON of clusters, HTML pages, text vectors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T


def cluster_json(occ: DataFrame) -> DataFrame:
    """key and one JSON document with its occurrences in order."""
    o = F.struct("text_form", F.struct("start", "end", "doc_id", "sent_no").alias("position"))
    rows = occ.groupBy("key").agg(F.count("*").alias("phrases_count"), F.array_sort(F.collect_list(o)).alias("phrases"))
    return rows.select("key", F.to_json(F.struct("phrases_count", "phrases")).alias("json"))


def grouped_json(groups: DataFrame) -> DataFrame:
    """cluster_json() from rows of (key, places), of spans whose text is their key."""
    rows = groups.groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    phrases = F.transform("places", lambda p: F.struct(F.col("key").alias("text_form"), p.alias("position")))
    return rows.select("key", F.to_json(F.struct(F.size("places").cast("long").alias("phrases_count"), phrases.alias("phrases"))).alias("json"))


def escape(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pages(edges: DataFrame) -> DataFrame:
    """key, slug and the HTML of its page, relations and phrases in order."""
    item = F.concat(F.lit('<li><a href="'), T.slugify(F.col("phrase")), F.lit('.html">'), escape(F.col("phrase")), F.lit("</a> ("), F.col("relation"), F.lit(")</li>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relation", "phrase", item.alias("li")))), lambda x: x["li"]), "")
    rows = edges.groupBy("key").agg(body.alias("body"))
    k = F.col("key")
    return rows.select("key", T.slugify(k).alias("slug"), F.concat(F.lit("<h1>"), escape(k), F.lit("</h1><ul>"), F.col("body"), F.lit("</ul>")).alias("html"))


def vector_lines(vectors: DataFrame) -> DataFrame:
    """One line of text for each vector: the word and its components."""
    return vectors.select(F.concat_ws(" ", "w", F.array_join(F.transform("v", lambda x: F.format_string("%.6f", x)), " ")).alias("value"))
