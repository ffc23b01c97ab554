"""Look-ups in a wordnet given as tables: senses (lemma, synset) and links (synset, hypernym)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def related_words(words: DataFrame, senses: DataFrame, links: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """lemma, relation, other: synonyms, hypernyms, hyponyms and siblings of each word, itself and the excluded left out.

    words (lemma) is the stated query set; every step is a join on a synset's key.
    """
    up = links.select("synset", "hypernym").distinct()
    own = words.select("lemma").distinct().join(senses, "lemma").select("lemma", "synset")
    above = own.join(up, "synset").select("lemma", F.col("hypernym").alias("synset"))
    down = up.select(F.col("hypernym").alias("synset"), F.col("synset").alias("below"))
    below = own.join(down, "synset").select("lemma", F.col("below").alias("synset"))
    beside = above.join(down, "synset").select("lemma", F.col("below").alias("synset"))
    kinds = (("synonym", own), ("hypernym", above), ("hyponym", below), ("sibling", beside))
    out = None
    for name, found in kinds:
        part = found.distinct().withColumn("relation", F.lit(name))
        out = part if out is None else out.unionByName(part)
    out = out.join(senses.select("synset", F.col("lemma").alias("other")), "synset").where("other <> lemma").select("lemma", "relation", "other").distinct()
    return out if excluded is None else out.join(excluded.select(F.col("lemma").alias("other")), "other", "left_anti").select("lemma", "relation", "other")
