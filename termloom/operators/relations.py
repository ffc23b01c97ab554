"""Relation edges (key, phrase, relation): closure, checks, merging, rules."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: relation -> what the reverse edge is called. Fixed values.
INVERSE = {"hypernym": "hyponym", "hyponym": "hypernym", "synonym": "synonym", "antonym": "antonym", "related": "related", "not_related": "not_related"}
FLAGS = ("is_synonym", "is_usage_variant", "is_related", "is_hypernym", "is_hyponym")


def inverse(relation: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in INVERSE.items() for x in kv))[relation]


def swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("phrase").alias("key"), F.col("key").alias("phrase"), inverse(F.col("relation")).alias("relation"))


def symmetric_closure(edges: DataFrame, keys_only: bool = True) -> DataFrame:
    """Edges and the inverses of those whose phrase is itself a key (or of all)."""
    back = swapped(edges)
    if keys_only:
        back = back.join(edges.select("key").distinct(), "key", "left_semi")
    return edges.unionByName(back).distinct()


def reverse_mismatch(edges: DataFrame, relation: str = "hypernym") -> DataFrame:
    """key, phrase, found: edges of a relation whose reverse edge is there but is not the inverse."""
    e = edges.where(F.col("relation") == relation)
    r = edges.select(F.col("phrase").alias("key"), F.col("key").alias("phrase"), F.col("relation").alias("found"))
    return e.join(r, ["key", "phrase"]).where(F.col("found") != INVERSE[relation]).select("key", "phrase", "found")


def with_not_related(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new edges, and pairs that only the old list has as not_related."""
    gone = old.select("key", "phrase").distinct().join(new.select("key", "phrase"), ["key", "phrase"], "left_anti")
    return new.unionByName(gone.withColumn("relation", F.lit("not_related")))


def without_self(edges: DataFrame) -> DataFrame:
    return edges.where("key <> phrase")


def within(edges: DataFrame, phrases: DataFrame) -> DataFrame:
    """Edges of which both ends are phrases of the table, trimmed and in lower case."""
    p = phrases.select(F.lower(F.trim("phrase")).alias("p")).distinct()
    own = edges.withColumn("_k", F.lower(F.trim("key"))).withColumn("_p", F.lower(F.trim("phrase")))
    return own.join(p, F.col("_k") == F.col("p"), "left_semi").join(p, F.col("_p") == F.col("p"), "left_semi").drop("_k", "_p")


def enforce_symmetry(edges: DataFrame) -> DataFrame:
    """Where both directions stand and disagree, the stronger relation (synonym, hypernym, hyponym, then by name) names both."""
    rank = lambda c: F.when(c == "synonym", 0).when(c == "hypernym", 1).when(c == "hyponym", 2).otherwise(3)
    r = edges.select(F.col("phrase").alias("key"), F.col("key").alias("phrase"), inverse(F.col("relation")).alias("back"))
    j = edges.join(r, ["key", "phrase"], "left")
    stronger = (rank(F.col("back")) < rank(F.col("relation"))) | ((rank(F.col("back")) == rank(F.col("relation"))) & (F.col("back") < F.col("relation")))
    return j.groupBy("key", "phrase", "relation").agg(F.min(F.when(stronger, F.struct(rank(F.col("back")).alias("r"), "back")))["back"].alias("b")).select("key", "phrase", F.coalesce("b", "relation").alias("relation")).distinct()


def upsert(edges: DataFrame, manual: DataFrame) -> DataFrame:
    """manual edges and their inverses in place of what stood between the same phrases."""
    both = manual.unionByName(swapped(manual)).distinct()
    return edges.join(both.select("key", "phrase"), ["key", "phrase"], "left_anti").unionByName(both)


def merge_flags(flagged: DataFrame) -> DataFrame:
    """One row a pair with the flags of all sources joined by or."""
    return flagged.groupBy("key", "phrase").agg(*(F.bool_or(f).alias(f) for f in FLAGS))


def flags_of(edges: DataFrame) -> DataFrame:
    """Typed edges as flags."""
    return edges.select("key", "phrase", *((F.col("relation") == f.removeprefix("is_")).alias(f) for f in FLAGS))


def resolve_flags(flags: DataFrame) -> DataFrame:
    """One relation a pair: related, synonym, usage variant, hypernym, hyponym, the first that is set."""
    rel = F.lit("not_related")
    for f in reversed(("is_related", "is_synonym", "is_usage_variant", "is_hypernym", "is_hyponym")):
        rel = F.when(F.col(f), f.removeprefix("is_")).otherwise(rel)
    return flags.select("key", "phrase", rel.alias("relation"))


def merge_synonyms(sources: DataFrame) -> DataFrame:
    """key, synonyms (all sources' distinct), best probability, marked by hand in any."""
    return sources.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("synonym")), ",").alias("synonyms"), F.max("prob").alias("prob"), F.max("manual").alias("manual"))


def distribution(edges: DataFrame) -> DataFrame:
    total = edges.agg(F.count("*").alias("all"))
    return edges.groupBy("relation").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("relation", "n", F.round(100 * F.col("n") / F.col("all"), 6).alias("percent"))


def negated_antonyms(pairs: DataFrame, prefix: str = "не") -> DataFrame:
    """Pairs of two or more words that differ by a negating prefix of one word."""
    a, b = F.split("key", " "), F.split("phrase", " ")
    neg = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == F.concat(F.lit(prefix), y)) | (y == F.concat(F.lit(prefix), x))), lambda t: t))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t))
    return pairs.where((F.size(a) == F.size(b)) & (F.size(a) >= 2) & (neg == 1) & (same == F.size(a) - 1))


def replaced_antonyms(pairs: DataFrame, antonyms: DataFrame) -> DataFrame:
    """Pairs that become equal when a word of the antonym table (a, b) is replaced by its opposite; the table is short."""
    both = antonyms.unionByName(antonyms.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hit = F.expr("contains(key, a) AND replace(key, a, b) = phrase")
    return pairs.join(F.broadcast(both), hit, "left_semi")


def rule_relations(pairs: DataFrame, markers: list[str], adjectives: list[str]) -> DataFrame:
    """relation by the first rule that fits: the phrase is the key's head or tail behind a marker (related), the key is an adjective and the phrase (hypernym), either the other way (hyponym); else as it was."""
    k, p = F.col("key"), F.col("phrase")
    marked = lambda a, b: F.array_contains(F.array(*map(F.lit, markers)), F.when(F.endswith(a, F.concat(F.lit(" "), b)), F.substring(a, F.lit(1), F.length(a) - F.length(b) - 1)))
    adj = lambda a, b: F.array_contains(F.array(*map(F.lit, adjectives)), F.when(F.endswith(a, F.concat(F.lit(" "), b)), F.substring(a, F.lit(1), F.length(a) - F.length(b) - 1)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rel = F.when(yes(marked(k, p)) | yes(marked(p, k)), "related").when(yes(adj(k, p)), "hypernym").when(yes(adj(p, k)), "hyponym").otherwise(F.col("relation"))
    return pairs.withColumn("relation", rel)


def corrected(pairs: DataFrame, rules: dict[str, list]) -> DataFrame:
    """relation of each (key, phrase, relation) by the first rule that fits, else as it was.

    rules holds word lists: narrowing (markers that make a phrase narrower), linking (other
    markers), adjectives, twins (pairs of interchangeable words), soft (adjectives that change
    nothing), actions, classes (nouns that name a class) and places (positional adjectives).
    Key and phrase are compared trimmed and in lower case; the lists are short and sent along.
    """
    k, p = F.trim(F.lower("key")), F.trim(F.lower("phrase"))
    listed = lambda name: F.array(*map(F.lit, rules[name])) if rules.get(name) else F.array().cast("array<string>")
    before = lambda a, b: F.when(F.endswith(a, F.concat(F.lit(" "), b)), F.left(a, F.length(a) - F.length(b) - 1))
    fits = lambda name, x: F.coalesce(F.array_contains(listed(name), x), F.lit(False))
    down, up = before(k, p), before(p, k)
    wk, wp = F.array_distinct(F.split(k, r"\s+")), F.array_distinct(F.split(p, r"\s+"))
    only_k, only_p = F.array_except(wk, wp), F.array_except(wp, wk)
    more_k = F.when((F.size(only_k) == 1) & (F.size(only_p) == 0), F.get(only_k, F.lit(0)))
    more_p = F.when((F.size(only_p) == 1) & (F.size(only_k) == 0), F.get(only_p, F.lit(0)))
    twin = F.lit(False)
    for a, b in rules.get("twins", []):
        twin = twin | (p == F.replace(k, F.lit(a), F.lit(b))) | (p == F.replace(k, F.lit(b), F.lit(a)))
    rule = F.when(fits("narrowing", down), "hypernym").when(fits("linking", down), "related").when(fits("narrowing", up), "hyponym").when(fits("linking", up), "related")
    rule = rule.when(fits("adjectives", down), "hypernym").when(twin, "synonym").when(fits("soft", more_k) | fits("soft", more_p), "synonym")
    rule = rule.when(fits("actions", down) | fits("actions", up), "related").when(fits("classes", down), "hypernym").when(fits("classes", up), "hyponym")
    return pairs.withColumn("relation", rule.when(fits("places", more_k), "hypernym").when(fits("places", more_p), "hyponym").otherwise(F.col("relation")))


def with_reverse(edges: DataFrame, relation: str = "antonym") -> DataFrame:
    """Edges, and the turned edge of each edge of a symmetric relation; a pair that has any edge keeps its own."""
    back = edges.where(F.col("relation") == relation).select(F.col("phrase").alias("key"), F.col("key").alias("phrase"), "relation")
    return edges.unionByName(back.join(edges.select("key", "phrase"), ["key", "phrase"], "left_anti").distinct())


def without_prefix(edges: DataFrame, prefix: str) -> DataFrame:
    """Edges of which neither end starts with the prefix."""
    return edges.where(~F.startswith("key", F.lit(prefix)) & ~F.startswith("phrase", F.lit(prefix)))


def one_word_edges(terms: DataFrame) -> DataFrame:
    """key, phrase, relation of terms (noun, and arrays hypernyms, hyponyms, synonyms, related_terms), sorted by key."""
    kinds = {"hypernyms": "hypernym", "hyponyms": "hyponym", "synonyms": "synonym", "related_terms": "related"}
    edge = lambda r: lambda x: F.struct(x.alias("phrase"), F.lit(r).alias("relation"))
    one = F.flatten(F.array(*(F.transform(F.coalesce(c, F.array().cast("array<string>")), edge(r)) for c, r in kinds.items())))
    return terms.select(F.trim("noun").alias("key"), F.explode(one).alias("x")).select("key", "x.*").orderBy("key", "relation", "phrase")


def overlap_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the phrases that two models give in all, those both give, and the mean for each key."""
    j = compare_models(a, b)
    mean = lambda c: F.round(F.sum(c) / F.count_if(F.col(c) > 0), 6)
    return j.agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum("common").alias("common"), mean("n_a").alias("mean_a"), mean("n_b").alias("mean_b"))


def pair_features(pairs: DataFrame, features: DataFrame, numeric: list[str], classes: list[str], buckets: int = 1000) -> DataFrame:
    """Each pair with its phrase's features and its key's (suffix _main): numbers (0 for none), norms and cosine of the vectors v, classes by hash."""
    side = lambda f, on, end: f.select(F.col("word").alias(on), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c + end) for c in numeric), *(F.pmod(F.xxhash64(c), F.lit(buckets)).alias(c + end) for c in classes), F.col("v").alias("v" + end))
    j = pairs.join(side(features, "phrase", ""), "phrase", "left").join(side(features, "key", "_main"), "key", "left")
    norm = lambda c: F.coalesce(F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x * x)), F.lit(0.0))
    dot = F.coalesce(F.aggregate(F.zip_with("v", "v_main", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    cos = F.when((norm("v") == 0) | (norm("v_main") == 0), F.lit(0.0)).otherwise(dot / (norm("v") * norm("v_main")))
    return j.fillna(0.0, [c + e for c in numeric for e in ("", "_main")]).withColumns({"norm": norm("v"), "norm_main": norm("v_main"), "cos": cos})


def candidate_similarity(candidates: DataFrame, vectors: DataFrame, least: float = 0.5) -> DataFrame:
    """head, word, context, sim of candidates (head, item), an item being "word" or "word (context)": the cosine to the word, or the mean of those to word and context; from least up to but without 1."""
    part = lambda k: F.trim(F.regexp_extract("item", r"^([^(]*)(?:\(([^)]*)\))?", k))
    c = candidates.select("head", part(1).alias("word"), F.nullif(part(2), F.lit("")).alias("context"))
    unit = vectors.select("w", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))).alias("u"))
    for name in ("head", "word", "context"):
        c = c.join(unit.select(F.col("w").alias(name), F.col("u").alias(f"u_{name}")), name, "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sim = F.when(F.col("context").isNull(), dot("u_head", "u_word")).otherwise((dot("u_head", "u_word") + dot("u_head", "u_context")) / 2)
    return c.select("head", "word", "context", F.round(sim, 6).alias("sim")).where((F.col("sim") >= least) & (F.col("sim") < 1))


def sane_hyponyms(candidates: DataFrame, near_topic: DataFrame, most: int = 150) -> DataFrame:
    """Candidates (key, word) of keys with fewer than `most` of them, if the word is near some topic (word)."""
    few = candidates.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") < most).select("key")
    return candidates.join(few, "key", "left_semi").join(near_topic.select("word").distinct(), "word", "left_semi")


def previous(turns: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """The row before within by."""
    return turns.withColumn("previous", F.lag(text).over(Window.partitionBy(by).orderBy(order)))


def complete_mutual(edges: DataFrame) -> DataFrame:
    """Edges, and the turned ones whose key is a key that lacks them; other columns are carried over."""
    rest = [c for c in edges.columns if c not in ("key", "phrase")]
    back = edges.select(F.col("phrase").alias("key"), F.col("key").alias("phrase"), *rest)
    missing = back.join(edges.select("key").distinct(), "key", "left_semi").join(edges.select("key", "phrase"), ["key", "phrase"], "left_anti")
    return edges.unionByName(missing)


def lookup_either_way(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """relation of each pair, from the pair or else from the turned one (then marked)."""
    back = known.select(F.col("phrase").alias("key"), F.col("key").alias("phrase"), F.concat("relation", F.lit(" (reversed)")).alias("back"))
    return pairs.join(known.select("key", "phrase", "relation"), ["key", "phrase"], "left").join(back, ["key", "phrase"], "left").select("key", "phrase", F.coalesce("relation", "back").alias("relation"))


def override(base: DataFrame, new: DataFrame, on: str, column: str) -> DataFrame:
    """base with the column's values of new where it has any."""
    n = new.select(on, F.col(column).alias("_new"))
    return base.join(n, on, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, the number of phrases that each of two models gives for it, and of those that both give."""
    x = a.select("key", "phrase").distinct().withColumn("in_a", F.lit(1))
    y = b.select("key", "phrase").distinct().withColumn("in_b", F.lit(1))
    j = x.join(y, ["key", "phrase"], "full_outer")
    return j.groupBy("key").agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("common"))


def best_by_phrase(candidates: DataFrame) -> DataFrame:
    """The record of highest similarity for each (key, phrase), the first source of equal ones."""
    best = F.min_by(F.struct("sim", "source"), F.struct(-F.col("sim"), "source"))
    return candidates.groupBy("key", "phrase").agg(best.alias("x")).select("key", "phrase", F.round("x.sim", 5).alias("sim"), "x.source")


def nli_decisions(scores: DataFrame, entailed: float = 0.8, margin: float = 0.01) -> DataFrame:
    """hyper, hypo, mean scores over the templates and the verdict: entailed, by a margin over contradiction, and not less than neutral."""
    m = scores.groupBy("hyper", "hypo").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("ent", "contr", "neutral")))
    return m.withColumn("is_hyper", (F.col("ent") >= entailed) & (F.round(F.col("ent") - F.col("contr"), 6) >= margin) & (F.col("neutral") <= F.col("ent")))


def strong_entries(edges: DataFrame, least: float = 0.4) -> DataFrame:
    """Edges of keys that are, or have a candidate that is, marked by hand or probable enough."""
    good = (F.col("manual") != 0) | (F.col("prob") >= least)
    return edges.join(edges.where(good).select("key").distinct(), "key", "left_semi")


def head_nouns(found: DataFrame) -> DataFrame:
    """head, relation, word with the mean similarity, contexts and terms of what was found (head, relation, word, sim, context, term)."""
    joined = lambda c, by: F.array_join(F.array_sort(F.collect_set(c)), by)
    return found.groupBy("head", "relation", "word").agg(F.round(F.avg("sim"), 6).alias("sim"), joined("context", "; ").alias("contexts"), joined("term", ",").alias("terms"))


def paraphrases(candidates: DataFrame) -> DataFrame:
    """Without pairs of two nouns and of adjective and noun where the adjective starts like the first noun (key, phrase, key_tags, phrase_tags)."""
    same = F.startswith(F.col("phrase"), F.left(F.element_at(F.split("key", " "), 1), F.lit(5)))
    return candidates.where(~((F.col("key_tags") == "NOUN NOUN") & (F.col("phrase_tags") == "ADJ NOUN") & same))


def consistent_predictions(scores: DataFrame, cut: float = 0.5) -> DataFrame:
    """key, phrase, relation, confidence from a probability a flag, one row for each ordered pair.

    Synonyms are neither hypernym nor hyponym, and a pair is a hyponym (hypernym) if the
    turned pair is a hypernym (hyponym) and it is no hypernym (hyponym) itself; the first
    flag in resolve_flags()'s order then names the pair. Confidence is the mean distance
    of the probabilities from one half.
    """
    yes = scores.select("key", "phrase", *((F.col(f) > cut).alias(f) for f in FLAGS), F.round(sum(F.abs(F.col(f) - 0.5) for f in FLAGS) / len(FLAGS), 6).alias("confidence"))
    back = yes.select(F.col("phrase").alias("key"), F.col("key").alias("phrase"), F.col("is_hypernym").alias("b_hyper"), F.col("is_hyponym").alias("b_hypo"))
    j = yes.join(back, ["key", "phrase"], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    hyper = F.col("is_hypernym") | (no("b_hypo") & ~F.col("is_hyponym"))
    hypo = F.col("is_hyponym") | (no("b_hyper") & ~F.col("is_hypernym"))
    j = j.select("key", "phrase", "is_synonym", "is_usage_variant", "is_related", (hyper & ~F.col("is_synonym")).alias("is_hypernym"), (hypo & ~F.col("is_synonym")).alias("is_hyponym"), "confidence")
    return resolve_flags(j).join(j.select("key", "phrase", "confidence"), ["key", "phrase"])
