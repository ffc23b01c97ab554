"""Grammar patterns over tagged tokens: a small language, and matching by windows and joins.

A pattern is `name: "..."` with a body of components: `w:<role> POS [Feature=Value, ...]
| rec | exlex:"lemma"` for a word, `m:<role> "name"` for a pattern defined earlier; roles
are h (head), d (dependent) and i (independent).  Simple patterns hold words only.

Tokens are rows (doc_id, sent_no, pos, form, lemma, readings), readings an array of
(pos, feats map); a condition holds if every reading meets it.  A repeated component
matches every run length from one up.
"""

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from termloom.operators import matching

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the repository

#: Features that a condition compares; gender can be written but is not compared.
COMPARED = ("Case", "Animacy", "Number", "Tense", "Degree", "VerbForm", "Mood", "Person", "Variant", "Voice", "Aspect")


@dataclass(frozen=True)
class Word:
    role: str
    pos: str
    feats: tuple[tuple[str, str], ...] = ()
    rec: bool = False
    lemma: str | None = None

    def holds(self, t: str = "") -> Column:
        readings = F.col(f"{t}readings")
        out = (F.size(readings) > 0) & F.forall(readings, lambda r: self._reading(r["pos"], lambda k: r["feats"][k]))
        return out & (F.col(f"{t}lemma") == self.lemma) if self.lemma else out

    def holds_one(self) -> Column:
        """holds() of tokens with one reading each, in the columns tag and gram (its case)."""
        out = self._reading(F.col("tag"), lambda k: F.col("gram") if k == "Case" else F.lit(None))
        return out & (F.col("lemma") == self.lemma) if self.lemma else out

    def _reading(self, pos: Column, feat: Callable[[str], Column]) -> Column:
        out = pos == self.pos
        for k, v in self.feats:
            if k in COMPARED:
                out = out & F.coalesce(feat(k) == v, F.lit(False))
        return out

    @property
    def key(self) -> tuple:
        """What a token has to meet."""
        return self.pos, self.feats, self.lemma


@dataclass(frozen=True)
class Inner:
    role: str
    name: str


@dataclass(frozen=True)
class Pattern:
    name: str
    parts: tuple = field(default=())

    @property
    def simple(self) -> bool:
        return all(isinstance(p, Word) for p in self.parts)

    @property
    def head(self) -> int:
        return next((i for i, p in enumerate(self.parts) if p.role == "h"), 0)


def parse(text: str) -> list[Pattern]:
    """The patterns of a pattern file; an inner pattern has to be defined before it is used."""
    out: dict[str, Pattern] = {}
    for m in re.finditer(r"name\s*:\s*\"([^\"]*)\"\s*body\s*:\s*\{(.*?)\}", text, re.DOTALL):
        parts = []
        for line in filter(None, map(str.strip, m[2].splitlines())):
            if w := re.match(r"w\s*:\s*([hdi])\s+(\w+)\s*(?:\[([^\]]*)\])?(.*)", line):
                feats = tuple(tuple(x.strip().split("=", 1)) for x in (w[3] or "").split(",") if "=" in x)
                lemma = re.search(r"exlex\s*:\s*\"([^\"]*)\"", w[4])
                parts.append(Word(w[1], w[2], feats, bool(re.search(r"\brec\b", w[4])), lemma and lemma[1]))
            elif i := re.match(r"m\s*:\s*([hdi])\s+\"([^\"]*)\"", line):
                if i[2] not in out:
                    raise ValueError(f"pattern {m[1]!r} uses {i[2]!r}, which is not defined before it")
                parts.append(Inner(i[1], i[2]))
            else:
                raise ValueError(f"pattern {m[1]!r}: can't read {line!r}")
        out[m[1]] = Pattern(m[1], tuple(parts))
    return list(out.values())


def usable(tokens: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """tokens with ok: neither form nor lemma is a stop word, and it is no one-letter word taken for a content word."""
    one = (F.length("form") == 1) & (F.size("readings") == 1) & F.get(F.col("readings"), F.lit(0))["pos"].isin("ADJ", "NOUN", "PROPN", "VERB")
    if stop is None:
        return tokens.withColumn("ok", ~one)
    s = stop.select(F.col("w").alias("stop_w")).distinct()
    by_form = tokens.join(s, F.lower("form") == F.col("stop_w"), "left").withColumn("s1", F.col("stop_w").isNotNull()).drop("stop_w")
    return by_form.join(s, F.col("lemma") == F.col("stop_w"), "left").withColumn("ok", ~one & ~F.col("s1") & F.col("stop_w").isNull()).drop("stop_w", "s1")


SENTENCE = ("doc_id", "sent_no")


def runs(tokens: DataFrame, cond: Column, left: bool) -> Column:
    """How many tokens in a row meet cond, ending right before (left) or starting right after the token."""
    w = Window.partitionBy(*SENTENCE).orderBy("pos")
    if left:
        stop = F.max(F.when(~cond, F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        first = F.min("pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.col("pos") - 1 - F.coalesce(stop, first - 1), F.lit(0))
    stop = F.min(F.when(~cond, F.col("pos"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    last = F.max("pos").over(w.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(F.coalesce(stop, last + 1) - 1 - F.col("pos"), F.lit(0))


def bounded(n: Column, max_run: int | None) -> Column:
    return n if max_run is None else F.least(n, F.lit(max_run))


def simple_spans(tokens: DataFrame, patterns: list[Pattern], max_run: int | None = None) -> DataFrame:
    """doc_id, sent_no, start, end, model of all matches of simple patterns; tokens from usable().

    A run of n repeated components gives n spans for each head, up to its square in all;
    max_run is the longest repetition that is still a phrase, None for any.

    Runs and neighbours of all patterns come from windows over one partitioning by sentence.
    """
    w = Window.partitionBy(*SENTENCE).orderBy("pos")
    spans = []
    for p in (p for p in patterns if p.simple):
        h = p.head
        ok = F.col("ok") & p.parts[h].holds()
        low, high = F.lit(0), F.lit(0)
        for k, part in enumerate(p.parts):
            if k == h:
                continue
            c = F.col("ok") & part.holds()
            if part.rec and k in (0, len(p.parts) - 1):
                n = bounded(runs(tokens, c, k < h), max_run)
                if k < h:
                    low = n + (h - 1 - k)
                    ok = ok & (n > 0)
                else:
                    high = n + (k - 1 - h)
                    ok = ok & (n > 0)
            else:
                ok = ok & F.coalesce(F.lag(c, h - k).over(w) if k < h else F.lead(c, k - h).over(w), F.lit(False))
                low, high = (F.lit(h), high) if k < h else (low, F.lit(len(p.parts) - 1 - h))
        first_rec = p.parts[0].rec and h > 0
        last_rec = p.parts[-1].rec and h < len(p.parts) - 1
        lows = F.sequence(F.lit(h), low) if first_rec else F.array(F.lit(h))
        highs = F.sequence(F.lit(len(p.parts) - 1 - h), high) if last_rec else F.array(F.lit(len(p.parts) - 1 - h))
        spans.append(F.when(ok, each_span(lows, highs, p.name)))
    none = F.array().cast("array<struct<start:int,end:int,model:string>>")
    every = F.concat(*(F.coalesce(s, none) for s in spans)) if spans else none
    return tokens.select(*SENTENCE, every.alias("spans")).select(*SENTENCE, F.explode("spans").alias("s")).select(*SENTENCE, "s.*")


def each_span(lows: Column, highs: Column, name: str) -> Column:
    """A span for each number of tokens before and behind the head."""
    return F.flatten(F.transform(lows, lambda a: F.transform(highs, lambda b: F.struct((F.col("pos") - a).cast("int").alias("start"), (F.col("pos") + b).cast("int").alias("end"), F.lit(name).alias("model")))))


def complex_spans(tokens: DataFrame, simple: DataFrame, patterns: list[Pattern], max_run: int | None = None) -> DataFrame:
    """Spans of patterns with inner ones: a span of the first inner model is extended by neighbouring words and spans.

    Every step is a join on equality of (sentence, position).  A word on the far left can't
    be the sentence's first token.
    """
    word = tokens.where("ok").select(*SENTENCE, F.col("pos").alias("at"), "lemma", "readings")
    out = None
    for p in (p for p in patterns if not p.simple):
        a = next(i for i, x in enumerate(p.parts) if isinstance(x, Inner))
        cur = simple.where(F.col("model") == p.parts[a].name).select(*SENTENCE, "start", "end")
        for k in range(a - 1, -1, -1):
            t = word.where(p.parts[k].holds()).select(*SENTENCE, (F.col("at") + 1).alias("start"))
            if k == 0:
                t = t.where("start > 1")
            cur = cur.join(t, [*SENTENCE, "start"], "left_semi").withColumn("start", F.col("start") - 1)
        for k in range(a + 1, len(p.parts)):
            x = p.parts[k]
            if isinstance(x, Inner):
                nxt = simple.where(F.col("model") == x.name).select(*SENTENCE, (F.col("start") - 1).alias("end"), F.col("end").alias("to"))
                cur = cur.join(nxt, [*SENTENCE, "end"]).select(*SENTENCE, "start", F.col("to").alias("end"))
            else:
                run = tokens.select(*SENTENCE, F.col("pos").alias("end"), bounded(runs(tokens, F.col("ok") & x.holds(), False), max_run).alias("n")).where("n > 0")
                many = F.sequence(F.lit(1), F.col("n")) if x.rec and k == len(p.parts) - 1 else F.array(F.lit(1))
                cur = cur.join(run, [*SENTENCE, "end"]).withColumn("k", F.explode(many)).withColumn("end", F.col("end") + F.col("k")).drop("n", "k")
        cur = cur.select(*SENTENCE, "start", "end", F.lit(p.name).alias("model"))
        out = cur if out is None else out.unionAll(cur)
    return simple.limit(0) if out is None else out.distinct()


def longest(spans: DataFrame) -> DataFrame:
    """Of the spans that start together, the longest; equal ones rule each other out."""
    w = Window.partitionBy(*SENTENCE, "start")
    top = F.max("end").over(w)
    kept = spans.withColumn("top", top).withColumn("n", F.sum((F.col("end") == F.col("top")).cast("int")).over(w))
    return kept.where((F.col("end") == F.col("top")) & (F.col("n") == 1)).drop("top", "n")


def occurrences(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """key (lemmas), text_form, model, doc_id, sent_no, start, end of each span, cut out of its sentence's tokens.

    Sorted and merged with the spans in front, as a long sentence has many: were they
    broadcast, its tokens would be copied and held once for each of them.
    """
    words = F.array_sort(F.collect_list(F.struct("pos", "lemma", "form")))
    s = tokens.groupBy(*SENTENCE).agg(words.alias("ws")).select(*SENTENCE, F.col("ws.lemma").alias("lemmas"), F.col("ws.form").alias("forms"))
    own = lambda c: F.array_join(F.slice(c, F.col("start") + 1, F.col("end") - F.col("start") + 1), " ")
    return spans.hint("merge").join(s, [*SENTENCE]).select(own("lemmas").alias("key"), own("forms").alias("text_form"), "model", *SENTENCE, "start", "end")


def collect_phrases(tokens: DataFrame, patterns: list[Pattern], stop: DataFrame | None = None, validate: bool = True, max_run: int | None = None) -> DataFrame:
    """All occurrences, of simple and of complex patterns."""
    return keyed(tokens, patterns, stop, validate, max_run)


#: Content words; one of a single letter is none.
CONTENT = ("ADJ", "NOUN", "PROPN", "VERB")


def marked(tokens: DataFrame, patterns: list[Pattern], stop: DataFrame | None, columns: list[Column]) -> tuple[DataFrame, dict]:
    """pos, columns and, in _bits0 and so on, which words of the patterns a token meets; sentences stay or come together, in order. The bit of each word.

    Tokens with the columns tag and gram (tagging.tag_plain) have one reading and come in the
    order of their sentences, so nothing is moved; others are dealt by sentence and sorted.
    """
    words = list({w.key: w for p in patterns for w in p.parts if isinstance(w, Word)}.values())
    plain = "tag" in tokens.columns
    if plain and stop is None:
        ok = ~((F.length("form") == 1) & F.col("tag").isin(*CONTENT))
        t, met = tokens, [F.coalesce(ok & w.holds_one(), F.lit(False)) for w in words]
    else:
        t = usable(tokens, stop)
        met = [F.coalesce(F.col("ok") & (w.holds_one() if plain else w.holds()), F.lit(False)) for w in words]
    numbers = []
    for i in range(0, len(words), matching.WIDE):
        n = F.lit(0).cast("long")
        for k, m in enumerate(met[i : i + matching.WIDE]):
            n = n + F.when(m, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        numbers.append(n.alias(f"_bits{i // matching.WIDE}"))
    if not (plain and stop is None):
        t = t.repartition(*SENTENCE).sortWithinPartitions(*SENTENCE, "pos")
    return t.select("pos", *columns, *numbers), {w.key: i for i, w in enumerate(words)}


def matched(tokens: DataFrame, patterns: list[Pattern], give: str, schema: StructType, columns: list[Column], texts: tuple[str, ...] = (), stop: DataFrame | None = None, validate: bool = True, max_run: int | None = None, simple: bool = True, wide: bool = True) -> DataFrame:
    """What a method of matching.Found gives of all spans, of simple patterns, complex ones or both."""
    t, bits = marked(tokens, patterns, stop, [*columns, *map(F.col, texts)])
    return t.mapInArrow(matching.runner(patterns, bits, max_run, simple, wide, validate, texts, give), schema)


def place(tokens: DataFrame) -> StructType:
    """The columns of a span; m is the model's rank by name."""
    out = StructType()
    for name in SENTENCE:
        out = out.add(name, tokens.schema[name].dataType)
    return out.add("start", IntegerType()).add("end", IntegerType()).add("m", IntegerType())


def model(patterns: list[Pattern], rank: Column) -> Column:
    """A model's name from its rank by name."""
    return F.element_at(F.array(*(F.lit(n) for n in sorted(p.name for p in patterns))), rank + 1)


def spans(tokens: DataFrame, patterns: list[Pattern], simple: bool = True, wide: bool = True, stop: DataFrame | None = None, validate: bool = True, max_run: int | None = None) -> DataFrame:
    """doc_id, sent_no, start, end, model of simple patterns, complex ones or both; complex spans have a document."""
    if wide:
        tokens = tokens.where("doc_id is not null")
    out = matched(tokens, patterns, "spans", place(tokens), list(map(F.col, SENTENCE)), (), stop, validate, max_run, simple, wide)
    return out.select(*SENTENCE, "start", "end", model(patterns, F.col("m")).alias("model"))


def keyed(tokens: DataFrame, patterns: list[Pattern], stop: DataFrame | None = None, validate: bool = True, max_run: int | None = None, repeats: bool = True) -> DataFrame:
    """key (lemmas), text_form, model, doc_id, sent_no, start, end of each span, without those whose key is that of the sentence's span before if no repeats are asked for."""
    tokens = tokens.where("doc_id is not null")
    same = "tag" in tokens.columns  # tagged by suffix: a lemma is the form
    schema = place(tokens).add("key", StringType())
    out = matched(tokens, patterns, "keyed" if repeats else "fresh", schema if same else schema.add("text_form", StringType()), list(map(F.col, SENTENCE)), ("lemma",) if same else ("lemma", "form"), stop, validate, max_run)
    return out.select("key", (F.col("key") if same else F.col("text_form")).alias("text_form"), model(patterns, F.col("m")).alias("model"), *SENTENCE, "start", "end")


def counted(tokens: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """key, doc_id, n, model: how often a key occurs in a document and the model of its first span there.

    Numbers stand for the place and the model of a span, so rows are summed by hashing, not sorting.
    """
    tokens = tokens.where("doc_id is not null")
    schema = StructType().add("key", StringType()).add("doc_id", tokens.schema["doc_id"].dataType).add("n", LongType()).add("no", LongType())
    rows = matched(tokens, patterns, "counts", schema, [F.col("doc_id")], ("lemma",))
    # Dealt by key once: both sums, by document and by key, are taken where the rows then are.
    by_doc = rows.repartition("key").groupBy("key", "doc_id").agg(F.sum("n").alias("n"), F.min("no").alias("no"))
    return by_doc.select("key", "doc_id", "n", (F.col("no") % len(patterns)).cast("int").alias("m"))


def in_contexts(tokens: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """key, sha, head: the distinct sentences of each key, from tokens with sha and head at a sentence's first."""
    schema = StructType().add("key", StringType()).add("sha", BinaryType()).add("head", LongType())
    return matched(tokens.where("doc_id is not null"), patterns, "contexts", schema, [F.col("sha"), F.col("head")], ("lemma",)).distinct()


def placed(tokens: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """key and places, an array of (start, end, doc_id, sent_no): the spans of a key that are near each other have a row, without a text of their own."""
    tokens = tokens.where("doc_id is not null")
    at = place(tokens)
    places = StructType([at[c] for c in ("start", "end", "doc_id", "sent_no")])
    return matched(tokens, patterns, "grouped", StructType().add("key", StringType()).add("places", ArrayType(places)), list(map(F.col, SENTENCE)), ("lemma",))
