"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Words are runs of characters other than space and tab to carriage return.  Each
rule is a condition on the text that rejects it.  ``order_rules`` takes a sample, bounded
in rows and bytes, times each rule on it (the second of two runs, less the time of the
words alone) and notes what each rejects.  The next rule of the cascade is always the one
with the most rejections per second among the rows that the rules before it let pass.
``rejected`` nests the rules in that order in one CASE, so a row pays for later rules
only if the earlier ones let it pass.  The order changes what is computed, never the
verdict.

Null text counts as empty: no words, so the first base rule rejects it.  Rows stay
rows: ties, repeated ids and extra columns change nothing.
"""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import SPACE

#: Rows and characters of the sample on which the order of the rules is estimated.
SAMPLE_ROWS, SAMPLE_BYTES = 500, 8_000_000
#: Low bits of a packed window key that hold its position.
POSITION_BITS = 24
POSITION = (1 << POSITION_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; a lambda would work out any other expression again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+", -1))


def word_chars(word: Column) -> Column:
    return F.length(F.concat_ws("", word)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def covered(at: Column) -> Column:
    """Words inside three-word windows that start at the sorted positions."""
    steps = let(at, lambda v: F.transform(v, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(v, k + 1) - p, F.lit(3))).cast("long")))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def near(xs: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Elements of a sorted array that are the same as a neighbour."""
    no = F.lit(False)
    return let(xs, lambda v: F.filter(v, lambda x, k: F.coalesce(same(x, F.get(v, k - 1)), no) | F.coalesce(same(x, F.get(v, k + 1)), no)))


def n_repeat_words(word: Column) -> Column:
    """Words in three-word windows that stand twice or more in the text, the first included.

    Each window becomes one long, 40 bits of hash above 24 bits of position; sorted,
    equal windows are neighbours.  Neighbours are then compared word by word.  Where two
    different windows share a hash, or a text is too long for the position bits, the
    windows themselves are sorted instead.
    """
    n = F.size(word)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    packed = F.sort_array(F.transform(at, lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)).bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long"))))
    alike = near(packed, lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), POSITION_BITS) == 0)

    def from_alike(found: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(POSITION)).cast("int")
        same = lambda x, y: (F.shiftrightunsigned(x.bitwiseXOR(y), POSITION_BITS) == 0) & (F.get(word, place(x)) == F.get(word, place(y))) & (F.get(word, place(x) + 1) == F.get(word, place(y) + 1)) & (F.get(word, place(x) + 2) == F.get(word, place(y) + 2))
        clash = lambda x, y: (F.shiftrightunsigned(x.bitwiseXOR(y), POSITION_BITS) == 0) & ~same(x, y)
        spelled = F.array_sort(F.transform(at, lambda i: F.struct(F.get(word, i).alias("a"), F.get(word, i + 1).alias("b"), F.get(word, i + 2).alias("c"), i.alias("i"))))
        exact = F.transform(near(spelled, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])), lambda x: x["i"])
        quick = F.transform(near(found, same), place)
        return F.when((n > POSITION) | (F.size(near(found, clash)) > 0), covered(F.sort_array(exact))).when(F.size(found) == 0, F.lit(0).cast("long")).otherwise(covered(F.sort_array(quick)))

    return let(alike, from_alike)


Measure = Callable[[Column, Column], Column]

#: What the rules compare, by name: functions of (text, words).
MEASURES: dict[str, Measure] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: word_chars(w),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
}
#: name -> condition on (text, words, measures) that rejects; measures gives a Column for a name.  The first two are the base rules.
RULES: dict[str, Callable[[Column, Column, Callable[[str], Column]], Column]] = {
    "few_words": lambda t, w, m: m("n_words") < 50,
    "repeated_words": lambda t, w, m: 100 * m("n_repeat_words") > 50 * m("n_words"),
    "symbols": lambda t, w, m: 10 * m("n_symbols") > m("n_words"),
    "repeated_lines": lambda t, w, m: let(m("n_dup_lines"), lambda d: (d >= 4) & (100 * d > 30 * F.size(F.split(F.coalesce(t, F.lit("")), "\n", -1)))),
    "capitals": lambda t, w, m: 100 * F.regexp_count(F.coalesce(t, F.lit("")), F.lit(r"\p{Lu}{2,}")) > 30 * m("n_words"),
    "word_length": lambda t, w, m: let(m("word_chars"), lambda c: ~c.between(m("n_words") * 2, m("n_words") * 15)),
}
BASE = ("few_words", "repeated_words")


def fresh(t: Column, w: Column) -> Callable[[str], Column]:
    """Measures worked out where they are asked for."""
    return lambda name: MEASURES[name](t, w)


def sample_of(df: DataFrame, text_col: str, rows: int) -> DataFrame:
    """Some rows' texts as column t: at most so many, SAMPLE_BYTES in all unless the first alone is longer."""
    spark = df.sparkSession
    texts = df.select(F.col(text_col).cast("string").alias("t"))
    # Taken in the JVM, a few partitions at a time until there are enough: a limit inside a plan would start every partition.
    total = n = 0
    for r in texts.select(F.coalesce(F.octet_length("t"), F.lit(0)).alias("n"))._jdf.takeAsList(rows):
        total += r.getInt(0)
        if n and total > SAMPLE_BYTES:
            break
        n += 1
    return DataFrame(spark._jsparkSession.createDataFrame(texts._jdf.takeAsList(n), texts._jdf.schema()), spark)


def cascade(verdicts: list[tuple], seconds: dict[str, float]) -> list[tuple[str, float, float]]:
    """(name, seconds, share rejected of the rows that reach it), most rejections per second first; verdicts in the order of seconds."""
    left, names, out = list(verdicts), list(seconds), []
    while len(out) < len(names):
        open_ = [k for k, x in enumerate(names) if x not in {o[0] for o in out}]
        share = {k: sum(bool(v[k]) for v in left) / max(1, len(left)) for k in open_}
        k = max(open_, key=lambda k: (share[k] / max(seconds[names[k]], 1e-6), -seconds[names[k]], -k))
        out.append((names[k], seconds[names[k]], share[k]))
        left = [v for v in left if not v[k]]
    return out


def order_rules(df: DataFrame, text_col: str = "text", names: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(name, seconds, share rejected) of each rule in the order of the cascade; only the order rests on the sample."""
    sample = sample_of(df, text_col, sample_rows)
    names = names or list(RULES)
    t = F.col("t")

    def took(condition: Callable[[Column], Column]) -> float:
        plan = sample.agg(F.count_if(let(words(t), condition)))
        plan.first()
        began = time.perf_counter()
        plan.first()
        return time.perf_counter() - began

    alone = took(lambda w: F.size(w) < 0)
    rule = lambda name: lambda w: RULES[name](t, w, fresh(t, w))
    seconds = {name: max(took(rule(name)) - alone, 1e-4) for name in names}
    verdict = let(words(t), lambda w: F.struct(*(F.coalesce(rule(name)(w), F.lit(False)).alias(name) for name in names)))
    return cascade([tuple(r) for r in sample.select(verdict.alias("v")).select("v.*").collect()], seconds)


def rejected(text: Column, word: Column, names: list[str], measures: Callable[[str], Column] | None = None) -> Column:
    """True where a rule of names rejects; the rules are tried in that order, up to the first that does."""
    out = F.lit(False)
    for name in reversed(names):
        out = F.when(F.coalesce(RULES[name](text, word, measures or fresh(text, word)), F.lit(False)), F.lit(True)).otherwise(out)
    return out


def quality_filter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, columns unchanged."""
    names = [x[0] for x in order_rules(df, text_col)]
    text = F.col(text_col).cast("string")
    return df.where(~let(words(text), lambda w: rejected(text, w, names)))


def quality_metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base measures, base_failed and kept for each row; the rules read the measures that are given anyway."""
    rest = [x[0] for x in order_rules(df, text_col, [x for x in RULES if x not in BASE])]
    t = F.col(text_col).cast("string")

    def verdicts(w: Column, m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(*(m[name].alias(name) for name in MEASURES), failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(~rejected(t, w, rest, lambda name: m[name])).alias("kept"))

    measured = let(words(t), lambda w: let(F.struct(*(of(t, w).alias(name) for name, of in MEASURES.items())), lambda m: verdicts(w, m)))
    return df.select(F.col(id_col).alias("doc_id"), measured.alias("m")).select("doc_id", "m.*")
