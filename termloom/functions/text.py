"""String functions of the term pipeline as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that corpora of prose don't hold: digits, Han, Devanagari, Arabic, symbols and pictographs.
UNWANTED = r"[\p{Nd}\p{IsHan}\p{IsDevanagari}\p{IsArabic}\p{Sm}\p{So}]"


def tokens(text: Column) -> Column:
    """Runs of letters in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def sentences(text: Column) -> Column:
    """The text cut behind . ! ? ; : and white space."""
    return F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;:])\s+", -1)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unwanted(text: Column) -> Column:
    return text.rlike(UNWANTED)


def should_filter_out(text: Column) -> Column:
    """Markup characters, no letter, a long run of ASCII without spaces, or unwanted characters."""
    return text.rlike(r"[%*_#$]") | ~text.rlike(r"\p{L}") | ((F.octet_length(text) > 25) & text.rlike(r"^[a-zA-Z0-9!-/:-@\[-`{-~]*$")) | unwanted(text)


def misclassified(token: Column) -> Column:
    """Nothing but digits and ASCII punctuation."""
    return token.rlike(r"^[0-9!-/:-@\[-`{-~]*$")


def leading_bits(text: Column) -> Column:
    """The leading 48 bits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def roman(key: Column) -> Column:
    """A word of the key is a roman numeral (without m)."""
    return key.rlike(r"(?i)(?:^|\s)[ivxlcd]+(?:\s|$)")


def strip_urls(line: Column) -> Column:
    """Null for a line that is a URL; other URLs at the start or the end become `link`."""
    only = line.rlike(r"^\s*https?://\S+\s*$")
    starts = line.rlike(r"^https?://")
    return F.when(only, F.lit(None)).when(starts, F.regexp_replace(line, r"https?://\S+", "link")).otherwise(F.regexp_replace(line, r"https?://\S+$", "link"))


def clean_punctuation(line: Column) -> Column:
    """One of repeated marks, no space before a mark, the last of different marks in a row."""
    out = line
    for pattern, to in ((r"\.{2,}", "."), (r",{2,}", ","), (r"!{2,}", "!"), (r"\?{2,}", "?"), (r"\s+([.,;:!?])", "$1"), (r"[,;:]+([.!?])", "$1"), (r"([.!?])[.,;:]+", "$1"), (r"\s{2,}", " ")):
        out = F.regexp_replace(out, pattern, to)
    return out


def terminal_period(line: Column) -> Column:
    return F.when(line.rlike(r"[.!?:;]$"), line).otherwise(F.concat(line, F.lit(".")))


def slugify(text: Column) -> Column:
    """Lower case, letters and digits joined by hyphens; `phrase` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", ""), r"[\s_-]+", "-")
    s = F.btrim(s, F.lit("-"))
    return F.when(s == "", F.lit("phrase")).otherwise(s)


def cut_stem(word: Column) -> Column:
    """The word without its last two characters, if it has more."""
    return F.when(F.length(word) > 2, F.left(word, F.length(word) - 2)).otherwise(word)


def suffix_strip(word: Column) -> Column:
    return F.regexp_replace(word, r"(а|и|ов|s|es)$", "")


def byte_stem(word: Column, ending: int) -> Column:
    """The word's UTF-8 bytes without the last `ending`."""
    return F.substring(F.encode(word, "UTF-8"), F.lit(1), F.greatest(F.octet_length(word) - ending, F.lit(0)))


def keys_similar(a: Column, b: Column) -> Column:
    """Keys of the same number of words that differ in inflection alone.

    Words of up to eight bytes have to be equal; longer ones may differ behind a stem,
    in up to three words by two bytes of ending, or in the first word alone by four.
    """

    def call(most: int, ending: int, first_only: bool) -> Column:
        pairs = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

        def alike(p: Column) -> Column:
            x, y = p["x"], p["y"]
            n = F.least(F.octet_length(x), F.octet_length(y)) - ending
            head = lambda w: F.substring(F.encode(w, "UTF-8"), F.lit(1), n)
            long_ = (F.octet_length(x) > 8) & (F.octet_length(y) > 8)
            return (x == y) | (long_ & (F.abs(F.octet_length(x) - F.octet_length(y)) < most) & (head(x) == head(y)))

        differ = F.size(F.filter(pairs, lambda p: p["x"] != p["y"]))
        rest = F.size(F.filter(F.slice(pairs, 2, 1000), lambda p: p["x"] != p["y"])) if first_only else F.lit(0)
        return F.forall(pairs, alike) & (differ <= most) & (rest == 0)

    same = F.size(F.split(a, " ")) == F.size(F.split(b, " "))
    return F.coalesce(same & (call(3, 2, False) | call(2, 4, True)), F.lit(False))


def before_mark(text: Column) -> Column:
    """No white space before the final mark."""
    return F.regexp_replace(text, r"\s+([.,;:!?])$", "$1")


def starts_latin(text: Column) -> Column:
    """The first word starts with a Latin letter."""
    return F.trim(text).rlike(r"^[A-Za-z]")


def without_containing(items: Column, parts: list[str]) -> Column:
    """The items of an array that hold none of the parts."""
    return F.filter(items, lambda x: ~F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(x, p)))


def word_context(entry: Column) -> Column:
    """`word (context, more)` as word and the context's first part, null without one."""
    inside = F.regexp_extract(entry, r"^\s*[^(]*\(([^,)]*)", 1)
    return F.struct(F.trim(F.regexp_extract(entry, r"^([^(]*)", 1)).alias("word"), F.when(inside != "", F.trim(inside)).alias("context"))


def wiki_examples(text: Column) -> Column:
    """The examples of a wiki page's `{{пример|...}}` templates: first field, markup and stress marks taken out."""
    found = F.regexp_extract_all(text, F.lit(r"\{\{(?:пример|example)\|([^|}]*)"), F.lit(1))
    plain = F.transform(found, lambda x: F.trim(F.translate(F.regexp_replace(F.regexp_replace(x, r"&[a-z]+;", " "), "́", ""), "{}[]'", "")))
    return F.filter(plain, lambda x: x != "")


def between_bars(line: Column) -> Column:
    """What stands behind the first || up to the next."""
    p = F.split(line, r"\|\|", -1)
    return F.trim(F.coalesce(F.get(p, F.lit(1)), F.get(p, F.lit(0))))


def preposition(line: Column, words: list[str]) -> Column:
    """The first word of the list that stands between spaces in the line, else `others`."""
    return F.coalesce(*(F.when(F.contains(line, F.lit(f" {w} ")), F.lit(w)) for w in words), F.lit("others"))


def common_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.split(a, " "), F.split(b, " ")))


def hypotheses(hyper: Column, hypo: Column, templates: list[str]) -> Column:
    """Each template filled in; %1$s is the hyponym, %2$s the hypernym."""
    return F.array(*(F.format_string(t, hypo, hyper) for t in templates))
