"""Secret scan by assignment-aware lexing.

Three base patterns find secrets by their shape.  Beside them a lexer reads source and
configuration syntax into name-literal pairs: assignments and keys (``=``, ``:``,
``:=``, ``=>``, ``+=``), quoted, triple-quoted, raw and YAML block values, keys by braces
or by indentation, arguments by keyword or behind a named string, setters, XML elements,
and a name and a value side by side (``name: X``, ``value: Y``).

A name is bound to the literals and names of its value; a name stands for its last
binding before, or its first one after.  Weights run along these references to a
fixpoint, so a literal has the weight of the most sensitive name that it reaches; a
name's weight sums its distinct sensitive words.  Literals that are joined (``+``, side
by side, or inside a formatted string) are scored as one value.  A literal with a high
score that no base span holds becomes a span of kind ``lexed``; of a URL only the password
counts, and paths don't.

Every character is read a bounded number of times, whatever the input.  Null and empty
texts have no spans.  Spans count code points, end exclusive.  Every row gives one row,
repeated ids included; other columns are not read.
"""

import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import as_texts, small_batches

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: One of these stands in every text that ASSIGN matches.
STEMS = ("passw", "secret", "token", "apikey", "api_key")

NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
STRING = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*+){q}") for q in "\"'"} | {"`": re.compile(r"`([^`\n]*+)`")}
TOKEN = re.compile(rf"(?P<ref>\$\{{{NAME}\}}|\$[A-Za-z_]\w*+|\{{\{{ ?{NAME} ?\}}\}}|%\({NAME}\)s)|(?P<name>{NAME})|(?P<op>:=|=>|[=!<>]=++|->|\+=|[=:])|(?P<plus>\+|\.\.|\|\|)|(?P<tag><(?={NAME}[^<>\n]*+>))|(?P<quote>[\"'`])|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<end>[,;])|(?P<gap>[ \t\r]++)|(?P<other>[^\s\"'`A-Za-z_$%{{}}()\[\],;:=+<>|.!-]++|.)", re.ASCII)
ASSIGNS = frozenset([":=", "=>", "=", ":", "+=", "==", "==="])
#: A value that is not quoted.
RAW = re.compile(r"(?!#)[^\s,;\"'`(){}\[\]<>]++")
ELEMENT = re.compile(rf"<({NAME})[^<>\n]*+>([^<>\n]++)</")
BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*+(?=\n)")
INNER = re.compile(r"\{([A-Za-z_][A-Za-z0-9_.]*+)\}")
WHOLE = re.compile(rf"{NAME}\Z")
TRIGGER = re.compile(r"[:=]|</|\([\"']")
GAP = re.compile(r"[ \t\r]*+")
CALLED = re.compile(rf"(?:[fFrRbBuU]{{1,2}})?[\"']|{NAME}\(")
KEYED = re.compile(rf"[\"']?(?:{NAME})?[\"']?[ \t]*+(?:=>|:|=)(?=\s|$|[^:=])")
TRIPLE = tuple(q * 3 for q in "\"'")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/\s:@]*+:([^/\s@]++)@)?")
PATH = re.compile(r"(?:~|\.{1,2}|[A-Za-z]:)?(?:[/\\][\w.-]++){2,}+[/\\]?\Z")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How sensitive a part of a name is.
WEIGHT = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "secret": 3.0, "token": 3.0, "apikey": 3.0, "credential": 3.0, "credentials": 3.0, "pass": 2.0, "cred": 2.0, "auth": 2.0, "bearer": 2.0, "private": 1.5, "key": 1.5, "salt": 1.5, "api": 1.0, "access": 1.0, "signing": 1.0, "encryption": 1.0}
#: Those looked up inside names written as one word, longest first; short ones stand in plain words (compass, author, basalt, monkey, capital).
INSIDE = sorted((w for w in WEIGHT if len(w) > 5 or w in ("token", "pwd")), key=lambda w: (-len(w), w))
#: One-word names that end in a short sensitive word after one of these hold it too.
COMPOUND = re.compile(r"(?:access|account|api|auth|client|crypt|db|encryption|host|master|private|secret|service|shared|signing|ssh|storage|user)(key|pass|auth|salt|cred)s?$")
#: Literals that stand for a value to be filled in.
PLACEHOLDER = re.compile(r"(?i)^(?:none|null|nil|true|false|undefined|change_?me|example.*|your.*|xxx+|\*+|<.*>|\.\.\.+|test|todo|password|secret|token)$")
LEAST_SCORE = 1.4
#: One of these stands in every text with a sensitive name.
SENSITIVE = re.compile("|".join(sorted({w for w in WEIGHT if not any(o in w and o != w for o in WEIGHT)})), re.IGNORECASE)


def name_words(word: str) -> set[str]:
    """The sensitive words of one word of a name: itself, its singular, or the longest that stand in it without overlap."""
    for w in (word, word.removesuffix("s")):
        if w in WEIGHT:
            return {w}
    found, whole = set(), word
    for w in INSIDE:
        if w in word:
            found.add(w)
            word = word.replace(w, " ")
    return found | ({m[1]} if (m := COMPOUND.search(whole)) else set())


def name_score(name: str) -> float:
    return sum(WEIGHT[w] for w in set().union(*(name_words(w.lower()) for w in WORD.findall(name))))


def literal_score(value: str, quoted: bool) -> float:
    """0 to 1, from length, entropy and mixture of characters; 0 for placeholders, prose and short values."""
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value) or value.count(" ") > 3:
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9\\s]"))
    if kinds < 2 and not (quoted and " " not in value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, 0.25 * min(1.0, n / 12) + 0.5 * min(1.0, entropy / 3.0) + 0.1 * kinds)


#: Keys whose value names the next key's value, and such next keys.
LABELS, VALUES = frozenset(["name", "key", "id", "field", "variable"]), frozenset(["value", "val", "default", "content"])
#: Keys around a literal that count for it.
AROUND = 8


class Lexer:
    """The literals of a text, and names bound to literals and other names.

    open holds the bindings whose value is being read, innermost last; keys those whose
    value is what is indented below them.  A literal belongs to all of them.
    """

    def __init__(self, text: str):
        self.text = text
        self.literals: list[tuple[int, int, bool]] = []  # start, end, quoted
        self.names: list[str] = []  # of each binding, with its place, literals and references (name, place, raw literal)
        self.places: list[int] = []
        self.held: list[list[int]] = []
        self.refs: list[list[tuple[str, int, int | None]]] = []
        self.joined: list[tuple] = []  # neighbours that form one value
        self.open: list[tuple[int, int]] = []  # depth, binding
        self.keys: list[tuple[int, int]] = []  # indentation, binding
        self.depth = 0
        self.last, self.joins = None, False  # the part before, and whether the next one continues it
        self.label: tuple[str, int] | None = None  # what a name's key held, and the binding after which it counts
        self.labels: set[int] = set()  # literals that name others
        self.argument: tuple[str, int] | None = None  # a named string, and its depth in brackets
        self.dead = dict.fromkeys([*STRING, *TRIPLE], -1)  # up to where a quote is known not to close
        self._lex()

    def bind(self, name: str, at: int) -> int:
        b = len(self.names)
        if self.label and self.label[1] == b - 1 and name.lower() in VALUES:
            name = self.label[0]
        self.names.append(name)
        self.places.append(at)
        self.held.append([])
        self.refs.append([])
        return b

    def start(self, name: str, at: int) -> None:
        self.open.append((self.depth, self.bind(name, at)))
        self.last, self.joins = None, False

    def around(self) -> list[int]:
        return [b for _, b in self.open[-AROUND:]] + [b for _, b in self.keys[-AROUND:]]

    def literal(self, start: int, end: int, quoted: bool) -> int | None:
        own = self.around()
        if end <= start or not own:
            return None
        k = len(self.literals)
        self.literals.append((start, end, quoted))
        for b in own:
            self.held[b].append(k)
        if self.argument and self.argument[1] == self.depth:
            self.held[self.bind(self.argument[0], start)].append(k)
            self.argument = None
        self.part(k)
        return k

    def refer(self, name: str, at: int) -> None:
        if self.open:
            at = self.places[self.open[-1][1]]  # a name in its own value is the one before
        for b in self.around():
            self.refs[b].append((name, at, None))
        self.part((name, at))

    def part(self, x) -> None:
        if self.joins and self.last is not None:
            self.joined.append((self.last, x))
        self.last, self.joins = x, True

    def close(self) -> None:
        """End the bindings of this depth, as a comma or a line's end does."""
        while self.open and self.open[-1][0] >= self.depth:
            b = self.open.pop()[1]
            if len(self.held[b]) == 1 and self.names[b].lower() in LABELS and WHOLE.match(own := self.text[slice(*self.literals[self.held[b][0]][:2])]):
                self.label = (own, len(self.names) - 1)
                self.labels.add(self.held[b][0])
        self.last, self.joins = None, False

    def _lex(self) -> None:
        t, at, n = self.text, 0, len(self.text)
        while at < n:
            end = t.find("\n", at)
            end = n if end < 0 else end
            first = self._skip(at, end)
            if first == end:  # an empty line ends what is open
                self.depth = 0
                self.close()
                at = end + 1
                continue
            item = t.startswith("- ", first)
            if not (self.depth or (item and self.keys) or TRIGGER.search(t, at, end)):
                self.keys.clear()
                at = end + 1
                continue
            indent = first - at + 2 * item
            while self.keys and not self.depth and self.keys[-1][0] >= indent:
                self.keys.pop()
            at = self._line(first + 2 * item, end, indent)

    def _line(self, at: int, end: int, indent: int) -> int:
        """Read a line, and those that its strings and blocks go on to; where the next one begins."""
        t, first = self.text, at
        if t.startswith(t[at : at + 1] * 3, at) and t[at] in "#-=*":  # a rule
            return end + 1
        name: tuple[str, int] | None = None  # what an assignment would bind
        pending: tuple[str, int] | None = None  # a name that is a reference unless it is bound
        value = bool(self.keys) and t.startswith("- ", at - 2) if at >= 2 else False
        if value and (m := KEYED.match(t, at, end)) and m:
            value = False
        while at < end:
            if value:
                value = False
                at = self._skip(at, end)
                if block := BLOCK.match(t, at):
                    return self._block(block.end() + 1, indent)
                raw = RAW.match(t, at)
                if raw and not t.startswith(("$", "{", "+"), at) and not CALLED.match(t, at):
                    self._raw(at, raw.end())
                    at = raw.end()
                    continue
                if at >= end:
                    break
            m = TOKEN.match(t, at)
            kind, at = m.lastgroup, m.end()
            if kind == "gap":
                continue
            assigns = kind == "op" and m[0] in ASSIGNS
            if pending and not assigns:
                self.refer(*pending)
            if kind != "op":
                name = None
            if kind == "quote":
                pending = None
                q = m[0]
                if q != "`" and t.startswith(q * 3, m.start()):
                    stop = t.find(q * 3, m.start() + 3) if self.dead[q * 3] < 0 else -1
                    at = m.start() + 3
                    if stop < 0:
                        self.dead[q * 3] = at
                        continue
                    self.literal(at, stop, True)
                    at = stop + 3
                    if at > end:
                        end = t.find("\n", at)
                        end = len(t) if end < 0 else end
                    continue
                found = STRING[q].match(t, m.start()) if m.start() >= self.dead[q] else None
                if not found:
                    self.dead[q] = max(self.dead[q], end)
                    continue
                at, own, place = found.end(), found[1], found.start(1)
                follow = TOKEN.match(t, self._skip(at, end)) if WHOLE.match(own) and at < len(t) else None
                if follow and follow["op"] in (":", "=", "=>") or (t.startswith("]", at) and follow and KEYED.match(t, at + 1, end)):
                    name = (own, place)
                    at += t.startswith("]", at)
                    continue
                parts = list(INNER.finditer(own)) if q == "`" or t[found.start() - 1 : found.start()] in ("f", "F", "$") else []
                for p in parts:
                    self.literal(place, found.start(1) + p.start(), True)
                    self.refer(p[1], found.start(1) + p.start())
                    place = found.start(1) + p.end()
                self.literal(place, found.end(1), True)
                if not parts and self.depth and self.open and WHOLE.match(own) and name_score(own):
                    self.argument = (own, self.depth)
                continue
            if kind == "name":
                pending = None
                name = (m[0], m.start())
                if t.startswith(("\"", "'"), at) and len(m[0]) < 3:
                    name = None  # the prefix of a string
                elif t.startswith("(", at):
                    if t.startswith(("\"", "'"), at + 1) and name_score(m[0]):
                        self.start(*name)
                    self.depth += 1
                    at += 1
                    name, self.joins = None, False
                else:
                    pending = name if self.open or self.keys else None
            elif assigns and name:
                if self.open and self.open[-1][0] == self.depth and self.held[self.open[-1][1]]:
                    self.close()
                self.start(*name)
                if m[0] == "+=":
                    self.refer(*name)
                    self.joins = False
                if m[0] == ":" and name[1] - (t[name[1] - 1 : name[1]] in ("\"", "'")) == first and not self.depth and self._skip(at, end) == end:
                    self.keys.append((indent, self.open.pop()[1]))
                name, pending, value = None, None, True
            elif kind == "ref":
                self.refer(re.search(NAME, m[0])[0], m.start())
            elif kind == "plus":
                self.joins = self.last is not None
            elif kind == "tag":
                if e := ELEMENT.match(t, m.start()):
                    if t.startswith(f"{e[1]}>", e.end()):
                        self.start(e[1], e.start(1))
                        own = e[2]
                        self.literal(e.start(2) + len(own) - len(own.lstrip()), e.start(2) + len(own.rstrip()), True)
                        self.open.pop()
                    at = e.end() - 2
            elif kind == "open":
                self.depth += 1
                self.joins = False
            elif kind in ("close", "end"):
                self.close()
                if kind == "close":
                    self.depth = max(0, self.depth - 1)
                    if self.argument and self.argument[1] > self.depth:
                        self.argument = None
            else:
                self.joins = False
            if kind != "name":
                pending = None
        if pending:
            self.refer(*pending)
        self.close()
        return end + 1

    def _skip(self, at: int, end: int) -> int:
        return GAP.match(self.text, at, end).end()

    def _raw(self, a: int, z: int) -> None:
        """A value without quotes is a literal, or names; which, is seen when all names are known."""
        k = self.literal(a, z, False)
        if k is not None:
            a, own = self.places[self.open[-1][1]] if self.open else a, self.text[a:z]
            for name in own.split("+"):
                if WHOLE.match(name):
                    for b in self.around():
                        self.refs[b].append((name, a, k))
                    self.joined.append((k, (name, a)))

    def _block(self, at: int, indent: int) -> int:
        """The lines that are indented deeper are one literal."""
        t, start, stop = self.text, None, at
        while at < len(t):
            end = t.find("\n", at)
            end = len(t) if end < 0 else end
            first = self._skip(at, end)
            if first < end:
                if first - at <= indent:
                    break
                start = first if start is None else start
                stop = end
            at = end + 1
        if start is not None:
            self.literal(start, stop, True)
        self.close()
        return at

    def weights(self) -> tuple[dict[int, float], list[int]]:
        """The weight of each literal that a sensitive name reaches, and a number for each literal that joined ones share."""
        of: dict[str, tuple[list[int], list[int]]] = {}
        for b in sorted(range(len(self.names)), key=lambda b: self.places[b]):
            places, own = of.setdefault(self.names[b], ([], []))
            places.append(self.places[b])
            own.append(b)

        def meant(name: str, at: int) -> int | None:
            """The last binding before, else the first."""
            places, own = of.get(name, ((), ()))
            return own[max(bisect_left(places, at) - 1, 0)] if own else None

        resolved = [[(b, k) for name, at, k in refs if (b := meant(name, at)) is not None and b != own] for own, refs in enumerate(self.refs)]
        names_only = {k for refs in resolved for _, k in refs if k is not None}
        group = list(range(len(self.literals)))

        def root(k: int) -> int:
            while group[k] != k:
                group[k] = group[group[k]]
                k = group[k]
            return k

        for pair in self.joined:
            ends = [x if isinstance(x, int) else (self.held[b][0] if (b := meant(*x)) is not None and self.held[b] else None) for x in pair]
            if None not in ends:
                group[root(ends[1])] = root(ends[0])
        best: dict[int, float] = {}
        heap = [(-w, b) for b, name in enumerate(self.names) if (w := name_score(name))]
        heapq.heapify(heap)
        seen: set[int] = set()
        while heap:
            w, b = heapq.heappop(heap)
            if b not in seen:
                seen.add(b)
                for k in self.held[b]:
                    if k not in names_only and k not in self.labels:
                        best.setdefault(k, -w)
                for other, _ in resolved[b]:
                    heapq.heappush(heap, (w, other))
        return best, [-1 if k in names_only else root(k) for k in range(len(group))]


def lexed(text: str) -> Iterator[tuple[int, int]]:
    """The spans of the literals with a high score."""
    lexer = Lexer(text)
    best, group = lexer.weights()
    together: dict[int, list[int]] = {}
    for k, g in enumerate(group):
        if g >= 0:
            together.setdefault(g, []).append(k)
    scores: dict[int, float] = {}
    for k, weight in best.items():
        own = together[group[k]]
        start, end, quoted = lexer.literals[k]
        if len(own) == 1:
            if url := URL.match(text, start, end):
                if url[1]:
                    yield url.span(1)
                continue
            if PATH.match(text[start:end]):
                continue
        if group[k] not in scores:
            scores[group[k]] = literal_score("".join(text[slice(*lexer.literals[i][:2])] for i in own), quoted)
        if weight * scores[group[k]] >= LEAST_SCORE:
            yield start, end


def within(base: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the sorted spans holds a to b; those of one kind don't overlap, so the last few that begin before it tell."""
    k = bisect_right(base, (a, math.inf))
    return any(x <= a and b <= y for x, y in base[max(0, k - 8) : k])


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    spans = []
    if any(s in (low := text.lower()) for s in STEMS):
        del low
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if TRIGGER.search(text) and SENSITIVE.search(text):
        base = sorted((a, b) for _, a, b in spans)
        spans += [("lexed", a, b) for a, b in sorted(set(lexed(text))) if not within(base, a, b)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans, an array of (kind, start, end), for each row; narrow, one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)] for t in as_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], names=[id_col, "spans"])

    source = small_batches(df.select(F.col(id_col), F.col(text_col).cast("string")))
    return source.mapInArrow(scan, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from secret_spans()."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return df.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(text(F.filter("spans", lambda s: s["kind"] != "lexed")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), of("lexed").alias("n_lexed"))
