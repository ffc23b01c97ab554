"""Main text of web pages by site template removal.

Every page is read into elements (unclosed paragraphs and items close as browsers
close them; scripts, styles and comments are no text).  A block element has a slot, its
path of tags, classes and ids (digits left out), and its subtree a hash of slot and
text; link targets and other attributes don't count.  Spark counts, for each host, the
distinct main paragraphs (the longest of a page's article) under which a subtree
stands, so that copies of a page, near ones too, count once.

What recurs is the host's template: subtrees in MIN_PAGES and SHARE of the host's
pages, and slots most of whose subtrees recur in MIN_PAGES, whatever they hold on one
page.  Elements named as site furniture (menu, header, footer, notice, advert) and
those outside the page's articles need only little evidence: NAMED_SHARE of the slot's
subtrees recur at all.  An unnamed element with a page's main paragraph is never taken,
nor is an article or a paragraph in one, as a paragraph that many articles share is
still the article's.  On hosts of fewer than COUNTED pages, slots say little: there
names decide beside the subtrees that recur, and the text is read from the articles,
else main, else the body.

Forms, sidebars, reader comments and the like differ from page to page: they are left
out by name on all hosts.

Blocks are joined by an empty line, white space inside a block becomes one space,
character references are decoded once.

Null and empty pages have empty text; a null url is a host of its own.  A tag that the
page's end cuts off is dropped, as in browsers; elements nest DEEP levels, those below
are siblings.  A page costs in proportion to its length.  Repeated rows stay rows, other
columns are not read.  An empty table gives no rows.
"""

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import cut, small_batches

#: Pages and share of a host's pages in which a template stands; pages from which a host is counted.
MIN_PAGES, SHARE, COUNTED = 4, 0.2, 30
#: Shares of a slot's subtrees that recur: for any slot, for one that is named as furniture.
SLOT_SHARE, NAMED_SHARE = 0.5, 0.05
#: Set beside a slot's hash where the evidence is enough for named elements only.
NAMED = 0x5DEECE66D
DEEP = 512
#: Template hashes that are sent out at once; more are joined by host.
BROADCAST_HASHES = 400_000

# Possessive throughout: no character is read twice at one place.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>", re.DOTALL)
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++))")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
#: Elements of the page's structure. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object canvas noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head".split())
LEFT_OUT = frozenset("aside form menu head button dialog fieldset search label".split())
SITE = frozenset("nav header footer".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li pre dd dt td th tr blockquote figcaption caption summary".split())
#: Words of a class, id or role that say an element is the page's furniture, or the site's.
HINT = re.compile(r"(?:^|[\s_-])(?:sidebar|side|aside|complementary|popup|modal|overlay|form|search|login|signup|subscribe|subscription|newsletter|share|sharing|social|related|recommended|comments?|replies|reply|disqus|respond|skip|widget|toolbar|pagination|pager)(?:$|[\s_-])", re.IGNORECASE)
SITE_HINT = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|footer|contentinfo|notice|cookies?|consent|gdpr|banner|alert|ads?|advert|adverts|advertisement|advertising|promo|promoted|sponsor|sponsored)(?:$|[\s_-])", re.IGNORECASE)
CLOSED_BY: dict[str, frozenset] = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset(["ul", "ol", "dl", "table", "menu", "article", "section", "div", "body", "main", "td", "th", "aside", "nav"])


class Node:
    __slots__ = ("attrs", "hash", "items", "main", "names", "size", "slot", "tag")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.items = tag, attrs, []
        self.hash = self.slot = self.size = 0
        self.names: str | None = None
        self.main: Node | None = None  # of the root: the main paragraph

    def named(self) -> str:
        """The element's class, id and role."""
        if self.names is None:
            self.names = " ".join(a or b or c for name, a, b, c in ATTRIBUTE.findall(self.attrs) if name.lower() in ("class", "id", "role")) if "=" in self.attrs else ""
        return self.names


def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE)


RAW_END = {tag: raw_end(tag) for tag in RAW}


def parse(html: str) -> Node:
    """A tree of nodes; items are nodes and pieces of source text."""
    root = Node("#root", "")
    stack, open_ = [root], Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    at, text, end = 0, 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            break
        m = TAG.match(html, lt)
        kind = html[lt + 1 : lt + 2]
        if not m and not (kind.isascii() and kind.isalpha()) and kind not in ("/", "!", "?"):
            at = lt + 1  # a plain less-than sign
            continue
        if lt > text:
            stack[-1].items.append(html[text:lt])
        if m:
            at = m.end()
        elif html.startswith("<!--", lt):
            short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, lt)), None)
            stop = None if short else COMMENT_END.search(html, lt + 4)
            at = lt + len(short) if short else stop.end() if stop else end
        elif kind in ("!", "?") or (kind == "/" and not html[lt + 2 : lt + 3].isalpha()):
            at = html.find(">", lt) + 1 or end
        else:
            at = end  # a tag cut off by the page's end
        text = at
        tag = m and m[2].lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag == "p" and stack[k].tag in SCOPE:
                    break
            else:
                if tag in ("p", "br"):
                    stack[-1].items.append(Node(tag, ""))
            continue
        if tag in BLOCK and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in CLOSED_BY and any(open_[x] for x in CLOSED_BY[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    close(k)
                    break
                if stack[k].tag in SCOPE and stack[k].tag not in ("td", "th"):
                    break
        if len(stack) > DEEP:
            close(len(stack) - 1)
        node = Node(tag, m[3])
        stack[-1].items.append(node)
        if tag in RAW:
            if not m[3].endswith("/"):
                stop = RAW_END[tag].search(html, at)
                at = (html.find(">", stop.end()) + 1 or end) if stop else end
            text = at
        elif tag not in VOID:
            stack.append(node)
            open_[tag] += 1
    if text < end:
        stack[-1].items.append(html[text:])
    return root


DIGITS = re.compile(r"\d+")
UPPER = ("html", "body", "head")


def signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def hash_blocks(root: Node) -> tuple[list[Node], int]:
    """Set each node's slot, hash and size; the block elements below the body, and the hash of the page's main paragraph (0: none)."""
    found, best = [], (False, 0, 0)
    root.main = None
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, ready, inside = todo.pop()
        if not ready:
            inside = inside or node.tag == "article"
            todo.append((node, True, inside))
            names = DIGITS.sub("", " ".join(node.named().split())) if node.attrs else ""
            slot = f"{node.slot:x}" if node.tag in UPPER else f"{node.slot:x}>{node.tag} {names}"
            node.slot = signed(xxhash.xxh64_intdigest(slot.encode("utf-8", "surrogatepass"))) if node.tag not in UPPER else node.slot
            for x in node.items:
                if isinstance(x, Node):
                    x.slot = node.slot
                    todo.append((x, False, inside))
            continue
        parts, size, leaf = [], 0, True
        for x in node.items:
            if isinstance(x, Node):
                parts.append(f"<{x.hash:x}>")
                size += x.size
                leaf = leaf and x.tag not in BLOCK
            elif y := " ".join(x.split()):
                parts.append(y)
                size += len(y)
        node.size = size
        node.hash = signed(xxhash.xxh64_intdigest(f"{node.slot:x}\0{chr(0).join(parts)}".encode("utf-8", "surrogatepass")))
        if node.tag in BLOCK and node.tag not in UPPER:
            found.append(node)
            if leaf and size:
                if (own := (inside, size, node.hash)) > best:
                    best, root.main = own, node
    return found, best[2]


def left_out(node: Node) -> bool:
    """Whether an element is furniture of its page, by name."""
    if node.tag in LEFT_OUT or node.tag in RAW:
        return True
    if node.attrs and node.tag not in (*UPPER, "main"):
        if HINT.search(node.named()):
            return True
        return "hidden" in node.attrs and bool(re.search(r"(?:^|\s)hidden(?:\s|$)|aria-hidden\s*=\s*[\"']?true", node.attrs))
    return False


def site_named(node: Node) -> bool:
    return node.tag in SITE or bool(node.attrs and node.tag not in (*UPPER, "main") and SITE_HINT.search(node.named()))


def articles(root: Node) -> list[Node]:
    """The outermost articles in page order."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag == "article":
            found.append(x)
        elif not left_out(x):
            todo += [i for i in reversed(x.items) if isinstance(i, Node)]
    return found


def mains(root: Node) -> list[Node]:
    """The outermost main elements in page order."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag == "main" or re.search(r"(?:^|\s)main(?:\s|$)", x.named()) and "role" in x.attrs:
            found.append(x)
        else:
            todo += [i for i in reversed(x.items) if isinstance(i, Node) and not left_out(i) and not site_named(i)]
    return found


def main_text(root: Node, template: frozenset | set | None) -> str:
    """The main text of a parsed page (hash_blocks() done) without its host's template, in which 0 says that the host is counted."""
    own = articles(root)
    template = template or frozenset()
    counted = 0 in template
    tops = [root] if counted else own or mains(root) or [root]
    blocks: list[str] = []
    part: list[str] = []
    within, holding = set(), set()  # elements that hold an article, or the main paragraph
    todo: list = [(root, ())]
    while todo and template:
        x, path = todo.pop()
        if x.tag == "article" or x is root.main:
            up = (id(x), path)
            while up:
                if x.tag == "article":
                    within.add(up[0])
                if x is root.main:
                    holding.add(up[0])
                up = up[1]
        todo += [(i, (id(x), path)) for i in x.items if isinstance(i, Node)]

    def flush() -> None:
        if text := " ".join(unescape("".join(part)).split()):
            blocks.append(text)
        part.clear()

    def gone(x: Node, inside: bool) -> bool:
        if left_out(x):
            return True
        if not counted and site_named(x):
            return True
        if x.tag not in BLOCK or x.tag in UPPER or x.tag == "article":
            return False
        if counted and (site_named(x) or (own and not inside and id(x) not in within)) and x.slot ^ NAMED in template:
            return True
        if inside and x.tag in PARAGRAPH or id(x) in holding:
            return False
        return x.hash in template or x.slot in template

    for top in tops:
        stack: list = [(iter(top.items), True, top.tag == "article" or top.tag == "main")]
        while stack:
            items, block, inside = stack[-1]
            x = next(items, None)
            if x is None:
                stack.pop()
                if block:
                    flush()
            elif isinstance(x, str):
                part.append(x)
            elif x.tag == "br":
                part.append(" ")
            else:
                block = x.tag in BLOCK
                if block:
                    flush()
                if not gone(x, inside):
                    stack.append((iter(x.items), block, inside or x.tag == "article"))
    return "\n\n".join(blocks)


def host_of(url: str) -> str:
    m = HOST.match(url)
    return m[1].lower() if m else ""


def templates(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, hash): 0 for a host that is counted; the hashes of its template's subtrees and slots, and slots ^ NAMED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, int, int, int]] = []
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host = host_of(url or "")
                nodes, key = hash_blocks(parse(html or ""))
                out += {(host, 0, 0, key), *((host, x.slot, x.hash, key) for x in nodes if x.size)}  # 0 stands for the page itself
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "slot", "hash", "key"])

    seen = df.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "host string, slot long, hash long, key long")
    counts = cut(seen.distinct().groupBy("host", "slot", "hash").agg(F.count("*").alias("pages")))
    many = lambda least: F.sum(F.when(F.col("pages") >= least, F.col("pages")).otherwise(0))
    slots = counts.groupBy("host", "slot").agg(F.sum("pages").alias("n"), many(2).alias("twice"), many(MIN_PAGES).alias("often"))
    known = F.when(F.col("slot") == 0, F.array(F.when(F.col("n") >= COUNTED, F.lit(0).cast("long")))).otherwise(
        F.array(F.when((F.col("often") >= MIN_PAGES) & (F.col("often") >= F.col("n") * SLOT_SHARE), F.col("slot")), F.when((F.col("twice") > 0) & (F.col("twice") >= F.col("n") * NAMED_SHARE), F.col("slot").bitwiseXOR(F.lit(NAMED))))
    )
    by_slot = slots.select("host", F.explode(known).alias("hash")).where("hash is not null")
    size = slots.where("slot = 0").select("host", F.col("n").alias("all_pages"))
    often = counts.where((F.col("slot") != 0) & (F.col("pages") >= MIN_PAGES)).join(size, "host").where(F.col("pages") >= F.col("all_pages") * SHARE).select("host", "hash")
    return by_slot.join(size.where(F.col("all_pages") >= COUNTED).select("host"), "host", "left_semi").unionAll(often)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """page_id, url and text of each row."""
    spark = small_batches(df).sparkSession
    found = cut(templates(df, url_col, html_col))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    n = found.count()
    if n <= broadcast_hashes:
        by_host: dict[str, set] = {}
        for r in found.collect():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        sent = spark.sparkContext.broadcast(by_host)
    else:
        sent = None
        # A host has at most (blocks a page) / SHARE such subtrees, and the slots of its templates.
        lists = found.groupBy("host").agg(F.collect_set("hash").alias("template"))
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST.pattern, 1))
        rows = rows.withColumn("host", host).join(lists, "host", "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(3).to_pylist() if sent is None else [None] * b.num_rows
            texts = []
            for url, html, template in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), own, strict=True):
                root = parse(html or "")
                hash_blocks(root)
                texts.append(main_text(root, set(template or ()) if sent is None else sent.value.get(host_of(url or ""))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")


def digest(df: DataFrame) -> DataFrame:
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
