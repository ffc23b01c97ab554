"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has a bit set where over half of the text's shingle hashes have it.
Fingerprints link at RADIUS or fewer differing bits; a component is what links reach.

Equal fingerprints are reduced to one row first.  Each fingerprint is cut into
SEGMENTS on a ring.  If two differ in at most r bits, then by the pigeonring
principle some segment starts a chain in which the first l segments differ by at most
l * r / SEGMENTS bits, for every l.  With r = 2 and three segments the budgets are 0,
1 and 2: a bucket holds the fingerprints that agree on the first segment, inside it
only second segments that are equal or one bit apart go on, and then only third
segments within what is left.  What remains gets the full Hamming check.  Both inner
steps look up bit variants in sorted arrays, so a bucket costs in proportion to its
fingerprints, never to its pairs, and gives at most one link (to a spanning root) for
each of them.  Buckets of more than HOT_BUCKET fingerprints are dealt on by the
chain's second segment and its one-bit variants; nothing is dropped.

Links become components by label propagation with pointer jumping in Spark, cut by a
table in the shared folder each round.

Null and empty texts, or texts without words, have fingerprint zero, which links like
any other.  Fewer words than a shingle count as one shingle.  Rows with a null doc_id
get a null component unless a text with an id reaches them.  Repeated rows stay rows,
other columns are not read.  An empty table gives no rows.

near_copies() is the same operator for a similarity of the shingle sets themselves, by
default five words and 0.8.  Fingerprints of such pairs differ in up to a third of their
bits, where segments of 64 bits no longer tell pairs apart: so families are formed first,
by bands of minima of the sets (a pair at 0.8 is missed with probability 2e-5, less
above).  Inside a family, cut into blocks so that no task takes it whole, pairs meet the
pigeonring chains of WIDE_RADIUS over eight segments, then the full Hamming check, and
what is left is held against the whole sets, so no link is false.  Pairs are never rows:
a task gives a spanning forest of two blocks.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import as_bytes, cut, drop_cut, small_batches

RADIUS = 2
#: Lengths of the ring's segments in bits.
SEGMENTS = (22, 21, 21)
SHINGLE, SEED = 3, 42
#: Fingerprints of a bucket that one task takes without dealing it on.
HOT_BUCKET = 50_000
STRIP = 1 << 15


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """The hashes of the text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, SEED)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-size]])
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; none for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STRIP):
        ones += np.unpackbits(hashes[at : at + STRIP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, size))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, size) for x in as_bytes(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(df).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def rotated(fp: np.ndarray, ring: int) -> np.ndarray:
    """The fingerprint's bits with segment `ring` on top, the next below it."""
    by = sum(SEGMENTS[:ring])
    return fp if not by else (fp << np.uint64(by)) | (fp >> np.uint64(64 - by))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(nxt := label[label], label):
            label = nxt
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into wanted, and into the sorted distinct keys, where they are equal."""
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    hit = np.nonzero(keys[at] == wanted)[0]
    return hit, at[hit]


def chain_links(x: np.ndarray, ring: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of indices into x, sorted distinct rotated fingerprints, that a chain from segment `ring` admits.

    Pairs whose second segments agree are linked through shared variants: all that share
    one are within the radius of each other, so neighbours in the variant's order do.
    """
    one = np.uint64(1)
    third = SEGMENTS[(ring + 2) % 3]
    second = SEGMENTS[(ring + 1) % 3]
    a, b = [], []
    # Budget 0 on the second segment: only groups of two or more that share the first two go on.
    head = x >> np.uint64(third)
    twin = np.zeros(len(x), bool)
    same = head[1:] == head[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    at = np.nonzero(twin)[0]
    if len(at):
        flips = np.array([0, *(1 << i for i in range(third))], dtype=np.uint64)
        variants = (x[at, None] ^ flips).ravel()
        own = np.repeat(at, len(flips))
        order = np.argsort(variants, kind="stable")
        variants, own = variants[order], own[order]
        same = variants[1:] == variants[:-1]
        a.append(own[:-1][same])
        b.append(own[1:][same])
    # One bit on the second segment, at most one on the third.
    heads, first = np.unique(head, return_index=True)
    ends = np.append(first[1:], len(x))
    for bit in range(second):
        flip = one << np.uint64(bit)
        clear = np.nonzero(heads & flip == 0)[0]
        hit, other = find(heads, heads[clear] | flip)
        for g, h in zip(clear[hit].tolist(), other.tolist(), strict=True):
            left, right = np.arange(first[g], ends[g]), np.arange(first[h], ends[h])
            keys = x[left]
            flipped = x[right] ^ (flip << np.uint64(third))
            for f in (0, *(1 << i for i in range(third))):
                i, j = find(keys, flipped ^ np.uint64(f))
                a.append(left[j])
                b.append(right[i])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    near = np.bitwise_count(x[a] ^ x[b]) <= RADIUS  # the full check
    return a[near], b[near]


def bucket_links(keys: DataFrame) -> DataFrame:
    """(a, b) fingerprints of a spanning forest of each bucket (ring, head, sub)."""

    def flush(ring: int, fps: list[np.ndarray]) -> pa.RecordBatch | None:
        x = np.concatenate(fps)
        r = np.unique(rotated(x, ring))
        i, j = chain_links(r, ring)
        root = roots(len(r), i, j)
        child = np.nonzero(root != np.arange(len(r)))[0]
        if not len(child):
            return None
        back = rotated_back(r, ring).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back[child]), pa.array(back[root[child]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs of whole buckets of one ring position are worked on together.
        ring, held, size = None, [], 0
        last = None
        for b in batches:
            rings, heads, subs = (np.array(b.column(i)) for i in (0, 1, 2))
            fps = np.array(b.column(3)).view(np.uint64)
            if not len(fps):
                continue
            key = np.stack([rings.astype(np.int64), heads.astype(np.int64), subs.astype(np.int64)], 1)
            change = np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1
            for lo, hi in zip([0, *change], [*change, len(fps)], strict=True):
                here = tuple(key[lo])
                if held and (here[0] != ring or here != last and (size >= 20_000 or here[2] >= 0 or last[2] >= 0)):
                    if out := flush(ring, held):
                        yield out
                    held, size = [], 0
                ring, last = here[0], here
                held.append(fps[lo:hi])
                size += hi - lo
        if held and (out := flush(ring, held)):
            yield out

    return keys.select("ring", "head", "sub", "fp").repartition("ring", "head", "sub").sortWithinPartitions("ring", "head", "sub").mapInArrow(run, "a long, b long")


def rotated_back(x: np.ndarray, ring: int) -> np.ndarray:
    by = sum(SEGMENTS[:ring])
    return x if not by else (x >> np.uint64(by)) | (x << np.uint64(64 - by))


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links between distinct fingerprints (column fp) that connect all those within RADIUS bits."""
    turn = lambda c, by: c if not by else F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, 64 - by))
    rings = [F.struct(F.lit(i).alias("ring"), F.shiftrightunsigned(turn(F.col("fp"), sum(SEGMENTS[:i])), 64 - SEGMENTS[i]).cast("int").alias("head"), F.shiftrightunsigned(turn(F.col("fp"), sum(SEGMENTS[: i + 1]) % 64), 64 - SEGMENTS[(i + 1) % 3]).cast("int").alias("next")) for i in range(3)]
    dealt = fps.select("fp", F.explode(F.array(*rings)).alias("k")).select("fp", "k.*")
    sizes = dealt.groupBy("ring", "head").agg(F.count("*").alias("n")).where("n > 1")
    hot = cut(sizes.where(F.col("n") > hot_bucket).select("ring", "head"))
    if not hot.isEmpty():
        n = hot.count()
        # Hot buckets number at most the fingerprints over hot_bucket; only a short list is sent out.
        marked = dealt.join(F.broadcast(hot.withColumn("hot", F.lit(True))) if n <= 100_000 else hot.withColumn("hot", F.lit(True)), ["ring", "head"], "left")
        bits = F.when(F.col("ring") == 0, F.lit(SEGMENTS[1])).when(F.col("ring") == 1, F.lit(SEGMENTS[2])).otherwise(F.lit(SEGMENTS[0]))
        subs = F.when(F.col("hot"), F.concat(F.array("next"), F.transform(F.sequence(F.lit(0), bits - 1), lambda i: F.col("next").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i))))).otherwise(F.array(F.lit(-1)))
        dealt = marked.withColumn("sub", F.explode(subs))
    else:
        dealt = dealt.withColumn("sub", F.lit(-1))
    return bucket_links(dealt)


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of the fingerprints with links; root is the smallest fingerprint reached.

    Each round takes the smallest label among the neighbours, then the label's label;
    the rounds grow with the logarithm of a component's width in practice.
    """
    both = cut(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        step = near.join(labels, "a").select("a", F.least("low", "root").alias("next"), "root")
        jump = labels.select(F.col("a").alias("next"), F.col("root").alias("far"))
        new = cut(step.join(jump, "next").select("a", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")))
        drop_cut(labels)
        labels = new
        if labels.where("moved").isEmpty():
            return labels.select(F.col("a").alias("fp"), "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id that links reach, of each row."""
    docs = cut(fingerprints(df, id_col, text_col, size))
    classes = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(classes.select("fp"), hot_bucket))
    root = classes.join(joined, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    root = cut(root)
    first = root.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = root.join(first, "root").select("fp", "component_id")
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: near_copies(): words of a shingle, least similarity as a fraction, bands and minima of a band.
WIDE_SHINGLE, LEAST, BANDS, ROWS = 5, (4, 5), 60, 8
#: Differing bits at most: pairs at LEAST differ in 9.7 bits, 2.9 being their deviation.
WIDE_RADIUS, WIDE_SEGMENTS = 24, 8
#: Shingles and classes of a block, about; hashes of a text and of a pair of blocks worked on at once.
BLOCK_SHINGLES, BLOCK_CLASSES, PART, VOCABULARY = 20_000, 64, 512, 4096
_rng = np.random.default_rng(7)
FACTORS = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
TERMS = _rng.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set of hashes, the band's number hashed in; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    x = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), PART):
        np.minimum(low, (x[at : at + PART] * FACTORS + TERMS).min(1), out=low)
    low = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(low[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def signatures(rows: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """key, cls (equal for equal sets), n (the set's size) and the bands' keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(x, WIDE_SHINGLE)) for x in as_bytes(b.column(1))]
            cls = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls), pa.array([len(x) for x in sets], pa.int64()), pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))], names=["key", "cls", "n", "bands"])

    return small_batches(rows).select(F.col(key_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "key long, cls long, n long, bands array<long>")


def sets_of(rows: DataFrame, key_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """cls, fp and own, the bytes of its set, for the classes of wanted (cls, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(x, WIDE_SHINGLE) for x in as_bytes(b.column(1))]
            fps = np.array([majority(x) for x in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), pa.array([np.unique(x).tobytes() for x in hashes], pa.binary())], names=["cls", "fp", "own"])

    texts = rows.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return texts.join(wanted, "key").select("cls", "text").mapInArrow(run, "cls long, fp long, own binary")


def chained(a: np.ndarray, b: np.ndarray, radius: int = WIDE_RADIUS, segments: int = WIDE_SEGMENTS) -> np.ndarray:
    """Which pairs of fingerprints pass: from some segment on, the first l segments differ in at most l * radius / segments bits, for every l; and all in at most radius."""
    differ = np.bitwise_count((a[:, None] ^ b[None, :])[..., None].view(np.uint8)).reshape(len(a), len(b), segments, -1).sum(-1, dtype=np.int16)
    ring = np.cumsum(np.concatenate([differ, differ], -1), -1, dtype=np.int16)
    budget = np.arange(1, segments + 1) * radius
    out = np.zeros(differ.shape[:2], bool)
    for k in range(segments):
        before = ring[..., k - 1 : k] if k else np.int16(0)
        out |= (segments * (ring[..., k : k + segments] - before) <= budget).all(-1)
    return out & (ring[..., segments - 1] <= radius)


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of left has in common with each of right."""
    words = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), np.float64)
    sides = [(np.concatenate([np.searchsorted(words, x) for x in side]), np.repeat(np.arange(len(side)), [len(x) for x in side])) for side in (left, right)]
    for at in range(0, len(words), VOCABULARY):
        m = []
        for (word, who), side in zip(sides, (left, right), strict=True):
            own = (word >= at) & (word < at + VOCABULARY)
            x = np.zeros((len(side), min(VOCABULARY, len(words) - at)), np.float32)
            x[who[own], word[own] - at] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def block_links(rows: DataFrame) -> DataFrame:
    """(a, b) classes of a spanning forest of the similar ones in each pair of blocks (family, i, j); rows have side, the block that the class is in."""

    def links(cls: list[int], fps: list[int], sets: list[bytes], side: list[int]) -> pa.RecordBatch | None:
        own = [np.frombuffer(x, np.uint64) for x in sets]
        fp = np.array(fps, np.int64).view(np.uint64)
        at = np.array(side)
        left = np.nonzero(at == at.min())[0]
        right = np.nonzero(at == at.max())[0]
        n = np.array([len(x) for x in own])
        low, high = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
        maybe = chained(fp[left], fp[right]) & (LEAST[1] * low >= LEAST[0] * high)
        rows, cols = np.nonzero(maybe.any(1))[0], np.nonzero(maybe.any(0))[0]
        if not len(rows):
            return None
        both = shared([own[k] for k in left[rows]], [own[k] for k in right[cols]])
        near = LEAST[1] * both >= LEAST[0] * (n[left[rows]][:, None] + n[right[cols]] - both)
        i, j = np.nonzero(near & maybe[np.ix_(rows, cols)])
        root = roots(len(cls), left[rows[i]], right[cols[j]])
        child = np.nonzero(root != np.arange(len(cls)))[0]
        if not len(child):
            return None
        cls = np.array(cls, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cls[child]), pa.array(cls[root[child]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [], [])
        for b in batches:
            for *group, side, cls, fp, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != last and last is not None:
                    if out := links(held[0], held[1], held[2], held[3]):
                        yield out
                    held = ([], [], [], [])
                last = group
                for x, y in zip(held, (cls, fp, own, side), strict=True):
                    x.append(y)
        if held[0] and (out := links(*held)):
            yield out

    return rows.select("family", "i", "j", "side", "cls", "fp", "own").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, "a long, b long")


def near_copies(rows: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_col (a long, distinct) and first, the key of the row of smallest id in its component, of each row.

    Null ids come last; equal ids go by the text's class, then the key.  Texts with equal
    sets are one class, of which one row stands for all; texts without words are one class.
    """
    signs = cut(signatures(rows, key_col, text_col))
    classes = signs.groupBy("cls").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    dealt = classes.select("cls", F.explode("bands").alias("band"))
    first = dealt.groupBy("band").agg(F.min("cls").alias("a"), F.count("*").alias("size")).where("size > 1").select("band", "a")
    # A class hangs on the least root of its buckets, and that root on the others: few distinct pairs for many bands.
    hung = dealt.join(first, "band").groupBy("cls").agg(F.collect_set("a").alias("roots"))
    edges = cut(hung.select(F.array_min("roots").alias("a"), F.explode(F.array_union("roots", F.array("cls"))).alias("b")).where("a <> b").distinct())
    family = cut(components(edges).select(F.col("fp").alias("cls"), F.col("root").alias("family")))
    drop_cut(edges)
    members = cut(signs.join(family, "cls").groupBy("family", "cls").agg(F.min("key").alias("key"), F.first("n").alias("n")))
    parts = members.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("parts"))
    dealt = members.join(parts, "family").select("cls", "key", "family", "parts", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("side"))
    sets = cut(sets_of(rows, key_col, text_col, dealt.select("cls", "key")))
    pairs = dealt.join(sets, "cls").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("family", F.least("side", "k").alias("i"), F.greatest("side", "k").alias("j"), "side", "cls", "fp", "own")
    near = cut(block_links(pairs))
    drop_cut(sets)
    label = cut(components(near))
    grouped = signs.select("key", "cls").join(label.withColumnRenamed("fp", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    ids = rows.select(F.col(key_col).cast("long").alias("key"), F.col(id_col).alias("id"))
    own = cut(grouped.join(ids, "key"))
    for done in (signs, family, members, near, label):
        drop_cut(done)
    first = own.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "cls", "key")).alias("x")).select("root", F.col("x.key").alias("first"))
    return own.join(first, "root").select(F.col("key").alias(key_col), "first")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
