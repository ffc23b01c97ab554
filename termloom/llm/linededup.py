"""Line dedup over a sharded minimal perfect hash.

A line's key is the line stripped of white space, A-Z in lower case; keys of fewer
than MIN_CHARS code points are never dropped.  One pass hashes the keys to 128 bits
and Spark reduces (hash, doc_id) to the number of rows and the smallest and largest
doc_id of each hash.  Hashes of two or more documents are dealt to shards of bounded
size; each shard becomes a minimal perfect hash with compact fingerprint, count and
first-document arrays at its slots.  Hashes of one document are left out: a probe
that misses its fingerprint is a line of one document.

Documents probe the arrays; lines are never joined.  While all shards together stay
under BROADCAST_BYTES they are sent to the executors.  Beyond it, the documents'
line hashes travel to the shards instead (salted copies of each shard, so that a
frequent line doesn't gather in one task), and the hashes to drop come back by
document.

Null and empty texts are one empty line.  Rows of one doc_id count as one document;
a null doc_id sorts after all others and counts as the document 2^63 - 1.  Ties can't arise, other columns pass through
line_dedup() unread.  An empty table gives no rows.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import SPACE, as_bytes, cut, small_batches

MIN_CHARS = 10
SHARD_KEYS = 200_000
BROADCAST_BYTES = 48_000_000
SALTS = 16
#: Bytes that a key costs in the arrays and the hash.
KEY_BYTES = 29
LAST_DOC = np.iinfo(np.int64).max
STRIPPED = SPACE.encode()


def key_hash(line: bytes) -> bytes | None:
    """128 bits of the line's key; None for keys that are too short to drop."""
    key = line.strip(STRIPPED).lower()
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS):
        return None
    return xxhash.xxh3_128_digest(key)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n-1 for n distinct 64-bit keys: levels of bit arrays that keep the keys without collisions, the rest one level on."""

    GAMMA, LEVELS = 1.5, 40

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []  # packed bits, rank before each byte, first slot
        first, left = 0, keys
        for level in range(self.LEVELS):
            if not len(left):
                break
            m = -(-max(64, int(self.GAMMA * len(left))) // 8) * 8
            at = mixed(left, level) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            bits = np.packbits(alone)
            rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]])
            self.levels.append((bits, rank.astype(np.uint32), first))
            first += int(alone.sum())
            left = left[~alone[at.astype(np.int64)]]
        self.rest, self.first_rest = np.sort(left), first

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots; for other keys any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, rank, first) in enumerate(self.levels):
            at = mixed(keys[open_], level) % np.uint64(len(bits) * 8)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)
            hit = (bits[byte] >> (np.uint8(7) - bit)) & np.uint8(1) == 1
            before = np.bitwise_count(bits[byte] >> (np.uint8(8) - bit).astype(np.uint16).clip(0, 8).astype(np.uint8)).astype(np.int64)
            before[bit == 0] = 0
            out[open_[hit]] = first + rank[byte[hit]] + before[hit]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            i = np.searchsorted(self.rest, keys[open_]).clip(max=len(self.rest) - 1)
            out[open_] = np.where(self.rest[i] == keys[open_], self.first_rest + i, -1)
        return out


class Shard:
    def __init__(self, low: np.ndarray, high: np.ndarray, count: np.ndarray, first: np.ndarray):
        self.hash = PerfectHash(low)
        at = self.hash.slots(low)
        self.fingerprint, self.count, self.first = np.zeros(len(low), np.uint64), np.zeros(len(low), np.uint32), np.zeros(len(low), np.int64)
        self.fingerprint[at], self.count[at], self.first[at] = high, count.clip(max=2**32 - 1), first

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.hash.__dict__, self.fingerprint, self.count, self.first))

    @classmethod
    def from_bytes(cls, blob: bytes) -> "Shard":
        out = cls.__new__(cls)
        out.hash = PerfectHash.__new__(PerfectHash)
        out.hash.__dict__, out.fingerprint, out.count, out.first = pickle.loads(blob)
        return out

    def dropped(self, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a line of that hash in that document stands in an earlier document too."""
        if not len(self.first):
            return np.zeros(len(low), bool)
        at = self.hash.slots(low)
        return (at >= 0) & (self.fingerprint[at] == high) & (self.count[at] > 1) & (self.first[at] != doc)


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return x[:, 0].copy(), x[:, 1].copy()


def docs_of(column: pa.Array) -> np.ndarray:
    return np.array(pc.fill_null(column.cast(pa.int64()), int(LAST_DOC)))


def line_hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hash, doc and row (the text's hash) of each distinct key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, docs, rows = [], [], []
            for doc, text in zip(docs_of(b.column(0)).tolist(), as_bytes(b.column(1)), strict=True):
                own = {h for x in text.split(b"\n") if (h := key_hash(x))}
                hashes += own
                docs += [doc] * len(own)
                rows += [signed64(text)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(docs, pa.int64()), pa.array(rows, pa.int64())], names=["hash", "doc", "row"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "hash binary, doc long, row long")


def shard_of(n: int) -> F.Column:
    return F.pmod(F.xxhash64("hash"), F.lit(n)).cast("int")


def build_index(df: DataFrame, id_col: str, text_col: str, shard_keys: int) -> tuple[DataFrame, int, int]:
    """(shard, blob) of the hashes of two or more documents; the number of shards and of hashes."""
    seen = line_hashes(df, id_col, text_col).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    repeated = cut(seen.where("first <> last").select("hash", "n", "first"))
    keys = repeated.count()
    shards = max(1, -(-keys // shard_keys))

    def build(key, frame):
        import pandas as pd

        low, high = halves(frame["hash"].tolist())
        return pd.DataFrame({"shard": [key[0]], "blob": [Shard(low, high, frame["n"].to_numpy(), frame["first"].to_numpy()).to_bytes()]})

    return repeated.withColumn("shard", shard_of(shards)).groupBy("shard").applyInPandas(build, "shard int, blob binary"), shards, keys


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with its texts deduplicated, and line_dedup_lines and line_dedup_dropped, the numbers of lines before and dropped."""
    spark = small_batches(df).sparkSession
    index, shards, keys = build_index(df, id_col, text_col, shard_keys)
    names, schema = df.columns, df.schema
    i, t = names.index(id_col), names.index(text_col)
    small = keys * KEY_BYTES <= broadcast_bytes
    if small:
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.collect()})
        source = df
    else:
        sent = None
        # By id and text: rows without an id, or of one id, have sets of their own.
        same = (F.coalesce(df[id_col].cast("long"), F.lit(int(LAST_DOC))) == F.col("_drop_doc")) & (F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))) == F.col("_drop_row"))
        source = df.join(to_drop(df, index, shards, id_col, text_col), same, "left").drop("_drop_doc", "_drop_row")
    open_shards: dict = {}

    def drops(hashes: list[bytes], docs: np.ndarray) -> np.ndarray:
        if not open_shards:
            open_shards.update({k: Shard.from_bytes(v) for k, v in sent.value.items()})
        low, high = halves(hashes)
        out = np.zeros(len(hashes), bool)
        where = np.array([signed64(h) % shards for h in hashes])
        for k, shard in open_shards.items():
            own = np.nonzero(where == k)[0]
            out[own] = shard.dropped(low[own], high[own], docs[own])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = docs_of(b.column(i))
            lines = [x.split(b"\n") for x in as_bytes(b.column(t))]
            places, hashes = [], []
            for d, own in enumerate(lines):
                for k, x in enumerate(own):
                    if h := key_hash(x):
                        places.append((d, k))
                        hashes.append(h)
            if not hashes:
                bad = []
            elif small:
                bad = [places[x] for x in np.nonzero(drops(hashes, docs[[d for d, _ in places]]))[0]]
            else:
                gone = [set(x or ()) for x in b.column(len(names)).to_pylist()]
                bad = [p for p, h in zip(places, hashes, strict=True) if h in gone[p[0]]]
            dropped = np.zeros(len(lines), np.int64)
            for d, k in bad:
                lines[d][k] = None
                dropped[d] += 1
            texts = pa.array([b"\n".join(x for x in own if x is not None) for own in lines], pa.binary()).cast(pa.string())
            columns = [texts if c == t else b.column(c) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in lines], pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "line_dedup_lines", "line_dedup_dropped"])

    from pyspark.sql.types import LongType, StructType

    out = StructType(list(schema.fields)).add("line_dedup_lines", LongType()).add("line_dedup_dropped", LongType())
    return source.mapInArrow(run, out)


def signed64(h: bytes) -> int:
    """Spark's xxhash64 of a binary column: XXH64 with seed 42, as a signed long."""
    x = xxhash.xxh64_intdigest(h, 42)
    return x - 2**64 if x >= 2**63 else x


def to_drop(df: DataFrame, index: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    """_drop_doc, _drop_row and the hashes that they lose: hashes probe the shard that they are sent to."""
    asked = line_hashes(df, id_col, text_col).select(shard_of(shards).alias("shard"), F.pmod(F.xxhash64("doc", "row"), F.lit(SALTS)).cast("int").alias("salt"), "hash", "doc", "row", F.lit(None).cast("binary").alias("blob"))
    copies = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("binary").alias("hash"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("row"), "blob")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for b in batches:
            rows = [(r["shard"], r["hash"], r["doc"], r["blob"], r["row"]) for r in b.to_pylist()]
            hit: list[tuple[bytes, int, int]] = []
            k = 0
            while k < len(rows):
                if rows[k][3] is not None:
                    at, shard = rows[k][0], Shard.from_bytes(rows[k][3])
                    k += 1
                    continue
                e = k
                while e < len(rows) and rows[e][3] is None and rows[e][0] == rows[k][0]:
                    e += 1
                if rows[k][0] == at:
                    own = rows[k:e]
                    low, high = halves([x[1] for x in own])
                    bad = shard.dropped(low, high, np.array([x[2] for x in own], np.int64))
                    hit += [(x[1], x[2], x[4]) for x, y in zip(own, bad, strict=True) if y]
                k = e
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in hit], pa.int64()), pa.array([x[2] for x in hit], pa.int64()), pa.array([x[0] for x in hit], pa.binary())], names=["_drop_doc", "_drop_row", "hash"])

    sent = copies.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())
    return sent.mapInArrow(probe, "_drop_doc long, _drop_row long, hash binary").groupBy("_drop_doc", "_drop_row").agg(F.collect_set("hash").alias("_drop_hashes"))


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("line_dedup_lines").alias("n_lines"), F.col("line_dedup_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
