"""SentencePiece encoding and decoding with seeded merge-dropout.

Byte-pair pieces are merged as the agenda of a SentencePiece model would: always the
waiting pair whose merged piece has the best score, leftmost among equals.  With
dropout, the candidate that comes up t-th in a unit's agenda is skipped for good if a
keyed hash of (seed, document, place of the unit in the text, t) falls below the rate.
One seed always gives one segmentation; each occurrence of a word has its own.  All of
them decode to the same text, byte for byte.

Pieces don't cross from a letter to a following space, and characters that are in no
piece become byte pieces that never merge; so a text falls into units (spaces and what
follows them, split at line feeds) that are segmented on their own.

What is remembered is the agenda, not the outcome of an occurrence: a unit has a tree
whose root is the run without skips (its number of candidates and its pieces) and whose
child t is the run that skips candidate t as well.  An occurrence draws its hashes
candidate by candidate, moves to a child at each skip, and ends where no candidate is
left; runs that aren't known yet are made for all occurrences of a slice together in
numpy.  Units of more than WIDE symbols go through a heap, one occurrence at a time.

Null text counts as empty: no pieces, decoded as empty.  The space mark itself, and
every character that is not a piece, is written in byte pieces.  Rows of one id have one
segmentation, unless turn_col tells them apart.  Very long texts and units cost n log n.
Rows stay rows; an empty table gives no rows.
"""

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import as_bytes, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SPACE = "▁"
#: Units of more symbols go through the heap; the candidates of WIDE symbols fit in 64 bits.
WIDE = 20
TABLE_BITS = 18
#: Runs that are remembered; those of little use go when there are more.
KEEP_RUNS = 350_000
#: Bytes of text that are encoded together, one text at least.
SLICE = 2_000_000


class Model:
    """Pieces, byte pieces and the table of merges of a SentencePiece model file."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special}
        # Piece of rank r has the r-th best score; ties in score go to the smaller id.
        order = sorted(self.id.values(), key=lambda i: (-sp.get_score(i), i))
        # Numbers of pieces and ranks are kept as narrow as they fit: the agendas of many units are worked on at once.
        self.kind = np.int16 if n < np.iinfo(np.int16).max else np.int32
        self.rank = np.full(n, np.iinfo(self.kind).max, self.kind)
        self.rank[order] = np.arange(len(order), dtype=self.kind)
        pairs = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * 65536 + b] = i
        self.pairs = pairs
        self.raw: list[bytes] = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self._table()
        # Piece of each character of the basic plane, -1 where it takes byte pieces.
        self.single = np.full(65536, -1, self.kind)
        for p, i in self.id.items():
            if len(p) == 1 and ord(p) < 65536:
                self.single[ord(p)] = i
        self.single[32], self.single[ord(SPACE)] = self.id[SPACE], -1

    def _table(self) -> None:
        """Open addressing: the pair's key and merged piece, found in a few probes for all pairs at once."""
        size = 1 << TABLE_BITS
        keys, values = np.full(size, -1, np.int64), np.full(size, -1, self.kind)
        left = np.array(list(self.pairs), np.int64)
        merged = np.array(list(self.pairs.values()), self.kind)
        self.probes = 0
        while len(left):
            at = self._slot(left, self.probes)
            free = keys[at] == -1
            # The last of those that want one slot gets it.
            keys[at[free]], values[at[free]] = left[free], merged[free]
            open_ = keys[at] != left
            left, merged = left[open_], merged[open_]
            self.probes += 1
        self.keys, self.values = keys, values

    @staticmethod
    def _slot(key: np.ndarray, probe: int) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(64 - TABLE_BITS)).astype(np.int64) + probe * 7919) & ((1 << TABLE_BITS) - 1)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, -1 for none."""
        # Pieces number fewer than 65,535, so -1 on either side gives no pair's key.
        key = a.astype(np.int64) * 65536 + b
        at = self._slot(key, 0)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], self.kind(-1))
        todo = np.nonzero((found != key) & (found != -1))
        for probe in range(1, self.probes):
            if not len(todo[0]):
                break
            own = key[todo]
            at = self._slot(own, probe)
            found = self.keys[at]
            hit = found == own
            out[tuple(x[hit] for x in todo)] = self.values[at[hit]]
            open_ = ~hit & (found != -1)
            todo = tuple(x[open_] for x in todo)
        return out

    def symbols(self, unit: bytes) -> list[int]:
        """A unit's characters as pieces, or as byte pieces if they are none; spaces as the mark."""
        out = []
        for c in unit.decode("utf-8", "surrogatepass"):
            i = self.id.get(SPACE if c == " " else c) if c != SPACE else None
            out += [self.byte[x] for x in c.encode("utf-8", "surrogatepass")] if i is None else [i]
        return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def unit_keys(doc: int, n: int) -> np.ndarray:
    """A key for each of a document's n units."""
    return mix(np.uint64(doc) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def skipped(key: np.ndarray, eight: int, rate: float) -> np.ndarray:
    """For each unit's key, whether its candidates 8 * eight to 8 * eight + 7 are left out: 16 bits of a hash each."""
    words = np.empty((len(key), 2), "<u8")
    for k in (0, 1):
        words[:, k] = mix(key + np.uint64((2 * eight + k) * 0xA24BAED4963EE407 % 2**64))
    return words.view("<u2") < min(round(rate * 65536), 65535)


def segment_long(model: Model, symbols: list[int], key: int, rate: float) -> list[int]:
    """Agenda with a heap of (rank, place)."""
    n = len(symbols)
    ids, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and (m := model.pairs.get(ids[i] * 65536 + ids[j])) is not None:
            heapq.heappush(heap, (int(model.rank[m]), i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    t, bad, one = 0, [], np.array([key], np.uint64)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        if rate:
            if t % 8 == 0:
                bad = skipped(one, t // 8, rate)[0].tolist()
            t += 1
            if bad[(t - 1) % 8]:
                continue
        ids[i], ids[j] = model.pairs[a * 65536 + b], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [x for x in ids if x >= 0]


def segment_short(model: Model, rows: np.ndarray, masks: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The same agenda for many units at once, one row of symbols each: each round takes the best candidate of every unit, which is skipped if its bit of the mask is set.

    Pieces and number of candidates of each.
    """
    n, width = rows.shape
    none = model.kind(np.iinfo(model.kind).max)
    done: list[bytes] = [b""] * n
    count = np.zeros(n, np.int64)
    left = masks.astype(np.uint64)
    ids = np.full((n, width + 1), -1, model.kind)  # a last column that is never a piece
    ids[:, :-1] = rows
    cand = model.merge(ids[:, :-1], ids[:, 1:])
    rank = np.where(cand >= 0, model.rank[cand], none)
    at, line, columns = np.arange(n), np.arange(n), np.arange(width, dtype=np.int8)

    def finish(rows: np.ndarray) -> None:
        own = ids[rows]
        sizes = (own >= 0).sum(1)
        flat, ends = own[own >= 0].astype(np.int32).tobytes(), (4 * np.cumsum(sizes)).tolist()
        for k, a, z in zip(at[rows].tolist(), [0, *ends[:-1]], ends, strict=True):
            done[k] = flat[a:z]

    while len(at):
        best = rank.argmin(1)
        open_ = rank[line, best] != none
        if 4 * np.count_nonzero(open_) < 3 * len(at) or not open_.any():
            finish(np.nonzero(~open_)[0])
            at, ids, cand, rank, best, left = at[open_], ids[open_], cand[open_], rank[open_], best[open_], left[open_]
            line, open_ = np.arange(len(at)), np.ones(len(at), bool)
        count[at] += open_
        skip = open_ & ((left & np.uint64(1)) > 0)
        left >>= np.uint64(1)
        rank[line[skip], best[skip]] = none
        r = np.nonzero(open_ & ~skip)[0]
        b = best[r]
        new = cand[r, b]
        # What is right of the merged pair moves one to the left; rows without a merge stay as they are.
        place = np.full(len(at), width, np.int8)
        place[r] = b
        beyond = columns > place[:, None]
        ids[:, :-1] = np.where(beyond, ids[:, 1:], ids[:, :-1])
        ids[r, b] = new
        for x in (cand, rank):
            x[:, :-1] = np.where(beyond[:, :-1], x[:, 1:], x[:, :-1])
        # Then the two candidates at the new piece.
        i, j = np.concatenate([r[b > 0], r]), np.concatenate([b[b > 0] - 1, b])
        m = model.merge(ids[i, j], ids[i, j + 1])
        cand[i, j] = m
        rank[i, j] = np.where(m >= 0, model.rank[m], none)
    return done, count


UNIT = re.compile(rb"\n| *[^ \n]+| +")


def units_of(text: bytes) -> list[bytes]:
    """The text, with the space that the model puts in front, in units that no piece crosses."""
    return UNIT.findall(b" " + text) if text else []


class Encoder:
    """Runs of units by number: the unit, the mask of skipped candidates, how many candidates came up, the pieces, the uses."""

    def __init__(self, model: Model, seed: int = 0, rate: float = DROPOUT, keep: int = KEEP_RUNS):
        self.model, self.seed, self.rate, self.keep = model, seed, rate, keep
        self.root: dict[bytes, int] = {}
        self.child: dict[int, int] = {}
        self.units: list[bytes] = []
        self.pieces: list[bytes] = []
        self.mask, self.steps, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def matrix(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many units, one row each, -1 behind them; which units are of another kind (characters that are no pieces, or many)."""
        raw = np.frombuffer(b"".join(units), np.uint8)
        ends = np.cumsum([len(u) for u in units])
        lengths = np.add.reduceat((raw & 0xC0 != 0x80).astype(np.int64), np.concatenate([[0], ends[:-1]]))
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        ids = self.model.single[np.minimum(points, 65535)]
        ids[points >= 65536] = -1
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        other = (np.minimum.reduceat(ids, first) < 0) | (lengths > WIDE)
        width = int(lengths[~other].max(initial=1))
        row = np.repeat(np.arange(len(units)), lengths)
        col = np.arange(len(points)) - np.repeat(first, lengths)
        out = np.full((len(units), width), -1, self.model.kind)
        fits = ~other[row]
        out[row[fits], col[fits]] = ids[fits]
        return out, other

    def add(self, units: list[bytes], masks: np.ndarray) -> int:
        """Make the runs of these units with these skips; the number of the first.  A run of a unit that is too wide has -1 candidates."""
        base, n = len(self.units), len(units)
        pieces: list[bytes] = [b""] * n
        steps = np.full(n, -1, np.int64)
        order = np.argsort(np.fromiter(map(len, units), np.int64, n), kind="stable").tolist()
        for i in range(0, n, 8192):
            part = order[i : i + 8192]
            ids, other = self.matrix([units[k] for k in part])
            where = np.array(part)
            plain = np.nonzero(~other)[0]
            sets = [(where[plain], ids[plain])] if len(plain) else []
            for k in np.nonzero(other)[0].tolist():
                symbols = self.model.symbols(units[part[k]])
                if len(symbols) <= WIDE:
                    sets.append((where[k : k + 1], np.array([symbols], self.model.kind)))
            for own, rows in sets:
                found, steps[own] = segment_short(self.model, rows, masks[own])
                for k, x in zip(own.tolist(), found, strict=True):
                    pieces[k] = x
        self.units += units
        self.pieces += pieces
        self.mask, self.steps = np.concatenate([self.mask, masks]), np.concatenate([self.steps, steps])
        self.uses = np.concatenate([self.uses, np.zeros(n, np.int64)])
        return base

    def forget(self) -> None:
        """Keep the runs that were used at least twice since the last time; a run is used as often as its children or more."""
        least = 2
        while (stay := self.uses >= least).sum() > self.keep // 2:
            least *= 2
        number = (np.cumsum(stay) - 1).tolist()
        kept = np.nonzero(stay)[0].tolist()
        ok = stay.tolist()
        self.root = {u: number[k] for u, k in self.root.items() if ok[k]}
        self.child = {number[k >> 6] << 6 | (k & 63): number[v] for k, v in self.child.items() if ok[v]}
        self.units, self.pieces = [self.units[k] for k in kept], [self.pieces[k] for k in kept]
        self.mask, self.steps, self.uses = self.mask[stay], self.steps[stay], np.zeros(len(kept), np.int64)

    def runs_of(self, units: list[bytes], keys: np.ndarray) -> np.ndarray:
        """The number of the run of each occurrence."""
        run = np.fromiter(map(self.root.get, units, repeat(-1)), np.int64, len(units))
        holes = np.nonzero(run < 0)[0].tolist()
        if holes:
            new = list(dict.fromkeys([units[k] for k in holes]))
            base = self.add(new, np.zeros(len(new), np.uint64))
            self.root.update(zip(new, range(base, base + len(new)), strict=True))
            run[holes] = [self.root[units[k]] for k in holes]
        self.uses += np.bincount(run, minlength=len(self.uses))
        if not self.rate:
            return run
        open_, t = np.nonzero(self.steps[run] > 0)[0], np.zeros(len(run), np.int64)
        while len(open_):
            hits = []
            first, last = t[open_], self.steps[run[open_]]
            at, eight = open_, 0
            while len(at):
                place = np.arange(8 * eight, 8 * eight + 8, dtype=np.int8)
                bad = skipped(keys[at], eight, self.rate)
                bad &= place < last.astype(np.int8)[:, None]
                if open_ is not at or first.any():
                    bad &= place >= first.astype(np.int8)[:, None]
                hit = bad.any(1)
                if hit.any():
                    hits.append(at[hit])
                    t[at[hit]] = 8 * eight + bad[hit].argmax(1)
                eight += 1
                stay = ~hit & (last > 8 * eight)
                at, first, last = at[stay], first[stay], last[stay]
            if not hits:
                break
            open_ = np.concatenate(hits)
            wanted, which = np.unique(run[open_] << 6 | t[open_], return_inverse=True)
            got = list(map(self.child.get, wanted.tolist()))
            new = [k for k, x in enumerate(got) if x is None]
            if new:
                asked = wanted[new]
                parents = asked >> 6
                base = self.add([self.units[k] for k in parents.tolist()], self.mask[parents] | np.uint64(1) << (asked & 63).astype(np.uint64))
                self.child.update(zip(asked.tolist(), range(base, base + len(new)), strict=True))
                for i, k in enumerate(new):
                    got[k] = base + i
            run[open_] = np.array(got, np.int64)[which]
            self.uses += np.bincount(run[open_], minlength=len(self.uses))
            t[open_] += 1
            open_ = open_[t[open_] < self.steps[run[open_]]]
        return run

    def encode(self, texts: list[bytes], docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts in a row, offsets of the texts in them); docs are the documents' keys."""
        if len(self.units) > self.keep:
            self.forget()
        split = list(map(units_of, texts))
        counts = [len(x) for x in split]
        if not sum(counts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        units = [u for x in split for u in x]
        keys = np.concatenate([unit_keys(d, n) for d, n in zip(docs, counts, strict=True)])
        run = self.runs_of(units, keys)
        used = np.zeros(len(self.units), bool)
        used[run] = True
        distinct = np.nonzero(used)[0]
        u = (np.cumsum(used) - 1)[run]
        blobs = [self.pieces[k] for k in distinct.tolist()]
        for i in np.nonzero(self.steps[run] < 0)[0].tolist():  # units on the heap
            u[i] = len(blobs)
            blobs.append(np.array(segment_long(self.model, self.model.symbols(units[i]), int(keys[i]), self.rate), np.int32).tobytes())
        size = np.array([len(x) // 4 for x in blobs], np.int64)
        flat = np.frombuffer(b"".join(blobs), np.int32)
        first = np.cumsum(size) - size
        n = size[u]
        ends = np.cumsum(n)
        take = np.arange(ends[-1]) - np.repeat(ends - n - first[u], n)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return flat[take], offsets


def doc_key(doc, turn, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{doc}:{turn}", seed % 2**64)


def decode(model: Model, ids) -> bytes:
    """The text of piece ids: their bytes without the space that was put in front."""
    return b"".join(map(model.raw.__getitem__, ids))[1:]


def decode_all(model: Model, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """decode() of many texts' pieces in a row."""
    sizes = np.array([len(x) for x in model.raw], np.int64)
    flat, first = np.frombuffer(b"".join(model.raw), np.uint8), np.cumsum(sizes) - sizes
    n = sizes[ids]
    ends = np.cumsum(n)
    raw = flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - first[ids], n)].tobytes()
    at = np.concatenate([[0], ends])[offsets].tolist()
    return [raw[a + 1 : z] for a, z in zip(at[:-1], at[1:], strict=True)]


def slices(b: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most so many bytes of text (column 1), a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
    first = size = 0
    for i, n in enumerate(sizes):
        if i > first and size + n > most:
            yield b.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield b.slice(first)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, seed: int = 0, rate: float = DROPOUT, with_text: bool = True, turn_col: str | None = None, keep_runs: int = KEEP_RUNS, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, pieces (array of piece ids), lossless (they decode to the text) and, if asked for, decoded of each row."""
    spark = small_batches(df).sparkSession
    model = spark.sparkContext.broadcast(Model(model_path).__dict__)  # a fixed vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.__dict__.update(model.value)
        encoder = Encoder(m, seed, rate, keep_runs)
        for whole in batches:
            for b in slices(whole, slice_bytes):
                texts = as_bytes(b.column(1))
                keys = [doc_key(i, k, seed) for i, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
                ids, offsets = encoder.encode(texts, keys)
                decoded = decode_all(m, ids, offsets)
                pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                out = {"doc_id": b.column(0), "pieces": pieces, "lossless": pa.array([x == y for x, y in zip(texts, decoded, strict=True)], pa.bool_())}
                if with_text:
                    out["decoded"] = pa.array(decoded, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), (F.col(turn_col) if turn_col else F.lit(0)).cast("long")).mapInArrow(run, "doc_id long, pieces array<int>, lossless boolean" + ", decoded string" * with_text)


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join("pieces", ","), 256).alias("pieces_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
