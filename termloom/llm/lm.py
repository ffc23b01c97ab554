"""Language-model scoring with a gated recurrent network.

Counts: every training document's tokens (words in lower case A-Z, then one end) are
counted in full; the add-one unigram of them is the base score.

Model: a gated recurrent unit over the SHORT most frequent tokens, everything else
being one input and one output symbol.  The output is factored: a softmax over classes
of tokens of like frequency, then one over the class's members.  A token outside the
short list gets the symbol's probability times its share among such tokens in the
unigram, so that the probabilities of all texts sum to one.  A whole document is
scored in one sweep; the state is carried from window to window from its first token
to its end.

Training: one pass over every token of every training document.  Documents are dealt
to rounds and tasks, each of which lays its own one after another in lanes and runs
truncated backpropagation over all their chunks: the state is carried from CHUNK tokens
to the next through the whole document and starts anew with each, the gradient stays in
the chunk.  After each round the tasks' weights are averaged by tokens and sent out
again.  What is gathered - counts and ids - grows with the corpus.

Frequent tokens are looked up in a list of bounded length; the others are joined with
the counts.  Null and empty texts are the end alone.  A null doc_id counts as the text
"".  Repeated rows are rows of their own, other columns are not read.  Without training
documents every token has probability one in the base, as its formula says.
"""

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import as_bytes, cut, small_batches

FOLDS, HELD_OUT = 7, 2
END = b"\n"  # no word holds white space
HEAD = 100_000  # tokens whose counts are sent out
CLASSES, MEMBERS, HIDDEN = 32, 64, 16
SHORT = CLASSES * MEMBERS
CHUNK = 16
RATES = (0.02, 0.02, 0.01, 0.005)  # of each round
#: Tokens that a task takes: less where that leaves fewer than SOME_TASKS.
TOKENS_A_TASK, LEAST_TOKENS, SOME_TASKS, MOST_TASKS = 8_000_000, 500_000, 8, 4096
#: Lanes side by side: as many as leave UPDATES steps, within these bounds.
LANES, UPDATES = (16, 1024), 150
#: States that are held before their probabilities are worked out.
STATES = 65_536
NAMES = ("emb", "wx", "wh", "b", "wc", "bc", "wm", "bm")


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def count_tokens(rows: DataFrame) -> DataFrame:
    """(word, c) over the training documents of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return b

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if not held_out(doc):
                    held.update(tokens(text))
                if len(held) > 400_000:
                    yield out()
        if held:
            yield out()

    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The tokens of the highest counts, at most `most`, most frequent first.

    A histogram over steps of the logarithm gives the least count, so that no task sends
    more than its share of the list.
    """
    step = F.floor(F.log2("c") * 16)
    taken, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["step"]):
        if taken + r["n"] > most:
            break
        taken, least = taken + r["n"], r["c"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))


def start_params(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of a model that starts out as the unigram of the short list's counts."""
    rng = np.random.default_rng(1)
    w = lambda *s: (rng.standard_normal(s) * 0.08).astype(np.float32)
    p = (np.maximum(counts, 1e-6) / np.maximum(counts, 1e-6).sum()).reshape(CLASSES, MEMBERS)
    bc, bm = np.log(p.sum(1)), np.log(p / p.sum(1, keepdims=True))
    return {"emb": w(SHORT, HIDDEN) * 4, "wx": w(HIDDEN, 3 * HIDDEN) * 3, "wh": w(HIDDEN, 3 * HIDDEN) * 3, "b": np.zeros(3 * HIDDEN, np.float32), "wc": w(HIDDEN, CLASSES), "bc": bc.astype(np.float32), "wm": w(CLASSES, HIDDEN, MEMBERS), "bm": bm.astype(np.float32)}


def pack(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in NAMES]).astype(np.float32).tobytes()


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in NAMES:
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(xw: np.ndarray, h: np.ndarray, wh: np.ndarray) -> np.ndarray:
    """The states (unit, document) after one step from input projections xw."""
    n = HIDDEN
    u = wh @ h
    zr = sigmoid(xw[: 2 * n] + u[: 2 * n])
    c = zr[n:] * u[2 * n :]
    c += xw[2 * n :]
    np.tanh(c, out=c)
    return c + zr[:n] * (h - c)


def log_probs(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after state h (unit, token): its class, then the member."""
    cls, member = target.astype(np.int64) // MEMBERS, target.astype(np.int64) % MEMBERS
    order = np.argsort(cls.astype(np.int16), kind="stable")
    h, cls, member = h[:, order], cls[order], member[order]
    every = np.arange(len(cls))

    def log_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        x -= x.max(0)
        own = x[at, every[: len(at)]]
        np.exp(x, out=x)
        return own - np.log(x.sum(0))

    found = log_of(p["wc"].T @ h + p["bc"][:, None], cls).astype(np.float64)
    ends = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    for c, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a < z:
            found[a:z] += log_of(p["wm"][c].T @ h[:, a:z] + p["bm"][c][:, None], member[a:z])
    out = np.empty(len(cls))
    out[order] = found
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    """In place, over the first axis."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, target: np.ndarray, mask: np.ndarray, h: np.ndarray, with_loss: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients over one chunk (time, lane) from states h (unit, lane), the states after it, the summed loss if asked for.

    Features come first and lanes last throughout, so that every step works on long rows.
    """
    n, kind = HIDDEN, p["wh"].dtype
    steps, width = ids.shape
    g = {k: np.zeros_like(p[k]) for k in ("wm", "bm")}
    wh = np.ascontiguousarray(p["wh"].T)
    xw = np.take(np.ascontiguousarray((p["emb"] @ p["wx"] + p["b"]).T), ids, axis=1)
    hs, zrs, cs, us = (np.empty((steps + more, k, width), kind) for more, k in ((1, n), (0, 2 * n), (0, n), (0, n)))
    hs[0] = h
    for t in range(steps):
        u = wh @ hs[t]
        zr, c = zrs[t], cs[t]
        np.add(xw[: 2 * n, t], u[: 2 * n], out=zr)
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        us[t] = u[2 * n :]
        np.multiply(zr[n:], us[t], out=c)
        c += xw[2 * n :, t]
        np.tanh(c, out=c)
        hs[t + 1] = c + zr[:n] * (hs[t] - c)
    # Tokens in order of their class, so that a class's are one slice.
    y = target.ravel()
    at = np.nonzero(mask.ravel() > 0)[0]
    at = at[np.argsort((y[at] // MEMBERS).astype(np.int16), kind="stable")]
    cls, member = y[at] // MEMBERS, y[at] % MEMBERS
    own = hs[1:].transpose(1, 0, 2).reshape(n, -1)[:, at]
    every = np.arange(len(at))
    d = softmax(p["wc"].T @ own + p["bc"][:, None])
    loss = float(np.log(d[cls, every]).sum()) if with_loss else 0.0
    d[cls, every] -= 1
    g["wc"], g["bc"], dh = own @ d.T, d.sum(1), p["wc"] @ d
    ends = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    for c, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a == z:
            continue
        d = softmax(p["wm"][c].T @ own[:, a:z] + p["bm"][c][:, None])
        if with_loss:
            loss += float(np.log(d[member[a:z], every[: z - a]]).sum())
        d[member[a:z], every[: z - a]] -= 1
        g["wm"][c], g["bm"][c] = own[:, a:z] @ d.T, d.sum(1)
        dh[:, a:z] += p["wm"][c] @ d
    dhs = np.zeros((n, steps * width), kind)
    dhs[:, at] = dh
    dhs = dhs.reshape(n, steps, width)
    dxw, carry, dus = np.empty_like(xw), np.zeros((n, width), kind), np.empty((steps, 3 * n, width), kind)
    for t in reversed(range(steps)):
        z, r, c, du = zrs[t, :n], zrs[t, n:], cs[t], dus[t]
        out = dhs[:, t] + carry
        dc = out * (1 - z)
        dc *= 1 - c * c
        np.multiply(out * (hs[t] - c), z * (1 - z), out=du[:n])
        np.multiply(dc * us[t], r * (1 - r), out=du[n : 2 * n])
        np.multiply(dc, r, out=du[2 * n :])
        dxw[: 2 * n, t] = du[: 2 * n]
        dxw[2 * n :, t] = dc
        carry = p["wh"] @ du
        out *= z
        carry += out
    g["wh"] = np.matmul(hs[:-1], dus.transpose(0, 2, 1)).sum(0)
    # Sum what falls on each input symbol, then go through its embedding once.
    symbols = ids.ravel().astype(np.int16)
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.concatenate([[0], np.nonzero(symbols[1:] != symbols[:-1])[0] + 1])
    table = np.zeros((3 * n, SHORT), kind)
    table[:, symbols[first]] = np.add.reduceat(np.take(dxw.reshape(3 * n, -1), order, axis=1), first, axis=1)
    g["b"], g["wx"], g["emb"] = table.sum(1), (table @ p["emb"]).T, table.T @ p["wx"].T
    return g, hs[steps], -loss


def lanes_of(docs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets (lane, chunk, CHUNK; -1 behind a document's end) of whole documents laid one after another in lanes, longest lane first, and which chunks begin a document."""
    lanes: list[list[np.ndarray]] = [[] for _ in range(min(most, len(docs)))]
    load = [(0, i) for i in range(len(lanes))]
    for d in docs:
        n, i = heapq.heappop(load)
        lanes[i].append(d)
        heapq.heappush(load, (n - (1 - len(d)) // CHUNK, i))
    order = sorted(load, reverse=True)
    ids = np.full((len(lanes), order[0][0], CHUNK), -1, np.int16)
    target, first = ids.copy(), np.zeros(ids.shape[:2], bool)
    for row, (_, i) in enumerate(order):
        at = 0
        for d in lanes[i]:
            n = -((1 - len(d)) // CHUNK)
            for out, x in ((ids, d[:-1]), (target, d[1:])):
                out[row, at : at + n].reshape(-1)[: len(x)] = x
            first[row, at] = True
            at += n
    return ids, target, first


def train(p: dict[str, np.ndarray], docs: list[np.ndarray], rate: float, batch: int | None = None) -> dict[str, np.ndarray]:
    """Adam over the chunks of whole documents (END, tokens, END), the state carried from each document's start to its end."""
    p = {k: v.copy() for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    batch = batch or int(np.clip(sum(map(len, docs)) // (CHUNK * UPDATES), *LANES))
    ids, target, first = (np.ascontiguousarray(x.swapaxes(0, 1)) for x in lanes_of(docs, batch))
    h = np.zeros((HIDDEN, ids.shape[1]), np.float32)
    for n in range(1, len(ids) + 1):
        rows = int((target[n - 1, :, 0] >= 0).sum())  # lanes that haven't ended
        h = np.where(first[n - 1, :rows], np.float32(0), h[:, :rows])
        y = np.ascontiguousarray(target[n - 1, :rows].T).astype(np.int64)
        mask = (y >= 0).astype(np.float32)
        g, h, _ = gradients(p, np.maximum(ids[n - 1, :rows].T, 0).astype(np.int64), y, mask, h)
        size = np.float32(1 / max(1.0, mask.sum()))
        fix = np.float32(rate / (1 - 0.9**n)), np.float32(1 / math.sqrt(1 - 0.995**n))
        for k in NAMES:
            d = g[k] * size
            m[k] += np.float32(0.1) * (d - m[k])
            d *= d
            d -= v[k]
            d *= np.float32(0.005)
            v[k] += d
            np.sqrt(v[k], out=d)
            d *= fix[1]
            d += np.float32(1e-6)
            np.divide(m[k], d, out=d)
            d *= fix[0]
            p[k] -= d
    return p


def ids_of(text: bytes, short: dict[bytes, int]) -> bytes:
    """The whole document's short-list ids between two ENDs."""
    return np.fromiter(map(short.get, [END, *tokens(text)], repeat(0)), np.int16).tobytes()


def trained(rows: DataFrame, p: dict[str, np.ndarray], short: dict[bytes, int]) -> dict[str, np.ndarray]:
    spark = rows.sparkSession
    words = spark.sparkContext.broadcast(short)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [ids_of(text, words.value) for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True) if not held_out(doc)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["ids"])

    docs = cut(rows.mapInArrow(collect, "ids binary").withColumn("key", F.xxhash64(F.monotonically_increasing_id())))
    n = docs.agg(F.sum(F.length("ids") / 2)).first()[0]
    if not n:
        return p
    tasks = min(MOST_TASKS, max(-(-int(n) // TOKENS_A_TASK), min(SOME_TASKS, -(-int(n) // LEAST_TOKENS))))
    shards = math.isqrt(tasks - 1) + 1
    for turn, rate in enumerate(RATES):
        own = docs.where(F.pmod(F.shiftrightunsigned("key", 32), F.lit(len(RATES))) == turn)
        dealt = own.select("ids", F.pmod("key", F.lit(tasks)).cast("int").alias("task")).repartition(tasks, "task")
        sent = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            own, key, size, waiting, held = sent.value, 0, 0, 0, []

            def learn() -> None:
                nonlocal own, waiting
                own = train(own, [np.frombuffer(x, np.int16) for x in held], rate)
                held.clear()
                waiting = 0

            for b in batches:
                if b.num_rows:
                    key = b.column(1)[0].as_py()
                    for x in b.column(0).to_pylist():
                        held.append(x)
                        size += len(x) // 2
                        waiting += len(x) // 2
                        if waiting >= 2 * TOKENS_A_TASK:
                            learn()
            if held:
                learn()
            if size:
                yield pa.RecordBatch.from_arrays([pa.array([key % shards], pa.int32()), pa.array([float(size)]), pa.array([pack(own)], pa.binary())], names=["shard", "weight", "params"])

        def average(frame):
            total = frame["weight"].sum()
            flat = sum(w * np.frombuffer(x, np.float32).astype(np.float64) for w, x in zip(frame["weight"], frame["params"], strict=True)) / total
            import pandas as pd

            return pd.DataFrame({"weight": [total], "params": [flat.astype(np.float32).tobytes()]})

        got = dealt.mapInArrow(run, "shard int, weight double, params binary").groupBy("shard").applyInPandas(average, "weight double, params binary").collect()
        total = sum(r["weight"] for r in got)
        if not got:
            continue
        p = unpack(sum(r["weight"] / total * np.frombuffer(r["params"], np.float32).astype(np.float64) for r in got), p)
    return p


class Scorer:
    """Looks tokens up in the head list and runs the model over whole documents."""

    def __init__(self, head: list[tuple[bytes, int]], short: dict[bytes, int], params: dict[str, np.ndarray], total: float):
        self.at = {w: i for i, (w, _) in enumerate(head)}
        self.logs = np.log10((np.array([c for _, c in head], np.float64) + 1) / total)
        self.short = np.array([short.get(w, 0) for w, _ in head], np.int16)
        self.start = short.get(END, 0)
        self.p, self.xw = params, np.ascontiguousarray((params["emb"] @ params["wx"] + params["b"]).T, np.float32)
        self.wh = np.ascontiguousarray(params["wh"].T)

    def neural(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each document's short-list ids; the state carried through it."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        sizes = np.array([len(docs[i]) for i in order])
        flat = np.concatenate([docs[i] for i in order])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = np.zeros(len(docs))
        h = np.zeros((HIDDEN, len(docs)), np.float32)
        before = np.full(len(docs), self.start)
        active = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), side="left")  # documents longer than t
        states, targets, who, held = [], [], [], 0
        every = np.arange(len(docs))
        for t in range(int(sizes[0])):
            n = int(active[t])
            h = step(np.take(self.xw, before[:n], axis=1), np.ascontiguousarray(h[:, :n]), self.wh)
            before = flat[first[:n] + t]
            states.append(h)
            targets.append(before)
            who.append(every[:n])
            held += n
            if held >= STATES or t + 1 == sizes[0]:
                lp = log_probs(self.p, np.concatenate(states, axis=1), np.concatenate(targets))
                out += np.bincount(np.concatenate(who), lp, len(docs))
                states, targets, who, held = [], [], [], 0
        result = np.zeros(len(docs))
        result[order] = out / math.log(10)
        return result


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = small_batches(df).sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = cut(count_tokens(rows))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = float(n + v + 1)
    head = frequent(counts)
    listed = head[: SHORT - 1]
    if all(w != END for w, _ in listed):
        listed = [*listed[: SHORT - 2], *[x for x in head if x[0] == END]]
    short = {w: i + 1 for i, (w, _) in enumerate(listed)}
    outside = max(total - sum(c + 1 for _, c in listed), 1.0)
    p = trained(rows, start_params(np.array([outside, *(c for _, c in listed), *[0] * (SHORT - 1 - len(listed))], np.float64)), short)
    sent = spark.sparkContext.broadcast((head, short, p, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        get = scorer.at.get
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "oov": pa.float64(), "n_oov": pa.int64(), "words": pa.list_(pa.binary()), "counts": pa.list_(pa.int64())}
        docs: list[np.ndarray] = []
        done: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            """Score what has gathered: the more documents at once, the fewer steps."""
            gru, at = scorer.neural(docs) if docs else np.zeros(0), 0
            for x in done:
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(gru[at : at + x.num_rows])], names=[*kinds, "gru"])
                at += x.num_rows
            docs.clear()
            done.clear()

        for b in batches:
            out = {k: [] for k in kinds}
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                ws = tokens(text)
                at = np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws))
                known = at[at >= 0]
                ids = np.zeros(len(ws), np.int16)
                ids[at >= 0] = scorer.short[known]
                docs.append(ids)
                logs = scorer.logs[known]
                tail = Counter(ws[i] for i in np.nonzero(at < 0)[0])
                for k, x in zip(out, (doc, held_out(doc), len(ws), len(known), float(logs.sum()), float(logs[scorer.short[known] == 0].sum()), int((ids == 0).sum()), list(tail), list(tail.values())), strict=True):
                    out[k].append(x)
            done.append(pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for k, x in out.items()], names=list(kinds)))
            if len(docs) >= 8000 or sum(map(len, docs)) >= 6_000_000:
                yield from flush()
        yield from flush()

    scored = cut(rows.mapInArrow(run, "doc_id long, held_out boolean, n long, known long, base double, oov double, n_oov long, words array<binary>, counts array<long>, gru double").withColumn("rid", F.monotonically_increasing_id()))
    tail = scored.select("rid", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.counts").alias("times"))
    found = tail.join(counts, "word", "left").select("rid", (F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(total))).alias("part"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"))
    sums = found.groupBy("rid").agg(F.sum("part").alias("part"), F.sum("known").alias("more"))
    part = F.coalesce("part", F.lit(0.0))
    return scored.drop("words", "counts").join(sums, "rid", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + part).alias("base_score"), (F.col("gru") + F.col("oov") + part - F.col("n_oov") * F.lit(math.log10(outside / total))).alias("score"),
    )
