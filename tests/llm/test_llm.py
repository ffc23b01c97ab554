"""Each operator against a brute-force version, on tables with nulls, empty and long texts, ties, repeated rows, clashing column names, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import by_spark, by_sql
from termloom.llm import chat, html, linededup, lm, mixing, pieces, quality, queries, secrets, simhash, topk

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t ", "one", "one two", "a b c a b c a b c", "same line here\nother text\nsame line here", "SAME line here \nshort\nfresh line number 1", "naïve café – 日本語 🎉 ▁ mark ▁▁x", "x" * 3000, ("alpha beta gamma delta " * 700).strip(), "The quick\r\nbrown\x0bfox\x0cjumps", "tie tie tie"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["s1", "s2", None][i % 3], "clash", i) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "s1", "clash", 3), (None, "SAME line here \nno id on this row", "s2", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, spans string, n_words long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert by_spark(queries.QUERIES[name](spark, SF)) == by_sql(queries.ORACLE_SQL[name], SF)


def test_secrets(spark, docs, none):
    text = 'Token = "abc.def-123"\npassword: ab password: abcdef\n' + "AKIA" + "Z9" * 8 + " " + "0af3" * 8 + '\nbase = "Zx9!kkQpLm27"\ndb_credential = base\ntitle = "Zx9 kkQ pLm27a"\nkſecret=abcdefg'
    found = secrets.find_secrets(text)
    base = [(m.start(), "assign", m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII) if len(m[1]) >= 6]
    base += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted((s, k, e) for k, s, e in found if k != "lexed") == sorted(base)
    assert [text[s:e] for k, s, e in found if k == "lexed"] == ["Zx9!kkQpLm27"]
    got = secrets.digest(secrets.secret_spans(docs)).collect()
    assert len(got) == docs.count() and all(r["spans"] == "" for r in got)
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.secret_spans(none).count() == 0


def test_quality(docs, none):
    got = Counter(tuple(r) for r in quality.quality_metrics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for i, t in plain(docs):
        w = WORD.findall(t)
        three = list(zip(w, w[1:], w[2:], strict=False))
        n = Counter(three)
        covered = {k + j for k, x in enumerate(three) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want
    assert quality.quality_metrics(none).count() == 0 and quality.quality_filter(none).count() == 0


def test_quality_order_by_rejection_per_cost_of_what_is_left():
    seconds = {"a": 1.0, "b": 1.0, "c": 0.1}
    verdicts = [(True, True, False)] * 6 + [(False, True, False)] * 3 + [(False, False, True)] * 1
    assert [x[0] for x in quality.cascade(verdicts, seconds)] == ["c", "b", "a"]
    verdicts = [(True, True, False)] * 6 + [(False, True, False)] * 3 + [(True, False, False)] * 2
    assert [(x[0], x[2]) for x in quality.cascade(verdicts, seconds)] == [("b", 9 / 11), ("a", 1.0), ("c", 0.0)]


def test_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 5000)
    df = spark.createDataFrame([(i, "word " * 400) for i in range(100)], "doc_id long, text string").coalesce(1)
    assert quality.sample_of(df, "text", 500).count() == 2
    assert quality.sample_of(df.limit(0), "text", 500).count() == 0


def test_quality_order_never_changes_the_verdict(docs):
    keep = lambda names: sorted(r["doc_id"] or -1 for r in docs.where(~quality.let(quality.words(F.col("text")), lambda w: quality.rejected(F.col("text"), w, names))).collect())
    names = list(quality.RULES)
    assert keep(names) == keep(names[::-1])


def test_chat(spark):
    said = "</s>[INST] ok [/INST] \\ <|im_end|>\n<|im_start|>user\n"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "system\n", None), (2, 0, "assistant", ""), (None, None, None, None), (3, 5, "assistant", "0 long " * 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df)).collect()}
    turns: dict = {}
    for c, _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "")):
        turns.setdefault(c, []).append((r or "", t or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss))
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_chat_detects_rewriting():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert chat.locate(chat.chatml, turns).rewritten is None
    assert chat.locate(chat.inst, turns).rewritten is None
    found = chat.locate(chat.last_answer, turns)
    assert found.rewritten == 3 and found.text[slice(*found.inner[3])] == "d"


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(400)]
    rows += [(400, rows[3][1]), (401, None), (402, [float("nan")] * 8), (403, [1.0] * 7 + [None]), (None, [1.0] * 8), (450, [1e12] * 8), (500, [2e12] * 8), (404, []), (405, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    v = topk.usable(df, "vec_id", "embedding", 256.0)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.where("id % 50 = 0 and id < 450"), 5, block=3).collect()}
    own = {i: [math.floor(256 * x) for x in e] for i, e in rows if i is not None and e and len(e) == 8 and all(x is not None and math.isfinite(x) for x in e)}
    for q in (i for i in own if i % 50 == 0 and i < 450):
        best = sorted((-sum(a * b for a, b in zip(own[q], x, strict=True)), i) for i, x in own.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_topk_bounds_prune():
    """Under half of the registered vectors' pairs are scored exactly, under a fifth of clustered ones; no find is lost."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, real = np.array(t["vec_id"]), np.floor(256 * np.array(t["embedding"].to_pylist(), dtype=float))
    rng = np.random.default_rng(0)
    clustered = np.floor(np.repeat(rng.standard_normal((20, 64)) * 40, 100, 0) + rng.standard_normal((2000, 64)) * 4)
    for x, at, share in ((real, ids % 50 == 0, 0.5), (clustered, np.arange(2000) % 100 == 0, 0.2)):
        n = int(at.sum()) * len(x)
        seeded = topk.Block(ids[at], x[at], 5, np.arange(64))
        seeded.offer(ids, x)
        b = topk.Block(ids[at], x[at], 5, np.argsort(-x.var(0)), seeded.least)
        assert b.offer(ids, x) < share * n
        assert b.best == seeded.best
        for q, best in zip(np.nonzero(at)[0], b.best, strict=True):
            own = sorted((-int(s), int(i)) for s, i in zip(x @ x[q], ids, strict=True) if i != ids[q])[:5]
            assert best == own


def test_topk_huge_components(spark):
    rows = [(0, [1e10, 3.0]), (50, [1e10, -1.0]), (1, [2e10, 1.5]), (2, [1e200, 1.0]), (3, [-1e200, 1.0]), (4, [1e307, 1.0]), (5, [2.0**45 + 0.5, 0.0]), (6, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.usable(df, "vec_id", "embedding", 256.0)
    own = {i: [int(x * 256 // 1) for x in e] for i, e in rows if i != 4}  # 256e307 is no number
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in (0, 50):
        best = sorted((-clip(sum(a * b for a, b in zip(own[q], x, strict=True))), i) for i, x in own.items() if i != q)[:5]
        got = topk.top_k(v, v.where(F.col("id") == q), 5).orderBy("rank").collect()
        assert [(r["vec_id"], r["score"]) for r in got] == [(i, -s) for s, i in best]


def test_lm(spark, docs, none):
    tok = lambda t: [w.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in WORD.findall(t)] + [b"\n"]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in plain(docs) if not out(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, out(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in plain(docs))
    got = lm.score_documents(docs).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) for r in got)
    assert lm.score_documents(none).count() == 0


def test_lm_beats_the_unigram_on_held_out_documents(spark):
    rows = [(i, " ".join(["le chat la maison"] * 20 if i % 2 else ["the cat a house"] * 20)) for i in range(400)]
    r = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] + 100


def test_lm_gradients():
    rng = np.random.default_rng(0)
    p = {k: x.astype(float) for k, x in lm.start_params(np.arange(lm.SHORT, 0, -1.0)).items()}
    ids, y, mask, h = rng.integers(0, lm.SHORT, (3, 5)), rng.integers(0, lm.SHORT, (3, 5)), np.ones((3, 5)), rng.standard_normal((lm.HIDDEN, 5)) * 0.1
    g = lm.gradients(p, ids, y, mask, h)[0]
    at = {"emb": (ids[0, 1], 3), "wx": (2, 5), "wh": (4, 40), "b": (7,), "wc": (3, 2), "bc": (5,), "wm": (y[0, 2] // lm.MEMBERS, 3, y[0, 2] % lm.MEMBERS), "bm": (y[0, 2] // lm.MEMBERS, y[0, 2] % lm.MEMBERS)}
    for k, i in at.items():
        q = {**p, k: p[k].copy()}
        q[k][i] += 1e-5
        up = lm.gradients(q, ids, y, mask, h, True)[2]
        q[k][i] -= 2e-5
        assert (up - lm.gradients(q, ids, y, mask, h, True)[2]) / 2e-5 == pytest.approx(g[k][i], abs=1e-5)


def test_lm_probabilities_sum_to_one():
    p = lm.start_params(np.arange(lm.SHORT, 0, -1.0))
    h = np.random.default_rng(1).standard_normal((lm.HIDDEN, 1)).astype(np.float32)
    assert np.exp(lm.log_probs(p, np.repeat(h, lm.SHORT, 1), np.arange(lm.SHORT))).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("broadcast_bytes", [10**9, 0])
def test_line_dedup(docs, none, broadcast_bytes):
    big = 2**63 - 1
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    held: dict = {}
    for i, t in plain(docs):
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(big if i is None else i)
    want = Counter()
    for i, t in plain(docs):
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(held[key(x)]) == (big if i is None else i)]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = linededup.line_dedup(docs, shard_keys=2, broadcast_bytes=broadcast_bytes)
    assert got.columns == [*docs.columns, "line_dedup_lines", "line_dedup_dropped"]
    assert Counter(tuple(r) for r in linededup.digest(got).collect()) == want
    assert linededup.line_dedup(none, broadcast_bytes=broadcast_bytes).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    assert sorted(linededup.PerfectHash(keys).slots(keys)) == list(range(len(keys)))


def brute_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash(docs, none):
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    want = {}
    for i, t in plain(docs):
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{x:016x}" for i, x in want.items()}
    assert len(got) == docs.count()
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [50_000, 2])
def test_simhash_links(spark, hot):
    rnd = random.Random(1)
    fps = [0, 2**64 - 1]
    for _ in range(30):
        x = rnd.getrandbits(64)
        fps.append(x)
        for _ in range(6):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3])))
            fps.append(x)
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in fps})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.components(simhash.links(df, hot)).collect()}
    label = brute_components([x % 2**64 for x in fps])
    first = {}
    for x, k in zip(fps, label, strict=True):
        first.setdefault(k, x)
    assert {x: got.get(x, x) for x in fps} == {x: first[k] for x, k in zip(fps, label, strict=True)}


def agenda(m, symbols, key, rate):
    """Plain reading of the rule: of the waiting pairs the best, leftmost; the t-th that comes up is skipped if its hash says so."""
    ids, gone, t = list(symbols), [False] * len(symbols), 0  # gone: the pair at this place was skipped
    while True:
        waiting = [(int(m.rank[m.pairs[a * 65536 + b]]), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a * 65536 + b in m.pairs and not gone[i]]
        if not waiting:
            return ids
        i = min(waiting)[1]
        bad = bool(pieces.skipped(np.array([key], np.uint64), t // 8, rate)[0, t % 8])
        t += 1
        if bad:
            gone[i] = True
        else:
            ids[i : i + 2] = [m.pairs[ids[i] * 65536 + ids[i + 1]]]
            gone[i : i + 2] = [False]
            if i:
                gone[i - 1] = False


def test_pieces(docs, none):
    import sentencepiece

    m = pieces.Model()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for _, t in plain(docs)] + ["  two  spaces ", "\n\n", "a\tb", "x" * 200]
    for rate in (0.0, 0.4):
        e = pieces.Encoder(m, 5, rate)
        ids, at = e.encode([t.encode() for t in texts], list(range(len(texts))))
        assert pieces.decode_all(m, ids, at) == [t.encode() for t in texts]
        for t, a, z in zip(texts, at, at[1:], strict=False):
            own = ids[a:z].tolist()
            assert pieces.decode(m, own) == t.encode()
            if rate == 0 and pieces.SPACE not in t:
                assert own == sp.encode(t)
    keys = lambda seed: [pieces.doc_key(i, 0, seed) for i in range(len(texts))]
    runs = [pieces.Encoder(m, 0, 0.4).encode([t.encode() for t in texts], keys(seed))[0].tolist() for seed in (5, 5, 6)]
    assert runs[0] == runs[1] != runs[2]
    got = pieces.encode_documents(docs)
    assert got.where("lossless").count() == docs.count() and pieces.encode_documents(none).count() == 0


@pytest.mark.parametrize(("rate", "keep"), [(0.1, 10**6), (0.5, 10**6), (0.3, 40)])
def test_pieces_by_brute_force(rate, keep):
    """Every occurrence of every unit by the plain rule; the encoder remembers all runs, or forgets most."""
    m = pieces.Model()
    texts = [(t or "").encode()[:4000] for t in TEXTS] + [b"the same phrase again and again " * 60, b"international " * 50 + b"internationalizationalities " * 3] * 2
    e = pieces.Encoder(m, 1, rate, keep)
    for part in (texts[:6], texts[6:]):
        docs = [pieces.doc_key(i, 3, 1) for i in range(len(part))]
        ids, at = e.encode(part, docs)
        for t, d, a, z in zip(part, docs, at, at[1:], strict=False):
            units = pieces.units_of(t)
            want = [x for u, k in zip(units, pieces.unit_keys(d, len(units)).tolist(), strict=True) for x in agenda(m, m.symbols(u), k, rate)]
            assert ids[a:z].tolist() == want


def test_pieces_vary_between_the_places_of_a_word(spark):
    m = pieces.Model()
    e = pieces.Encoder(m, 0, 0.1)
    text = b"international organisation " * 2000
    ids, at = e.encode([text, text], [pieces.doc_key(i, 0, 0) for i in (1, 2)])
    one, two = ids[at[0] : at[1]].tolist(), ids[at[1] : at[2]].tolist()
    assert one != two and pieces.decode(m, one) == pieces.decode(m, two) == text
    cuts, word = Counter(), []
    for i in one:
        if m.piece[i].startswith(pieces.SPACE) and word:
            cuts[tuple(word)] += 1
            word = []
        word.append(i)
    assert len(cuts) > 8
    df = spark.createDataFrame([(7, text.decode(), k) for k in range(2)], "doc_id long, text string, turn long")
    own = lambda col: {tuple(r["pieces"]) for r in pieces.encode_documents(df, turn_col=col).collect()}
    assert len(own(None)) == 1 and len(own("turn")) == 2


def test_mixing(spark, docs, none):
    rows = [(i, "w " * (1 + i % 7), "big" if i < 300 else f"s{i % 3}" if i < 390 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df, seed=3).collect()
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    by: dict = {}
    for i, _, s in rows:
        by.setdefault(s, []).append(i)
    order = sorted(by, key=lambda s: "" if s is None else "=" + s)
    _, w, budget = mixing.solve([float(sum(size[i] for i in by[s])) for s in order])
    want = Counter()
    for s, share in zip(order, w, strict=True):
        total, quota = sum(size[i] for i in by[s]), max(1, round(budget * share))
        full, rest = divmod(quota, total)
        for i in by[s]:
            want[i] += full
        for i in sorted(by[s], key=lambda i: hashlib.md5(f"3:{full}:{i}".encode()).hexdigest()):
            if rest <= 0:
                break
            want[i] += 1
            rest -= size[i]
    assert Counter(r["doc_id"] for r in got) == want
    assert set(want) == set(size) and max(want.values()) <= 3
    assert {r["doc_id"] for r in mixing.mix(docs).collect()} == {i for i, _ in plain(docs)}
    assert mixing.mix(none).count() == 0


def test_mixing_targets():
    t = [1000.0, 100.0, 10.0]
    e, w, b = mixing.solve(t, max_repeats=2.0)
    assert max(b * x / n for n, x in zip(t, w, strict=True)) == pytest.approx(2, abs=1e-6) and 0 < e < 1
    assert mixing.entropy(mixing.solve(t, None, target_entropy=0.8)[1]) == pytest.approx(0.8, abs=1e-6)


PAGE = '<html><head><title>t</title></head><body><nav><a href=/>home</a></nav><div class="box">Follow us<p>everywhere</p></div>{}<footer>f</footer></body></html>'


def test_html(spark):
    article = "<article><h1>A &amp; B</h1><p>One<b> bold<br><p>two &lt;p&gt;\n x<div class='cookie-notice'>no</div><ul><li>i<li>j</ul><script>1<p></script></article>"
    rows = [(1, "http://h.example/1", PAGE.format(article)), (1, "http://h.example/1", PAGE.format(article)), (2, None, None), (3, "", ""), (4, "x", "plain &eacute;"), (5, "http://k/", "<p>a<p>b")]
    rows += [(10 + i, f"http://t.example/{i}", PAGE.format(f"<div><p>text number {i}</p></div>")) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (10**6, -1):
        got = {r["page_id"]: r["text"] for r in html.extract(df, broadcast_hashes=limit).collect()}
        assert got[1] == "A & B\n\nOne bold\n\ntwo <p> x\n\ni\n\nj"
        assert (got[2], got[3], got[4], got[5]) == ("", "", "plain é", "a\n\nb")
        assert got[12] == "text number 2"
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    body = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{body} {i}\nshared line of text\nown line {i * 7919} here", "en", "s0" if i < 20 else "s1", 0) for i in range(30)]
    rows += [(100, None, "en", "s0", 0), (101, "too short", "en", None, 0), (102, "spam spam " * 200, "en", "s0", 0), (None, " ".join(f"other{i}" for i in range(90)), "en", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r[0] for r in rows} - {100, 101, 102}
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r["doc_id"] for r in docs.collect()}
        if k == 0:
            assert ids == good
        if k == 1:
            assert ids == good and docs.where("text like '%shared line%'").count() == 1
        if k == 2:
            held = {r["doc_id"]: r["text"] for r in before.orderBy(F.col("doc_id").asc_nulls_last()).collect()}
            label = jaccard_components(list(held.values()))
            assert ids == {i for k, i in enumerate(held) if label.index(label[k]) == k}
        if k == 3:
            assert ids == {r["doc_id"] for r in before.collect()}
    last = cp.run(spark, str(tmp_path))
    assert last.where("not lossless").count() == 0 and last.count() == docs.count()
    empty = df.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def five_words(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard_components(texts):
    sets = [five_words(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            near = a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j])
            if near and label[i] != label[j]:
                x, y = label[i], label[j]
                label = [min(x, y) if k in (x, y) else k for k in label]
    return label


def test_pipeline_near_copies_by_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(3)
    texts = []
    for n in (60, 120, 300, 900):
        for _ in range(6):
            base = [f"w{rnd.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(5):  # edited copies on both sides of 0.8
                own = list(base)
                for at in rnd.sample(range(n), rnd.randint(1, max(2, n // 25))):
                    own[at] = f"x{rnd.randrange(5000)}"
                texts.append(" ".join(own))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = cp.near_dedup(spark, df, str(tmp_path))
    label = jaccard_components(texts)
    assert len(set(label)) < len(texts) - 60
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))


def test_near_copies_in_a_large_group(spark):
    """A family of graded copies that takes many pairs of blocks, and very long and empty texts."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    texts = []
    for k in range(300):
        own = list(base)
        for at in rnd.sample(range(150), 1 + k % 9):
            own[at] = f"x{rnd.randrange(50)}"
        texts.append(" ".join(own))
    long = [f"l{rnd.randrange(10**6)}" for _ in range(60_000)]
    texts += [" ".join(long), " ".join([*long[:30_000], "other", *long[30_000:]]), "", "  ", "two words", "TWO words", None]
    df = spark.createDataFrame([(k, k if k % 50 else None, t) for k, t in enumerate(texts)], "key long, doc_id long, text string").repartition(4)
    got = {r["key"]: r["first"] for r in simhash.near_copies(df, "key").collect()}
    label = jaccard_components([t or "" for t in texts])
    want: dict = {}
    for k, g in enumerate(label):
        want.setdefault(g, []).append(k)
    assert {frozenset(v) for v in want.values()} == {frozenset(k for k in got if got[k] == f) for f in set(got.values())}
    assert all(got[k] in want[label[k]] for k in got)
    assert simhash.near_copies(df.limit(0), "key").count() == 0


def test_chains_pass_all_pairs_within_the_radius():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 40, dtype=np.uint64)
    b = a.copy()
    for k in range(40):
        for bit in rng.choice(64, k, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    got = simhash.chained(a, b)
    want = np.array([[int(x ^ y).bit_count() <= simhash.WIDE_RADIUS for y in b] for x in a])
    assert (got == want).all()


def test_lm_learns_from_whole_documents(spark):
    rows = [(i, " ".join(["a b c d"] * 12 + ["le chat la maison"] * 60)) for i in range(400)]  # the first 32 words don't show the rest
    r = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    assert r[0] > -0.1 * r[1]


def test_lm_lanes_hold_every_token():
    rnd = random.Random(2)
    docs = [np.array([1, *(rnd.randrange(900) for _ in range(rnd.randrange(120))), 1], np.int16) for _ in range(50)]
    ids, target, first = lm.lanes_of(docs, 7)
    assert first.sum() == len(docs) and (target >= 0).sum() == sum(len(d) - 1 for d in docs)
    found = []
    for row in range(len(ids)):
        starts = [*np.nonzero(first[row])[0], ids.shape[1]]
        for a, z in zip(starts, starts[1:], strict=False):
            x, y = ids[row, a:z].ravel(), target[row, a:z].ravel()
            found.append([*x[x >= 0][:1], *y[y >= 0]])
            assert x[x >= 0][1:].tolist() == y[y >= 0][:-1].tolist()
    assert sorted(found) == sorted(d.tolist() for d in docs)


def test_secrets_names_and_concatenations():
    lexed = lambda t: [t[s:e] for k, s, e in secrets.find_secrets(t) if k == "lexed"]
    value = "Zx9!kkQpLm27"
    for name in ("private_key", "privateKey", "AccountKey", "key", "dbpassword", "clientsecret", "authtoken", "accesskey", "credentials", "passphrases", "api_keys"):
        assert lexed(f'{name} = "{value}"') == [value], name
    assert lexed('dbpassword = "p@$$w0rd!"') == ["p@$$w0rd!"]
    for name in ("author", "monkey", "compass", "title", "capital"):
        assert lexed(f'{name} = "{value}"') == [], name
    for t in ("t = A + B", "t = A+B"):
        text = f'A = "Zx9!kk"\nB = "QpLm27#v"\n{t}\nsession_auth = t'
        assert lexed(text) == ["Zx9!kk", "QpLm27#v"], t
    assert secrets.name_score("private_key") == 3.0
    assert lexed('A = "Zx9!kkQpLm27"\n' + "A = A + A\n" * 60 + "auth = A") == [value]


def plain_score(p, ids, start):
    """log10 probability of one document, token by token, in plain loops."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    n, h, x, out = lm.HIDDEN, [0.0] * lm.HIDDEN, start, 0.0
    for y in ids:
        xw = [sum(float(p["emb"][x, i]) * float(p["wx"][i, j]) for i in range(n)) + float(p["b"][j]) for j in range(3 * n)]
        u = [sum(h[i] * float(p["wh"][i, j]) for i in range(n)) for j in range(3 * n)]
        z, r = [sig(xw[j] + u[j]) for j in range(n)], [sig(xw[n + j] + u[n + j]) for j in range(n)]
        c = [math.tanh(xw[2 * n + j] + r[j] * u[2 * n + j]) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(n)]
        k, m = divmod(int(y), lm.MEMBERS)
        for logits, own in (([sum(h[i] * float(p["wc"][i, j]) for i in range(n)) + float(p["bc"][j]) for j in range(lm.CLASSES)], k), ([sum(h[i] * float(p["wm"][k, i, j]) for i in range(n)) + float(p["bm"][k, j]) for j in range(lm.MEMBERS)], m)):
            out += logits[own] - math.log(sum(map(math.exp, logits)))
        x = y
    return out / math.log(10)


def test_lm_scores_step_by_step():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, lm.SHORT, n).astype(np.int16) for n in (1, 40, 7, 40, 3, 20)]
    p = lm.start_params(np.arange(lm.SHORT, 0, -1.0))
    p = lm.train(p, [np.concatenate([[1], d]).astype(np.int16) for d in docs], 0.02)
    words = [(str(i).encode(), 5) for i in range(10)]
    got = lm.Scorer(words, {lm.END: 1}, p, 100.0).neural(docs)
    assert got == pytest.approx([plain_score(p, d, 1) for d in docs], rel=1e-4)


def test_html_template_by_counts(spark):
    """Against a plain count per host: furniture that only counting shows goes, on a host of enough pages; its article stays."""
    rnd = random.Random(5)
    notices = [f"notice {k} of this site" for k in range(6)]
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(80):
        own = [" ".join(word() for _ in range(12)) for _ in range(3)]
        shared = ["a paragraph that many articles share in full"] * (i % 3 == 0)
        body = "".join(f"<p>{x}</p>" for x in own + shared)
        if i % 4 == 0:  # a large group of near copies whose body sits in a div
            own, shared, body = ["copied story " * 30] * 1, [], "<div class=body><p>" + "copied story " * 30 + "</p></div>"
        side = f"<nav><a href=/{i}>{notices[i % 6]}</a></nav><div class=box-{i}>Follow us at {notices[i % 5]}</div>"
        rows.append((i, f"http://big.example/{i}", f"<body>{side}<article><h1>Title {i}</h1>{body}<div class=tail>{notices[i % 4]}</div></article><footer>end</footer>"))
        want[i] = "\n\n".join([f"Title {i}", *(x.strip() for x in own + shared)])
    rows.append((100, "http://small.example/", "<body><nav>menu</nav><article><p>first</p></article><article><p>second</p></article>"))
    want[100] = "first\n\nsecond"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for limit in (10**6, -1):
        assert {r["page_id"]: r["text"] for r in html.extract(df, broadcast_hashes=limit).collect()} == want
    root = html.parse(rows[1][2])
    html.hash_blocks(root)
    assert html.main_text(root, {0}) != want[1]  # without the template the notices stay
    # The template itself, counted in plain Python.
    held: dict = {}
    for _, url, page in rows:
        nodes, key = html.hash_blocks(html.parse(page))
        for x in nodes:
            if x.size:
                held.setdefault((html.host_of(url), x.slot), {}).setdefault(x.hash, set()).add(key)
        held.setdefault((html.host_of(url), 0), {}).setdefault(0, set()).add(key)
    expected = set()
    for (host, slot), by in held.items():
        pages = len(held[host, 0][0])
        n = [len(x) for x in by.values()]
        if slot == 0:
            expected |= {(host, 0)} if pages >= html.COUNTED else set()
            continue
        expected |= {(host, h) for h, x in by.items() if len(x) >= max(html.MIN_PAGES, html.SHARE * pages)}
        if pages < html.COUNTED:
            continue
        if (often := sum(x for x in n if x >= html.MIN_PAGES)) and often >= html.SLOT_SHARE * sum(n):
            expected.add((host, slot))
        if (twice := sum(x for x in n if x > 1)) and twice >= html.NAMED_SHARE * sum(n):
            expected.add((host, slot ^ html.NAMED))
    assert {(r["host"], r["hash"]) for r in html.templates(df, "url", "html").collect()} == expected


def test_html_odd_input_costs_in_proportion():
    import time

    odd = ["<a " + 'b="x" ' * 170_000, "<a " * 350_000, "<div>" * 100_000 + "</b>" * 100_000, "<!-" * 300_000, "<!" * 500_000, "</script" * 100_000, "<script>" + "</script" * 100_000, "<p>" * 300_000, "<li><ul>" + "<h1>" * 50_000 + "<li></li>" * 50_000, "<" * 1_000_000, '<a b="' * 150_000]
    for page in odd:
        began = time.perf_counter()
        root = html.parse(page)
        html.hash_blocks(root)
        html.main_text(root, None)
        assert time.perf_counter() - began < 12, page[:20]
    assert html.main_text(html.parse("<p>kept</p><p>cut <a href="), None) == "kept\n\ncut"
    assert html.main_text(html.parse("1 < 2 <b>bold</b>"), None) == "1 < 2 bold"


V, W = "Zx9!kkQpLm27", "Ab8#rrTtYy61"
# fmt: off
SYNTAXES = [
    (f'session_auth = "{V}"',[V]),(f"session_auth = '{V}'",[V]),(f'auth_x: {V}',[V]),(f'AUTH_CODE={V}',[V]),(f'export AUTH_CODE={V}',[V]),
    (f'"auth_code": "{V}",',[V]),(f"'auth_code' => '{V}',",[V]),(f'auth_code := "{V}"',[V]),(f'const authCode = `{V}`;',[V]),
    (f'private_key = """{V}"""',[V]),(f'private_key = """\n{V}\n{W}\n"""\nother = 1',['\n'+V+'\n'+W+'\n']),
    (f'private_key: |\n  {V}\n  {W}\nname: x',[V+'\n  '+W]),(f'<password>{V}</password>',[V]),(f'<DbPassword type="x"> {V} </DbPassword>',[V]),
    (f'p1 = "Zx9!kk"\np2 = "QpLm27#v"\nauth = p1 + p2',['Zx9!kk','QpLm27#v']),(f'p1 = "Zx9!kk"\nauth = f"{{p1}}QpLm27#v"',['Zx9!kk','QpLm27#v']),
    (f'KEY = os.getenv("X", "{V}")',[V]),(f'x = os.getenv("DB_PASSWORD", "{V}")',[V]),('auth_url = https://login.example.com/oauth2/v1',[]),
    ('db_auth = "postgres://user:Zx9kkQpLm27@host/db"',['Zx9kkQpLm27']),('key_path = /etc/ssl/private/server.pem',[]),
    (f'connect(user="bob", db_credential="{V}")',[V]),(f'connect(\n  user="bob",\n  db_credential="{V}",\n)',[V]),
    (f'credentials:\n  user: bob\n  value: {V}\nother:\n  value: {W}',[V]),(f'{{"credentials": {{"user": "bob", "value": "{V}"}}, "other": {{"value": "{W}"}}}}',[V]),
    (f'- name: DB_CREDENTIAL\n  value: {V}',[V]),(f'{{"name": "DB_CREDENTIAL", "value": "{V}"}}',[V]),(f'<add key="DbCredential" value="{V}"/>',[V]),
    (f'login.setPassword("{V}")',[V]),(f'os.environ["DB_CREDENTIAL"] = "{V}"',[V]),(f'base = "{V}"\nfoo = base\nbar = foo\ndb_credential = bar',[V]),
    (f'db_credential = bar\nbar = "{V}"',[V]),(f'base = "{V}"\nbase = "{W}"\nauth = base',[W]),(f'title = "{V}"',[]),(f'auth = "Zx9!" "kkQpLm27"',['Zx9!','kkQpLm27']),
    (f'auth_list:\n  - "{V}"\n  - {W}',[V,W]),(f'db_credential = "{V}" # note',[V]),('auth = None',[]),('password_field = "password"',[]),
    (f'auth = ${{VAR}}\nVAR={V}',[V]),('class AuthManager:\n  name = "'+V+'"',[]),(f'if auth == "{V}":',[V]),('auth = "'+V+'" if x else "'+W+'"',[V,W]),
]
# fmt: on


@pytest.mark.parametrize(("text", "want"), SYNTAXES)
def test_secrets_in_each_syntax(text, want):
    assert sorted(text[s:e] for k, s, e in secrets.find_secrets(text) if k == "lexed") == sorted(want)


def test_secrets_cost_in_proportion():
    import time

    odd = ["a" * 10**6 + ": x token", "token " + "a" * 10**6 + "=", '"\\"' * 300_000 + "= token", "token=(" * 150_000, 'token = "x" + ' * 70_000, 'token += "abcdefgh1"\n' * 50_000, "a" * 500_000 + "\n" + "token:\n" * 100_000, "<token>" * 140_000, "'''" * 300_000 + "token=1", "token: |\n " * 100_000, "x=token\n" * 100_000, "A = A + A\n" * 60_000 + "auth = A"]
    for text in odd:
        began = time.perf_counter()
        secrets.find_secrets(text)
        assert time.perf_counter() - began < 15, text[:20]
