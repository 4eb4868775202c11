"""Hard negatives, prefix counts and conversation repair against plain versions on small and odd rows."""

import hashlib
import heapq
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revlake.llm import hard_negatives, prefix_counts, repair
from revlake.llm.queries import damaged, tokenizer_path

VEC = "vec_id long, label int, embedding array<double>, score int, bucket string"


def plain_negatives(rows, every=100, positives=5, negatives=10):
    ok = {(i, c, tuple(int(np.floor(256 * x)) for x in v)) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, c, v in ok:
        if i % every == 0:
            met = sorted((-score(v, w), j, d) for j, d, w in ok if j != i)
            for p, j, d in [m for m in met if m[2] == c][:positives]:
                hard = [m for m in met if m[2] != c and -30 * p <= -100 * m[0] <= -90 * p][:negatives]
                out += [(i, j, k, n, -p, -s) for k, (s, n, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "lengths", "clusters"])
def test_hard_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(240, 6))
    if kind == "lengths":
        v *= np.exp(rng.normal(size=(240, 1)) * 2)
    if kind == "clusters":
        v = np.eye(6)[rng.integers(0, 6, 240)] + 0.05 * v
    rows = [(int(k), int(rng.integers(0, 4)), x.tolist()) for k, x in enumerate(v)]
    odd = [(20, 1, None), (40, None, [1.0] * 6), (60, 2, [1.0, None, 1.0]), (80, 3, [float("nan")] * 6), (100, 3, [float("inf")] * 6), (None, 1, [1.0] * 6), (300, 1, [0.0] * 6), (320, 2, []), (340, 2, [1.0, 2.0]), (1000, 3, [1e5] * 2), (7, 3, [1.0] * 6), (0, 2, [0.5] * 6)]
    rows = [*rows, *odd, *rows[:50]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VEC)
    got = hard_negatives.mine_negatives(df, every=20)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain_negatives(rows, 20)


def test_hard_negatives_ranges_leave_out_rows_but_none_that_is_sought(monkeypatch):
    """Long vectors near axes: ranges of the focus coordinates are narrow, and the rows met are those that all rows give."""
    rng = np.random.default_rng(6)
    v = (np.eye(8)[rng.integers(0, 8, 500)] * 1000 + rng.normal(size=(500, 8)) * 40).astype(np.int32)
    norms = np.sqrt((v.astype(float) ** 2).sum(1))
    share = v / norms[:, None]
    b = {"n": 500, "d": 8, "low": norms.min(), "high": norms.max(), "ids": np.arange(500).astype("<i8").tobytes(), "labels": np.zeros(500, "<i8").tobytes(), "rows": v.astype("<i4").tobytes(), "lists": np.ascontiguousarray(np.argsort(share, axis=0, kind="stable").T.astype("<u2")).tobytes()}
    best = int(norms.max() ** 2)
    target = {"no": 1, "positive_id": 1, "positive_score": best, "lo": best * 3 // 10, "hi": best * 9 // 10}
    asked = [{"id": -1 - k, "key": k, "label": 1, "v": v[k].tolist(), "targets": [target]} for k in range(40)]
    one, every = hard_negatives._Cell(asked, False, 10), hard_negatives._Cell(asked, False, 10)
    begin, end = one._ranges(np.arange(40), b["low"], b["high"], np.take_along_axis(share.T, np.frombuffer(b["lists"], "<u2").reshape(8, 500), 1))
    assert ((end - begin).min(1) < 250).all()
    one.meet(b)
    monkeypatch.setattr(hard_negatives, "WIDE", 0)
    every.meet(b)
    assert one.found() == every.found() != []


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine_negatives(spark.createDataFrame([], VEC)).count() == 0
    assert hard_negatives.mine_negatives(spark.createDataFrame([(1, 1, [1.0], 1, "")], VEC)).count() == 0
    assert hard_negatives.mine_negatives(spark.createDataFrame([(100, 1, [1.0], 1, "")], VEC)).count() == 0


PARTS = ["\n", "\n\n", "%", "!?", "'ll", "'s", "'", "中", "ß", " ", "  ", "\t", "a", "Bc", " hello", "12345", "é", ".", "\x1c", "<|endoftext|>", "<|endo", "\xa0", "　", "👍🏽", "\x00", "ing", "don't", "-" * 16, "é", "ɐ", " Жук"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=12))
def test_counts_at_every_prefix(text):
    c = prefix_counts.prefix_counter(tokenizer_path())
    want = [len(e.ids) for e in c.tok.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
    assert c.counts(text) == want
    counted = c.steps(pa.array([text, "", text]))
    for steps in list(counted.tables())[::2]:
        assert [0, *np.cumsum(steps).tolist()] == want
    for budget in {0, 1, want[-1] // 2, want[-1]}:
        assert counted.fits(budget)[0] == max(k for k, n in enumerate(want) if n <= budget)


def test_long_runs_are_counted_whole():
    c = prefix_counts.prefix_counter(tokenizer_path())
    for text in (" " * 100_000, "-" * 100_000, "word" * 30_000, "a b\n" * 20_000):
        assert c.counts(text)[-1] == len(c.tok.encode(text, add_special_tokens=False).ids)


def test_prefix_tables_answer_questions(spark):
    texts = [(1, "one two  three\n\nfour's " * 300), (2, None), (3, ""), (3, "x"), (None, "abc")]
    docs = spark.createDataFrame([(*t, "a", 1) for t in texts], "doc_id long, text string, steps string, n_tokens int")
    path, tok = tokenizer_path(), prefix_counts.prefix_counter(tokenizer_path()).tok
    n = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
    counts = {(r["doc_id"], r["n_bytes"]): (r["n_tokens"], r["over_limit"], r["fit_chars"]) for r in prefix_counts.token_counts(docs, path).collect()}
    long = texts[0][1]
    fit = max(k for k in range(len(long) + 1) if n(long[:k]) <= 1024)
    assert counts == {(1, len(long)): (n(long), True, fit), (2, 0): (0, False, 0), (3, 0): (0, False, 0), (3, 1): (1, False, 1), (None, 3): (n("abc"), False, 3)}
    tables = prefix_counts.prefix_tables(docs, path)
    asks = spark.createDataFrame([(1, 3000, 40), (1, -1, 0), (1, 10**9, 10**9), (2, 5, 5), (9, 1, 1), (1, None, None)], "doc_id long, chars long, budget long")
    assert sorted(((r["chars"], r["tokens"]) for r in prefix_counts.tokens_at(tables, asks).collect()), key=str) == sorted([(3000, n(long[:3000])), (-1, 0), (10**9, n(long)), (5, 0), (1, None), (None, None)], key=str)
    got = {(r["doc_id"], r["budget"]): r["chars"] for r in prefix_counts.longest_fit(tables, asks.drop("chars")).collect()}
    assert got == {(1, 40): max(k for k in range(400) if n(long[:k]) <= 40), (1, 0): 0, (1, 10**9): len(long), (2, 5): 0, (9, 1): None, (1, None): None}
    assert prefix_counts.token_counts(docs.limit(0), path).count() == prefix_counts.prefix_tables(docs.limit(0), path).count() == 0


def plain_repair(rows):
    """Dijkstra over (turns used, last role), by cost and then audit."""
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, k, q, out = heapq.heappop(heap)
        if k == len(rows) and q in ("", "a"):
            break
        if (k, q) in done:
            continue
        done.add((k, q))
        fits = lambda r: (r == "s" and q == "") or (r == "u" and q != "u") or (r == "a" and q == "u")  # noqa: E731, B023
        for r, name in (("u", "user"), ("a", "assistant")):
            if fits(r):
                heapq.heappush(heap, (cost + 2, audit + "I", k, r, (*out, f"{name}:")))
        if k < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, q, out))
            if faults[k] not in ("blank", "duplicate"):
                _, role, text = rows[k]
                more = faults[k] == "truncated"
                if fits(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[:1], (*out, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if fits(r):
                        heapq.heappush(heap, (cost + more + 2, audit + "R", k + 1, r, (*out, f"{name}:{text}")))
    heads, turns = [r[1][:1] for r in rows], [r[0] for r in rows if r[0] is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(out)


def in_order(rows):
    filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


@pytest.mark.parametrize("piece", [4096, 3])
def test_repair(spark, piece, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_TURNS", piece)
    rng, rows = random.Random(3), []
    for c in [None, *range(150)]:
        rows += [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b!", "c", "d", "", " \n", "e?", None])) for _ in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("x")).withColumn("conv", F.lit(1))
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(row)
    want = {c: plain_repair(in_order(own)) for c, own in by.items()}
    got = {r["conv_id"]: r for r in repair.repair_report(df).collect()}
    assert got.keys() == want.keys()
    for c, (*numbers, audit, text) in want.items():
        r = got[c]
        assert [r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] == numbers, c
        assert (r["audit"], r["repaired_sha256"]) == (audit, hashlib.sha256(text.encode()).hexdigest())
    turns = {}
    for r in repair.repair_turns(df).orderBy("piece", "place").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: "\n".join(t) for c, t in turns.items()} == {c: w[-1] for c, w in want.items() if w[-1]}
    assert repair.repair_report(df.limit(0)).count() == repair.repair_turns(df.limit(0)).count() == 0


def test_one_conversation_holds_most_rows(spark):
    """A conversation of 20,000 turns goes through several tasks and is repaired as a whole."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(20_000)] + [(2, 0, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = repair._planned(df, "conv_id", "turn", "role", "text")[0]
    assert pieces.filter("conv = 1").count() >= 4
    got = {r["conv_id"]: r for r in repair.repair_report(df).collect()}
    assert (got[1]["cost"], got[1]["audit"], got[2]["audit"]) == (0, "K" * 20_000, "KI")
    assert got[1]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:-1]).encode()).hexdigest()


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "a.b!") for c in [*range(40), None] for t in [0, 1, None]]
    got = {}
    for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        assert got.get((c, t), []) == {0: [], 1: [(role, "")], 2: [(role, "ab")], 3: [(role, text)] * 2, 4: [("user", text)]}.get(code, [(role, text)])


def test_long_runs_of_few_characters_are_one_anchor(spark):
    """A run of one character, or of a few in turn, gives a handful of anchors and one range, whatever its length."""
    from revlake.llm import suffix_dedup

    n = 5_000_000
    texts = {1: "x" * n, 2: " " * n, 3: "- " * 50_000, 4: "y" * 400, 5: "y" * 401, 6: "ab " * 200 + "z" * 300, 7: "q" * 399, 8: "x" * 400}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scanned = suffix_dedup._scan(suffix_dedup._rows(docs, "doc_id", "text"), 400, 200)
    assert scanned.count() < 2_000
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs).collect()}

    def plain(text):
        starts = {}
        for k in range(len(text) - 399):
            starts.setdefault(text[k : k + 400], []).append(k)
        gone = {j for at in starts.values() if len(at) > 1 for k in at for j in range(k, k + 400)}
        return len(gone), sum(j - 1 not in gone for j in gone)

    want = {k: plain(t) for k, t in texts.items() if len(t) < 1000} | {1: (n, 1), 2: (n, 1), 3: (100_000, 1), 4: (400, 1), 8: (400, 1)}
    assert got == want
