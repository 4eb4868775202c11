import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlake.llm import decontaminate, exact_dedup, line_dedup, minhash, packing, quality, suffix_dedup, tokens, toxicity, url_filter
from revlake.llm.common import new_path
from revlake.llm.queries import URL_RULES, tokenizer_path

DOC = "doc_id long, text string, rid string, n_lines int, th string"


def docs(spark, rows):
    """rows (id, text); extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOC)


ODD = [(5, None), (3, ""), (1, "a b c\nthe same long line\n"), (2, "The Same Long line \nx"), (2, "The Same Long line \nx"), (None, "abc"), (7, "word " * 5000), (8, "ab c")]
OPERATORS = {
    "exact": exact_dedup.exact_dedup, "lines": line_dedup.dedup_lines, "near": minhash.near_groups, "suffix": suffix_dedup.remove_repeats,
    "pack": lambda d: packing.pack(d, tokenizer_path()), "leaks": lambda d: decontaminate.leak_report(d, d.limit(0).withColumnRenamed("doc_id", "item_id")),
    "toxicity": lambda d: toxicity.score_toxicity(d, d.limit(0).select("doc_id", F.lit(1).alias("toxic"))), "quality": lambda d: quality.grade_quality(d, d.limit(0).select("doc_id", F.lit(1).alias("quality"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    n = OPERATORS[name](docs(spark, ODD)).count()
    assert n == (0 if name == "leaks" else n) and (name in ("leaks", "pack") or n == len(ODD))
    assert OPERATORS[name](docs(spark, [])).count() == 0


def test_exact_dedup(spark):
    long = "x" * 700
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, [(1, "a b"), (2, "ab"), (3, "a  b"), (4, long), (5, long + "y"), (6, long + " "), (7, None), (8, " ")])).collect()}
    assert {k: (r["keep_id"], r["group_size"], r["kept"]) for k, r in got.items()} == {1: (3, 3, False), 2: (3, 3, False), 3: (3, 3, True), 4: (6, 2, False), 5: (5, 1, True), 6: (6, 2, True), 7: (8, 2, False), 8: (8, 2, True)}
    assert got[1]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()


def test_line_dedup_batches_agree(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(f"line number {rng.randint(0, 40)}" for _ in range(8))) for i in range(60)]
    first = {}
    for i, t in rows:
        for line in t.split("\n"):
            first.setdefault(line, i)
    want = {i: "\n".join(x for x in t.split("\n") if first[x] == i) for i, t in rows}
    for batches in (1, 5):
        assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows), batches=batches, fanout=2).collect()} == want


def test_word_tokenizer_equals_whole_texts():
    tok, rng = tokens.WordTokenizer(tokenizer_path()), random.Random(2)
    parts = ["\n", "%", "!?", "b'", "中", "ß", " ", "  ", "\t", "a", "Bc", "'s", "1", "é", ".", "\x1c", "<|endoftext|>", " ", " x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert tok.encode(texts) == tok.whole(texts)
    # words are forgotten and learned again, and odd texts go in small batches
    tok.MOST_WORDS, tok.WHOLE, want = 50, 100, tok.whole(texts)
    assert [x for k in range(0, len(texts), 300) for x in tok.encode(texts[k : k + 300])] == want
    assert tok.encode([]) == []


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, u in ((1, 1), (300, 5), (900, 10**6)):
        v = np.sort(rng.integers(0, u, n))
        e = tokens.EliasFano.encode(v)
        assert (e.decode() == v).all() and [e.select(i) for i in range(n)] == v.tolist()
        for begin, end in ((0, n), (0, 0), (n, n), (n // 3, n // 2), (max(0, n - 1), n), (min(n, 256), min(n, 512))):
            assert (e.selects(begin, end) == v[begin:end]).all()
    assert len(tokens.EliasFano.encode(np.array([], np.int64)).selects(0, 0)) == 0


def test_token_shards_round_trip(spark):
    rows = [(i, f"some text {i} " * (i % 7)) for i in range(50, 0, -1)]
    tokens.write_shards(docs(spark, rows), out := new_path(spark, "t"), tokenizer_path(), shard_ids=100)
    tok, start = tokens.WordTokenizer(tokenizer_path()), 0
    got = {r["doc_id"]: r for r in tokens.read_boundaries(spark, out).collect()}
    for i, t in sorted(rows):
        run = tok.whole([t])[0] + bytes(4)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(run) // 4, zlib.crc32(run))
        start += len(run) // 4


def test_packing_is_gapless(spark):
    rng = random.Random(4)
    got = packing.pack(docs(spark, [(i, "word " * rng.randint(0, 200)) for i in range(200)]), tokenizer_path(), capacity=64).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) * 1.1 + 1


def test_url_trie():
    t = url_filter.UrlTrie(URL_RULES)
    assert t.longest("a.example.net", "/en/x") == ("example.net/en/", "allow")
    assert t.longest("a.example.net", "/de/") == ("net/", "block") and t.longest("net", "") is None
    assert t.longest("x.example.com", "/de/1") == ("example.com/de/", "block") and t.longest("example.org", "/fr") is None


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(120):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    sets = {i: frozenset(tuple(t.split()[k : k + 3]) for k in range(118)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs(spark, rows), width=3, percent=85).collect()}
    assert got == {i: find(i) for i in sets}


def test_packed_minima_count_agreement(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**32, (40, 128), dtype=np.uint32)
    y = np.where(rng.random(x.shape) < np.linspace(0.5, 1, 40)[:, None], x, rng.integers(0, 2**32, x.shape, dtype=np.uint32))
    rows = [(100, minhash.packed(a).tolist(), 100, minhash.packed(b).tolist()) for a, b in zip(x, y)]
    got = spark.createDataFrame(rows, "u_n long, u_sig array<bigint>, v_n long, v_sig array<bigint>").coalesce(1).select(minhash._may_link("u", "v", 85).alias("m")).collect()
    most = int((1 - (0.85 + 0.15 / 16) + minhash.SLACK) * 128)
    want = [int(((a & 15) != (b & 15)).sum()) <= most for a, b in zip(x, y)]
    assert [r["m"] for r in got] == want and 5 < sum(want) < 35


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [[word() for _ in range(rng.randint(4, 50))] for _ in range(12)]
    rows = []
    for i in range(60):
        item = list(rng.choice(items))
        if i % 3 == 1:
            item[rng.randrange(len(item))] = "changed"
        rows.append((i, " ".join([word() for _ in range(20)] + (item if i % 3 else []) + [word() for _ in range(20)])))
    shingles = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    want = set()
    for i, t in rows:
        w = t.split()
        for k, item in enumerate(items):
            own = shingles(item, min(5, len(item)))
            for a in range(len(w) - len(item) + 1):
                there = shingles(w[a : a + len(item)], min(5, len(item)))
                both = sum((there & own).values())
                if 100 * both >= 80 * (sum(there.values()) + sum(own.values()) - both):
                    want.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leak_report(docs(spark, rows), bench).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_dedup_equals_brute_force(spark, hot):
    rng = random.Random(7)
    pieces = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(30, 300))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) + str(i)) for i in range(40)]
    need = 100
    seen = Counter(t[k : k + need] for _, t in rows for k in range(len(t) - need + 1))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, rows), need=need, gram=16, hot=hot).collect()}
    for i, t in rows:
        gone = {j for k in range(len(t) - need + 1) if seen[t[k : k + need]] > 1 for j in range(k, k + need)}
        assert (got[i]["n_removed"], bytes(got[i]["kept"]).decode()) == (len(gone), "".join(c for j, c in enumerate(t) if j not in gone))


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    t = toxicity.score_toxicity(documents, labels).select("row.doc_id", "held_out", "predicted").join(labels, "doc_id").filter("held_out")
    assert t.filter("predicted = toxic").count() >= 0.95 * t.count()
    q = quality.grade_quality(documents, labels).select("row.doc_id", "held_out", "kept").join(labels, "doc_id").filter("held_out")
    assert q.filter("cast(kept as int) = quality").count() >= 0.93 * q.count()


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{d}/documents.parquet")
    out = before
    for _, f in P.STAGES[:-1]:
        out = f(spark, out, d)
        assert out.columns == before.columns and 0.5 * before.count() < out.count() <= before.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    item = {tuple(re.findall(r"\S+", r["text"].lower())) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    assert not any(" ".join(x) in " ".join(t.lower().split()) for x in item for t in text.values())
