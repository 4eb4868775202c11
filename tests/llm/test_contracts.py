"""Text operators and pipeline stages against plain versions of their contracts, on small fixtures with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlake.llm import common, decontaminate, exact_dedup, line_dedup, minhash, packing, quality, suffix_dedup, tokens, toxicity, url_filter
from revlake.llm.common import new_path
from revlake.llm.queries import URL_RULES, tokenizer_path

#: Names that the operators use themselves.
EXTRA = "rid string, row int, id string, gone_id long, th string, kept string, rank int, cid int, h long"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z", "k", 3, 4, 5) for i, t in rows], SCHEMA)


LINE = "A line that stands in more than one document"
ODD = [(5, None), (3, ""), (9, "  \t\n "), (1, f"a b c\n{LINE}\n"), (2, f"{LINE.upper()} \nx"), (2, f"{LINE.upper()} \nx"), (None, "abc"), (None, f"q\n{LINE}"), (7, "word " * 9000), (8, "ab c"), (10, "abc")]
KEYS = [(i if i is not None else float("-inf"), i, t or "") for i, t in ODD]


def blank_free(t):
    return "".join(c for c in t if c not in " \t\n\x0b\f\r")


def collected(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_exact_dedup_of_odd_rows(spark):
    groups = defaultdict(list)
    for k, (order, i, t) in enumerate(KEYS):
        groups[blank_free(t)].append((-len(t), order, k, i))
    want = []
    for body, own in groups.items():
        best = min(own)
        same = [x for x in own if x[:2] == best[:2]]
        want += [(i, best[3], len(own), hashlib.sha256(body.encode()).hexdigest()) for _, _, _, i in own]
        assert len(same) >= 1
    got = exact_dedup.exact_dedup(frame(spark, ODD))
    assert collected(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=str)
    assert got.filter("kept").count() == len(groups)


def plain_lines(rows):
    """Kept text of each row, in order."""
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans(common.UPPER, common.LOWER))
    where = defaultdict(set)
    order = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(order(i))
    gone = lambda i, line: len(key(line)) >= 10 and len(where[key(line)]) > 1 and min(where[key(line)]) != order(i)
    return [(i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x)), sum(gone(i, x) for x in (t or "").split("\n")), len((t or "").split("\n"))) for i, t in rows]


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup_of_odd_rows(spark, batches):
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, d, n in plain_lines(ODD)]
    assert collected(line_dedup.line_report(frame(spark, ODD), batches=batches), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=str)
    out = line_dedup.dedup_lines(frame(spark, ODD), batches=batches)
    assert out.columns == frame(spark, ODD).columns and out.filter("text IS NULL").count() == 1


def test_token_shards_of_odd_rows(spark):
    rows = [*ODD, (-(2**63), "least"), (2**63 - 1, "most")]
    tokens.write_shards(frame(spark, rows), out := new_path(spark, "t"), tokenizer_path(), shard_ids=40)
    tok, start, want = tokens.WordTokenizer(tokenizer_path()), 0, []
    for _, i, t in sorted((-(2**64) if i is None else i, i, t or "") for i, t in rows):
        run = tok.whole([t])[0] + bytes(4)
        want.append((i, start, len(run) // 4, zlib.crc32(run)))
        start += len(run) // 4
    got = tokens.read_boundaries(spark, out)
    assert collected(got, "start", "n_tokens") == sorted([w[1:3] for w in want], key=str)
    assert Counter(collected(got, "doc_id", "n_tokens", "ids_crc32")) == Counter((w[0], *w[2:]) for w in want)
    tokens.write_shards(frame(spark, []), empty := new_path(spark, "t"), tokenizer_path())
    assert tokens.read_boundaries(spark, empty).count() == 0


def plain_pieces(rows, capacity):
    tok, out = tokens.WordTokenizer(tokenizer_path()), []
    for i, t in rows:
        ids = np.append(np.frombuffer(tok.whole([t or ""])[0], "<u4"), 0).astype("<u4")
        start, size, piece = 0, len(ids) % capacity or capacity, 0
        while start < len(ids):
            out.append((i, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())))
            start, size, piece = start + size, capacity, piece + 1
    return out


def assert_packed(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    # the least number of bins: by volume, and by pieces over half of one
    least = max(-(-sum(r["length"] for r in got) // capacity), sum(2 * r["length"] > capacity for r in got))
    assert least <= len(bins) <= 1.03 * least + 1


def test_packing_equals_plain_pieces(spark):
    rng = random.Random(4)
    rows = [*ODD[:-3], *[(100 + i, "word " * int(rng.lognormvariate(2.5, 1))) for i in range(400)]]
    got = packing.pack(frame(spark, rows), tokenizer_path(), capacity=64).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(plain_pieces(rows, 64), key=str)
    assert_packed(got, 64)


def test_filter_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?q#f"), (4, "http://example.net/de/"), (5, "x://net"), (6, "x://net/"), (7, "x://b.org/fr/1"), (8, "x://example.com?/de/"), (9, "x://a://b/c"), (9, "x://a://b/c"), (None, "x://y.example.com/de/z#"), (11, "x://notexample.com/de/"), (12, ""), (13, "x://org/fr")]
    df = spark.createDataFrame([(i, u, "r", "v", "h") for i, u in rows], "page_id long, url string, rule string, verdict string, host string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, URL_RULES).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "example.net", "/de/", "net/", "block"), (5, "net", "", None, "allow"), (6, "net", "/", "net/", "block"), (7, "b.org", "/fr/1", "org/fr/", "allow"),
        (8, "example.com", "", None, "allow"), (9, "a:", "//b/c", None, "allow"), (None, "y.example.com", "/de/z", "example.com/de/", "block"), (11, "notexample.com", "/de/", None, "allow"), (12, "", "", None, "allow"), (13, "org", "/fr", None, "allow"),
    }
    assert url_filter.filter_urls(df, URL_RULES).count() == len(rows)
    longest = [("block", "x.example.org", "/a"), ("allow", "org", "/aaaaaaaaaaaaaaa")]
    assert url_filter.UrlTrie(longest).longest("x.example.org", "/aaaaaaaaaaaaaaa") == ("org/aaaaaaaaaaaaaaa", "allow")
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_many_shards_equal_brute_force():
    rng = random.Random(8)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    strings = []
    for _ in range(30):
        a = rng.randrange(2000)
        s = bytearray(base[a : a + rng.randint(380, 900)])
        if rng.random() < 0.6:
            s[rng.randrange(len(s))] = 33
        strings.append(bytes(s))
    for need in (8, 100, 400):
        seen = Counter(s[k : k + need] for s in strings for k in range(len(s) - need + 1))
        want = [[k for k in range(len(s) - need + 1) if seen[s[k : k + need]] > 1] for s in strings]
        for shard in (700, 4000, 1 << 20):
            assert [x.tolist() for x in suffix_dedup.merge_repeats(strings, need, shard)] == want


@pytest.mark.parametrize("hot", [1024, 1])
def test_suffix_dedup_at_its_own_size(spark, hot):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    common_part = text(900)
    rows = [(k, text(rng.randint(0, 300)) + common_part[rng.randint(0, 200) : rng.randint(500, 900)] + text(100)) for k in range(40)] + [(None, None), (50, ""), (51, "x" * 1500), (52, common_part), (52, common_part), (None, common_part[:450])]
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(frame(spark, rows), hot=hot)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)


def plain_groups(rows, width, percent):
    """(id, shingles, component) of each row; rows without id link too."""
    fold = str.maketrans(common.UPPER, common.LOWER)
    sets = []
    for _, t in rows:
        w = (t or "").translate(fold).split(" ") if "\n" not in (t or "") else (t or "").translate(fold).split()
        w = [x for x in w if x]
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), None if i is None else least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)]


def test_near_groups_without_a_common_original(spark):
    """Copies that differ from their original in two places or more: no leader links to all, most pairs are apart."""
    rng = random.Random(10)
    rows = []
    for g in range(3):
        base = [f"b{g}w{k}" for k in range(60)]
        places = [rng.sample(range(60), rng.choice((2, 2, 3))) for _ in range(12)]
        for k in range(90):
            w = list(base)
            for at in rng.choice(places):
                w[at] = f"e{rng.randint(0, 5)}"
            rows.append((1000 * g + k, " ".join(w)))
    want = plain_groups(rows, 3, 85)
    assert 3 < len({c for _, _, c in want}) < len(rows)
    assert collected(minhash.near_groups(frame(spark, rows), width=3, percent=85), "doc_id", "n_shingles", "component_id") == sorted(want, key=str)


def test_near_groups_of_odd_rows(spark):
    words = [f"w{k}" for k in range(100)]
    a, b, c = (" ".join(words[:k]) + f" e{k}" for k in (80, 90, 100))  # neighbours are near, a and c are not
    rows = [*ODD, (101, a), (None, b), (103, c), (103, c), (104, "One"), (105, "one"), (106, "one two"), (None, "alone here")]
    want = plain_groups(rows, 5, 80)
    assert (103, 97, 101) in want
    got = minhash.near_groups(frame(spark, rows))
    assert collected(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=str)
    stay = Counter(i for i, _, comp in want if i is None or i == comp)
    out = minhash.drop_near_copies(frame(spark, rows))
    assert Counter(r["doc_id"] for r in out.collect()) == stay and out.columns == SCHEMA.replace(",", "").split()[::2]


def test_leaks_by_shuffled_joins_and_odd_rows(spark, monkeypatch):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [*ODD, (20, f"before {item} after"), (20, f"before {item} after"), (None, item.upper()), (21, item.replace("w3 ", "x ")), (22, " ".join(f"w{k}" for k in range(15)))]
    bench = spark.createDataFrame([(1, item, "t"), (1, item, "t"), (2, None, "t"), (3, "", "t"), (None, item, "t"), (4, "A B C", "t")], "item_id long, text string, th string")
    docs, found = frame(spark, rows), []
    for most in (2_000_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", most)
        monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", most)
        found.append((collected(decontaminate.leak_report(docs, bench), "doc_id", "item_id", "start", "similarity"), Counter(r["doc_id"] for r in decontaminate.drop_leaky(docs, bench).collect())))
    assert found[0] == found[1]
    assert {x[:2] for x in found[0][0]} == {(20, 1), (20, None), (None, 1), (None, None), (1, 4)}
    assert found[0][1] == Counter(i for i, t in rows if not (i == 20 or i == 1 or t == item.upper()))
    assert decontaminate.leak_report(docs, bench.limit(0)).count() == 0 and decontaminate.drop_leaky(docs, bench.limit(0)).count() == len(rows)


def test_quality_of_three_grades(spark):
    rng = random.Random(12)
    words = {g: [f"{'abc'[g]}{k}" for k in range(40)] for g in range(3)}
    text = lambda g: " ".join(rng.choice(words[g] if rng.random() < 0.3 else words[rng.randrange(3)]) for _ in range(60))
    rows = [(k, text(k % 3)) for k in range(900)] + [(2000, None), (2001, ""), (2002, "a1 a2"), (2003, "a1 a2"), (None, "c1")]
    ratings = spark.createDataFrame([(k, k % 3) for k in range(900)] + [(5, 0), (None, 1), (7, None), (8, 9)], "doc_id long, quality int")
    got = quality.grade_quality(frame(spark, rows), ratings, n_grades=3, at_least=2).collect()
    assert len(got) == len(rows)
    by = {r["row"]["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["row"]["doc_id"] is not None and r["row"]["doc_id"] < 900]
    mean = [np.mean([r["expected_grade"] for r in held if r["row"]["doc_id"] % 3 == g]) for g in range(3)]
    assert mean[0] + 0.3 < mean[1] < mean[2] - 0.3
    assert by[2002]["tail_probability"] == pytest.approx(by[2003]["tail_probability"]) and by[2000]["expected_grade"] == pytest.approx(by[2001]["expected_grade"])
    assert all(0 <= r["tail_probability"] <= 1 and r["tail_probability"] <= r["expected_grade"] <= 2 for r in got)
    none = quality.grade_quality(frame(spark, ODD), ratings.limit(0)).select("expected_grade", "kept").distinct().collect()
    assert [tuple(r) for r in none] == [(0.5, True)]


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(13)
    calm = lambda: " ".join(rng.choice(["river", "stone", "walk", "paper", "window", "green"]) for _ in range(30))
    rows = [(k, calm() + (" you are a pathetic idiot" if k % 4 == 0 else "")) for k in range(600)] + [(None, None), (900, None), (901, ""), (902, "You IDIOT!!"), (902, "You IDIOT!!")]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame(spark, rows), labels).select("row.doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 902}) == 1
    for kinds, score in (("toxic = 5", 0.0), ("toxic = 1 AND doc_id IS NOT NULL", 1.0)):
        flat = toxicity.score_toxicity(frame(spark, ODD), frame(spark, [(i, t) for i, t in rows if i is not None]).limit(0).select("doc_id", F.lit(1).alias("toxic")) if score == 0 else labels.filter(kinds))
        assert {r["score"] for r in flat.select("score").collect()} <= {0.0, score}


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(14)
    word = lambda: f"w{rng.randint(0, 4000)}"
    base = [[word() for _ in range(80)] for _ in range(12)]
    item = [word() for _ in range(40)]
    rows = []
    for k in range(120):
        w = list(base[k % 12]) if k % 3 == 0 else [word() for _ in range(rng.randint(1, 200))]
        if k % 3 == 0 and k > 30:
            w[rng.randrange(80)] = "edit"
        lines = [" ".join(w[a : a + 20]) for a in range(0, len(w), 20)]
        if k % 5 == 0:
            lines.insert(1, f"A footer line of section {k % 2}")
        if k % 11 == 0:
            lines.append(" ".join(item))
        if k % 7 == 0:
            lines.append("you are a pathetic idiot, you worthless scum")
        rows.append((k, "\n".join(lines), "en", "s", 0, "extra"))
    rows += [(500, None, None, None, None, None), (501, "", "en", "s", 0, "x"), (None, "no id at all", "en", "s", 3, "x"), (502, "same row", "en", "s", 3, "x"), (502, "same row", "en", "s", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 7 == 0), 1) for k in range(120)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for name, f in P.STAGES:
        before, step = pairs(step), common.stage(f(spark, step, str(tmp_path)), name)
        if name == "toxicity":
            assert pairs(step) == [(i, t) for i, t in before if "idiot" not in (t or "")]
        elif name == "line_dedup":
            want = {(i, t if u is None else None) for (i, u), (_, t, _, _) in zip(before, plain_lines(before), strict=True) if u is None} | {(i, t) for (i, u), (_, t, _, _) in zip(before, plain_lines(before), strict=True) if u is not None}
            assert set(pairs(step)) == {(i, None) if i == 500 else (i, t) for i, t in want} and len(pairs(step)) == len(before)
            assert step.filter("n_chars <> char_length(text)").count() == 0
        elif name == "minhash_dedup":
            stay = Counter(i for i, _, c in plain_groups(before, 5, 80) if i is None or i == c)
            assert Counter(i for i, _ in pairs(step)) == stay
        elif name == "decontamination":
            assert pairs(step) == [(i, t) for i, t in before if " ".join(item) not in (t or "")]
        if name != "packing":
            assert step.columns == docs.columns
    got = step.collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(plain_pieces(before, 2048), key=str)
    assert_packed(got, 2048)
    assert sorted(map(str, P.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(map(str, step.drop("sequence_id", "offset").collect()))
