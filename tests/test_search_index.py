"""The stored index against a scan, and snippets of texts whose letters change their width."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from revlake.operators import search, text_index
from revlake.streaming import warehouse

TERMS = ["abc", "aaaa", "b ca", "İx", "zzz", "ABCab", "é c", "ab"]


def scan(spark, texts, term):
    c = spark.createDataFrame([(k, *v) for k, v in texts.items()], "key string, title string, body string")
    return {r["key"]: round(r["rank"], 9) for r in search.ranked(c, ["title", "body"], term, "x").collect()}


def frame(spark, texts):
    return spark.createDataFrame([(k, *v, 1, "x") for k, v in texts.items()], "key string, title string, body string, gram int, seq string")


@pytest.mark.parametrize("compacted", [False, True])
def test_index_equals_scan_after_refreshes(spark, tmp_path, compacted):
    rng, root, now = random.Random(4), str(tmp_path), {}
    text = lambda: "".join(rng.choice("aabbc éİxAB") for _ in range(rng.randint(0, 60)))
    for step in range(3):
        changed = {f"k{rng.randint(0, 60)}": (text(), rng.choice([None, text()])) for _ in range(25)}
        gone = rng.sample(sorted(now), min(len(now), 6)) if step else []
        gone = [k for k in gone if k not in changed] + ["never"]
        text_index.refresh(frame(spark, changed), root, "key", ["title", "body"], spark.createDataFrame([(k,) for k in gone], "key string"), "w", step)
        now = {k: v for k, v in (now | changed).items() if k not in gone}
    text_index.refresh(frame(spark, {"k1": ("abc", "abc")}), root, "key", ["title", "body"], None, "w", 2)  # this one is in
    if compacted:
        text_index.compact(spark, root)
        assert all(len(f) == 1 for f in warehouse.state(spark, root).folders.values())
    for term in TERMS:
        got = {r["key"]: round(r["rank"], 9) for r in text_index.search_index(spark, root, term).collect()}
        assert got == scan(spark, now, term), term
    first = [r["key"] for r in text_index.search_index(spark, root, "abc", 5).collect()]
    assert first == [k for _, k in sorted((v, k) for k, v in scan(spark, now, "abc").items())][:5]


def test_a_search_reads_its_trigrams_buckets_only(spark, tmp_path):
    text_index.refresh(frame(spark, {f"k{k}": (f"some text {k}", "and more") for k in range(50)}), str(tmp_path), "key", ["title", "body"])
    found = text_index.matches(spark, str(tmp_path), "text")
    buckets = {text_index._bucket_of(g) for g in text_index.grams_of("text")}
    read = {f.split("/_part=")[1].split("/")[0] for f in found.inputFiles() if "/postings/" in f}
    assert read == {str(b) for b in buckets} and found.count() == 50
    assert "In(gram" in found._jdf.queryExecution().toString()


def test_small_chunks_and_keys_that_come_twice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "CHUNK", 40)
    monkeypatch.setattr(text_index, "MOST_TEXTS", 3)
    rng, root = random.Random(7), str(tmp_path)
    now = {f"k{k}": ("".join(rng.choice("aabbc ") for _ in range(rng.randint(0, 90))), rng.choice([None, "abc ab"])) for k in range(40)}
    text_index.refresh(frame(spark, now).union(frame(spark, now)), root, "key", ["title", "body"])
    changed = {f"k{k}": ("abc" * k, None) for k in range(0, 40, 3)}
    text_index.refresh(frame(spark, changed), root, "key", ["title", "body"], spark.createDataFrame([("k1",), ("k4",)], "key string"))
    now = {k: v for k, v in (now | changed).items() if k not in ("k1", "k4")}
    for _ in range(2):
        for term in ("abc", "aab", "c ab"):
            assert {r["key"]: round(r["rank"], 9) for r in text_index.search_index(spark, root, term).collect()} == scan(spark, now, term), term
        text_index.compact(spark, root)


def test_the_postings_take_a_few_times_the_room_of_their_texts(spark, tmp_path):
    at = "/root/testdata/sf0.01/documents.parquet"
    text_index.refresh(spark.read.parquet(at), str(tmp_path), "doc_id", ["text"])
    size = sum(f.stat().st_size for f in (tmp_path / "postings").rglob("*.parquet"))
    assert size < 3.5 * Path(at).stat().st_size


def test_an_empty_index(spark, tmp_path):
    assert text_index.search_index(spark, str(tmp_path), "abc").count() == 0
    text_index.refresh(frame(spark, {"a": ("x", None)}).limit(0), str(tmp_path), "key", ["title", "body"])
    assert text_index.search_index(spark, str(tmp_path), "abc").count() == 0


@pytest.mark.parametrize(
    ("fields", "query", "want"),
    [
        (["İİİİ find the needle here"], "needle", "…the [needle] her…"),
        (["İİİİ find the needle here"], "i̇ f", "İİİ[İ f]ind the …"),
        (["short"], "hor", "s[hor]t"),
        (["needle"], "NEEDLE", "[needle]"),
        (["a needle at the end: needle"], "end", "… the [end]: need…"),
        (["one needle", "needle, needle and more text"], "needle", "[needle], [needle]…"),
        (["nothing", None, "it is here"], "here", "it is [here]"),
        (["a literal that is longer than twelve trigrams by far"], "literal that is longer than", "…[literal that is longer than]…"),
        (["ẞtraße needle"], "needle", "ẞtraße [needle]"),
        (["axb a.b"], "a.b", "axb [a.b]"),
    ],
)
def test_snippets(spark, fields, query, want):
    names = [f"f{k}" for k in range(len(fields))]
    row = spark.createDataFrame([tuple(fields)], ", ".join(f"{n} string" for n in names))
    assert row.select(search.snippet([F.col(n) for n in names], query)).first()[0] == want
