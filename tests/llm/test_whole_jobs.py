"""Text operators against what a cut-down version of them would lose."""

import random
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlake.llm import decontaminate, minhash


def tables(spark, texts, items):
    """Documents and benchmark items from lists of words."""
    both = (texts, "doc_id long, text string"), (items, "item_id long, text string")
    return [spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], schema) for rows, schema in both]


def leaks(texts, items):
    """(document, item): (similarity, first start of it), by comparing every window."""
    cut = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)])
    found = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            own = cut(item, min(5, len(item)))
            for a in range(max(0, len(text) - len(item)) + 1):
                there = cut(text[a : a + len(item)], min(5, len(item)))
                both = sum((there & own).values())
                either = sum((there | own).values())
                if 100 * both >= 80 * either and both / either > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (both / either, a)
    return found


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_lose_no_more_than_the_bands(spark, percent):
    n = minhash.BANDS * minhash.ROWS
    rows = []
    for k in range(n + 1):
        sig = minhash.packed((np.arange(n) < k).astype("<u4"))
        rows.append((k, 100, minhash.packed(np.zeros(n, "<u4")).tolist(), 100, sig.tolist()))
    got = spark.createDataFrame(rows, "k int, u_n long, u_sig array<bigint>, v_n long, v_sig array<bigint>").coalesce(1).filter(minhash._may_link("u", "v", percent))
    most = got.agg(F.max("k")).first()[0]  # unequal minima that still pass
    apart = (1 - percent / 100) * (1 - 1 / 2**minhash.BITS)
    lost = sum(comb(n, i) * apart**i * (1 - apart) ** (n - i) for i in range(most + 1, n + 1))
    assert lost <= (1 - (percent / 100) ** minhash.ROWS) ** minhash.BANDS


def test_leaks_in_another_order_and_shorter_documents(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [[word() for _ in range(n)] for n in (40, 50, 59, 59, 25, 15)]
    texts = [items[0][1:], items[2][:55], items[3] * 2, items[5][2:]]
    for item in items:
        half = len(item) // 2
        third = len(item) // 3
        for own in (item[half:] + item[:half], item[third : 2 * third] + item[:third] + item[2 * third :], item[:half] + ["x"] + item[half:], item):
            texts.append([word() for _ in range(rng.randint(0, 30))] + own + [word() for _ in range(rng.randint(0, 30))])
    want = leaks(texts, items)
    docs, bench = tables(spark, texts, items)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontaminate.leak_report(docs, bench).collect()}
    assert got == want and {(8, 1), (12, 2), (16, 3)} <= set(want)


def test_short_items_in_longer_documents(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 60)}"
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 4, 5, 9)]
    texts = [items[2][:2], items[4], []]
    for item in items * 2:
        texts.append([word() for _ in range(rng.randint(0, 20))] + item + [word() for _ in range(rng.randint(0, 20))])
    want = leaks(texts[:2], items) | {(d + 3, i): x for (d, i), x in leaks(texts[3:], items).items()}
    docs, bench = tables(spark, texts, items)
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontaminate.leak_report(docs, bench).collect()}
    assert got == want and {len(items[i]) for _, i in want} == {1, 2, 3, 4, 5, 9}


def test_leaks_far_apart_in_bits(spark):
    for seed in (134, 6635):  # similarity 0.8, and fingerprints 21 bits apart
        rng = random.Random(seed)
        item = [f"w{rng.randint(0, 10**6)}" for _ in range(19)]
        docs, bench = tables(spark, [item[:16]], [item])
        assert [r["similarity"] for r in decontaminate.leak_report(docs, bench).collect()] == [0.8]
