"""Suffix-array dedup: bytes covered by a string of NEED bytes that also starts elsewhere are removed.

1. Each window of NEED bytes has an anchor, its GRAM-byte run of smallest hash. Equal windows have equal anchors, so text
   whose anchors stand nowhere else holds no repeat and is done. An anchor's context is the union of its windows.
2. Equal contexts are one class: all windows of a class of two or more are repeats, and one context speaks for it.
3. Different contexts under one anchor are compared by their Burrows-Wheeler transforms: contexts are dealt by anchor,
   each task sorts the suffixes of small shards, and the shards' orders are merged by refining their interleave to twice
   the depth at a time. A block that is still shared at NEED symbols is a repeated interval (its common prefix is NEED or
   longer); entries alone in their block are settled and leave. Suffixes of different shards are never sorted together.
4. Anchors with more than HOT classes are split further, so that no task holds such an anchor's contexts: by bands of BAND
   window places that repeat whole, then by window, counted by digest with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage, text_of

NEED, GRAM = 400, 200
HOT, BAND = 1024, 16
SHARD_BYTES, TASK_BYTES = 1 << 17, 1 << 20
#: Symbols that a shard's first sort and the first interleave compare.
DEPTH = 8
#: Longer texts are scanned in pieces of this many window starts.
PIECE = 1 << 20
_NULL_ID = -(2**63)

_BASES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


class Digests:
    """64-bit digests of all substrings of a byte string: polynomials modulo 2^64 with an odd base, mixed."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        n = len(data)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base))))
        down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), inverse))))[:n]
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down)))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[begin]) * self.up[begin]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    right = np.minimum.accumulate(rows, 1).ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def anchors(data: np.ndarray, need: int, gram: int) -> dict[str, np.ndarray]:
    """h (anchor's hash), p (its place), lo and hi (first and last start of its windows), d1, d2 (digests of [lo, hi + need))."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("h", "p", "lo", "hi", "d1", "d2")}
    for base in range(0, len(data) - need + 1, PIECE):
        part = data[base : base + PIECE + need - 1]
        one, two = (Digests(part, b) for b in _BASES)
        at = np.arange(len(part) - gram + 1)
        h = one.of(at, at + gram)
        # the place breaks ties within a window, the same way in equal windows
        low = _sliding_min((h >> np.uint64(23) << np.uint64(23)) | at.astype(np.uint64), need - gram + 1)
        lo = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        hi = np.append(lo[1:], len(low)) - 1
        p = (low[lo] & np.uint64((1 << 23) - 1)).astype(np.int64)
        for k, v in (("h", h[p]), ("p", p + base), ("lo", lo + base), ("hi", hi + base), ("d1", one.of(lo, hi + need)), ("d2", two.of(lo, hi + need))):
            out[k].append(v.view(np.int64))
    return {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}


class Shard:
    """The sorted suffixes of a few strings, as their Burrows-Wheeler transform orders them: place of each, key (its first
    DEPTH symbols) and inner (no end among these). ahead() steps from a suffix to shorter ones, as the transform's inverse
    does."""

    def __init__(self, strings: list[bytes]):
        t = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)  # no byte of UTF-8
        n = len(t)
        code = np.where(t == 255, 0, t.astype(np.uint64) + np.uint64(1))
        # eight symbols at once; an end is the least symbol, and nothing follows it
        key, inner, step = code, code > 0, 1
        while step < DEPTH:
            ahead = np.zeros(n, np.uint64)
            ahead[:-step] = key[step:]
            key = key << np.uint64(8 * step) | np.where(inner, ahead, np.uint64(0))
            inner[:-step] &= inner[step:].copy()
            inner[-step:] = False
            step *= 2
        whole = inner.copy()
        order = np.argsort(key)
        first = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
        slots, rank = np.arange(n), np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
        open_ = ~(first & np.append(first[1:], True))
        while len(slots := slots[open_]):  # only suffixes that equal others so far are sorted on
            at = order[slots]
            # ends differ by their string; what has no end within so many symbols goes by the symbols behind them
            by = rank[at] << 32 | np.where(inner[at], rank[np.minimum(at + step, n - 1)], at)
            own = np.argsort(by)
            at, by = at[own], by[own]
            first = np.concatenate(([True], by[1:] != by[:-1]))
            order[slots] = at
            rank[at] = np.maximum.accumulate(np.where(first, slots, 0))
            open_ = ~(first & np.append(first[1:], True))
            inner[at] = True
            step *= 2
        self.place, self.rank, self.key, self.inner = order, rank, key[order], whole[order]

    def ahead(self, d: int) -> np.ndarray:
        """Where the suffix stands that begins d symbols later (the last one, if none does)."""
        return self.rank[np.minimum(self.place + d, len(self.place) - 1)]


def _interleave(of: np.ndarray, high: np.ndarray, low: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of equal (high, low) among the entries of, which each shard holds in order, so that sorting merges them:
    block numbers in merged order, and whether an entry shares its block; entries alone are settled."""
    key = high if low is None else high << 32 | low
    order = np.argsort(key, kind="stable")
    at, key = of[order], key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    block, shared = np.zeros(n, np.int64), np.zeros(n, bool)
    block[at] = np.cumsum(first)
    shared[at] = ~(first & np.append(first[1:], True)[: len(key)])
    return block, shared


def merge_repeats(strings: list[bytes], need: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string the places where a run of need bytes (DEPTH or more) starts that also starts elsewhere in them.

    The interleave of the shards' suffixes is refined to twice the depth by merging each shard's order of (block of the
    suffix, block of the one so many symbols later). Blocks left at need symbols have a common prefix of that length.
    """
    shards, owner, part, size = [], [], [], 0
    for k, s in enumerate(strings):
        part.append(k)
        size += len(s) + 1
        if size >= shard_bytes or k == len(strings) - 1:
            shards.append(Shard([strings[i] for i in part]))
            owner.append(part)
            part, size = [], 0
    bases = np.concatenate(([0], np.cumsum([len(s.place) for s in shards])))
    n = int(bases[-1])
    of = np.flatnonzero(np.concatenate([s.inner for s in shards]))
    block, shared = _interleave(of, np.concatenate([s.key for s in shards])[of], None, n)
    depth = DEPTH
    while depth < need:
        step = min(depth, need - depth)
        ahead = np.concatenate([s.ahead(step) + b for s, b in zip(shards, bases, strict=False)])
        of = np.flatnonzero(shared & shared[ahead])
        block, shared = _interleave(of, block[of], block[ahead[of]], n)
        depth += step
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(strings)
    for shard, mine, base, end in zip(shards, owner, bases, bases[1:], strict=False):
        at = np.sort(shard.place[shared[base:end]])
        begins = np.concatenate(([0], np.cumsum([len(strings[k]) + 1 for k in mine])))
        for k, a, b in zip(mine, begins, begins[1:], strict=False):
            out[k] = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a
    return out


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive places as (first, last)."""
    cuts = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, cuts + 1)].tolist(), places[np.append(cuts, len(places) - 1)].tolist(), strict=True)) if len(places) else []


_ANCHOR = "doc long, th long, h long, p long, lo long, hi long, d1 long, d2 long, m long"


def _scan(rows: DataFrame, need: int, gram: int) -> DataFrame:
    """The anchors of each text, equal contexts of a text once with their number m; rows with m = 0 are byte ranges (lo, hi)
    that such contexts cover: a long run of one character, or of few in turn, is one anchor and one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                if len(data) >= need:
                    found = _fold(anchors(data, need, gram), need)
                    n = len(found["h"])
                    yield pa.record_batch({"doc": pa.array(np.full(n, doc, np.int64)), "th": pa.array(np.full(n, th, np.int64)), **{k: pa.array(v) for k, v in found.items()}})

    return rows.select("doc", "th", "data").filter(F.octet_length("data") >= need).mapInArrow(run, _ANCHOR)


def _fold(found: dict[str, np.ndarray], need: int) -> dict[str, np.ndarray]:
    kind = (found["d1"], found["d2"], found["h"], found["p"] - found["lo"], found["hi"] - found["lo"])
    order = np.lexsort(kind)  # stable: the first of equal contexts comes first
    first = np.ones(len(order), bool)
    for x in kind:
        first[1:] &= x[order[1:]] == x[order[:-1]]
    first[1:] = ~first[1:]
    group = np.cumsum(first) - 1
    many = np.bincount(group)
    twice = np.zeros(len(order), bool)
    twice[order] = many[group] > 1
    begin, end = found["lo"][twice], found["hi"][twice] + need  # in the order of the text
    reach = np.maximum.accumulate(end) if len(end) else end
    cuts = np.flatnonzero(begin[1:] > reach[:-1])
    begin, end = (begin[np.append(0, cuts + 1)], reach[np.append(cuts, len(reach) - 1)]) if len(begin) else (begin, end)
    none = np.zeros(len(begin), np.int64)
    whole = {k: v[order[first]] for k, v in found.items()} | {"m": many.astype(np.int64)}
    ranges = {"lo": begin, "hi": end}
    return {k: np.concatenate((v, ranges.get(k, none))) for k, v in whole.items()}


def _bodies(rows: DataFrame, reps: DataFrame, need: int) -> DataFrame:
    """h, cid, off (of the anchor), body of each representative context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, xs in zip(batch["data"], batch["xs"], strict=True):
                data, own = text.as_py(), xs.as_py()
                yield pa.record_batch({"h": pa.array([x["h"] for x in own], pa.int64()), "cid": pa.array([x["cid"] for x in own], pa.int64()), "off": pa.array([x["p"] - x["lo"] for x in own], pa.int64()), "body": pa.array([data[x["lo"] : x["hi"] + need] for x in own], pa.binary())})

    by_doc = reps.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "cid", "p", "lo", "hi")).alias("xs"))
    held = rows.join(by_doc.hint("merge"), ["doc", "th"]).select("data", "xs", "doc", "th")
    return held.mapInArrow(run, "h long, cid long, off long, body binary").dropDuplicates(["cid"])


def _by_transform(bodies: DataFrame, need: int) -> DataFrame:
    """cid, first, last: runs of repeated window starts in a context."""

    def decide(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        rows = [(cid, a, b) for (cid, _), at in zip(held, merge_repeats([x for _, x in held], need), strict=True) for a, b in _runs(at)]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["cid", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for h, cid, body in zip(batch["h"].to_pylist(), batch["cid"].to_pylist(), batch["body"].to_pylist(), strict=True):
                if size >= TASK_BYTES and h != last:
                    yield decide(held)
                    held, size = [], 0
                held.append((cid, body))
                size, last = size + len(body), h
        if held:
            yield decide(held)

    return bodies.select("h", "cid", "body").repartition("h").sortWithinPartitions("h").mapInArrow(run, "cid long, first long, last long")


def _by_digest(bodies: DataFrame, need: int) -> DataFrame:
    """The same for contexts under very common anchors: bands of BAND places that repeat whole, then the single windows of
    other bands whose core repeats."""

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, cid, off, body in zip(*(batch[c].to_pylist() for c in ("h", "cid", "off", "body")), strict=True):
                one, two = (Digests(np.frombuffer(body, np.uint8), b) for b in _BASES)
                bands = np.arange(max(0, off - (len(body) - need)) // BAND, off // BAND + 1)
                last = off - bands * BAND
                first = last - BAND + 1
                inside = (first >= 0) & (last + need <= len(body))
                core = one.of(np.clip(last, 0, None), np.minimum(first + need, len(body)))
                span = np.clip(first, 0, None), np.minimum(last + need, len(body))
                cols = {"band": bands, "d": core.view(np.int64), "f1": one.of(*span).view(np.int64), "f2": two.of(*span).view(np.int64), "first": first, "last": last}
                n = len(bands)
                yield pa.record_batch({"h": pa.array([h] * n, pa.int64()), "cid": pa.array([cid] * n, pa.int64()), **{k: pa.array(v, mask=~inside if k == "f1" else None) for k, v in cols.items()}})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, cid, off, body, bands in zip(*(batch[c].to_pylist() for c in ("h", "cid", "off", "body", "bands")), strict=True):
                data = np.frombuffer(body, np.uint8)
                places = (np.array([x["band"] for x in bands])[:, None] * BAND + np.arange(BAND)).ravel()
                real = (places <= off) & (off - places + need <= len(body))
                start = off - places[real]
                one, two = (Digests(data, b).of(start, start + need).view(np.int64) for b in _BASES)
                done = np.repeat([x["done"] for x in bands], BAND)[real]
                n = len(start)
                yield pa.record_batch({"h": pa.array([h] * n, pa.int64()), "cid": pa.array([cid] * n, pa.int64()), "start": pa.array(start), "place": pa.array(off - start), "w1": pa.array(one), "w2": pa.array(two), "done": pa.array(done)})

    whole = ["h", "band", "f1", "f2"]
    c = stage(bodies.mapInArrow(cores, "h long, cid long, band long, d long, f1 long, f2 long, first long, last long"), "cores")
    twice = c.filter("f1 IS NOT NULL").groupBy(*whole).agg(F.count("*").alias("n")).filter("n > 1")
    c = stage(c.join(twice.hint("merge"), whole, "left").withColumn("done", F.col("n").isNotNull()), "cores")
    again = c.groupBy("h", "band", "d").agg(F.count("*").alias("k"), F.count_if(~F.col("done")).alias("open")).filter("k > 1 AND open > 0").select("h", "band", "d")
    left = c.join(again.hint("merge"), ["h", "band", "d"]).groupBy("cid").agg(F.collect_list(F.struct("band", "done")).alias("bands"))
    w = stage(bodies.join(left, "cid").select("h", "cid", "off", "body", "bands").mapInArrow(windows, "h long, cid long, start long, place long, w1 long, w2 long, done boolean"), "windows")
    same = w.groupBy("h", "place", "w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    single = w.filter("NOT done").join(same.hint("merge"), ["h", "place", "w1", "w2"])
    return c.filter("done").select("cid", "first", "last").unionByName(single.select("cid", F.col("start").alias("first"), F.col("start").alias("last")))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", need: int = NEED, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc, th (hash of the text), begin, end: byte ranges to remove; they may overlap."""
    rows = _rows(docs, id_col, text_col)
    all_scanned = stage(_scan(rows, need, gram), "anchors")
    scanned, within = all_scanned.filter("m > 0"), all_scanned.filter("m = 0").select("doc", "th", F.col("lo").alias("begin"), F.col("hi").alias("end"))
    shared = stage(scanned.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared")
    met_all = stage(scanned.join(shared.hint("merge"), "h"), "anchors")
    kind = ["h", "off", "len", "d1", "d2"]
    met = met_all.select("doc", "th", "h", "p", "lo", "hi", (F.col("p") - F.col("lo")).alias("off"), (F.col("hi") - F.col("lo")).alias("len"), "d1", "d2", "m")
    classes = met.groupBy(*kind).agg(F.sum("m").alias("n"), F.min(F.struct("doc", "th", "p", "lo", "hi")).alias("rep"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), *kind, "n", "rep.*"), "contexts")
    whole = met.join(classes.filter("n > 1").select(*kind).hint("merge"), kind).select("doc", "th", F.col("lo").alias("begin"), (F.col("hi") + need).alias("end"))
    crowd = stage(classes.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"), "crowds")
    reps = stage(classes.join(crowd.hint("merge"), "h").select("cid", "h", "k", "doc", "th", "p", "lo", "hi", "n"), "contexts")
    bodies = stage(_bodies(rows, reps, need), "bodies")
    common = reps.filter(F.col("k") > hot).select("h").distinct()
    found = _by_transform(bodies.join(common.hint("merge"), "h", "left_anti"), need)
    found = found.unionByName(_by_digest(stage(bodies.join(common.hint("merge"), "h", "left_semi"), "bodies"), need))
    # classes of two or more are covered already
    part = found.join(reps.filter("n = 1").select("cid", "doc", "th", "lo"), "cid").select("doc", "th", (F.col("lo") + F.col("first")).alias("begin"), (F.col("lo") + F.col("last") + need).alias("end"))
    out = stage(whole.unionByName(part).unionByName(within), "ranges")
    drop_staged(shared, all_scanned, crowd, met_all, classes, reps, bodies)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", need: int = NEED, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (remaining bytes).

    Strings are judged on the input, within a document too; overlaps count. A null text counts as empty; texts shorter
    than need stay whole. Repeated rows are repeats of each other. Other columns are not read. An empty table gives no rows.
    A text of any length that fits a row is taken whole; the ranges of one text meet in one row.
    """
    ranges = repeated_ranges(docs, id_col, text_col, need, gram, hot)
    by_doc = ranges.groupBy("doc", "th").agg(F.collect_set(F.struct("begin", "end")).alias("xs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, xs in zip(batch["data"], batch["xs"], strict=True):
                data, own = text.as_py(), sorted((x["begin"], x["end"]) for x in xs.as_py() or ())
                spans: list[list[int]] = []
                for a, b in own:
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                at = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
                for col, v in zip(out, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    col.append(v)
            yield pa.record_batch([batch["doc"], *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = _rows(docs, id_col, text_col).join(by_doc.hint("merge"), ["doc", "th"], "left").select("doc", "data", "xs")
    done = rows.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
