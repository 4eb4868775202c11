"""MinHash near-dedup: universal hash minima in bands, verified signatures and sets, connected components.

Rows with equal shingle sets form one class, and classes are what is compared. Classes that share a band meet in a
bucket. In a bucket nobody is paired with everybody: every class meets the bucket's leader, the class that shares most
buckets with others, and what verifies is joined into components. Buckets that still hold several components are open.
Open buckets that share classes form a region, with its most shared class as pivot. There the links are found by overlap:
a class is written as its difference d from the pivot, so that two classes differ by as much as their d do. With the
elements of d ordered from rare to common, the first ones of two linked classes must meet (see _prefixes), which holds
for every link of a region. So a large group of copies costs about one pair per member, and no link that a bucket could
give is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, drop_staged, stage, text_of, text_slices

#: At a similarity of 0.8, 32 bands of 4 minima miss a pair with a chance of 5e-8; at 0.85 of 6e-11.
BANDS, ROWS = 32, 4
#: Low bits kept of each minimum, packed into longs. Unequal minima agree in them with a chance of 1/16.
BITS = 4
#: Agreement this far below what the threshold gives ends a pair before its sets are read: over seven deviations of 128
#: minima. It loses a pair at 0.8 with a chance of 8e-11, at 0.85 of 7e-13, so the banding above stays the real miss.
SLACK = 0.25
#: Elements that more than this share of a region's classes have are ordered by their count, rarer ones by their hash.
COMMON = 1 / 256
_NULL_ID = -(2**63)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: a published 64-bit mixer


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the distinct 64-bit hashes of its word shingles, sorted."""
    import xxhash

    w = Words(texts, fold=True)
    known = np.array([xxhash.xxh3_64_intdigest(x) for x in w.known.to_numpy(zero_copy_only=False)], np.uint64)
    h = known[w.at] if len(known) else np.empty(0, np.uint64)

    def runs(h: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
        return out

    whole = runs(h, width) if len(h) >= width else h[:0]
    for a, b in zip(w.begins.tolist(), w.ends.tolist(), strict=True):
        yield np.unique(whole[a : b - width + 1] if b - a >= width else runs(h[a:b], b - a) if b > a else h[:0])


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n universal hash functions x -> (a x + b) mod 2^32."""
    draw = np.random.default_rng(20240229).integers(0, 2**31, (2, n), dtype=np.uint32) * np.uint32(2)
    return draw[0] + np.uint32(1), draw[1] + np.uint32(1)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum under each hash function of the shingles' upper 32 bits."""
    best, upper = np.full(len(a), np.iinfo(np.uint32).max, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(upper), 512):
        x = a[:, None] * upper[None, k : k + 512]
        x += b[:, None]
        np.minimum(best, x.min(1), out=best)
    return best


def packed(sig: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, 16 minima to a long."""
    low = (sig.astype(np.uint64) & np.uint64((1 << BITS) - 1)).reshape(*sig.shape[:-1], -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(-1, dtype=np.uint64).view(np.int64)


def _buckets(sigs: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band's minima and number, for each row of minima."""
    parts = sigs.reshape(len(sigs), bands, -1).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(parts.shape[2]):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key and th (which tell texts of rows apart, also without id), text."""
    text = text_of(text_col)
    id_ = F.col(id_col).cast("long")
    return docs.select(id_.alias("id"), F.coalesce(id_, F.lit(_NULL_ID)).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))


_SIGNED = "id long, key long, th long, n long, set binary, sig array<bigint>, bands array<bigint>"


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, key, th, n (shingles), set (128-bit digest; null if empty), sig (packed minima), bands (a bucket for each)."""
    a, b = _family(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch["text"]):
                sizes, sets, sigs = [], [], []
                for s in shingle_sets(texts, width):
                    sizes.append(len(s))
                    sets.append(_digest(s) if len(s) else None)
                    sigs.append(signature(s, a, b))
                sigs = np.array(sigs)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (packed(sigs), _buckets(sigs, bands))]
                own = batch.slice(at, len(texts))
                yield pa.record_batch([own["id"], own["key"], own["th"], pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), *lists], names=["id", "key", "th", "n", "set", "sig", "bands"])
                at += len(texts)

    return _rows(docs, id_col, text_col).mapInArrow(run, _SIGNED)


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """cid, shingles (array) of the wanted (cid, set, key, th): shingled again from one row of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch["text"]):
                s = list(shingle_sets(texts, width))
                ends = np.cumsum([0, *map(len, s)]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(s).view(np.int64)))
                yield pa.record_batch([batch["cid"].slice(at, len(texts)), held], names=["cid", "shingles"])
                at += len(texts)

    rows = _rows(docs, id_col, text_col).join(wanted.select("cid", "key", "th"), ["key", "th"]).dropDuplicates(["cid"])
    return rows.select("cid", "text").mapInArrow(run, "cid long, shingles array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) by alternating large-star and small-star; edges (u, v) of any type."""

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def little(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        return down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()

    now = stage(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    while True:
        new = stage(little(large(now)), "edges")
        # equal iff nothing is new on either side; both are distinct
        same = now.count() == new.count() and new.join(now, ["u", "v"], "left_anti").isEmpty()
        drop_staged(now)
        now = new
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def _may_link(u: str, v: str, percent: int) -> Column:
    """Whether sizes and signatures (u_n, u_sig, ...) leave a link possible."""
    ones = F.lit(int("1" * (64 // BITS), 16))

    def unequal(k: int) -> Column:
        """How many of the 16 minima in long k differ."""
        x = F.col(f"{u}_sig")[k].bitwiseXOR(F.col(f"{v}_sig")[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))

    total = BANDS * ROWS
    agree = percent / 100 + (1 - percent / 100) / 2**BITS
    apart = sum((unequal(k) for k in range(1, total * BITS // 64)), unequal(0))
    return (100 * F.least(f"{u}_n", f"{v}_n") >= percent * F.greatest(f"{u}_n", f"{v}_n")) & (apart <= int((1 - agree + SLACK) * total))


def _linked(n_u: Column, n_v: Column, apart: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, from the sizes and how many elements only one of the sets has."""
    return 100 * (n_u + n_v - apart) >= percent * (n_u + n_v + apart)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union."""
    own = classes.select("cid", "n", "sig")
    side = lambda k: own.select(F.col("cid").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("n", "sig")])
    held = pairs.join(side("u"), "u").join(side("v"), "v").filter(_may_link("u", "v", percent))
    held = stage(held.select("u", "v", "u_n", "v_n"), "pairs")
    wanted = held.select(F.explode(F.array("u", "v")).alias("cid")).distinct().join(classes, "cid")
    sets = stage(_sets(docs, id_col, text_col, width, wanted), "sets")

    @F.pandas_udf("long")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")

    of = lambda k: sets.select(F.col("cid").alias(k), F.col("shingles").alias(f"{k}_s"))
    met = held.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_n", "v_n", shared("u_s", "v_s").alias("both"))
    found = stage(met.filter(_linked(F.col("u_n"), F.col("v_n"), F.col("u_n") + F.col("v_n") - 2 * F.col("both"), percent)).select("u", "v"), "links")
    drop_staged(held, sets)
    return found


def _prefixes(deltas: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """region, elem, cid, root, n, size (of d), place: the first elements of each class's d, from rare to common.

    Linked classes of n elements differ by at most D = floor(n * (100 / percent - 1)), for the n of either, and so do
    their d. Then the first D + 1 elements of both d share one, unless both are within reach of the pivot, to which they
    then link. At their first common element as many elements as they share must be left in both. common: region, elems
    (ascending counts).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cid", "region", "root", "n", "size"]
        for batch in batches:
            out: list[np.ndarray] = []
            for n, d, often in zip(batch["n"].to_pylist(), batch["d"], batch["elems"], strict=True):
                d, often = np.asarray(d.values), np.asarray(often.values) if often.is_valid else np.empty(0, np.int64)
                usual = np.isin(d, often)
                d = np.concatenate((d[~usual], often[np.isin(often, d)]))
                out.append(d[: n * (100 - percent) // percent + 1])
            sizes = [len(x) for x in out]
            at = np.repeat(np.arange(len(out)), sizes)
            place = np.arange(len(at)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
            yield pa.record_batch([*(batch[c].take(pa.array(at)) for c in names), pa.array(np.concatenate(out) if out else []).cast(pa.int64()), pa.array(place)], names=[*names, "elem", "place"])

    rows = deltas.join(common.hint("merge"), "region", "left").select("cid", "region", "root", "n", "size", "d", "elems")
    return rows.mapInArrow(run, "cid long, region long, root long, n long, size long, elem long, place long")


def _open_links(opened: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Links (u, v) between components in open buckets: opened (bucket, cid, root, pop, hub)."""
    region = components(opened.select(F.col("hub").alias("u"), F.col("cid").alias("v"))).withColumnsRenamed({"node": "cid", "root": "region"})
    own = stage(opened.select("cid", "root", "pop").distinct().join(region, "cid"), "open")
    pivot = own.groupBy("region").agg(F.max(F.struct("pop", "cid"))["cid"].alias("pivot"), F.count("*").alias("m"))
    sets = stage(_sets(docs, id_col, text_col, width, own.select("cid").join(classes, "cid")), "sets")
    pivots = stage(pivot.join(sets, F.col("pivot") == F.col("cid")).select("region", "pivot", F.col("shingles").alias("p")), "pivots")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [np.setxor1d(np.asarray(s.values), np.asarray(p.values), assume_unique=True) for s, p in zip(batch["shingles"], batch["p"], strict=True)]
            sizes = [len(s.values) for s in batch["shingles"]]
            ends = np.cumsum([0, *map(len, d)]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(d) if d else []).cast(pa.int64()))
            yield pa.record_batch([batch["cid"], batch["region"], batch["root"], batch["pivot"], pa.array(sizes, pa.int64()), pa.array([len(p.values) for p in batch["p"]], pa.int64()), pa.array(np.diff(ends).astype(np.int64)), held], names=["cid", "region", "root", "pivot", "n", "p_n", "size", "d"])

    rows = own.join(sets, "cid").join(pivots.hint("merge"), "region").select("cid", "region", "root", "pivot", "shingles", "p")
    deltas = stage(rows.mapInArrow(differ, "cid long, region long, root long, pivot long, n long, p_n long, size long, d array<bigint>"), "deltas")
    counts = deltas.select("region", F.explode("d").alias("elem")).groupBy("region", "elem").agg(F.count("*").alias("c")).filter("c >= 8")
    counts = counts.join(pivot, "region").filter(F.col("c") >= F.col("m") * COMMON)
    common = counts.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "elem"))), lambda x: x["elem"]).alias("elems"))
    common = stage(common, "common")
    first = stage(_prefixes(deltas, common, percent), "prefixes")
    side = lambda k: first.select("region", "elem", *[F.col(c).alias(f"{k}_{c}" if c != "cid" else k) for c in ("cid", "root", "n", "size", "place")])
    shared = F.least(F.col("u_size") - F.col("u_place"), F.col("v_size") - F.col("v_place"))
    reach = F.expr("u < v AND u_root <> v_root") & _linked(F.col("u_n"), F.col("v_n"), F.col("u_size") + F.col("v_size") - 2 * shared, percent)
    pairs = stage(side("u").join(side("v"), ["region", "elem"]).filter(reach).select("u", "v", "u_n", "v_n").distinct(), "pairs")
    of = lambda k: deltas.select(F.col("cid").alias(k), F.col("d").alias(f"{k}_d"))
    both = F.size(F.array_intersect("u_d", "v_d"))
    met = pairs.join(of("u"), "u").join(of("v"), "v").filter(_linked(F.col("u_n"), F.col("v_n"), F.size("u_d") + F.size("v_d") - 2 * both, percent))
    near = deltas.filter((F.col("cid") != F.col("pivot")) & _linked(F.col("n"), F.col("p_n"), F.col("size"), percent))
    links = stage(met.select("u", "v").union(near.select("pivot", "cid")), "links")
    drop_staged(own, sets, pivots, deltas, common, first, pairs)
    return links


def _labels(links: DataFrame) -> DataFrame:
    """cid, root of every class that has a link."""
    return stage(components(links).select(F.col("node").alias("cid"), "root"), "roots")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text's set holds its distinct shingles of width words, or all
    its words as one if they are fewer. Rows link when 100 * intersection >= percent * union of their sets; a component
    is named by its smallest id. A null or empty text has no shingles, links with nothing and stays. kept: the id is the
    component's. Rows with null ids link others like any row, have null components and stay. Repeated rows are all kept
    or all dropped with their id. Other columns are not read; an empty table gives no rows. Texts of any length are
    shingled whole; ids that are no longs are cast.
    """
    signed = stage(sign(docs, id_col, text_col, width), "signed")
    classes = signed.filter("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("first"), F.min(F.struct("key", "th")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), "set", "first", "rep.*", "n", "sig", "bands"), "classes")
    member = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = stage(member.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    met = stage(member.join(shared.hint("merge"), "bucket"), "buckets")
    member = stage(met.join(met.groupBy("cid").agg(F.sum("c").alias("pop")), "cid").select("bucket", "cid", "pop"), "buckets")
    lead = stage(member.groupBy("bucket").agg(F.max(F.struct("pop", "cid"))["cid"].alias("lead")), "leads")
    pairs = member.join(lead.hint("merge"), "bucket").filter("cid <> lead").select(F.col("lead").alias("u"), F.col("cid").alias("v")).distinct()
    links = _verified(pairs, classes, docs, id_col, text_col, width, percent)
    root = _labels(links)
    named = member.join(root, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("pop", "cid"))["cid"].alias("hub")).filter("lo < hi")
    mixed = stage(mixed.select("bucket", "hub"), "leads")
    opened = stage(named.join(mixed.hint("merge"), "bucket"), "open")
    root = _labels(links.union(_open_links(opened, classes, docs, id_col, text_col, width, percent)))
    drop_staged(shared, met, member, lead, mixed, opened)
    named = classes.select("cid", "first").join(root, "cid")
    ids = named.groupBy("root").agg(F.min("first").alias("component")).join(named.select("cid", "root"), "root").select("cid", "component")
    firsts = classes.select("set", "cid", "first").join(ids.hint("merge"), "cid", "left").select("set", F.coalesce("component", "first").alias("component"))
    out = signed.select("id", "n", "set").withColumn("set", F.coalesce("set", F.expr("cast(concat('none', uuid()) AS binary)"))).join(firsts.hint("merge"), "set", "left")
    name = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(name == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows whose id names its component; of repeated rows with that id all stay. Nulls and empty
    tables as in near_groups; other columns pass through under any name."""
    gone = near_groups(docs, id_col, text_col, width, percent).filter("not kept").select(F.col(id_col).cast("long").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])
