"""Benchmark decontamination in DataFrame operations only: SimHash of item-sized windows, a multi-index over Hamming
blocks, and exact weighted-shingle similarity.

A window of a document has as many words as a benchmark item (the whole document if that is shorter). It cannot be more
similar to an item of that size than the number of its shingles that items of that size have allows, wherever these stand,
so every window with enough of them is taken, and no other. Their fingerprints are looked up in an index of all items of
that size: a fingerprint is cut into BLOCKS
blocks, and an item is entered under every value within BLOCK_RADIUS bits of each of its blocks, so that every
fingerprint within RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1 bits meets it. Those pairs are then compared exactly.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, bind, drop_staged, small, stage, text_of

WIDTH, PERCENT = 5, 80
#: 63 bits in 9 blocks of 7. The radius is all that the index is sure to meet; exact similarity decides within it.
LANES, STEP = 3, 21
BITS = LANES * STEP
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 9, 7, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Item shingles up to this count (a hash, an item and two places each) are broadcast; more are joined by shuffle.
BROADCAST_SHINGLES = 2_000_000
#: So are the keys of documents that share a shingle, 16 bytes each.
BROADCAST_DOCS = 1_000_000
_NULL_ID = -(2**63)


def _word_hashes(text: Column) -> Column:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in order."""
    cut = F.split(F.trim(ascii_lower(text), F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+", -1)
    return F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of width words, in order; all words as one run if they are fewer; none without words."""

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda k: F.xxhash64(*[F.get(h, k + j) for j in range(width)]))
        return F.when(F.size(h) >= width, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bind(words, of)  # a run hashes as the array of its words does


def _counted(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "h").agg(F.count("*").alias("c"))


def _fingerprints(counted: DataFrame, by: list[str]) -> DataFrame:
    """by, n (shingles), fp: a bit is set if more than half of the shingles, by weight, have it. STEP sums hold LANES
    counters each, so a window may have two million shingles."""
    mask = sum(1 << (STEP * lane) for lane in range(LANES))
    sums = [F.sum(F.col("c") * F.shiftrightunsigned("h", k).bitwiseAND(F.lit(mask))).alias(f"s{k}") for k in range(STEP)]
    rows = counted.groupBy(*by).agg(F.sum("c").alias("n"), *sums)
    bit = lambda k, lane: F.when(F.shiftrightunsigned(f"s{k}", STEP * lane).bitwiseAND(F.lit((1 << STEP) - 1)) * 2 > F.col("n"), F.lit(1 << (k + STEP * lane))).otherwise(F.lit(0).cast("long"))
    return rows.select(*by, "n", reduce(Column.bitwiseOR, [bit(k, lane) for k in range(STEP) for lane in range(LANES)]).alias("fp"))


def _blocks(fp: Column) -> Column:
    values = [F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for b in range(BLOCKS)]
    return F.array(*[F.struct(F.lit(b).alias("block"), v.alias("value")) for b, v in enumerate(values)])


def _index(items: DataFrame) -> DataFrame:
    """size, block, value, item, fp, n: an item under each value near each of its blocks."""
    near = [sum(1 << k for k in bits) for r in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), r)]
    rows = items.select("size", "item", "fp", "n", F.explode(_blocks(F.col("fp"))).alias("b"))
    return rows.select("size", "item", "fp", "n", "b.block", F.explode(F.transform(F.array(*map(F.lit, near)), lambda flip: F.col("b.value").bitwiseXOR(flip.cast("long")))).alias("value"))


def _starts(shared: DataFrame, width: int, percent: int) -> DataFrame:
    """doc, th, size, start of every window that can reach percent: from doc, th, m (shingles of the document), size and p
    (place of a shingle that an item of that size has). Windows lie inside the document; a shorter document is one."""
    own = shared.groupBy("doc", "th", "size").agg(F.max("m").alias("m"), F.array_sort(F.collect_set("p")).alias("at"))
    n_item = F.greatest(F.col("size") - width + 1, F.lit(1))
    own = own.withColumn("n", F.least("m", n_item)).withColumn("need", F.greatest(F.lit(1), F.ceil(percent * (F.col("n") + n_item) / (100 + percent) - F.lit(1e-9))).cast("int"))
    own = own.filter("size(at) >= need")

    def span(x: Column, k: Column) -> Column:
        """Starts of the windows whose first shared shingle is number k, at x, and that hold need of them."""
        lo = F.greatest(F.lit(0), F.get("at", k + F.col("need") - 1) - F.col("n") + 1, F.coalesce(F.get("at", k - 1) + 1, F.lit(0)))
        return F.struct(lo.alias("lo"), F.least(x, F.col("m") - F.col("n")).alias("hi"))

    spans = F.filter(F.transform(F.slice("at", F.lit(1), F.size("at") - F.col("need") + 1), span), lambda s: s["lo"] <= s["hi"])
    return own.select("doc", "th", "size", F.explode(spans).alias("s")).select("doc", "th", "size", F.explode(F.sequence("s.lo", "s.hi")).alias("start"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document and item that it holds: doc and item (null ids as the least long), th (hash of the text), start
    (word where the best window begins), similarity.

    Weights are multiplicities: similarity = sum of the shingles' smaller counts / sum of their larger counts, and
    percent / 100 of it or more is a leak. Null or empty texts hold and are nothing; items with fewer words than width
    are one shingle, and so are the windows of their size; repeated rows count once; other columns
    are not read; empty tables give no rows. A text's words must fit a row; ids that are no longs are cast.
    """
    b = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(_NULL_ID)).alias("item"), _word_hashes(text_of(item_text_col)).alias("w")).distinct().filter("size(w) > 0")
    placed = stage(b.select("item", F.size("w").alias("size"), F.explode(_shingles(F.col("w"), width)).alias("h")), "items")
    n_shingles = placed.count()
    item_counts = _counted(placed, ["item", "size"])
    item_prints = stage(_fingerprints(item_counts, ["item", "size"]), "items")

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), text_of(text_col).alias("t")).withColumn("th", F.xxhash64("t"))
    # an item shorter than width meets runs of its own length
    placed = placed.withColumn("k", F.least("size", F.lit(width)))
    lengths = [r["k"] for r in placed.select("k").distinct().collect()]

    def meet(k: int) -> DataFrame:
        cut = rows.select("doc", "th", _shingles(_word_hashes(F.col("t")), k).alias("s")).withColumn("m", F.size("s"))
        own = placed.filter(F.col("k") == k).select("h", "size").distinct()
        return cut.select("doc", "th", "m", F.posexplode("s").alias("p", "h")).join(small(own, n_shingles, BROADCAST_SHINGLES), "h")

    shared = reduce(DataFrame.unionByName, map(meet, lengths or [width]))
    starts = stage(_starts(shared, width, percent), "starts")
    held = starts.select("doc", "th").distinct()
    words = rows.join(small(held, held.count(), BROADCAST_DOCS), ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]).select("doc", "th", _word_hashes(F.col("t")).alias("w"))
    windows = words.join(starts, ["doc", "th"]).select("doc", "th", "size", "start", F.slice("w", F.col("start") + 1, F.col("size")).alias("w"))
    key = ["doc", "th", "size", "start"]
    counted = stage(_counted(windows.select(*key, F.explode(_shingles(F.col("w"), width)).alias("h")), key), "windows")
    prints = _fingerprints(counted, key).select(*key, "n", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select(*key, "n", "fp", "b.*")
    index = _index(item_prints).select("size", "block", "value", "item", F.col("fp").alias("item_fp"), F.col("n").alias("item_n"))
    pairs = prints.join(index, ["size", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*key, "n", "item", "item_n").distinct()
    pairs = stage(pairs, "pairs")
    both = pairs.join(counted, key).join(item_counts.select("item", "h", F.col("c").alias("ic")), ["item", "h"]).groupBy(*key, "item", "n", "item_n").agg(F.sum(F.least("c", "ic")).alias("both"))
    either = F.col("n") + F.col("item_n") - F.col("both")
    good = both.filter(100 * F.col("both") >= percent * either).select("doc", "th", "item", "start", (F.col("both") / either).alias("similarity"))
    best = good.groupBy("doc", "th", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("m"))
    out = stage(best.select("doc", "th", "item", (-F.col("m.back")).alias("start"), F.col("m.similarity").alias("similarity")), "leaks")
    drop_staged(starts, counted, pairs)
    return out


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """find_leaks with the documents' ids: id, item_id, start, similarity. Clean documents have no row."""
    found = find_leaks(docs, benchmark, id_col, **options)
    return found.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias(id_col), F.when(F.col("item") != _NULL_ID, F.col("item")).alias("item_id"), F.col("start").cast("long").alias("start"), "similarity").distinct()


def drop_leaky(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, all columns, without the documents that hold an item, as find_leaks finds them: documents with null
    or empty texts stay, so do all without a benchmark; rows without id go by their text; repeated rows go or stay alike."""
    bad = find_leaks(docs, benchmark, id_col, text_col, **options).select("doc", "th").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(text_of(text_col)).alias("th"))
    return rows.join(small(bad, bad.count(), BROADCAST_DOCS), ["doc", "th"], "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])
