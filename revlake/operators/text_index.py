"""A stored trigram index that is kept current by refreshes, and search that reads nothing but the lists of its trigrams.

Texts come in chunks of about CHUNK characters, in which each stands at a place of its own. A row of the postings holds where
a trigram stands in a chunk, as differences of few bytes; rows lie in hash buckets of the trigram, sorted by it. A task makes
the rows of its own texts and writes them: no posting is shuffled. A refresh adds a segment to the buckets that it touches and
marks the places of the texts that it changes or removes: those are dead. Numbers of texts and trigrams are kept as they
change. A literal stands where its trigrams stand one after the other, so matches, their counts and their ranks come from the
postings alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import warehouse as W
from .search import LEAST_IDF, B, K1, trigram_count

BUCKETS, MOST_SEGMENTS = 32, 8
#: Characters and texts of a chunk, about: a text is not cut.
CHUNK, MOST_TEXTS = 1 << 21, 1 << 14
_POSTINGS = "gram bigint, chunk bigint, list binary"
_TEXTS = "chunk bigint, keys array<string>, lens array<bigint>, begins array<int>, ends array<int>, part string"
_MADE = "gram bigint, chunk bigint, list binary, keys array<string>, lens array<bigint>, begins array<int>, ends array<int>, part string"
_PLACE = "len bigint, chunk bigint, begin int, end int"
_DOCS = f"key string, {_PLACE}, was struct<{_PLACE.replace(' ', ': ').replace(',:', ',')}>, seq bigint, bucket int"
_DEAD = "chunk bigint, begins array<int>, ends array<int>, part string"
_SIZES = "n bigint, len bigint, part string"
_BITS = 21


def grams_of(text: str) -> list[int]:
    """A number for each trigram of a text, in order: three code points."""
    c = list(map(ord, text))
    return [a << 2 * _BITS | b << _BITS | d for a, b, d in zip(c, c[1:], c[2:], strict=False)]


def _bucket_of(gram: int) -> int:
    return (gram * 0x9E3779B97F4A7C15 >> 40) % BUCKETS


def _packed(places: np.ndarray, first: np.ndarray) -> pa.BinaryArray:
    """Lists of rising places, which begin at first, as differences of seven bits a byte."""
    d = np.diff(places, prepend=0)
    d[first] = places[first]
    n = 1 + sum((d >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    start = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[start[has] + k] = d[has] >> 7 * k & 127 | np.where(n[has] > k + 1, 128, 0)
    offsets = np.append(start[first], len(out)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(lists: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all lists, and where each list begins among them."""
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    data = np.frombuffer(lists.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    end = np.flatnonzero(data < 128)
    start = np.append(0, end[:-1] + 1)
    n, d = end - start + 1, (data[start] & 127).astype(np.int64)
    for k in range(1, int(n.max(initial=1))):
        has = n > k
        d[has] |= (data[start[has] + k] & 127).astype(np.int64) << 7 * k
    first = np.searchsorted(start, offsets[:-1] - offsets[0])
    total = np.cumsum(d)
    return total - np.repeat(total[first] - d[first], np.diff(np.append(first, len(d)))), first


def _dead_at(places: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which places lie in one of the spans, which rise."""
    k = np.searchsorted(begins, places, "right") - 1
    return (k >= 0) & (places < np.append(ends, 0)[k])


class _Chunk:
    def __init__(self, number: int) -> None:
        self.number, self.size, self.keys, self.lens, self.begins, self.grams, self.places = number, 0, [], [], [], [], []

    def add(self, key: str, fields: list[str | None], length: int) -> None:
        self.keys.append(key)
        self.lens.append(length)
        self.begins.append(self.size)
        for f in fields:
            p = np.frombuffer((f or "").encode("utf-32-le"), "<u4").astype(np.int64)
            if len(p) >= 3:
                self.grams.append(p[:-2] << 2 * _BITS | p[1:-1] << _BITS | p[2:])
                self.places.append(np.arange(self.size, self.size + len(p) - 2))
            self.size += len(p)  # its last two places hold no trigram, so that none follows on another field's
        self.size += 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        none, ends = [None], [*self.begins[1:], self.size]
        ints, names = pa.list_(pa.int32()), ["gram", "chunk", "list", "keys", "lens", "begins", "ends", "part"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), ints, ints, pa.string()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        own = [none, [self.number], none, [self.keys], [self.lens], [self.begins], [ends], ["texts"]]
        yield pa.record_batch([pa.array(v, k) for v, k in zip(own, kinds, strict=True)], schema=schema)
        if self.grams:
            gram = np.concatenate(self.grams)
            order = np.argsort(gram, kind="stable")
            gram = gram[order]
            first = np.append(0, np.flatnonzero(np.diff(gram)) + 1)
            known, n = gram[first], len(first)
            bucket = ((known.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)
            lists = _packed(np.concatenate(self.places)[order], first)
            part = pa.array(list(map(str, range(BUCKETS)))).take(pa.array(bucket))
            yield pa.record_batch([pa.array(known), pa.array(np.full(n, self.number)), lists, *[pa.nulls(n, k) for k in kinds[3:7]], part], schema=schema)


def _made(seq: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each chunk's texts, and one for each trigram of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = seq << 40 | TaskContext.get().partitionId() << 20
        chunk = _Chunk(number)
        for batch in batches:
            for key, fields, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                chunk.add(key, fields, length)
                if chunk.size >= CHUNK or len(chunk.keys) >= MOST_TEXTS:
                    yield from chunk.rows()
                    chunk = _Chunk(chunk.number + 1)
        if chunk.keys:
            yield from chunk.rows()

    return run


def _place(c: str | None = None) -> list[Column]:
    return [F.col(f"{c}.{n}" if c else n).alias(n) for n in ("len", "chunk", "begin", "end")]


def _spans(places: DataFrame) -> DataFrame:
    """chunk, begins, ends: the places of texts (chunk, begin, end) as rising spans; those that follow each other are one."""
    s = F.col("s")
    begins = F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)["end"] != x["begin"]))
    ends = F.filter(s, lambda x, k: (k == F.size(s) - 1) | (F.get(s, k + 1)["begin"] != x["end"]))
    by = places.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("s"))
    return by.select("chunk", begins["begin"].alias("begins"), ends["end"].alias("ends"))


def refresh(changed: DataFrame, root: str, key: str, fields: list[str], gone: DataFrame | None = None, writer: str = "", number: int | None = None) -> None:
    """Bring the index under root up to date with texts that are new or changed, and without those that are gone (key). A
    key that comes twice must not differ; a null key is none. (writer, number) names a refresh that may come again."""
    spark = changed.sparkSession
    rows = changed.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.array(*[F.lower(F.col(f).cast("string")) for f in fields]).alias("fields"), reduce(Column.__add__, [trigram_count(F.col(f).cast("string")) for f in fields]).cast("long").alias("_len"))
    number = W.state(spark, root).version if number is None else number

    def job(at: W.State) -> W.Change:
        seq = at.version + 1
        postings = W.write(rows.mapInArrow(_made(seq), _MADE), root, "postings", "part", ["gram", "chunk"], dealt=True)
        landed = postings.pop("texts", None)  # of the same pass as the lists: another may cut the chunks otherwise
        texts = spark.read.schema(_TEXTS).parquet(f"{root}/{landed}") if landed else spark.createDataFrame([], _TEXTS)
        each = texts.select("chunk", F.explode(F.arrays_zip("keys", "lens", "begins", "ends")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.lens").alias("len"), "chunk", F.col("x.begins").alias("begin"), F.col("x.ends").alias("end"))
        new = each.groupBy("key").agg(F.min(F.struct("chunk", "begin", "end", "len")).alias("new"), F.count("*").alias("_n"))
        known = W.read(spark, root, at, "docs", _DOCS).groupBy("key").agg(F.max_by(F.struct(*_place()), "seq").alias("was")).filter("was.len IS NOT NULL")
        touched = new.select("key") if gone is None else new.select("key").union(gone.select(F.col(key).cast("string"))).distinct()
        change = touched.join(known, "key", "left").join(new.drop("_n"), "key", "left")
        docs = W.write(change.select("key", *_place("new"), "was", F.lit(seq).cast("long").alias("seq"), F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")), root, "docs", "bucket")
        done = W.read(spark, root, W.State(folders={("docs", b): (f,) for b, f in docs.items()}), "docs", _DOCS)
        twice = each.join(new.filter("_n > 1"), "key").filter(F.struct("chunk", "begin") != F.struct("new.chunk", "new.begin"))
        over = done.filter("was.len IS NOT NULL").select("was.chunk", "was.begin", "was.end").unionByName(twice.select("chunk", "begin", "end"))
        dead = W.write(_spans(over).withColumn("part", F.lit("all")), root, "dead", "part")
        delta = done.agg((F.count("len") - F.count("was.len")).alias("n"), (F.coalesce(F.sum("len"), F.lit(0)) - F.coalesce(F.sum("was.len"), F.lit(0))).alias("len")).withColumn("part", F.lit("all"))
        sizes = W.read(spark, root, at, "sizes", _SIZES).unionByName(delta).groupBy("part").agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
        out = {("sizes", "all"): tuple(W.write(sizes, root, "sizes", "part").values())}
        for name, written in (("postings", postings), ("texts", W.write(texts, root, "texts", "part")), ("docs", docs), ("dead", dead)):
            for part, folder in written.items():
                out[name, part] = (*at.folders.get((name, part), ()), folder)
        return W.Change([k for k in at.folders if k[0] in ("docs", "texts", "dead", "sizes")] + list(out), out)

    W.apply(spark, root, writer, number, {"index": job})
    if any(len(f) > MOST_SEGMENTS for (n, _), f in W.state(spark, root).folders.items() if n == "postings"):
        compact(spark, root)


def _dead(spark: SparkSession, root: str, at: W.State) -> DataFrame:
    """chunk, dead_begins, dead_ends of the chunks with dead texts."""
    dead = W.read(spark, root, at, "dead", _DEAD).select("chunk", F.explode(F.arrays_zip("begins", "ends")).alias("x")).select("chunk", F.col("x.begins").alias("begin"), F.col("x.ends").alias("end"))
    return _spans(dead).select("chunk", F.col("begins").alias("dead_begins"), F.col("ends").alias("dead_ends"))


_LIVING = pa.schema([("gram", pa.int64()), ("chunk", pa.int64()), ("list", pa.binary()), ("bucket", pa.string())])


def _living(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists without the places of dead texts; those of which nothing is left go. The rows of a batch come by their chunks."""
    for batch in batches:
        marked = batch.column("dead_begins").is_valid()
        whole = batch.filter(pc.invert(marked))
        yield pa.record_batch([whole.column(n) for n in _LIVING.names], schema=_LIVING)
        some = batch.filter(marked)
        chunks = some.column("chunk").to_numpy()
        for number in np.unique(chunks):
            own = some.filter(pa.array(chunks == number))
            begins, ends = (np.array(own.column(c)[0].as_py()) for c in ("dead_begins", "dead_ends"))
            places, first = _unpacked(own.column("list"))
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(places))))
            lives = ~_dead_at(places, begins, ends)
            places, row = places[lives], row[lives]
            if len(row):
                first = np.append(0, np.flatnonzero(np.diff(row)) + 1)
                kept = own.take(pa.array(row[first]))
                yield pa.record_batch([kept.column("gram"), kept.column("chunk"), _packed(places, first), kept.column("bucket")], schema=_LIVING)


def compact(spark: SparkSession, root: str) -> None:
    """Make one segment of a bucket's, without dead texts. Each bucket is read by tasks of its own, so that nothing is dealt
    anew but where the dead are too many for a broadcast."""

    def job(at: W.State) -> W.Change:
        buckets = [W.read(spark, root, at, "postings", _POSTINGS, [b]).withColumn("bucket", F.lit(b)) for b in at.parts("postings")]
        docs = W.read(spark, root, at, "docs", _DOCS).groupBy("key", "bucket").agg(F.max_by(F.struct(*_place()), "seq").alias("x"), F.max("seq").alias("seq")).filter("x.len IS NOT NULL")
        out = {(n, p): () for n in ("postings", "docs", "texts", "dead") for p in at.parts(n)}
        if buckets:
            live = reduce(DataFrame.unionByName, buckets).join(_dead(spark, root, at), "chunk", "left").select("gram", "chunk", "list", "bucket", "dead_begins", "dead_ends").mapInArrow(_living, f"{_POSTINGS}, bucket string")
            out |= {("postings", p): (f,) for p, f in W.write(live, root, "postings", "bucket", ["gram", "chunk"], dealt=True).items()}
        docs = W.write(docs.select("key", *_place("x"), F.lit(None).cast(f"struct<{_PLACE.replace(' ', ': ').replace(',:', ',')}>").alias("was"), "seq", "bucket"), root, "docs", "bucket")
        out |= {("docs", p): (f,) for p, f in docs.items()}
        done = W.read(spark, root, W.State(folders={("docs", b): (f,) for b, f in docs.items()}), "docs", _DOCS)
        by = done.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "key", "len"))).alias("x"))
        texts = by.select("chunk", F.col("x.key").alias("keys"), F.col("x.len").alias("lens"), F.col("x.begin").alias("begins"), F.col("x.end").alias("ends"), F.lit("texts").alias("part"))
        out |= {("texts", p): (f,) for p, f in W.write(texts, root, "texts", "part").items()}
        return W.Change(list(at.folders), out)

    W.apply(spark, root, "compact", W.state(spark, root).version, {"index": job})


def _hits(grams: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key, tf, len of a chunk's texts in which the trigrams follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists = {x["gram"]: _unpacked(pa.array([x["list"]], pa.binary()))[0] for x in row["lists"]}
                found = reduce(lambda a, b: np.intersect1d(a, b, True), [lists[g] - k for k, g in enumerate(grams)])
                if row["dead_begins"]:
                    found = found[~_dead_at(found, np.array(row["dead_begins"]), np.array(row["dead_ends"]))]
                text, tf = np.unique(np.searchsorted(np.array(row["begins"]), found, "right") - 1, return_counts=True)
                if len(text):
                    yield pa.record_batch([pa.array([row["keys"][k] for k in text], pa.string()), pa.array(tf, pa.int64()), pa.array([row["lens"][k] for k in text], pa.int64())], ["key", "tf", "len"])

    return run


def matches(spark: SparkSession, root: str, query: str) -> DataFrame:
    """key, tf, len of the texts that hold the literal within a field, of three characters or more; overlaps count."""
    grams = grams_of(query.lower())
    at = W.state(spark, root)
    if len(query) < 3:
        return spark.createDataFrame([], "key string, tf bigint, len bigint")
    different = sorted(set(grams))
    lists = W.read(spark, root, at, "postings", _POSTINGS, sorted({str(_bucket_of(g)) for g in different})).filter(F.col("gram").isin(different))
    by = lists.groupBy("chunk").agg(F.collect_list(F.struct("gram", "list")).alias("lists")).filter(F.size("lists") == len(different))  # a row for each trigram of the query
    texts = W.read(spark, root, at, "texts", _TEXTS).select("chunk", "keys", "lens", "begins")
    return by.join(texts, "chunk").join(_dead(spark, root, at), "chunk", "left").drop("chunk").mapInArrow(_hits(grams), "key string, tf bigint, len bigint")


def search_index(spark: SparkSession, root: str, query: str, limit: int | None = None) -> DataFrame:
    """key, rank of the texts that hold the literal: the negated BM25 as a scan of the corpus gives it, from the index alone."""
    hits = matches(spark, root, query)
    sizes = W.read(spark, root, W.state(spark, root), "sizes", _SIZES).agg(F.sum("n").alias("n"), F.greatest(F.sum("len") / F.sum("n"), F.lit(1.0)).alias("avg"))
    many = hits.agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    bm25 = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    out = hits.join(F.broadcast(sizes)).join(F.broadcast(many)).select("key", (-bm25).alias("rank"))  # one row each
    return out if limit is None else out.orderBy("rank", "key").limit(limit)
