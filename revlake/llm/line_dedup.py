"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

The runs hold the 128-bit hashes of all line keys seen so far, in as many buckets by hash as a shuffle has partitions,
sorted within each. A batch of documents merge-anti-joins them bucket by bucket, without a shuffle: keys that the runs
lack are new and become a run of level 0; keys that they hold have a first document already. FANOUT runs of one level
are compacted into one of the next, so that a batch reads few runs and a hash is rewritten a few times.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, bind, new_path, stage, text_of

MIN_CHARS = 10
FANOUT = 3
BATCHES = 4
_NULL_ID = -(2**63)


class LineRuns:
    """The line keys of all batches added so far."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, keys: DataFrame, tag: str) -> DataFrame:
        """keys in sorted buckets, as files of the shared folder."""
        name = f"revlake_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", new_path(self.spark, tag)).saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay, and the bucketing is known to run
        return run

    def add(self, lines: DataFrame) -> DataFrame:
        """lines (doc, h1, h2, ...) of a batch -> the repeated keys in it: h1, h2, first (the batch's document that keeps
        them; null if an earlier batch has one). The new keys become a run."""
        keys = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        keys = fresh = self._write(keys, "line-keys")
        if older := self.runs():
            for run in older:
                fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
            fresh = self._write(fresh, "line-run")
        self._push(0, fresh)
        again = fresh.filter("first < last").select("h1", "h2", "first")
        if older:
            old = keys.join(fresh.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            again = again.unionByName(old.select("h1", "h2", F.lit(None).cast("long").alias("first")))
        return stage(again, "line-again")

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run.select("h1", "h2"))
        if len(self.levels[level]) >= self.fanout:
            whole = reduce(DataFrame.unionByName, self.levels[level]).repartition(self.buckets, "h1", "h2")
            self.levels[level] = []
            self._push(level + 1, self._write(whole, "line-run"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key_hashes(text: Column, min_chars: int) -> Column:
    """For each line whose key has min_chars code points or more: its place and the key's hashes."""
    cut = F.transform(_lines(ascii_lower(text)), lambda line: F.trim(line, F.lit(BLANKS)))
    own = F.transform(cut, lambda key, k: F.struct(k.alias("pos"), F.when(F.char_length(key) >= min_chars, F.xxhash64(key)).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))
    return F.filter(own, lambda x: x["h1"].isNotNull())


def _repeated(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """doc, th, gone (places of the lines to drop) of the rows that lose lines."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), text_of(text_col).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)]).alias("q")).first()["q"] if batches > 1 else None
    batch = reduce(lambda a, q: a + (F.col("doc") > q).cast("int"), sorted(set(cuts or [])), F.lit(0))
    lines = rows.select("doc", F.xxhash64("text").alias("th"), F.explode(_key_hashes(F.col("text"), min_chars)).alias("x")).select(batch.alias("batch"), "doc", "th", "x.*")
    lines = stage(lines, "lines", "batch")
    runs, dropped = LineRuns(spark, fanout), []
    for k in range(len(set(cuts or [])) + 1):
        own = lines.filter(F.col("batch") == k)
        again = runs.add(own)
        dropped.append(own.join(again.hint("merge"), ["h1", "h2"]).filter("first IS NULL OR doc <> first").select("doc", "th", "pos"))
    return reduce(DataFrame.unionByName, dropped).groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))


def _kept(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """row (the input's columns), n (lines), gone (places or null), kept (text)."""
    gone = _repeated(docs, id_col, text_col, min_chars, batches, fanout)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), text_of(text_col).alias("t"))
    rows = rows.withColumn("th", F.xxhash64("t")).join(gone, ["doc", "th"], "left")
    left = bind(_lines(F.col("t")), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda k: lines[k]), "\n"))
    return rows.select("row", F.size(_lines(F.col("t"))).alias("n"), "gone", F.when(F.col("gone").isNull(), F.col("t")).otherwise(left).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The input's rows and columns, with the repeated lines gone from text.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. Keys of min_chars code
    points or more that stand in two documents or more stay in the document with the smallest id only (null: smallest),
    with all their lines there. Rows with one id are one document. A null text stays null; an empty one stays empty.
    Documents are taken in id order, in so many batches. Other columns pass through under any name; an empty table gives no
    rows. A text is taken whole and must fit a row, as must the lines of one document; ids that are no longs are cast.
    """
    kept = _kept(docs, id_col, text_col, min_chars, batches, fanout)
    text = F.when(F.col(f"row.{text_col}").isNotNull(), F.col("kept")).alias(text_col)
    return kept.select(*[text if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: id, n_lines (before), n_dropped, kept_sha256. A null or empty text has one empty line. Other
    columns are not read, whatever their names; ids, long texts and empty tables as in dedup_lines."""
    kept = _kept(docs, id_col, text_col, min_chars, batches, fanout)
    return kept.select(F.col(f"row.{id_col}"), F.col("n").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))
