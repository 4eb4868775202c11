"""Helpers that the text operators share: staged tables, word splitting and row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    global _own_dir
    if at := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="revlake-")
    return _own_dir


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/revlake/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder, in folders of column by, and read it back: cuts lineage, survives lost executors,
    fixes generated ids. A staged side of a join is a plain scan, so that adaptive execution can split the other's hot keys."""
    spark = df.sparkSession
    (df.write.partitionBy(by) if by else df.write).parquet(path := new_path(spark, tag))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*staged: DataFrame) -> None:
    """Remove staged tables that no later plan reads: the folders of new_path that hold their files."""
    for df in staged:
        spark = df.sparkSession
        for f in {x.partition("/revlake/")[0] + "/revlake/" + x.partition("/revlake/")[2].partition("/")[0] for x in df.inputFiles()[:1]}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other letters as they are; texts of single-byte characters take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Mark df for broadcast if its counted rows stay under the bound; larger sides join by shuffle."""
    return F.broadcast(df) if rows <= most else df


def bind(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_slices(texts: pa.Array, most: int = 6 << 20) -> Iterator[pa.Array]:
    """Runs of about `most` bytes of a string array, so that what is made of a batch of long texts stays bounded."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most)) + 1
        yield texts.slice(begin, end - begin)
        begin = end


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of each of some texts: different words once (known), and for each word its place among
    them (at). ends holds where each text's words end in at."""

    def __init__(self, texts: pa.Array, fold: bool = False):
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts) if fold else texts)
        coded = pc.dictionary_encode(cut.flatten())
        at, self.known = coded.indices.to_numpy(), coded.dictionary
        ends = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        # a text that begins or ends with white space has an empty word there
        if (none := pc.index(self.known, "").as_py()) >= 0:
            real = at != none
            ends = np.concatenate(([0], np.cumsum(real)))[ends]
            at = at[real]
        self.at, self.ends = at, ends
        self.begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
