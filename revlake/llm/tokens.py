"""Token ids of whole texts, and binary shards with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of, text_slices

END_ID = 0
#: A shard closes at this many ids or documents; one longer document makes one longer shard.
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 16
#: Code points of a text that deal rows of one id over tasks; rows with one id and one head lie in one task.
HEAD = 64
#: Bytes of a row group of shards.
ROW_GROUP = 16 << 20


class WordTokenizer:
    """Ids of a text under a byte-level BPE of the tokenizers library, as little-endian uint32 bytes.

    Such a tokenizer cuts a text before it merges: always before a blank or line feed that follows other characters than
    white space, and between letters and a mark. So a text is cut there, and each different word of a batch (with its
    blank, or with its line feed) and each run of marks after a word goes through the tokenizer once while it is
    remembered. Texts with other runs of white space, or with the strings of special tokens, are encoded whole. The
    memory is bounded by MOST_WORDS entries.
    """

    MOST_WORDS = 300_000
    BULK = 4_000
    WHOLE = 1 << 19
    #: White space but the blank and the line feed. Cut texts must hold neither these nor these runs.
    SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
    RUNS = ("  ", " \n", "\n ", "\n\n\n")
    #: Stands before the first word of a text, which has no blank; texts with it are encoded whole.
    FIRST = "\x00"
    #: A word of letters, and the marks after it.
    MARKED = r"^(?P<stem>[\n\x00]?\pL*[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])(?P<tail>[!-/:-@\[-`{-~]+)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = "|".join([*map(re.escape, (*self.RUNS, *special)), f"[{''.join(self.SPACES)}{self.FIRST}]", "^ ", " $", "\\n\\n$"])
        self.stems = self.tails = (pa.array([], pa.string()), pa.array([], pa.large_binary()))
        vocab = self.tok.get_vocab()
        self.starts = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, k in vocab.items():
            self.starts[k] = token[:1] in ("Ġ", "Ċ")  # the alphabet's signs for the blank and the line feed

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _bulk(self, words: pa.Array) -> pa.Array:
        """Words are encoded in one run, each after a blank, cut again where a token begins with a blank or line feed."""
        own = [" " + w for w in words.to_pylist()]
        ids = np.array(self.tok.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(own):
            return pa.array(self.whole(own), pa.large_binary())
        return pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(np.append(at, len(ids)) * 4), pa.py_buffer(ids)])

    def _learn(self, new: pa.Array) -> pa.Array:
        lead = pc.match_substring_regex(new, f"^[\n{self.FIRST}]").to_numpy(zero_copy_only=False)
        plain, rest = new.filter(pa.array(~lead)), new.filter(pa.array(lead))
        runs = [self._bulk(plain.slice(k, self.BULK)) for k in range(0, len(plain), self.BULK)]
        runs.append(pa.array(self.whole([w.removeprefix(self.FIRST) for w in rest.to_pylist()]), pa.large_binary()))
        return pa.concat_arrays(runs).take(pa.array(np.argsort(np.argsort(lead, kind="stable"))))

    @staticmethod
    def _of(words: pa.Array, known: tuple[pa.Array, pa.Array], learn: Callable[[pa.Array], pa.Array], most: int) -> tuple[pa.Array, tuple[pa.Array, pa.Array]]:
        """The ids of words, through the words and ids that are known, and what is known then."""
        coded = pc.dictionary_encode(words)
        if len(known[0]) > most:  # words met early are mostly the frequent ones
            known = tuple(x.slice(0, most * 3 // 4) for x in known)
        found = pc.index_in(coded.dictionary, value_set=known[0])
        at, new = found.to_numpy(zero_copy_only=False), found.is_null().to_numpy(zero_copy_only=False)
        if new.any():
            at = np.where(new, len(known[0]) + np.cumsum(new) - 1, at)
            names = coded.dictionary.filter(pa.array(new))
            known = pa.concat_arrays([known[0], names]), pa.concat_arrays([known[1], learn(names)])
        return known[1].take(pa.array(at[coded.indices.to_numpy()].astype(np.int64))), known

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, self.odd)
        cut = pc.split_pattern(pc.binary_join_element_wise(self.FIRST, pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), ""), " ")
        coded = pc.dictionary_encode(cut.flatten())
        words = coded.dictionary
        has = pc.match_substring_regex(words, self.MARKED)
        marked = pc.extract_regex(words.filter(has), self.MARKED)
        cut_off = pc.replace_with_mask(words, has, pc.struct_field(marked, "stem"))
        stems, self.stems = self._of(cut_off, self.stems, self._learn, self.MOST_WORDS)
        marks = lambda new: pa.array(self.whole(new.to_pylist()), pa.large_binary())
        tails, self.tails = self._of(pc.replace_with_mask(pa.repeat("", len(words)), has, pc.struct_field(marked, "tail")), self.tails, marks, self.MOST_WORDS // 4)
        ids = pc.binary_join_element_wise(stems, tails, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        # the ids of consecutive words lie next to each other
        run = iter(())
        if len(cut):
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset + cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
            raw = memoryview(ids.buffers()[2] or b"")
            run = iter([bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)])
        # the library keeps over a hundred bytes for each token of a batch, so odd texts go in small batches
        rest = (x for part in text_slices(texts.filter(odd), self.WHOLE) for x in self.whole(part.to_pylist()))
        return [next(rest if x else run) for x in odd.to_pylist()]


@lru_cache(1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that its words outlive a task."""
    return WordTokenizer(path)


class EliasFano:
    """Non-decreasing integers v[0..n) up to u in about n * (2 + log2(u / n)) bits.

    low: the lowest l bits of each, packed; high: for v[i] a one at position (v[i] >> l) + i. sample holds the position
    of every STEP-th one, so select reads at most STEP ones beyond a sample.
    """

    STEP = 256

    def __init__(self, n: int, l: int, low: bytes, high: bytes, sample: bytes):  # noqa: E741
        self.n, self.l, self.low, self.high, self.sample = n, l, low, high, sample

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, u = len(v), int(v[-1]) + 1 if len(v) else 1
        l = max(0, (u // max(n, 1)).bit_length() - 1)  # noqa: E741
        low = np.packbits(((v[:, None] >> np.arange(l)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> l) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, l, low, np.packbits(bits, bitorder="little").tobytes(), ones[:: cls.STEP].astype("<u4").tobytes())

    def selects(self, begin: int, end: int) -> np.ndarray:
        """v[begin:end], from the sample before begin on to the one behind end."""
        k = begin // self.STEP
        at, to = (np.frombuffer(self.sample, "<u4")[j : j + 1] for j in (k, -(-end // self.STEP)))
        if begin >= end:
            return np.zeros(0, np.int64)
        first = int(at[0]) // 8
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[first : int(to[0]) // 8 + 1 if len(to) else None], bitorder="little")
        bits[: int(at[0]) % 8] = 0
        ones = np.flatnonzero(bits)[begin - k * self.STEP : end - k * self.STEP] + first * 8
        return (ones - np.arange(begin, end) << self.l) + self._lows(begin, end)

    def _lows(self, begin: int, end: int) -> np.ndarray:
        at = begin * self.l
        raw = np.frombuffer(self.low, np.uint8)[at // 8 : (end * self.l + 7) // 8]
        bits = np.unpackbits(raw, bitorder="little")[at % 8 :][: (end - begin) * self.l].reshape(end - begin, self.l)
        return (bits.astype(np.int64) << np.arange(self.l)).sum(1)

    def select(self, i: int) -> int:
        """v[i], from the nearest sample on."""
        k = i // self.STEP
        at = int(np.frombuffer(self.sample, "<u4")[k])
        left, byte = i - k * self.STEP, at // 8
        skip = at % 8
        while True:
            ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high[byte : byte + 64], np.uint8), bitorder="little")[skip:]) + skip
            if left < len(ones):
                return (byte * 8 + int(ones[left]) - i << self.l) + int(self._lows(i, i + 1)[0])
            left, byte, skip = left - len(ones), byte + 64, 0

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return (ones - np.arange(self.n) << self.l) + self._lows(0, self.n)


_CODED = "struct<n: int, l: int, low: binary, high: binary, sample: binary>"
_SHARD = f"part int, seq int, n_docs long, n_ids long, n_null long, first_id long, doc_ids {_CODED}, ids binary, ends {_CODED}"


def write_shards(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all texts, in ascending id order, as shards under out.

    Format: a Parquet folder; one row is a shard: part and seq (its place), n_docs, n_ids, ids (one run of little-endian
    uint32, each document closed by end_id), and two Elias-Fano codes: ends, where the documents end in ids, and doc_ids,
    their ids less first_id; the first n_null documents have no id. A null text is empty and has the end id alone; null
    ids come first; rows with equal ids follow each other by text. An empty table gives no shards. A text's ids must fit a
    shard's binary: 2 GB, about 500 million tokens. Ids that are no longs are cast.
    """

    def coded(values: list[int]) -> dict:
        ef = EliasFano.encode(np.array(values, np.int64))
        return {"n": ef.n, "l": ef.l, "low": ef.low, "high": ef.high, "sample": ef.sample}

    def close(part: int, seq: int, names: list, runs: list[bytes], ends: list[int]) -> pa.RecordBatch:
        real = [x for x in names if x is not None]
        row = {"part": part, "seq": seq, "n_docs": len(names), "n_ids": ends[-1], "n_null": len(names) - len(real), "first_id": real[0] if real else None, "doc_ids": coded([x - real[0] for x in real]), "ids": b"".join(runs), "ends": coded(ends)}
        return pa.RecordBatch.from_pylist([row], _SHARD_ARROW)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        part, seq, names, runs, ends = TaskContext.get().partitionId(), 0, [], [], []
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for texts in text_slices(batch.column(1)):
                for name, run in zip(islice(ids, len(texts)), tok.encode(texts), strict=True):
                    far = names and name is not None and names[-1] is not None and name - next(x for x in names if x is not None) > _WIDEST
                    if far or ends and (ends[-1] >= shard_ids or len(names) >= SHARD_DOCS):
                        yield close(part, seq, names, runs, ends)
                        seq, names, runs, ends = seq + 1, [], [], []
                    names.append(name)
                    runs += (run, end)
                    ends.append((ends[-1] if ends else 0) + len(run) // 4 + 1)
        if names:
            yield close(part, seq, names, runs, ends)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # rows of one id are dealt too; heads order as texts do, and only heads are sampled for the bounds of ranges
    rows = rows.repartitionByRange("id", F.substring("text", 1, HEAD)).sortWithinPartitions("id", "text")
    # row groups of a few shards, so that neither a writer nor a reader holds a file's ids at once
    rows.mapInArrow(encode, _SHARD).write.option("parquet.block.size", ROW_GROUP).parquet(out)


#: Ids of a shard lie no farther apart, so that their differences are longs.
_WIDEST = 1 << 62
_CODED_ARROW = pa.struct([("n", pa.int32()), ("l", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("sample", pa.binary())])
_SHARD_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_null", pa.int64()), ("first_id", pa.int64()), ("doc_ids", _CODED_ARROW), ("ids", pa.binary()), ("ends", _CODED_ARROW)])


def shard_bases(shards: DataFrame) -> DataFrame:
    """part, seq, base (ids of all shards before). Running sums go within a part, and over the parts' totals."""
    meta = shards.select("part", "seq", "n_ids")
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("total")).select("part", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return meta.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").select("part", "seq", (F.col("first") + F.col("within")).alias("base"))


def read_boundaries(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the shards under path: id, start (ids before it), n_tokens (with the end id), ids_crc32.

    Ids and offsets are selected from the shards' codes; only the document at hand is touched in ids. Documents written
    without id have null; no shards give no rows; repeated rows have a row each.
    """
    shards = spark.read.schema(_SHARD).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("ids")
            for k, row in enumerate(batch.drop_columns("ids").to_pylist()):
                ends, names = (EliasFano(**row[c]) for c in ("ends", "doc_ids"))
                ids, n = memoryview(blobs[k].as_buffer()), row["n_docs"]
                at = [0, *ends.selects(0, n).tolist()]
                own = [None] * row["n_null"] + [row["first_id"] + x for x in names.selects(0, names.n).tolist()]
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.record_batch({"part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()), "id": pa.array(own, pa.int64()), "at": pa.array(at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    blobs = shards.select("part", "seq", "n_docs", "n_null", "first_id", "doc_ids", "ids", "ends")
    rows = blobs.mapInArrow(read, "part int, seq int, id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_bases(shards), ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
