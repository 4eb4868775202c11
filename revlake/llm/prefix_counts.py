"""Exact token counts at every prefix of a text, by dynamic programming over prefixes of a byte-level BPE."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import text_of, text_slices

#: The characters of Unicode's White_Space property, which the byte-level cutter's \s takes.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: A stored table has the count itself at every so many characters, and steps between.
MARK_EVERY = 1024


class PrefixCounter:
    """Token counts of all prefixes of texts, as the tokenizers library gives them for each prefix by itself.

    Within a piece that the cutter makes, last[i] is the last token of the first i bytes: the token t that ends there and
    for which (last[i - len(t)], t) stands as a pair, which means that the model leaves both as they are when it encodes
    them together. Exactly one does, so count[i] = count[i - len(t)] + 1 needs no encoding of the prefix. Pieces are taken
    in order, so that what a piece shares with the one before is counted once.

    A text is cut before white space that follows other characters; such units neither share pieces nor look into each
    other, so each different unit of a batch is looked up once, and each different word counted once while it is remembered. Within a unit, a run of white space is one piece for a prefix
    that ends in it, an apostrophe is a piece of its own until its contraction is complete, and a special string is one
    token once it is complete.
    """

    MOST_WORDS, MOST_PAIRS, MOST_PIECES, LONG_PIECE = 400_000, 400_000, 50_000, 64
    CUT = "([^" + "".join(sorted(WHITE | set("\x1c\x1d\x1e\x1f"))) + "])([ \\n\\t\\r])"
    #: A line feed or none, a word with its blank or a number with its blank, and marks: pieces that any prefix leaves whole.
    USUAL = r"^(?P<line>\n?)(?P<stem> ?(?:[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}]+|[0-9]+))(?P<tail>[!-/:-@\[-`{-~]*)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path)
        kind = json.loads(self.tok.to_str())
        cutter, model = kind["pre_tokenizer"] or {}, kind["model"]
        if kind["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges") or cutter.get("type") != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"]:
            raise ValueError("prefix counts need a byte-level BPE without normalizer")
        special = sorted((t["content"] for t in kind["added_tokens"]), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in kind["added_tokens"]):
            raise ValueError("prefix counts need special strings that take no neighbours")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.whole = "|".join(["\x00", *map(re.escape, special)])
        # the model's alphabet has a sign for each byte; these characters have all bytes of UTF-8
        signs = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        every = map(chr, [*range(0x1000), *range(0x1000, 0x10000, 0x1000), 0x10000, *range(0x40000, 0x110000, 0x40000)])
        byte = {s: b for c in every for b, s in zip(c.encode(), signs(c)[0][0], strict=True)}
        self.vocab = {bytes(map(byte.__getitem__, t)): k for t, k in self.tok.get_vocab(with_added_tokens=False).items() if set(t) <= byte.keys()}
        self.names = {k: t for t, k in self.tok.get_vocab(with_added_tokens=False).items()}
        ending: dict[bytes, set[int]] = {}
        for t in self.vocab:
            if len(t) >= 3:
                ending.setdefault(t[-3:], set()).add(len(t))
        if max(map(len, self.vocab), default=0) > 1 << 14:
            raise ValueError("a step must fit 16 bits")
        self.lengths = {end: tuple(sorted(n, reverse=True)) for end, n in ending.items()}
        self.pairs: dict[int, bool] = {}
        self.known: dict[bytes, list[int]] = {}
        self.words: dict[bytes, bytes] = {}

    def _stand(self, a: int, b: int) -> bool:
        """Whether token b (after token a, or alone for a = -1) is left as it is."""
        made = [t.id for t in self.tok.model.tokenize((self.names[a] if a >= 0 else "") + self.names[b])]
        return made == ([a, b] if a >= 0 else [b])

    def pieces(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Counts at each prefix of pieces, a byte each; quick where a piece shares its beginning with the one before. A
        list holds until the next is asked for."""
        before, count, last, vocab, lengths, pairs = b"", [0], [-1], self.vocab, self.lengths, self.pairs
        if len(pairs) > self.MOST_PAIRS:
            pairs.clear()
        for w in words:
            k, most = 0, min(len(w), len(before))
            while k < most and w[k] == before[k]:
                k += 1
            del count[k + 1 :], last[k + 1 :]
            for i in range(k + 1, len(w) + 1):
                for n in (*lengths.get(w[i - 3 : i], ()), 2, 1) if i > 2 else (2, 1):
                    if n <= i and (t := vocab.get(w[i - n : i])) is not None:
                        a = last[i - n]
                        if (stands := pairs.get(at := a + 1 << 32 | t)) is None:
                            stands = pairs[at] = self._stand(a, t)
                        if stands:
                            count.append(count[i - n] + 1)
                            last.append(t)
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            before = w
            yield count

    def piece(self, w: bytes) -> list[int]:
        """Counts at each prefix of one piece."""
        if (found := self.known.get(w)) is None:
            found = list(next(self.pieces([w])))
            if len(w) <= self.LONG_PIECE:
                if len(self.known) > self.MOST_PIECES:
                    self.known.clear()
                self.known[w] = found
        return found

    @staticmethod
    def _ends(text: str) -> list[int]:
        """Bytes of text up to the end of each character."""
        return np.cumsum([1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in text]).tolist()

    def _plain(self, text: str) -> list[int]:
        """Counts at each prefix of a text without special strings."""
        out, base, done, cut = [0], 0, 0, self.tok.pre_tokenizer.pre_tokenize_str
        for _, (a, b) in cut(text):
            if a == done and text[a] in WHITE:
                end = a + 1
                while end < len(text) and text[end] in WHITE:
                    end += 1
                run = self.piece(text[a:end].encode())
                out += [base + run[k] for k in self._ends(text[a:end])]
                done = end
            own = text[a:b]
            count = self.piece(own.encode())
            if b > done:
                if own[0] == "'" and b - a > 1 and "a" <= own[1] <= "z":
                    out += [base + k for k in range(1, b - a)] + [base + count[-1]]
                elif b - a == len(count) - 1:
                    out += [base + k for k in count[done - a + 1 :]]
                else:
                    out += [base + count[k] for k in self._ends(own)[done - a :]]
                done = b
            base += count[-1]
        return out

    def counts(self, text: str) -> list[int]:
        """The count at each prefix of text, from the empty one to the whole, a prefix for each character."""
        out, base, at = [0], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            before = self._plain(text[at : m.end() - 1])
            out += [base + k for k in before[1:]]
            base += self._plain(text[at : m.start()])[-1] + 1
            out.append(base)
            at = m.end()
        return out + [base + k for k in self._plain(text[at:])[1:]]

    def _all(self, words: pa.Array) -> pa.Array:
        """Counts at each character of pieces (no more than one each), as little-endian int32."""
        coded = pc.dictionary_encode(words)
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.words) > self.MOST_WORDS:  # words met early are mostly the frequent ones
            self.words = dict(islice(self.words.items(), self.MOST_WORDS * 3 // 4))
        words = self.words
        new = sorted(w for w in names if w not in words)
        for w, count in zip(new, self.pieces(new), strict=True):
            words[w] = array("i", count[1:] if w.isascii() else [c for c, b in zip(count[1:], w[1:] + b"a", strict=True) if b & 0xC0 != 0x80]).tobytes()
        return _differences(list(map(words.__getitem__, names))).take(coded.indices)

    def steps(self, texts: pa.Array) -> CountedTexts:
        """Of each text, what each character adds to the count."""
        whole = pc.match_substring_regex(texts, self.whole)
        cut = pc.split_pattern(pc.if_else(whole, texts, pc.replace_substring_regex(texts, self.CUT, "\\1\x00\\2")), "\x00")
        if pc.any(whole).as_py():
            parts = [[t] if w else p for t, w, p in zip(texts.to_pylist(), whole.to_pylist(), cut.to_pylist(), strict=True)]
            cut = pa.array(parts, pa.list_(pa.string()))
        coded = pc.dictionary_encode(cut.flatten())
        units = coded.dictionary
        found = pc.extract_regex(units, self.USUAL)
        usual = pc.and_(pc.is_valid(found), pc.invert(pc.starts_with(units, "\n ")))
        parts = [self._all(pc.struct_field(found.filter(usual), k)) for k in ("line", "stem", "tail")]
        known = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
        rest = _differences([array("i", self.counts(u)[1:]).tobytes() for u in units.filter(pc.invert(usual)).to_pylist()])
        place = np.empty(len(units), np.int64)
        place[usual.to_numpy(zero_copy_only=False)] = np.arange(n := len(known))
        place[~usual.to_numpy(zero_copy_only=False)] = np.arange(len(rest)) + n
        return CountedTexts(cut.offsets.to_numpy() - cut.offsets[0].as_py(), place[coded.indices.to_numpy()], pa.concat_arrays([known, rest]))


def _differences(counts: list[bytes]) -> pa.Array:
    """Little-endian int32 counts as the int16 steps between them, each list from 0 on."""
    raw = np.frombuffer(b"".join(counts), "<i4")
    ends = np.cumsum([0, *map(len, counts)], dtype=np.int64) // 4
    steps = np.diff(raw, prepend=0)
    begins = ends[:-1][np.diff(ends) > 0]
    steps[begins] = raw[begins]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends * 2), pa.py_buffer(steps.astype("<i2"))])


class CountedTexts:
    """Some texts as runs of units: unit at[k] of the texts' ends[i] to ends[i + 1] has the steps known[at[k]]."""

    def __init__(self, ends: np.ndarray, at: np.ndarray, known: pa.Array):
        self.ends, self.at, self.known = ends, at, known
        sizes = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1] if len(known) else np.zeros(1, np.int64)
        steps = np.frombuffer(known.buffers()[2] or b"", "<i2") if len(known) else np.zeros(0, "<i2")
        sums = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
        self.sizes, self.raw = sizes // 2, steps
        self.tokens = np.concatenate(([0], np.cumsum((sums[self.sizes[1:]] - sums[self.sizes[:-1]])[at])))
        self.chars = np.concatenate(([0], np.cumsum(np.diff(self.sizes)[at])))

    def totals(self) -> np.ndarray:
        return np.diff(self.tokens[self.ends])

    def lengths(self) -> np.ndarray:
        return np.diff(self.chars[self.ends])

    def fits(self, budget: int) -> np.ndarray:
        """Characters of the longest prefix of each text that has at most budget tokens."""
        out = self.lengths()
        for i in np.flatnonzero(self.totals() > budget):
            a, b = self.ends[i], self.ends[i + 1]
            u = a + int(np.searchsorted(self.tokens[a:b] - self.tokens[a], budget, "right")) - 1
            own = np.cumsum(self.raw[self.sizes[self.at[u]] : self.sizes[self.at[u] + 1]])
            inside = np.flatnonzero(own <= budget - (self.tokens[u] - self.tokens[a]))
            out[i] = self.chars[u] - self.chars[a] + (int(inside[-1]) + 1 if len(inside) else 0)
        return out

    def tables(self) -> Iterator[np.ndarray]:
        """The steps of each text."""
        run = self.known.take(pa.array(self.at))
        raw = np.frombuffer(run.buffers()[2] or b"", "<i2") if len(run) else np.zeros(0, "<i2")
        for a, b in zip(self.chars[self.ends], self.chars[self.ends[1:]], strict=False):
            yield raw[a:b]


@lru_cache(1)
def prefix_counter(path: str) -> PrefixCounter:
    """One for each worker process, so that its pairs outlive a task."""
    return PrefixCounter(path)


def _counted(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, schema: str, columns: Callable[[CountedTexts], dict[str, pa.Array]]) -> DataFrame:
    names = ["id", *[c.split()[0] for c in schema.split(", ")][1:]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer)
        for batch in batches:
            begin = 0
            for texts in text_slices(batch.column(1)):
                made = columns(counter.steps(texts))
                yield pa.record_batch([batch.column(0).slice(begin, len(texts)), *made.values()], names)
                begin += len(texts)

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, schema.replace("id ?", f"id {rows.schema['id'].dataType.simpleString()}")).withColumnRenamed("id", id_col)


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, n_chars, n_tokens and its prefix table, which answers every question about where to
    cut the text without encoding it again.

    steps: little-endian int16, what each character adds to the count (a longer prefix may have fewer tokens). marks:
    little-endian uint32, the count at every MARK_EVERY-th prefix from 0 on. Null and empty texts have 0 tokens and empty
    steps; repeated rows and rows without id have a row each; an empty table gives no rows; other columns are not read. A
    text's steps take two bytes a character, so texts of over a thousand million characters do not fit a row.
    """

    def columns(c: CountedTexts) -> dict[str, pa.Array]:
        steps, marks = [], []
        for own in c.tables():
            steps.append(own.tobytes())
            marks.append(np.concatenate(([0], np.cumsum(own, dtype=np.int64)))[::MARK_EVERY].astype("<u4").tobytes())
        return {"n_chars": pa.array(c.lengths()), "n_tokens": pa.array(c.totals()), "marks": pa.array(marks, pa.binary()), "steps": pa.array(steps, pa.binary())}

    return _counted(docs, tokenizer, id_col, text_col, "id ?, n_chars long, n_tokens long, marks binary, steps binary", columns)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens) and fit_chars, the
    characters of its longest prefix of at most limit tokens. The counts are read off the prefix tables, which are not
    written. Odd rows as in prefix_tables; texts of any length are counted whole.
    """

    def columns(c: CountedTexts) -> dict[str, pa.Array]:
        return {"n_tokens": pa.array(c.totals()), "fit_chars": pa.array(c.fits(limit))}

    sized = docs.select(F.struct(F.col(id_col).alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes")).alias("of"), text_of(text_col).alias("text"))
    made = _counted(sized, tokenizer, "of", "text", "id ?, n_tokens long, fit_chars long", columns)
    return made.select(F.col("of.id").alias(id_col), "of.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


@F.pandas_udf(LongType())
def _at(marks: pd.Series, steps: pd.Series, chars: pd.Series) -> pd.Series:
    def one(m: bytes, s: bytes, k: float) -> int | None:
        if k is None or np.isnan(k):
            return None
        k = min(max(int(k), 0), len(s) // 2)
        own = np.frombuffer(s, "<i2")[k - k % MARK_EVERY : k]
        return int(np.frombuffer(m, "<u4")[k // MARK_EVERY]) + int(own.sum(dtype=np.int64))

    return pd.Series(map(one, marks, steps, chars), dtype="Int64")


@F.pandas_udf(LongType())
def _fit(steps: pd.Series, budget: pd.Series) -> pd.Series:
    def one(s: bytes, b: float) -> int | None:
        if b is None or np.isnan(b):
            return None
        inside = np.flatnonzero(np.cumsum(np.frombuffer(s, "<i2"), dtype=np.int64) <= b)
        return int(inside[-1]) + 1 if len(inside) else 0

    return pd.Series(map(one, steps, budget), dtype="Int64")


def tokens_at(tables: DataFrame, asks: DataFrame, id_col: str = "doc_id", chars_col: str = "chars") -> DataFrame:
    """asks (an id and a number of characters) with tokens, the count of that prefix; longer asks count the whole text,
    negative ones the empty prefix, null asks and unknown ids have null."""
    t = tables.select(F.col(id_col), F.col("marks").alias("_marks"), F.col("steps").alias("_steps"))
    met = asks.join(t, id_col, "left")
    return met.withColumn("tokens", F.when(F.col("_steps").isNotNull(), _at(F.coalesce("_marks", F.lit(b"\0\0\0\0")), F.coalesce("_steps", F.lit(b"")), chars_col))).drop("_marks", "_steps")


def longest_fit(tables: DataFrame, asks: DataFrame, id_col: str = "doc_id", budget_col: str = "budget") -> DataFrame:
    """asks (an id and a number of tokens) with chars, the characters of the longest prefix within it; null asks and unknown
    ids have null."""
    met = asks.join(tables.select(F.col(id_col), F.col("steps").alias("_steps")), id_col, "left")
    return met.withColumn("chars", F.when(F.col("_steps").isNotNull(), _fit(F.coalesce("_steps", F.lit(b"")), budget_col))).drop("_steps")
