"""Quality: ordinal cumulative-link (proportional odds) regression on graded ratings over hashed text.

P(grade > k | text) = 1 / (1 + exp(theta_k - w . x)): the weights w are shared by all grades and the thresholds theta
ascend. x holds hashed words and hashed word shapes, each as shares of the text's words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, drop_staged, stage, text_of, text_slices
from .toxicity import fold

DIMS, SHAPES = 1 << 15, 1024
#: Words, shapes, then three shares of the whole text: its length, words like their predecessor (eightfold, 1 at most), different words.
SIZE = DIMS + SHAPES + 3
#: At most so many graded rows are used to fit, in so many partitions.
FIT_ROWS, FIT_PARTS = 12_000, 8
STEPS, RIDGE = 60, 3e-4


class Hashed:
    """Hashed vectors of some texts: a slot for each word and one for its shape (letters as x or X, digits as 0, in runs),
    and the shares of each whole text."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        slot = np.array([zlib.crc32(x.encode()) for x in pc.ascii_lower(w.known).to_numpy(zero_copy_only=False)], np.int64) % DIMS
        shapes = w.known
        for run, sign in (("[a-z]+", "x"), ("[A-Z]+", "X"), ("[0-9]+", "0")):
            shapes = pc.replace_substring_regex(shapes, run, sign)
        shapes = pc.dictionary_encode(shapes)
        kinds = np.array([DIMS + zlib.crc32(x[:12].encode()) % SHAPES for x in shapes.dictionary.to_pylist()], np.int64)
        self.slots = np.stack([slot, kinds[shapes.indices.to_numpy()]]) if len(slot) else np.empty((2, 0), np.int64)
        self.n = w.ends - w.begins
        self.some = np.flatnonzero(self.n)
        doc = np.repeat(np.arange(len(self.n)), self.n)
        like = np.zeros(len(w.at))
        like[1:] = (w.at[1:] == w.at[:-1]) & (doc[1:] == doc[:-1])
        kinds = np.bincount(np.unique(doc * max(len(w.known), 1) + w.at) // max(len(w.known), 1), minlength=len(self.n))
        least = np.maximum(self.n, 1)
        self.whole = np.stack([np.log1p(least) / 10, np.minimum(1, 8 * self.sums(like) / least), kinds / least], 1)

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        out = np.zeros(len(self.n))
        if len(self.some):
            out[self.some] = np.add.reduceat(of_word, self.words.begins[self.some])
        return out

    def scores(self, w: np.ndarray) -> np.ndarray:
        of_word = w[self.slots].sum(0)[self.words.at] if len(self.words.at) else np.zeros(0)
        return self.sums(of_word) / np.maximum(self.n, 1) + self.whole @ w[-3:]

    def vectors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slots and shares of each text."""
        for a, b, n, whole in zip(self.words.begins, self.words.ends, np.maximum(self.n, 1), self.whole, strict=True):
            at, count = np.unique(self.slots[:, self.words.at[a:b]], return_counts=True)
            yield np.append(at, range(SIZE - 3, SIZE)), np.append(count / n, whole)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _over(fit: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """of(grades, row, slot, share) summed over the fitting rows: one array from each partition reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sizes = np.diff(batch["slots"].offsets.to_numpy())
            total = total + of(batch["y"].to_numpy(), np.repeat(np.arange(len(batch)), sizes), batch["slots"].flatten().to_numpy(), batch["shares"].flatten().to_numpy())
        if isinstance(total, np.ndarray):
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return sum(np.frombuffer(r["sums"]) for r in fit.mapInArrow(run, "sums binary").collect())


def fit_ordinal(fit: DataFrame, n_grades: int, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds (n_grades - 1) from fit (y, slots, shares), by limited-memory BFGS on the mean
    negative log likelihood. Tasks sum the gradients of their rows; the driver holds a few vectors of the model's size."""
    ends = n_grades - 1
    counts = _over(fit, lambda y, row, col, val: np.concatenate((np.bincount(y, minlength=n_grades), np.bincount(col, val.astype(float) ** 2, SIZE))))
    n = counts[:n_grades].sum()
    # rarer slots are raised, so that the text's telling words move as fast as its common ones
    scale = 1 / np.sqrt(counts[n_grades:] / n + 1e-5)
    share = (1 - np.cumsum(counts[:ends]) / n).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(SIZE), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([p[SIZE : SIZE + 1], np.exp(p[SIZE + 1 :])]))

    def value(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, theta = p[:SIZE] * scale, thresholds(p)

        def part(y: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> np.ndarray:
            upper, lower = np.minimum(y, ends - 1), np.maximum(y - 1, 0)
            s = np.bincount(row, val * w[col], len(y))
            hi = np.where(y == ends, 1.0, _sigmoid(theta[upper] - s))
            lo = np.where(y == 0, 0.0, _sigmoid(theta[lower] - s))
            like = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
            dtheta = np.bincount(upper, -dhi * (y < ends), ends) + np.bincount(lower, dlo * (y > 0), ends)
            return np.concatenate(([-np.log(like).sum()], np.bincount(col, val * (dhi - dlo)[row], SIZE), dtheta))

        sums = _over(fit, part) / n
        tail = np.cumsum(sums[1 + SIZE :][::-1])[::-1]
        g = np.concatenate((sums[1 : 1 + SIZE] * scale + ridge * p[:SIZE], tail[:1], tail[1:] * np.exp(p[SIZE + 1 :])))
        return sums[0] + ridge / 2 * (p[:SIZE] ** 2).sum(), g

    f, g = value(p)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = -g, []
        for s, y in reversed(memory):
            kept.append(a := s @ way / (s @ y))
            way = way - a * y
        if memory:
            s, y = memory[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(memory, reversed(kept), strict=True):
            way = way + s * (a - y @ way / (s @ y))
        rate = 1.0 if memory else min(1.0, 1 / np.abs(g).sum())
        while True:
            f2, g2 = value(p + rate * way)
            if f2 <= f + 1e-4 * rate * (g @ way) or rate < 1e-4:
                break
            rate /= 3
        s, y = rate * way, g2 - g
        if s @ y > 1e-12:
            memory = [*memory[-7:], (s, y)]
        p, done = p + s, f - f2 < 1e-5 * abs(f)
        f, g = f2, g2
        if done:
            break
    return p[:SIZE] * scale, thresholds(p)


def grade_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", n_grades: int = 2, at_least: int = 1, keep_from: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The input's columns as struct row, and held_out, expected_grade, tail_probability (of a grade >= at_least), kept.

    Grades are integers from 0 to n_grades - 1; others and nulls are not learned from. Only rows whose fold (crc32 of
    the id's text, mod 4) is not 2 are, at most fit_rows, chosen by a hash of the id. A null text counts as empty.
    Without ratings all texts get the same grade in the middle. Repeated rows repeat; other columns are not read. An empty table gives no rows. Texts of any
    length are read whole, a few megabytes of them at a time; ids that are no longs are cast.
    """
    known = ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").between(0, n_grades - 1)).filter(fold("id") != 2)
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in text_slices(batch["text"]):
                both = list(Hashed(texts).vectors())
                yield pa.record_batch([batch["y"].slice(at, len(texts)), pa.array([x for x, _ in both], pa.list_(pa.int32())), pa.array([x for _, x in both], pa.list_(pa.float32()))], names=["y", "slots", "shares"])
                at += len(texts)

    # fit_rows bounds what is broadcast and what fits
    fit = rows.select("id", "text").join(F.broadcast(known), "id").dropDuplicates(["id"]).select("y", "text").mapInArrow(vectors, "y int, slots array<int>, shares array<float>")
    fit = stage(fit.repartition(FIT_PARTS), "quality-fit")
    w, theta = fit_ordinal(fit, n_grades) if fit.count() else (np.zeros(SIZE), np.zeros(n_grades - 1))
    drop_staged(fit)
    model = docs.sparkSession.sparkContext.broadcast((w, theta))

    @F.pandas_udf("expected double, tail double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, theta = model.value
        for texts in parts:
            s = np.concatenate([np.empty(0), *(Hashed(x).scores(w) for x in text_slices(pa.array(texts, pa.string())))])
            above = _sigmoid(s[:, None] - theta)
            yield pd.DataFrame({"expected": above.sum(1), "tail": above[:, at_least - 1]})

    return rows.select("row", (fold("id") == 2).alias("held_out"), judge("text").alias("j")).select("row", "held_out", F.col("j.expected").alias("expected_grade"), F.col("j.tail").alias("tail_probability"), (F.col("j.tail") >= keep_from).alias("kept"))
