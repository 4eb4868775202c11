"""Best-fit packing of token sequences by large-item matching on the histogram of lengths.

Lengths are integers up to the capacity, so the plan needs only how many pieces have each length. Pieces over a third
of the capacity stand at most two to a bin, each paired with the largest partner that fits; smaller ones go, longest
first, to the fullest bins that hold them. The plan is a bounded list of runs: so many pieces of one length, in rank
order, go to consecutive bins at one offset. Tasks then look up each piece by its rank among pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of, text_slices
from .tokens import END_ID, word_tokenizer

CAPACITY = 2048


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """counts: pieces of each length -> runs (length, first rank, pieces, first bin, offset). Piece r of a run stands in
    bin first bin + r. Bins are numbered from 0. The number of runs depends on the capacity, not on the pieces."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[list[int]]] = {}  # free room -> [first bin, bins]
    rooms: list[int] = []  # the gaps that have bins, ascending
    used = dict.fromkeys(counts, 0)
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append([first, n])

    def take(room: int, most: int) -> tuple[int, int]:
        block = gaps[room][-1]
        first, n = block[0], min(most, block[1])
        block[0], block[1] = first + n, block[1] - n
        if not block[1]:
            gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.remove(room)
        return first, n

    left = {length: n for length, n in counts.items() if n > 0}
    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        b = large[k] if k >= 0 else None
        if b is None:
            n = left[a]
            put(a, n, bins, 0)
        elif b == a:
            n = left[a] // 2
            if n:
                put(a, n, bins, 0)
                put(a, n, bins, a)
            if left[a] % 2:
                other = large[-2] if len(large) > 1 else None
                put(a, 1, bins + n, 0)
                if other is None:
                    free(capacity - a, bins + n, 1)
                else:
                    put(other, 1, bins + n, a)
                    left[other] -= 1
                    free(capacity - a - other, bins + n, 1)
                    if not left[other]:
                        large.remove(other)
            free(capacity - 2 * a, bins, n)
            bins += n + left[a] % 2
            left[a] = 0
            large.pop()
            continue
        else:
            n = min(left[a], left[b])
            put(a, n, bins, 0)
            put(b, n, bins, a)
            left[b] -= n
        free(capacity - a - (b or 0), bins, n)
        bins += n
        left[a] -= n
        for length in {a, b} - {None}:
            if not left[length]:
                large.remove(length)
    for length in sorted((x for x in left if 3 * x <= capacity and left[x]), reverse=True):
        while left[length]:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                free(capacity, bins, new := -(-left[length] // (capacity // length)))
                bins += new
                k = len(rooms) - 1
            room = rooms[k]
            first, n = take(room, left[length])
            for step in range(min(room // length, left[length] // n)):
                put(length, n, first, capacity - room + step * length)
                left[length] -= n
            free(room - (step + 1) * length, first, n)
    return runs


class Plan:
    """Bin and offset of the piece of a given length and rank."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]):
        r = np.array(sorted(runs), np.int64).reshape(-1, 5)
        self.length, self.first, _, self.bin, self.offset = r.T
        self.begin = {int(x): (int(a), int(b)) for x in np.unique(self.length) for a, b in [np.searchsorted(self.length, [x, x + 1])]}

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begin[length]
        k = a + np.searchsorted(self.first[a:b], rank, "right") - 1
        return self.bin[k] + rank - self.first[k], self.offset[k]


_PIECE = "id long, piece int, start long, length long, ids_crc32 long, task int, at long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with end_id; a null or empty text is the end id alone. Longer documents than the capacity are
    cut into full pieces after a first, shorter one. Repeated rows are packed each; rows without id keep a null id.
    Other columns are ignored; an empty table gives no rows. Long texts are encoded
    whole, one at a time where needed; ids that are no longs are cast. The plan's size is bounded by the capacity.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_tokenizer(tokenizer), np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in text_slices(batch.column(1)):
                rows = []
                for name, run in zip(islice(names, len(texts)), tok.encode(texts), strict=True):
                    run, n, start = memoryview(run + end), len(run) // 4 + 1, 0
                    size = n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        rows.append((name, piece, start, size, zlib.crc32(run[4 * start : 4 * (start + size)]), task, seen[size]))
                        seen[size] += 1
                        start, size = start + size, capacity
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "task", "at"])

    spark = docs.sparkSession
    pieces = stage(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(cut, _PIECE), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(Plan(plan_runs(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                of = np.flatnonzero(length == x)
                bins[of], offsets[of] = plan.value.place(x, rank[of])
            yield pa.record_batch([*batch.columns[:5], pa.array(bins), pa.array(offsets)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(first, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank"))
    return ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
