"""Hard negatives by exact inner products, after the LEMP method: buckets of like length with sorted coordinate lists, and
feasible ranges on an anchor's focus coordinates that leave few rows to verify."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SCALE = 256
#: Components reach so far, and squared lengths (after scaling), so that a hundredfold score is a long.
FARTHEST, LONGEST = float(1 << 20), float(1 << 56)
#: Labels fall into so many classes by their remainder; lengths into bands, each up to a ninth longer than the one before.
CLASSES, RATIO = 64, 0.9
#: About so many rows make a bucket, anchors a group, buckets a cell; so many cells at least where there are buckets enough.
BUCKET_ROWS, GROUP_ROWS, CELL_BUCKETS, LEAST_CELLS = 2048, 16384, 32, 64
#: Coordinates of an anchor with the largest share of its length, whose ranges are looked up.
FOCUS = 4
#: Where no range is under this share of a bucket, all its rows are verified at once.
WIDE = 0.25
_EXACT = float(1 << 53)
_SLACK = 1e-7


def vector_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (components floor(SCALE * x)), norm; equal rows once.

    Left out: rows without id, label or vector, with a null or non-finite component, with one beyond FARTHEST or a length
    beyond the square root of LONGEST, for which scores are not defined.
    """
    scaled = F.transform(F.col(vec_col), lambda x: F.when(F.abs(x.cast("double")) <= FARTHEST, F.floor(x.cast("double") * SCALE).cast("int")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = rows.filter("id is not null and label is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull()))
    return rows.dropDuplicates(["id", "label", "v"]).withColumn("norm", norm).filter(F.col("norm") * F.col("norm") <= LONGEST)


_BUCKET = "bucket long, cls int, n int, d int, low double, high double, ids binary, labels binary, v binary, lists binary"


def _buckets(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """One row for each bucket: a class and band of rows (id, label, v, norm, cls, band), and lists, for each coordinate the
    rows in ascending order of their share of length on it (little-endian uint16)."""

    def close(key: int, cls: int, got: list[tuple]) -> dict:
        ids, labels, norms = (np.array([r[k] for r in got]) for k in (0, 1, 3))
        v = np.zeros((len(got), max(len(r[2]) for r in got)), np.int32)
        for k, r in enumerate(got):
            v[k, : len(r[2])] = r[2]
        lists = np.argsort(v / np.maximum(norms, 1)[:, None], axis=0, kind="stable").T.astype("<u2")
        return {"bucket": key, "cls": cls, "n": len(got), "d": v.shape[1], "low": norms.min(), "high": norms.max(), "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "v": v.astype("<i4").tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}

    def rows_in(b: pa.RecordBatch) -> Iterator[tuple]:
        key, cls, ids, labels, v, norm = b.columns
        ends, flat = v.offsets.to_numpy().tolist(), v.values.to_numpy(zero_copy_only=False)
        own = (flat[x:y] for x, y in zip(ends, ends[1:], strict=False))
        return zip(key.to_pylist(), cls.to_pylist(), ids.to_pylist(), labels.to_pylist(), own, norm.to_pylist(), strict=True)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in rows_in(b))
        for (key, cls), got in groupby(each, key=lambda r: r[:2]):
            got = [r[2:] for r in got]
            for k in range(0, len(got), 1 << 15):  # row numbers have 16 bits; hashing keeps buckets far below
                yield pa.RecordBatch.from_pylist([close(key, cls, got[k : k + (1 << 15)])], schema)

    schema = pa.schema([("bucket", pa.int64()), ("cls", pa.int32()), ("n", pa.int32()), ("d", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), *[(c, pa.binary()) for c in ("ids", "labels", "v", "lists")]])
    keyed = rows.join(F.broadcast(splits), ["cls", "band"])  # at most CLASSES times the bands of a length under 2 ** 28
    key = F.shiftleft(F.col("cls").cast("long") * 256 + F.col("band"), 40) + F.pmod(F.xxhash64("id", "v"), F.col("splits"))
    keyed = keyed.select(key.alias("bucket"), "cls", "id", "label", "v", "norm")
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "id", "label").mapInArrow(build, _BUCKET)


class _Cell:
    """A group of anchors with their targets, each a range of scores of which the first k rows are sought."""

    def __init__(self, anchors: list[dict], same: bool, k: int):
        self.anchors, self.same, self.k = anchors, same, k
        self.q = np.zeros((len(anchors), max(len(a["v"]) for a in anchors)))
        for row, a in zip(self.q, anchors, strict=True):
            row[: len(a["v"])] = a["v"]
        self.norm = np.sqrt((self.q**2).sum(1))
        share = self.q / np.maximum(self.norm, 1)[:, None]
        self.focus = np.argsort(-np.abs(share), axis=1, kind="stable")[:, :FOCUS]
        self.angle = np.arccos(np.clip(np.take_along_axis(share, self.focus, 1), -1, 1))
        far = float("inf")
        self.targets = [[[-far if t["lo"] is None else t["lo"], far if t["hi"] is None else t["hi"], t, []] for t in a["targets"]] for a in anchors]
        # as floats these may be a little wide; targets are compared exactly
        self.lo = np.nextafter(np.array([min(t[0] for t in own) for own in self.targets], float), -far)
        self.hi = np.nextafter(np.array([max(t[1] for t in own) for own in self.targets], float), far)

    def _ranges(self, live: np.ndarray, low: float, high: float, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the live anchors' focus coordinates, begin and end in the lists (with values by) of what can reach the scores
        sought: the angle to the anchor lies between two bounds, and so the angle to the coordinate's axis does."""
        lo, hi, q = self.lo[live], self.hi[live], self.norm[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.nan_to_num(np.where(lo > 0, lo / (q * high), lo / (q * low)), nan=-1, neginf=-1, posinf=1)
            most = np.nan_to_num(np.where(hi >= 0, hi / (q * low), hi / (q * high)), nan=1, neginf=-1, posinf=1)
        far, near = np.arccos(np.clip(least - _SLACK, -1, 1))[:, None], np.arccos(np.clip(most + _SLACK, -1, 1))[:, None]
        a = self.angle[live]
        first, last = np.maximum(np.maximum(a - far, near - a), 0), np.minimum(np.minimum(a + far, 2 * np.pi - a - near), np.pi)
        floor, ceil = np.cos(np.maximum(last, first)) - _SLACK, np.cos(np.minimum(first, np.pi)) + _SLACK
        begin, end = np.zeros(a.shape, np.int64), np.full(a.shape, by.shape[1])
        focus = self.focus[live]
        for c in np.unique(focus[focus < len(by)]):
            at = focus == c
            begin[at], end[at] = np.searchsorted(by[c], floor[at], "left"), np.searchsorted(by[c], ceil[at], "right")
        return begin, np.maximum(begin, end)

    def meet(self, b: dict) -> None:
        """Take what a bucket has for the targets. A target's lower bound rises to its k-th score so far."""
        n, d = b["n"], b["d"]
        top = self.norm * b["high"] * (1 + 1e-9)
        live = np.flatnonzero((self.lo <= top) & (self.hi >= -top))
        if not len(live):
            return
        ids, labels = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i8")
        v, lists = np.frombuffer(b["rows"], "<i4").reshape(n, d).astype(float), np.frombuffer(b["lists"], "<u2").reshape(d, n)
        few: dict[int, np.ndarray] = {}
        if b["high"] > 0:
            share = v / np.maximum(np.sqrt((v**2).sum(1)), 1)[:, None]
            begin, end = self._ranges(live, b["low"], b["high"], np.take_along_axis(share.T, lists, 1))
            for k in np.flatnonzero((end - begin).min(1) < WIDE * n):
                met = np.zeros(n, np.uint8)
                for c, x, y in zip(self.focus[live[k]], begin[k], end[k], strict=True):
                    if c < d:
                        met[lists[c, x:y]] += 1
                few[int(live[k])] = np.flatnonzero(met == np.count_nonzero(self.focus[live[k]] < d))
        wide = [a for a in live.tolist() if a not in few]
        both = min(d, self.q.shape[1])
        kind = float if top.max() < _EXACT else np.int64
        v, q = v[:, :both].astype(kind), self.q[:, :both].astype(kind)
        scores = iter((v @ q[wide].T).T if wide else ())
        for a in live.tolist():
            at = few.get(a)
            s = next(scores) if at is None else v[at] @ q[a]
            own = self.anchors[a]
            fits = (s >= self.lo[a]) & (s <= self.hi[a]) & (((labels if at is None else labels[at]) == own["label"]) == self.same)
            fits &= (ids if at is None else ids[at]) != own["id"]
            if len(found := np.flatnonzero(fits)):
                self._take(a, s[found], ids[found if at is None else at[found]])

    def _take(self, a: int, s: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -s))
        s, ids = s[order], ids[order]
        for t in self.targets[a]:
            x = int(np.searchsorted(-s, -t[1], "left"))
            new = [(-int(p), i) for p, i in zip(s[x : x + self.k].tolist(), ids[x : x + self.k].tolist(), strict=True) if p >= t[0]]
            if new:
                t[3] = sorted(t[3] + new)[: self.k]
                if len(t[3]) == self.k:
                    t[0] = max(t[0], -t[3][-1][0])
        self.lo[a] = np.nextafter(float(min(t[0] for t in self.targets[a])), -np.inf)

    def found(self) -> list[dict]:
        return [{"id": a["id"], "key": a["key"], "no": t["no"], "positive_id": t["positive_id"], "positive_score": t["positive_score"], "near_id": i, "score": -s} for a, own in zip(self.anchors, self.targets, strict=True) for _, _, t, best in own for s, i in best]


_TARGET = "array<struct<no: int, positive_id: bigint, positive_score: bigint, lo: bigint, hi: bigint>>"
_FOUND = "id long, key long, no int, positive_id long, positive_score long, near_id long, score long"


def _search(index: DataFrame, anchors: DataFrame, cells_of_bucket: Column, cells_of_anchor: Column, same: bool, k: int) -> DataFrame:
    """The first k rows by score, then id, of each anchor's targets: anchors (id, key, label, v, targets) and buckets meet in
    cells, arrays of struct<grp, slot>. A task holds the anchors of one cell while its buckets pass, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
        for _, rows in groupby(each, key=lambda r: (r["grp"], r["slot"])):
            waiting, cell = [], None
            for r in rows:
                if r["ids"] is None:
                    waiting.append(r)
                elif waiting:
                    cell = cell or _Cell(waiting, same, k)
                    cell.meet(r)
            if cell and (out := cell.found()):
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("no", pa.int32()), *[(c, pa.int64()) for c in ("positive_id", "positive_score", "near_id", "score")]])
    a = anchors.select(F.explode(cells_of_anchor).alias("cell"), "id", "key", "label", "v", "targets")
    b = index.withColumn("cell", F.explode(cells_of_bucket)).select("cell", "n", "d", "low", "high", "ids", "labels", F.col("v").alias("rows"), "lists", "bucket")
    met = a.unionByName(b, allowMissingColumns=True).select("cell.grp", "cell.slot", "id", "key", "label", "v", "targets", "n", "d", "low", "high", "ids", "labels", F.col("rows"), "lists", "bucket")
    met = met.repartition("grp", "slot").sortWithinPartitions("grp", "slot", F.col("ids").isNotNull(), F.desc("high"), "bucket", "id", "key")
    found = met.mapInArrow(run, _FOUND)
    first = Window.partitionBy("id", "key", "no").orderBy(F.desc("score"), "near_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def mine_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by every; an anchor's positives its first rows of the same label, by integer
    inner product of the scaled components, then id; a positive's hard negatives the first rows of other labels with a score
    of low to high percent of the positive's. Every row is searched for every anchor; what a bucket's length or the ranges
    rule out cannot reach the scores sought, and all else is verified exactly.

    Rows that vector_rows leaves out take no part. Equal rows count once; rows with one id and other content are rows of
    their own, but none is its own anchor's positive or negative. Vectors of unequal size meet on the components that both
    have; zero vectors score 0. Ties go by id. No anchors, no other rows, or an empty table give no rows; other columns are
    not read.
    """
    spark = vectors.sparkSession
    band = F.when(F.col("norm") == 0, 0).otherwise((F.log("norm") / -float(np.log(RATIO))).cast("int") + 1)
    rows = stage(vector_rows(vectors, id_col, vec_col, label_col).withColumns({"cls": F.pmod("label", F.lit(CLASSES)).cast("int"), "band": band}), "vectors")
    is_anchor = F.col("id") % every == 0
    # a row for each class and band at most
    counts = rows.groupBy("cls", "band").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors")).collect()
    splits = spark.createDataFrame([(r["cls"], r["band"], -(-r["n"] // BUCKET_ROWS)) for r in counts], "cls int, band int, splits long")
    index = stage(_buckets(rows, splits), "buckets")
    buckets, groups = (dict.fromkeys({r["cls"] for r in counts}, 0) for _ in range(2))
    for r in counts:
        buckets[r["cls"]] += -(-r["n"] // BUCKET_ROWS)
        groups[r["cls"]] += r["anchors"]
    if not any(groups.values()):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    everyone = -(-sum(groups.values()) // GROUP_ROWS)
    groups = {c: -(-n // GROUP_ROWS) for c, n in groups.items()}

    def slots(n: int, cells: int) -> int:
        return max(-(-n // CELL_BUCKETS), min(n, cells))

    def of_class(values: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("cls"))

    def cells(n: Column, grp: Column | None, slot: Column | None) -> Column:
        at = F.sequence(F.lit(0), n - 1)
        return F.when(n > 0, F.transform(at, lambda x: F.struct((x.cast("long") if grp is None else grp).alias("grp"), (x if slot is None else slot).cast("int").alias("slot"))))

    spread = of_class({c: slots(n, -(-LEAST_CELLS // len(buckets))) for c, n in buckets.items()})
    first = F.shiftleft(F.col("cls").cast("long"), 32)
    anchors = rows.filter(is_anchor).withColumn("key", F.xxhash64("id", "label", "v"))
    own = first + F.pmod(F.col("key"), of_class(groups))
    whole = F.from_json(F.lit('[{"no": 0}]'), _TARGET)
    by_bucket = F.when(of_class(groups) > 0, F.transform(F.sequence(F.lit(0), of_class(groups) - 1), lambda g: F.struct((first + g).alias("grp"), F.pmod(F.xxhash64("bucket"), spread).cast("int").alias("slot"))))
    near = _search(index, anchors.withColumn("targets", whole), by_bucket, cells(spread, own, None), True, positives)

    bounds = {"lo": F.expr(f"({low} * score + 99) div 100"), "hi": F.expr(f"{high} * score div 100")}
    target = F.struct(F.col("rank").alias("no"), F.col("near_id").alias("positive_id"), F.col("score").alias("positive_score"), *[c.alias(k) for k, c in bounds.items()])
    targets = near.filter("score >= 0").groupBy("id", "key").agg(F.collect_list(target).alias("targets"))  # at most `positives`
    n = slots(sum(buckets.values()), LEAST_CELLS)
    grp, slot = F.pmod(F.col("key"), F.lit(everyone)), F.pmod(F.xxhash64("bucket"), F.lit(n))
    far = _search(index, anchors.join(targets, ["id", "key"]), cells(F.lit(everyone), None, slot), cells(F.lit(n), grp, None), False, negatives)
    return far.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("near_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
