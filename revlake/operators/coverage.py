"""What has been loaded and what is missing: ranges, gaps, cursors and load windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timekeys import month_windows

FIRST_LOAD_DAYS = 90
MOST_SPLITS = 8


def clamp_ranges(ranges: DataFrame, sealable: Column) -> DataFrame:
    """Ends are cut to the last complete day; ranges that this empties go. ranges: entity, start, end, ..."""
    return ranges.withColumn("end", F.least("end", sealable)).filter("start <= end")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """entity, start, end, items: overlapping and adjacent ranges made one, their counts added (overlaps add twice)."""
    w = Window.partitionBy("entity").orderBy("start", "end")
    so_far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("fresh", F.when(F.col("start") <= F.date_add(so_far, 1), 0).otherwise(1))
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("island", island).groupBy("entity", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("items").alias("items")).drop("island")


def record_ranges(old: DataFrame, new: DataFrame, sealable: Column) -> DataFrame:
    return merge_ranges(old.unionByName(clamp_ranges(new, sealable)))


def recorded_until(ranges: DataFrame, sealable: Column) -> DataFrame:
    """Merged ranges as readers see them: clamped again, so that a day recorded too early is not taken as complete."""
    return clamp_ranges(merge_ranges(ranges), sealable)


def gaps(ranges: DataFrame, target: Column) -> DataFrame:
    """entity, gap_start, gap_end between merged ranges and after the last one up to target; nothing before the first."""
    merged = merge_ranges(ranges)
    w = Window.partitionBy("entity").orderBy("start")
    after = F.coalesce(F.date_sub(F.lead("start").over(w), 1), target)
    return merged.select("entity", F.date_add("end", 1).alias("gap_start"), F.least(after, target).alias("gap_end")).filter("gap_start <= gap_end")


def extent(ranges: DataFrame, sealable: Column | None = None) -> DataFrame:
    """entity, start, end of all ranges; with sealable the ends are cut to it first."""
    ranges = ranges if sealable is None else clamp_ranges(ranges, sealable)
    return ranges.groupBy("entity").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def since_cursor(items: DataFrame, cursors: DataFrame, by: list[str], updated: str = "updated_at") -> DataFrame:
    """Items at or after their source's cursor; those without a time or a cursor are kept."""
    u = F.col(updated)
    return items.join(cursors.select(*by, "cursor"), by, "left").filter(F.col("cursor").isNull() | u.isNull() | (u >= F.col("cursor"))).drop("cursor")


def advance_cursors(old: DataFrame, accepted: DataFrame, open_rejects: DataFrame, by: list[str], updated: str = "updated_at") -> DataFrame:
    """by, newest, cursor: newest is the newest accepted item ever, the cursor that time or the oldest item that is still
    rejected, whichever is less, and never goes backwards. Where nothing was accepted a cursor stays; rejects alone make none.
    old: by, cursor and, where it is kept, newest; open_rejects: also those of earlier loads."""
    new = accepted.groupBy(*by).agg(F.max(updated).alias("_new"))
    bad = open_rejects.groupBy(*by).agg(F.min(updated).alias("_bad"))
    newest = F.col("newest") if "newest" in old.columns else F.col("cursor")
    was = old.select(*by, F.col("cursor").alias("_was"), newest.alias("_newest"))
    both = was.join(new, by, "full").join(bad, by, "left").withColumn("newest", F.greatest("_newest", "_new"))
    return both.select(*by, "newest", F.greatest("_was", F.when(F.col("newest").isNotNull(), F.least("newest", "_bad"))).alias("cursor"))


def load_window(sources: DataFrame, last_day: Column, days_back: Column) -> DataFrame:
    """Adds load_start and load_end. sources: covered_start, covered_end (null: never loaded). Asked-for days win; a first
    load goes FIRST_LOAD_DAYS back; a covered source loads the last day again at least, never past the coverage's end."""
    first = F.date_sub(last_day, FIRST_LOAD_DAYS - 1)
    start = F.when(days_back.isNotNull(), F.date_sub(last_day, days_back - 1)).when(F.col("covered_end").isNull(), first).otherwise(F.least(F.date_add("covered_end", 1), last_day))
    return sources.withColumn("load_start", F.when(F.col("covered_end").isNotNull(), F.least(start, F.date_add("covered_end", 1))).otherwise(start)).withColumn("load_end", last_day)


def capped_windows(daily: DataFrame, start: Column, end: Column, cap: int, depth: int = MOST_SPLITS) -> DataFrame:
    """win_start, win_end, items, unsplittable: month windows halved while they hold more than cap items and more than a
    day, depth times at most. daily: day, items. The days' running counts become one array, a number for each day of the
    calendar, and a window's count is the difference of two of its entries: no round counts again."""
    span = daily.sparkSession.range(1).select(start.alias("lo"), end.alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    counts = daily.groupBy("day").agg(F.sum("items").alias("items"))
    whole = days.join(counts, "day", "left").agg(F.array_sort(F.collect_list(F.struct("day", F.coalesce("items", F.lit(0)).alias("items")))).alias("d"))
    sums = F.aggregate("d", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["items"])))
    base = whole.select(sums.alias("sums"), F.col("d")[0]["day"].alias("lo"), F.element_at("d", -1)["day"].alias("hi"))

    def items(s: Column, e: Column) -> Column:
        return F.get("sums", F.datediff(e, F.col("lo")) + 1) - F.get("sums", F.datediff(s, F.col("lo")))

    window = lambda s, e: F.struct(s.alias("s"), e.alias("e"), items(s, e).alias("n"))
    now = base.select("sums", "lo", F.transform(month_windows(F.col("lo"), F.col("hi")), lambda w: window(w["start"], w["end"])).alias("w"))
    for _ in range(depth):
        mid = lambda x: F.date_add(x["s"], F.floor(F.datediff(x["e"], x["s"]) / 2).cast("int"))
        halves = lambda x: F.when((x["n"] > cap) & (x["s"] < x["e"]), F.array(window(x["s"], mid(x)), window(F.date_add(mid(x), 1), x["e"]))).otherwise(F.array(x))  # noqa: E731, B023
        now = now.select("sums", "lo", F.flatten(F.transform("w", halves)).alias("w"))
    return now.select(F.explode("w").alias("w")).select(F.col("w.s").alias("win_start"), F.col("w.e").alias("win_end"), F.col("w.n").alias("items"), (F.col("w.n") > cap).alias("unsplittable"))


def route_sources(sources: DataFrame) -> DataFrame:
    """Adds route: repos or users for enabled sources of these types, disabled, or unsupported. sources: kind, enabled."""
    route = F.when(~F.col("enabled"), "disabled").when(F.col("kind") == "repo", "repos").when(F.col("kind") == "user", "users").otherwise("unsupported")
    return sources.withColumn("route", route)
