"""Daily sums of measures, kept by month, from which scorecards and boards of any window are read.

A table has day, entity, measure and value: one row for each, so it grows with the calendar and the active entities, not with
the facts. A load changes the months that its rows fall in: their sums are made again from the facts of those months alone,
and replace the old ones in one commit. Reading a window is one aggregate over its days, without any join of facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import Windows
from ..streaming import warehouse as W
from .metrics import COMMENT, REVIEW, split_sums, with_deltas

_DAILY = "day date, entity string, measure string, value double, month string"
#: Tasks that a month's sparse sums are dealt to, at most.
SLOTS = 8


def _day(df: DataFrame, day: str, entity: str, measures: dict[str, Column]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value")) for m, v in measures.items()])).alias("x")
    return df.select(F.col(day).alias("day"), F.col(entity).cast("string").alias("entity"), each).select("day", "entity", "x.*").filter("value <> 0")


def author_days(prs: DataFrame, acts: DataFrame) -> DataFrame:
    """day, entity, measure, value of the author scorecard's measures, not yet summed. prs: pr_key, author, created, state,
    added, removed; acts as metrics.activity makes it."""
    one = F.lit(1)
    own = _day(prs, "created", "author", {"opened": one, "merged": F.when(F.col("state") == "MERGED", 1).otherwise(0), "added": F.col("added"), "removed": F.col("removed")})
    met = acts.join(prs.select("pr_key", "author"), "pr_key").filter("actor <> author")
    side = lambda who, measure: F.struct(F.col(who).cast("string").alias("entity"), F.lit(measure).alias("measure"))
    review = F.col("kind") == REVIEW
    sides = F.when(review, F.array(side("actor", "reviews_given"), side("author", "reviews_received"))).when(F.col("kind") == COMMENT, F.array(side("actor", "comments_given")))
    return own.unionByName(met.select("day", F.explode(sides).alias("x")).select("day", "x.*", F.lit(1.0).alias("value")))  # one join for both sides


def scope_days(prs: DataFrame, acts: DataFrame, scope: str = "repo") -> DataFrame:
    """The same for the measures of repositories or owners, own reviews included."""
    own = _day(prs, "created", scope, {"opened": F.lit(1), "merged": F.when(F.col("state") == "MERGED", 1).otherwise(0)})
    met = acts.join(prs.select("pr_key", scope), "pr_key")
    return own.unionByName(_day(met, "day", scope, {"reviews": (F.col("kind") == REVIEW).cast("int"), "comments": (F.col("kind") == COMMENT).cast("int")}))


def months_of(*days: DataFrame) -> list[str]:
    """The months of tables of days (day); bounded by the calendar. More months than have sums do no harm, so the facts' own
    days do, without their join."""
    out: set[str] = set()
    for df in days:
        out |= {r[0] for r in df.select(F.date_format("day", "yyyy-MM")).distinct().collect() if r[0]}
    return sorted(out)


def refresh(days: DataFrame, months: list[str], root: str, name: str, writer: str = "", number: int | None = None, sparse: bool = False) -> None:
    """Make the sums of these months again from days (day, entity, measure, value of all facts); other months stay. A day
    without date belongs to no month. (writer, number) names a refresh that may come again. sparse: an entity has
    few facts a day, so that sums are about as many as facts; these are dealt by month, summed and written by one shuffle. Else
    tasks sum their own facts first."""
    spark = days.sparkSession
    inside = days.withColumn("month", F.date_format("day", "yyyy-MM")).filter(F.col("month").isin(months))
    by = ["day", "entity", "measure", "month"]
    if sparse:
        by.append("slot")
        inside = inside.withColumn("slot", F.pmod(F.xxhash64("entity"), F.lit(SLOTS))).repartition("month", "slot")
    sums = inside.groupBy(*by).agg(F.sum("value").alias("value")).select("day", "entity", "measure", "value", "month")

    def job(at: W.State) -> W.Change:
        written = W.write(sums, root, name, "month", dealt=sparse) if months else {}
        return W.Change([(name, m) for m in months], {(name, m): (written[m],) if m in written else () for m in months})

    W.apply(spark, root, writer, W.state(spark, root).version if number is None else number, {name: job})


def read(spark: SparkSession, root: str, name: str, windows: Windows | None = None) -> DataFrame:
    """day, entity, measure, value; of the months that the windows touch only, if given."""
    at = W.state(spark, root)
    parts = at.parts(name)
    if windows is not None:
        spans = [(lo.strftime("%Y-%m"), hi.strftime("%Y-%m")) for lo, hi in ((windows.start, windows.end), (windows.prev_start, windows.prev_end))]
        parts = [p for p in parts if any(lo <= p <= hi for lo, hi in spans)]
    return W.read(spark, root, at, name, _DAILY, parts).drop("month")


def scorecard(daily: DataFrame, windows: Windows, entity: str = "entity") -> DataFrame:
    """entity, measure, current, previous, delta, delta_percent, as the scorecards of the facts have them."""
    wide = split_sums(daily, ["entity", "measure"], "day", {"n": (F.lit(True), F.col("value"))}, windows)
    both = wide.select(F.col("entity").alias(entity), "measure", F.col("n_current").alias("current"), F.col("n_previous").alias("previous"))
    return with_deltas(both.filter("current <> 0 OR previous <> 0"))


def board_counts(daily: DataFrame, measure: str, windows: Windows) -> DataFrame:
    """entity, current, previous of one measure, for top_board."""
    wide = split_sums(daily.filter(F.col("measure") == measure), ["entity"], "day", {"n": (F.lit(True), F.col("value"))}, windows)
    return wide.select("entity", F.col("n_current").cast("long").alias("current"), F.col("n_previous").cast("long").alias("previous"))
