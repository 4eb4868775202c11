"""Leaderboards with the rank in both windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import Windows
from .metrics import split_sums

#: A board lists a few hundred entities at most; ranks are counted against that many rows.
MOST_TOP = 500


def board_counts(df: DataFrame, entity: str, date_col: str, windows: Windows, scope: list[str] | None = None) -> DataFrame:
    wide = split_sums(df, [*(scope or []), entity], date_col, {"n": (F.lit(True), None)}, windows)
    return wide.select(*(scope or []), F.col(entity).alias("entity"), F.col("n_current").alias("current"), F.col("n_previous").alias("previous"))


def top_board(counts: DataFrame, top: int = 10) -> DataFrame:
    """entity, current, previous, delta, rank_current, rank_previous of the first top entities by (current desc, entity);
    rank_previous is null without activity in that window. No window over all entities: the top rows are few."""
    if top > MOST_TOP:
        raise ValueError(f"a board has {MOST_TOP} rows at most")
    best = counts.filter("current > 0").orderBy(F.desc("current"), "entity").limit(top)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("current"), "entity"))  # over the listed rows
    one = F.lit(0).alias("_scope")
    return _with_previous_rank(best.withColumn("rank_current", place).select(one, "*"), counts.select(one, "*"), ["_scope"]).drop("_scope")


def scoped_boards(counts: DataFrame, scope: list[str], top: int = 10) -> DataFrame:
    """The same for each scope. The filter on the row number lets tasks keep their first rows of a scope only."""
    now = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("current"), "entity"))
    best = counts.filter("current > 0").withColumn("rank_current", now).filter(F.col("rank_current") <= top)
    return _with_previous_rank(best, counts, scope)


def _with_previous_rank(best: DataFrame, counts: DataFrame, scope: list[str]) -> DataFrame:
    """The listed rows with their rank by (previous desc, entity) among all of their scope.

    A scope's histogram of previous counts has the entities before each count; those of the same count are put in the slots
    between the listed entities of that count, which are few, and counted by slot. Both are partial sums over narrow rows;
    no entity is compared with more than the listed ones of its own count, and no scope is sorted.
    """
    active = counts.filter("previous > 0 AND current >= 0")  # both columns, so that the branches share one exchange
    by = [*scope, "previous"]
    higher = Window.partitionBy(*scope).orderBy(F.desc("previous")).rowsBetween(Window.unboundedPreceding, -1)
    before = active.groupBy(*by).agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0))).drop("n")
    listed = best.filter("previous > 0").groupBy(*by).agg(F.sort_array(F.collect_list("entity")).alias("es"))
    slot = F.size(F.filter("es", lambda x: x < F.col("entity"))).alias("slot")
    slots = active.join(listed, by).groupBy(*by, slot).agg(F.count("*").alias("n")).groupBy(*by).agg(F.collect_list(F.struct("slot", "n")).alias("slots"))
    ranks = listed.join(before, by).join(slots, by).select(*by, "above", "slots", F.posexplode("es").alias("pos", "entity"))
    same = F.aggregate("slots", F.lit(0).cast("long"), lambda a, x: a + F.when(x["slot"] <= F.col("pos"), x["n"]).otherwise(0))
    ranks = ranks.select(*scope, "entity", (F.col("above") + same).cast("int").alias("rank_previous"))
    return best.join(ranks, [*scope, "entity"], "left").select(*scope, "entity", "current", "previous", (F.col("current") - F.col("previous")).alias("delta"), "rank_current", "rank_previous")


def with_names(board: DataFrame, *names: DataFrame) -> DataFrame:
    """names: tables (entity, name); the first that knows an entity names it, else its key."""
    out = board
    for k, n in enumerate(names):
        out = out.join(n.select("entity", F.col("name").alias(f"_{k}")), "entity", "left")
    return out.select(*board.columns, F.coalesce(*[f"_{k}" for k in range(len(names))], F.col("entity").cast("string")).alias("entity_name"))
