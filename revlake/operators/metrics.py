"""Two-window measures and the scorecards made of them. Reviews and comments are one table of activity, read once and
joined once with the requests; requests are read twice, for their own measures and for that join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.deltas import delta, delta_percent
from ..functions.periods import Windows


def split_sums(df: DataFrame, by: list[str], date_col: str, measures: dict[str, tuple[Column, Column | None]], windows: Windows) -> DataFrame:
    """by, and <measure>_current, <measure>_previous for each measure (condition, value; None counts rows)."""
    d = F.col(date_col)
    cols = []
    for name, (cond, value) in measures.items():
        v = F.lit(1).cast("long") if value is None else value
        for when, test in (("current", windows.current(d)), ("previous", windows.previous(d))):
            cols.append(F.greatest(F.coalesce(F.sum(F.when(test & cond, v)), F.lit(0)), F.lit(0)).alias(f"{name}_{when}"))
    return df.filter(windows.either(d)).groupBy(*by).agg(*cols)


def long_form(wide: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """by, measure, current, previous, without rows that are 0 in both."""
    parts = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_current").cast("double").alias("current"), F.col(f"{m}_previous").cast("double").alias("previous")) for m in measures])
    return wide.select(*by, F.explode(parts).alias("m")).select(*by, "m.*").filter("current <> 0 OR previous <> 0")


def with_deltas(df: DataFrame) -> DataFrame:
    c, p = F.col("current"), F.col("previous")
    return df.withColumn("delta", delta(c, p)).withColumn("delta_percent", delta_percent(c, p))


def failure_ratio(runs: DataFrame, prs: DataFrame, by: list[str], windows: Windows) -> DataFrame:
    """by, ratio of failed runs of requests created in the current window; null conclusions count as runs."""
    own = prs.filter(windows.current(F.col("created"))).select("pr_key", *by)
    failed = F.col("conclusion").isin("FAILURE", "TIMED_OUT")
    return runs.select("pr_key", "conclusion").join(own, "pr_key").groupBy(*by).agg((F.sum(F.when(failed, 1).otherwise(0)).cast("double") / F.count("*")).alias("ratio"))


#: What an activity row can be.
REVIEW, COMMENT = "review", "comment"
RUN, FAILED = "run", "failed run"


def activity(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """pr_key, actor, day, kind of reviews and of both kinds of comments."""
    one = lambda df, kind: df.select("pr_key", F.col("reviewer").alias("actor"), F.col("submitted").alias("day"), F.lit(kind).alias("kind"))
    return one(reviews, REVIEW).unionByName(one(comments, COMMENT))


def _of_kind(names: dict[str, str]) -> dict[str, tuple[Column, None]]:
    return {name: (F.col("kind") == kind, None) for name, kind in names.items()}


def _own() -> dict[str, tuple[Column, None]]:
    return {"opened": (F.lit(True), None), "merged": (F.col("state") == "MERGED", None)}


def scorecard_authors(prs: DataFrame, acts: DataFrame, windows: Windows) -> DataFrame:
    """author, measure, current, previous, delta, delta_percent for every author: opened, merged (by created date), lines
    added and removed, reviews given and received and comments given, own requests excluded. acts as activity makes it."""
    own = split_sums(prs, ["author"], "created", _own() | {"added": (F.lit(True), F.col("added")), "removed": (F.lit(True), F.col("removed"))}, windows)
    met = acts.filter(windows.either(F.col("day"))).join(prs.select("pr_key", "author"), "pr_key").filter("actor <> author")
    pairs = split_sums(met, ["actor", "author"], "day", _of_kind({"reviews": REVIEW, "comments": COMMENT}), windows)  # then by either side
    given, taken = ["reviews_given", "comments_given"], ["reviews_received"]

    def side(who: str, kept: list[str]) -> Column:
        """One row for one side of a pair, with 0 in the other side's measures."""
        value = lambda m, w: F.col(f"{m.split('_')[0]}_{w}") if m in kept else F.lit(0).cast("long")
        return F.struct(F.col(who).alias("author"), *[value(m, w).alias(f"{m}_{w}") for m in given + taken for w in ("current", "previous")])

    both = pairs.select(F.explode(F.array(side("actor", given), side("author", taken))).alias("x")).select("x.*")
    sums = both.groupBy("author").agg(*[F.sum(c).alias(c) for c in both.columns if c != "author"])
    return with_deltas(long_form(own, ["author"], ["opened", "merged", "added", "removed"]).unionByName(long_form(sums, ["author"], ["reviews_given", "reviews_received", "comments_given"])))


def scorecard_scopes(prs: DataFrame, acts: DataFrame, windows: Windows, scope: str = "repo", runs: DataFrame | None = None) -> DataFrame:
    """scope, measure, ...: opened, merged, reviews, comments; own reviews included. With check runs also failure_rate, of
    the current window alone: runs are two more kinds of activity, so that all meet the requests in one join."""
    own = split_sums(prs, [scope], "created", _own(), windows)
    rows = acts.filter(windows.either(F.col("day"))).select("pr_key", "day", "kind")
    if runs is not None:
        kind = F.when(F.col("conclusion").isin("FAILURE", "TIMED_OUT"), FAILED).otherwise(RUN).alias("kind")
        rows = rows.unionByName(runs.select("pr_key", F.lit(None).cast("date").alias("day"), kind))
    met = rows.join(prs.select("pr_key", scope, "created"), "pr_key")
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    sums = [count((F.col("kind") == kind) & test(F.col("day"))).alias(f"{m}_{when}") for m, kind in (("reviews", REVIEW), ("comments", COMMENT)) for when, test in (("current", windows.current), ("previous", windows.previous))]
    now = windows.current(F.col("created"))
    ran = [count(F.col("kind").isin(*kinds) & now).alias(name) for name, kinds in (("_failed", [FAILED]), ("_ran", [RUN, FAILED]))]
    wide = met.groupBy(scope).agg(*sums, *ran)
    card = long_form(own, [scope], ["opened", "merged"])
    if runs is None:
        return with_deltas(card.unionByName(long_form(wide, [scope], ["reviews", "comments"])))
    part = lambda m, now, was: F.struct(F.lit(m).alias("measure"), now.cast("double").alias("current"), was.cast("double").alias("previous"))
    parts = [part(m, F.col(f"{m}_current"), F.col(f"{m}_previous")) for m in ("reviews", "comments")]
    parts.append(part("failure_rate", F.col("_failed") / F.nullif(F.col("_ran"), F.lit(0)), F.lit(None)))
    long = wide.select(scope, F.explode(F.array(*parts)).alias("m")).select(scope, "m.*")
    kept = F.when(F.col("measure") == "failure_rate", F.col("current").isNotNull()).otherwise((F.col("current") != 0) | (F.col("previous") != 0))
    return with_deltas(card.unionByName(long.filter(kept)))


def _current_only(df: DataFrame, by: str, measure: str, value: str) -> DataFrame:
    return df.select(by, F.lit(measure).alias("measure"), F.col(value).cast("double").alias("current"), F.lit(None).cast("double").alias("previous"))


def scorecard_members(prs: DataFrame, reviews: DataFrame, roster: DataFrame, windows: Windows) -> DataFrame:
    """group, measure, ...: opened and merged by members, reviews given to outsiders, and members. roster: group, member."""
    own = prs.join(roster.withColumnRenamed("member", "author"), "author")
    own = split_sums(own, ["group"], "created", _own(), windows)
    given = reviews.filter(windows.either(F.col("submitted"))).select("pr_key", "reviewer", "submitted").join(roster.withColumnRenamed("member", "reviewer"), "reviewer").join(prs.select("pr_key", "author"), "pr_key")
    given = given.join(roster.select(F.col("group").alias("g"), F.col("member").alias("m")), (F.col("g") == F.col("group")) & (F.col("m") == F.col("author")), "left_anti")
    given = split_sums(given, ["group"], "submitted", {"given_outside": (F.lit(True), None)}, windows)
    members = roster.groupBy("group").agg(F.countDistinct("member").alias("n"))
    return with_deltas(long_form(own, ["group"], ["opened", "merged"]).unionByName(long_form(given, ["group"], ["given_outside"])).unionByName(_current_only(members, "group", "members", "n")))


def group_sizes(groups: DataFrame, roster: DataFrame) -> DataFrame:
    """group, members; groups without members have 0."""
    return groups.join(roster, "group", "left").groupBy("group").agg(F.count("member").alias("members"))
