"""Facts in buckets, and daily sums."""

import datetime as dt
import re

from pyspark.sql import functions as F

from revlake.functions import periods
from revlake.operators import daily, metrics
from revlake.plans import queries
from revlake.plans import tables as t
from revlake.streaming import warehouse

SF = "/root/testdata/sf0.001"
D = dt.date
W = periods.comparison_windows(periods.parse_period("2022-Q2", D(2022, 7, 1)), D(2022, 7, 1))


def test_bucketed_facts_join_without_an_exchange(spark):
    prs, acts = queries._bucketed(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = acts.join(prs.select("pr_key", "author"), "pr_key").groupBy("author").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in plan
    below = plan[plan.index("SortMergeJoin") :]
    assert not re.search(r"\bExchange\b", below)
    assert spark.read.parquet(*acts.inputFiles()).count() == t.activity(spark, SF).count()


def test_daily_sums_equal_the_facts_after_changes(spark, tmp_path):
    prs = spark.createDataFrame([(11, 5, D(2022, 2, 3), "MERGED", 70.0, 7.0), (12, 5, D(2022, 5, 6), "MERGED", 20.0, 2.0), (13, 5, D(2022, 6, 1), "OPEN", 11.0, 1.0), (14, 6, D(2022, 5, 30), "MERGED", 4.0, 0.0), (15, 6, None, "OPEN", 1.0, 1.0)], "pr_key long, author long, created date, state string, added double, removed double")
    acts = spark.createDataFrame([(12, 6, D(2022, 5, 7), "review"), (14, 5, D(2022, 5, 31), "review"), (12, 5, D(2022, 5, 8), "comment"), (13, 6, D(2022, 6, 2), "comment")], "pr_key long, actor long, day date, kind string")
    root = str(tmp_path)
    days = daily.author_days(prs, acts)
    daily.refresh(days, daily.months_of(days), root, "a")

    def same(p, a):
        got = daily.scorecard(daily.read(spark, root, "a", W), W, "author")
        want = metrics.scorecard_authors(p, a, W).withColumn("author", F.col("author").cast("string"))
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        assert rows(got) == rows(want) != []

    same(prs, acts)
    before = warehouse.state(spark, root).folders
    # a request goes away with what stands in it, another changes its state: June and May are made again, February is not
    prs2, acts2 = prs.filter("pr_key <> 13").withColumn("state", F.when(F.col("pr_key") == 12, "OPEN").otherwise(F.col("state"))), acts.filter("pr_key <> 13")
    daily.refresh(daily.author_days(prs2, acts2), ["2022-05", "2022-06"], root, "a")
    same(prs2, acts2)
    after = warehouse.state(spark, root).folders
    assert after["a", "2022-02"] == before["a", "2022-02"] and ("a", "2022-06") not in after and after["a", "2022-05"] != before["a", "2022-05"]
    daily.refresh(days.limit(0), [], root, "a")
    same(prs2, acts2)


def test_days_of_authors_join_once_and_sparse_sums_are_the_same(spark, tmp_path):
    prs, acts = t.scoped_requests(spark, SF), t.activity(spark, SF)
    days = daily.author_days(t.requests(spark, SF), acts)
    assert len(re.findall(r"\bJoin\b", days._jdf.queryExecution().optimizedPlan().toString())) == 1
    months = daily.months_of(prs.select(F.col("created").alias("day")), acts.select("day"))
    for k in (False, True):
        daily.refresh(days, months, str(tmp_path), f"a{k}", sparse=k)
    rows = lambda k: sorted(map(tuple, daily.read(spark, str(tmp_path), f"a{k}").select("day", "entity", "measure", F.round("value", 2)).collect()))
    assert rows(True) == rows(False) != []
