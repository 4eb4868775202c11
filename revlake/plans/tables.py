"""The given tables in the roles of the star schema: orders as requests, line items as reviews, comments and check runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="revlake-")
    return f"{root.rstrip('/')}/revlake/{name}-{uuid.uuid4().hex}"


def drop_places(spark: SparkSession, *paths: str) -> None:
    """Remove folders of shared_place that no later plan reads."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go when the query ends, not when the driver collects its garbage. Every DataFrame that
    is made within it is to be run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """pr_key, author, created, state, lines, and lines added and removed."""
    state = F.when(F.col("o_orderstatus") == "F", "MERGED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("pr_key"), F.col("o_custkey").alias("author"), F.to_date("o_orderdate").alias("created"), state.alias("state"), F.col("o_totalprice").alias("lines"), F.col("o_totalprice").alias("added"), (F.col("o_totalprice") / 4).alias("removed"))


def scoped_requests(spark: SparkSession, d: str) -> DataFrame:
    """requests with repo, the author's nation."""
    return requests(spark, d).join(read(spark, d, "customer").select(F.col("c_custkey").alias("author"), F.col("c_nationkey").alias("repo")), "author")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """pr_key, reviewer, submitted."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pr_key"), F.col("l_suppkey").alias("reviewer"), F.to_date("l_shipdate").alias("submitted"))


def comments(spark: SparkSession, d: str) -> DataFrame:
    """The two comment branches as one: pr_key, reviewer, submitted."""
    both = read(spark, d, "lineitem")
    own = lambda flag: both.filter(F.col("l_linestatus") == flag).select(F.col("l_orderkey").alias("pr_key"), F.col("l_suppkey").alias("reviewer"), F.to_date("l_shipdate").alias("submitted"))
    return own("O").unionByName(own("F"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    """pr_key, actor, day, kind: every line item is a review and, whatever its status, a comment; one scan."""
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pr_key"), F.col("l_suppkey").alias("actor"), F.to_date("l_shipdate").alias("day"))
    return line.select("*", F.explode(F.array(F.lit("review"), F.lit("comment"))).alias("kind"))


def check_runs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pr_key"), F.when(F.col("l_returnflag") == "R", "FAILURE").when(F.col("l_returnflag") == "A", "SUCCESS").alias("conclusion"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """entity_key (the customer's key), login, entity_type: one market segment stands for bots."""
    return read(spark, d, "customer").select(F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("login"), F.when(F.col("c_mktsegment") == "MACHINERY", "bot").otherwise("user").alias("entity_type"))


def loaded_ranges(spark: SparkSession, d: str) -> DataFrame:
    """entity, start, end, items: each user's days with events, as loaded ranges."""
    e = read(spark, d, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("start"))
    return e.groupBy("entity", "start").agg(F.count("*").alias("items")).select("entity", "start", F.col("start").alias("end"), "items")


PR = "pr AS (SELECT o_orderkey AS pr_key, o_custkey AS author, CAST(o_orderdate AS DATE) AS created, CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END AS state, o_totalprice AS lines, o_totalprice AS added, o_totalprice / 4 AS removed, c_nationkey AS repo, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"
RV = "rv AS (SELECT l_orderkey AS pr_key, l_suppkey AS reviewer, CAST(l_shipdate AS DATE) AS submitted FROM lineitem)"
RANGES = "rg AS (SELECT user_id AS entity, CAST(ts AS DATE) AS s, count(*) AS items FROM events GROUP BY ALL)"
