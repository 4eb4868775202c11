"""Queries of the analytics operators over the given tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import deltas, identity, periods, timekeys
from ..operators import boards, coverage, daily, listing, merge, metrics, quality, search, text_index
from ..sources import sinks
from . import sqlsurface
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

D = dt.date
Q2 = periods.parse_period("1997-Q2", D(1997, 7, 1))
FULL = periods.comparison_windows(Q2, D(1997, 7, 1))
PART = periods.comparison_windows(Q2, D(1997, 5, 15))
ZONE = "America/Los_Angeles"
TARGET = D(2024, 1, 31)

CUR, PREV = "BETWEEN DATE '1997-04-01' AND DATE '1997-06-30'", "BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'"
EITHER = "BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if kind in ("date", "timestamp") else F.col(c) for c, kind in df.dtypes])


# --- listings and counts

_LIST = "pr_key, author, state, CAST(created AS VARCHAR) AS created"


def _listed(df: DataFrame) -> DataFrame:
    return dates_as_text(df.select("pr_key", "author", "state", "created"))


@query(f"WITH {t.PR} SELECT pr_key, c_name AS author, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bot' ELSE 'user' END AS author_type, state, CAST(created AS VARCHAR) AS created FROM pr WHERE state IN ('MERGED', 'OPEN') AND created BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' ORDER BY pr.created DESC, pr_key LIMIT 50 OFFSET 25")
def listing_page(spark, d):
    rows = listing.between(listing.where_in(t.requests(spark, d), "state", ["MERGED", "OPEN"]), "created", D(1996, 1, 1), D(1996, 12, 31))
    rows = listing.page(rows.withColumnRenamed("author", "author_key"), [F.desc("created"), F.col("pr_key")], 50, 25)
    return dates_as_text(listing.with_authors(rows, t.entities(spark, d)).select("pr_key", "author", "author_type", "state", "created"))


@query(f"WITH {t.PR}, {t.RV} SELECT {_LIST} FROM pr WHERE pr_key IN (SELECT pr_key FROM rv WHERE reviewer = 7)")
def listing_by_reviewer(spark, d):
    return _listed(listing.where_related(t.requests(spark, d), t.reviews(spark, d).filter("reviewer = 7"), "pr_key"))


@query(f"WITH {t.PR} SELECT {_LIST} FROM pr WHERE repo IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def listing_by_owner(spark, d):
    owned = t.read(spark, d, "nation").join(t.read(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return _listed(listing.where_related(t.scoped_requests(spark, d), owned.select(F.col("n_nationkey").alias("repo")), "repo"))


@query(f"WITH {t.PR} SELECT {_LIST} FROM pr WHERE pr_key IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#13')")
def listing_by_label(spark, d):
    labelled = t.read(spark, d, "part").filter("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("label"))
    bridge = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pr_key"), F.col("l_partkey").alias("label"))
    return _listed(listing.where_related(t.requests(spark, d), listing.where_related(bridge, labelled, "label"), "pr_key"))


def _roster(spark, d, segment: str) -> DataFrame:
    return t.read(spark, d, "customer").filter(F.col("c_mktsegment") == segment).select(F.col("c_custkey").alias("author"))


@query(f"WITH {t.PR} SELECT {_LIST} FROM pr WHERE c_mktsegment = 'BUILDING' AND state = 'CLOSED'")
def listing_by_group(spark, d):
    return _listed(listing.where_related(listing.where_in(t.requests(spark, d), "state", ["CLOSED"]), _roster(spark, d, "BUILDING"), "author"))


@query(f"WITH {t.PR} SELECT {_LIST} FROM pr WHERE c_mktsegment <> 'BUILDING' AND state = 'CLOSED'")
def listing_excluding_group(spark, d):
    return _listed(listing.where_unrelated(listing.where_in(t.requests(spark, d), "state", ["CLOSED"]), _roster(spark, d, "BUILDING"), "author"))


@query(f"WITH {t.PR} SELECT {_LIST} FROM pr WHERE created BETWEEN DATE '1997-06-02' AND DATE '1997-07-01'")
def listing_rolling_period(spark, d):
    return _listed(listing.during(t.requests(spark, d), "created", periods.parse_period("last-30", D(1997, 7, 1))))


@query(f"WITH {t.PR} SELECT 'none' AS filter, count(*) AS n FROM pr WHERE 1 = 0 UNION ALL SELECT 'all', count(*) FROM pr")
def filter_by_empty_set(spark, d):
    own = t.requests(spark, d)
    one = lambda name, df: listing.count_rows(df).select(F.lit(name).alias("filter"), "n")
    return one("none", listing.where_in(own, "author", [])).union(one("all", listing.where_not_in(own, "author", [])))


@query(f"WITH {t.PR}, a AS (SELECT c_custkey FROM customer WHERE c_name IN ('Customer#000000007', 'Customer#000000011') AND c_mktsegment <> 'MACHINERY' OR c_mktsegment = 'MACHINERY' AND c_name = 'Customer#000000001') SELECT {_LIST} FROM pr WHERE author IN (SELECT c_custkey FROM a)")
def listing_by_login(spark, d):
    """Bare logins in any case give every entity that has them; type:login is taken as it is."""
    c = t.read(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "Bot").otherwise("User")
    known = c.select("c_custkey", identity.entity_key(F.col("c_name"), kind).alias("entity_key"), F.lower("c_name").alias("login"))
    asked = spark.createDataFrame([("user:customer#000000007",), ("User:CUSTOMER#000000011",), ("bot:customer#000000001",), ("nobody",)], "login string")
    keys = known.join(identity.resolve_logins(asked, known.select("login", "entity_key")).select("entity_key"), "entity_key", "left_semi")
    return _listed(listing.where_related(t.requests(spark, d), keys.select(F.col("c_custkey").alias("author")), "author"))


@query(f"WITH {t.PR} SELECT {_LIST} FROM pr WHERE repo IN (SELECT n_nationkey FROM nation WHERE lower(n_name) IN ('nation_3', 'nation_8'))")
def listing_by_repo(spark, d):
    named = t.scoped_requests(spark, d).join(t.read(spark, d, "nation").select(F.col("n_nationkey").alias("repo"), F.lower("n_name").alias("repo_key")), "repo")
    return _listed(listing.where_repo(named, ["NATION_3", "nation_8", "Nation_99"]))


@query(f"""WITH {t.PR}, rv AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT 'owner/nation_' || repo || '#' || pr_key AS pr_key, 'owner/nation_' || repo AS repo_key, pr_key AS number, 'pr ' || pr_key AS title,
CASE WHEN author % 7 = 0 THEN 'cust-' || author ELSE c_name END AS author, CASE WHEN author % 7 = 0 AND author % 2 = 0 THEN 'bot' WHEN author % 7 = 0 THEN 'user' WHEN c_mktsegment = 'MACHINERY' THEN 'bot' ELSE 'user' END AS author_type, CASE WHEN author % 2 = 0 THEN 'bot' ELSE 'user' END || ':cust-' || author AS author_key, state,
CAST(created AS VARCHAR) AS created_at, CAST(created + 1 AS VARCHAR) AS updated_at, CAST(CASE WHEN state = 'MERGED' THEN created + 1 END AS VARCHAR) AS merged_at, CAST(coalesce(q, 0) AS BIGINT) AS additions, 0 AS deletions, coalesce(n, 0) AS review_count FROM pr LEFT JOIN rv ON l_orderkey = pr_key""")
def listing_full(spark, d):
    """All fourteen fields; an author that the dimension lacks is named by the key."""
    k = F.col("author")
    key = F.concat(F.when(k % 2 == 0, "bot").otherwise("user"), F.lit(":cust-"), k)
    counts = t.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    repo = F.concat(F.lit("owner/nation_"), "repo")
    prs = t.scoped_requests(spark, d).select(F.col("pr_key").alias("number"), repo.alias("repo_key"), key.alias("author_key"), "state", F.col("created").alias("created_at"), F.date_add("created", 1).alias("updated_at"), F.when(F.col("state") == "MERGED", F.date_add("created", 1)).alias("merged_at")).join(counts, "number", "left")
    prs = prs.select(identity.pr_key(F.col("repo_key"), F.col("number")).alias("pr_key"), "repo_key", "number", F.concat(F.lit("pr "), "number").alias("title"), "author_key", "state", "created_at", "updated_at", "merged_at", F.coalesce(F.col("q").cast("long"), F.lit(0)).alias("additions"), F.lit(0).cast("int").alias("deletions"), F.coalesce("n", F.lit(0)).alias("review_count"))
    c = t.read(spark, d, "customer").filter("c_custkey % 7 <> 0")
    known = c.select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "bot").otherwise("user"), F.lit(":cust-"), "c_custkey").alias("entity_key"), F.col("c_name").alias("login"), F.when(F.col("c_mktsegment") == "MACHINERY", "bot").otherwise("user").alias("entity_type"))
    return dates_as_text(listing.with_authors(prs, known))


@query(f"WITH {t.PR}, {t.RV} SELECT count(DISTINCT pr.pr_key) AS n FROM pr JOIN rv USING (pr_key) WHERE reviewer IN (3, 4, 5) AND state = 'MERGED'")
def count_matching(spark, d):
    met = listing.where_in(t.reviews(spark, d), "reviewer", [3, 4, 5])
    return listing.count_rows(listing.where_related(listing.where_in(t.requests(spark, d), "state", ["MERGED"]), met, "pr_key"))


@query(f"WITH {t.PR} SELECT round(coalesce(sum(added), 0), 2) AS added, round(coalesce(sum(removed), 0), 2) AS removed FROM pr WHERE state = 'MERGED' AND created {CUR}")
def lines_changed(spark, d):
    return _rounded(listing.lines_changed(listing.during(listing.where_in(t.requests(spark, d), "state", ["MERGED"]), "created", Q2), "added", "removed"))


@query(f"WITH {t.PR} SELECT c_name || CASE WHEN c_mktsegment = 'MACHINERY' THEN ' [bot]' ELSE '' END AS \"group\", count(*) AS n FROM pr GROUP BY ALL")
def count_by_author(spark, d):
    own = t.requests(spark, d).withColumnRenamed("author", "entity_key")
    return listing.count_by(listing.author_label(own, t.entities(spark, d), "entity_key"), F.col("label"))


@query(f"WITH {t.PR} SELECT n_name AS \"group\", count(*) AS n FROM pr JOIN nation ON repo = n_nationkey GROUP BY ALL")
def count_by_repo(spark, d):
    names = t.read(spark, d, "nation").select(F.col("n_nationkey").alias("repo"), "n_name")
    counts = listing.count_by(t.scoped_requests(spark, d), F.col("repo"))
    return counts.join(names, F.col("group") == F.col("repo")).select(F.col("n_name").alias("group"), "n")


@query(f"WITH {t.PR} SELECT state AS \"group\", count(*) AS n FROM pr GROUP BY ALL")
def count_by_state(spark, d):
    return listing.count_by(t.requests(spark, d), F.col("state"), order=True)


@query(f"WITH {t.PR} SELECT strftime(created, '%Y-%m') AS \"group\", count(*) AS n FROM pr GROUP BY ALL")
def count_by_month(spark, d):
    return listing.count_by(t.requests(spark, d), F.date_format("created", "yyyy-MM"), order=True)


# --- measures


@query(f"WITH {t.PR} SELECT state, count(*) FILTER (created {CUR}) AS n_current, count(*) FILTER (created {PREV}) AS n_previous, round(coalesce(sum(lines) FILTER (created {CUR}), 0), 2) AS lines_current, round(coalesce(sum(lines) FILTER (created {PREV}), 0), 2) AS lines_previous FROM pr WHERE created {EITHER} GROUP BY state")
def two_window_measure(spark, d):
    out = metrics.split_sums(t.requests(spark, d), ["state"], "created", {"n": (F.lit(True), None), "lines": (F.lit(True), F.col("lines"))}, FULL)
    return out.select("state", "n_current", "n_previous", F.round("lines_current", 2).alias("lines_current"), F.round("lines_previous", 2).alias("lines_previous"))


@query(f"WITH {t.PR}, x AS (SELECT count(*) FILTER (created BETWEEN DATE '1997-04-01' AND DATE '1997-05-15') AS c, count(*) FILTER (created BETWEEN DATE '1997-01-01' AND DATE '1997-02-14') AS p FROM pr) SELECT c AS current, p AS previous, c - p AS delta, round((c - p) / p * 100, 2) AS delta_percent FROM x")
def two_window_partial(spark, d):
    both = metrics.split_sums(t.requests(spark, d), [], "created", {"n": (F.lit(True), None)}, PART).select(F.col("n_current").alias("current"), F.col("n_previous").alias("previous"))
    return metrics.with_deltas(both).withColumn("delta_percent", F.round("delta_percent", 2))


@query(f"WITH {t.PR} SELECT repo, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS ratio FROM lineitem JOIN pr ON l_orderkey = pr_key WHERE created {CUR} GROUP BY repo")
def failure_ratio(spark, d):
    return metrics.failure_ratio(t.check_runs(spark, d), t.scoped_requests(spark, d), ["repo"], FULL).withColumn("ratio", F.round("ratio", 6))


@query("SELECT n_name AS \"group\", count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY n_name")
def group_sizes(spark, d):
    groups = t.read(spark, d, "nation").select(F.col("n_name").alias("group"), "n_nationkey")
    members = t.read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").join(groups, F.col("c_nationkey") == F.col("n_nationkey")).select("group", F.col("c_custkey").alias("member"))
    return metrics.group_sizes(groups.select("group"), members)


def _card_sql(ctes: str, parts: list[tuple[str, str, str, str, str]], by: str, now: str = "") -> str:
    """parts: measure, source with condition, key, date, value. now: SQL of measures without a previous window."""
    one = " UNION ALL ".join(f"SELECT {key} AS {by}, '{m}' AS measure, CAST(coalesce(sum({v}) FILTER ({dcol} {CUR}), 0) AS DOUBLE) AS current, CAST(coalesce(sum({v}) FILTER ({dcol} {PREV}), 0) AS DOUBLE) AS previous FROM {src} GROUP BY 1" for m, src, key, dcol, v in parts)
    return f"WITH {ctes}, u AS ({one}) SELECT {by}, measure, round(current, 2) AS current, round(previous, 2) AS previous, round(current - previous, 2) AS delta, CASE WHEN previous <> 0 THEN round((current - previous) / previous * 100, 2) END AS delta_percent FROM u WHERE current <> 0 OR previous <> 0{now}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 2).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


_MET = "met AS (SELECT reviewer, author, submitted, repo FROM rv JOIN pr USING (pr_key))"


@query(_card_sql(f"{t.PR}, {t.RV}, {_MET}", [("opened", "pr", "author", "created", "1"), ("merged", "pr WHERE state = 'MERGED'", "author", "created", "1"), ("added", "pr", "author", "created", "added"), ("removed", "pr", "author", "created", "removed"), ("reviews_given", "met WHERE reviewer <> author", "reviewer", "submitted", "1"), ("reviews_received", "met WHERE reviewer <> author", "author", "submitted", "1"), ("comments_given", "met WHERE reviewer <> author", "reviewer", "submitted", "1")], "author"))
def scorecard_author(spark, d):
    return _rounded(metrics.scorecard_authors(t.requests(spark, d), t.activity(spark, d), FULL))


@query(_card_sql(f"{t.PR}, {t.RV}, {_MET}", [("opened", "pr", "repo", "created", "1"), ("merged", "pr WHERE state = 'MERGED'", "repo", "created", "1"), ("reviews", "met", "repo", "submitted", "1"), ("comments", "met", "repo", "submitted", "1")], "repo", f" UNION ALL SELECT repo, 'failure_rate', round(count(*) FILTER (l_returnflag = 'R') / count(*), 2), NULL, NULL, NULL FROM lineitem JOIN pr ON l_orderkey = pr_key WHERE created {CUR} GROUP BY repo"))
def scorecard_repo(spark, d):
    return _rounded(metrics.scorecard_scopes(t.scoped_requests(spark, d), t.activity(spark, d), FULL, "repo", t.check_runs(spark, d)))


@query(_card_sql(f"{t.PR}, {t.RV}, m AS (SELECT c_custkey AS member, c_mktsegment AS grp FROM customer), met AS (SELECT grp, author, submitted FROM rv JOIN pr USING (pr_key) JOIN m ON member = reviewer)", [("opened", "pr", "c_mktsegment", "created", "1"), ("merged", "pr WHERE state = 'MERGED'", "c_mktsegment", "created", "1"), ("given_outside", "met JOIN m AS a ON a.member = author WHERE a.grp <> met.grp", "met.grp", "submitted", "1")], '"group"', " UNION ALL SELECT grp, 'members', count(DISTINCT member), NULL, NULL, NULL FROM m GROUP BY grp"))
def scorecard_author_group(spark, d):
    roster = t.read(spark, d, "customer").select(F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("member"))
    return _rounded(metrics.scorecard_members(t.requests(spark, d), t.reviews(spark, d), roster, FULL))


@query(_card_sql(f"{t.PR}, {t.RV}, met AS (SELECT r_name AS owner, submitted FROM rv JOIN pr USING (pr_key) JOIN nation ON n_nationkey = repo JOIN region ON r_regionkey = n_regionkey), p AS (SELECT pr.*, r_name AS owner FROM pr JOIN nation ON n_nationkey = repo JOIN region ON r_regionkey = n_regionkey)", [("opened", "p", "owner", "created", "1"), ("merged", "p WHERE state = 'MERGED'", "owner", "created", "1"), ("reviews", "met", "owner", "submitted", "1"), ("comments", "met", "owner", "submitted", "1")], "owner"))
def scorecard_repo_group(spark, d):
    owners = t.read(spark, d, "nation").join(t.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("repo"), F.col("r_name").alias("owner"))
    return _rounded(metrics.scorecard_scopes(t.scoped_requests(spark, d).join(owners, "repo"), metrics.activity(t.reviews(spark, d), t.comments(spark, d)), FULL, "owner"))


# --- scorecards from stored forms of the facts


def _bucketed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Requests and activity as tables in buckets of the request."""
    name = lambda kind: f"{kind}_{uuid.uuid4().hex}"
    put = lambda kind, df: sinks.write_bucketed(df, name(kind), t.shared_place(spark, kind), "pr_key", 16)
    return put("requests", t.requests(spark, d)), put("activity", t.activity(spark, d))


@query(SQL["scorecard_author"])
def scorecard_author_bucketed(spark, d):
    """From facts in buckets of their request: the join of activity with requests needs no exchange."""
    return _rounded(metrics.scorecard_authors(*_bucketed(spark, d), FULL))


def _daily(spark, d, days, name: str) -> str:
    """Daily sums after two loads: a part of the requests with what stands in them, then the rest, which changes months that
    are there already."""
    root, sparse = t.shared_place(spark, "daily"), name == "authors"
    prs, acts = t.scoped_requests(spark, d), t.activity(spark, d)
    first = F.col("pr_key") % 3 != 0
    months = lambda test: daily.months_of(prs.filter(test).select(F.col("created").alias("day")), acts.filter(test).select("day"))
    daily.refresh(days(prs.filter(first), acts.filter(first)), months(first), root, name, "load", 0, sparse)
    changed = months(~first)
    for _ in range(2):  # the load that comes again changes nothing
        daily.refresh(days(prs, acts), changed, root, name, "load", 1, sparse)
    return root


@query(SQL["scorecard_author"])
def daily_scorecard_author(spark, d):
    sums = daily.read(spark, _daily(spark, d, daily.author_days, "authors"), "authors", FULL)
    return _rounded(daily.scorecard(sums, FULL, "author").withColumn("author", F.col("author").cast("long")))


@query(_card_sql(f"{t.PR}, {t.RV}, {_MET}", [("opened", "pr", "repo", "created", "1"), ("merged", "pr WHERE state = 'MERGED'", "repo", "created", "1"), ("reviews", "met", "repo", "submitted", "1"), ("comments", "met", "repo", "submitted", "1")], "repo"))
def daily_scorecard_repo(spark, d):
    sums = daily.read(spark, _daily(spark, d, daily.scope_days, "repos"), "repos", FULL)
    return _rounded(daily.scorecard(sums, FULL, "repo").withColumn("repo", F.col("repo").cast("long")))


@query(f"WITH {t.PR}, c AS (SELECT author AS entity, count(*) FILTER (created {CUR}) AS current, count(*) FILTER (created {PREV}) AS previous FROM pr WHERE created {EITHER} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY current DESC, CAST(entity AS VARCHAR)) AS rc, row_number() OVER (ORDER BY previous DESC, CAST(entity AS VARCHAR)) AS rp FROM c) SELECT CAST(entity AS VARCHAR) AS entity, current, previous, current - previous AS delta, CAST(rc AS INTEGER) AS rank_current, CASE WHEN previous > 0 THEN CAST(rp AS VARCHAR) END AS rank_previous FROM r WHERE current > 0 ORDER BY rc LIMIT 10")
def daily_board(spark, d):
    """A board from daily sums; ties by the entity's name."""
    sums = daily.read(spark, _daily(spark, d, daily.author_days, "authors"), "authors", FULL)
    return _shown(boards.top_board(daily.board_counts(sums, "opened", FULL), 10))


# --- boards


def _board_sql(src: str, entity: str, dcol: str, top: int, ctes: str, scope: str = "") -> str:
    part, scoped = f"PARTITION BY {scope} " if scope else "", f"{scope}, " if scope else ""
    return f"WITH {ctes}, c AS (SELECT {scoped}{entity} AS entity, count(*) FILTER ({dcol} {CUR}) AS current, count(*) FILTER ({dcol} {PREV}) AS previous FROM {src} {'AND' if 'WHERE' in src else 'WHERE'} {dcol} {EITHER} GROUP BY ALL), r AS (SELECT *, row_number() OVER ({part}ORDER BY current DESC, entity) AS rc, row_number() OVER ({part}ORDER BY previous DESC, entity) AS rp FROM c) SELECT {scoped}entity, current, previous, current - previous AS delta, CAST(rc AS INTEGER) AS rank_current, CASE WHEN previous > 0 THEN CAST(rp AS VARCHAR) END AS rank_previous FROM r WHERE rc <= {top} AND current > 0"


def _shown(board: DataFrame) -> DataFrame:
    """A rank that can be missing is shown as text."""
    return board.withColumn("rank_previous", F.col("rank_previous").cast("string"))


@query(_board_sql("pr", "author", "created", 10, t.PR))
def board_authors(spark, d):
    return _shown(boards.top_board(boards.board_counts(t.requests(spark, d), "author", "created", FULL), 10))


@query(_board_sql("pr WHERE state = 'MERGED'", "author", "created", 10, t.PR))
def board_merged(spark, d):
    return _shown(boards.top_board(boards.board_counts(listing.where_in(t.requests(spark, d), "state", ["MERGED"]), "author", "created", FULL), 10))


@query(_board_sql("pr", "repo", "created", 5, t.PR))
def board_repos(spark, d):
    return _shown(boards.top_board(boards.board_counts(t.scoped_requests(spark, d), "repo", "created", FULL), 5))


def _met(spark, d) -> DataFrame:
    return t.reviews(spark, d).join(t.scoped_requests(spark, d).select("pr_key", "author", "repo"), "pr_key")


@query(_board_sql("met WHERE reviewer <> author", "reviewer", "submitted", 10, f"{t.PR}, {t.RV}, {_MET}"))
def board_reviewers(spark, d):
    return _shown(boards.top_board(boards.board_counts(_met(spark, d).filter("reviewer <> author"), "reviewer", "submitted", FULL), 10))


@query(_board_sql("met WHERE reviewer <> author", "author", "submitted", 10, f"{t.PR}, {t.RV}, {_MET}"))
def board_reviewed_authors(spark, d):
    return _shown(boards.top_board(boards.board_counts(_met(spark, d).filter("reviewer <> author"), "author", "submitted", FULL), 10))


@query(_board_sql("met", "reviewer", "submitted", 3, f"{t.PR}, {t.RV}, {_MET}", "repo"))
def board_commenters(spark, d):
    said = t.comments(spark, d).join(t.scoped_requests(spark, d).select("pr_key", "repo"), "pr_key")
    return _shown(boards.scoped_boards(boards.board_counts(said, "reviewer", "submitted", FULL, ["repo"]), ["repo"], 3))


@query(_board_sql("pr", "author", "created", 5, t.PR, "repo"))
def board_per_repo(spark, d):
    return _shown(boards.scoped_boards(boards.board_counts(t.scoped_requests(spark, d), "author", "created", FULL, ["repo"]), ["repo"], 5))


def _scoped_board(counted: DataFrame, entity: str, date: str, scope: str, top: int) -> DataFrame:
    return _shown(boards.scoped_boards(boards.board_counts(counted, entity, date, FULL, [scope]), [scope], top))


@query(_board_sql("pr", "repo", "created", 3, t.PR, "author"))
def board_repos_of_author(spark, d):
    return _scoped_board(t.scoped_requests(spark, d), "repo", "created", "author", 3)


@query(_board_sql("met WHERE reviewer <> author", "reviewer", "submitted", 5, f"{t.PR}, {t.RV}, {_MET}", "author"))
def board_reviewers_of_author(spark, d):
    return _scoped_board(_met(spark, d).filter("reviewer <> author"), "reviewer", "submitted", "author", 5)


@query(_board_sql("met WHERE reviewer <> author", "author", "submitted", 5, f"{t.PR}, {t.RV}, {_MET}", "reviewer"))
def board_authors_of_reviewer(spark, d):
    return _scoped_board(_met(spark, d).filter("reviewer <> author"), "author", "submitted", "reviewer", 5)


@query(_board_sql("pr WHERE state = 'MERGED'", "author", "created", 5, t.PR, "repo"))
def board_mergers_of_repo(spark, d):
    return _scoped_board(listing.where_in(t.scoped_requests(spark, d), "state", ["MERGED"]), "author", "created", "repo", 5)


@query(_board_sql("met", "reviewer", "submitted", 5, f"{t.PR}, {t.RV}, {_MET}", "repo"))
def board_reviewers_of_repo(spark, d):
    return _scoped_board(_met(spark, d), "reviewer", "submitted", "repo", 5)


@query(f"WITH b AS ({_board_sql('met', 'reviewer', 'submitted', 20, f'{t.PR}, {t.RV}, {_MET}')}) SELECT entity, coalesce(s_name, n_name, CAST(entity AS VARCHAR)) AS entity_name, current, rank_current FROM b LEFT JOIN supplier ON s_suppkey = entity AND s_suppkey % 3 <> 0 LEFT JOIN nation ON n_nationkey = entity AND n_nationkey % 2 = 0")
def board_with_names(spark, d):
    board = boards.top_board(boards.board_counts(_met(spark, d), "reviewer", "submitted", FULL), 20)
    people = t.read(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"))
    places = t.read(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("entity"), F.col("n_name").alias("name"))
    return boards.with_names(board, people, places).select("entity", "entity_name", "current", "rank_current")


@query(f"WITH b AS ({_board_sql('pr', 'author', 'created', 20, t.PR)}) SELECT entity, '#' || rank_current || ' ' || c_name || ' — ' || current || ' (' || CASE WHEN delta >= 0 THEN '+' ELSE '' END || delta || ')' || CASE WHEN rank_previous IS NULL THEN ' [new]' WHEN rank_previous <> CAST(rank_current AS VARCHAR) THEN ' [was #' || rank_previous || ']' ELSE '' END AS line FROM b JOIN customer ON c_custkey = entity")
def rank_movement(spark, d):
    board = boards.top_board(boards.board_counts(t.requests(spark, d), "author", "created", FULL), 20)
    names = t.read(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    named = boards.with_names(board, names)
    return named.select("entity", deltas.render_row(F.col("rank_current"), F.col("entity_name"), F.col("current"), F.col("previous"), F.col("rank_previous")).alias("line"))


# --- calendar

_CAL = """CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day_of_month, CAST(isodow(d) AS INTEGER) AS day_of_week, CAST(week(d) AS INTEGER) AS week_of_year,
CAST(date_diff('day', date_trunc('quarter', d), d) + 1 AS INTEGER) AS day_of_quarter, CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(date_diff('day', make_date(year(d), CASE WHEN month(d) <= 6 THEN 1 ELSE 7 END, 1), d) + 1 AS INTEGER) AS day_of_half,
CAST(date_diff('day', date_trunc('quarter', d), d) // 7 + 1 AS INTEGER) AS week_of_quarter, CAST((month(d) - 1) % 3 + 1 AS INTEGER) AS month_of_quarter, CAST((month(d) - 1) % 6 + 1 AS INTEGER) AS month_of_half, isodow(d) >= 6 AS is_weekend, strftime(d, '%G-W%V') AS week_key,
strftime(d, '%Y-%m') AS month_key, year(d) || '-Q' || quarter(d) AS quarter_key, CAST(year(d) AS VARCHAR) AS year_key, year(d) || '-H' || CASE WHEN month(d) <= 6 THEN 1 ELSE 2 END AS half_key"""


@query(f"WITH x AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d) SELECT CAST(d AS VARCHAR) AS date_key, {_CAL} FROM x")
def calendar_dimension(spark, d):
    span = t.requests(spark, d).agg(F.min("created").alias("lo"), F.max("created").alias("hi"))
    return dates_as_text(timekeys.with_calendar(span.select(F.explode(F.sequence("lo", "hi")).alias("date_key")), "date_key"))


@query(f"WITH x AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events) SELECT event_id, CAST(d AS VARCHAR) AS date_key, {_CAL} FROM x")
def calendar_of_events(spark, d):
    return dates_as_text(timekeys.with_calendar(t.read(spark, d, "events").select("event_id", F.to_date("ts").alias("date_key")), "date_key"))


@query("WITH x AS (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(h AS INTEGER) AS hour, n, printf('%02d:00', h) AS time_key, CAST((h + 11) % 12 + 1 AS INTEGER) AS hour_12, CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END AS am_pm, CASE WHEN h < 6 THEN 'Night' WHEN h < 12 THEN 'Morning' WHEN h < 18 THEN 'Afternoon' ELSE 'Evening' END AS time_bucket, h >= 9 AND h < 17 AS is_core_hours FROM x")
def hour_dimension(spark, d):
    hours = t.read(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.select("hour", "n", *[c.alias(k) for k, c in timekeys.hour_columns(F.col("hour")).items()])


@query(f"SELECT CAST(CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS DATE) AS VARCHAR) AS date_key, count(*) AS n FROM events GROUP BY ALL")
def local_day_activity(spark, d):
    return dates_as_text(t.read(spark, d, "events").groupBy(timekeys.local_date_key(F.col("ts"), ZONE).alias("date_key")).agg(F.count("*").alias("n")))


@query(f"SELECT strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%H:00') AS time_key, count(*) AS n FROM events GROUP BY ALL")
def local_hour_activity(spark, d):
    return t.read(spark, d, "events").groupBy(timekeys.local_time_key(F.col("ts"), ZONE).alias("time_key")).agg(F.count("*").alias("n"))


def _grain_sql(g: str) -> str:
    trunc, step = {"year": ("date_trunc('year', d)", "INTERVAL 1 YEAR"), "half": ("make_date(year(d), CASE WHEN month(d) <= 6 THEN 1 ELSE 7 END, 1)", "INTERVAL 6 MONTH"), "quarter": ("date_trunc('quarter', d)", "INTERVAL 3 MONTH"), "month": ("date_trunc('month', d)", "INTERVAL 1 MONTH"), "week": ("date_trunc('week', d)", "INTERVAL 7 DAY")}[g]
    day = lambda x: f"CAST(CAST({x} AS DATE) AS VARCHAR)"
    return f"SELECT DISTINCT '{g}' AS grain, {day(trunc)} AS start, {day(f'{trunc} + {step} - INTERVAL 1 DAY')} AS \"end\", {day(f'{trunc} - {step}')} AS prev_start, {day(f'{trunc} - INTERVAL 1 DAY')} AS prev_end FROM x"


@query("WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) " + " UNION ALL ".join(map(_grain_sql, ("year", "half", "quarter", "month", "week"))))
def period_ranges(spark, d):
    days = t.requests(spark, d).select("created").distinct()
    spans = F.array(*[F.struct(F.lit(g).alias("grain"), *[c.alias(n) for n, c in zip(("start", "end", "prev_start", "prev_end"), periods.period_range(F.col("created"), g), strict=True)]) for g in ("year", "half", "quarter", "month", "week")])
    return dates_as_text(days.select(F.explode(spans).alias("p")).select("p.*").distinct())


@query("WITH x AS (SELECT o_custkey AS author, min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) AS e FROM orders GROUP BY 1), m AS (SELECT *, CAST(unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS DATE) AS m FROM x) SELECT author, CAST(greatest(s, m) AS VARCHAR) AS win_start, CAST(least(e, last_day(m)) AS VARCHAR) AS win_end FROM m")
def month_windows(spark, d):
    spans = t.requests(spark, d).groupBy("author").agg(F.min("created").alias("s"), F.max("created").alias("e"))
    return dates_as_text(spans.select("author", F.explode(timekeys.month_windows(F.col("s"), F.col("e"))).alias("w")).select("author", F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end")))


@query("WITH k AS (SELECT DISTINCT unnest([strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%G-W%V'), year(o_orderdate) || '-Q' || quarter(o_orderdate)]) AS key FROM orders) SELECT key, CASE WHEN key LIKE '%Q%' THEN 'quarter' WHEN key LIKE '%W%' THEN 'week' WHEN length(key) = 4 THEN 'year' ELSE 'month' END AS grain FROM k")
def period_keys(spark, d):
    c = timekeys.calendar_columns(F.col("created"))
    keys = t.requests(spark, d).select(F.explode(F.array(c["year_key"], c["month_key"], c["week_key"], c["quarter_key"])).alias("key")).distinct()
    return keys.select("key", periods.grain_of_key(F.col("key")).alias("grain"))


# --- rendering, identity, payloads


@query(f"WITH {t.PR}, x AS (SELECT author, count(*) FILTER (created {CUR}) AS c, count(*) FILTER (created {PREV}) AS p FROM pr WHERE created {EITHER} GROUP BY 1) SELECT author, CASE WHEN c = p THEN c || ' (no change)' WHEN p = 0 THEN c || ' (' || printf('%+d', c - p) || ')' ELSE c || ' (' || printf('%+d', c - p) || ', ' || printf('%+d', CAST(CASE WHEN c > p THEN floor((c - p) / p * 100 + 0.5) ELSE -floor((p - c) / p * 100 + 0.5) END AS BIGINT)) || '%)' END AS text FROM x")
def delta_render(spark, d):
    both = metrics.split_sums(t.requests(spark, d), ["author"], "created", {"n": (F.lit(True), None)}, FULL)
    return both.select("author", deltas.render_delta(F.col("n_current"), F.col("n_previous")).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bot' ELSE 'user' END || ':' || lower(c_name) AS entity_key, lower(c_name) AS login, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bot' ELSE 'user' END AS namespace, c_name || CASE WHEN c_mktsegment = 'MACHINERY' THEN ' [bot]' ELSE '' END AS shown FROM customer")
def identity_display(spark, d):
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "Bot").otherwise("User")
    keyed = t.read(spark, d, "customer").select("c_custkey", "c_name", identity.entity_key(F.col("c_name"), kind).alias("entity_key"))
    k = F.col("entity_key")
    return keyed.select("c_custkey", "entity_key", identity.bare_login(k).alias("login"), identity.namespace(k).alias("namespace"), identity.display(F.col("c_name"), identity.namespace(k)).alias("shown"))


@query("""WITH e AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bot:' ELSE 'user:' END || lower(c_name) AS k, lower(c_name) AS login FROM customer UNION ALL SELECT 'user:' || lower(c_name), lower(c_name) FROM customer WHERE c_mktsegment = 'MACHINERY'),
a AS (SELECT c_name AS login FROM customer UNION ALL SELECT 'Bot:' || c_name FROM customer UNION ALL SELECT s_name FROM supplier)
SELECT a.login, coalesce(e.k, 'user:' || lower(a.login)) AS entity_key FROM a LEFT JOIN e ON e.login = lower(a.login) WHERE strpos(a.login, ':') = 0 UNION ALL SELECT login, lower(login) FROM a WHERE strpos(login, ':') > 0""")
def identity_keys(spark, d):
    c = t.read(spark, d, "customer")
    bot, low = F.col("c_mktsegment") == "MACHINERY", F.lower("c_name")
    known = c.select(F.concat(F.when(bot, "bot:").otherwise("user:"), low).alias("entity_key"), low.alias("login")).union(c.filter(bot).select(F.concat(F.lit("user:"), low), low))
    asked = c.select(F.col("c_name").alias("login")).union(c.select(F.concat(F.lit("Bot:"), "c_name"))).union(t.read(spark, d, "supplier").select("s_name"))
    return identity.resolve_logins(asked, known)


@query("SELECT o_orderkey, 'cust/' || o_custkey || '#' || o_orderkey AS pr_key, 'cust/' || o_custkey AS repo, o_orderkey AS number FROM orders")
def key_parts(spark, d):
    made = t.read(spark, d, "orders").select("o_orderkey", identity.pr_key(F.concat(F.lit("Cust/"), F.col("o_custkey")), F.col("o_orderkey")).alias("pr_key"))
    return made.select("o_orderkey", "pr_key", identity.key_repo(F.col("pr_key")).alias("repo"), identity.key_number(F.col("pr_key")).alias("number"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '[\"' || event_type || '\",\"' || json_extract_string(props, '$.k') || '\"]' AS words FROM events")
def json_payload(spark, d):
    e = t.read(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    words = F.to_json(F.array(F.col("event_type"), F.col("p.k").cast("string")))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.from_json(words, "array<string>")).alias("words"))


# --- coverage

_MERGED = f"{t.RANGES}, f AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY entity ORDER BY s) + 1 THEN 0 ELSE 1 END AS fresh FROM rg), i AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY s) AS island FROM f), mg AS (SELECT entity, min(s) AS s, max(s) AS e, CAST(sum(items) AS BIGINT) AS items FROM i GROUP BY entity, island)"


@query(f"WITH {_MERGED} SELECT entity, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS \"end\", items FROM mg")
def coverage_merged(spark, d):
    return dates_as_text(coverage.merge_ranges(t.loaded_ranges(spark, d)))


@query(f"WITH {_MERGED} SELECT entity, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS \"end\", items FROM (SELECT entity, s, least(e, DATE '2024-01-20') AS e, items FROM mg WHERE s <= DATE '2024-01-20')")
def coverage_recorded(spark, d):
    ranges = coverage.merge_ranges(t.loaded_ranges(spark, d))
    return dates_as_text(coverage.record_ranges(ranges.limit(0), ranges, F.lit(D(2024, 1, 20))))


@query(f"WITH {_MERGED}, g AS (SELECT entity, e + 1 AS a, least(coalesce(lead(s) OVER (PARTITION BY entity ORDER BY s) - 1, DATE '2024-01-31'), DATE '2024-01-31') AS b FROM mg) SELECT entity, CAST(a AS VARCHAR) AS gap_start, CAST(b AS VARCHAR) AS gap_end FROM g WHERE a <= b")
def coverage_gaps(spark, d):
    return dates_as_text(coverage.gaps(t.loaded_ranges(spark, d), F.lit(TARGET)))


@query("SELECT user_id AS entity, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS start, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS \"end\" FROM events GROUP BY 1")
def coverage_extent(spark, d):
    return dates_as_text(coverage.extent(t.loaded_ranges(spark, d)))


@query(f"WITH {_MERGED} SELECT entity, CAST(s AS VARCHAR) AS start, CAST(least(e, DATE '2024-01-12') AS VARCHAR) AS \"end\", items FROM mg WHERE s <= DATE '2024-01-12'")
def coverage_read(spark, d):
    return dates_as_text(coverage.recorded_until(t.loaded_ranges(spark, d), F.lit(D(2024, 1, 12))))


@query(f"WITH {t.RANGES}, c AS (SELECT entity, s, items FROM rg WHERE entity % 3 <> 0 OR s <= DATE '2024-01-09'), n AS (SELECT entity, s, items FROM rg WHERE entity % 3 = 0 AND s > DATE '2024-01-05' AND s <= DATE '2024-01-20'), u AS (SELECT * FROM c UNION ALL SELECT * FROM n), f AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY entity ORDER BY s) + 1 THEN 0 ELSE 1 END AS fresh FROM u), i AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY s, fresh DESC ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT entity, CAST(min(s) AS VARCHAR) AS start, CAST(max(s) AS VARCHAR) AS \"end\", CAST(sum(items) AS BIGINT) AS items FROM i GROUP BY entity, island")
def coverage_recorded_again(spark, d):
    """New ranges over older ones that they overlap; items of days loaded twice count twice."""
    days = t.loaded_ranges(spark, d)
    old = days.filter("entity % 3 <> 0 OR start <= date'2024-01-09'")
    new = days.filter("entity % 3 = 0 AND start > date'2024-01-05'")
    return dates_as_text(coverage.record_ranges(old, new, F.lit(D(2024, 1, 20))))


@query("SELECT user_id AS entity, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS start, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS \"end\" FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-10' GROUP BY 1")
def coverage_extent_clamped(spark, d):
    return dates_as_text(coverage.extent(t.loaded_ranges(spark, d), F.lit(D(2024, 1, 10))))


@query(f"SELECT event_type, CAST(max(CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS DATE)) - 1 AS VARCHAR) AS day FROM events GROUP BY 1")
def last_complete_days(spark, d):
    now = t.read(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("now"))
    return dates_as_text(now.select("event_type", timekeys.last_complete_day(F.col("now"), ZONE).alias("day")))


@query("WITH o AS (SELECT event_type, user_id % 4 AS source, max(ts) AS was FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 4 <> 1 GROUP BY ALL), n AS (SELECT event_type, user_id % 4 AS source, max(ts) AS newest FROM events WHERE event_id % 2 = 0 AND user_id % 4 <> 2 GROUP BY ALL) SELECT event_type, CAST(coalesce(o.source, n.source) AS BIGINT) AS source, strftime(greatest(was, newest), '%Y-%m-%d %H:%M:%S') AS cursor FROM o FULL JOIN n USING (event_type, source)".replace("coalesce(o.source, n.source)", "source"))
def high_water_marks_by_stream(spark, d):
    """A cursor for each kind of stream and source."""
    e = t.read(spark, d, "events").withColumn("source", F.col("user_id") % 4)
    old = e.filter("ts < timestamp_ntz '2024-01-15 00:00:00' AND source <> 1").groupBy("event_type", "source").agg(F.max("ts").alias("cursor"))
    new = coverage.advance_cursors(old, e.filter("event_id % 2 = 0 AND source <> 2"), e.limit(0), ["event_type", "source"], "ts")
    return new.select("event_type", "source", F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"))


def _cursors(spark, d) -> DataFrame:
    return t.read(spark, d, "events").filter("ts < timestamp_ntz '2024-01-15 00:00:00'").groupBy("event_type").agg(F.max("ts").alias("cursor"))


@query("WITH o AS (SELECT event_type, max(ts) AS was FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), n AS (SELECT event_type, max(ts) AS newest FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, min(ts) AS bad FROM events WHERE event_id % 101 = 1 AND ts > TIMESTAMP '2024-01-10' AND event_type <> 'click' GROUP BY 1) SELECT event_type, strftime(greatest(was, CASE WHEN newest IS NOT NULL THEN least(bad, newest) END), '%Y-%m-%d %H:%M:%S') AS cursor FROM o JOIN n USING (event_type) LEFT JOIN b USING (event_type)")
def high_water_mark(spark, d):
    e = t.read(spark, d, "events")
    bad = e.filter("event_id % 101 = 1 AND ts > timestamp_ntz '2024-01-10 00:00:00' AND event_type <> 'click'")
    return coverage.advance_cursors(_cursors(spark, d), e.filter("event_id % 2 = 0"), bad, ["event_type"], "ts").select("event_type", F.date_format("cursor", "yyyy-MM-dd HH:mm:ss").alias("cursor"))


@query("WITH o AS (SELECT event_type, max(ts) AS cursor FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) SELECT event_id, event_type FROM events JOIN o USING (event_type) WHERE ts >= cursor")
def incremental_cut(spark, d):
    return coverage.since_cursor(t.read(spark, d, "events"), _cursors(spark, d), ["event_type"], "ts").select("event_id", "event_type")


@query("WITH c AS (SELECT c_custkey AS entity, s, e FROM customer LEFT JOIN (SELECT user_id, min(CAST(ts AS DATE)) AS s, max(CAST(ts AS DATE)) AS e FROM events GROUP BY 1) ON user_id = c_custkey) SELECT entity, CAST(CASE WHEN e IS NULL THEN DATE '2024-02-10' - 89 ELSE least(e + 1, DATE '2024-02-10') END AS VARCHAR) AS load_start, '2024-02-10' AS load_end FROM c")
def load_window(spark, d):
    seen = coverage.extent(t.loaded_ranges(spark, d)).select("entity", F.col("start").alias("covered_start"), F.col("end").alias("covered_end"))
    sources = t.read(spark, d, "customer").select(F.col("c_custkey").alias("entity")).join(seen, "entity", "left")
    return dates_as_text(coverage.load_window(sources, F.lit(D(2024, 2, 10)), F.lit(None).cast("int")).select("entity", "load_start", "load_end"))


@query("WITH c AS (SELECT c_custkey AS entity, e FROM customer LEFT JOIN (SELECT user_id, max(CAST(ts AS DATE)) AS e FROM events GROUP BY 1) ON user_id = c_custkey) SELECT entity, CAST(CASE WHEN e IS NULL THEN DATE '2024-02-10' - (entity % 30) ELSE least(DATE '2024-02-10' - (entity % 30), e + 1) END AS VARCHAR) AS load_start, '2024-02-10' AS load_end FROM (SELECT CAST(entity AS INTEGER) AS entity, e FROM c)")
def load_window_days_back(spark, d):
    seen = coverage.extent(t.loaded_ranges(spark, d)).select("entity", F.col("start").alias("covered_start"), F.col("end").alias("covered_end"))
    sources = t.read(spark, d, "customer").select(F.col("c_custkey").alias("entity")).join(seen, "entity", "left")
    back = (F.col("entity") % 30 + 1).cast("int")
    return dates_as_text(coverage.load_window(sources, F.lit(D(2024, 2, 10)), back).select(F.col("entity").cast("int").alias("entity"), "load_start", "load_end"))


@query("""WITH RECURSIVE n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS items FROM orders GROUP BY 1),
w AS (SELECT greatest(m, DATE '1996-01-10') AS s, least(last_day(m), DATE '1996-12-20') AS e, 0 AS depth FROM (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-12-20', INTERVAL 1 MONTH)) AS DATE) AS m)
UNION ALL SELECT CASE k WHEN 0 THEN s ELSE s + CAST((e - s) // 2 AS INTEGER) + 1 END, CASE k WHEN 0 THEN s + CAST((e - s) // 2 AS INTEGER) ELSE e END, depth + 1 FROM w, (VALUES (0), (1)) AS h(k) WHERE depth < 8 AND s < e AND (SELECT sum(items) FROM n WHERE day BETWEEN s AND e) > (SELECT count(*) // 400 FROM orders)),
c AS (SELECT s, e, depth, CAST(coalesce((SELECT sum(items) FROM n WHERE day BETWEEN s AND e), 0) AS BIGINT) AS items FROM w), cap AS (SELECT count(*) // 400 AS cap FROM orders)
SELECT CAST(s AS VARCHAR) AS win_start, CAST(e AS VARCHAR) AS win_end, items, items > cap AS unsplittable FROM c, cap WHERE items <= cap OR s = e OR depth = 8""")
def capped_windows(spark, d):
    daily = t.requests(spark, d).groupBy(F.col("created").alias("day")).agg(F.count("*").alias("items"))
    cap = t.requests(spark, d).count() // 400
    return dates_as_text(coverage.capped_windows(daily, F.lit(D(1996, 1, 10)), F.lit(D(1996, 12, 20)), cap))


@query("SELECT kind, identifier, CASE WHEN NOT enabled THEN 'disabled' WHEN kind = 'repo' THEN 'repos' WHEN kind = 'user' THEN 'users' ELSE 'unsupported' END AS route FROM (SELECT 'repo' AS kind, n_name AS identifier, n_nationkey % 5 <> 0 AS enabled FROM nation UNION ALL SELECT 'user', c_name, c_acctbal >= 0 FROM customer UNION ALL SELECT 'org', r_name, TRUE FROM region)")
def source_routing(spark, d):
    n = t.read(spark, d, "nation").select(F.lit("repo").alias("kind"), F.col("n_name").alias("identifier"), (F.col("n_nationkey") % 5 != 0).alias("enabled"))
    c = t.read(spark, d, "customer").select(F.lit("user").alias("kind"), F.col("c_name").alias("identifier"), (F.col("c_acctbal") >= 0).alias("enabled"))
    r = t.read(spark, d, "region").select(F.lit("org").alias("kind"), F.col("r_name").alias("identifier"), F.lit(True).alias("enabled"))
    return coverage.route_sources(n.unionByName(c).unionByName(r)).orderBy("kind", "identifier").select("kind", "identifier", "route")


# --- merges

_OLD = "SELECT o_orderkey AS k, o_orderstatus AS state, o_orderpriority AS name, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey AS k, 'X' AS state, 'renamed' AS name, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE -o_totalprice END AS price FROM orders WHERE o_orderkey % 2 = 0"


def _batches(spark, d) -> tuple[DataFrame, DataFrame]:
    o = t.read(spark, d, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    old = o.filter(k % 3 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("name"), F.when(k % 5 != 0, price).alias("price"))
    new = o.filter(k % 2 == 0).select(k.alias("k"), F.lit("X").alias("state"), F.lit("renamed").alias("name"), F.when(k % 7 != 0, -price).alias("price"))
    return old, new


def _merge_sql(state: str, name: str, price: str, how: str = "FULL") -> str:
    return f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.k, n.k) AS k, {state} AS state, {name} AS name, {price} AS price FROM o {how} JOIN n ON o.k = n.k"


def _r(c: str) -> str:
    return f"CASE WHEN n.k IS NOT NULL THEN n.{c} ELSE o.{c} END"


def _k(c: str) -> str:
    return f"CASE WHEN o.k IS NOT NULL THEN o.{c} ELSE n.{c} END"


@query(_merge_sql(_r("state"), _r("name"), _r("price")))
def merge_replace(spark, d):
    return merge.merge(*_batches(spark, d), ["k"], ["state", "name", "price"])


@query(_merge_sql(_r("state"), _k("name"), _k("price")))
def merge_keep(spark, d):
    return merge.merge(*_batches(spark, d), ["k"], ["state"])


@query(_merge_sql(_r("state"), _k("name"), "coalesce(n.price, o.price)"))
def merge_coalesce(spark, d):
    return merge.merge(*_batches(spark, d), ["k"], ["state"], ["price"])


@query(_merge_sql(_r("state"), "o.name", "coalesce(n.price, o.price)", "LEFT"))
def merge_update_only(spark, d):
    return merge.update_only(*_batches(spark, d), ["k"], ["state"], ["price"])


@query("WITH b AS (SELECT l_orderkey AS k, max(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT k, s, q FROM b")
def merge_newest(spark, d):
    lines = t.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    best_q = merge.newest_per_key(lines, ["k"], [F.desc("q"), F.col("n")]).select("k", "q")
    return merge.merge(merge.newest_per_key(lines, ["k"], [F.desc("s"), F.col("n")]).select("k", "s", F.lit(None).cast("double").alias("q")), best_q.withColumn("s", F.lit(None).cast("long")), ["k"], ["q"])


@query("WITH old AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS label FROM lineitem), par AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0), new AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS label FROM lineitem WHERE l_orderkey % 4 = 0) SELECT k, label FROM old WHERE k NOT IN (SELECT k FROM par) UNION SELECT k, label FROM new")
def bridge_replace(spark, d):
    line = t.read(spark, d, "lineitem")
    old = line.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("label")).distinct()
    new = line.filter("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("label"))
    return merge.replace_links(old, new, t.read(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("k")), "k")


@query("SELECT DISTINCT c_custkey AS member, c_mktsegment AS \"group\" FROM customer WHERE c_custkey % 2 = 0 UNION SELECT DISTINCT o_custkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def roster_load(spark, d):
    c = t.read(spark, d, "customer").select(F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("group"))
    new = t.read(spark, d, "orders").select(F.col("o_custkey").alias("member")).join(c, "member")
    return merge.insert_or_ignore(c.filter("member % 2 = 0"), new, ["member", "group"])


@query("SELECT DISTINCT c_mktsegment AS \"group\", lower(c_name) AS member FROM customer UNION SELECT DISTINCT 'repos', lower(n_name) FROM nation")
def roster_normalised(spark, d):
    """Users come as logins in any case, with or without a type, with blanks and twice; repositories in any case."""
    c = t.read(spark, d, "customer")
    users = c.select(F.col("c_mktsegment").alias("group"), F.concat(F.lit(" User:"), F.upper("c_name")).alias("member")).unionByName(c.select(F.col("c_mktsegment").alias("group"), F.concat("c_name", F.lit(" ")).alias("member")))
    repos = t.read(spark, d, "nation").select(F.lit("repos").alias("group"), F.explode(F.array(F.upper("n_name"), F.lower("n_name"), F.lit(" "))).alias("member"))
    return merge.normal_members(users, "user").unionByName(merge.normal_members(repos, "repo"))


def _summaries(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = t.read(spark, d, "orders")
    key = F.concat(F.lit("cust/"), F.col("o_custkey"), F.lit("#"), F.col("o_orderkey"))
    base = o.select(key.alias("pr_key"), F.concat(F.lit("cust/"), F.col("o_custkey")).alias("repo_key"), F.col("o_orderkey").alias("number"), F.concat(F.lit("user:"), F.col("o_custkey")).alias("author_key"), F.to_date("o_orderdate").alias("updated_at"))
    prs = base.filter("number % 10 <> 0")
    old = base.filter("number % 3 = 0").select("pr_key", F.lit(None).cast("string").alias("repo_key"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("author_key"), F.date_sub("updated_at", 1).alias("source_updated_at"), F.lit("old").alias("headline"), F.lit(True).alias("is_stale"), F.col("updated_at").alias("created_at"))
    new = base.filter("number % 2 = 0").select("pr_key", F.lit("new").alias("headline"), F.date_add("updated_at", 5).alias("created_at"))
    return old, new, prs


_SUMS = "o AS (SELECT 'cust/' || o_custkey || '#' || o_orderkey AS pr_key, 'cust/' || o_custkey AS repo, o_orderkey AS n, 'user:' || o_custkey AS a, CAST(o_orderdate AS DATE) AS u FROM orders)"


@query(f"WITH {_SUMS} SELECT pr_key, CASE WHEN n % 2 = 0 THEN repo END AS repo_key, CAST(CASE WHEN n % 2 = 0 THEN n END AS VARCHAR) AS number, CASE WHEN n % 2 = 0 AND n % 10 <> 0 THEN a END AS author_key, CAST(CASE WHEN n % 2 <> 0 THEN u - 1 WHEN n % 10 <> 0 THEN u END AS VARCHAR) AS source_updated_at, CASE WHEN n % 2 = 0 THEN 'new' ELSE 'old' END AS headline, n % 2 <> 0 AS is_stale, CAST(CASE WHEN n % 3 = 0 THEN u ELSE u + 5 END AS VARCHAR) AS created_at FROM o WHERE n % 2 = 0 OR n % 3 = 0")
def summary_merge(spark, d):
    return dates_as_text(merge.merge_summaries(*_summaries(spark, d))).withColumn("number", F.col("number").cast("string"))


@query(f"WITH {_SUMS} SELECT pr_key FROM o WHERE n % 10 <> 0 AND n % 3 <> 0")
def summary_missing(spark, d):
    old, _, prs = _summaries(spark, d)
    return merge.without_summary(prs, old).select("pr_key")


@query(f"WITH {_SUMS} SELECT pr_key FROM o WHERE n % 10 <> 0 AND n % 3 = 0")
def summary_stale(spark, d):
    old, _, prs = _summaries(spark, d)
    return merge.stale_summaries(old, prs).select("pr_key")


# --- search

_TERM = "ationing"


def _search_sql(table: str, key: str, text: str | tuple[str, ...], q: str, kind: str, more: str = "") -> str:
    """Counts occurrences by removing them: right for a literal that cannot overlap itself. more: columns to keep."""
    fields = (text,) if isinstance(text, str) else text
    tf = " + ".join(f"(length(lower(coalesce({f}, ''))) - length(replace(lower(coalesce({f}, '')), '{q}', ''))) / {len(q)}" for f in fields)
    size = " + ".join(f"greatest(length(coalesce({f}, '')) - 2, 0)" for f in fields)
    return f"""h AS (SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS key, {tf} AS tf, {size} AS len{more} FROM {table}),
s AS (SELECT *, count(*) OVER () AS n, avg(len) OVER () AS al, count(*) FILTER (tf > 0) OVER () AS df FROM h),
k AS (SELECT * EXCLUDE (tf, len, n, al, df), round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al)), 6) AS rank FROM s WHERE tf > 0)"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select("kind", "key", F.round("rank", 6).alias("rank"))


def _corpus(spark, d, table: str, key: str, text: str) -> DataFrame:
    return t.read(spark, d, table).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))


@query(f"WITH {_search_sql('documents', 'doc_id', 'text', _TERM, 'document')} SELECT * FROM k")
def search_documents(spark, d):
    return _hits(search.search_corpus(_corpus(spark, d, "documents", "doc_id", "text"), ["text"], _TERM.upper(), "document", None))


@query(f"WITH {_search_sql('pages', 'page_id', 'html', 'tionhe', 'page')} SELECT * FROM k")
def search_pages(spark, d):
    return _hits(search.search_corpus(_corpus(spark, d, "pages", "page_id", "html"), ["text"], "tionhe", "page", None))


@query(f"WITH {_search_sql('conversations', chr(39) + chr(39) + ' || conv_id || chr(35) || turn', 'text', 'tion ', 'turn')} SELECT * FROM k")
def search_conversations(spark, d):
    turns = t.read(spark, d, "conversations").select(F.concat(F.col("conv_id"), F.lit("#"), F.col("turn")).alias("key"), "text")
    return _hits(search.search_corpus(turns, ["text"], "tion ", "turn", None))


@query("""WITH h AS (SELECT doc_id, text, strpos(lower(text), 'ationing') AS p, length(text) AS n FROM documents), w AS (SELECT *, greatest(least(p - 3, n - 13), 1) AS f FROM h WHERE p > 0), z AS (SELECT *, least(greatest(f + 13, p + 7), n) AS l FROM w)
SELECT CAST(doc_id AS VARCHAR) AS key, substr(text, f, p - f) AS lead, CASE WHEN f > 1 THEN '…' ELSE '' END AS cut, '[' || substr(text, p, 8) || ']' AS hit, substr(text, p + 8, l - p - 7) || CASE WHEN l < n THEN '…' ELSE '' END AS tail FROM z""")
def search_snippets(spark, d):
    hits = search.search_corpus(_corpus(spark, d, "documents", "doc_id", "text"), ["text"], _TERM, "document", None)
    parts = lambda k: F.regexp_extract("snippet", r"(?s)^(…?)(.*?)(\[[^\[\]]{8}\])(.*)$", k)
    return hits.select("key", parts(2).alias("lead"), parts(1).alias("cut"), parts(3).alias("hit"), parts(4).alias("tail"))


_ALL = [("documents", "doc_id", "text", "document"), ("pages", "page_id", "html", "page"), ("benchmark", "item_id", "text", "benchmark")]


@query("WITH " + ", ".join(f"x{n} AS (WITH {_search_sql(a, b, c, 'tionhe', kind)} SELECT *, {n} AS corpus FROM k ORDER BY rank, key LIMIT 20)" for n, (a, b, c, kind) in enumerate(_ALL)) + " SELECT kind, key, rank FROM (" + " UNION ALL ".join(f"SELECT * FROM x{n}" for n in range(3)) + ") ORDER BY rank, corpus, key LIMIT 20")
def search_all(spark, d):
    found = [_hits(search.search_corpus(_corpus(spark, d, a, b, c), ["text"], "tionhe", kind, None)).orderBy("rank", "key").limit(20) for a, b, c, kind in _ALL]
    return search.merge_hits(found)


@query(f"WITH {_search_sql('documents', 'doc_id', 'text', _TERM, 'document')} SELECT * FROM k")
def search_postings(spark, d):
    corpus = _corpus(spark, d, "documents", "doc_id", "text")
    keys = search.candidates(search.postings(corpus, "key", ["text"]), "key", _TERM)
    return _hits(search.search_corpus(corpus, ["text"], _TERM, "document", None, keys))


@query(f"WITH {_search_sql('documents', 'doc_id', 'text', _TERM, 'document')} SELECT * FROM k")
def search_refreshed_postings(spark, d):
    """Postings of an older state of the texts, brought up to date: texts added, changed and removed since."""
    now = _corpus(spark, d, "documents", "doc_id", "text")
    k = F.col("key").cast("long")
    old = now.filter(k % 5 != 0).withColumn("text", F.when(k % 3 == 0, F.concat(F.lit("Was stationing "), "text")).otherwise(F.col("text")))
    gone = now.select(F.concat(F.lit("-"), "key").alias("key"), F.lit("mentioned rationing").alias("text"))
    index = search.postings(old.unionByName(gone), "key", ["text"])
    index = search.refresh_postings(index, now.filter((k % 5 == 0) | (k % 3 == 0)), "key", ["text"], gone)
    return _hits(search.search_corpus(now, ["text"], _TERM, "document", None, search.candidates(index, "key", _TERM)))


def _refreshed_index(spark, d) -> str:
    """A stored index of documents after three refreshes: an older state with other texts and more of them, what has changed
    and gone since, and what is new."""
    now, root = _corpus(spark, d, "documents", "doc_id", "text"), t.shared_place(spark, "index")
    k = F.col("key").cast("long")
    old = now.filter(k % 5 != 0).withColumn("text", F.when(k % 3 == 0, F.concat(F.lit("Was stationing "), "text")).otherwise(F.col("text")))
    gone = now.select(F.concat(F.lit("-"), "key").alias("key"), F.lit("mentioned rationing").alias("text"))
    text_index.refresh(old.unionByName(gone), root, "key", ["text"])
    text_index.refresh(now.filter((k % 3 == 0) & (k % 5 != 0)), root, "key", ["text"], gone)
    text_index.refresh(now.filter(k % 5 == 0), root, "key", ["text"])
    return root


@query(f"WITH {_search_sql('documents', 'doc_id', 'text', _TERM, 'document')} SELECT * FROM k")
def search_segments(spark, d):
    """Search by a stored index after three refreshes: matches and ranks come from the lists of the term's trigrams."""
    return _hits(text_index.search_index(spark, _refreshed_index(spark, d), _TERM).withColumn("kind", F.lit("document")))


@query(f"WITH {_search_sql('documents', 'doc_id', 'text', 'tion', 'document')} SELECT * FROM (SELECT * FROM k ORDER BY rank, key LIMIT 20)")
def search_top_segments(spark, d):
    """The first twenty by rank, after the segments have been made one."""
    text_index.compact(spark, root := _refreshed_index(spark, d))
    hits = text_index.search_index(spark, root, "TION").withColumn("kind", F.lit("document"))
    return _hits(hits).orderBy("rank", "key").limit(20)


# Texts in the roles of the searched facts: documents as requests, pages as issues, turns as comments.

_FACTS = """e AS (SELECT c_custkey, c_name, c_mktsegment FROM customer), dr AS (SELECT doc_id, 'lake/' || lang AS repo, 'lake/' || lang || '#' || doc_id AS pr_key, source, text, doc_id % 160 AS who FROM documents),
iss AS (SELECT page_id, 'I-' || page_id AS id, 'web/' || (page_id % 3) AS repo, url, html, page_id % 160 AS who FROM pages),
tn AS (SELECT *, conv_id % 160 AS who FROM conversations)"""
_AUTHOR = "CASE WHEN c_name IS NULL THEN CAST(who AS VARCHAR) ELSE c_name END AS author, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bot' ELSE 'user' END AS author_type"


def _people(spark, d) -> DataFrame:
    return t.entities(spark, d).withColumn("entity_key", F.concat(F.lit("user:"), "entity_key"))


def _requests_text(spark, d) -> tuple[DataFrame, DataFrame]:
    x = t.read(spark, d, "documents").withColumn("repo", F.concat(F.lit("lake/"), "lang")).withColumn("pr_key", identity.pr_key(F.col("repo"), F.col("doc_id")))
    facts = x.select(F.col("pr_key").alias("fact_key"), F.col("pr_key").alias("key"), "repo", F.col("source").alias("title"))
    return x.select(F.col("pr_key").alias("fact_key"), F.concat(F.lit("user:"), F.col("doc_id") % 160).alias("author_key"), F.col("source").alias("title"), F.col("text").alias("body")), facts


def _issues_text(spark, d) -> tuple[DataFrame, DataFrame]:
    x = t.read(spark, d, "pages").withColumn("repo", F.concat(F.lit("web/"), F.col("page_id") % 3))
    facts = x.select(F.concat(F.lit("I-"), "page_id").alias("fact_key"), F.concat("repo", F.lit("#"), "page_id").alias("key"), "repo", F.col("url").alias("title"))
    return x.select(F.concat(F.lit("I-"), "page_id").alias("fact_key"), F.concat(F.lit("user:"), F.col("page_id") % 160).alias("author_key"), F.col("url").alias("title"), F.col("html").alias("body")), facts


def _found(df: DataFrame) -> DataFrame:
    return df.select("kind", "key", "repo", "title", "author", "author_type", F.round("rank", 6).alias("rank"))


_REQUEST_HITS = _search_sql("dr", "pr_key", ("source", "text"), "tionhe", "pull_request", ", repo, source AS title, who")


@query(f"WITH {_FACTS}, {_REQUEST_HITS} SELECT kind, key, repo, title, {_AUTHOR}, rank FROM k LEFT JOIN e ON c_custkey = who")
def search_requests(spark, d):
    corpus, facts = _requests_text(spark, d)
    return _found(search.search_facts(corpus, ["title", "body"], "TIONHE", "pull_request", facts, _people(spark, d), None, None))


@query(f"WITH {_FACTS}, {_search_sql('iss', chr(39) + chr(39) + ' || repo || chr(35) || page_id', ('url', 'html'), 'tionhe', 'issue', ', repo, url AS title, who')} SELECT kind, key, repo, title, {_AUTHOR}, rank FROM k LEFT JOIN e ON c_custkey = who WHERE repo = 'web/1'")
def search_issues(spark, d):
    corpus, facts = _issues_text(spark, d)
    return _found(search.search_facts(corpus, ["title", "body"], "tionhe", "issue", facts, _people(spark, d), "Web/1", None))


def _turns(spark, d, role: str, fact_key) -> DataFrame:
    turn = t.read(spark, d, "conversations").filter(F.col("role") == role)
    return turn.select(fact_key.alias("fact_key"), F.concat(F.lit("user:"), F.col("conv_id") % 160).alias("author_key"), F.col("text").alias("body"))


@query(f"WITH {_FACTS}, {_search_sql(chr(40) + 'SELECT * FROM tn WHERE role = ' + chr(39) + 'assistant' + chr(39) + chr(41), 'conv_id', 'text', 'tion ', 'review_comment', ', conv_id, who')} SELECT kind, pr_key AS key, repo, source AS title, {_AUTHOR}, rank FROM k JOIN dr ON doc_id = conv_id LEFT JOIN e ON c_custkey = k.who".replace("CAST(who", "CAST(k.who"))
def search_review_comments(spark, d):
    """A hit carries the request's key and title; comments without their request are no hits."""
    _, facts = _requests_text(spark, d)
    corpus = _turns(spark, d, "assistant", F.col("conv_id"))
    by_id = facts.withColumn("fact_key", identity.key_number(F.col("key")))
    return _found(search.search_facts(corpus, ["body"], "tion ", "review_comment", by_id, _people(spark, d), None, None))


_PARENTS = "pa AS (SELECT 'pull_request:' || pr_key AS fk, pr_key AS key2, repo, source AS title FROM dr UNION ALL SELECT 'issue:' || id, id, repo, url FROM iss)"
_USER_TURNS = "ut AS (SELECT text, who, CASE WHEN conv_id % 2 = 0 THEN 'pull_request:' || (SELECT any_value(pr_key) FROM dr WHERE doc_id = conv_id) ELSE 'issue:I-' || conv_id END AS fk FROM tn WHERE role = 'user')"


@query(f"WITH {_FACTS}, {_PARENTS}, {_USER_TURNS}, {_search_sql('ut', 'fk', 'text', 'tion ', 'issue_comment', ', fk, who')} SELECT kind, key2 AS key, repo, title, {_AUTHOR}, rank FROM k JOIN pa USING (fk) LEFT JOIN e ON c_custkey = who WHERE repo = 'web/1' OR repo = 'lake/en'")
def search_comments_by_parent(spark, d):
    """Comments on requests of one repository and on issues of another, by what they stand under."""
    _, prs = _requests_text(spark, d)
    issues = _issues_text(spark, d)[1].withColumn("parent_key", F.col("fact_key"))
    pr_of = prs.select(F.col("key").alias("pr_key"), identity.key_number(F.col("key")).alias("conv_id"))
    turn = t.read(spark, d, "conversations").filter("role = 'user'").join(pr_of, "conv_id", "left")
    parent = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("pull_request:"), "pr_key")).otherwise(F.concat(F.lit("issue:I-"), "conv_id"))
    corpus = turn.select(parent.alias("fact_key"), F.concat(F.lit("user:"), F.col("conv_id") % 160).alias("author_key"), F.col("text").alias("body"))
    prs = prs.withColumn("parent_key", F.col("key"))
    one = lambda repo: search.search_facts(corpus, ["body"], "tion ", "issue_comment", search.parent_facts(prs, issues, repo), _people(spark, d), None, None)
    return _found(one("web/1").unionByName(one("lake/en")))


@query(f"WITH {_FACTS}, x0 AS (WITH {_REQUEST_HITS} SELECT * FROM k WHERE repo = 'lake/en' ORDER BY rank, key LIMIT 20), x1 AS (WITH {_search_sql('iss', chr(39) + chr(39) + ' || repo || chr(35) || page_id', ('url', 'html'), 'tionhe', 'issue', ', repo, url AS title, who')} SELECT * FROM k WHERE repo = 'lake/en' ORDER BY rank, key LIMIT 20) SELECT kind, key, repo, title, {_AUTHOR}, rank FROM (SELECT * FROM (SELECT *, 0 AS corpus FROM x0 UNION ALL SELECT *, 1 FROM x1) ORDER BY rank, corpus, key LIMIT 20) LEFT JOIN e ON c_custkey = who")
def search_in_repo(spark, d):
    """Several corpora within one repository, merged by rank."""
    found = [search.search_facts(corpus, ["title", "body"], "tionhe", kind, facts, _people(spark, d), "Lake/EN", 20) for kind, (corpus, facts) in (("pull_request", _requests_text(spark, d)), ("issue", _issues_text(spark, d)))]
    return _found(search.merge_hits([h.withColumn("rank", F.round("rank", 6)) for h in found]))


# --- quality and SQL


@query("SELECT 'order' AS relation, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY ALL UNION ALL SELECT 'label', CAST(d.doc_id AS VARCHAR) FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'event user', CAST(user_id AS VARCHAR) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY ALL")
def dq_orphans(spark, d):
    r = lambda n: t.read(spark, d, n)
    return quality.orphans([("order", r("lineitem"), "l_orderkey", r("orders"), "o_orderkey"), ("label", r("documents"), "doc_id", r("labels"), "doc_id"), ("event user", r("events"), "user_id", r("customer"), "c_custkey")])


_ENT = "SELECT CASE WHEN c_custkey % 11 = 0 THEN 'team' WHEN c_mktsegment = 'MACHINERY' THEN 'bot' ELSE 'user' END AS ty, CASE WHEN c_custkey % 13 = 0 THEN 'a:' || c_name ELSE lower(c_name) END AS login, CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE CASE WHEN c_mktsegment = 'MACHINERY' THEN 'bot:' ELSE 'user:' END || lower(c_name) END AS entity_key FROM customer"


@query(f"WITH e AS ({_ENT}) SELECT entity_key FROM e WHERE ty = 'team' OR strpos(login, ':') > 0 OR entity_key <> ty || ':' || login")
def dq_entity_rules(spark, d):
    k, bot, low = F.col("c_custkey"), F.col("c_mktsegment") == "MACHINERY", F.lower("c_name")
    kind = F.when(k % 11 == 0, "team").when(bot, "bot").otherwise("user")
    made = t.read(spark, d, "customer").select(kind.alias("entity_type"), F.when(k % 13 == 0, F.concat(F.lit("a:"), "c_name")).otherwise(low).alias("login"), F.when(k % 17 == 0, "x").otherwise(F.concat(F.when(bot, "bot:").otherwise("user:"), low)).alias("entity_key"))
    return quality.entity_rule_breaks(made)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicate_keys(spark, d):
    return quality.duplicate_keys(t.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'quality' AS \"column\", count(*) - count(quality) AS nulls FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'text', count(*) - count(text) FROM documents LEFT JOIN labels USING (doc_id)")
def dq_nulls(spark, d):
    return quality.null_counts(t.read(spark, d, "documents").join(t.read(spark, d, "labels"), "doc_id", "left"), ["quality", "text"])


@query("SELECT '{\"o_orderstatus\":\"' || o_orderstatus || '\",\"n\":' || count(*) || '}' AS row FROM orders GROUP BY o_orderstatus")
def readonly_sql(spark, d):
    """Rows of a plain query as JSON."""
    sqlsurface.register({"orders": t.read(spark, d, "orders")})
    return sqlsurface.as_json(sqlsurface.read_only(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"))


@query("SELECT count(*) > 7 AS truncated, least(count(*), 7) AS n FROM (SELECT DISTINCT o_custkey FROM orders)")
def readonly_sql_capped(spark, d):
    """The first rows of a query and whether there are more."""
    sqlsurface.register({"orders": t.read(spark, d, "orders")})
    head, more = listing.capped(sqlsurface.read_only(spark, "WITH c AS (SELECT DISTINCT o_custkey FROM orders) SELECT * FROM c"), 7)
    return head.agg(F.lit(more).alias("truncated"), F.count("*").alias("n"))
