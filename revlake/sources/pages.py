"""Landed JSON pages to star-schema rows: one explode per nesting level, no shuffle but for keyed dedupe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import GHOST, bare_login, entity_key
from ..functions.timekeys import local_date_key, local_time_key
from . import schema as S


def _ts(c: str | Column) -> Column:
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _actor(c: str) -> Column:
    return entity_key(F.col(f"{c}.login"), F.col(f"{c}.__typename"))


_HEADER = ("nameWithOwner", "primaryLanguage", "isFork", "isPrivate", "defaultBranchRef", "createdAt")


def _last(page: Column) -> Column:
    """Whether a page ends its source's list."""
    return (~F.coalesce(page["pageInfo"]["hasNextPage"], F.lit(False))).alias("last")


def pr_items(pages: DataFrame) -> DataFrame:
    """source_id (the repository), last (page of its source), header, node: a row for each request, and one without node for
    a page without any."""
    r = F.col("data.repository")
    header = F.struct(*[r[c].alias(c) for c in _HEADER]).alias("header")
    rows = pages.select(F.lower(r["nameWithOwner"]).alias("source_id"), _last(r["pullRequests"]), header, F.explode_outer(r["pullRequests"]["nodes"]).alias("node"))
    return rows.withColumn("node", F.when(F.col("node.number").isNotNull(), F.col("node")))


def search_items(pages: DataFrame) -> DataFrame:
    """The same from person searches, whose source_id (stream and person) is a column of the pages; nodes without a number
    are none."""
    found = pages.select(F.coalesce("source_id", F.lit("")).alias("source_id"), _last(F.col("data.search")), F.explode_outer("data.search.nodes").alias("n"))
    return found.select("source_id", "last", F.col("n.repository").alias("header"), F.when(F.col("n.number").isNotNull(), F.col("n").dropFields("repository")).alias("node"))


def issue_items(pages: DataFrame) -> DataFrame:
    """The same for issues, with repo_key in place of the header."""
    r = F.col("data.repository")
    repo = F.lower(r["nameWithOwner"])
    rows = pages.select(repo.alias("source_id"), _last(r["issues"]), repo.alias("repo_key"), F.explode_outer(r["issues"]["nodes"]).alias("node"))
    return rows.withColumn("node", F.when(F.col("node.id").isNotNull(), F.col("node")))


def read_pr_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per request: header (its repository), node."""
    return pr_items(spark.read.schema(S.PR_PAGE).json(path)).filter("node IS NOT NULL").select("header", "node")


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.schema(S.SEARCH_PAGE).json(path).withColumn("source_id", F.lit(""))
    return search_items(found).filter("node IS NOT NULL").select("header", "node")


def read_issue_pages(spark: SparkSession, path: str) -> DataFrame:
    return issue_items(spark.read.schema(S.ISSUE_PAGE).json(path)).filter("node IS NOT NULL").select("repo_key", "node")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PATCHES).json(path).filter("filename IS NOT NULL")


#: Times of an item: its own, and those within its arrays.
_PR_TIMES = ["updatedAt", "mergedAt", "closedAt"]
_ISSUE_TIMES = ["updatedAt", "closedAt"]


def _bad(c: Column) -> Column:
    return c.isNotNull() & _ts(c).isNull()


def _any(nodes: Column, bad) -> Column:
    return F.coalesce(F.exists(nodes, bad), F.lit(False))


def item_key(items: DataFrame) -> Column:
    """The key of a request (by its header) or an issue."""
    return F.concat(F.lower("header.nameWithOwner"), F.lit("#"), F.col("node.number").cast("string")) if "header" in items.columns else F.col("node.id")


def broken(items: DataFrame) -> tuple[Column, Column]:
    """Whether any time of an item, also of its reviews, comments and check runs, does not parse, and what is then said of it."""
    n = F.col("node")
    comment = lambda x: _bad(x["createdAt"])
    parts = [_any(n["comments"]["nodes"], comment)]
    if "header" in items.columns:
        own = _PR_TIMES
        runs = lambda x: _any(x["checkRuns"]["nodes"], lambda r: _bad(r["startedAt"]) | _bad(r["completedAt"]))
        last = F.try_element_at(n["commits"]["nodes"], F.lit(-1))["commit"]["checkSuites"]["nodes"]
        parts += [_any(n["reviews"]["nodes"], lambda x: _bad(x["submittedAt"])), _any(n["reviewThreads"]["nodes"], lambda x: _any(x["comments"]["nodes"], comment)), _any(last, runs)]
    else:
        own = _ISSUE_TIMES
        parts.append(_bad(n["milestone"]["dueOn"]))
    any_ = reduce(Column.__or__, [_ts(n["createdAt"]).isNull(), *[_bad(n[c]) for c in own], *parts])
    error = F.concat(F.lit("unreadable time: "), F.to_json(F.struct(n["createdAt"].alias("createdAt"), *[n[c].alias(c) for c in own])))
    return F.coalesce(any_, F.lit(True)), error


def split_rejects(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items all whose times parse, also those of their reviews, comments and check runs, and the others as item_key,
    updated_at, error: a whole item is set aside. items: node, and header (requests) or repo_key (issues); a source_id comes
    along."""
    any_, error = broken(items)
    flagged = items.withColumn("_broken", any_)
    bad = flagged.filter("_broken").select(*[c for c in ("source_id",) if c in items.columns], item_key(items).alias("item_key"), _ts("node.updatedAt").alias("updated_at"), error.alias("error"))
    return flagged.filter("NOT _broken").drop("_broken"), bad


def repositories(items: DataFrame) -> DataFrame:
    key = F.lower("header.nameWithOwner")
    return items.select(key.alias("repo_key"), F.split_part(key, F.lit("/"), F.lit(1)).alias("owner"), F.split_part(key, F.lit("/"), F.lit(2)).alias("name"), F.col("header.primaryLanguage.name").alias("primary_language"), F.coalesce("header.isFork", F.lit(False)).alias("is_fork"), F.coalesce("header.isPrivate", F.lit(False)).alias("is_private"), F.col("header.defaultBranchRef.name").alias("default_branch"), _ts("header.createdAt").alias("created_at")).dropDuplicates(["repo_key"])


def _along(items: DataFrame) -> list[str]:
    """The month of an item comes along to the facts that stand in it."""
    return [c for c in ("month",) if c in items.columns]


def _keyed(items: DataFrame) -> DataFrame:
    repo = F.lower("header.nameWithOwner")
    return items.select("*", repo.alias("repo_key"), F.concat(repo, F.lit("#"), F.col("node.number").cast("string")).alias("pr_key"))


def pull_requests(items: DataFrame, zone: str) -> DataFrame:
    n = F.col("node")
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    threads = F.aggregate(F.coalesce(n["reviewThreads"]["nodes"], F.array()), F.lit(0), lambda a, t: a + F.coalesce(F.array_size(t["comments"]["nodes"]), F.lit(0)))
    created, updated, merged = _ts("node.createdAt"), _ts("node.updatedAt"), _ts("node.mergedAt")
    zero = lambda c: F.coalesce(n[c], F.lit(0)).alias(c)
    return _keyed(items).select(
        "pr_key", n["number"].alias("number"), "repo_key", _actor("node.author").alias("author_key"), F.coalesce(n["state"], F.lit("OPEN")).alias("state"), F.coalesce(n["isDraft"], F.lit(False)).alias("is_draft"),
        F.coalesce(n["title"], F.lit("")).alias("title"), F.coalesce(n["body"], F.lit("")).alias("body"), n["baseRefName"].alias("base_ref"), n["headRefName"].alias("head_ref"), created.alias("created_at"), updated.alias("updated_at"), merged.alias("merged_at"),
        _ts("node.closedAt").alias("closed_at"), F.when(n["mergedBy"]["login"].isNotNull(), _actor("node.mergedBy")).alias("merged_by_key"), local_date_key(created, zone).alias("created_date_key"), local_time_key(created, zone).alias("created_time_key"),
        local_date_key(updated, zone).alias("updated_date_key"), local_time_key(updated, zone).alias("updated_time_key"), local_date_key(merged, zone).alias("merged_date_key"), (count(n["comments"]["nodes"]) + threads).cast("long").alias("comment_count"),
        count(n["reviews"]["nodes"]).alias("review_count"), zero("changedFiles").alias("changed_files"), zero("additions"), zero("deletions"), *_along(items),
    )


def reviews(items: DataFrame, zone: str) -> DataFrame:
    rows = _keyed(items).select("pr_key", *_along(items), F.explode("node.reviews.nodes").alias("x")).filter("x.id IS NOT NULL AND x.submittedAt IS NOT NULL")
    at = _ts("x.submittedAt")
    return rows.select(F.col("x.id").alias("review_key"), "pr_key", _actor("x.author").alias("reviewer_key"), F.coalesce("x.state", F.lit("COMMENTED")).alias("state"), _none_if_empty(F.col("x.body")).alias("body"), at.alias("submitted_at"), local_date_key(at, zone).alias("submitted_date_key"), local_time_key(at, zone).alias("submitted_time_key"), *_along(items))


def review_comments(items: DataFrame, zone: str) -> DataFrame:
    flat = F.flatten(F.transform("node.reviewThreads.nodes", lambda t: F.coalesce(t["comments"]["nodes"], F.array())))
    rows = _keyed(items).select("pr_key", *_along(items), F.explode(flat).alias("x")).filter("x.id IS NOT NULL AND x.createdAt IS NOT NULL")
    at = _ts("x.createdAt")
    return rows.select(F.col("x.id").alias("comment_key"), "pr_key", _actor("x.author").alias("author_key"), F.lit(None).cast("string").alias("review_key"), F.col("x.replyTo.id").alias("in_reply_to"), F.col("x.path").alias("path"), F.col("x.line").alias("line"), F.col("x.body").alias("body"), at.alias("created_at"), local_date_key(at, zone).alias("created_date_key"), local_time_key(at, zone).alias("created_time_key"), *_along(items))


def _conversation(rows: DataFrame, kind: str, zone: str) -> DataFrame:
    at = _ts("x.createdAt")
    return rows.filter("x.id IS NOT NULL AND x.createdAt IS NOT NULL").select(F.col("x.id").alias("comment_key"), F.lit(kind).alias("parent_type"), "parent_key", _actor("x.author").alias("author_key"), F.lit(None).cast("string").alias("in_reply_to"), F.col("x.body").alias("body"), at.alias("created_at"), local_date_key(at, zone).alias("created_date_key"), local_time_key(at, zone).alias("created_time_key"), *_along(rows))


def pr_comments(items: DataFrame, zone: str) -> DataFrame:
    return _conversation(_keyed(items).select(F.col("pr_key").alias("parent_key"), *_along(items), F.explode("node.comments.nodes").alias("x")), "pull_request", zone)


def file_diffs(items: DataFrame) -> DataFrame:
    rows = _keyed(items).select("pr_key", "repo_key", *_along(items), F.explode("node.files.nodes").alias("x")).filter("x.path IS NOT NULL")
    return rows.select(F.concat_ws(":", "pr_key", "x.path").alias("file_diff_key"), "pr_key", "repo_key", F.col("x.path").alias("file_path"), F.lit(None).cast("string").alias("previous_path"), F.coalesce("x.changeType", F.lit("MODIFIED")).alias("change_type"), F.lit(None).cast("string").alias("patch"), F.coalesce("x.additions", F.lit(0)).alias("additions"), F.coalesce("x.deletions", F.lit(0)).alias("deletions"), *_along(items))


def check_runs(items: DataFrame) -> DataFrame:
    commit = F.try_element_at("node.commits.nodes", F.lit(-1))["commit"]
    own = _keyed(items).filter(F.coalesce(F.array_size("node.commits.nodes"), F.lit(0)) > 0).select("pr_key", *_along(items), commit.alias("c")).filter("c.oid IS NOT NULL")
    rows = own.select("pr_key", *_along(items), F.col("c.oid").alias("head_sha"), F.explode(F.flatten(F.transform("c.checkSuites.nodes", lambda s: F.coalesce(s["checkRuns"]["nodes"], F.array())))).alias("x")).filter("x.id IS NOT NULL")
    return rows.select(F.col("x.id").alias("check_run_key"), "pr_key", "head_sha", F.coalesce("x.name", F.lit("")).alias("name"), F.coalesce("x.status", F.lit("COMPLETED")).alias("status"), F.col("x.conclusion").alias("conclusion"), _ts("x.startedAt").alias("started_at"), _ts("x.completedAt").alias("completed_at"), *_along(items))


def issues(items: DataFrame, zone: str) -> DataFrame:
    n, created = F.col("node"), _ts("node.createdAt")
    return items.select(n["id"].alias("id"), "repo_key", n["number"].alias("number"), F.coalesce(n["title"], F.lit("")).alias("title"), n["body"].alias("body"), F.lower(F.coalesce(n["state"], F.lit("open"))).alias("state"), F.lower(n["stateReason"]).alias("state_reason"), _actor("node.author").alias("author_key"), n["milestone"]["id"].alias("milestone_id"), F.coalesce(F.array_size(n["comments"]["nodes"]), F.lit(0)).cast("long").alias("comment_count"), created.alias("created_at"), F.coalesce(_ts("node.updatedAt"), created).alias("updated_at"), _ts("node.closedAt").alias("closed_at"), local_date_key(created, zone).alias("created_date_key"), *_along(items))


def milestones(items: DataFrame) -> DataFrame:
    m = F.col("node.milestone")
    return items.filter("node.milestone.id IS NOT NULL").select(m["id"].alias("id"), "repo_key", m["number"].alias("number"), m["title"].alias("title"), m["description"].alias("description"), F.lower(m["state"]).alias("state"), _ts("node.milestone.dueOn").alias("due_on"), _ts("node.milestone.createdAt").alias("created_at")).dropDuplicates(["id"])


def labels(items: DataFrame) -> DataFrame:
    rows = items.select("repo_key", F.explode("node.labels.nodes").alias("x")).filter("x.id IS NOT NULL")
    return rows.select(F.col("x.id").alias("id"), "repo_key", F.col("x.name").alias("name"), F.coalesce("x.color", F.lit("")).alias("color"), F.coalesce("x.description", F.lit("")).alias("description")).dropDuplicates(["id"])


def issue_labels(items: DataFrame) -> DataFrame:
    return items.select(F.col("node.id").alias("issue_id"), F.explode("node.labels.nodes").alias("x")).filter("x.id IS NOT NULL").select("issue_id", F.col("x.id").alias("label_id")).dropDuplicates()


def issue_assignees(items: DataFrame) -> DataFrame:
    return items.select(F.col("node.id").alias("issue_id"), F.explode("node.assignees.nodes").alias("x")).select("issue_id", _actor("x").alias("entity_key")).dropDuplicates()


def issue_comments(items: DataFrame, zone: str) -> DataFrame:
    return _conversation(items.select(F.col("node.id").alias("parent_key"), *_along(items), F.explode("node.comments.nodes").alias("x")), "issue", zone)


def _actors(items: DataFrame, one: list[str], many: list[Column]) -> DataFrame:
    """The actors in all places of an item, by one pass over it."""
    kind = F.array().cast("array<struct<login: string, __typename: string>>")
    places = [F.array(*[F.col(c) for c in one]), *[F.coalesce(c, kind) for c in many]]
    return items.select(F.explode(F.concat(*places)).alias("a")).filter("a.login IS NOT NULL AND a.login <> ''").select(_actor("a").alias("entity_key"), F.col("a.login").alias("name"))


def named_actors(prs: DataFrame | None, issue_items: DataFrame | None = None) -> DataFrame:
    """entity_key, name: every actor in any place, and the ghost, once each with the first casing in binary order."""
    author = lambda nodes: F.col(nodes)["author"]
    threads = F.flatten(F.transform("node.reviewThreads.nodes", lambda t: F.coalesce(t["comments"]["nodes"]["author"], F.array())))
    parts = []
    if prs is not None:
        parts.append(_actors(prs, ["node.author", "node.mergedBy"], [author("node.reviews.nodes"), threads, author("node.comments.nodes")]))
    if issue_items is not None:
        parts.append(_actors(issue_items, ["node.author"], [author("node.comments.nodes"), F.col("node.assignees.nodes")]))
    spark = parts[0].sparkSession
    actors = reduce(DataFrame.unionByName, [*parts, spark.range(1).select(F.lit(GHOST).alias("entity_key"), F.lit("ghost").alias("name"))])
    return actors.groupBy("entity_key").agg(F.min("name").alias("name"))


def entities_of(named: DataFrame) -> DataFrame:
    """One row per key of named_actors, of one load or of several."""
    kind = F.substring_index("entity_key", ":", 1)
    return named.groupBy("entity_key").agg(F.min("name").alias("name")).select("entity_key", kind.alias("entity_type"), bare_login(F.col("entity_key")).alias("login"), (kind == "user").alias("is_human"), (kind == "bot").alias("is_bot"), "name")


def entities(prs: DataFrame | None, issue_items: DataFrame | None = None) -> DataFrame:
    """Every actor in any place, and the ghost; one row per key with the first casing in binary order as its name."""
    return entities_of(named_actors(prs, issue_items))


def issue_tables(items: DataFrame, zone: str) -> dict[str, DataFrame]:
    """All tables that issue pages fill."""
    return {"issues": issues(items, zone), "milestones": milestones(items), "labels": labels(items), "issue_labels": issue_labels(items), "issue_assignees": issue_assignees(items), "fact_issue_comments": issue_comments(items, zone)}


def request_tables(items: DataFrame, zone: str) -> dict[str, DataFrame]:
    """All tables that request pages fill."""
    return {"dim_repositories": repositories(items), "dim_entities": entities(items), "fact_pull_requests": pull_requests(items, zone), "fact_reviews": reviews(items, zone), "fact_review_comments": review_comments(items, zone), "fact_issue_comments": pr_comments(items, zone), "fact_check_runs": check_runs(items), "fact_file_diffs": file_diffs(items)}
