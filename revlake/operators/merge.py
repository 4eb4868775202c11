"""Keyed merges with a policy for each column, for tables without row-level updates.

R replaces, K keeps the first value, C takes the new value unless it is null. Every merge is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import bare_login

#: Columns by table: key, replaced (R), coalesced (C); all others are kept (K).
POLICIES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "dim_entities": (["entity_key"], ["entity_type", "is_human", "is_bot"], []),
    "dim_repositories": (["repo_key"], ["primary_language", "is_fork", "is_private", "default_branch"], ["created_at"]),
    "fact_pull_requests": (["pr_key"], ["state", "is_draft", "title", "body", "base_ref", "head_ref", "updated_at", "merged_at", "closed_at", "merged_by_key", "updated_date_key", "updated_time_key", "merged_date_key", "comment_count", "review_count", "changed_files", "additions", "deletions"], []),
    "fact_reviews": (["review_key"], ["state", "body", "submitted_at", "submitted_date_key", "submitted_time_key"], []),
    "fact_review_comments": (["comment_key"], ["in_reply_to", "path", "line", "body"], []),
    "fact_issue_comments": (["comment_key"], ["body", "in_reply_to"], []),
    "fact_check_runs": (["check_run_key"], ["status", "conclusion", "started_at", "completed_at"], []),
    "fact_file_diffs": (["file_diff_key"], ["previous_path", "change_type", "additions", "deletions"], ["patch"]),
    "issues": (["id"], ["title", "body", "state", "state_reason", "author_key", "milestone_id", "comment_count", "updated_at", "closed_at", "created_date_key"], []),
    "labels": (["id"], ["name", "color", "description"], []),
    "milestones": (["id"], ["title", "description", "state", "due_on"], []),
    "user_group": (["name"], [], ["description"]),
}


def newest_per_key(batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def merge(old: DataFrame, new: DataFrame, key: list[str], replace: list[str] = (), coalesce: list[str] = ()) -> DataFrame:
    """old with new merged in: one row per key, old's columns. new has one row per key."""
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, key, "full")

    def column(c: str) -> Column:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in key:
            return F.col(c)
        if c in replace:
            return F.when(F.col("_new"), now).otherwise(was).alias(c)
        if c in coalesce:
            return F.coalesce(now, was).alias(c)
        return F.when(F.col("_old"), was).otherwise(now).alias(c)

    return both.select(*[column(c) for c in old.columns])


def merge_table(table: str, old: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    key, replace, coalesce = POLICIES[table]
    return merge(old, newest_per_key(batch, key, order), key, replace, coalesce)


def update_only(old: DataFrame, new: DataFrame, key: list[str], replace: list[str] = (), coalesce: list[str] = ()) -> DataFrame:
    """Changes rows that exist, adds none."""
    n = new.withColumn("_new", F.lit(True))
    both = old.alias("o").join(n.alias("n"), key, "left")
    column = lambda c: F.col(c) if c in key else F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in replace else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in coalesce else F.col(f"o.{c}")
    return both.select(*[column(c) for c in old.columns])


def replace_links(old: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Bridge rows: those of the batch's parents go, the new ones come, once each."""
    return old.join(parents.select(parent), parent, "left_anti").unionByName(new.select(*old.columns)).dropDuplicates(old.columns)


def backfill_patches(diffs: DataFrame, patches: DataFrame) -> DataFrame:
    """File diffs with the patches of scanned files: rows that exist only; a previous path is taken where one is given."""
    p = patches.select(F.concat_ws(":", "pr_key", "filename").alias("file_diff_key"), "patch", F.col("previous_filename").alias("previous_path"))
    p = p.groupBy("file_diff_key").agg(F.max_by("patch", F.struct("patch", "previous_path")).alias("patch"), F.max_by("previous_path", F.struct("patch", "previous_path")).alias("previous_path"))
    return update_only(diffs, p, ["file_diff_key"], ["patch"], ["previous_path"])


def normal_members(members: DataFrame, kind: str) -> DataFrame:
    """group, member of a roster as loaded: users as bare logins and repositories, all in lower case and trimmed, once each."""
    m = F.lower(F.trim("member"))
    m = bare_login(m) if kind == "user" else m
    return members.select("group", m.alias("member")).filter("member <> ''").distinct()


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.select(*old.columns).dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def merge_summaries(old: DataFrame, new: DataFrame, prs: DataFrame) -> DataFrame:
    """pr_key, repo_key, number, author_key, source_updated_at from the request (from the key where it is missing), other
    columns as given, created_at kept, the stale flag cleared. old has the table's columns."""
    p = prs.select("pr_key", F.col("repo_key").alias("_repo"), F.col("number").alias("_number"), F.col("author_key").alias("_author"), F.col("updated_at").alias("_updated"))
    own = [c for c in old.columns if c not in ("repo_key", "number", "author_key", "source_updated_at", "is_stale")]
    made = new.join(p, "pr_key", "left").select(
        *own,
        F.coalesce("_repo", F.regexp_extract("pr_key", r"^(.*)#(\d+)$", 1)).alias("repo_key"),
        F.coalesce("_number", F.regexp_extract("pr_key", r"^(.*)#(\d+)$", 2).try_cast("long")).alias("number"),
        F.col("_author").alias("author_key"), F.col("_updated").alias("source_updated_at"), F.lit(False).alias("is_stale"),
    )
    return merge(old, made, ["pr_key"], [c for c in old.columns if c not in ("pr_key", "created_at")])


def without_summary(prs: DataFrame, summaries: DataFrame) -> DataFrame:
    return prs.join(summaries.select("pr_key"), "pr_key", "left_anti")


def stale_summaries(summaries: DataFrame, prs: DataFrame) -> DataFrame:
    return summaries.join(prs.select("pr_key", "updated_at"), "pr_key").filter("source_updated_at < updated_at")
