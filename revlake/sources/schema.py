"""Schemas of the landed pages and of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ACTOR = "struct<login: string, __typename: string>"
_COMMENT = f"struct<id: string, body: string, createdAt: string, author: {_ACTOR}>"
_PR = f"""number: bigint, title: string, body: string, state: string, isDraft: boolean, createdAt: string, updatedAt: string,
mergedAt: string, closedAt: string, baseRefName: string, headRefName: string, additions: bigint, deletions: bigint, changedFiles: bigint,
author: {_ACTOR}, mergedBy: {_ACTOR},
reviews: struct<nodes: array<struct<id: string, state: string, body: string, submittedAt: string, author: {_ACTOR}>>>,
reviewThreads: struct<nodes: array<struct<comments: struct<nodes: array<struct<id: string, body: string, path: string, line: bigint, createdAt: string, author: {_ACTOR}, replyTo: struct<id: string>>>>>>>,
comments: struct<nodes: array<{_COMMENT}>>,
files: struct<nodes: array<struct<path: string, changeType: string, additions: bigint, deletions: bigint>>>,
commits: struct<nodes: array<struct<commit: struct<oid: string, checkSuites: struct<nodes: array<struct<checkRuns: struct<nodes: array<struct<id: string, name: string, status: string, conclusion: string, startedAt: string, completedAt: string>>>>>>>>>>"""
_REPO = "nameWithOwner: string, primaryLanguage: struct<name: string>, isFork: boolean, isPrivate: boolean, defaultBranchRef: struct<name: string>, createdAt: string"
_PAGE = "pageInfo: struct<hasNextPage: boolean, endCursor: string>"
PR_PAGE = f"data struct<repository: struct<{_REPO}, pullRequests: struct<{_PAGE}, nodes: array<struct<{_PR}>>>>>"
SEARCH_PAGE = f"data struct<search: struct<issueCount: bigint, {_PAGE}, nodes: array<struct<{_PR}, repository: struct<{_REPO}>>>>>"
_ISSUE = f"""id: string, number: bigint, title: string, body: string, state: string, stateReason: string, createdAt: string, updatedAt: string, closedAt: string, author: {_ACTOR},
milestone: struct<id: string, number: bigint, title: string, description: string, state: string, dueOn: string, createdAt: string>,
labels: struct<nodes: array<struct<id: string, name: string, color: string, description: string>>>, assignees: struct<nodes: array<{_ACTOR}>>, comments: struct<nodes: array<{_COMMENT}>>"""
ISSUE_PAGE = f"data struct<repository: struct<{_REPO}, issues: struct<{_PAGE}, nodes: array<struct<{_ISSUE}>>>>>"
PATCHES = "pr_key string, filename string, previous_filename string, patch string"

TABLES: dict[str, str] = {
    "dim_entities": "entity_key string, entity_type string, login string, is_human boolean, is_bot boolean, name string",
    "dim_repositories": "repo_key string, owner string, name string, primary_language string, is_fork boolean, is_private boolean, default_branch string, created_at timestamp",
    "fact_pull_requests": "pr_key string, number bigint, repo_key string, author_key string, state string, is_draft boolean, title string, body string, base_ref string, head_ref string, created_at timestamp, updated_at timestamp, merged_at timestamp, closed_at timestamp, merged_by_key string, created_date_key date, created_time_key string, updated_date_key date, updated_time_key string, merged_date_key date, comment_count bigint, review_count bigint, changed_files bigint, additions bigint, deletions bigint",
    "fact_reviews": "review_key string, pr_key string, reviewer_key string, state string, body string, submitted_at timestamp, submitted_date_key date, submitted_time_key string",
    "fact_review_comments": "comment_key string, pr_key string, author_key string, review_key string, in_reply_to string, path string, line bigint, body string, created_at timestamp, created_date_key date, created_time_key string",
    "fact_issue_comments": "comment_key string, parent_type string, parent_key string, author_key string, in_reply_to string, body string, created_at timestamp, created_date_key date, created_time_key string",
    "fact_check_runs": "check_run_key string, pr_key string, head_sha string, name string, status string, conclusion string, started_at timestamp, completed_at timestamp",
    "fact_file_diffs": "file_diff_key string, pr_key string, repo_key string, file_path string, previous_path string, change_type string, patch string, additions bigint, deletions bigint",
    "issues": "id string, repo_key string, number bigint, title string, body string, state string, state_reason string, author_key string, milestone_id string, comment_count bigint, created_at timestamp, updated_at timestamp, closed_at timestamp, created_date_key date",
    "labels": "id string, repo_key string, name string, color string, description string",
    "milestones": "id string, repo_key string, number bigint, title string, description string, state string, due_on timestamp, created_at timestamp",
    "issue_labels": "issue_id string, label_id string",
    "issue_assignees": "issue_id string, entity_key string",
    "rejects": "item_key string, source_type string, source_id string, updated_at timestamp, error string, tries bigint",
    "cursors": "source_type string, source_id string, newest timestamp, cursor timestamp",
    "coverage": "entity string, start date, end date, items bigint",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
