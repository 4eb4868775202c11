"""Filters, listings and counts over a fact table. A filter is a DataFrame -> DataFrame step: values of one dimension are
alternatives, steps are all required. Filters through other tables are semi-joins, so rows never multiply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import bare_login, display, namespace
from ..functions.periods import Period, in_period


def where_in(df: DataFrame, col: str, values: list) -> DataFrame:
    """An empty list selects nothing."""
    return df.filter(F.col(col).isin(values))


def where_repo(df: DataFrame, repos: list[str], col: str = "repo_key") -> DataFrame:
    """Repositories are named in any case; keys are in lower case."""
    return where_in(df, col, [r.lower() for r in repos])


def where_not_in(df: DataFrame, col: str, values: list) -> DataFrame:
    """An empty list keeps all."""
    return df.filter(~F.col(col).isin(values))


def where_related(df: DataFrame, related: DataFrame, key: str) -> DataFrame:
    """Rows that related has a row for: reviewers, labels, owners, rosters."""
    return df.join(related.select(key), key, "left_semi")


def where_unrelated(df: DataFrame, related: DataFrame, key: str) -> DataFrame:
    return df.join(related.select(key), key, "left_anti")


def since(df: DataFrame, col: str, day) -> DataFrame:
    return df.filter(F.col(col) >= F.lit(day))


def until(df: DataFrame, col: str, day) -> DataFrame:
    return df.filter(F.col(col) <= F.lit(day))


def between(df: DataFrame, col: str, first, last) -> DataFrame:
    return until(since(df, col, first), col, last)


def during(df: DataFrame, col: str, period: Period) -> DataFrame:
    """Calendar and rolling periods alike are date ranges."""
    return df.filter(in_period(F.col(col), period))


def when_given(df: DataFrame, col: str, value) -> DataFrame:
    """An optional filter."""
    return df if value is None else df.filter(F.col(col) == F.lit(value))


def with_authors(prs: DataFrame, entities: DataFrame, key: str = "author_key") -> DataFrame:
    """Adds author and author_type; a missing entity falls back to what the key says. Never drops a row."""
    e = entities.select(F.col("entity_key").alias(key), F.col("login").alias("_login"), F.col("entity_type").alias("_type"))
    k = F.col(key)
    return prs.join(e, key, "left").select(*[F.col(c) for c in prs.columns], F.coalesce("_login", bare_login(k)).alias("author"), F.coalesce("_type", namespace(k)).alias("author_type"))


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def count_rows(prs: DataFrame) -> DataFrame:
    """Limit and offset play no part; keys are unique after semi-joins."""
    return prs.agg(F.count("*").alias("n"))


def lines_changed(prs: DataFrame, *cols: str) -> DataFrame:
    """Sums over the selected rows, 0 when there are none."""
    return prs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])


def count_by(prs: DataFrame, group: Column, order: bool = False) -> DataFrame:
    """group, n."""
    out = prs.groupBy(group.alias("group")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "group") if order else out


def author_label(prs: DataFrame, entities: DataFrame, key: str = "author_key") -> DataFrame:
    """Adds label: login with the bot mark; the raw key where the entity is missing."""
    e = entities.select(F.col("entity_key").alias(key), display(F.col("login"), F.col("entity_type")).alias("_label"))
    return prs.join(e, key, "left").withColumn("label", F.coalesce("_label", F.col(key).cast("string"))).drop("_label")


def capped(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """At most so many rows, and whether there were more."""
    head = df.limit(rows + 1)
    return df.limit(rows), head.count() > rows
