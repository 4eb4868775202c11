"""Data quality: orphans, entity rules, duplicate keys and missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """relation, key for each child value without parent. checks: relation, child, column, parent, column."""
    one = lambda name, child, c, parent, p: child.select(F.col(c).alias("k")).filter("k IS NOT NULL").distinct().join(parent.select(F.col(p).alias("k")), "k", "left_anti").select(F.lit(name).alias("relation"), F.col("k").cast("string").alias("key"))
    return reduce(DataFrame.unionByName, [one(*c) for c in checks])


def entity_rule_breaks(entities: DataFrame) -> DataFrame:
    """entity_key of entities with an unknown type, a login that is empty or has a colon, or another key than type:login."""
    good = F.col("entity_type").isin("user", "bot", "org") & (F.col("login") != "") & ~F.contains("login", F.lit(":")) & (F.col("entity_key") == F.concat_ws(":", "entity_type", "login"))
    return entities.filter(~F.coalesce(good, F.lit(False))).select("entity_key")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """The key's columns and n, for keys with several rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def null_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """column, nulls, in one pass."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in required])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("nulls")) for c in required])).alias("x")).select("x.*")
