"""Identity: entity keys type:login, bare logins and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GHOST = "user:ghost"
BOT_SUFFIX = "[bot]"
BOT_MARK = " [bot]"


def is_bot(login: Column, wire_type: Column, suffix: str = BOT_SUFFIX) -> Column:
    return F.coalesce(wire_type == "Bot", F.lit(False)) | F.endswith(F.lower(login), F.lit(suffix.lower()))


def entity_key(login: Column, wire_type: Column, suffix: str = BOT_SUFFIX) -> Column:
    """type:login in lower case; the ghost for a missing actor."""
    kind = F.when(is_bot(login, wire_type, suffix), "bot").otherwise("user")
    return F.when(login.isNull() | (login == ""), F.lit(GHOST)).otherwise(F.concat(kind, F.lit(":"), F.lower(login)))


def bare_login(key: Column) -> Column:
    """Strips user: and bot: only."""
    return F.regexp_replace(F.lower(key), "^(user|bot):", "")


def namespace(key: Column) -> Column:
    return F.when(F.lower(key).startswith("bot:"), "bot").otherwise("user")


def display(login: Column, kind: Column) -> Column:
    return F.concat(login, F.when(kind == "bot", BOT_MARK).otherwise(""))


def resolve_logins(logins: DataFrame, entities: DataFrame, login_col: str = "login") -> DataFrame:
    """login, entity_key: a bare login gives each entity that has it, user:login if none has; type:login is taken as it is."""
    asked = logins.select(F.col(login_col).alias("login"), F.lower(F.trim(F.col(login_col))).alias("asked"))
    known = entities.select(F.col("login").alias("asked"), F.col("entity_key").alias("known"))
    bare = asked.filter(~F.contains("asked", F.lit(":"))).join(known, "asked", "left").select("login", F.coalesce("known", F.concat(F.lit("user:"), "asked")).alias("entity_key"))
    return bare.unionByName(asked.filter(F.contains("asked", F.lit(":"))).select("login", F.col("asked").alias("entity_key")))


def pr_key(repo: Column, number: Column) -> Column:
    return F.concat(F.lower(repo), F.lit("#"), number.cast("string"))


def key_repo(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^(.*)#(\d+)$", 1)


def key_number(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^(.*)#(\d+)$", 2).try_cast("long")
