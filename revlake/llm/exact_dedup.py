"""Exact dedup by distributed most-significant-digit radix partitioning.

A level splits every open group by its members' next bytes, a digit of growing width. A group closes when it has one
member or when its texts end inside the digit. Only (row, group, digit) is shuffled, counts are pre-aggregated, and a
text's later bytes are read only while its group is open. Equality rests on the bytes themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage, text_of

FIRST_DIGIT = 64
GROWTH = 8


def _level(rows: DataFrame, width: int) -> DataFrame:
    """rows (rid, grp, digit) -> rows of groups that still have two members or more: rid, grp, ended."""
    groups = stage(rows.groupBy("grp", "digit").agg(F.min("rid").alias("next"), F.count("*").alias("n")).filter("n > 1"), "exact-groups")
    return rows.join(groups.hint("merge"), ["grp", "digit"]).select("rid", F.col("next").alias("grp"), (F.octet_length("digit") < width).alias("ended"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when they agree after deleting [\\x20\\x09-\\x0D]; a null text counts as empty, and empty texts are
    equal to each other. The row with the most code points stays, then the smallest id (null first), then any one of
    rows that repeat wholly. Repeated rows count one by one. Other columns are ignored; an empty table gives no
    rows. Texts of any length are compared whole.
    """
    text = text_of(text_col)
    body = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")
    base = stage(
        docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("points"), body.alias("b"))
        .select(F.monotonically_increasing_id().alias("rid"), "id", "points", F.sha2(F.col("b"), 256).alias("sha"), F.col("b").cast("binary").alias("body")),
        "exact-base",
    )
    digit = lambda at, width: F.substring("body", at + 1, width).alias("digit")
    at, width = 0, FIRST_DIGIT
    found = stage(_level(base.select("rid", F.lit(0).cast("long").alias("grp"), digit(0, width)), width), "exact-level")
    done = [found.filter("ended")]
    if left := found.filter("not ended").count():
        open_rows = found.filter("not ended").select("rid", "grp")
        bodies = stage(base.select("rid", "body").join(open_rows.select("rid").hint("merge"), "rid"), "exact-bodies")
        while left:  # levels, about log8 of the longest text in which two texts agree
            at, width = at + width, width * GROWTH
            rows = bodies.filter(F.octet_length("body") >= at).select("rid", digit(at, width)).join(open_rows.hint("merge"), "rid")
            found = stage(_level(rows, width), "exact-level")
            done.append(found.filter("ended"))
            open_rows = found.filter("not ended").select("rid", "grp")
            left = open_rows.count()
        drop_staged(bodies)
    head = base.select("rid", "id", "points", "sha")
    members = reduce(DataFrame.unionByName, done).select("rid", "grp").join(head.drop("sha"), "rid")
    best = members.groupBy("grp").agg(F.min(F.struct(-F.col("points"), "id", "rid")).alias("m"), F.count("*").alias("n")).select("grp", F.col("m.id").alias("keep_id"), F.col("m.rid").alias("keep_rid"), "n")
    decided = members.join(stage(best, "exact-groups").hint("merge"), "grp").select("rid", "keep_id", "keep_rid", "n")
    return head.join(decided, "rid", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
