import datetime as dt

import pytest
from pyspark.sql import functions as F

from revlake.functions import periods
from revlake.operators import boards, coverage, merge, metrics, quality, search
from revlake.plans import sqlsurface

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_coverage(spark):
    schema = "entity string, start date, end date, items long"
    r = spark.createDataFrame([("x", D(2022, 9, 11), D(2022, 9, 20), 3), ("x", D(2022, 9, 1), D(2022, 9, 4), 7), ("x", D(2022, 9, 5), D(2022, 9, 12), 2), ("x", D(2022, 9, 2), D(2022, 9, 3), 1)], schema)
    assert rows(coverage.merge_ranges(r)) == [("x", D(2022, 9, 1), D(2022, 9, 20), 13)]
    holes = spark.createDataFrame([("x", D(2022, 9, 3), D(2022, 9, 8), 1), ("x", D(2022, 9, 12), D(2022, 9, 13), 1), ("y", D(2022, 9, 1), D(2022, 9, 30), 1)], schema)
    assert rows(coverage.gaps(holes, F.lit(D(2022, 9, 15)))) == [("x", D(2022, 9, 9), D(2022, 9, 11)), ("x", D(2022, 9, 14), D(2022, 9, 15))]
    assert rows(coverage.gaps(r.limit(0), F.lit(D(2022, 9, 15)))) == []
    assert rows(coverage.recorded_until(holes, F.lit(D(2022, 9, 10)))) == [("x", D(2022, 9, 3), D(2022, 9, 8), 1), ("y", D(2022, 9, 1), D(2022, 9, 10), 1)]


def test_cursors_stay_below_rejects(spark):
    s = "src string, updated_at timestamp"
    t = lambda d: dt.datetime(2022, 5, d)
    old = spark.createDataFrame([("p", t(17)), ("q", t(3))], "src string, cursor timestamp")
    good, bad = spark.createDataFrame([("p", t(6)), ("q", t(28)), ("r", t(9))], s), spark.createDataFrame([("q", t(14)), ("s", t(2))], s)
    got = coverage.advance_cursors(old, good, bad, ["src"])
    assert rows(got) == [("p", t(17), t(17)), ("q", t(28), t(14)), ("r", t(9), t(9))]
    # the bad item is the newest: the cursor stays at what is kept; once it has landed the cursor takes all that came before
    late = spark.createDataFrame([("p", t(30)), ("r", t(20))], s)
    held = coverage.advance_cursors(got, good, late, ["src"])
    assert rows(held) == [("p", t(17), t(17)), ("q", t(28), t(28)), ("r", t(9), t(9))]
    # an open reject of an earlier load holds the cursor while newer items land; nothing accepted leaves it
    more = coverage.advance_cursors(got, spark.createDataFrame([("r", t(25))], s), spark.createDataFrame([("r", t(12)), ("q", t(14))], s), ["src"])
    assert rows(more) == [("p", t(17), t(17)), ("q", t(28), t(14)), ("r", t(25), t(12))]
    assert rows(coverage.advance_cursors(more, good.limit(0), bad.limit(0), ["src"])) == [("p", t(17), t(17)), ("q", t(28), t(28)), ("r", t(25), t(25))]


def test_capped_windows(spark):
    daily = spark.createDataFrame([(D(2022, 2, 7), 31), (D(2022, 2, 8), 12), (D(2022, 2, 9), 90), (D(2022, 3, 1), 40)], "day date, items long")
    got = rows(coverage.capped_windows(daily, F.lit(D(2022, 2, 7)), F.lit(D(2022, 3, 2)), 50))
    assert got == [(D(2022, 2, 7), D(2022, 2, 8), 43, False), (D(2022, 2, 9), D(2022, 2, 9), 90, True), (D(2022, 2, 10), D(2022, 2, 12), 0, False), (D(2022, 2, 13), D(2022, 2, 17), 0, False), (D(2022, 2, 18), D(2022, 2, 28), 0, False), (D(2022, 3, 1), D(2022, 3, 2), 40, False)]
    one = rows(coverage.capped_windows(daily, F.lit(D(2022, 2, 7)), F.lit(D(2022, 3, 2)), 50, depth=0))
    assert [r[2:] for r in one] == [(133, True), (40, False)]


def test_merge_policies_and_replay(spark):
    s = "k int, r string, f string, c string"
    old, new = spark.createDataFrame([(1, "a", "a", "a"), (2, "a", "a", "a")], s), spark.createDataFrame([(2, None, "b", None), (3, "b", "b", "b")], s)
    once = merge.merge(old, new, ["k"], ["r"], ["c"])
    assert rows(once) == [(1, "a", "a", "a"), (2, None, "a", "a"), (3, "b", "b", "b")]
    assert rows(merge.merge(once, new, ["k"], ["r"], ["c"])) == rows(once)


def test_boards_agree(spark):
    data = [(a, D(2026, 4, 1) if k % 3 else D(2026, 1, 5)) for a in range(30) for k in range(a % 7)]
    facts = spark.createDataFrame(data, "author long, created date").withColumn("all", F.lit(1))
    w = periods.comparison_windows(periods.parse_period("2026-Q2", D(2026, 7, 1)), D(2026, 7, 1))
    flat = boards.top_board(boards.board_counts(facts, "author", "created", w), 8)
    scoped = boards.scoped_boards(boards.board_counts(facts, "author", "created", w, ["all"]), ["all"], 8).drop("all")
    assert [str(r) for r in rows(flat)] == [str(r) for r in rows(scoped)]


def test_scorecard_excludes_own(spark):
    prs = spark.createDataFrame([(11, 5, D(2022, 2, 3), "MERGED", 70.0, 7.0), (12, 5, D(2022, 5, 6), "MERGED", 20.0, 2.0), (13, 5, D(2022, 6, 1), "OPEN", 11.0, 1.0), (14, 6, D(2022, 5, 30), "MERGED", 4.0, 0.0)], "pr_key long, author long, created date, state string, added double, removed double")
    rev = spark.createDataFrame([(12, 6, D(2022, 5, 7)), (14, 5, D(2022, 5, 31)), (12, 5, D(2022, 5, 8))], "pr_key long, reviewer long, submitted date")
    w = periods.comparison_windows(periods.parse_period("2022-Q2", D(2022, 7, 1)), D(2022, 7, 1))
    got = {r["measure"]: (r["current"], r["previous"]) for r in metrics.scorecard_authors(prs, metrics.activity(rev, rev.limit(0)), w).filter("author = 5").collect()}
    assert got == {"opened": (2, 1), "merged": (1, 1), "added": (31, 70), "removed": (3, 7), "reviews_given": (1, 0), "reviews_received": (1, 0)}


def test_search_scan_equals_postings(spark):
    c = spark.createDataFrame([("1", "Rotate expired signing certificates"), ("2", "Shorten the build"), ("3", "certificate store for Windows"), ("4", None)], "key string, text string")
    hits = search.search_corpus(c, ["text"], "ERTIFICAT", "pr")
    assert {r["key"] for r in hits.collect()} == {"1", "3"} and all("[" in r["snippet"] for r in hits.collect())
    keys = search.candidates(search.postings(c, "key", ["text"]), "key", "ertificat")
    again = search.search_corpus(c, ["text"], "ertificat", "pr", 20, keys)
    assert rows(hits) == rows(again)
    assert search.search_corpus(c, ["text"], "er", "pr").count() == 0


def test_a_hit_needs_its_fact_and_falls_back_to_its_author_key(spark):
    c = spark.createDataFrame([("1", "bot:lint", "cache warm-up"), ("2", "user:mira", "warm-up of caches"), ("9", "user:mira", "warm-up, lost")], "fact_key string, author_key string, body string")
    facts = spark.createDataFrame([("1", "a/x#1", "a/x", "one"), ("2", "a/y#2", "a/y", "two")], "fact_key string, key string, repo string, title string")
    people = spark.createDataFrame([("user:mira", "Mira", "user")], "entity_key string, login string, entity_type string")
    found = search.search_facts(c, ["body"], "warm-up", "pr", facts, people)
    assert rows(found, "key", "author", "author_type", "title") == [("a/x#1", "lint", "bot", "one"), ("a/y#2", "Mira", "user", "two")]
    assert rows(search.search_facts(c, ["body"], "warm-up", "pr", facts, people, "A/Y", 5), "key") == [("a/y#2",)]


def test_quality(spark):
    e = spark.createDataFrame([("user:a", "user", "a"), ("user:b", "bot", "b"), ("x:c", "x", "c")], "entity_key string, entity_type string, login string")
    assert rows(quality.entity_rule_breaks(e)) == [("user:b",), ("x:c",)]


def test_read_only_sql(spark, tmp_path):
    sqlsurface.register({"numbers": spark.range(5)})
    spark.range(5).write.parquet(f"{tmp_path}/t")
    got = sqlsurface.query_rows(spark, "SELECT id FROM numbers", 3)
    assert len(got.rows) == 3 and got.truncated
    good = "WITH a AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM numbers) SELECT * FROM a JOIN numbers USING (id) WHERE id IN (SELECT max(id) FROM numbers) OR id < 2 ORDER BY id LIMIT 9"
    assert len(sqlsurface.query_rows(spark, good).rows) == 3
    bad = ["", "DROP VIEW numbers", "INSERT INTO numbers VALUES (1)", "WITH x AS (SELECT 1) DELETE FROM numbers", "SET spark.x = 1", "EXPLAIN SELECT 1", f"SELECT * FROM parquet.`{tmp_path}/t`", "SELECT * FROM text.`/etc/hostname`", "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", "SELECT id FROM numbers WHERE reflect('java.lang.Math', 'abs', -1) = '1'", "SELECT try_reflect('java.lang.Math', 'abs', -1)"]
    for sql in bad:
        with pytest.raises(ValueError):
            sqlsurface.read_only(spark, sql)
