import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from revlake.functions import deltas, identity, periods, timekeys

D = dt.date


def test_period_ranges_and_predecessors():
    p = lambda s: periods.parse_period(s, D(2023, 5, 9))
    assert [p(s).previous().key for s in ("2023-Q1", "2023-01", "2023-H1", "2023-Q3", "2022")] == ["2022-Q4", "2022-12", "2022-H2", "2023-Q2", "2021"]
    assert p("last-10").range() == (D(2023, 4, 30), D(2023, 5, 9))
    assert p(" This-Quarter ").key == "2023-Q2" and p("2023-M11").key == "2023-11"
    assert p("2016-W01").previous().key == "2015-W53"
    for bad in ("spring", "2023-Q0", "2023-00", "2023-W53"):
        with pytest.raises(ValueError):
            p(bad)


def test_partial_windows():
    q = periods.parse_period("2023-Q4", D(2023, 10, 12))
    assert q.is_partial(D(2023, 10, 12)) and q.days_elapsed(D(2023, 10, 12)) == 12
    assert not q.is_partial(D(2023, 12, 31))
    w = periods.comparison_windows(periods.parse_period("2023-Q3", D(2023, 8, 1)), D(2023, 8, 1))
    assert (w.end, w.prev_end) == (D(2023, 8, 1), D(2023, 5, 2))


def test_local_keys(spark):
    """Against Python's zones, over both changes of the clock and the ends of the day line."""
    zones = ("Europe/Berlin", "America/St_Johns", "Australia/Lord_Howe", "Asia/Kathmandu", "Pacific/Auckland")
    instants = [dt.datetime(2023, m, d, h, 40, tzinfo=dt.UTC) for m, d in ((3, 26), (10, 29), (4, 2), (12, 31), (2, 28)) for h in (0, 1, 11, 23)]
    for zone in zones:
        want = [x.astimezone(ZoneInfo(zone)) for x in instants]
        rows = spark.createDataFrame([(k, x.strftime("%Y-%m-%d %H:%M:%S")) for k, x in enumerate(instants)], "k int, ts string").withColumn("ts", F.to_timestamp("ts"))
        got = rows.orderBy("k").select(timekeys.local_date_key(F.col("ts"), zone).alias("d"), timekeys.local_time_key(F.col("ts"), zone).alias("h")).collect()
        assert [(r["d"], r["h"]) for r in got] == [(x.date(), f"{x.hour:02d}:00") for x in want]
    now = F.to_timestamp(F.lit("2023-02-01 12:30"))
    assert spark.range(1).select(timekeys.last_complete_day(now, "Pacific/Auckland")).first()[0] == D(2023, 2, 1)
    assert timekeys.date_dimension(spark, D(2021, 1, 3), D(2021, 1, 3)).first()["week_key"] == "2020-W53"


def test_deltas(spark):
    df = spark.createDataFrame([(75, 60), (9, 9), (4, 0), (1, 8)], "c long, p long")
    assert [r[0] for r in df.select(deltas.render_delta(F.col("c"), F.col("p"))).collect()] == ["75 (+15, +25%)", "9 (no change)", "4 (+4)", "1 (-7, -88%)"]
    rows = spark.createDataFrame([(2, "mira", 31, 40, 1), (5, "tove", 6, 0, None), (3, "lint [bot]", 8, 8, 3)], "r int, n string, c long, p long, q int")
    assert [r[0] for r in rows.select(deltas.render_row(*map(F.col, "rncpq"))).collect()] == ["#2 mira — 31 (-9) [was #1]", "#5 tove — 6 (+6) [new]", "#3 lint [bot] — 8 (+0)"]


def test_identity(spark):
    known = spark.createDataFrame([("user:mira", "mira"), ("bot:lint", "lint"), ("user:lint", "lint")], "entity_key string, login string")
    asked = spark.createDataFrame([("MIRA ",), ("lint",), ("Team:Core",), ("tove",)], "login string")
    got = {tuple(r) for r in identity.resolve_logins(asked, known).collect()}
    assert got == {("MIRA ", "user:mira"), ("lint", "bot:lint"), ("lint", "user:lint"), ("Team:Core", "team:core"), ("tove", "user:tove")}
    keys = spark.createDataFrame([("Tove", "User"), ("lint[bot]", "User"), ("Lint", "Bot"), ("", "User"), (None, None)], "l string, t string")
    assert [r[0] for r in keys.select(identity.entity_key(F.col("l"), F.col("t"))).collect()] == ["user:tove", "bot:lint[bot]", "bot:lint", "user:ghost", "user:ghost"]
