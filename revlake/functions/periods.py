"""Calendar periods: parsing one literal on the driver, comparison windows, and the same as columns over dates."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = dt.timedelta(days=1)


def _month_end(year: int, month: int) -> dt.date:
    return dt.date(year, month, calendar.monthrange(year, month)[1])


@dataclass(frozen=True)
class Period:
    """grain: year, half, quarter, month, week or rolling. For rolling, end and n days; otherwise year and n of the grain."""

    grain: str
    year: int
    n: int
    end: dt.date | None = None

    MONTHS = {"year": 12, "half": 6, "quarter": 3, "month": 1}

    @property
    def key(self) -> str:
        forms = {"year": f"{self.year}", "half": f"{self.year}-H{self.n}", "quarter": f"{self.year}-Q{self.n}", "month": f"{self.year}-{self.n:02d}", "week": f"{self.year}-W{self.n:02d}", "rolling": f"last-{self.n}"}
        return forms[self.grain]

    def range(self) -> tuple[dt.date, dt.date]:
        if self.grain == "rolling":
            return self.end - (self.n - 1) * DAY, self.end
        if self.grain == "week":
            monday = dt.date.fromisocalendar(self.year, self.n, 1)
            return monday, monday + 6 * DAY
        months = self.MONTHS[self.grain]
        return dt.date(self.year, months * (self.n - 1) + 1, 1), _month_end(self.year, months * self.n)

    def previous(self) -> Period:
        if self.grain == "rolling":
            return Period("rolling", self.year, self.n, self.end - self.n * DAY)
        if self.grain == "week":
            year, week, _ = (self.range()[0] - DAY).isocalendar()
            return Period("week", year, week)
        if self.n > 1:
            return Period(self.grain, self.year, self.n - 1)
        return Period(self.grain, self.year - 1, 12 // self.MONTHS[self.grain])

    def is_partial(self, today: dt.date) -> bool:
        start, end = self.range()
        return self.grain != "rolling" and start <= today < end

    def days_elapsed(self, today: dt.date) -> int:
        start, end = self.range()
        return max((min(end, today) - start).days + 1, 0)


def parse_period(text: str, today: dt.date) -> Period:
    """YYYY, YYYY-H1, YYYY-Q1, YYYY-MM, YYYY-M1, YYYY-W01, last-N, this-/previous- week|month|quarter|year; else ValueError."""
    said = text.strip().lower()
    if m := re.fullmatch(r"last-(\d+)", said):
        if int(m[1]) < 1:
            raise ValueError(f"not a period: {text!r}")
        return Period("rolling", today.year, int(m[1]), today)
    if m := re.fullmatch(r"(this|previous)-(week|month|quarter|year)", said):
        iso = today.isocalendar()
        now = {"week": Period("week", iso.year, iso.week), "month": Period("month", today.year, today.month), "quarter": Period("quarter", today.year, (today.month + 2) // 3), "year": Period("year", today.year, 1)}[m[2]]
        return now if m[1] == "this" else now.previous()
    if m := re.fullmatch(r"(\d{4})(?:-(?:(h)([12])|(q)([1-4])|(w)(\d{1,2})|m?(\d{1,2})))?", said):
        year = int(m[1])
        found = Period("half", year, int(m[3])) if m[2] else Period("quarter", year, int(m[5])) if m[4] else Period("week", year, int(m[7])) if m[6] else Period("month", year, int(m[8])) if m[8] else Period("year", year, 1)
        if found.grain == "month" and not 1 <= found.n <= 12:
            raise ValueError(f"not a period: {text!r}")
        found.range()  # raises for a week that the year lacks
        return found
    raise ValueError(f"not a period: {text!r}")


@dataclass(frozen=True)
class Windows:
    """Inclusive date ranges that a period and the one before it are compared over."""

    start: dt.date
    end: dt.date
    prev_start: dt.date
    prev_end: dt.date

    def current(self, d: Column) -> Column:
        return d.between(F.lit(self.start), F.lit(self.end))

    def previous(self, d: Column) -> Column:
        return d.between(F.lit(self.prev_start), F.lit(self.prev_end))

    def either(self, d: Column) -> Column:
        return self.current(d) | self.previous(d)


def comparison_windows(period: Period, today: dt.date) -> Windows:
    """The current window ends today at the latest; a partial period's predecessor is cut to as many days."""
    (start, end), (prev_start, prev_end) = period.range(), period.previous().range()
    if period.is_partial(today):
        prev_end = min(prev_end, prev_start + (period.days_elapsed(today) - 1) * DAY)
    return Windows(start, min(end, today), prev_start, prev_end)


def in_period(d: Column, period: Period) -> Column:
    """A date range, so that it reaches the scan."""
    start, end = period.range()
    return d.between(F.lit(start), F.lit(end))


def period_range(d: Column, grain: str) -> tuple[Column, Column, Column, Column]:
    """start, end, previous start and previous end of the period of a grain that holds a date."""
    if grain == "week":
        start = F.trunc(d, "week")
        return start, F.date_add(start, 6), F.date_sub(start, 7), F.date_sub(start, 1)
    months = Period.MONTHS[grain]
    start = F.make_date(F.year(d), (F.floor((F.month(d) - 1) / months) * months + 1).cast("int"), F.lit(1))
    return start, F.date_sub(F.add_months(start, months), 1), F.add_months(start, -months), F.date_sub(start, 1)


def grain_of_key(key: Column) -> Column:
    """Grain of a period key."""
    return (
        F.when(key.rlike(r"^\d{4}$"), "year").when(key.rlike(r"^\d{4}-H[12]$"), "half").when(key.rlike(r"^\d{4}-Q[1-4]$"), "quarter")
        .when(key.rlike(r"^\d{4}-\d{2}$"), "month").when(key.rlike(r"^\d{4}-W\d{2}$"), "week").when(key.rlike(r"^last-\d+$"), "rolling")
    )
