"""Current against previous: delta, percent, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delta(current: Column, previous: Column) -> Column:
    return current - previous


def delta_percent(current: Column, previous: Column) -> Column:
    """Null where previous is 0."""
    return F.when(previous != 0, (current - previous) / previous * 100)


def render_delta(current: Column, previous: Column) -> Column:
    """42 (+8, +24%) · 5 (no change) · 3 (+3)."""
    d, p = delta(current, previous), delta_percent(current, previous)
    return F.when(d == 0, F.format_string("%d (no change)", current)).when(p.isNull(), F.format_string("%d (%+d)", current, d)).otherwise(F.format_string("%d (%+d, %+.0f%%)", current, d, p))


def rank_note(rank: Column, previous: Column) -> Column:
    return F.when(previous.isNull(), " [new]").when(previous != rank, F.format_string(" [was #%d]", previous)).otherwise("")


def render_row(rank: Column, name: Column, current: Column, previous: Column, rank_previous: Column) -> Column:
    """#1 alice — 42 (+8) [was #3]."""
    return F.concat(F.format_string("#%d %s — %d (%+d)", rank, name, current, delta(current, previous)), rank_note(rank, rank_previous))
