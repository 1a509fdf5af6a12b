"""Calendar-correct recurrence: fixed durations for seconds to hours, calendar steps from days on."""

from __future__ import annotations

import calendar
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds of a unit; months and years by their shortest (fixed values).
UNIT_MS = {"SECOND": 1_000, "MINUTE": 60_000, "HOUR": 3_600_000, "DAILY": 86_400_000, "MONTHLY": 28 * 86_400_000, "YEARLY": 365 * 86_400_000}
_PART = {"YEARLY": 0, "MONTHLY": 1, "DAILY": 3, "HOUR": 4, "MINUTE": 5, "SECOND": 6}


def next_after_sql(at: Column, unit: Column, amount: Column) -> Column:
    """Next run in UTC; a day past a month's end becomes its last day.  Null units have no next run."""
    out = F.when(F.lit(False), at)
    for name, i in _PART.items():
        parts = [amount if k == i else F.lit(0) for k in range(7)]
        out = out.when(unit == name, at + F.make_interval(*parts))
    return out


def next_after(at_ms: int, unit: str, amount: int, zone: str = "UTC") -> int:
    """Next run in a time zone, in epoch milliseconds.

    Calendar steps keep the local time of day; a time that a clock change
    leaves out moves forward by the change, one that occurs twice is the first
    unless the start was in the second.
    """
    if amount <= 0:
        raise ValueError("amount must be positive")
    if unit in ("SECOND", "MINUTE", "HOUR"):
        return at_ms + UNIT_MS[unit] * amount
    tz = ZoneInfo(zone)
    start = (datetime.fromtimestamp(at_ms // 1000, UTC) + timedelta(milliseconds=at_ms % 1000)).astimezone(tz)
    local = start.replace(tzinfo=None)
    if unit == "DAILY":
        local += timedelta(days=amount)
    else:
        months = local.year * 12 + local.month - 1 + amount * (12 if unit == "YEARLY" else 1)
        year, month = divmod(months, 12)
        local = local.replace(year=year, month=month + 1, day=min(local.day, calendar.monthrange(year, month + 1)[1]))
    aware = local.replace(tzinfo=tz, fold=start.fold)
    if aware.astimezone(UTC).astimezone(tz).replace(tzinfo=None) != local:  # in a gap: read with the offset before it
        aware = local.replace(tzinfo=tz, fold=0)
    out = aware.astimezone(UTC)
    return int(out.replace(microsecond=0).timestamp()) * 1000 + out.microsecond // 1000


def next_after_zoned(at_ms: Column, unit: Column, amount: Column, zone: Column) -> Column:
    @F.pandas_udf("long")
    def run(a: pd.Series, u: pd.Series, n: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([next_after(int(x), y, int(k), w) if isinstance(y, str) else None for x, y, k, w in zip(a, u, n, z, strict=True)], dtype="Int64")

    return run(at_ms, unit, amount, zone)


def min_interval_ms(unit: Column, amount: Column) -> Column:
    """Shortest interval of a rule; overflow fails (ANSI arithmetic)."""
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for name, ms in UNIT_MS.items():
        out = out.when(unit == name, F.lit(ms).cast("long") * amount)
    return out
