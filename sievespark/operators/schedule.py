"""When scans are due and which engines are alive."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFLINE_SECONDS = 900
_FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


def due(schedules: DataFrame, as_of: Column) -> DataFrame:
    """Enabled schedules that have never run or whose next time has come."""
    return schedules.where(F.col("enabled") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of)))


def _allowed(field: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        first, _, last = ("*" if span == "*" else span).partition("-")
        a, b = (low, high) if span == "*" else (int(first), int(last or (high if step else first)))
        if not low <= a <= b <= high or step and int(step) < 1:
            raise ValueError(f"{part!r} is outside {low}-{high}")
        out.update(range(a, b + 1, int(step or 1)))
    return out


def next_time(cron: str, after: datetime.datetime) -> datetime.datetime | None:
    """First minute strictly after ``after`` (UTC) that five cron fields allow; None if none comes within eight years.

    If both the day and the weekday are given, either is enough.
    """
    fields = cron.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    minutes, hours, days, months, weekdays = (_allowed(f, a, b) for f, (_, a, b) in zip(fields, _FIELDS))
    weekdays = {w % 7 for w in weekdays}
    either = fields[2] != "*" and fields[4] != "*"
    start = after.replace(second=0, microsecond=0) + datetime.timedelta(minutes=1)
    day = start.date()
    for _ in range(8 * 366):
        by_day, by_week = day.day in days, day.isoweekday() % 7 in weekdays
        if day.month in months and (by_day or by_week if either else by_day and by_week):
            floor = start.hour * 60 + start.minute if day == start.date() else 0
            at = next((h * 60 + n for h in sorted(hours) for n in sorted(minutes) if h * 60 + n >= floor), None)
            if at is not None:
                return datetime.datetime.combine(day, datetime.time(at // 60, at % 60))
        day += datetime.timedelta(days=1)
    return None


def next_run(cron: Column, after: Column) -> Column:
    """The next time of a schedule as a column; null for a schedule that can't be read or never fires."""

    @F.pandas_udf("timestamp")
    def run(crons: pd.Series, times: pd.Series) -> pd.Series:
        def one(cron, at):
            if cron is None or pd.isna(at):
                return None
            try:
                return next_time(cron, at.to_pydatetime())
            except ValueError:
                return None

        return pd.Series([one(c, t) for c, t in zip(crons, times)], dtype="datetime64[ns]")

    return run(cron, after)


def fleet(engines: DataFrame, as_of: Column, seconds: int = OFFLINE_SECONDS) -> DataFrame:
    """Engines with their state now: one that works but has been silent for too long is offline; one that never spoke is left."""
    silent = F.unix_timestamp(as_of) - F.unix_timestamp("last_heartbeat_at") > seconds
    lost = F.col("status").isin("active", "draining") & F.coalesce(silent, F.lit(False))
    return engines.withColumn("status", F.when(lost, "offline").otherwise(F.col("status")))
