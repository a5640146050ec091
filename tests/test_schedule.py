"""Cron times."""

import datetime

import pytest

from sievespark.operators.schedule import next_time


@pytest.mark.parametrize(
    ("cron", "after", "want"),
    [
        ("* * * * *", "2026-01-01 00:00:30", "2026-01-01 00:01"),
        ("0 3 * * *", "2026-01-01 03:00:00", "2026-01-02 03:00"),
        ("*/15 9-10 * * 1-5", "2026-01-03 12:00:00", "2026-01-05 09:00"),
        ("0 0 13 * 5", "2026-02-01 00:00:00", "2026-02-06 00:00"),
        ("0 0 29 2 *", "2026-03-01 00:00:00", "2028-02-29 00:00"),
        ("5,10 0 1 1 7", "2026-01-01 00:05:00", "2026-01-01 00:10"),
    ],
)
def test_next_time(cron, after, want):
    assert next_time(cron, datetime.datetime.fromisoformat(after)) == datetime.datetime.fromisoformat(want)


def test_bad_or_empty():
    assert next_time("0 0 31 2 *", datetime.datetime(2026, 1, 1)) is None
    for cron in ("* * * *", "60 * * * *", "* * 0 * *", "a * * * *", "5-2 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            next_time(cron, datetime.datetime(2026, 1, 1))
