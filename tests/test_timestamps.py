import datetime as dt

import pytest

from hirelake.functions.timestamps import with_utc

UTC = dt.timezone.utc
ANCHOR = dt.datetime(2025, 6, 15, 3, 30, tzinfo=UTC)
CASES = [
    # value, zone, locale, expected
    ("2025-01-31", "Europe/Berlin", "de-DE", "2025-01-30 23:00:00"),
    ("2025-02-30", "Europe/Berlin", "de-DE", None),
    ("0000-00-00", "Europe/Berlin", "de-DE", None),
    ("2024-02-29", "UTC", "en-IE", "2024-02-29 00:00:00"),
    ("2023-02-29", "UTC", "en-IE", None),
    ("2025-03-30 02:30:00", "Europe/Berlin", "de-DE", "2025-03-30 01:30:00"),  # never occurs: offset before the change
    ("2025-10-26 02:30:00", "Europe/Berlin", "de-DE", "2025-10-26 00:30:00"),  # occurs twice: the first
    ("2025-01-02T03:04:05.123456789+05:30", "UTC", "en-IN", "2025-01-01 21:34:05.123456"),
    ("2025-01-02T03:04:05-0500", "UTC", "en-US", "2025-01-02 08:04:05"),
    ("2025-07-01 12:00 EST", "America/New_York", "en-US", "2025-07-01 17:00:00"),
    ("2025-07-01 12:00 IST", "Europe/Dublin", "en-IE", "2025-07-01 11:00:00"),
    ("2025-07-01 12:00 IST", "Asia/Kolkata", "en-IN", "2025-07-01 06:30:00"),
    ("2025-07-01 12:00 UTC+5:30", "UTC", "en-IN", "2025-07-01 06:30:00"),
    ("20250120T012025Z", "Asia/Kolkata", "en-IN", "2025-01-20 01:20:25"),
    ("03/04/2025", "UTC", "en-US", "2025-03-04 00:00:00"),
    ("03/04/2025", "UTC", "en-IE", "2025-04-03 00:00:00"),
    ("31/11/2025", "UTC", "en-IE", None),
    ("1/2/25 12:05 AM", "UTC", "en-US", "2025-01-02 00:05:00"),
    ("3. März 2025, 13:59 Uhr", "Europe/Berlin", "de-DE", "2025-03-03 12:59:00"),
    ("25 de diciembre de 2024", "UTC", "es-ES", "2024-12-25 00:00:00"),
    ("April 1, 2025 at 12:00 pm", "UTC", "en-IE", "2025-04-01 12:00:00"),
    ("Fri, 02 May 2025 23:59:47 GMT", "Asia/Kolkata", "en-IN", "2025-05-02 23:59:47"),
    ("1736438364", "Asia/Kolkata", "en-IN", "2025-01-09 15:59:24"),
    ("1736241429152", "UTC", "en-IE", "2025-01-07 09:17:09.152000"),
    ("3 hours ago", "UTC", "en-IE", "2025-06-15 00:30:00"),
    ("2 days ago", "America/New_York", "en-US", "2025-06-12 04:00:00"),
    ("vor 2 Tagen", "Europe/Berlin", "de-DE", "2025-06-12 22:00:00"),
    ("Yesterday", "UTC", "en-IE", "2025-06-14 00:00:00"),
    ("open until filled", "UTC", "en-IE", None),
    ("", "UTC", "en-IE", None),
    (" \t", "UTC", "en-IE", None),
    ("x" * 100_000, "UTC", "en-IE", None),
    (None, "UTC", "en-IE", None),
    ("2025-01-31", None, None, "2025-01-31 00:00:00"),
]


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, z string, l string, a timestamp, utc string")
    return {r.i: r for r in with_utc(df, "v", "z", "l", "a", out="us").collect()}


def test_cases(spark):
    got = run(spark, [(v, z, loc, ANCHOR, "clash") for v, z, loc, _ in CASES])
    for i, (v, _, _, want) in enumerate(CASES):
        us = None if want is None else int((dt.datetime.fromisoformat(want).replace(tzinfo=UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(microseconds=1))
        assert got[i].us == us, v
        assert got[i].utc == "clash"


def test_relative_without_anchor_repeats_and_empty(spark):
    got = run(spark, [("2 days ago", "UTC", "en-IE", None, ""), ("2025-01-01", "UTC", "en-IE", None, ""), ("2025-01-01", "UTC", "en-IE", None, "")])
    assert got[0].us is None and got[1].us == got[2].us
    assert run(spark, []) == {}


@pytest.mark.parametrize("zone", ["Europe/Dublin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_against_zoneinfo(spark, zone):
    from zoneinfo import ZoneInfo

    base = dt.datetime(2024, 12, 30)
    values = [(base + dt.timedelta(hours=7 * i, minutes=13 * i)).strftime("%Y-%m-%dT%H:%M:%S") for i in range(1400)]
    got = run(spark, [(v, zone, "en-IE", None, "") for v in values])
    for i, v in enumerate(values):
        local = dt.datetime.fromisoformat(v).replace(tzinfo=ZoneInfo(zone))
        want = (local.replace(tzinfo=None) - local.utcoffset() - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        assert got[i].us == want, v
