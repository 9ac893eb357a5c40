"""Printed dates, one by one."""

import pytest

from matchlake.operators.timestamps import posteriors, printed_instants, read_timestamps, recovered_orders

SOURCES = [("uk", "Europe/London", "DMY"), ("us", "America/New_York", "MDY"), ("jp", "Asia/Tokyo", "YMD"), ("free", "UTC", None), ("nozone", None, "DMY")]
CASES = [
    ("2024-05-01T10:00:00Z", "uk", "2024-05-01T10:00:00Z"),
    ("2024-05-01T10:00:00.999Z", "uk", "2024-05-01T10:00:00Z"),
    ("2024-05-01 10:00:00.5+0530", "uk", "2024-05-01T04:30:00Z"),
    ("2024-05-01T10:00-04:00", "uk", "2024-05-01T14:00:00Z"),
    ("2024-05-01T10:00[America/New_York]", "uk", "2024-05-01T14:00:00Z"),
    ("2024-05-01T10:00[No/Where]", "uk", None),
    ("1 May 2024 10:00 CET", "uk", "2024-05-01T09:00:00Z"),
    ("1 May 2024 10:00 CEST", "uk", "2024-05-01T08:00:00Z"),
    ("1 May 2024 12:05 AM", "uk", "2024-04-30T23:05:00Z"),
    ("1 May 2024 12:05 PM", "uk", "2024-05-01T11:05:00Z"),
    ("1 May 2024 13:05 PM", "uk", None),
    ("May 1, 2024", "us", "2024-05-01T23:59:59Z"),
    ("03/04/2024 10:00", "uk", "2024-04-03T09:00:00Z"),
    ("03/04/2024 10:00", "us", "2024-03-04T15:00:00Z"),
    ("3-4-2024 10:00", "us", "2024-03-04T15:00:00Z"),
    ("31/02/2024 10:00", "uk", None),
    ("2024.03.04 10.00", "jp", "2024-03-04T01:00:00Z"),
    ("20240304T100000Z", "jp", "2024-03-04T10:00:00Z"),
    ("1709546400", "uk", "2024-03-04T10:00:00Z"),
    ("1709546400123", "uk", "2024-03-04T10:00:00Z"),
    ("Mon, 04 Mar 2024 10:00:00 -0500", "uk", "2024-03-04T15:00:00Z"),
    # a time that occurs twice means the first, a skipped one moves forward by the gap
    ("2024-10-27 01:30:00", "uk", "2024-10-27T00:30:00Z"),
    ("2024-03-31 01:30:00", "uk", "2024-03-31T01:30:00Z"),
    ("2024-11-03T01:30", "us", "2024-11-03T05:30:00Z"),
    ("2024-05-01T10:00", "nozone", None),
    ("2024-05-01T10:00", "unknown", None),
    ("2024-05-01", "unknown", "2024-05-01T23:59:59Z"),
    ("postponed", "uk", None),
    ("", "uk", None),
    (None, "uk", None),
    ("0000-00-00", "uk", None),
    ("9" * 5000, "uk", None),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "source string, tz_name string, date_order string")


def test_cases(spark, sources):
    rows = spark.createDataFrame([(i, d, s, "kept") for i, (d, s, _) in enumerate(CASES)], "row_id bigint, date string, source string, ts_utc string")
    got = {r["row_id"]: r["ts_utc"] for r in read_timestamps(rows, sources).collect()}
    assert {(CASES[i][0], CASES[i][1]): v for i, v in got.items()} == {(d, s): e for d, s, e in CASES}


def test_time_of_day_and_repeats(spark, sources):
    rows = spark.createDataFrame([(1, "2024-05-01T23:59:59Z", "uk"), (1, "2024-05-01T23:59:59Z", "uk"), (2, "2024-05-01", "uk"), (3, "2024-05-01T10:00", "uk")], "row_id bigint, date string, source string")
    got = sorted((r["row_id"], r["ts_has_time"]) for r in read_timestamps(rows, sources).collect())
    assert got == [(1, False), (1, False), (2, False), (3, True)]
    assert printed_instants({"history": rows}, sources).count() == 2
    assert printed_instants({"history": rows.limit(0)}, sources).count() == 0


def taken(spark, *counts):
    got = posteriors(spark.createDataFrame(counts, "source_key string, declared string, candidates string, n bigint")).collect()
    return {(r["source_key"], r["candidates"]): None if r["at"] is None else r["candidates"].split("|")[r["at"]] for r in got}


def test_order_is_learned_where_none_is_declared(spark):
    both, first = "DMY:2024|MDY:2024", "DMY:2024"
    got = taken(spark, ("a", None, both, 40), ("a", None, first, 60), ("b", None, both, 3))
    assert got["a", both] == "DMY:2024"  # the sure values of the source teach the unsure ones
    assert got["b", both] is None  # nothing speaks for either: ambiguous


def test_a_declared_order_is_strong_but_not_absolute(spark):
    both, other = "DMY:2024|MDY:2024", "DMY:2024"
    got = taken(spark, ("few", "MDY", both, 400), ("few", "MDY", "MDY:2024", 500), ("few", "MDY", other, 10), ("many", "MDY", both, 40), ("many", "MDY", other, 60))
    assert got["few", both] == "MDY:2024" and got["few", other] is None  # a few contradictions are misprints
    assert got["many", other] == "DMY:2024" and got["many", both] is None  # a source that never follows its declaration


def test_years_settle_centuries_units_and_orders(spark):
    sure = [("s", None, f"ISO:{y}", 50) for y in (2023, 2024)]
    texts = ["DMY:2024|DMY:1924|MDY:2024|MDY:1924|YMD:2005|YMD:1905", "SECONDS:2024|MILLIS:1970|MICROS:1970|NANOS:1970", "MILLIS:2023|MICROS:1970|NANOS:1970", "DMY:2010|DMY:1910|YMD:2023|YMD:1923", "SECONDS:1970|MILLIS:1970|MICROS:1970|NANOS:1970"]
    got = taken(spark, *sure, *[("s", None, t, 1) for t in texts])
    assert [got["s", t] for t in texts] == [None, "SECONDS:2024", "MILLIS:2023", "YMD:2023", "SECONDS:1970"]


def test_ambiguity_is_marked(spark, sources):
    rows = spark.createDataFrame([(1, "03/04/2024 10:00", "free")], "row_id bigint, date string, source string")
    assert [r["ts_status"] for r in read_timestamps(rows, sources).collect()] == ["ambiguous"]


def test_all_parses_share_one_mixture(spark):
    src = spark.createDataFrame([("s", "UTC", None)], "source string, tz_name string, date_order string")
    rows = [("13/05/24", "2024-05-13T23:59:59Z"), ("05/05/24", "2024-05-05T23:59:59Z"), ("04/03/24", "2024-03-04T23:59:59Z"), ("1709546400", "2024-03-04T10:00:00Z"), ("29/02/2023", None), ("2|3|2024", None), ("epoch|5|||||||", None)]
    rows += [(f"2{k % 9 + 1}/0{k % 6 + 1}/2024", None) for k in range(30)]
    df = spark.createDataFrame([(i, d, "s") for i, (d, _) in enumerate(rows)], "row_id bigint, date string, source string")
    got = {r["row_id"]: r for r in read_timestamps(df, src).collect()}
    assert all(got[i]["ts_utc"] == e for i, (_, e) in enumerate(rows[:7]))
    assert got[2]["ts_reading"] == "DMY" and 0.95 <= got[2]["ts_posterior"] < 1 and got[4]["ts_status"] == "impossible" and got[5]["ts_status"] == "unreadable"


def test_orders_are_recovered_without_declarations(spark, sources):
    rows = [(f"{k % 28 + 1:02d}/{k % 12 + 1:02d}/2024 10:00", "uk") for k in range(60)] + [(f"{k % 12 + 1:02d}/{k % 28 + 1:02d}/2024 10:00", "us") for k in range(60)]
    got = {r["source"]: r for r in recovered_orders(spark.createDataFrame(rows, "date string, source string"), sources).collect()}
    assert set(got) == {"uk", "us"} and all(r["misread"] == 0 and r["ambiguous"] == 0 and r["values"] > 40 for r in got.values())
