"""Attributes as known at event time against a scan of all versions per event."""

import random
from datetime import datetime, timedelta

from matchlake.operators.known_at import as_known, history_versions

T0 = datetime(2024, 1, 1)
VERSIONS = "version_id bigint, competition string, strength double, valid_from timestamp_ntz, valid_to timestamp_ntz, known_at timestamp_ntz, withdrawn_at timestamp_ntz"


def micros(t):
    return int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def brute(events, versions):
    out = {}
    for i, c, t in events:
        best = None
        for v, cc, _, a, b, k, w in versions:
            if None in (cc, a, k, c, t) or cc != c or not (a <= t and (b is None or t < b) and k <= t and (w is None or t < w)):
                continue
            best = max(best, (a, k, v)) if best else (a, k, v)
        out[i] = best[2] if best else None
    return out


def test_random_versions_match_a_full_scan(spark):
    r = random.Random(4)
    day = lambda n: T0 + timedelta(hours=6 * n)
    maybe = lambda n: None if r.random() < 0.4 else day(n)
    versions = [(i, r.choice(["A", "A", "B", None]), float(i), day(r.randrange(60)), maybe(r.randrange(80)), day(r.randrange(60)), maybe(r.randrange(80))) for i in range(1, 60)]
    events = [(i, r.choice(["A", "B", "C", None]), r.choice([None, *[day(n) for n in range(80)]])) for i in range(300)]
    ev = spark.createDataFrame([(i, c, None if t is None else micros(t), "x", "y") for i, c, t in events], "id bigint, competition string, at bigint, e string, t string")
    got = as_known(ev, spark.createDataFrame(versions, VERSIONS), "competition", "at", attributes=["strength"]).collect()
    assert {r["id"]: r["version_id"] for r in got} == brute(events, versions)
    assert all((r["known_strength"] is None) == (r["version_id"] is None) for r in got)
    assert {r["e"] for r in got} == {"x"}  # clashing names of the input survive


def test_ties_repeats_and_empty_tables(spark):
    same = [(1, "A", 1.0, T0, None, T0, None), (2, "A", 2.0, T0, None, T0, None), (3, "A", 3.0, T0, T0, T0, None)]
    v = spark.createDataFrame(same, VERSIONS)
    ev = spark.createDataFrame([(1, "A", micros(T0)), (1, "A", micros(T0)), (2, "A", micros(T0) - 1)], "id bigint, competition string, at bigint")
    assert sorted((r["id"], r["version_id"]) for r in as_known(ev, v, "competition", "at").collect() if r["version_id"]) == [(1, 2), (1, 2)]
    assert as_known(ev.limit(0), v, "competition", "at").count() == 0
    assert {r["version_id"] for r in as_known(ev, v.limit(0), "competition", "at").collect()} == {None}


def test_history_rows_without_a_stored_date_are_left_out(spark):
    h = spark.createDataFrame([(1, "2024-01-02T00:00:00Z", "A"), (2, "2024-01-02", "A"), (3, None, "A"), (4, "2024-13-02T00:00:00Z", "A")], "row_id bigint, date string, competition string")
    v = spark.createDataFrame([(7, "A", 1.0, T0, None, T0, None)], VERSIONS)
    assert [tuple(r) for r in history_versions(h, v).collect()] == [(1, 7)]
