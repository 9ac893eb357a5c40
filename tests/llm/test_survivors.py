"""Survivors against a sort of every group."""

import random
from datetime import datetime, timedelta

from matchlake.llm.survivors import match_groups, match_survivors

SOURCES = [("a", "UTC", "DMY", 1), ("b", "Europe/London", "DMY", 2), ("c", "UTC", "DMY", 2), ("n", "UTC", "DMY", None)]
SCHEMA = """row_id bigint, date string, home string, away string, home_goals int, away_goals int, competition string, source string, home_shots double,
away_shots double, odds_home double, odds_draw double, odds_away double, retrieved_at timestamp_ntz, day int, priority string"""
T0 = datetime(2024, 5, 1)


def frames(spark, rows):
    h = spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)
    teams = spark.createDataFrame([(1, "Real Alfadel", None), (2, "SK Betamor", None)], "team_id bigint, name string, nickname string")
    return h, teams, spark.createDataFrame(SOURCES, "source string, tz_name string, date_order string, trust_rank int")


def test_random_groups(spark):
    r = random.Random(1)
    dates = ["2024-05-01T10:00:00Z", "2024-05-01T23:59:59Z", "1 May 2024", "2024-05-02T00:10:00Z", "01/05/2024 12:00", None, "junk"]
    rows = []
    for i in range(200):
        rows.append((i, r.choice(dates), r.choice(["Real Alfadel", "R. Alfadel", "Guest"]), r.choice(["SK Betamor", "SK Betamro"]), 1, 0, r.choice(["X", "Y", None]), r.choice(["a", "b", "c", "n", "z", None]), r.choice([None, 3.0, -1.0, float("nan"), float("inf"), 0.0]), None, None, None, None, r.choice([None, T0, T0 + timedelta(days=1)])))
    # a wall time of an unknown source means no instant
    rows = [x for x in rows if not (x[1] == "01/05/2024 12:00" and x[7] in ("z", None))]
    rank = {"a": 1, "b": 2, "c": 2}
    groups = {}
    for x in rows:
        day = {"2024-05-02T00:10:00Z": 2, None: None, "junk": None}.get(x[1], 1)
        if day and x[2] != "Guest" and x[6]:
            groups.setdefault((day, x[6]), []).append(x)
    want = set()
    for g in groups.values():
        if len(g) >= 2:
            g.sort(key=lambda x: (-rank.get(x[7], 10**9), x[13] is not None, x[13] or T0, x[0]), reverse=True)
            shots = [x[0] for x in g if x[8] is not None and 0 <= x[8] < float("inf")]
            timed = [x[0] for x in g if x[1] in ("2024-05-01T10:00:00Z", "01/05/2024 12:00", "2024-05-02T00:10:00Z")]
            want.add((min(x[0] for x in g), g[0][0], shots[0] if shots else -1, timed[0] if timed else g[0][0]))
    h, teams, sources = frames(spark, rows)
    assert want and {tuple(x) for x in match_groups(h, teams, sources).collect()} == want


def test_built_record_and_empty_table(spark):
    rows = [
        (1, "2024-05-01", "Real Alfadel", "SK Betamor", 2, 1, "X", "a", None, None, 1.5, None, 2.0, T0),
        (2, "2024-05-01T10:00:00Z", "R. Alfadel", "SK Betamor", 3, 1, "X", "b", 7.0, 5.0, 1.4, 3.0, 2.5, T0),
        (2, "2024-05-01T10:00:00Z", "R. Alfadel", "SK Betamor", 3, 1, "X", "b", 7.0, 5.0, 1.4, 3.0, 2.5, T0),
    ]
    h, teams, sources = frames(spark, rows)
    one = match_survivors(h, teams, sources).collect()
    assert len(one) == 1
    got = one[0].asDict()
    assert (got["home_goals"], got["home_shots"], got["odds_home"], got["source"], got["n_rows"]) == (2, 7.0, 1.4, "a", 3)
    assert got["seconds"] == int((datetime(2024, 5, 1, 10) - datetime(1970, 1, 1)).total_seconds())
    assert match_groups(h.limit(0), teams, sources).count() == 0
    assert match_groups(h, teams.limit(0), sources).count() == 0
