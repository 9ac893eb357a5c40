"""Snapshot changes against set algebra over plain dictionaries."""

import random

from matchlake.operators.snapshots import fixture_changes, snapshot_changes

SCHEMA = "row_id bigint, edition_id int, snapshot_no int, match_id string, home_goals int, away_goals int, status string, s string, w int"


def brute(rows):
    state = {}
    for row, e, n, k, h, a, st, *_ in sorted(rows, key=lambda r: r[0]):
        if None in (e, n, k):
            continue
        state.setdefault(e, {}).setdefault(n, {})[k] = (h, a, None if st is None else st.strip().lower())
    out = set()
    for e, snaps in state.items():
        order = sorted(snaps)
        for before, now in zip(order, order[1:]):
            x, y = snaps[before], snaps[now]
            out |= {(e, now, k, "added") for k in y.keys() - x.keys()} | {(e, now, k, "removed") for k in x.keys() - y.keys()}
            out |= {(e, now, k, "changed") for k in x.keys() & y.keys() if x[k] != y[k]}
    return out


def test_random_snapshots(spark):
    r = random.Random(9)
    rows = []
    for i in range(3000):
        rows.append((i, r.choice([1, 1, 2, None]), r.choice([1, 2, 4, 7, 8, None]), r.choice([None, *[f"m{k}" for k in range(150)]]), r.choice([None, 0, 1]), r.choice([None, 0]), r.choice([None, "Finished", " finished", "scheduled"]), "s", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(x) for x in fixture_changes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_ordinals_persist_and_new_keys_are_appended(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.choice([1, 2]), n, f"m{r.randrange(40 * n)}", r.choice([None, 0, 1]), 0, "x", "s", 1) for i, n in enumerate(sorted(r.choice([1, 2, 3]) for _ in range(500)))]
    df = spark.createDataFrame(rows, SCHEMA)
    path = f"{tmp_path}/registry"
    seen = {}
    for upto in (1, 3, 3):
        got = {tuple(x) for x in fixture_changes(df.where(f"snapshot_no <= {upto}"), registry=path).collect()}
        assert got == brute([x for x in rows if x[2] <= upto])
        now = {(x["s"], x["k"]): x["o"] for x in spark.read.parquet(path).collect()}
        assert all(now[k] == v for k, v in seen.items())
        for series in (1, 2):
            own = sorted(o for (s, _), o in now.items() if s == series)
            assert own == list(range(len(own)))
        seen = now
    assert spark.read.parquet(path).count() == len(seen)  # a repeated run appends nothing


def test_vanishing_snapshot_words_and_empty_table(spark):
    rows = [(1, 1, 1, "a", 0, 0, "x", "", 0), (2, 1, 2, "b", 0, 0, "x", "", 0), (3, 1, 3, "a", 0, None, "x", "", 0)]
    assert {tuple(x) for x in fixture_changes(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
    assert fixture_changes(spark.createDataFrame([], SCHEMA)).count() == 0
