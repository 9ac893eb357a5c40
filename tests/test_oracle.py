"""Every general query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
from matchlake.plans import data_queries, match_queries  # noqa: E402

QUERIES = data_queries.QUERIES | match_queries.QUERIES
SQL = data_queries.SQL | match_queries.SQL


def _cell(x):
    import pandas as pd

    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if hasattr(x, "dtype") and x.dtype.kind in "fiub":
        x = x.item()
    return f"{float(x):.6f}" if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    ours, theirs = QUERIES[name](spark, data).toPandas(), con.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    rows = [sorted(tuple(map(_cell, r)) for r in df[cols].itertuples(index=False)) for df in (ours, theirs)]
    assert rows[0] == rows[1]


def _unit(df, *columns):
    return all(0 <= x <= 1 for c in columns for x in df[c])


def _season(df):
    places = {"p_top8": 8, "p_playoff": 16, "p_eliminated": 12}
    return len(df) == 36 and all(abs(df[c].sum() - n) < 1e-3 for c, n in places.items()) and _unit(df, *places)


def _bracket(df):
    return len(df) in (0, 36) and (df.empty or (_season(df) and abs(df["p_champion"].sum() - 1) < 1e-9 and abs(df["expected_rank"].sum() - 666) < 1e-6))


#: What must hold of queries that have no twin.
INVARIANTS = {
    "p2_failures": lambda q, df: set(df["reason"]) <= {"quoting", "column_count", "bad_value"} and set(df["line_id"]) == set(q("p2_found")["line_id"]),
    "p4_found": lambda q, df: df["utc"].str.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ").all() and not df.duplicated(["tbl", "row_id"]).any(),
    "p4_undeclared": lambda q, df: (df["ambiguous"] + df["misread"] <= 0.1 * df["values"] + 5).all(),
    "league_monte_carlo_full": lambda q, df: _season(df),
    "projected_table_full": lambda q, df: sorted(df["place"]) == list(range(1, 37)),
    "knockout_bracket": lambda q, df: _bracket(df),
    "conditioned_bracket": lambda q, df: _bracket(df) and (df["p_round16"] == 1).sum() >= 9,
    "season_forecast": lambda q, df: _bracket(df),
    "poisson_map_fit": lambda q, df: abs(df["attack"]).max() <= 4 and not df["team"].duplicated().any(),
    "shot_blend_fit": lambda q, df: abs(df["attack"]).max() <= 4 and set(df["team"]) == set(q("poisson_map_fit")["team"]),
    "low_score_fit": lambda q, df: abs(df["rho"][0]) <= 0.2 and abs(df["elo"][0]) <= 0.01,
    "calibrator_fit": lambda q, df: len(df) <= 1 and (df.empty or abs(df["log_temperature"][0]) <= 1),
    "elo_replay": lambda q, df: _unit(df, "expected") and not df.duplicated(["cutoff", "row_id"]).any() and (df["date"].astype(str) < df["cutoff"]).all(),
    "elo_ratings": lambda q, df: df["rating"].between(1000, 2000).all(),
    "league_offsets": lambda q, df: (df.assign(x=df["offset"] * df["evidence"]).groupby("cutoff")["x"].sum().abs() < 1e-6).all(),
    "model_coverage": lambda q, df: set(df["issue"]) <= {"unknown", "sparse"},
    "rolling_evaluation": lambda q, df: df.empty or (len(df) == 12 and _unit(df, "ece") and (df["log_loss"] > 0).all() and df.groupby("fold")["n"].nunique().eq(1).all()),
    "model_decision": lambda q, df: len(df) == 1 and df["selected_model"][0] in ("poisson", "baseline", "low_score", "ensemble"),
    "known_schedule": lambda q, df: not df.duplicated(["edition_id", "match_id"]).any() and (df["home_goals"].isna() == (df["status"] == "scheduled")).all(),
}


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_invariants(spark, data, name):
    assert INVARIANTS[name](lambda other: QUERIES[other](spark, data).toPandas(), QUERIES[name](spark, data).toPandas())


def test_the_rest_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['matchlake.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p8_found' not in q; import matchlake.cli"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
