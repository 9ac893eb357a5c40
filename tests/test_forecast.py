"""From made-up records to a published forecast and back, and the selection's rules."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake import cli
from matchlake.operators import selection
from matchlake.operators import matches as M
from matchlake.plans import forecast, store

CUT = "2025-11-01 00:00:00"
TEAMS = [f"Team {i:02d}" for i in range(36)]


def played(n=900, seed=3, teams=TEAMS, start=datetime(2023, 1, 1), step=0.9):
    rng = np.random.default_rng(seed)
    s = np.linspace(0.7, -0.7, len(teams))
    rows = []
    for i in range(n):
        h, a = rng.choice(len(teams), 2, replace=False)
        at = start + timedelta(days=int(i * step), hours=int(rng.integers(12, 20)))
        rows.append((i, at, teams[h], teams[a], int(rng.poisson(np.exp(0.3 + s[h] - s[a]))), int(rng.poisson(np.exp(0.1 + s[a] - s[h]))), "UCL" if i % 2 else f"L{h % 3}", "s", None))
    return rows


HISTORY = "row_id bigint, date timestamp_ntz, home string, away string, home_goals int, away_goals int, competition string, source string, completed_at timestamp_ntz"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    h = spark.createDataFrame(played(), HISTORY)
    h = h.withColumn("date", F.concat(F.translate(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), " ", "T"), F.lit("Z")))
    for c in ("home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target", "odds_home", "odds_draw", "odds_away"):
        h = h.withColumn(c, F.lit(None).cast("double"))
    h.withColumn("retrieved_at", F.lit("2025-01-01").cast("timestamp_ntz")).write.parquet(f"{d}/history.parquet")
    rows = []
    for day in range(8):
        for i in range(18):
            x, y = (i, 18 + (i + day) % 18) if day % 2 == 0 else (18 + (i + day) % 18, i)
            over = day < 3
            at = datetime(2025, 9, 1, 19) + timedelta(days=14 * day)
            for snap, taken in ((1, datetime(2025, 8, 1)), (2, datetime(2025, 10, 20)), (3, datetime(2025, 11, 20))):
                done = over and snap > 1 or day == 3 and snap == 3
                rows.append((len(rows), 1, snap, taken, f"m{day}-{i}", at.strftime("%Y-%m-%dT%H:%M:%SZ"), "2025/26", "league", day + 1, TEAMS[x].upper() if False else TEAMS[x], TEAMS[y], (day + i) % 3 if done else None, i % 2 if done else None, "finished" if done else "scheduled", "s"))
    spark.createDataFrame(rows, "row_id bigint, edition_id int, snapshot_no int, taken_at timestamp_ntz, match_id string, date string, season string, stage string, matchday int, home string, away string, home_goals int, away_goals int, status string, source string").write.parquet(f"{d}/fixtures.parquet")
    spark.createDataFrame([(i, t, None) for i, t in enumerate(TEAMS)], "team_id bigint, name string, nickname string").write.parquet(f"{d}/teams.parquet")
    spark.createDataFrame([("s", 1, "UTC", "DMY")], "source string, trust_rank int, tz_name string, date_order string").write.parquet(f"{d}/sources.parquet")
    return str(d)


def run_cli(capsys, *args):
    code = cli.main(list(args))
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_a_published_run_is_reproduced_and_shown(spark, tables, tmp_path, capsys):
    root = str(tmp_path / "runs")
    common = ("--root", root, "--data", tables, "--cutoff", CUT, "--simulations", "300")
    code, out = run_cli(capsys, "simulate", "--name", "r1", *common, "--model", "poisson")
    assert code == 0 and out["model"] == "poisson" and len(out["favourites"]) == 3
    meta = store.metadata(spark, root, "r1")
    assert meta["known_results"] == 54 and meta["matchday"] == 3 and meta["diagnostics"]["score_sampling"] == "grids"  # the later delivery is not known
    assert run_cli(capsys, "reproduce", "--root", root, "--name", "r1") == (0, {"run_id": "r1", "hashes_valid": True, "probabilities_reproduced": True})
    got = spark.read.parquet(f"{root}/r1/probabilities").collect()
    strong = {r["team"]: r["expected_rank"] for r in got}
    assert np.mean([strong[t] for t in TEAMS[:9]]) + 8 < np.mean([strong[t] for t in TEAMS[-9:]])
    code, out = run_cli(capsys, "simulate", "--name", "r2", *common)
    assert code == 0 and store.metadata(spark, root, "r2")["evaluation"]["rolling"]["status"] == "ok"
    code, out = run_cli(capsys, "list", "--root", root)
    assert {r["run_id"] for r in out["runs"]} == {"r1", "r2"} and not out["issues"]
    page = tmp_path / "page.html"
    assert run_cli(capsys, "export", "--root", root, "--out", str(page))[0] == 0
    data = json.loads(page.read_text().split("const data = ")[1].split(";</script>")[0])
    assert data["run"] == "r2" and len(data["teams"]) == 36 and len(data["matches"]) == 144
    assert sum(m["p_home"] is not None for m in data["matches"]) == 90 and len(data["history"]) == 36  # one run per state of the data
    assert data["model"]["status"] == "ok" and data["model"]["ranking"][0][1] <= data["model"]["baseline_log_loss"]


@pytest.mark.parametrize("args", [("--simulations", "10"), ("--cutoff", "2999-01-01 00:00:00"), ("--matchday", "1"), ("--edition", "9")])
def test_bad_input_ends_with_status_one(tables, tmp_path, capsys, args):
    base = {"--root": str(tmp_path), "--data": tables, "--cutoff": CUT, "--model": "poisson", "--simulations": "100"} | dict([args])
    code, out = run_cli(capsys, "simulate", *[x for kv in base.items() for x in kv])
    assert code == 1 and out["error"]


def test_selection_reads_only_the_past(spark):
    rows = M.one_per_key(spark.createDataFrame(played(700), HISTORY))
    one = selection.select(rows, "2024-10-01 00:00:00")
    later = spark.createDataFrame([(9_000 + i, datetime(2024, 10, 5) + timedelta(hours=i), "Team 35", "Team 00", 9, 0, "UCL", "s", None) for i in range(50)], HISTORY)
    two = selection.select(rows.unionByName(later.select(*rows.columns)), "2024-10-01 00:00:00")
    assert one.status == "ok" and one.report() == two.report()
    table = {(r["fold"], r["model"]): r for r in one.scores.collect()}
    assert len(table) == 12 and {r["purpose"] for (f, _), r in table.items() if f == 2} == {"assessment"}
    assert all(table[f, "poisson"]["log_loss"] < table[f, "baseline"]["log_loss"] for f in range(3))
    assert all(table[f, "ensemble"]["log_loss"] <= min(table[f, "poisson"]["log_loss"], table[f, "low_score"]["log_loss"]) + 1e-9 for f in range(3))
    assert one.selected_model == "poisson" or one.selection_log_loss["poisson"] - one.selection_log_loss[one.selected_model] >= 0.005
    assert selection.select(rows.limit(50), "2024-10-01 00:00:00").status == "insufficient_data"
    with pytest.raises(ValueError):
        selection.select(rows, "2024-10-01 00:00:00", folds=1)


def test_a_calibration_is_promoted_only_on_an_unseen_fold(spark):
    rng = np.random.default_rng(8)

    def fold(f, n, honest):
        rows = []
        for i in range(n):
            p = (0.9, 0.06, 0.04)  # claimed
            k = rng.choice(3, p=p if honest else (0.5, 0.27, 0.23))
            rows.append((f, f * 1000 + i, *((1, 0), (0, 0), (0, 1))[k], *p))
        return rows

    schema = "fold int, row_id bigint, home_goals int, away_goals int, p_home double, p_draw double, p_away double"
    got = [selection.calibration(spark.createDataFrame(fold(0, 300, False) + fold(1, 300, honest) + fold(2, 100, honest), schema), 3) for honest in (False, True)]
    assert got[0]["promoted"] and got[0]["assessment"]["calibrated"]["log_loss"] < got[0]["assessment"]["base"]["log_loss"]
    assert not got[1]["promoted"] and got[1]["reason"] == "insufficient_selection_improvement"
    assert selection.calibration(spark.createDataFrame(fold(0, 20, True), schema), 3)["reason"] == "insufficient_class_coverage"


def test_the_hold_out_scores_every_match_after_the_split(spark):
    # The strong side wins until the 2,000th match of the hold-out and loses the other 1,000.
    strong_home, won = F.col("id") % 2 == 0, F.col("id") < 14_000
    goals = lambda home: F.when(home == won, 3).otherwise(0)
    rows = spark.range(15_000).select(
        F.col("id").alias("row_id"), (F.lit(datetime(2022, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("date"),
        F.when(strong_home, "Strong").otherwise("Weak").alias("home"), F.when(strong_home, "Weak").otherwise("Strong").alias("away"),
        goals(strong_home).alias("home_goals"), goals(~strong_home).alias("away_goals"), F.lit("L").alias("competition"),
    )
    got = selection.hold_out(rows, CUT)
    assert got["n_train"] == 12_000 and {m: s["n"] for m, s in got["models"].items()} == {"poisson": 3000, "baseline": 3000}
    assert got["selected_model"] == "baseline"


def test_forecasts_are_written_fold_by_fold(spark, monkeypatch):
    written = []
    plain = selection.materialize
    monkeypatch.setattr(selection, "materialize", lambda df, label: written.append(label) or plain(df, label))
    monkeypatch.setattr(selection.fit, "fit_goals", lambda rows, specs: [None] * len(specs))
    monkeypatch.setattr(selection.fit, "fit_low_scores", lambda rows, starts, bases: [None] * len(starts))
    monkeypatch.setattr(selection, "forecast", lambda fitted, test, **names: test.select(F.lit(names["fold"]).alias("fold"), "row_id"))
    rows = spark.createDataFrame(played(60), HISTORY)
    got = selection.fold_forecasts(rows, rows, [("2023-01-01 00:00:00", "2023-01-20 00:00:00"), ("2023-01-20 00:00:00", "2023-03-01 00:00:00")], "UCL")
    assert written == ["forecasts"] * 2 and {r["fold"]: r["count"] for r in got.groupBy("fold").count().collect()}.keys() == {0, 1}


def test_disputed_scores_raise_where_asked(spark):
    rows = spark.createDataFrame(played(200), HISTORY)
    schedule = rows.limit(1).select("row_id", "date", "home", "away", (F.col("home_goals") + 1).alias("home_goals"), "away_goals", F.lit("finished").alias("status"), F.lit(1).alias("matchday"), F.lit("x").alias("season"))
    assert forecast.conflicts(rows, schedule) == 1
    with pytest.raises(ValueError, match="disagree"):
        forecast.run(spark, rows, schedule, CUT, 100, kind="poisson")
