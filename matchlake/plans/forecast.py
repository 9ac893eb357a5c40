"""From records to a published forecast: schedule and matches as of a cutoff, the selected model, the simulation.

Everything that is published is computed from what was known strictly before the cutoff, and a published run holds all
that is needed to compute it again.
"""

from __future__ import annotations

import json
import platform
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import matchlake
from matchlake.operators import bracket_state, fit, selection, simulate
from matchlake.operators import matches as M
from matchlake.operators.models import Model, from_payload
from matchlake.operators.timestamps import read_timestamps
from matchlake.plans import store
from matchlake.util import lookup_join, materialize, ntz_from_unix

FEW_MATCHES, STALE_DAYS, LEAST_HISTORY = 20, 45, 100
COMPLETED_AFTER = "INTERVAL '3' HOUR"


def schedules_as_of(fixtures: DataFrame, sources: DataFrame, spellings: DataFrame, cutoff: str, matchday: int = 8) -> DataFrame:
    """The matches of every edition as its deliveries before the cutoff show them, one row per pair of known teams.

    ``spellings(typed, name)`` resolves sides. A match keeps the last delivery it is in; of two listings of a pair the
    one delivered last counts; scores are masked unless they were known before the cutoff and up to ``matchday``.
    """
    at = F.lit(cutoff).cast("timestamp_ntz")
    rows = read_timestamps(fixtures.where(F.col("taken_at") < at), sources)
    for side in ("home", "away"):
        rows = lookup_join(rows, spellings.toDF(side, f"{side}_name"), [side], "left")
    last = rows.groupBy("edition_id", "match_id").agg(
        F.max(F.struct("snapshot_no", "row_id", ntz_from_unix(F.col("ts_seconds")).alias("date"), "season", "matchday", "home_goals", "away_goals", F.lower(F.trim("status")).alias("status"))).alias("m"),
        F.mode("home_name").alias("home"),
        F.mode("away_name").alias("away"),
    )
    last = last.where("home is not null and away is not null and home <> away and m.date is not null").select("edition_id", "match_id", "m.*", "home", "away")
    one = last.groupBy("edition_id", F.least("home", "away").alias("x"), F.greatest("home", "away").alias("y")).agg(F.max_by(F.struct(*[c for c in last.columns if c != "edition_id"]), F.struct("snapshot_no", "row_id")).alias("m")).select("edition_id", "m.*")
    seen = F.coalesce((F.col("date") + F.expr(COMPLETED_AFTER) < at) & (F.col("matchday") <= matchday) & (F.col("status") == "finished") & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull(), F.lit(False))
    known = {c: F.when(seen, F.col(c)) for c in ("home_goals", "away_goals")}
    return one.withColumns(known | {"status": F.when(seen, "finished").otherwise("scheduled")}).drop("snapshot_no")


def schedule_as_of(fixtures: DataFrame, sources: DataFrame, spellings: DataFrame, edition: int, cutoff: str, matchday: int = 8) -> DataFrame:
    return schedules_as_of(fixtures.where(F.col("edition_id") == edition), sources, spellings, cutoff, matchday)


def complete_editions(schedules: DataFrame) -> DataFrame:
    """(edition_id, season) of editions with a whole schedule: 36 teams with eight matches each."""
    sides = schedules.select("edition_id", "season", F.explode(F.array("home", "away")).alias("team"))
    teams = sides.groupBy("edition_id", "team").agg(F.count("*").alias("n"), F.max("season").alias("season"))
    return teams.groupBy("edition_id").agg(F.max("season").alias("season"), F.count("*").alias("teams"), F.bool_and(F.col("n") == 8).alias("fine")).where("teams = 36 and fine").select("edition_id", "season")


def training(matches: DataFrame, schedule: DataFrame, cutoff: str) -> DataFrame:
    """History over before the cutoff with the schedule's finished matches, one row per day and sides; sources that
    disagree about a score raise."""
    played = schedule.where("status = 'finished'").select("row_id", "date", "home", "away", "home_goals", "away_goals", F.lit("UCL").alias("competition"), F.lit("schedule").alias("source"), (F.col("date") + F.expr(COMPLETED_AFTER)).alias("completed_at"))
    return M.training_set(matches, played, cutoff)


def conflicts(matches: DataFrame, schedule: DataFrame) -> int:
    played = schedule.where("status = 'finished'").select("row_id", "date", "home", "away", "home_goals", "away_goals", F.lit("UCL").alias("competition"), F.lit("schedule").alias("source"))
    return M.score_conflicts(M.training_union(matches, played)).count()


def season_of(schedule: DataFrame, model: Model) -> simulate.Season:
    """The schedule with the model's rates and grids of every ordered pair; at most 144 rows and 2,520 pairs."""
    rows = schedule.select("home", "away", "home_goals", "away_goals").orderBy("home", "away").limit(145).toPandas()
    teams = sorted({*rows["home"], *rows["away"]})
    if len(teams) != 36 or len(rows) != 144:
        raise ValueError(f"a season has 36 teams and 144 matches, the schedule {len(teams)} and {len(rows)}")
    at = {t: i for i, t in enumerate(teams)}
    pairs = schedule.sparkSession.createDataFrame([(h, a, bool(z)) for h in teams for a in teams if h != a for z in (0, 1)], "home string, away string, neutral boolean")
    rates, grids = np.full((2, 36, 36, 2), np.nan), np.full((36, 36, 169), np.nan)
    for r in model.grids(pairs).select("home", "away", "neutral", "home_rate", "away_rate", "grid").toPandas().itertuples(index=False):
        rates[int(r.neutral), at[r.home], at[r.away]] = r.home_rate, r.away_rate
        if not r.neutral:
            grids[at[r.home], at[r.away]] = r.grid
    goals = [rows[c].fillna(-1).astype(int).to_numpy() for c in ("home_goals", "away_goals")]
    return simulate.Season(teams, rows["home"].map(at).to_numpy(), rows["away"].map(at).to_numpy(), *goals, rates, grids=grids)


def coverage_report(history: DataFrame, teams: DataFrame, cutoff: str) -> tuple[DataFrame, list[str]]:
    """(team, matches, latest) of the season's teams, and a warning for each that is thinly or not lately covered."""
    got = M.by_side(history).groupBy("team").agg(F.count("*").alias("matches"), F.max("date").alias("latest"))
    rows = teams.join(got, "team", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    stale = F.coalesce(F.col("latest") < F.lit(cutoff).cast("timestamp_ntz") - F.expr(f"INTERVAL '{STALE_DAYS}' DAY"), F.lit(False))
    warnings = []
    for r in rows.select("team", "matches", "latest", stale.alias("stale")).orderBy("team").collect():  # 36 teams
        if r["matches"] < FEW_MATCHES:
            warnings.append(f"{r['team']}: only {r['matches']} matches")
        if r["stale"]:
            warnings.append(f"{r['team']}: no match in the {STALE_DAYS} days before the cutoff")
    return rows, warnings


def run(spark: SparkSession, matches: DataFrame, schedule: DataFrame, cutoff: str, simulations: int = 20_000, seed: int = 42, kind: str = "auto", state: dict | None = None, folds: int = 3, strict: bool = True) -> tuple[DataFrame, dict, dict]:
    """(probabilities, metadata, the rest of what is published) of a forecast as of the cutoff.

    Sources that disagree about a score, and teams without four matches at home and four away, raise where ``strict``;
    else the schedule, then the later row counts, the metadata say how many scores are disputed, and venues may have
    been switched.
    """
    if isinstance(simulations, bool) or not isinstance(simulations, int) or simulations < 100:
        raise ValueError("at least 100 simulations are needed")
    if kind not in ("auto", "poisson", "baseline", "low_score"):
        raise ValueError("kind must be auto, poisson, baseline or low_score")
    disputed = conflicts(matches, schedule)
    if disputed and strict:
        raise ValueError("sources disagree about a score")
    history = materialize(training(matches, schedule, cutoff), "history")
    n = history.count()
    if n < LEAST_HISTORY:
        raise ValueError(f"{n} matches are too few to train on")
    report: dict = {"status": "not_evaluated"}
    decision = {"selected_model": kind}
    if kind == "auto":
        report, rolling = selection.evaluated(history, cutoff, folds)
        decision = {"selected_model": report["selected_model"], "ensemble_weight": rolling.ensemble_weight, "calibration": rolling.calibration}
    model = fit.fit_selected(history, cutoff, decision)
    season = season_of(schedule, model)
    season.balanced = strict
    if state is not None:
        season = bracket_state.applied(season, state, cutoff)
    result = materialize(simulate.simulate(spark, season, simulations, seed), "probabilities")
    teams = spark.createDataFrame([(t,) for t in season.teams], "team string")
    coverage, warnings = coverage_report(history, teams, cutoff)
    thin = [f"{r['team']}: {r['issue']} in the model" for r in model.coverage_warnings(schedule).orderBy("team").collect()]
    said = simulate.diagnostics(season, result, simulations, seed)
    played = schedule.where("status = 'finished'").agg(F.max("matchday"), F.count("*")).first()
    metadata = {
        "season": schedule.agg(F.max("season")).first()[0],
        "matchday": played[0] or 0,
        "cutoff": cutoff,
        "created_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "model": decision["selected_model"],
        "requested_model": kind,
        "simulations": simulations,
        "seed": seed,
        "known_results": played[1],
        "disputed_scores": disputed,
        "strict": strict,
        "history_matches": n,
        "latest_training_match": str(history.agg(F.max("date")).first()[0]),
        "data_state": {"fixtures": store.fingerprint(schedule), "history": store.fingerprint(history)},
        "evaluation": store.clean(report),
        "diagnostics": said,
        "warnings": sorted({*warnings, *thin, *said["warnings"]}),
        "environment": {"python": platform.python_version(), "spark": spark.version, "numpy": np.__version__, "version": matchlake.__version__},
    }
    return result, metadata, {"tables": {"fixtures": schedule, "history": history, "coverage": coverage, "probabilities": result}, "model": model, "documents": {"knockout": state} if state else {}}


def publish(spark: SparkSession, root: str, name: str, metadata: dict, rest: dict) -> str:
    return store.publish(spark, root, name, rest["tables"], metadata, {"model": rest["model"].payload()} | rest["documents"])


def reproduce(spark: SparkSession, root: str, name: str) -> dict:
    """Simulates a published run again from its stored schedule, model, state and seed; any difference raises."""
    path = store.resolve(spark, root, name)
    meta, folder = store.metadata(spark, root, name), store.Folder(spark, root)
    model = from_payload(json.loads(folder.read(name, "model.json")))
    season = season_of(spark.read.parquet(f"{path}/fixtures"), model)
    season.balanced = meta["strict"]
    if folder.exists(name, "knockout.json"):
        season = bracket_state.applied(season, json.loads(folder.read(name, "knockout.json")), meta["cutoff"])
    fresh = simulate.simulate(spark, season, meta["simulations"], meta["seed"])
    bad = store.differences(fresh, spark.read.parquet(f"{path}/probabilities"), ["team"]).count()
    if bad:
        raise ValueError(f"{bad} values differ from the stored run")
    return {"run_id": name, "hashes_valid": True, "probabilities_reproduced": True}


def page_payload(spark: SparkSession, root: str) -> dict:
    """What a page shows: the headline run with its teams and open matches, its model, and places over earlier runs."""
    runs, issues = store.catalogue(spark, root)
    head = store.headline(runs).first()
    if head is None or head["run_id"] is None:
        raise FileNotFoundError("no readable run")
    name = head["run_id"]
    meta, folder = store.metadata(spark, root, name), store.Folder(spark, root)
    season = runs.where(F.col("season") == head["season"])
    # One run per state of the data, the latest created.
    kept = season.groupBy("state").agg(F.max(F.struct("created_at", "run_id")).alias("m")).select("m.run_id")
    places = store.run_tables(spark, root, season.join(kept, "run_id"))
    history = places.where("expected_rank is not null").select("cutoff", "created_at", "matchday", "team", "expected_rank").orderBy("cutoff", "created_at", "team")
    own = spark.read.parquet(folder.path(name, "probabilities")).orderBy(F.col("p_champion").desc(), "team")
    fixtures = spark.read.parquet(folder.path(name, "fixtures"))
    model = from_payload(json.loads(folder.read(name, "model.json")))
    open_ = model.outcomes(fixtures.where("home_goals is null").select("match_id", "home", "away")).select("match_id", "p_home", "p_draw", "p_away", "home_rate", "away_rate")
    games = fixtures.join(open_, "match_id", "left").orderBy("matchday", "date", "home")
    rows = lambda df: [r.asDict(True) for r in df.collect()]  # noqa: E731  36 teams, 144 matches, runs by hand
    picks = {"champion": [r["team"] for r in own.limit(2).collect()], "top8": own.orderBy(F.col("p_top8").desc(), "team").first()["team"]}
    return {"run": name, "picks": picks, "cutoff": meta["cutoff"], "teams": rows(own), "matches": rows(games), "history": rows(history), "model": model_summary(meta), "warnings": meta.get("warnings", [])[:12], "issues": rows(issues)}


def model_summary(meta: dict) -> dict:
    """The report of a run's selection, with defaults for what it lacks."""
    rolling = (meta.get("evaluation") or {}).get("rolling") or {}
    out = {
        "selected_model": meta.get("model"),
        "requested_model": meta.get("requested_model"),
        "basis": (meta.get("evaluation") or {}).get("selection_basis"),
        "status": rolling.get("status"),
        "calibrated": bool((rolling.get("calibration") or {}).get("promoted")),
    }
    if rolling.get("status") == "ok":
        scores = rolling.get("selection_log_loss") or {}
        out |= {"baseline_log_loss": scores.get("baseline"), "selected_log_loss": scores.get(rolling.get("selected_model")), "assessment": rolling.get("assessment"), "assessment_baseline": rolling.get("assessment_baseline"), "ranking": sorted(scores.items(), key=lambda x: x[1])[:6]}
    return out
