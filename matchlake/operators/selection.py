"""Selecting a model on chronological folds: forecasts of each fold are made by models fitted before it.

The folds but the last select the model, its mixture weight and its calibration; the last only assesses. Matches of all
competitions may train, those of one competition are held out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions import dist
from matchlake.operators import evaluate as E
from matchlake.operators import fit
from matchlake.operators import matches as M
from matchlake.operators.models import Model
from matchlake.util import materialize

#: Candidates in order; the first is the incumbent.
CANDIDATES = ["poisson", "baseline", "low_score", "ensemble"]
GAIN, MIN_FOLDS = 0.005, 2
LEAST = {"matches": 80, "dates_per_fold": 4, "train": 100, "holdout": 10}
STEPS = 20


@dataclass
class Decision:
    """What a selection found. ``scores(fold, model, n, log_loss, ...)`` is null where the data did not suffice."""

    status: str
    selected_model: str = "baseline"
    ensemble_weight: float | None = None
    selection_log_loss: dict[str, float] = field(default_factory=dict)
    calibration: dict = field(default_factory=lambda: {"status": "insufficient_data", "promoted": False})
    assessment: dict = field(default_factory=dict)
    assessment_baseline: dict = field(default_factory=dict)
    reason: str | None = None
    scores: DataFrame | None = None

    def report(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "scores"}


def held_out(rows: DataFrame, competition: str, start: str, end: str) -> DataFrame:
    inside = (F.col("competition") == competition) & (F.col("date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("date") < F.lit(end).cast("timestamp_ntz"))
    return rows.where(inside).select("row_id", "home", "away", "home_goals", "away_goals")


def forecast(fitted: Model, test: DataFrame, **names: object) -> DataFrame:
    """The model's rates, outcomes and the probability of the score seen, for each match of ``test``."""
    rows = fitted.grids(test)
    top = dist.MAX_GOALS
    cell = F.least(F.col("home_goals"), F.lit(top)) * (top + 1) + F.least(F.col("away_goals"), F.lit(top))
    labels = [F.lit(v).alias(k) for k, v in names.items()]
    return rows.select(*labels, "row_id", "home_goals", "away_goals", "home_rate", "away_rate", "p_home", "p_draw", "p_away", F.get("grid", cell).alias("p_score"))


VALUES = ["home_rate", "away_rate", "p_home", "p_draw", "p_away", "p_score"]


def fold_forecasts(rows: DataFrame, own: DataFrame, bounds: list[tuple[str, str]], competition: str) -> DataFrame:
    """Forecasts of the single models for every fold of the competition's matches ``own``; one pass of statistics and
    one replay serve all folds."""
    starts = [s for s, _ in bounds]
    specs = [x for s in starts for x in (fit.Spec(s), fit.Spec(s, kind="baseline"), fit.Spec(s, **fit.LOW_SCORE))]
    goals = fit.fit_goals(rows, specs)
    lows = fit.fit_low_scores(rows, starts, bases=goals[2::3])
    out = None
    for i, (start, end) in enumerate(bounds):
        test = held_out(own, competition, start, end)
        models = (("poisson", goals[3 * i]), ("baseline", goals[3 * i + 1]), ("low_score", lows[i]))
        # Written fold by fold: a plan of all folds would have the driver hold every model's teams at once.
        f = materialize(reduce(DataFrame.unionByName, [forecast(model, test, fold=i, model=name) for name, model in models]), "forecasts")
        out = f if out is None else out.unionByName(f)
    return out


def mixed(forecasts: DataFrame, weight: float | None = None, steps: int = STEPS) -> DataFrame:
    """Forecasts of the mixture of the goal and the low-score model at one weight, or at every step of a grid; rates,
    outcomes and scores all mix linearly."""
    one = forecasts.where("model = 'poisson'").select("fold", "row_id", "home_goals", "away_goals", *[F.col(v).alias(f"a_{v}") for v in VALUES])
    two = forecasts.where("model = 'low_score'").select("fold", "row_id", *[F.col(v).alias(f"b_{v}") for v in VALUES])
    grid = F.lit(float(weight)) if weight is not None else F.explode(F.array(*[F.lit(k / steps) for k in range(steps + 1)]))
    rows = one.join(two, ["fold", "row_id"]).withColumn("weight", grid)
    w = F.col("weight")
    return rows.select("fold", F.lit("ensemble").alias("model"), "row_id", "home_goals", "away_goals", *[(w * F.col(f"a_{v}") + (1 - w) * F.col(f"b_{v}")).alias(v) for v in VALUES], "weight")


def scored(forecasts: DataFrame, group: list[str]) -> DataFrame:
    """n, log_loss, brier, goal_log_loss and score_log_loss per group."""
    base = E.outcome_metrics(forecasts, group)
    nll = lambda rate, goals: rate - goals * F.log(rate) + F.log(F.factorial(F.least(goals, F.lit(20))).cast("double"))
    more = forecasts.groupBy(*group).agg(
        F.avg(nll(F.col("home_rate"), F.col("home_goals")) + nll(F.col("away_rate"), F.col("away_goals"))).alias("goal_log_loss"),
        F.avg(-F.log(F.greatest("p_score", F.lit(E.FLOOR)))).alias("score_log_loss"),
    )
    return base.join(more, group)


def calibration_errors(forecasts: DataFrame, group: list[str], bins: int = 10) -> DataFrame:
    """(group, ece): bins weighted by their size, averaged over the outcomes."""
    rows = E.long_probabilities(forecasts, group).withColumn("bin", E.bin_of(F.col("p"), bins))
    per = rows.groupBy(*group, "outcome", "bin").agg(F.count("*").alias("k"), F.avg("p").alias("mean_p"), F.avg("hit").alias("seen"))
    per = per.groupBy(*group, "outcome").agg((F.sum(F.col("k") * F.abs(F.col("mean_p") - F.col("seen"))) / F.sum("k")).alias("e"))
    return per.groupBy(*group).agg(F.avg("e").alias("ece"))


def select(rows: DataFrame, cutoff: str, folds: int = 3, competition: str = "UCL") -> Decision:
    """The model, weight and calibration chosen on matches of ``competition`` before the cutoff."""
    if folds < 2:
        raise ValueError("at least two folds are needed, one to select and one to assess")
    rows = M.before(rows, cutoff)
    own = rows.where(F.col("competition") == competition)
    n, dates = own.agg(F.count("*"), F.count_distinct("date")).first()
    if n < LEAST["matches"] or dates < LEAST["dates_per_fold"] * folds:
        return Decision("insufficient_data", reason="too few matches or dates of the competition")
    starts = [str(r["start"]) for r in E.fold_bounds(own, folds).orderBy("fold").collect()]
    bounds = list(zip(starts, [*starts[1:], cutoff], strict=True))
    sizes = rows.agg(*[F.count_if(F.col("date") < F.lit(s).cast("timestamp_ntz")) for s in starts], *[F.count_if((F.col("competition") == competition) & (F.col("date") >= F.lit(s).cast("timestamp_ntz")) & (F.col("date") < F.lit(e).cast("timestamp_ntz"))) for s, e in bounds]).first()
    if min(sizes[:folds]) < LEAST["train"] or min(sizes[folds:]) < LEAST["holdout"]:
        return Decision("insufficient_data", reason="too few matches in a fold")
    # Every fold and model reads the competition's matches again: as few tasks as their number asks for.
    own = materialize(own.select("row_id", "date", "home", "away", "home_goals", "away_goals", "competition").coalesce(1 + n // 100_000), "own")
    single = fold_forecasts(rows, own, bounds, competition)
    steps = mixed(single)
    loss = E.outcome_metrics(steps, ["fold", "weight"]).groupBy("fold").agg(F.min(F.struct(F.round("log_loss", 12).alias("l"), "weight")).alias("m"), F.first("n").alias("n"))
    best = {r["fold"]: (float(r["m"]["weight"]), int(r["n"])) for r in loss.collect()}  # one row per fold
    picked = F.create_map(*[x for k, (w, _) in best.items() for x in (F.lit(k), F.lit(w))])
    every = materialize(single.unionByName(steps.where(F.col("weight") == F.try_element_at(picked, F.col("fold"))).drop("weight")), "forecasts")
    scores = scored(every, ["fold", "model"]).join(calibration_errors(every, ["fold", "model"]), ["fold", "model"])
    scores = materialize(scores.withColumn("purpose", F.when(F.col("fold") == folds - 1, "assessment").otherwise("selection")), "scores")
    table = {(r["fold"], r["model"]): r.asDict() for r in scores.collect()}  # folds x candidates
    choosing = range(folds - 1)
    total = sum(table[f, "poisson"]["n"] for f in choosing)
    mean = {m: sum(table[f, m]["n"] * table[f, m]["log_loss"] for f in choosing) / total for m in CANDIDATES}
    candidate = min(CANDIDATES, key=mean.get)
    won = candidate != "poisson" and mean["poisson"] - mean[candidate] >= GAIN and folds - 1 >= MIN_FOLDS
    decision = Decision("ok", candidate if won else "poisson", selection_log_loss=mean, scores=scores)
    if decision.selected_model == "ensemble":
        decision.ensemble_weight = sum(best[f][1] * best[f][0] for f in choosing) / sum(best[f][1] for f in choosing)
    numbers = lambda r: {k: r[k] for k in ("n", "log_loss", "brier", "ece")}
    decision.assessment = numbers(table[folds - 1, decision.selected_model])
    decision.assessment_baseline = numbers(table[folds - 1, "baseline"])
    chosen = mixed(single, decision.ensemble_weight).drop("weight") if decision.selected_model == "ensemble" else single.where(F.col("model") == decision.selected_model)
    decision.calibration = calibration(materialize(chosen, "chosen"), folds)
    return decision


def calibration(chosen: DataFrame, folds: int) -> dict:
    """Fitted on the selection folds but the last of them, which decides on promotion; the final fold assesses."""
    if folds - 1 < 2:
        return {"status": "insufficient_data", "promoted": False, "reason": "one selection fold only"}
    values = fit.fit_calibrator(chosen.where(F.col("fold") < folds - 2))
    if values is None:
        return {"status": "insufficient_data", "promoted": False, "reason": "insufficient_class_coverage"}
    p = dist.tempered([F.col("p_home"), F.col("p_draw"), F.col("p_away")], values[0], values[1:])
    after = chosen.withColumns(dict(zip(["p_home", "p_draw", "p_away"], p, strict=True)))
    both = chosen.withColumn("kind", F.lit("base")).unionByName(after.withColumn("kind", F.lit("calibrated")))
    got = {(r["fold"], r["kind"]): {"n": r["n"], "log_loss": r["log_loss"], "brier": r["brier"]} for r in E.outcome_metrics(both.where(F.col("fold") >= folds - 2), ["fold", "kind"]).collect()}
    base, new = got[folds - 2, "base"], got[folds - 2, "calibrated"]
    promoted = base["log_loss"] - new["log_loss"] >= GAIN and new["brier"] <= base["brier"]
    return {
        "status": "ok",
        "promoted": promoted,
        "reason": "improved_selection" if promoted else "insufficient_selection_improvement",
        "values": list(values),
        "selection": {"base": base, "calibrated": new},
        "assessment": {"base": got[folds - 1, "base"], "calibrated": got[folds - 1, "calibrated"]},
    }


def hold_out(rows: DataFrame, cutoff: str) -> dict:
    """One chronological hold-out of every match after the split, over all competitions: the goal model is recommended
    where it converged and its loss is strictly below the baseline's."""
    rows = M.before(rows, cutoff)
    split = E.temporal_split(rows, 0.8, 30, 10).first()
    if split is None or split["train_rows"] < 30 or split["holdout_rows"] < 10:
        return {"status": "insufficient_data", "selected_model": "baseline"}
    start = str(split["split_date"])
    goal, base = fit.fit_goals(rows, [fit.Spec(start), fit.Spec(start, kind="baseline")])
    test = rows.where(F.col("date") >= F.lit(start).cast("timestamp_ntz")).select("row_id", "home", "away", "home_goals", "away_goals")
    # The scores read the forecasts twice; their grids are made once.
    both = materialize(forecast(goal, test, model="poisson").unionByName(forecast(base, test, model="baseline")), "forecasts")
    scores = {r["model"]: r.asDict() for r in scored(both, ["model"]).collect()}
    better = goal.converged and scores["poisson"]["log_loss"] < scores["baseline"]["log_loss"]
    return {"status": "ok", "train_cutoff": start, "n_train": split["train_rows"], "models": scores, "selected_model": "poisson" if better else "baseline"}


def evaluated(rows: DataFrame, cutoff: str, folds: int = 3) -> tuple[dict, Decision]:
    """The general hold-out and the rolling selection together: the selection decides where its data suffice."""
    general, rolling = hold_out(rows, cutoff), select(rows, cutoff, folds)
    report = general | {"rolling": rolling.report()}
    if rolling.status == "ok":
        report |= {"selected_model": rolling.selected_model, "selection_basis": "rolling selection folds; the final fold is reserved for assessment"}
    else:
        report |= {"selection_basis": "general hold-out; the competition's evidence does not suffice"}
    return report, rolling
