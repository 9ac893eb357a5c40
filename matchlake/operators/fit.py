"""Models fitted from sufficient statistics: one Spark aggregate for all fits asked for, one task per solve.

A task streams the statistics of its model, one row per ordered pair of teams that met and one per team and competition,
into whole numbers and sums. What reaches the driver is one row per model; teams stay in tables. The ratings of
low-score models are replayed, and their three parameters solved, in one task per cutoff.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import dist
from matchlake.operators import matches as M
from matchlake.operators import ratings
from matchlake.operators.models import ByTeam, Calibrated, GoalModel, LowScoreModel, Mixture, Model
from matchlake.util import materialize, materialize_apart

BOUNDS = {"intercept": 3.0, "advantage": 1.5, "team": 2.5, "league": 1.5}
#: What scoring is drawn to: goals of a side without advantage, the advantage, and the matches both count for.
PRIOR_GOALS, PRIOR_ADVANTAGE, PRIOR_MATCHES = 1.35, 0.15, 10.0


@dataclass(frozen=True)
class Spec:
    """One goal model to fit on the matches before ``cutoff``."""

    cutoff: str
    half_life: float = 365.0
    team_penalty: float = 5.0
    league_penalty: float = 0.5
    shot_blend: float = 0.0
    kind: str = "poisson"

    def validate(self) -> Spec:
        numbers = (self.half_life, self.team_penalty, self.league_penalty, self.shot_blend)
        if not all(math.isfinite(x) for x in numbers) or min(numbers[:3]) <= 0 or not 0 <= self.shot_blend <= 1:
            raise ValueError("half-life and penalties must be finite and positive, the shot blend in [0, 1]")
        if self.kind not in ("poisson", "baseline"):
            raise ValueError("kind must be poisson or baseline")
        return self


def fit_goals(rows: DataFrame, specs: list[Spec], max_iter: int = 50) -> list[GoalModel]:
    """Baseline or maximum a posteriori Poisson models, all from one pass over the matches."""
    for s in specs:
        s.validate()
    sums: list[Column] = []
    blends = sorted({s.shot_blend for s in specs})
    for b in blends:
        if b and all(c in rows.columns for c in ("home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target")):
            rows = M.goal_targets(rows, b).withColumnsRenamed({"home_target": f"__h{b}", "away_target": f"__a{b}"})
        else:
            rows = rows.withColumns({f"__h{b}": F.col("home_goals").cast("double"), f"__a{b}": F.col("away_goals").cast("double")})
    for i, s in enumerate(specs):
        known = F.col("date") < F.lit(s.cutoff).cast("timestamp_ntz")
        w = F.when(known, dist.decay_weight(M.age_days(s.cutoff), s.half_life))
        sums += [F.count_if(known).alias(f"n{i}"), F.sum(w).alias(f"w{i}"), F.sum(w * F.col(f"`__h{s.shot_blend}`")).alias(f"h{i}"), F.sum(w * F.col(f"`__a{s.shot_blend}`")).alias(f"a{i}")]
    pairs = materialize(rows.groupBy("home", "away").agg(*sums), "pairs")
    domestic = M.by_side(rows).where(~M.european(F.col("competition")))
    cutoffs = sorted({s.cutoff for s in specs})
    played = [F.count_if(F.col("date") < F.lit(c).cast("timestamp_ntz")).alias(f"c{i}") for i, c in enumerate(cutoffs)]
    leagues = materialize(domestic.groupBy("team", "competition").agg(*played), "leagues")
    parts = []
    for i, s in enumerate(specs):
        own = pairs.where(F.col(f"n{i}") > 0).select(F.lit(True).alias("met"), F.col("home").alias("one"), F.col("away").alias("other"), F.col(f"n{i}").alias("n"), *[F.col(f"{c}{i}").cast("double").alias(c) for c in ("w", "h", "a")])
        c = f"c{cutoffs.index(s.cutoff)}"
        mine = leagues.where(F.col(c) > 0).select(F.lit(False).alias("met"), F.col("team").alias("one"), F.col("competition").alias("other"), F.col(c).alias("n"), *[F.lit(None).cast("double").alias(x) for x in ("w", "h", "a")])
        parts.append(own.unionByName(mine).coalesce(1).mapInArrow(_solver(i, s, max_iter), _SOLVED))
    if not parts:
        return []
    got = materialize_apart(parts, "fits")
    heads = {r["spec"]: r for r in got.groupBy("spec").agg(F.max("head").alias("head"), F.count("team").alias("teams"), F.count("attack").alias("rated")).collect()}  # a row per model
    out = []
    for i in range(len(specs)):
        own, r = got.where(F.col("spec") == i), heads[i]
        known, met = own.where("attack is not null"), own.where("team is not null")
        attack, defence = (ByTeam(known, r["rated"], "team", c) if r["rated"] else {} for c in ("attack", "defence"))
        out.append(GoalModel(**json.loads(r["head"]), attack=attack, defence=defence, coverage=ByTeam(met, r["teams"], "team", "n", "w")))
    return out


_SOLVED = "spec int, team string, n double, w double, attack double, defence double, head string"


def _solver(i: int, s: Spec, max_iter: int):
    """The task that solves model ``i``: its pairs and leagues come in batches, its head and teams go out as rows."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        league_of: dict[str, tuple[float, str]] = {}
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] * 2 + [np.zeros(0)] * 4]

        def numbers(names: pa.Array) -> np.ndarray:
            coded = names.dictionary_encode()
            return np.array([ids.setdefault(x, len(ids)) for x in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy(zero_copy_only=False)]

        for batch in batches:
            t = pa.Table.from_batches([batch])
            own = t.filter(t["met"])
            if len(own):
                parts.append([numbers(own[c].combine_chunks()) for c in ("one", "other")] + [own[c].to_numpy().astype(float) for c in ("n", "w", "h", "a")])
            for team, league, n in zip(*(t.filter(pc.invert(t["met"]))[c].to_pylist() for c in ("one", "other", "n")), strict=True):
                league_of[team] = min(league_of.get(team, (0, "")), (-n, league))
        teams = sorted(ids)
        place = np.empty(len(ids), np.int64)
        place[[ids[t] for t in teams]] = np.arange(len(ids))
        columns = [np.concatenate([x[k] for x in parts]) for k in range(6)]
        del parts
        columns[:2] = [place[c] for c in columns[:2]]
        order = np.lexsort((columns[1], columns[0]))  # whatever order the files have
        head, values = _solved([c[order] for c in columns], teams, [league_of.get(t, (0, "OTHER"))[1] for t in teams], s, max_iter)
        schema = pa.schema([("spec", pa.int32()), ("team", pa.string()), *[(c, pa.float64()) for c in ("n", "w", "attack", "defence")], ("head", pa.string())])
        yield pa.RecordBatch.from_pylist([{"spec": i, "head": json.dumps(head)}], schema=schema)
        if teams:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(teams), i, np.int32)), pa.array(teams, pa.string()), *[pa.array(v, pa.float64(), from_pandas=True) for v in values], pa.nulls(len(teams), pa.string())], schema=schema)

    return solve


def _solved(stats: list[np.ndarray], teams: list[str], league: list[str], s: Spec, max_iter: int) -> tuple[dict, list[np.ndarray]]:
    """(what a model has besides teams, [matches, weight, attack, defence] by team) of ``stats``: home and away numbers,
    matches, weights and weighted goals of each pair."""
    h, a, met, w, wh, wa = stats
    total, n = float(w.sum()), len(teams)
    home_rate = (float(wh.sum()) + PRIOR_MATCHES * PRIOR_GOALS * math.exp(PRIOR_ADVANTAGE)) / (total + PRIOR_MATCHES)
    away_rate = (float(wa.sum()) + PRIOR_MATCHES * PRIOR_GOALS) / (total + PRIOR_MATCHES)
    base = {"intercept": math.log(away_rate), "advantage": math.log(home_rate / away_rate), "converged": True, "warnings": [], "model_type": "baseline"}
    unknown = np.full(n, np.nan)
    coverage = [np.bincount(h, x, n) + np.bincount(a, x, n) for x in (met, w)]
    if s.kind == "baseline":
        return base, [*coverage, unknown, unknown]
    if not len(w):
        return base | {"model_type": "prior_only", "converged": False}, [*coverage, unknown, unknown]
    names = sorted(set(league))
    k, place = len(names), {x: i for i, x in enumerate(names)}
    lg = np.array([place[x] for x in league])
    size = 2 + 2 * n + 2 * k
    centre = np.zeros(size)
    centre[:2] = math.log(PRIOR_GOALS), PRIOR_ADVANTAGE
    penalty = np.concatenate([np.full(2, PRIOR_MATCHES), np.full(2 * n, s.team_penalty), np.full(2 * k, s.league_penalty)])
    bound = np.concatenate([[BOUNDS["intercept"], BOUNDS["advantage"]], np.full(2 * n, BOUNDS["team"]), np.full(2 * k, BOUNDS["league"])])

    # A rate is intercept, advantage at home, the attack of a side and its league, less the defence of the other's: sums by
    # team first, so a pair is touched once per side.
    def linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        attack, defence = x[2 : 2 + n] + x[2 + 2 * n : 2 + 2 * n + k][lg], x[2 + n : 2 + 2 * n] + x[2 + 2 * n + k :][lg]
        return x[0] + x[1] + attack[h] - defence[a], x[0] + attack[a] - defence[h]

    def spread(home: np.ndarray, away: np.ndarray, sign: float = -1.0) -> np.ndarray:
        attack, defence = np.bincount(h, home, n) + np.bincount(a, away, n), sign * (np.bincount(a, home, n) + np.bincount(h, away, n))
        return np.concatenate([[home.sum() + away.sum(), home.sum()], attack, defence, np.bincount(lg, attack, k), np.bincount(lg, defence, k)])

    def value(x: np.ndarray) -> float:
        return sum(float(np.sum(w * np.exp(e) - target * e)) for e, target in zip(linear(x), (wh, wa), strict=True)) + 0.5 * float(np.sum(penalty * (x - centre) ** 2))

    def newton_step(gradient: np.ndarray, free: np.ndarray, mus: list[np.ndarray]) -> np.ndarray:
        """Conjugate gradients over the free values, scaled by the diagonal; the Hessian, which grows with the square of
        the teams, is never made."""
        scale = penalty + spread(*mus, 1.0)
        step, r = np.zeros(size), np.where(free, gradient, 0.0)
        z = r / scale
        d, rz, goal = z, r @ z, 1e-8 * np.linalg.norm(r)
        for _ in range(10 * size):
            if np.linalg.norm(r) <= goal:
                break
            q = np.where(free, penalty * d + spread(*[mu * e for mu, e in zip(mus, linear(d), strict=True)]), 0.0)
            alpha = rz / (d @ q)
            step, r = step + alpha * d, r - alpha * q
            z = r / scale
            d, rz = z + (r @ z) / rz * d, r @ z
        return step

    x, done = np.zeros(size), False
    x[:2] = base["intercept"], base["advantage"]
    for it in range(max_iter):
        mus = [w * np.exp(e) for e in linear(x)]
        gradient = penalty * (x - centre) + spread(mus[0] - wh, mus[1] - wa)
        free = ~(((x >= bound) & (gradient < 0)) | ((x <= -bound) & (gradient > 0)))
        if np.max(np.abs(gradient[free]), initial=0.0) < 1e-8 * max(1.0, total):
            done = it > 0
            break
        step, scale, now = newton_step(gradient, free, mus), 1.0, value(x)
        while scale > 1e-8 and value(np.clip(x - scale * step, -bound, bound)) > now:
            scale /= 2
        x = np.clip(x - scale * step, -bound, bound)
    if not done:
        return base | {"converged": False, "warnings": ["the goal model did not converge; baseline rates are used"]}, [*coverage, unknown, unknown]
    attack, defence = x[2 : 2 + n] + x[2 + 2 * n : 2 + 2 * n + k][lg], x[2 + n : 2 + 2 * n] + x[2 + 2 * n + k :][lg]
    return {"intercept": float(x[0]), "advantage": float(x[1]), "converged": True, "warnings": [], "model_type": "poisson"}, [*coverage, attack, defence]


def fit_baseline(rows: DataFrame, cutoff: str, half_life: float = 365.0) -> GoalModel:
    return fit_goals(rows, [Spec(cutoff, half_life, kind="baseline")])[0]


def fit_poisson(rows: DataFrame, cutoff: str, max_iter: int = 50, **settings: float) -> GoalModel:
    """Maximum a posteriori Poisson strengths of teams and leagues; without convergence the baseline with a warning."""
    return fit_goals(rows, [Spec(cutoff, **settings)], max_iter)[0]


# ---- dependence of low scores, ratings and leagues ---------------------------------------------------------------------

LOW_SCORE = {"half_life": 180.0, "team_penalty": 8.0}


def low_score_terms(games: pd.DataFrame, penalty: float, bounds: tuple[float, float, float], max_iter: int = 100) -> tuple[np.ndarray, bool]:
    """(rating, league and dependence coefficients, whether settled) of one cutoff's matches, by damped Newton steps.

    games: base rates ``lh, la``, differences ``e`` and ``l``, scores ``hg, ag`` and weights ``w``.
    """
    lh0, la0, hg, ag, w = (games[c].to_numpy(float) for c in ("lh", "la", "hg", "ag", "w"))
    terms = games[["e", "l"]].to_numpy(float)
    n00, n01, n10, n11 = ((hg == i) & (ag == j) for i in (0, 1) for j in (0, 1))
    top = np.array(bounds)

    def parts(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        move = np.clip(terms @ x[:2], -5, 5)
        lh, la, rho = lh0 * np.exp(move), la0 * np.exp(-move), x[2]
        c = np.where(n00, 1 - lh * la * rho, np.where(n01, 1 + lh * rho, np.where(n10, 1 + la * rho, np.where(n11, 1 - rho, 1.0))))
        if (c <= 0).any():
            return math.inf, np.zeros(3), np.eye(3)
        loss = -np.sum(w * (hg * np.log(lh) - lh + ag * np.log(la) - la + np.log(c))) + penalty * float(x @ x)
        # Derivatives of the correction by the move and by rho.
        cm = np.where(n01, lh * rho, np.where(n10, -la * rho, 0.0))
        cr = np.where(n00, -lh * la, np.where(n01, lh, np.where(n10, la, np.where(n11, -1.0, 0.0))))
        cmm = np.where(n01, lh * rho, np.where(n10, la * rho, 0.0))
        cmr = np.where(n01, lh, np.where(n10, -la, 0.0))
        gm, gr = (hg - lh) - (ag - la) + cm / c, cr / c
        hmm, hmr, hrr = -lh - la + cmm / c - (cm / c) ** 2, cmr / c - cm * cr / c**2, -((cr / c) ** 2)
        gradient = np.concatenate([-(terms.T @ (w * gm)), [-np.sum(w * gr)]]) + 2 * penalty * x
        hessian = np.zeros((3, 3))
        hessian[:2, :2] = -(terms.T * (w * hmm)) @ terms
        hessian[:2, 2] = hessian[2, :2] = -(terms.T @ (w * hmr))
        hessian[2, 2] = -np.sum(w * hrr)
        return float(loss), gradient, hessian + 2 * penalty * np.eye(3)

    x = np.array([0.0015, 0.0015, 0.0])
    loss, gradient, hessian = parts(x)
    if not math.isfinite(loss):
        return np.zeros(3), False
    for _ in range(max_iter):
        free = ~(((x >= top) & (gradient < 0)) | ((x <= -top) & (gradient > 0)))
        scale = np.sqrt(np.abs(np.diag(hessian)))
        if np.max(np.abs(gradient[free]) / scale[free], initial=0.0) < 1e-6:
            return x, True
        step, ridge = np.zeros(3), 0.0
        while True:  # a curvature that is not positive is raised until it is
            part = hessian[np.ix_(free, free)] + ridge * np.diag(scale[free] ** 2)
            if np.linalg.eigvalsh(part).min() > 0:
                break
            ridge = max(1e-3, 4 * ridge)
        step[free] = np.linalg.solve(part, gradient[free])
        size = 1.0
        while size > 1e-10:
            new = np.clip(x - size * step, -top, top)
            got = parts(new)
            if got[0] <= loss:
                break
            size /= 2
        if size <= 1e-10 or np.array_equal(new, x):
            return x, True
        x, (loss, gradient, hessian) = new, got
    return np.zeros(3), False


def fit_low_scores(rows: DataFrame, cutoffs: list[str], penalty: float = 8.0, bounds: tuple[float, float, float] = (0.01, 0.01, 0.2), bases: list[GoalModel] | None = None) -> list[LowScoreModel]:
    """A low-score model per cutoff: its own goal model, ratings replayed up to the cutoff, and three coefficients."""
    bases = bases or fit_goals(rows, [Spec(c, **LOW_SCORE) for c in cutoffs])
    games, teams, leagues = ratings.replay_tables(rows, cutoffs)
    scores = rows.select("row_id", F.col("home_goals").alias("hg"), F.col("away_goals").alias("ag"))
    every = None
    for cutoff, base in zip(cutoffs, bases, strict=True):
        own = games.where(F.col("cutoff") == cutoff).select("cutoff", "row_id", "date", "home", "away", (F.col("home_rating") - F.col("away_rating")).alias("e"), (F.col("home_offset") - F.col("away_offset")).alias("l"))
        w = dist.decay_weight(F.greatest(M.age_days(cutoff), F.lit(0.0)), LOW_SCORE["half_life"])
        own = base.rates(own).select("cutoff", "row_id", F.col("home_rate").alias("lh"), F.col("away_rate").alias("la"), "e", "l", w.alias("w"))
        every = own if every is None else every.unionByName(own)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ok = low_score_terms(pdf, penalty, bounds)
        return pd.DataFrame([(pdf["cutoff"].iloc[0], *map(float, x), ok)], columns=["cutoff", "elo", "league", "rho", "ok"])

    solved = {r["cutoff"]: r for r in every.join(scores, "row_id").groupBy("cutoff").applyInPandas(solve, "cutoff string, elo double, league double, rho double, ok boolean").collect()}
    offsets = leagues.select("cutoff", F.col("name").alias("league"), "offset")
    finals = teams.select("cutoff", F.col("name").alias("team"), "rating", "league").join(offsets, ["cutoff", "league"], "left").withColumn("offset", F.coalesce("offset", F.lit(0.0)))
    finals = materialize(finals, "ratings")
    sizes = {r["cutoff"]: r for r in finals.groupBy("cutoff").agg(F.count("*").alias("teams"), F.count("league").alias("placed")).collect()}  # a row per cutoff
    shared = {r["cutoff"]: r["n"] for r in offsets.groupBy("cutoff").agg(F.count("*").alias("n")).collect()}
    out = []
    for cutoff, base in zip(cutoffs, bases, strict=True):
        t, g = finals.where(F.col("cutoff") == cutoff), offsets.where(F.col("cutoff") == cutoff)
        r, n = solved.get(cutoff), sizes.get(cutoff)
        model = LowScoreModel(base)
        if n is not None:
            model.ratings, model.leagues = ByTeam(t, n["teams"], "team", "rating"), ByTeam(t.where("league is not null"), n["placed"], "team", "league")
            model.offsets = ByTeam(g, shared.get(cutoff, 0), "league", "offset")
        if r is None or not r["ok"] or not base.converged:
            model.converged = False
            model.warnings.append("the low-score model did not converge; goals are taken as independent")
        else:
            model.elo, model.league, model.rho = r["elo"], r["league"], r["rho"]
        out.append(model)
    return out


def fit_low_score(rows: DataFrame, cutoff: str, **settings: float) -> LowScoreModel:
    return fit_low_scores(rows, [cutoff], **settings)[0]


# ---- calibration -------------------------------------------------------------------------------------------------------


def fit_calibrator(forecasts: DataFrame, l2: float = 1.0, min_samples: int = 60, max_iter: int = 50) -> tuple[float, float, float] | None:
    """(log temperature, home offset, draw offset) minimising the penalised mean log loss; None without all three
    outcomes or enough samples.

    Newton steps; gradient and curvature of each come from one Spark aggregate of three log-probabilities.
    """
    rows = forecasts.select(*[F.log(F.greatest(c, F.lit(1e-15))).alias(c[2:]) for c in ("p_home", "p_draw", "p_away")], dist.outcome(F.col("home_goals"), F.col("away_goals")).alias("seen"))
    rows = materialize(rows, "log-probabilities")
    n, kinds = rows.agg(F.count("*"), F.count_distinct("seen")).first()
    if n < min_samples or kinds < 3:
        return None
    logs = [F.col(c) for c in ("home", "draw", "away")]
    own = lambda cols: F.when(F.col("seen") == 0, cols[0]).when(F.col("seen") == 1, cols[1]).otherwise(cols[2])

    def parts(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        cold = math.exp(-x[0])
        offsets = (x[1], x[2], -x[1] - x[2])
        score = [lp * cold + o for lp, o in zip(logs, offsets, strict=True)]
        high = F.greatest(*score)
        raw = [F.exp(v - high) for v in score]
        total = raw[0] + raw[1] + raw[2]
        p = [r / total for r in raw]
        # Each score's derivatives by temperature and the two offsets.
        d = [[-lp * cold for lp in logs], [F.lit(1.0), F.lit(0.0), F.lit(-1.0)], [F.lit(0.0), F.lit(1.0), F.lit(-1.0)]]
        mean = [p[0] * r[0] + p[1] * r[1] + p[2] * r[2] for r in d]
        sums = [F.avg(high + F.log(total) - own(score)).alias("loss")]
        sums += [F.avg(mean[i] - own(d[i])).alias(f"g{i}") for i in range(3)]
        for i in range(3):
            for j in range(i, 3):
                bent = (p[0] * d[0][0] + p[1] * d[0][1] + p[2] * d[0][2] - own(d[0])) * -1.0 if i == j == 0 else F.lit(0.0)
                sums.append(F.avg(p[0] * d[i][0] * d[j][0] + p[1] * d[i][1] * d[j][1] + p[2] * d[i][2] * d[j][2] - mean[i] * mean[j] + bent).alias(f"h{i}{j}"))
        r = rows.agg(*sums).first()
        hessian = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]) + 2 * l2 / n * np.eye(3)
        return r["loss"] + l2 * float(x @ x) / n, np.array([r[f"g{i}"] for i in range(3)]) + 2 * l2 * x / n, hessian

    top = np.array([1.0, 2.0, 2.0])
    x = np.zeros(3)
    loss, gradient, hessian = parts(x)
    for _ in range(max_iter):
        free = ~(((x >= top) & (gradient < 0)) | ((x <= -top) & (gradient > 0)))
        if np.max(np.abs(gradient[free]), initial=0.0) < 1e-8:
            break
        ridge, step, size = 0.0, np.zeros(3), 1.0
        while np.linalg.eigvalsh(part := hessian[np.ix_(free, free)] + ridge * np.eye(int(free.sum()))).min() <= 0:
            ridge = max(1e-4, 4 * ridge)
        step[free] = np.linalg.solve(part, gradient[free])
        while size > 1e-6 and (got := parts(new := np.clip(x - size * step, -top, top)))[0] > loss:
            size /= 2
        if size <= 1e-6:
            break
        x, (loss, gradient, hessian) = new, got
    return float(x[0]), float(x[1]), float(x[2])


# ---- the model of a decision -------------------------------------------------------------------------------------------


def fit_selected(rows: DataFrame, cutoff: str, decision: dict) -> Model:
    """The model that a selection chose, fitted on all matches before the cutoff and calibrated where that was promoted."""
    chosen = decision.get("selected_model", "poisson")
    if chosen in ("poisson", "baseline"):
        model: Model = fit_goals(rows, [Spec(cutoff, kind=chosen)])[0]
    elif chosen == "low_score":
        model = fit_low_score(rows, cutoff)
    elif chosen == "ensemble":
        if decision.get("ensemble_weight") is None:
            raise ValueError("a mixture needs the weight that was validated")
        goal, base = fit_goals(rows, [Spec(cutoff), Spec(cutoff, **LOW_SCORE)])
        model = Mixture(goal, fit_low_scores(rows, [cutoff], bases=[base])[0], float(decision["ensemble_weight"]))
    else:
        raise ValueError(f"unknown model {chosen}")
    calibration = decision.get("calibration") or {}
    if calibration.get("promoted"):
        model = Calibrated(model, *calibration["values"])
    return model
