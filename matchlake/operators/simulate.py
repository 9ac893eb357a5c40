"""Monte Carlo of a league phase and its knockout bracket.

Two forms. The relational form draws every score from a hash of (seed, simulation, fixture, side), so its results can be
reproduced by any engine. The block form runs fixed blocks of simulations in NumPy inside ``mapInPandas``: the generator
of a block is seeded by (seed, block), so partitions, row order and lost executors change nothing. Only counts per team
leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions.dist import pmf
from matchlake.functions.random import inverse_cdf, uniform
from matchlake.operators import standings

BLOCK = 1024
TOP = 12
# Fixed values of the competition: rank pairs (1-based) that meet in the play-off, seeded and unseeded, and the seeds
# waiting in the last 16.
SEEDED, UNSEEDED, DIRECT = ((15, 16), (9, 10), (13, 14), (11, 12)), ((17, 18), (23, 24), (19, 20), (21, 22)), ((1, 2), (7, 8), (3, 4), (5, 6))
EVENTS = ["top8", "playoff", "seeded", "unseeded", "eliminated", "round16", "quarterfinal", "semifinal", "final", "champion"]


# ---- relational form -------------------------------------------------------------------------------------------------


def cumulative(rate: Column, top: int = TOP) -> Column:
    """Cumulative goal probabilities rounded to 12 digits, so that engines agree on which cell a draw falls in."""
    p = pmf(rate, top)
    sums = F.transform(F.sequence(F.lit(1), F.lit(top)), lambda k: F.round(F.aggregate(F.slice(p, F.lit(1), k), F.lit(0.0), lambda s, x: s + x), 12))
    return sums


def drawn_scores(fixtures: DataFrame, simulations: int, seed: int) -> DataFrame:
    """One row per simulation and fixture: observed scores stay, others are drawn from the fixture's rates.

    fixtures(fixture, home, away, home_rate, away_rate, home_goals, away_goals).
    """
    rows = fixtures.withColumns({"ch": cumulative(F.col("home_rate")), "ca": cumulative(F.col("away_rate"))})
    # Every simulation plays every fixture: each fixture is written out once per simulation, spread before that.
    rows = rows.repartition(fixtures.sparkSession.sparkContext.defaultParallelism, "fixture")
    each = rows.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(simulations - 1).cast("bigint"))))
    u = lambda side: uniform(F.lit(seed), F.col("sim"), F.col("fixture"), F.lit(side))
    return each.select("sim", "fixture", "home", "away", F.coalesce("home_goals", inverse_cdf(F.col("ch"), u("h"))).alias("home_goals"), F.coalesce("away_goals", inverse_cdf(F.col("ca"), u("a"))).alias("away_goals"))


def league_probabilities(scores: DataFrame, seed: int) -> DataFrame:
    """(team, p_top8, p_playoff, p_eliminated, expected_points, expected_rank) over simulations of ``scores``."""
    table = standings.ranked(standings.metrics(scores, ["sim"]), ["sim"], uniform(F.lit(seed), F.col("sim"), F.col("team"), F.lit("tie")))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return table.groupBy("team").agg(
        share(F.col("pos") <= 8).alias("p_top8"),
        share(F.col("pos").between(9, 24)).alias("p_playoff"),
        share(F.col("pos") > 24).alias("p_eliminated"),
        F.avg("points").alias("expected_points"),
        F.avg("pos").alias("expected_rank"),
    )


def two_leg_winner(ties: DataFrame, seed: int) -> DataFrame:
    """Adds ``winner`` to ``ties(tie, first, second, r1h, r1a, r2h, r2a)``; ``second`` hosts the return leg.

    Level aggregates go to extra time at a third of the return leg's rates, then to a coin; goals away count as any.
    """
    draw = lambda rate, name: inverse_cdf(cumulative(rate), uniform(F.lit(seed), F.col("tie"), F.lit(name)))
    out = ties.withColumns(
        {
            "a": draw(F.col("r1h"), "1h") + draw(F.col("r2a"), "2a"),
            "b": draw(F.col("r1a"), "1a") + draw(F.col("r2h"), "2h"),
            "ea": draw(F.col("r2a") / 3, "ea"),
            "eb": draw(F.col("r2h") / 3, "eb"),
        }
    )
    level = F.col("a") == F.col("b")
    out = out.withColumns({"first_goals": F.when(level, F.col("a") + F.col("ea")).otherwise(F.col("a")), "second_goals": F.when(level, F.col("b") + F.col("eb")).otherwise(F.col("b"))})
    coin = uniform(F.lit(seed), F.col("tie"), F.lit("coin")) < 0.5
    won = (F.col("first_goals") > F.col("second_goals")) | ((F.col("first_goals") == F.col("second_goals")) & coin)
    return out.withColumn("winner", F.when(won, F.col("first")).otherwise(F.col("second"))).drop("a", "b", "ea", "eb")


# ---- block form ------------------------------------------------------------------------------------------------------


@dataclass
class Season:
    """What a block needs: teams, fixtures by team index, rates[neutral, home, away, side] and known results.

    ``grids[home, away]`` are score grids of the league phase, flattened; without them goals are independent draws from
    the rates. ``known`` maps a tie ("po-0" .. "final-0") to ``{"legs": [(first host's goals, guest's goals), ...],
    "winner": i}``.
    """

    teams: list[str]
    home: np.ndarray
    away: np.ndarray
    home_goals: np.ndarray
    away_goals: np.ndarray
    rates: np.ndarray
    order: list[int] | None = None
    slots: dict[str, list[int]] = field(default_factory=dict)
    known: dict[str, dict] = field(default_factory=dict)
    grids: np.ndarray | None = None
    balanced: bool = True  # four fixtures at home and four away each; eight in all otherwise

    def check(self) -> Season:
        n = len(self.teams)
        if len(set(self.teams)) != n or n != 36 or any(not t or t != t.strip() for t in self.teams):
            raise ValueError("a season has 36 different teams, named without outer blanks")
        if len(self.home) != 144 or (self.home == self.away).any():
            raise ValueError("a season has 144 fixtures between different teams")
        if len({frozenset(p) for p in zip(self.home.tolist(), self.away.tolist(), strict=True)}) != 144:
            raise ValueError("two teams meet once at most")
        at_home, away = np.bincount(self.home, minlength=n), np.bincount(self.away, minlength=n)
        if (at_home + away != 8).any() or (self.balanced and (at_home != 4).any()):
            raise ValueError("every team has eight fixtures, four of them at home")
        off = ~np.eye(n, dtype=bool)
        if self.rates.shape != (2, n, n, 2) or not np.isfinite(self.rates[:, off]).all() or (self.rates[:, off] < 0).any():
            raise ValueError("rates must be finite and >= 0 for every ordered pair")
        if self.grids is not None:
            g = self.grids[off]
            if not np.isfinite(g).all() or (g < 0).any() or not np.allclose(g.sum(-1), 1):
                raise ValueError("grids must be finite, >= 0 and sum to 1 for every ordered pair")
        if ((self.home_goals < 0) != (self.away_goals < 0)).any():
            raise ValueError("scores are known for both sides or for none")
        if self.order is not None:
            self._check_order()
        return self

    def _check_order(self) -> None:
        """An official order needs the whole league phase and may not contradict its nine keys."""
        if sorted(self.order) != list(range(len(self.teams))):
            raise ValueError("the official order names every team once")
        if (self.home_goals < 0).any():
            raise ValueError("an official order needs the whole league phase")
        keys = np.stack(nine_keys(self, self.home_goals[None], self.away_goals[None]), 2)[0][self.order]
        if any(tuple(keys[i]) < tuple(keys[i + 1]) for i in range(len(keys) - 1)):
            raise ValueError("the official order contradicts the results")


def nine_keys(s: Season, h: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
    """The nine ranking keys [sim, team] of scores [sim, fixture]."""
    n = len(s.teams)
    at_home, on_road = np.eye(n, dtype=np.int64)[s.home], np.eye(n, dtype=np.int64)[s.away]
    met = at_home.T @ on_road + on_road.T @ at_home
    win_h, win_a, level = (h > a).astype(int), (a > h).astype(int), (h == a).astype(int)
    sides = lambda x, y: x @ at_home + y @ on_road
    points, scored, conceded = sides(3 * win_h + level, 3 * win_a + level), sides(h, a), sides(a, h)
    keys = [points, scored - conceded, scored, a @ on_road, sides(win_h, win_a), win_a @ on_road]
    return keys + [k @ met for k in keys[:3]]


class _Block:
    def __init__(self, season: Season, seed: int, block: int, size: int):
        self.s, self.size = season, size
        self.rng = np.random.default_rng(np.random.SeedSequence([seed, block]))

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Goals [sim, fixture] of both sides: observed ones stay, others come from grids or rates."""
        s = self.s
        seen = s.home_goals >= 0
        h, a = (np.repeat(g[None].astype(np.int64), self.size, 0) for g in (s.home_goals, s.away_goals))
        open_ = np.flatnonzero(~seen)
        if s.grids is None:
            goals = self.rng.poisson(s.rates[0, s.home[open_], s.away[open_]][None], (self.size, len(open_), 2))
            h[:, open_], a[:, open_] = goals[..., 0], goals[..., 1]
            return h, a
        side = int(round(s.grids.shape[-1] ** 0.5))
        for f in open_.tolist():
            upto = np.cumsum(s.grids[s.home[f], s.away[f]])
            cell = np.minimum(np.searchsorted(upto, self.rng.random(self.size) * upto[-1], "right"), side * side - 1)
            h[:, f], a[:, f] = cell // side, cell % side
        return h, a

    def league(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(order[sim, place], points[sim, team], groups of teams settled by lot, simulations with one)."""
        h, a = self.scores()
        keys = nine_keys(self.s, h, a)
        lot = self.rng.random(keys[0].shape)
        if self.s.order is not None:
            return np.tile(np.array(self.s.order), (self.size, 1)), keys[0], 0, 0
        order = np.lexsort((lot, *[-k for k in reversed(keys)]), axis=1)
        stacked = np.take_along_axis(np.stack(keys, 2), order[:, :, None], 1)
        same = (stacked[:, 1:] == stacked[:, :-1]).all(2)
        groups = same & ~np.concatenate([np.zeros((self.size, 1), bool), same[:, :-1]], 1)
        return order, keys[0], int(groups.sum()), int(same.any(1).sum())

    def slots(self, name: str, pairs: tuple, order: np.ndarray) -> np.ndarray:
        """Eight slots: the pairs of ranks, each split at random between the two halves of the bracket."""
        if name in self.s.slots:
            return np.tile(np.array(self.s.slots[name]), (self.size, 1))
        flip = self.rng.integers(0, 2, (self.size, 4))
        low, high = (np.array([p[i] for p in pairs]) - 1 for i in (0, 1))
        left, right = np.where(flip == 0, low, high), np.where(flip == 0, high, low)
        return np.take_along_axis(order, np.concatenate([left, right], 1), 1)

    def tie(self, name: str, first: np.ndarray, second: np.ndarray, neutral: bool = False) -> np.ndarray:
        """Winners of one tie per simulation; known legs are kept, what is missing is drawn."""
        seen = self.s.known.get(name, {})
        legs, need = list(seen.get("legs", [])), 1 if neutral else 2
        winner = seen.get("winner")
        one = self.s.rates[int(neutral), first, second]
        two = one if neutral else self.s.rates[0, second, first][:, ::-1]
        total = np.zeros((self.size, 2), dtype=np.int64)
        for k, rate in enumerate([one] if neutral else [one, two]):
            if k < len(legs):
                total += np.array(legs[k] if k == 0 else legs[k][::-1])
            else:
                total += self.rng.poisson(rate)
        level = total[:, 0] == total[:, 1]
        if len(legs) == need:
            if winner is None:
                if level.any():
                    raise ValueError(f"{name} is complete and level but names no winner")
            else:
                if ((first != winner) & (second != winner)).any():
                    raise ValueError(f"{name}: the named winner does not play")
                ahead = np.where(total[:, 0] > total[:, 1], first, second)
                if (~level & (ahead != winner)).any():
                    raise ValueError(f"{name}: the named winner contradicts the score")
                return np.full(self.size, winner)
        else:
            extra = self.rng.poisson(two / 3)
            total[level] += extra[level]
        coin = self.rng.random(self.size) < 0.5
        ahead = (total[:, 0] > total[:, 1]) | ((total[:, 0] == total[:, 1]) & coin)
        return np.where(ahead, first, second)

    def round(self, name: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return np.stack([self.tie(f"{name}-{i}", first[:, i], second[:, i]) for i in range(first.shape[1])], 1)

    def run(self) -> pd.DataFrame:
        order, points, groups, tied = self.league()
        n = len(self.s.teams)
        seeded, unseeded = self.slots("seeded", SEEDED, order), self.slots("unseeded", UNSEEDED, order)
        playoff = self.round("po", unseeded, seeded)
        direct = self.slots("direct", DIRECT, order)
        quarter = self.round("r16", playoff, direct)
        # The upper slot of a pair keeps the right to host the return leg, whoever came through.
        semi = self.round("qf", quarter[:, 1::2], quarter[:, 0::2])
        last = self.round("sf", semi[:, 1::2], semi[:, 0::2])
        champion = self.tie("final-0", last[:, 0], last[:, 1], neutral=True)
        reach = {
            "top8": order[:, :8],
            "playoff": order[:, 8:24],
            "seeded": order[:, 8:16],
            "unseeded": order[:, 16:24],
            "eliminated": order[:, 24:],
            "round16": np.concatenate([playoff, direct], 1),
            "quarterfinal": quarter,
            "semifinal": semi,
            "final": last,
            "champion": champion[:, None],
        }
        out = {e: np.bincount(v.ravel(), minlength=n) for e, v in reach.items()}
        out["points"] = points.sum(0)
        out["rank_sum"] = np.bincount(order.ravel(), np.tile(np.arange(1, n + 1), self.size), n).astype(np.int64)
        frame = pd.DataFrame(out)
        frame.insert(0, "team", self.s.teams)
        frame["tie_groups"], frame["tied_simulations"] = groups, tied
        return frame


def simulate(spark: SparkSession, season: Season, simulations: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(team, p_<event>, se_<event>, expected_points, expected_rank, tie_groups, tied_simulations) of ``simulations`` runs
    in blocks of ``block``; the last two count, for the whole simulation, what lots had to settle."""
    for name, value, least in (("simulations", simulations, 1), ("seed", seed, 0), ("block", block, 1)):
        if isinstance(value, bool) or not isinstance(value, int) or value < least:
            raise ValueError(f"{name} must be a whole number of at least {least}")
    season.check()
    blocks = -(-simulations // block)
    shared = spark.sparkContext.broadcast(season)
    columns = [*EVENTS, "points", "rank_sum", "tie_groups", "tied_simulations"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["id"]:
                size = min(block, simulations - int(b) * block)
                yield _Block(shared.value, seed, int(b), size).run()

    parts = spark.range(0, blocks, 1, min(blocks, max(1, spark.sparkContext.defaultParallelism * 4)))
    counts = parts.mapInPandas(run, "team string, " + ", ".join(f"{c} bigint" for c in columns))
    sums = counts.groupBy("team").agg(*[F.sum(c).alias(c) for c in columns])
    p = {f"p_{e}": F.col(e) / simulations for e in EVENTS}
    se = {f"se_{e}": F.sqrt(F.col(e) / simulations * (1 - F.col(e) / simulations) / simulations) for e in EVENTS}
    return sums.select("team", *[v.alias(k) for k, v in (p | se).items()], (F.col("points") / simulations).alias("expected_points"), (F.col("rank_sum") / simulations).alias("expected_rank"), "tie_groups", "tied_simulations")


def diagnostics(season: Season, result: DataFrame, simulations: int, seed: int) -> dict:
    """What a published simulation says about itself."""
    lots = result.select("tie_groups", "tied_simulations").first()
    seen = int((season.home_goals >= 0).sum())
    warnings = [f"{lots[0]} groups of level teams in {lots[1]} of {simulations} simulations were settled by lot"] if lots[0] else []
    return {
        "simulations": simulations,
        "seed": seed,
        "block": BLOCK,
        "observed_matches": seen,
        "open_matches": len(season.home) - seen,
        "model_predictions": 2 * 36 * 35,
        "tie_groups": lots[0],
        "tied_simulations": lots[1],
        "score_sampling": "grids" if season.grids is not None else "independent_rates",
        "conditioned": season.order is not None,
        "warnings": warnings,
        "assumptions": ["knockout goals are independent", "extra time at a third of the rates", "shoot-outs are even", "the draw is uniform where it is open", "rates stay fixed"],
    }
