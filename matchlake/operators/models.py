"""Score models: what they know of teams, the rates and score grids they give to pairs, and their JSON.

Every model adds ``home_rate``, ``away_rate`` and ``grid`` to ``pairs(home, away[, neutral])``; evaluation, sampling and
simulation use nothing else. What a fitted model knows of teams stays in a table that the rates join; only its JSON, and
whoever asks for single teams, brings it to the driver. Rates are joins and column expressions; the grids of a model, however nested, are made from
the rates in one pass over Arrow batches. Models nest: a mixture holds models, a calibrated model holds one, and so does
their JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions import dist, grids
from matchlake.functions.random import uniform
from matchlake.util import BROADCAST_ROWS, salted_join

#: Decayed matches below which a team's strength is called sparse.
MIN_MATCHES = 5.0
INITIAL_RATING = 1500.0


class ByTeam(Mapping):
    """A value by team, or several as a list, in ``rows`` rows of a table; read into the driver when one is asked for."""

    def __init__(self, table: DataFrame, rows: int, key: str, *values: str) -> None:
        self.table, self.rows, self.key, self.values_of = table, rows, key, values
        self._read: dict | None = None

    def _all(self) -> dict:
        if self._read is None:
            t = self.table.select(self.key, *self.values_of).toArrow()
            columns = [t[c].to_pylist() for c in self.values_of]
            self._read = dict(sorted(zip(t[self.key].to_pylist(), columns[0] if len(columns) == 1 else map(list, zip(*columns, strict=True)), strict=True)))
        return self._read

    def __getitem__(self, team: str) -> object:
        return self._all()[team]

    def __iter__(self) -> Iterator[str]:
        return iter(self._all())

    def __len__(self) -> int:
        return self.rows


def _plain(fields: dict) -> dict:
    return {k: dict(v) if isinstance(v, ByTeam) else v for k, v in fields.items()}


def _with_team(pairs: DataFrame, side: str, known: DataFrame, rows: int, *names: str) -> DataFrame:
    """Left-joins ``known``, teams and values in ``rows`` rows, to one side of ``pairs``, the values under ``names``."""
    known = known.toDF(side, *names)
    return pairs.join(F.broadcast(known), side, "left") if rows <= BROADCAST_ROWS else salted_join(pairs, known, [side])


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


class Model:
    """What all models share."""

    def rates(self, pairs: DataFrame, home: str = "home_rate", away: str = "away_rate") -> DataFrame:
        """Adds the rates under the names given."""
        raise NotImplementedError

    def parts(self, pairs: DataFrame, prefix: str = "__m") -> DataFrame:
        """Adds the rates of every part of the model, ``{prefix}_h`` and ``{prefix}_a`` for a single one."""
        return self.rates(pairs, f"{prefix}_h", f"{prefix}_a")

    def grid(self, rows: pd.DataFrame, prefix: str = "__m") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home rates, away rates, grids) from the columns of :meth:`parts`."""
        h, a = rows[f"{prefix}_h"].to_numpy(float), rows[f"{prefix}_a"].to_numpy(float)
        return h, a, grids.grid(h, a, getattr(self, "rho", 0.0))

    def grids(self, pairs: DataFrame) -> DataFrame:
        """Adds the rates, ``grid`` and its outcomes ``p_home``, ``p_draw``, ``p_away``; a grid that is none raises."""

        own = self.bare()

        def make(pdf: pd.DataFrame) -> dict[str, object]:
            h, a, g = own.grid(pdf)
            if grids.bad(g).any():
                raise ValueError("a model gave an invalid grid")
            p = grids.outcomes(g)
            return {"home_rate": h, "away_rate": a, "grid": grids.cells(g), "p_home": p[:, 0], "p_draw": p[:, 1], "p_away": p[:, 2]}

        rows = self.parts(pairs)
        made = tuple(c for c in rows.columns if c not in pairs.columns)
        return grids.with_columns(rows, "home_rate double, away_rate double, grid array<double>, p_home double, p_draw double, p_away double", make, made)

    def bare(self) -> Model:
        """The model without its teams: what tasks need for :meth:`grid`."""
        raise NotImplementedError

    def payload(self) -> dict:
        raise NotImplementedError

    @property
    def known(self) -> Mapping[str, list[float]]:
        """Matches and decayed weight by team."""
        raise NotImplementedError

    def outcomes(self, pairs: DataFrame) -> DataFrame:
        return self.grids(pairs).drop("grid")

    def to_json(self) -> str:
        return json.dumps(self.payload(), sort_keys=True, allow_nan=False)

    def sampled(self, pairs: DataFrame, size: int, seed: int) -> DataFrame:
        """(home, away, draw, hg, ag): ``size`` scores of each pair, drawn from its grid by hashed numbers."""
        if isinstance(size, bool) or size < 1:
            raise ValueError("size must be a positive integer")
        rows = self.grids(pairs.select("home", "away", *[c for c in ("neutral",) if c in pairs.columns]))
        rows = grids.with_columns(rows, "c array<double>", lambda pdf: {"c": [np.cumsum(x) for x in pdf["grid"]]}).select("home", "away", "c")
        draws = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("u", uniform(F.lit(seed), F.col("home"), F.col("away"), F.col("draw")))

        def make(pdf: pd.DataFrame) -> dict[str, object]:
            at = np.array([min(int(np.searchsorted(c, u, "right")), len(c) - 1) for c, u in zip(pdf["c"], pdf["u"], strict=True)], dtype=int)
            return {"hg": at // grids.SIDE, "ag": at % grids.SIDE}

        return grids.with_columns(draws, "hg int, ag int", make, ("c", "u"))

    def coverage_warnings(self, pairs: DataFrame) -> DataFrame:
        """(team, issue, weight): teams of ``pairs`` without strength (unknown) or with few matches (sparse)."""
        teams = pairs.select(F.explode(F.array("home", "away")).alias("team")).where("team is not null").distinct()
        known = self.known
        if isinstance(known, ByTeam):
            weights = known.table.select("team", "w")
        else:
            weights = pairs.sparkSession.createDataFrame([(t, float(w)) for t, (_, w) in sorted(known.items())], "team string, w double")
        rows = _with_team(teams, "team", weights, len(known), "weight")
        issue = F.when(F.col("weight").isNull(), "unknown").when(F.col("weight") < MIN_MATCHES, "sparse")
        return rows.select("team", issue.alias("issue"), "weight").where("issue is not null")


@dataclass
class GoalModel(Model):
    """Log-linear rates; teams without strengths play at strength 0."""

    intercept: float
    advantage: float
    attack: Mapping[str, float] = field(default_factory=dict)
    defence: Mapping[str, float] = field(default_factory=dict)
    coverage: Mapping[str, list[float]] = field(default_factory=dict)
    converged: bool = True
    warnings: list[str] = field(default_factory=list)
    model_type: str = "poisson"

    @property
    def known(self) -> Mapping[str, list[float]]:
        return self.coverage

    def strengths(self, spark: SparkSession) -> DataFrame:
        """The model as a relation (team, attack, defence)."""
        if isinstance(self.attack, ByTeam):
            return self.attack.table.select("team", "attack", "defence")
        return spark.createDataFrame([(t, float(self.attack[t]), float(self.defence[t])) for t in sorted(self.attack)], "team string, attack double, defence double")

    def rates(self, pairs: DataFrame, home: str = "home_rate", away: str = "away_rate") -> DataFrame:
        known, n = self.strengths(pairs.sparkSession), len(self.attack)
        out = _with_team(_with_team(pairs, "home", known, n, "__ha", "__hd"), "away", known, n, "__aa", "__ad")
        mu = F.lit(float(self.intercept))
        own = F.when(F.coalesce(F.col("neutral"), F.lit(False)), 0.0).otherwise(float(self.advantage)) if "neutral" in pairs.columns else F.lit(float(self.advantage))
        made = {home: dist.link_rate(mu, own, _zero("__ha"), _zero("__ad")), away: dist.link_rate(mu, F.lit(0.0), _zero("__aa"), _zero("__hd"))}
        return out.withColumns(made).drop("__ha", "__hd", "__aa", "__ad")

    def bare(self) -> GoalModel:
        return replace(self, attack={}, defence={}, coverage={})

    def payload(self) -> dict:
        return {"schema_version": 1} | _plain(vars(self))


@dataclass
class LowScoreModel(Model):
    """A goal model moved by pre-match ratings and league offsets, with dependence between the lowest scores."""

    base: GoalModel
    ratings: Mapping[str, float] = field(default_factory=dict)
    offsets: Mapping[str, float] = field(default_factory=dict)
    leagues: Mapping[str, str] = field(default_factory=dict)
    elo: float = 0.0
    league: float = 0.0
    rho: float = 0.0
    converged: bool = True
    warnings: list[str] = field(default_factory=list)
    model_type: str = "low_score"

    @property
    def known(self) -> Mapping[str, list[float]]:
        return self.base.known

    def rates(self, pairs: DataFrame, home: str = "home_rate", away: str = "away_rate") -> DataFrame:
        """Rates of the base, moved by the differences of ratings (1500 where unknown) and league offsets (0)."""
        if isinstance(self.ratings, ByTeam):
            known = self.ratings.table.select("team", "rating", "offset")
        else:
            rows = [(t, float(r), float(self.offsets.get(self.leagues.get(t) or "", 0.0))) for t, r in sorted(self.ratings.items())]
            known = pairs.sparkSession.createDataFrame(rows, "team string, rating double, offset double")
        n = len(self.ratings)
        out = _with_team(_with_team(self.base.rates(pairs, home, away), "home", known, n, "__hr", "__ho"), "away", known, n, "__ar", "__ao")
        rating = lambda c: F.coalesce(F.col(c), F.lit(INITIAL_RATING))
        move = self.elo * (rating("__hr") - rating("__ar")) + self.league * (_zero("__ho") - _zero("__ao"))
        return out.withColumns({home: dist.adjusted_rate(F.col(home), move), away: dist.adjusted_rate(F.col(away), -move)}).drop("__hr", "__ho", "__ar", "__ao")

    def bare(self) -> LowScoreModel:
        return replace(self, base=self.base.bare(), ratings={}, offsets={}, leagues={})

    def payload(self) -> dict:
        return {"schema_version": 1} | _plain(vars(self)) | {"base": self.base.payload()}


@dataclass
class Mixture(Model):
    """A convex mixture of two models' grids."""

    first: Model
    second: Model
    weight: float
    model_type: str = "mixture"

    def __post_init__(self) -> None:
        if not (math.isfinite(self.weight) and 0 <= self.weight <= 1):
            raise ValueError("the weight of a mixture lies in [0, 1]")

    @property
    def known(self) -> Mapping[str, list[float]]:
        return self.first.known

    def parts(self, pairs: DataFrame, prefix: str = "__m") -> DataFrame:
        return self.second.parts(self.first.parts(pairs, prefix + "0"), prefix + "1")

    def grid(self, rows: pd.DataFrame, prefix: str = "__m") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, two = self.first.grid(rows, prefix + "0"), self.second.grid(rows, prefix + "1")
        return tuple(self.weight * a + (1 - self.weight) * b for a, b in zip(one, two, strict=True))

    def rates(self, pairs: DataFrame, home: str = "home_rate", away: str = "away_rate") -> DataFrame:
        rows = self.second.rates(self.first.rates(pairs, "__mh", "__ma"), home, away)
        mean = lambda a, b: F.col(a) * self.weight + F.col(b) * (1 - self.weight)
        return rows.withColumns({home: mean("__mh", home), away: mean("__ma", away)}).drop("__mh", "__ma")

    def bare(self) -> Mixture:
        return replace(self, first=self.first.bare(), second=self.second.bare())

    def payload(self) -> dict:
        return {"schema_version": 1, "model_type": self.model_type, "weight": self.weight, "first": self.first.payload(), "second": self.second.payload()}


@dataclass
class Calibrated(Model):
    """A model whose outcomes are tempered; its rates stay."""

    base: Model
    log_temperature: float
    home_offset: float
    draw_offset: float
    model_type: str = "calibrated"

    @property
    def known(self) -> Mapping[str, list[float]]:
        return self.base.known

    def rates(self, pairs: DataFrame, home: str = "home_rate", away: str = "away_rate") -> DataFrame:
        return self.base.rates(pairs, home, away)

    def parts(self, pairs: DataFrame, prefix: str = "__m") -> DataFrame:
        return self.base.parts(pairs, prefix)

    def grid(self, rows: pd.DataFrame, prefix: str = "__m") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, a, g = self.base.grid(rows, prefix)
        return h, a, grids.tempered(g, self.log_temperature, (self.home_offset, self.draw_offset))

    def bare(self) -> Calibrated:
        return replace(self, base=self.base.bare())

    def payload(self) -> dict:
        return {"schema_version": 1} | dict(vars(self)) | {"base": self.base.payload()}


def _finite(value: object) -> bool:
    if isinstance(value, dict):
        return all(map(_finite, value.values()))
    if isinstance(value, (list, tuple)):
        return all(map(_finite, value))
    return not isinstance(value, float) or math.isfinite(value)


def from_payload(d: dict) -> Model:
    """The model of a payload, nested models included; anything unknown or inconsistent raises."""
    if d.get("schema_version") != 1 or not _finite(d):
        raise ValueError("unknown model payload")
    own = {k: v for k, v in d.items() if k != "schema_version"}
    kind = d.get("model_type")
    if kind in ("poisson", "baseline", "prior_only"):
        if set(d["attack"]) != set(d["defence"]):
            raise ValueError("attack and defence name different teams")
        return GoalModel(**own)
    if kind in ("low_score", "calibrated"):
        return (LowScoreModel if kind == "low_score" else Calibrated)(**own | {"base": from_payload(d["base"])})
    if kind == "mixture":
        return Mixture(from_payload(d["first"]), from_payload(d["second"]), d["weight"])
    raise ValueError("unknown model payload")


def from_json(text: str) -> Model:
    return from_payload(json.loads(text))
