"""Rating replay: every match reads ratings, leagues and offsets of strictly earlier instants.

What a match reads besides ratings does not depend on them and is found for all matches at once: the league of a side is
the competition of its last domestic match before the instant, its international evidence a sum of decayed counts before
it; both are as-of lookups in sorted arrays. What remains is a recursion over two vectors, the ratings of teams and the
offsets of leagues, advanced one instant at a time.

The recursion is sequential by nature and its decay depends on the cutoff, so cutoffs run in parallel and each one is a
task that holds :data:`MOST_MATCHES` matches at most; more raise. A task reads its matches in batches, holds them as
numbers and gives them back in batches. Nothing after a cutoff is read for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.util import materialize, materialize_apart

MOST_MATCHES = 5_000_000

# Competitions between leagues, and where the offsets of known leagues begin.
CROSS_LEAGUE = ["UCL", "UCL qualifying", "UEL", "UEL qualifying", "UECL", "UECL qualifying"]
ASSOCIATION = {"E0": 55.0, "I1": 45.0, "SP1": 42.0, "D1": 38.0, "F1": 20.0, "N1": 14.0, "B1": 5.0, "P1": 0.0, "G1": -22.0, "T1": -22.0, "AUT": -30.0, "NOR": -35.0}


@dataclass(frozen=True)
class RatingConfig:
    initial: float = 1500.0
    k: float = 24.0
    home: float = 55.0
    half_life: float = 365.0
    league_k: float = 8.0
    league_shrink: float = 20.0
    international_shrink: float = 8.0
    min_weight: float = 0.45

    def validate(self) -> RatingConfig:
        for name, value in vars(self).items():
            if isinstance(value, bool) or not (value == value and abs(value) < float("inf")) or (value < 0 and name not in ("initial", "home")):
                raise ValueError(f"{name} must be a finite number, and >= 0")
        if 0 in (self.k, self.half_life, self.league_shrink, self.international_shrink) or self.min_weight > 1:
            raise ValueError("k, half_life and the shrinkages must be positive and min_weight at most 1")
        return self


#: One fold gives rows of three kinds; what a kind does not have is null.
COLUMNS = (
    "kind string, cutoff string, row_id bigint, date timestamp_ntz, home string, away string, home_rating double, away_rating double, home_league string, away_league string, "
    "home_offset double, away_offset double, expected double, recency double, name string, rating double, offset double, evidence double, league string"
)
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "timestamp_ntz": pa.timestamp("us")}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in COLUMNS.split(", "))])
#: Rows of one batch that a task gives back.
BATCH = 50_000
MATCH = ["cutoff", "row_id", "date", "home", "away", "home_rating", "away_rating", "home_league", "away_league", "home_offset", "away_offset", "expected", "recency"]
TEAM = ["cutoff", "name", "rating", "evidence", "league"]
LEAGUE = ["cutoff", "name", "offset", "evidence"]


class _Earlier:
    """What was last known of each of ``n`` owners strictly before an instant."""

    def __init__(self, owner: np.ndarray, at: np.ndarray, match: np.ndarray, instants: int):
        self.span = instants + 1
        key = owner.astype(np.int64) * self.span + at
        self.order = np.lexsort((match, key))  # of one instant the later match counts
        self.key = key[self.order]

    def _place(self, owner: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        return np.searchsorted(self.key, owner.astype(np.int64) * self.span + at, "left")

    def last(self, owner: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Index of the last event, -1 without any."""
        place = self._place(owner, at)
        begin = self._place(owner, 0)
        out = np.full(len(owner), -1)
        has = place > begin
        out[has] = self.order[place[has] - 1]
        return out

    def total(self, weight: np.ndarray, owner: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Sum of the weights of the events."""
        running = np.concatenate([[0.0], np.cumsum(weight[self.order])])
        return running[self._place(owner, at)] - running[self._place(owner, 0)]


def _checked(games: pd.DataFrame) -> pd.DataFrame:
    """The matches of a replay; a row that is no complete match raises, since every later rating would depend on it."""
    needed = games[["date", "home", "away", "home_goals", "away_goals", "competition"]]
    named = games["home"].fillna("").str.strip().ne("") & games["away"].fillna("").str.strip().ne("") & games["home"].ne(games["away"])
    if needed.isna().any(axis=None) or not named.all() or (games[["home_goals", "away_goals"]] < 0).any(axis=None):
        raise ValueError("a replay needs complete matches between two named sides")
    return games


def _coded(names: pa.Array, ids: dict[str, int]) -> np.ndarray:
    """The numbers of ``names`` in ``ids``, which takes up new ones."""
    coded = names.dictionary_encode()
    return np.array([ids.setdefault(x, len(ids)) for x in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy(zero_copy_only=False)]


def _in_order(ids: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """The names sorted, and the place of each number there."""
    names = sorted(ids)
    place = np.empty(len(ids), np.int32)
    place[[ids[x] for x in names]] = np.arange(len(ids), dtype=np.int32)
    return names, place


def _rows(kind: str, cutoff: str, n: int, columns: dict[str, object]) -> pa.RecordBatch:
    given = {"kind": pa.repeat(pa.scalar(kind), n), "cutoff": pa.repeat(pa.scalar(cutoff), n)} | columns
    return pa.RecordBatch.from_arrays([pa.array(given[f.name]).cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _folding(cutoff: str, c: RatingConfig):
    """The task of one cutoff: its matches come in batches and are held as numbers, rows go out in batches."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team_ids: dict[str, int] = {}
        comp_ids: dict[str, int] = {}
        parts: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            count += batch.num_rows
            if count > MOST_MATCHES:
                raise ValueError("a replay folds at most MOST_MATCHES matches; split by competition")
            if batch.num_rows:
                _checked(batch.to_pandas())
                at, gap = batch["date"].cast(pa.int64()).to_numpy(), batch["home_goals"].to_numpy().astype(np.int32) - batch["away_goals"].to_numpy().astype(np.int32)
                parts.append([batch["row_id"].to_numpy(), at, gap, _coded(batch["home"], team_ids), _coded(batch["away"], team_ids), _coded(batch["competition"], comp_ids)])
        if not parts:
            return
        row_id, at, gap, home, away, comp = (np.concatenate([p[k] for p in parts]) for k in range(6))
        parts.clear()
        teams, team_place = _in_order(team_ids)
        comps, comp_place = _in_order(comp_ids)
        home, away, comp = team_place[home], team_place[away], comp_place[comp]
        order = np.lexsort((row_id, away, home, comp, at))
        yield from _fold([x[order] for x in (row_id, at, gap, home, away, comp)], teams, comps, cutoff, c)

    return fold


def _fold(games: list[np.ndarray], teams: list[str], comps: list[str], cutoff: str, c: RatingConfig) -> Iterator[pa.RecordBatch]:
    """The rows of one cutoff's replay of ``games``: row ids, microseconds, goal differences and the numbers of sides and
    competitions, in order."""
    row_id, at, gap, home, away, comp = games
    n = len(row_id)
    age = np.maximum((np.datetime64(pd.Timestamp(cutoff), "us").astype(np.int64) - at) / 1e6, 0.0) / 86_400
    recency = np.exp2(-age / c.half_life)
    instant = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1]).astype(int)]))
    instants = int(instant[-1]) + 1
    cross = np.array([x.strip() in CROSS_LEAGUE for x in comps])[comp]
    actual = np.where(gap > 0, 1.0, np.where(gap == 0, 0.5, 0.0))
    size = np.abs(gap)
    margin = np.where(size <= 1, 1.0, np.where(size == 2, 1.5, (11 + size) / 8))

    domestic = np.flatnonzero(~cross)
    both = np.concatenate([domestic, domestic])
    seen = _Earlier(np.concatenate([home[domestic], away[domestic]]), np.concatenate([instant[domestic]] * 2), both, instants)

    def league_before(team: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        last = seen.last(team, at)
        return np.where(last >= 0, comp[both[last]] if len(both) else -1, -1)

    home_league = np.where(cross, league_before(home, instant), comp)
    away_league = np.where(cross, league_before(away, instant), comp)
    counted = np.flatnonzero(cross & (home_league >= 0) & (away_league >= 0) & (home_league != away_league))
    abroad = _Earlier(np.concatenate([home[counted], away[counted]]), np.concatenate([instant[counted]] * 2), np.concatenate([counted] * 2), instants)
    weights = np.concatenate([recency[counted]] * 2)

    def trust(evidence: np.ndarray) -> np.ndarray:
        return c.min_weight + (1 - c.min_weight) * evidence / (evidence + c.international_shrink)

    home_trust = np.where(cross, trust(abroad.total(weights, home, instant)), 1.0)
    away_trust = np.where(cross, trust(abroad.total(weights, away, instant)), 1.0)

    ratings, offsets, read = _advance(
        instant, home, away, home_league, away_league, home_trust, away_trust, c.k * recency * margin, np.where(np.isin(np.arange(n), counted), c.league_k * recency, 0.0), recency, actual, cross, comp, comps, len(teams), c
    )
    name = lambda league: pa.array(comps, pa.string()).take(pa.array(league, pa.int64(), mask=league < 0))
    side = lambda team: pa.array(teams, pa.string()).take(pa.array(team))
    for begin in range(0, n, BATCH):
        x = slice(begin, begin + BATCH)
        numbers = dict(zip(("home_rating", "away_rating", "home_offset", "away_offset", "expected"), read[x].T.copy(), strict=True))
        own = {"row_id": row_id[x], "date": pa.array(at[x], pa.int64()), "home": side(home[x]), "away": side(away[x]), "home_league": name(home_league[x]), "away_league": name(away_league[x]), "recency": recency[x]}
        yield _rows("match", cutoff, len(own["row_id"]), own | numbers)
    ids = np.arange(len(teams))
    evidence = abroad.total(weights, ids, instants)
    yield _rows("team", cutoff, len(teams), {"name": pa.array(teams, pa.string()), "rating": c.initial + ratings * trust(evidence), "evidence": evidence, "league": name(league_before(ids, instants))})
    born = ~np.isnan(offsets)
    shared = np.bincount(np.concatenate([home_league[counted], away_league[counted]]), weights, len(comps)) if len(counted) else np.zeros(len(comps))
    if born.any():
        yield _rows("league", cutoff, int(born.sum()), {"name": name(np.flatnonzero(born)), "offset": offsets[born], "evidence": shared[born]})


def _advance(instant, home, away, home_league, away_league, home_trust, away_trust, step, league_step, recency, actual, cross, comp, comps, n_teams, c):
    """Ratings (as deviations) and offsets after the last instant, and what every match read: both sides' ratings and
    offsets and the expected score."""
    ratings = np.zeros(n_teams)
    offsets, evidence = np.full(len(comps), np.nan), np.zeros(len(comps))
    prior = np.array([ASSOCIATION.get(x, 0.0) for x in comps])
    read = np.empty((len(instant), 5))
    bounds = np.flatnonzero(np.concatenate([[True], instant[1:] != instant[:-1], [True]]))
    for begin, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        now = slice(begin, stop)
        h, a, lh, la = home[now], away[now], home_league[now], away_league[now]
        known = np.append(np.nan_to_num(offsets), 0.0)  # a league that is not known reads the last entry
        rh, ra, oh, oa = ratings[h] * home_trust[now], ratings[a] * away_trust[now], known[lh], known[la]
        expected = 1 / (1 + 10.0 ** (-(rh + oh + c.home - ra - oa) / 400))
        read[now] = np.stack([c.initial + rh, c.initial + ra, oh, oa, expected], 1)
        surprise = actual[now] - expected
        np.add.at(ratings, h, step[now] * surprise)
        np.add.at(ratings, a, -step[now] * surprise)
        fresh = comp[now][~cross[now]]
        fresh = fresh[np.isnan(offsets[fresh])]
        offsets[fresh] = prior[fresh]
        moves = np.flatnonzero(league_step[now])
        if len(moves):
            pull = league_step[now][moves] * surprise[moves]
            for league, sign in ((lh[moves], 1.0), (la[moves], -1.0)):
                np.add.at(offsets, league, sign * pull)
                np.add.at(evidence, league, recency[now][moves])
        if (len(moves) or len(fresh)) and evidence.sum():
            offsets -= np.nansum(offsets * evidence) / evidence.sum()
    return ratings, offsets, read


def replay_tables(rows: DataFrame, cutoffs: list[str], config: RatingConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, teams, leagues) of a replay per cutoff.

    matches: what each match before the cutoff read; teams: final rating, drawn to the initial one by how little is known
    from abroad, evidence and league; leagues: offset and evidence.
    """
    c = (config or RatingConfig()).validate()
    base = materialize(rows.select("row_id", "date", "home", "away", "home_goals", "away_goals", "competition"), "matches")
    parts = [base.where(F.col("date") < F.lit(x).cast("timestamp_ntz")).coalesce(1).mapInArrow(_folding(x, c), COLUMNS) for x in dict.fromkeys(cutoffs)]
    out = materialize_apart(parts, "replay") if parts else rows.sparkSession.createDataFrame([], COLUMNS)
    return tuple(out.where(F.col("kind") == kind).select(*columns) for kind, columns in (("match", MATCH), ("team", TEAM), ("league", LEAGUE)))


def replay(rows: DataFrame, cutoffs: list[str], config: RatingConfig | None = None) -> DataFrame:
    """Pre-match ratings, leagues and offsets of every match before each cutoff."""
    return replay_tables(rows, cutoffs, config)[0]
