"""Queries of the operators for training text and records, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import leaks, mixing, names, quality, ranking, survivors
from matchlake.operators import matches, standings
from matchlake.plans import match_queries
from matchlake.util import lookup_join, materialize, ntz_from_unix, scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.match_groups(table(spark, d, "history"), table(spark, d, "teams"), table(spark, d, "sources"))


_survivors: dict[tuple[str, str], DataFrame] = {}


def shared_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The survivors of p1 over a folder's tables, built once per application and read by every query that starts from
    them."""
    key = scratch(spark), d  # released folders take what was shared with them
    if key not in _survivors:
        _survivors[key] = materialize(survivors.match_survivors(table(spark, d, "history"), table(spark, d, "teams"), table(spark, d, "sources")), "survivors")
    return _survivors[key]


def any_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The shared survivors where they exist already, else a plan of its own, of which only what is read is computed."""
    if (scratch(spark), d) in _survivors:
        return shared_survivors(spark, d)
    return survivors.match_survivors(table(spark, d, "history"), table(spark, d, "teams"), table(spark, d, "sources"))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return shared_survivors(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_sides(table(spark, d, "history"), table(spark, d, "teams"))


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    return names.recall(table(spark, d, "history"), table(spark, d, "teams"))


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    teams = table(spark, d, "teams")
    outcomes = any_survivors(spark, d).select(F.col("home_id").alias("a"), F.col("away_id").alias("b"), F.col("home_goals").alias("a_score"), F.col("away_goals").alias("b_score"))
    strengths = ranking.spectral_ranking(outcomes)
    return ranking.ranked(teams.select(F.col("team_id").cast("bigint").alias("team_id"), "name"), strengths, "team_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leaks.reparameterised(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.reached_shares(materialize(p9_selection(spark, d), "selection"), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.flagged(table(spark, d, "documents"))


def team_spellings(spark: SparkSession, d: str) -> DataFrame:
    """(typed, name) of every spelling in history or fixtures that refers to a team."""
    teams = table(spark, d, "teams")
    sides = table(spark, d, "history").select("home", "away").unionByName(table(spark, d, "fixtures").select("home", "away"))
    rows = names.all_spellings(sides.withColumn("row_id", F.lit(0).cast("bigint")), teams)
    return rows.join(teams.select(F.col("team_id").cast("bigint").alias("team_id"), "name"), "team_id").select("typed", "name")


def team_matches(spark: SparkSession, d: str) -> DataFrame:
    """One row per match between known teams: the survivors of p1, dates as in p4, sides as in p5, under the teams' names."""
    teams = table(spark, d, "teams").select(F.col("team_id").cast("bigint").alias("id"), "name")
    rows = shared_survivors(spark, d).where("home_goals is not null and home_id <> away_id")
    for side in ("home", "away"):
        rows = lookup_join(rows, teams.toDF(f"{side}_id", side), [f"{side}_id"], "inner")
    return rows.select(F.col("group_row_id").alias("row_id"), ntz_from_unix(F.col("seconds")).alias("date"), "home", "away", "home_goals", "away_goals", "competition", "source", "home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target", F.lit(None).cast("timestamp_ntz").alias("completed_at"))


def team_coverage_curated(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the known teams over all their matches, however they are recorded."""
    return matches.coverage(team_matches(spark, d), match_queries.CUT)


def standings_curated(spark: SparkSession, d: str) -> DataFrame:
    return standings.ranked(standings.metrics(materialize(team_matches(spark, d), "matches"), ["competition"]), ["competition"], F.col("team"))


def p6_agreement(spark: SparkSession, d: str) -> DataFrame:
    """(held_out, spectral, win_share): decided matches of a half kept back by a hash of their day and sides, and the
    shares of them that the ranking of the other half and its teams' mean margins foresee."""
    rows = any_survivors(spark, d).select(F.col("home_id").alias("a"), F.col("away_id").alias("b"), F.col("home_goals").alias("a_score"), F.col("away_goals").alias("b_score"), (F.xxhash64("day", "home_id", "away_id") % 2 == 0).alias("held"))
    return ranking.agreement(materialize(rows, "outcomes"), "held")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_survivors, p5_found, p5_recall, p6_ranking, p6_agreement, p8_found, p8_reparameterised, p9_selection, p9_shares, p10_found, p10_statistics, team_coverage_curated, standings_curated)
}
# The models of known teams, over the matches that p1, p4 and p5 make of the records instead of plainly read ones.
_FITTED = ["poisson_map_fit", "shot_blend_fit", "low_score_fit", "elo_replay", "elo_ratings", "league_offsets", "model_coverage", "rolling_evaluation", "model_decision"]
QUERIES |= {n: partial(match_queries.QUERIES[n], matches=team_matches) for n in _FITTED}
QUERIES["known_schedule"] = partial(match_queries.known_schedule, spellings=team_spellings)
QUERIES["season_forecast"] = partial(match_queries.season_forecast, matches=team_matches, spellings=team_spellings)
READERS = (team_spellings, team_matches)
SQL: dict[str, str] = {}
