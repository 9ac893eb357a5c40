"""Constraint reports: one aggregate pass, one row per rule with the number of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.operators.matches import stored_instant
from matchlake.schema import OPTIONAL_NUMBERS


def _report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def history_report(history: DataFrame) -> DataFrame:
    """Violations of each rule of the match history, with duplicate keys as a rule of its own."""
    numbers = F.lit(False)
    for c in OPTIONAL_NUMBERS:
        numbers = numbers | (F.col(c).isNotNull() & (F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf"))))
    rules = {
        "blank_home": blank("home"),
        "blank_away": blank("away"),
        "blank_competition": blank("competition"),
        "blank_source": blank("source"),
        "bad_date": stored_instant(F.col("date")).isNull(),
        "same_sides": F.col("home").eqNullSafe(F.col("away")),
        "bad_score": F.col("home_goals").isNull() | F.col("away_goals").isNull() | (F.col("home_goals") < 0) | (F.col("away_goals") < 0),
        "bad_number": numbers,
    }
    copies = history.groupBy("date", "home", "away", "competition").count().where("count > 1")
    return _report(history, rules).unionByName(copies.agg(F.lit("duplicate_key").alias("rule"), F.count("*").alias("violations")))


def schedule_report(fixtures: DataFrame) -> DataFrame:
    """(edition_id, snapshot_no, rule, violations) for every delivery of a schedule."""
    f = fixtures.withColumn("st", F.lower(F.trim("status"))).withColumn("stage_n", F.translate(F.lower(F.trim("stage")), "- ", "__"))
    key = ["edition_id", "snapshot_no"]
    known = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()
    none = F.col("home_goals").isNull() & F.col("away_goals").isNull()
    rules = {
        "bad_status": ~F.coalesce(F.col("st").isin("scheduled", "finished", "postponed"), F.lit(False)),
        "bad_matchday": ~F.coalesce(F.col("matchday").between(1, 8), F.lit(False)),
        "bad_date": stored_instant(F.col("date")).isNull(),
        "bad_stage": ~F.coalesce(F.col("stage_n").isin("league", "league_phase"), F.lit(False)),
        "same_sides": F.col("home").eqNullSafe(F.col("away")),
        "outer_blanks": (F.col("home") != F.trim("home")) | (F.col("away") != F.trim("away")),
        "finished_without_score": (F.col("st") == "finished") & ~known,
        "scheduled_with_score": (F.col("st") == "scheduled") & ~none,
        "half_score": ~known & ~none,
    }
    row = f.groupBy(*key).agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()], (F.count("*") - F.count_distinct("match_id")).alias("repeated_id"), F.abs(F.count("*") - 144).alias("row_count_off"))
    row = row.unpivot(key, [*rules, "repeated_id", "row_count_off"], "rule", "violations")
    pair = f.groupBy(*key, F.least("home", "away").alias("x"), F.greatest("home", "away").alias("y")).count().where("count > 1")
    pair = pair.groupBy(*key).agg(F.lit("repeated_pair").alias("rule"), F.count("*").alias("violations"))
    sides = f.select(*key, F.col("home").alias("team"), F.lit(1).alias("h")).unionAll(f.select(*key, F.col("away").alias("team"), F.lit(0).alias("h")))
    balance = sides.groupBy(*key, "team").agg(F.sum("h").alias("home_n"), F.count("*").alias("n")).where("home_n <> 4 or n <> 8")
    balance = balance.groupBy(*key).agg(F.lit("unbalanced_team").alias("rule"), F.count("*").alias("violations"))
    return row.where("violations > 0").unionByName(pair).unionByName(balance)


def probability_report(table: DataFrame, columns: list[str]) -> DataFrame:
    """Violations in a table of probabilities: blank or repeated team, non-finite value, value outside [0, 1]."""
    bad = outside = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c)
        outside = outside | (F.col(c) < 0) | (F.col(c) > 1)
    return _report(table, {"blank_team": blank("team"), "not_finite": bad, "outside_unit": outside}).unionByName(table.agg(F.lit("repeated_team").alias("rule"), (F.count("team") - F.count_distinct("team")).alias("violations")))
