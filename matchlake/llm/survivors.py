"""Best representative of each duplicate group (problem 1).

Match records are one match when their UTC day, both teams and the competition agree, however date and names are
printed. One aggregation builds the survivor field by field: for each attribute the maximum of the composite
``(usable, source priority, retrieved, row_id, value)`` is taken, so the best trusted, latest usable value wins without
sorting a group, and a group with a third of all rows is combined before the shuffle.

Defined results: records without an instant, a known team on either side or a competition belong to no match and are
left out; sources without a trust rank come after all ranked ones; a null retrieval time comes before any other; ties
end with the larger row_id; exact copies count as rows of their group; an attribute with no usable value is null (-1 as
a row id); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.names import SPELLINGS, all_spellings
from matchlake.operators.timestamps import read_timestamps
from matchlake.util import lookup_join, materialize

DAY = 86_400
KEY = ["day", "home_id", "away_id", "competition"]
NUMBERS = ["home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target", "odds_home", "odds_draw", "odds_away"]


def survivors(rows: DataFrame, key: list[str], order: list[Column], attributes: dict[str, tuple[Column, Column]], extra: list[Column] | None = None) -> DataFrame:
    """One row per ``key``: each attribute ``name: (usable, value)`` from the usable row that is largest in ``order``."""
    best = [F.max(F.when(F.coalesce(usable, F.lit(False)), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.alias("value")))).alias(name) for name, (usable, value) in attributes.items()]
    out = rows.groupBy(*key).agg(*best, *(extra or []))
    return out.select(*key, *[F.col(f"{name}.value").alias(name) for name in attributes], *[c for c in out.columns if c not in key and c not in attributes])


def match_rows(history: DataFrame, teams: DataFrame, sources: DataFrame, spellings: DataFrame | None = None) -> DataFrame:
    """``history`` with ``ts_seconds``, ``ts_has_time``, ``day``, ``home_id``, ``away_id`` and ``priority``."""
    names = materialize(spellings if spellings is not None else all_spellings(history, teams), "names")
    rows = read_timestamps(history.select("row_id", "date", "home", "away", "home_goals", "away_goals", "competition", "source", *[c for c in NUMBERS if c in history.columns], "retrieved_at"), sources)
    rows = rows.drop("ts_utc", "ts_reading", "ts_posterior", "ts_status")
    trust = sources.where("source is not null").groupBy("source").agg((-F.min("trust_rank")).alias("priority"))
    rows = lookup_join(rows, trust, ["source"])
    rows = lookup_join(rows, names.select(F.col("typed").alias("home"), F.col("team_id").alias("home_id")), ["home"], limit=SPELLINGS, held=True)
    rows = lookup_join(rows, names.select(F.col("typed").alias("away"), F.col("team_id").alias("away_id")), ["away"], limit=SPELLINGS, held=True)
    return rows.withColumn("day", F.floor(F.col("ts_seconds") / DAY))


def usable_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))


ORDER = ["priority", "retrieved_at", "row_id"]


def match_groups(history: DataFrame, teams: DataFrame, sources: DataFrame) -> DataFrame:
    """Row ids the survivor of each match of two or more rows takes its source, shots and date from."""
    rows = match_rows(history, teams, sources).where("day is not null and home_id is not null and away_id is not null and competition is not null")
    order = [F.coalesce("priority", F.lit(-(2**31))), F.col("retrieved_at"), F.col("row_id")]
    always, row = F.lit(True), F.col("row_id")
    out = survivors(
        rows,
        KEY,
        order,
        {"first_row": (always, row), "shots_row": (usable_number(F.col("home_shots")), row), "timed_row": (F.col("ts_has_time"), row)},
        [F.min("row_id").alias("group_row_id"), F.count("*").alias("n")],
    ).where("n >= 2")
    return out.select("group_row_id", F.col("first_row").alias("source_row_id"), F.coalesce("shots_row", F.lit(-1)).cast("bigint").alias("shots_row_id"), F.coalesce("timed_row", "first_row").alias("date_row_id"))


def match_survivors(history: DataFrame, teams: DataFrame, sources: DataFrame, spellings: DataFrame | None = None) -> DataFrame:
    """One built record per match, of groups of any size, every field from its best usable row."""
    rows = match_rows(history, teams, sources, spellings).where("day is not null and home_id is not null and away_id is not null and competition is not null")
    order = [F.coalesce("priority", F.lit(-(2**31))), F.col("retrieved_at"), F.col("row_id")]
    always = F.lit(True)
    goals = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull() & (F.col("home_goals") >= 0) & (F.col("away_goals") >= 0)
    whole_odds = F.col("odds_home").isNotNull() & F.col("odds_draw").isNotNull() & F.col("odds_away").isNotNull()
    out = survivors(
        rows,
        KEY,
        order,
        {
            "source": (always, F.col("source")),
            "score": (goals, F.struct("home_goals", "away_goals")),
            **{c: (usable_number(F.col(c)), F.col(c)) for c in NUMBERS[:4] if c in rows.columns},
            "odds": (whole_odds, F.struct("odds_home", "odds_draw", "odds_away")),
            "timed": (F.col("ts_has_time"), F.col("ts_seconds")),
            "any_time": (always, F.col("ts_seconds")),
        },
        [F.min("row_id").alias("group_row_id"), F.count("*").alias("n_rows")],
    )
    return out.select("group_row_id", "n_rows", *KEY, "source", F.coalesce("timed", "any_time").alias("seconds"), "score.*", *[c for c in NUMBERS[:4] if c in rows.columns], "odds.*")
