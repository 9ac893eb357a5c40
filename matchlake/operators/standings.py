"""League tables with nine ranking keys, and rank bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.matches import by_side

NINE = ["points", "gd", "gf", "away_gf", "wins", "away_wins", "opp_points", "opp_gd", "opp_gf"]


def metrics(matches: DataFrame, group: list[str]) -> DataFrame:
    """The nine keys per team of each group; the last three are sums over the opponents met."""
    s = by_side(matches).select(*group, "team", "opponent", "gf", "ga", "is_away")
    won, away = F.col("gf") > F.col("ga"), F.col("is_away") == 1

    def total(c: Column) -> Column:
        return F.sum(c).cast("bigint")

    base = s.groupBy(*group, "team").agg(
        total(F.when(won, 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)).alias("points"),
        total(F.col("gf") - F.col("ga")).alias("gd"),
        total(F.col("gf")).alias("gf"),
        total(F.when(away, F.col("gf")).otherwise(0)).alias("away_gf"),
        total(F.when(won, 1).otherwise(0)).alias("wins"),
        total(F.when(won & away, 1).otherwise(0)).alias("away_wins"),
    )
    met = s.groupBy(*group, "team", "opponent").agg(F.count("*").alias("times"))
    rival = base.select(*group, F.col("team").alias("opponent"), "points", "gd", "gf")
    opp = met.join(rival, [*group, "opponent"]).groupBy(*group, "team").agg(*[total(F.col("times") * F.col(c)).alias(f"opp_{c}") for c in ("points", "gd", "gf")])
    return base.join(opp, [*group, "team"])


def ranked(table: DataFrame, group: list[str], last: Column) -> DataFrame:
    """Adds ``pos``: the nine keys descending, then ``last``."""
    w = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in NINE], last)
    return table.withColumn("pos", F.row_number().over(w).cast("bigint"))


def tie_groups(table: DataFrame, group: list[str]) -> DataFrame:
    """Per group: sets of teams equal on all nine keys, and how many teams are in one."""
    runs = table.groupBy(*group, *NINE).agg(F.count("*").alias("n")).where("n > 1")
    return runs.groupBy(*group).agg(F.count("*").alias("tie_groups"), F.sum("n").cast("bigint").alias("tied_teams"))


def band(pos: Column) -> Column:
    return F.when(pos <= 8, "top8").when(pos <= 16, "seeded").when(pos <= 24, "unseeded").otherwise("eliminated")
