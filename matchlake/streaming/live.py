"""Live match records: windowed counts with late data, and coverage per team kept across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators import matches as M


def windowed_counts(records: DataFrame, late: str = "2 days", width: str = "7 days") -> DataFrame:
    """Matches and goals per competition and window of kick-off; records later than ``late`` are left out.

    Works on a stream and on a table alike: records need the history's columns.
    """
    rows = M.valid_matches(records).withColumn("at", F.col("date").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", width), "competition").agg(F.count("*").alias("matches"), F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals"))
    return out.select(F.col("window.start").alias("start"), "competition", "matches", "goals")


def first_deliveries(records: DataFrame, late: str = "7 days") -> DataFrame:
    """Each match once, however often it is delivered: state is dropped once a kick-off is ``late`` behind."""
    rows = M.valid_matches(records).withColumn("at", F.col("date").cast("timestamp"))
    if rows.isStreaming:
        return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["at", "home", "away", "competition"])
    return rows.dropDuplicates(["at", "home", "away", "competition"])
