"""Schema of the match history."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns records are exchanged in.
CORE = ["date", "home", "away", "home_goals", "away_goals", "competition", "source"]
OPTIONAL_NUMBERS = ["home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target", "odds_home", "odds_draw", "odds_away", "home_xg", "away_xg"]
HISTORY = T.StructType(
    [T.StructField(c, T.StringType() if c not in ("home_goals", "away_goals") else T.IntegerType()) for c in CORE]
    + [T.StructField(c, T.DoubleType()) for c in OPTIONAL_NUMBERS]
    + [T.StructField("odds_provider", T.StringType()), T.StructField("odds_semantics", T.StringType()), T.StructField("completed_at", T.TimestampNTZType())]
)
