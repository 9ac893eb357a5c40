"""Models of known teams take every spelling of a team."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from matchlake.plans import match_queries

TEAMS = [(1, "Dynamo Fafaborkel", None), (2, "Corkelhelsol United", None), (5, "Union Trani Selda", "The Cobalt Plovers"), (6, "Bortídrazor", None)]
SIDES = [
    ("Dynamo Fafaborkel", "Corkelhelsol United"),
    ("dynamo  FAFABORKEL", "Bortídrazor"),
    (r"Bort\u00eddrazor", "Union Trani Selda"),
    ("The Cobalt Plovers", "Corkelhelsol Utd"),
    ("Dynamo Fafaborkle", "Union Trani Selda"),
    ("Guests of Nowhere", "Bortídrazor"),
    ("Bortidrazor", "Bortídrazor"),
]


def test_variant_spellings_are_played_under_the_team_name(spark, tmp_path):
    rows = [(i, f"2024-03-{i + 1:02d}T15:00:00Z", h, a, 1 + i % 2, 1, "L", "s") for i, (h, a) in enumerate(SIDES)]
    rows.append((50, "2024-03-01T15:00:00Z", "DYNAMO FAFABORKEL", "Corkelhelsol United", 3, 0, "L", "s"))  # row 0 again
    history = spark.createDataFrame(rows, "row_id bigint, date string, home string, away string, home_goals int, away_goals int, competition string, source string")
    for c in ("home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target", "odds_home", "odds_draw", "odds_away"):
        history = history.withColumn(c, F.lit(None).cast("double"))
    for c in ("completed_at", "retrieved_at"):
        history = history.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    history.write.parquet(f"{tmp_path}/history.parquet")
    spark.createDataFrame([("s", 1, "UTC", "DMY")], "source string, trust_rank int, tz_name string, date_order string").write.parquet(f"{tmp_path}/sources.parquet")
    spark.createDataFrame([(i, h, a) for i, (h, a) in enumerate(SIDES)], "row_id bigint, home string, away string").write.parquet(f"{tmp_path}/fixtures.parquet")
    spark.createDataFrame(TEAMS, "team_id bigint, name string, nickname string").write.parquet(f"{tmp_path}/teams.parquet")
    names = {n for _, n, _ in TEAMS}
    last = lambda q: {r["row_id"]: (r["home"], r["away"]) for r in q["elo_replay"](spark, str(tmp_path)).where("cutoff like '2025%'").collect()}
    got = last(queries())
    assert set(got) == {0, 1, 2, 3, 4} and all({*x} <= names for x in got.values())
    assert got[4] == ("Dynamo Fafaborkel", "Union Trani Selda") and got[2][0] == "Bortídrazor"
    assert {r["team"] for r in queries()["poisson_map_fit"](spark, str(tmp_path)).collect()} == names
    assert set(last(match_queries.QUERIES)) == {0, 2}  # without links only plain forms are resolved
