"""Valid matches and what can be known of them before a cutoff.

Nulls: rows that break a rule are filtered and counted by :mod:`matchlake.operators.validate`, never repaired. Times are
TIMESTAMP_NTZ in UTC. A cutoff is exclusive everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.dist import decay_weight
from matchlake.operators.timestamps import STRICT

KEY = ["date", "home", "away", "competition"]
#: Competitions between leagues; labels with "qualifying" count too.
EUROPEAN = ["UCL", "UEL", "UECL"]


def stored_instant(c: Column) -> Column:
    """TIMESTAMP_NTZ of a date in the stored form, null for any other text and for impossible dates."""
    return F.when(c.rlike(STRICT), F.translate(F.replace(c, F.lit("T"), F.lit(" ")), "Z", "").try_cast("timestamp_ntz"))


def valid_matches(history: DataFrame) -> DataFrame:
    """Rows with a stored, real date, two different named sides, whole scores and a competition."""
    rows = history.withColumn("date", stored_instant(F.col("date")))
    named = (F.trim("home") != "") & (F.trim("away") != "") & (F.col("home") != F.col("away")) & (F.trim("competition") != "")
    return rows.where(F.col("date").isNotNull() & named & (F.col("home_goals") >= 0) & (F.col("away_goals") >= 0))


def one_per_key(matches: DataFrame, priority: str = "row_id") -> DataFrame:
    """One row per date, sides and competition: the one with the largest ``priority``."""
    rest = [c for c in matches.columns if c not in KEY]
    best = matches.groupBy(*KEY).agg(F.max(F.struct(priority, *[c for c in rest if c != priority])).alias("m"))
    return best.select(*KEY, *[F.col(f"m.{c}").alias(c) for c in rest])


def before(matches: DataFrame, cutoff: str) -> DataFrame:
    return matches.where(F.col("date") < F.lit(cutoff).cast("timestamp_ntz"))


def completed_before(matches: DataFrame, cutoff: str) -> DataFrame:
    """Matches known to be over: kick-off <= completed_at < cutoff; an unknown completion is excluded."""
    return matches.where((F.col("date") <= F.col("completed_at")) & (F.col("completed_at") < F.lit(cutoff).cast("timestamp_ntz")))


def masked_scores(fixtures: DataFrame, cutoff: str, matchday: int) -> DataFrame:
    """Scores as visible at ``cutoff``: finished, on a matchday up to ``matchday`` and three hours past kick-off."""
    at = stored_instant(F.col("date"))
    seen = F.coalesce((at + F.expr("INTERVAL '3' HOUR") < F.lit(cutoff).cast("timestamp_ntz")) & (F.col("matchday") <= matchday) & (F.lower(F.trim("status")) == "finished"), F.lit(False))
    return fixtures.withColumns({"home_goals": F.when(seen, F.col("home_goals")), "away_goals": F.when(seen, F.col("away_goals")), "status": F.when(seen, "finished").otherwise("scheduled")})


def played_fixtures(fixtures: DataFrame) -> DataFrame:
    """Finished fixtures in the history's shape, labelled UCL and completed three hours after kick-off."""
    at = stored_instant(F.col("date"))
    rows = fixtures.where((F.lower(F.trim("status")) == "finished") & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    return rows.select("row_id", at.alias("date"), "home", "away", "home_goals", "away_goals", F.lit("UCL").alias("competition"), "source", (at + F.expr("INTERVAL '3' HOUR")).alias("completed_at")).where("date is not null")


def training_union(matches: DataFrame, played: DataFrame) -> DataFrame:
    """Both inputs with ``origin`` (history 0, fixtures 1) and a filled ``completed_at``."""
    own = matches.select("row_id", "date", "home", "away", "home_goals", "away_goals", "competition", "source", "completed_at").withColumn("origin", F.lit(0))
    both = own.unionByName(played.withColumn("origin", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("completed_at", F.coalesce("completed_at", F.col("date") + F.expr("INTERVAL '3' HOUR")))


def training_set(matches: DataFrame, played: DataFrame, cutoff: str) -> DataFrame:
    """Matches over before the cutoff, one per day and sides; fixtures win over history, then the later row."""
    rows = training_union(matches, played).where(F.col("completed_at") < F.lit(cutoff).cast("timestamp_ntz")).withColumn("day", F.col("date").cast("date"))
    rest = ["date", "home_goals", "away_goals", "competition", "source", "completed_at"]
    best = rows.groupBy("day", "home", "away").agg(F.max(F.struct("origin", "row_id", *rest)).alias("m"))
    return best.select("day", "home", "away", "m.origin", "m.row_id", *[F.col(f"m.{c}").alias(c) for c in rest])


def score_conflicts(rows: DataFrame) -> DataFrame:
    """Day and sides reported with more than one score."""
    rows = rows.withColumn("day", F.col("date").cast("date"))
    return rows.groupBy("day", "home", "away").agg(F.count("*").alias("n_rows"), F.count_distinct("home_goals", "away_goals").alias("n_scores")).where("n_scores > 1")


def by_side(matches: DataFrame) -> DataFrame:
    """Two rows per match, one for each side: team, opponent, gf, ga, is_away and the match's other columns."""
    sides = F.array(
        F.struct(F.col("home").alias("team"), F.col("away").alias("opponent"), F.col("home_goals").alias("gf"), F.col("away_goals").alias("ga"), F.lit(0).alias("is_away")),
        F.struct(F.col("away").alias("team"), F.col("home").alias("opponent"), F.col("away_goals").alias("gf"), F.col("home_goals").alias("ga"), F.lit(1).alias("is_away")),
    )
    return matches.withColumn("__s", F.explode(sides)).select("*", "__s.*").drop("__s")


def age_days(cutoff: str) -> Column:
    end = F.lit(cutoff).cast("timestamp_ntz").cast("timestamp")
    return (F.unix_micros(end) - F.unix_micros(F.col("date").cast("timestamp"))) / 86_400_000_000.0


def coverage(matches: DataFrame, cutoff: str, half_life: float = 365.0) -> DataFrame:
    """(team, matches, weight, latest): matches before the cutoff, decayed weight and the last date."""
    rows = before(matches, cutoff).withColumn("w", decay_weight(age_days(cutoff), half_life))
    return by_side(rows).groupBy("team").agg(F.count("*").alias("matches"), F.sum("w").alias("weight"), F.max("date").alias("latest"))


def european(c: Column) -> Column:
    return c.isin(*EUROPEAN) | F.lower(c).contains("qualifying")


def modal_league(matches: DataFrame) -> DataFrame:
    """(team, league): each team's most frequent domestic competition, ties alphabetically, OTHER without any."""
    sides = by_side(matches).select("team", "competition")
    teams = sides.select("team").distinct()
    counts = sides.where(~european(F.col("competition"))).groupBy("team", "competition").count()
    best = counts.groupBy("team").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("competition"))).alias("m"))
    return teams.join(best, "team", "left").select("team", F.coalesce("m.competition", F.lit("OTHER")).alias("league"))


def baseline_rates(matches: DataFrame, cutoff: str, half_life: float = 365.0, prior_matches: float = 10.0, prior_away: float = 1.35, prior_advantage: float = 0.15) -> DataFrame:
    """One row: decayed scoring rates drawn to a prior; intercept is the log away rate, advantage the log ratio."""
    rows = before(matches, cutoff).withColumn("w", decay_weight(age_days(cutoff), half_life))
    sums = rows.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.col("w") * F.col("home_goals")), F.lit(0.0)).alias("h"), F.coalesce(F.sum(F.col("w") * F.col("away_goals")), F.lit(0.0)).alias("a"))
    home = (F.col("h") + prior_matches * prior_away * F.exp(F.lit(prior_advantage))) / (F.col("w") + prior_matches)
    away = (F.col("a") + prior_matches * prior_away) / (F.col("w") + prior_matches)
    return sums.select(home.alias("home_rate"), away.alias("away_rate")).withColumns({"intercept": F.log("away_rate"), "advantage": F.log(F.col("home_rate") / F.col("away_rate"))})


def pair_statistics(matches: DataFrame, cutoff: str, half_life: float = 365.0) -> DataFrame:
    """(home, away, w, wh, wa): all that a decayed Poisson goal model needs of the matches of an ordered pair."""
    rows = before(matches, cutoff).withColumn("w", decay_weight(age_days(cutoff), half_life))
    return rows.groupBy("home", "away").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("home_goals")).alias("wh"), F.sum(F.col("w") * F.col("away_goals")).alias("wa"))


def goal_targets(matches: DataFrame, blend: float = 0.3) -> DataFrame:
    """Adds ``home_target`` and ``away_target``: goals blended with shots where both sides' shots make sense."""
    fine = F.lit(True)
    for side in ("home", "away"):
        shots, on = F.col(f"{side}_shots"), F.col(f"{side}_shots_on_target")
        fine = fine & shots.isNotNull() & on.isNotNull() & ~F.isnan(shots) & ~F.isnan(on) & (F.abs(shots) < float("inf")) & (on >= 0) & (shots >= on)

    def target(side: str) -> Column:
        shots, on, goals = F.col(f"{side}_shots"), F.col(f"{side}_shots_on_target"), F.col(f"{side}_goals").cast("double")
        return F.when(F.coalesce(fine, F.lit(False)), (1 - blend) * goals + blend * (0.31 * on + 0.03 * (shots - on))).otherwise(goals)

    return matches.withColumns({"home_target": target("home"), "away_target": target("away")})


def connected_to(pairs: DataFrame, seed: Column) -> DataFrame:
    """(team) reachable from ``seed`` over ``pairs(home, away)``: a frontier that grows by one join a round, until it is
    empty."""
    from matchlake.util import materialize

    edges = pairs.select(F.col("home").alias("a"), F.col("away").alias("b")).union(pairs.select(F.col("away").alias("a"), F.col("home").alias("b"))).where("a is not null and b is not null").distinct()
    edges = materialize(edges, "edges")
    front = found = materialize(edges.where(F.col("a") == seed).select(F.col("a").alias("team")).distinct(), "front")
    while True:
        # A team reached in an earlier round is in one of the fronts, which are read as they were written.
        front = materialize(edges.join(front.withColumnRenamed("team", "a"), "a", "left_semi").select(F.col("b").alias("team")).distinct().join(found, "team", "left_anti"), "front")
        if front.isEmpty():
            return found
        found = found.union(front)


def form_before(matches: DataFrame) -> DataFrame:
    """Per side and match: matches, points and goals of strictly earlier instants (point-in-time features).

    Sums are made inside a team's month and carried over its months, so a team with very many matches is spread.
    """
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    sides = by_side(matches).withColumns({"micros": F.unix_micros(F.col("date").cast("timestamp")), "month": F.trunc(F.col("date").cast("date"), "month"), "points": points, "one": F.lit(1)})
    sums = {"played_before": "one", "points_before": "points", "goals_before": "gf"}
    months = sides.groupBy("team", "month").agg(*[F.sum(c).alias(f"m_{k}") for k, c in sums.items()])
    over = Window.partitionBy("team").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("team", "month", *[F.coalesce(F.sum(f"m_{k}").over(over), F.lit(0)).alias(f"b_{k}") for k in sums])
    inside = Window.partitionBy("team", "month").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    rows = sides.withColumns({f"i_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(months, ["team", "month"])
    return rows.select("row_id", "team", "date", *[(F.col(f"b_{k}") + F.col(f"i_{k}")).cast("bigint").alias(k) for k in sums])
