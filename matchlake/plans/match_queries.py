"""Queries over match records and schedules, each with its SQL twin where SQL can say the same.

Averages and sums of real numbers are rounded to six digits on both sides.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions import dist, grids
from matchlake.operators import evaluate as E
from matchlake.operators import bracket_state, fit, ratings, selection, simulate, standings, validate
from matchlake.operators import matches as M
from matchlake.operators.timestamps import read_timestamps
from matchlake.plans import forecast
from matchlake.sources import parsers
from matchlake.util import lookup_join, materialize, ntz_from_unix, table

CUT = "2025-07-01 00:00:00"
#: Seasons drawn where no twin sets the number, as the reference's published runs.
SIMULATIONS = 20_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return M.valid_matches(table(spark, d, "history"))


def _unique(spark: SparkSession, d: str) -> DataFrame:
    return M.one_per_key(_valid(spark, d))


_STRICT = "regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z')"
V = f"""
WITH v AS (
  SELECT * REPLACE (try_strptime(CASE WHEN {_STRICT} THEN date END, '%Y-%m-%dT%H:%M:%SZ') AS date) FROM history
  WHERE try_strptime(CASE WHEN {_STRICT} THEN date END, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL
    AND trim(home) <> '' AND trim(away) <> '' AND home <> away AND trim(competition) <> '' AND home_goals >= 0 AND away_goals >= 0),
u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY date, home, away, competition ORDER BY row_id DESC) = 1)"""
FX = f"""
f AS (SELECT *, try_strptime(CASE WHEN {_STRICT} THEN date END, '%Y-%m-%dT%H:%M:%SZ') AS kick FROM fixtures)"""
SIDES = """
s AS (SELECT row_id, date, competition, home AS team, away AS opponent, home_goals AS gf, away_goals AS ga, 0 AS is_away FROM u
  UNION ALL SELECT row_id, date, competition, away, home, away_goals, home_goals, 1 FROM u)"""
AGE = f"(epoch_us(TIMESTAMP '{CUT}') - epoch_us(date)) / 86400000000.0"
EURO = "(competition IN ('UCL', 'UEL', 'UECL') OR contains(lower(competition), 'qualifying'))"


# ---- selection before a cutoff ---------------------------------------------------------------------------------------


@query(V + f"\nSELECT row_id, date, home, away, home_goals, away_goals, competition FROM u WHERE date < TIMESTAMP '{CUT}'")
def asof_cutoff(spark, d):
    return M.before(_unique(spark, d), CUT).select("row_id", "date", "home", "away", "home_goals", "away_goals", "competition")


@query(V + f"\nSELECT row_id, completed_at FROM v WHERE date <= completed_at AND completed_at < TIMESTAMP '{CUT}'")
def completed_before(spark, d):
    return M.completed_before(_valid(spark, d), CUT).select("row_id", "completed_at")


@query(
    "WITH"
    + FX
    + """, g AS (SELECT *, coalesce(kick + INTERVAL 3 HOUR < TIMESTAMP '2025-01-15 00:00:00' AND matchday <= 6 AND lower(trim(status)) = 'finished', false) AS seen FROM f)
SELECT row_id, CASE WHEN seen THEN home_goals END AS home_goals, CASE WHEN seen THEN away_goals END AS away_goals, CASE WHEN seen THEN 'finished' ELSE 'scheduled' END AS status FROM g"""
)
def asof_mask_scores(spark, d):
    return M.masked_scores(table(spark, d, "fixtures"), "2025-01-15 00:00:00", 6).select("row_id", "home_goals", "away_goals", "status")


_PLAYED = """, p AS (SELECT row_id, kick AS date, home, away, home_goals, away_goals, 'UCL' AS competition, source, kick + INTERVAL 3 HOUR AS completed_at FROM f
  WHERE lower(trim(status)) = 'finished' AND home_goals IS NOT NULL AND away_goals IS NOT NULL AND kick IS NOT NULL),
b AS (SELECT row_id, date, home, away, home_goals, away_goals, competition, source, coalesce(completed_at, date + INTERVAL 3 HOUR) AS completed_at, 0 AS origin FROM v
  UNION ALL SELECT *, 1 FROM p)"""


@query(
    V
    + ","
    + FX
    + _PLAYED
    + f"""
SELECT CAST(CAST(date AS DATE) AS VARCHAR) AS day, home, away, origin, row_id, date, home_goals, away_goals, competition, source, completed_at FROM b
WHERE completed_at < TIMESTAMP '{CUT}'
QUALIFY row_number() OVER (PARTITION BY CAST(date AS DATE), home, away ORDER BY origin DESC, row_id DESC) = 1"""
)
def training_merge_dedup(spark, d):
    return M.training_set(_valid(spark, d), M.played_fixtures(table(spark, d, "fixtures")), CUT).withColumn("day", F.col("day").cast("string"))


@query(
    V
    + ","
    + FX
    + _PLAYED
    + """
SELECT CAST(CAST(date AS DATE) AS VARCHAR) AS day, home, away, count(*) AS n_rows, count(DISTINCT (home_goals, away_goals)) AS n_scores FROM b GROUP BY ALL HAVING count(DISTINCT (home_goals, away_goals)) > 1"""
)
def source_conflicts(spark, d):
    return M.score_conflicts(M.training_union(_valid(spark, d), M.played_fixtures(table(spark, d, "fixtures")))).withColumn("day", F.col("day").cast("string"))


@query(
    V
    + """, t AS (SELECT count(*) AS total FROM u),
k AS (SELECT date, count(*) AS n FROM u GROUP BY date), c AS (SELECT date, sum(n) OVER (ORDER BY date) AS upto FROM k),
cut AS (SELECT min(date) AS split_date FROM c, t WHERE upto > least(total - 10, greatest(100, floor(total * 0.8))))
SELECT split_date, (SELECT count(*) FROM u WHERE date < split_date) AS train_rows, (SELECT count(*) FROM u WHERE date >= split_date) AS holdout_rows FROM cut"""
)
def temporal_split(spark, d):
    return E.temporal_split(_unique(spark, d))


@query(
    V
    + """, dd AS (SELECT DISTINCT date FROM u WHERE competition = 'UCL'), n AS (SELECT count(*) AS n FROM dd), r AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM dd),
b AS (SELECT fold, date AS start FROM (SELECT unnest([0, 1, 2]) AS fold), n, r WHERE pos = floor(n.n * (fold + 1) / 4.0))
SELECT CAST(fold AS INTEGER) AS fold, start, lead(start) OVER (ORDER BY fold) AS "end" FROM b"""
)
def rolling_fold_bounds(spark, d):
    return E.fold_bounds(_unique(spark, d).where("competition = 'UCL'"))


@query("WITH" + FX + "\nSELECT edition_id, matchday, min(kick) AS first_at, min(kick) < TIMESTAMP '2025-11-01 00:00:00' AS too_early FROM f WHERE kick IS NOT NULL GROUP BY ALL")
def cutoff_matchday_check(spark, d):
    at = M.stored_instant(F.col("date"))
    return table(spark, d, "fixtures").withColumn("at", at).where("at is not null").groupBy("edition_id", "matchday").agg(F.min("at").alias("first_at"), (F.min("at") < F.lit("2025-11-01 00:00:00").cast("timestamp_ntz")).alias("too_early"))


@query("SELECT row_id, home, away FROM history WHERE contains(lower(home), 'united') OR contains(lower(away), 'united')")
def text_search(spark, d):
    has = lambda c: F.lower(c).contains("united")
    return table(spark, d, "history").where(has("home") | has("away")).select("row_id", "home", "away")


# ---- validation ------------------------------------------------------------------------------------------------------

_NUMS = " OR ".join(f"({c} IS NOT NULL AND (isnan({c}) OR {c} < 0 OR {c} = 'infinity'::DOUBLE))" for c in validate.OPTIONAL_NUMBERS)
_RULES = {
    "blank_home": "home IS NULL OR trim(home) = ''",
    "blank_away": "away IS NULL OR trim(away) = ''",
    "blank_competition": "competition IS NULL OR trim(competition) = ''",
    "blank_source": "source IS NULL OR trim(source) = ''",
    "bad_date": f"try_strptime(CASE WHEN {_STRICT} THEN date END, '%Y-%m-%dT%H:%M:%SZ') IS NULL",
    "same_sides": "home IS NOT DISTINCT FROM away",
    "bad_score": "home_goals IS NULL OR away_goals IS NULL OR home_goals < 0 OR away_goals < 0",
    "bad_number": _NUMS,
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS violations FROM history WHERE {c}" for n, c in _RULES.items()) + " UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM history GROUP BY date, home, away, competition HAVING count(*) > 1)")
def validate_history_report(spark, d):
    return validate.history_report(table(spark, d, "history"))


_SCHEDULE = {
    "bad_status": "NOT coalesce(lower(trim(status)) IN ('scheduled', 'finished', 'postponed'), false)",
    "bad_matchday": "NOT coalesce(matchday BETWEEN 1 AND 8, false)",
    "bad_date": f"try_strptime(CASE WHEN {_STRICT} THEN date END, '%Y-%m-%dT%H:%M:%SZ') IS NULL",
    "bad_stage": "NOT coalesce(replace(replace(lower(trim(stage)), '-', '_'), ' ', '_') IN ('league', 'league_phase'), false)",
    "same_sides": "home IS NOT DISTINCT FROM away",
    "outer_blanks": "coalesce(home <> trim(home) OR away <> trim(away), true)",
    "finished_without_score": "coalesce(lower(trim(status)) = 'finished', true) AND NOT (home_goals IS NOT NULL AND away_goals IS NOT NULL)",
    "scheduled_with_score": "coalesce(lower(trim(status)) = 'scheduled', true) AND NOT (home_goals IS NULL AND away_goals IS NULL)",
    "half_score": "(home_goals IS NULL) <> (away_goals IS NULL)",
}


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT edition_id, snapshot_no, '{n}' AS rule, count(*) AS violations FROM fixtures WHERE {c} GROUP BY ALL" for n, c in _SCHEDULE.items())
    + """
UNION ALL SELECT edition_id, snapshot_no, 'repeated_id', count(*) - count(DISTINCT match_id) FROM fixtures GROUP BY ALL
UNION ALL SELECT edition_id, snapshot_no, 'row_count_off', abs(count(*) - 144) FROM fixtures GROUP BY ALL
UNION ALL SELECT edition_id, snapshot_no, 'repeated_pair', count(*) FROM (SELECT edition_id, snapshot_no FROM fixtures GROUP BY edition_id, snapshot_no, least(home, away), greatest(home, away) HAVING count(*) > 1) GROUP BY ALL
UNION ALL SELECT edition_id, snapshot_no, 'unbalanced_team', count(*) FROM (
  SELECT edition_id, snapshot_no, team FROM (SELECT edition_id, snapshot_no, home AS team, 1 AS h FROM fixtures UNION ALL SELECT edition_id, snapshot_no, away, 0 FROM fixtures)
  GROUP BY ALL HAVING sum(h) <> 4 OR count(*) <> 8) GROUP BY ALL) WHERE violations > 0"""
)
def validate_schedule_report(spark, d):
    return validate.schedule_report(table(spark, d, "fixtures"))


# ---- aggregates ------------------------------------------------------------------------------------------------------


@query(
    V
    + ","
    + SIDES
    + f"""
SELECT team, count(*) AS matches, round(sum(pow(2.0, -{AGE} / 365.0)), 6) AS weight, max(date) AS latest FROM s WHERE date < TIMESTAMP '{CUT}' GROUP BY team"""
)
def team_coverage_decayed(spark, d):
    return M.coverage(_unique(spark, d), CUT).withColumn("weight", F.round("weight", 6))


@query(V + "," + SIDES + "\nSELECT t.name AS team, count(s.team) AS matches, max(s.date) AS latest FROM teams t LEFT JOIN s ON s.team = t.name GROUP BY t.name")
def team_match_counts(spark, d):
    own = M.by_side(_unique(spark, d)).groupBy("team").agg(F.count("*").alias("matches"), F.max("date").alias("latest"))
    return table(spark, d, "teams").select(F.col("name").alias("team")).join(own, "team", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


@query(V + "," + SIDES + f"\nSELECT team, count(*) AS matches, count(*) < 20 AS few, max(date) < TIMESTAMP '{CUT}' - INTERVAL 45 DAY AS stale FROM s WHERE date < TIMESTAMP '{CUT}' GROUP BY team")
def freshness_flags(spark, d):
    rows = M.coverage(_unique(spark, d), CUT)
    return rows.select("team", "matches", (F.col("matches") < 20).alias("few"), (F.col("latest") < F.lit(CUT).cast("timestamp_ntz") - F.expr("INTERVAL '45' DAY")).alias("stale"))


@query(V + "," + SIDES + f"\nSELECT name FROM teams WHERE name NOT IN (SELECT team FROM s WHERE competition = 'UCL' AND date < TIMESTAMP '2022-01-01')")
def missing_teams(spark, d):
    """Teams without a match of the competition before a cutoff."""
    seen = M.by_side(M.before(_unique(spark, d), "2022-01-01").where("competition = 'UCL'")).select(F.col("team").alias("name"))
    return table(spark, d, "teams").select("name").join(seen, "name", "left_anti")


@query(V + "\nSELECT row_id FROM v WHERE home IN (SELECT name FROM teams) AND away IN (SELECT name FROM teams)")
def known_sides(spark, d):
    names = table(spark, d, "teams").select("name")
    return _valid(spark, d).join(names.toDF("home"), "home", "left_semi").join(names.toDF("away"), "away", "left_semi").select("row_id")


@query(V + "\nSELECT least(home, away) AS side_a, greatest(home, away) AS side_b, count(*) AS meetings, count(DISTINCT home) AS orders FROM u GROUP BY ALL")
def unordered_pairs(spark, d):
    return _unique(spark, d).groupBy(F.least("home", "away").alias("side_a"), F.greatest("home", "away").alias("side_b")).agg(F.count("*").alias("meetings"), F.count_distinct("home").alias("orders"))


@query(V + "\nSELECT team FROM (SELECT home AS team FROM u EXCEPT SELECT away FROM u)\nUNION ALL SELECT '=' || team FROM (SELECT home AS team FROM u INTERSECT SELECT away FROM u)")
def side_set_algebra(spark, d):
    u = _unique(spark, d)
    h, a = u.select(F.col("home").alias("team")), u.select(F.col("away").alias("team"))
    return h.subtract(a).unionByName(h.intersect(a).select(F.concat(F.lit("="), "team").alias("team")))


@query(
    V
    + """, e AS MATERIALIZED (SELECT DISTINCT home AS a, away AS b FROM u UNION SELECT away, home FROM u)
SELECT team FROM (WITH RECURSIVE r(team) AS (SELECT min(a) FROM e UNION SELECT e.b FROM r JOIN e ON e.a = r.team) SELECT team FROM r)"""
)
def connected_teams(spark, d):
    pairs = materialize(_unique(spark, d).select("home", "away").distinct(), "pairs")
    seed = pairs.agg(F.least(F.min("home"), F.min("away"))).first()[0]
    return M.connected_to(pairs, F.lit(seed))


@query(
    V
    + ","
    + SIDES
    + f""", c AS (SELECT team, competition, count(*) AS n FROM s WHERE NOT {EURO} GROUP BY ALL),
b AS (SELECT team, competition FROM c QUALIFY row_number() OVER (PARTITION BY team ORDER BY n DESC, competition) = 1)
SELECT t.team, coalesce(b.competition, 'OTHER') AS league FROM (SELECT DISTINCT team FROM s) t LEFT JOIN b ON b.team = t.team"""
)
def modal_league(spark, d):
    return M.modal_league(_unique(spark, d))


@query("SELECT competition, count(*) AS n, min(retrieved_at) AS first_seen, max(retrieved_at) AS last_seen FROM history GROUP BY competition")
def competition_counts(spark, d):
    return table(spark, d, "history").groupBy("competition").agg(F.count("*").alias("n"), F.min("retrieved_at").alias("first_seen"), F.max("retrieved_at").alias("last_seen"))


_BASE_SQL = f"""
w AS (SELECT *, pow(2.0, -{AGE} / 365.0) AS w FROM u WHERE date < TIMESTAMP '{CUT}'),
br AS (SELECT (coalesce(sum(w * home_goals), 0) + 10 * 1.35 * exp(0.15)) / (coalesce(sum(w), 0) + 10) AS home_rate, (coalesce(sum(w * away_goals), 0) + 10 * 1.35) / (coalesce(sum(w), 0) + 10) AS away_rate FROM w)"""


@query(V + "," + _BASE_SQL + "\nSELECT round(home_rate, 6) AS home_rate, round(away_rate, 6) AS away_rate, round(ln(away_rate), 6) AS intercept, round(ln(home_rate / away_rate), 6) AS advantage FROM br")
def baseline_rates(spark, d):
    return M.baseline_rates(_unique(spark, d), CUT).select(*[F.round(c, 6).alias(c) for c in ("home_rate", "away_rate", "intercept", "advantage")])


@query(V + "," + _BASE_SQL + "\nSELECT home, away, round(sum(w), 6) AS w, round(sum(w * home_goals), 6) AS wh, round(sum(w * away_goals), 6) AS wa FROM w GROUP BY home, away")
def pair_sufficient_stats(spark, d):
    return M.pair_statistics(_unique(spark, d), CUT).select("home", "away", *[F.round(c, 6).alias(c) for c in ("w", "wh", "wa")])


_FINE = " AND ".join(f"{s}_shots IS NOT NULL AND {s}_shots_on_target IS NOT NULL AND isfinite({s}_shots) AND isfinite({s}_shots_on_target) AND {s}_shots_on_target >= 0 AND {s}_shots >= {s}_shots_on_target" for s in ("home", "away"))
_TARGET = ", ".join(f"round(CASE WHEN fine THEN 0.7 * {s}_goals + 0.3 * (0.31 * {s}_shots_on_target + 0.03 * ({s}_shots - {s}_shots_on_target)) ELSE {s}_goals END, 6) AS {s}_target" for s in ("home", "away"))


@query(V + f", g AS (SELECT *, coalesce({_FINE}, false) AS fine FROM v)\nSELECT row_id, {_TARGET} FROM g")
def goal_targets_blend(spark, d):
    return M.goal_targets(_valid(spark, d)).select("row_id", F.round("home_target", 6).alias("home_target"), F.round("away_target", 6).alias("away_target"))


@query(
    V
    + ","
    + SIDES
    + """
SELECT row_id, team, date, count(*) OVER w AS played_before,
  CAST(coalesce(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS points_before, CAST(coalesce(sum(gf) OVER w, 0) AS BIGINT) AS goals_before
FROM s WINDOW w AS (PARTITION BY team ORDER BY epoch_us(date) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def asof_form_features(spark, d):
    return M.form_before(_unique(spark, d))


# ---- league tables ---------------------------------------------------------------------------------------------------

_NINE = """
base AS (SELECT competition, team, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(gf - ga) AS BIGINT) AS gd, CAST(sum(gf) AS BIGINT) AS gf,
  CAST(sum(CASE WHEN is_away = 1 THEN gf ELSE 0 END) AS BIGINT) AS away_gf, CAST(sum(CASE WHEN gf > ga THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN gf > ga AND is_away = 1 THEN 1 ELSE 0 END) AS BIGINT) AS away_wins
  FROM s GROUP BY competition, team),
opp AS (SELECT s.competition, s.team, CAST(sum(b.points) AS BIGINT) AS opp_points, CAST(sum(b.gd) AS BIGINT) AS opp_gd, CAST(sum(b.gf) AS BIGINT) AS opp_gf FROM s JOIN base b ON b.competition = s.competition AND b.team = s.opponent GROUP BY s.competition, s.team),
tab AS (SELECT b.*, o.opp_points, o.opp_gd, o.opp_gf FROM base b JOIN opp o ON o.competition = b.competition AND o.team = b.team),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY competition ORDER BY points DESC, gd DESC, gf DESC, away_gf DESC, wins DESC, away_wins DESC, opp_points DESC, opp_gd DESC, opp_gf DESC, team) AS BIGINT) AS pos FROM tab)"""


def _table(spark, d):
    return standings.ranked(standings.metrics(_unique(spark, d), ["competition"]), ["competition"], F.col("team"))


@query(V + "," + SIDES + "," + _NINE + "\nSELECT * FROM rk")
def standings_nine_keys(spark, d):
    return _table(spark, d)


@query(V + "," + SIDES + "," + _NINE + "\nSELECT competition, team, pos, CASE WHEN pos <= 8 THEN 'top8' WHEN pos <= 16 THEN 'seeded' WHEN pos <= 24 THEN 'unseeded' ELSE 'eliminated' END AS band FROM rk")
def rank_bands(spark, d):
    return _table(spark, d).select("competition", "team", "pos", standings.band(F.col("pos")).alias("band"))


@query(
    V
    + ","
    + SIDES
    + ","
    + _NINE
    + """
SELECT competition, count(*) AS tie_groups, CAST(sum(n) AS BIGINT) AS tied_teams FROM (
  SELECT competition, count(*) AS n FROM rk GROUP BY competition, points, gd, gf, away_gf, wins, away_wins, opp_points, opp_gd, opp_gf HAVING count(*) > 1) GROUP BY competition"""
)
def tie_group_counts(spark, d):
    return standings.tie_groups(standings.metrics(_unique(spark, d), ["competition"]), ["competition"])


@query(V + "," + SIDES + "," + _NINE + "\nSELECT competition, team, pos, CAST(ntile(3) OVER (PARTITION BY competition ORDER BY pos) AS INTEGER) AS display_group FROM rk")
def display_groups(spark, d):
    return _table(spark, d).select("competition", "team", "pos", F.ntile(3).over(Window.partitionBy("competition").orderBy("pos")).alias("display_group"))


@query(V + "," + SIDES + "," + _NINE + "\nSELECT competition, team, pos, round(points * 100.0 / (3 * greatest(wins, 1)), 6) AS points_pct FROM rk WHERE pos <= 2")
def topk_display(spark, d):
    return _table(spark, d).where("pos <= 2").select("competition", "team", "pos", F.round(F.col("points") * 100.0 / (3 * F.greatest("wins", F.lit(1))), 6).alias("points_pct"))


# ---- schedules -------------------------------------------------------------------------------------------------------


@query(
    """
WITH one AS (SELECT * FROM fixtures QUALIFY row_number() OVER (PARTITION BY edition_id, snapshot_no, match_id ORDER BY row_id DESC) = 1),
st AS (SELECT edition_id, snapshot_no, max(taken_at) AS taken_at, md5(string_agg(match_id || ':' || coalesce(CAST(home_goals AS VARCHAR), '') || ':' || coalesce(CAST(away_goals AS VARCHAR), ''), ',' ORDER BY match_id)) AS state FROM one GROUP BY ALL)
SELECT edition_id, state, snapshot_no, taken_at FROM st QUALIFY row_number() OVER (PARTITION BY edition_id, state ORDER BY taken_at DESC, snapshot_no DESC) = 1"""
)
def history_latest_per_state(spark, d):
    one = table(spark, d, "fixtures").groupBy("edition_id", "snapshot_no", "match_id").agg(F.max(F.struct("row_id", "home_goals", "away_goals", "taken_at")).alias("m"))
    text = F.concat(F.col("match_id"), F.lit(":"), F.coalesce(F.col("m.home_goals").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("m.away_goals").cast("string"), F.lit("")))
    st = one.groupBy("edition_id", "snapshot_no").agg(F.max("m.taken_at").alias("taken_at"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("match_id", text.alias("t")))), lambda x: x["t"]), ",")).alias("state"))
    best = st.groupBy("edition_id", "state").agg(F.max(F.struct("taken_at", "snapshot_no")).alias("m"))
    return best.select("edition_id", "state", "m.snapshot_no", "m.taken_at")


@query("SELECT edition_id, max_by(snapshot_no, taken_at) AS snapshot_no, max(taken_at) AS taken_at, count(DISTINCT snapshot_no) AS runs FROM fixtures GROUP BY edition_id")
def latest_run(spark, d):
    return table(spark, d, "fixtures").groupBy("edition_id").agg(F.max_by("snapshot_no", "taken_at").alias("snapshot_no"), F.max("taken_at").alias("taken_at"), F.count_distinct("snapshot_no").alias("runs"))


@query("SELECT edition_id, snapshot_no, coalesce(min(CASE WHEN home_goals IS NULL THEN matchday END), 8) AS next_matchday, count(DISTINCT matchday) AS matchdays FROM fixtures GROUP BY ALL")
def next_open_matchday(spark, d):
    return table(spark, d, "fixtures").groupBy("edition_id", "snapshot_no").agg(F.coalesce(F.min(F.when(F.col("home_goals").isNull(), F.col("matchday"))), F.lit(8)).alias("next_matchday"), F.count_distinct("matchday").alias("matchdays"))


@query("SELECT row_id, 'ucl-2026-27-' || substr(sha256(home || '|' || away), 1, 16) AS made_id, CAST(('0x' || substr(sha256(home), 1, 4)) AS INTEGER) % 360 AS hue FROM fixtures")
def match_id_hash(spark, d):
    hue = (F.conv(F.substring(F.sha2("home", 256), 1, 4), 16, 10).cast("int") % 360).alias("hue")
    return table(spark, d, "fixtures").select("row_id", parsers.match_id(F.col("home"), F.col("away"), "ucl-2026-27-").alias("made_id"), hue)


@query(
    r"""
WITH d AS (SELECT row_id, CASE WHEN regexp_matches(home, '\\u[0-9a-fA-F]{4}') THEN ('"' || replace(home, '"', '\"') || '"')::JSON ->> '$' ELSE home END AS home FROM history),
h AS (SELECT row_id, trim(regexp_replace(replace(home, chr(160), ' '), '\s+', ' ', 'g')) AS t FROM d)
SELECT h.row_id, coalesce(t.name, nfc_normalize(h.t)) AS home FROM h LEFT JOIN (SELECT nickname, min(name) AS name FROM teams WHERE nickname IS NOT NULL GROUP BY nickname) t ON t.nickname = nfc_normalize(h.t)"""
)
def alias_normalize(spark, d):
    return _aliased(spark, d, table(spark, d, "history"))


def _aliased(spark, d, rows):
    return parsers.normalised_team(rows.select("row_id", "home"), "home", _aliases(spark, d)).select("row_id", "home")


def _aliases(spark, d):
    return table(spark, d, "teams").where("nickname is not null").groupBy(F.col("nickname").alias("alias")).agg(F.min("name").alias("name"))


# ---- distributions and models ----------------------------------------------------------------------------------------
# A model is a relation of strengths; here each team's from its decayed goals for and against, drawn to the mean.

_STRENGTH = f"""
sd AS (SELECT team, pow(2.0, -{AGE} / 365.0) AS w, gf, ga FROM s WHERE date < TIMESTAMP '{CUT}'),
mu AS (SELECT sum(w * gf) / sum(w) AS m FROM sd),
str AS (SELECT team, round(ln((sum(w * gf) + 5 * any_value(m)) / ((sum(w) + 5) * any_value(m))), 9) AS attack, round(-ln((sum(w * ga) + 5 * any_value(m)) / ((sum(w) + 5) * any_value(m))), 9) AS defence FROM sd, mu GROUP BY team),
br2 AS (SELECT round(ln(away_rate), 9) AS intercept, round(ln(home_rate / away_rate), 9) AS advantage FROM br),
pr AS (SELECT DISTINCT home, away FROM u WHERE competition = 'UCL'),
rt AS (SELECT pr.home, pr.away, round(exp(greatest(least(intercept + advantage + coalesce(h.attack, 0) - coalesce(a.defence, 0), ln(100)), ln(1e-6))), 9) AS lh, round(exp(greatest(least(intercept + coalesce(a.attack, 0) - coalesce(h.defence, 0), ln(100)), ln(1e-6))), 9) AS la
  FROM pr CROSS JOIN br2 LEFT JOIN str h ON h.team = pr.home LEFT JOIN str a ON a.team = pr.away)"""
_RATES = V + "," + SIDES + "," + _BASE_SQL + "," + _STRENGTH
_PMF = """
k AS (SELECT unnest(range(0, 12)) AS k),
pm AS (SELECT lam, k, exp(-lam) * pow(lam, k) / factorial(CAST(k AS INTEGER)) AS p FROM (SELECT DISTINCT lh AS lam FROM rt UNION SELECT DISTINCT la FROM rt), k),
pt AS (SELECT * FROM pm UNION ALL SELECT lam, 12, greatest(1 - sum(p), 0) FROM pm GROUP BY lam),
gr AS (SELECT home, away, lh, la, CAST(a.k AS INTEGER) AS hg, CAST(b.k AS INTEGER) AS ag, a.p * b.p AS p FROM rt JOIN pt a ON a.lam = lh JOIN pt b ON b.lam = la)"""


def _strengths(unique):
    sides = M.by_side(M.before(unique, CUT)).withColumn("w", M.decay_weight(M.age_days(CUT), 365.0)).select("team", "w", "gf", "ga")
    per = materialize(sides.groupBy("team").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("gf")).alias("f"), F.sum(F.col("w") * F.col("ga")).alias("a")), "sides")
    mean = per.agg(F.sum("f") / F.sum("w")).first()[0] or 1.0
    drawn = lambda c: F.log((F.col(c) + 5 * mean) / ((F.col("w") + 5) * mean))
    return per.select("team", F.round(drawn("f"), 9).alias("attack"), F.round(-drawn("a"), 9).alias("defence"))


def _rates(spark, d, pairs=None):
    unique = materialize(M.one_per_key(_valid(spark, d).select("row_id", *M.KEY, "home_goals", "away_goals")), "unique")
    base = M.baseline_rates(unique, CUT).first()
    s = _strengths(unique)
    pairs = pairs if pairs is not None else unique.where("competition = 'UCL'").select("home", "away").distinct()
    rows = pairs.join(s.toDF("home", "ha", "hd"), "home", "left").join(s.toDF("away", "aa", "ad"), "away", "left")
    mu, adv, c, z = F.lit(round(base["intercept"], 9)), F.lit(round(base["advantage"], 9)), F.coalesce, F.lit(0.0)
    rates = [dist.link_rate(mu, adv, c("ha", z), c("ad", z)), dist.link_rate(mu, z, c("aa", z), c("hd", z))]
    return rows.select(*pairs.columns, F.round(rates[0], 9).alias("lh"), F.round(rates[1], 9).alias("la"))


@query(_RATES + "\nSELECT home, away, round(lh, 6) AS lh, round(la, 6) AS la FROM rt")
def pair_rates(spark, d, pairs=None):
    return _rates(spark, d, pairs).select("home", "away", F.round("lh", 6).alias("lh"), F.round("la", 6).alias("la"))


@query(_RATES + "," + _PMF + "\nSELECT home, away, hg, ag, round(p, 9) AS p FROM gr")
def score_grid(spark, d, pairs=None):
    return dist.grid(_rates(spark, d, pairs), "lh", "la").select("home", "away", "hg", "ag", F.round("p", 9).alias("p"))


_OUT = "round(sum(CASE WHEN hg > ag THEN p ELSE 0 END), 6) AS p_home, round(sum(CASE WHEN hg = ag THEN p ELSE 0 END), 6) AS p_draw, round(sum(CASE WHEN hg < ag THEN p ELSE 0 END), 6) AS p_away"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(_RATES + "," + _PMF + f"\nSELECT home, away, {_OUT} FROM gr GROUP BY home, away")
def grid_outcomes(spark, d, pairs=None):
    return _rounded(dist.grid_outcomes(dist.grid(_rates(spark, d, pairs), "lh", "la"), ["home", "away"]), "p_home", "p_draw", "p_away")


@query(
    _RATES
    + """,
kk AS (SELECT unnest(range(0, 261)) AS k),
lp AS (SELECT lam, k, exp(-lam + k * ln(lam) - lgamma(k + 1)) AS p FROM (SELECT DISTINCT lh AS lam FROM rt UNION SELECT DISTINCT la FROM rt), kk),
cm AS (SELECT lam, k, p, coalesce(sum(p) OVER (PARTITION BY lam ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM lp)
SELECT home, away, round(sum(a.p * b.below), 6) AS p_home, round(sum(a.p * b.p), 6) AS p_draw, round(1 - sum(a.p * b.below) - sum(a.p * b.p), 6) AS p_away
FROM rt JOIN cm a ON a.lam = lh JOIN cm b ON b.lam = la AND b.k = a.k GROUP BY home, away"""
)
def skellam_outcomes(spark, d, pairs=None):
    rows = _rates(spark, d, pairs).withColumn("s", dist.skellam(F.col("lh"), F.col("la")))
    return _rounded(rows.select("home", "away", "s.*"), "p_home", "p_draw", "p_away")


_DC = """,
dc0 AS (SELECT *, p * CASE WHEN hg = 0 AND ag = 0 THEN 1 - lh * la * 0.05 WHEN hg = 0 AND ag = 1 THEN 1 + lh * 0.05 WHEN hg = 1 AND ag = 0 THEN 1 + la * 0.05 WHEN hg = 1 AND ag = 1 THEN 1 - 0.05 ELSE 1 END AS q FROM gr),
dc AS (SELECT home, away, hg, ag, q / sum(q) OVER (PARTITION BY home, away) AS p FROM dc0)"""


@query(_RATES + "," + _PMF + _DC + f"\nSELECT home, away, {_OUT} FROM dc GROUP BY home, away")
def dixon_coles_grid(spark, d, pairs=None):
    return _rounded(dist.grid_outcomes(dist.corrected_grid(_rates(spark, d, pairs), ["home", "away"], "lh", "la", 0.05), ["home", "away"]), "p_home", "p_draw", "p_away")


@query(_RATES + "," + _PMF + _DC + ",\nmx AS (SELECT home, away, hg, ag, sum(p) AS p FROM (SELECT home, away, hg, ag, 0.35 * p AS p FROM gr UNION ALL SELECT home, away, hg, ag, 0.65 * p FROM dc) GROUP BY ALL)\nSELECT home, away, hg, ag, round(p, 9) AS p FROM mx")
def ensemble_mixture(spark, d, pairs=None):
    cells = dist.blended_grid(_rates(spark, d, pairs), "lh", "la", 0.05, 0.35)
    return cells.select("home", "away", "hg", "ag", F.round("p", 9).alias("p"))


@query(
    _RATES
    + ","
    + _PMF
    + """,
o AS (SELECT home, away, sum(CASE WHEN hg > ag THEN p ELSE 0 END) AS ph, sum(CASE WHEN hg = ag THEN p ELSE 0 END) AS pd, sum(CASE WHEN hg < ag THEN p ELSE 0 END) AS pa FROM gr GROUP BY home, away),
x AS (SELECT *, exp(ln(greatest(ph, 1e-15)) / exp(0.1) + 0.05) AS xh, exp(ln(greatest(pd, 1e-15)) / exp(0.1) - 0.02) AS xd, exp(ln(greatest(pa, 1e-15)) / exp(0.1) - 0.03) AS xa FROM o)
SELECT gr.home, gr.away, hg, ag, round(p * CASE WHEN hg > ag THEN xh / (xh + xd + xa) / greatest(ph, 1e-15) WHEN hg = ag THEN xd / (xh + xd + xa) / greatest(pd, 1e-15) ELSE xa / (xh + xd + xa) / greatest(pa, 1e-15) END, 9) AS p
FROM gr JOIN x ON x.home = gr.home AND x.away = gr.away"""
)
def calibrated_grid(spark, d, pairs=None):
    return dist.calibrated_grid(dist.grid(_rates(spark, d, pairs), "lh", "la"), ["home", "away"], 0.1, (0.05, -0.02)).select("home", "away", "hg", "ag", F.round("p", 9).alias("p"))


# Forecasts of the UCL's matches, a fold per year: rates use what was known before the year began.
_FC = (
    V
    + ","
    + SIDES
    + """,
fd AS (SELECT DISTINCT year(date) AS fold, make_timestamp(year(date), 1, 1, 0, 0, 0.0) AS start FROM u WHERE competition = 'UCL'),
fw AS (SELECT fd.fold, u.home_goals, u.away_goals, pow(2.0, -((epoch_us(start) - epoch_us(date)) / 86400000000.0) / 365.0) AS w FROM fd JOIN u ON u.date < fd.start),
fb AS (SELECT fd.fold, (coalesce(sum(w * home_goals), 0) + 10 * 1.35 * exp(0.15)) / (coalesce(sum(w), 0) + 10) AS home_rate, (coalesce(sum(w * away_goals), 0) + 10 * 1.35) / (coalesce(sum(w), 0) + 10) AS away_rate FROM fd LEFT JOIN fw ON fw.fold = fd.fold GROUP BY fd.fold),
fs AS (SELECT fd.fold, team, pow(2.0, -((epoch_us(start) - epoch_us(date)) / 86400000000.0) / 365.0) AS w, gf, ga FROM fd JOIN s ON s.date < fd.start),
fm AS (SELECT fold, sum(w * gf) / sum(w) AS m FROM fs GROUP BY fold),
ft AS (SELECT fs.fold, team, round(ln((sum(w * gf) + 5 * any_value(m)) / ((sum(w) + 5) * any_value(m))), 9) AS attack, round(-ln((sum(w * ga) + 5 * any_value(m)) / ((sum(w) + 5) * any_value(m))), 9) AS defence FROM fs JOIN fm ON fm.fold = fs.fold GROUP BY fs.fold, team),
f2 AS (SELECT fold, round(ln(away_rate), 9) AS intercept, round(ln(home_rate / away_rate), 9) AS advantage FROM fb),
rt AS (SELECT u.row_id, f2.fold, home_goals, away_goals, round(exp(greatest(least(intercept + advantage + coalesce(h.attack, 0) - coalesce(a.defence, 0), ln(100)), ln(1e-6))), 9) AS lh, round(exp(greatest(least(intercept + coalesce(a.attack, 0) - coalesce(h.defence, 0), ln(100)), ln(1e-6))), 9) AS la
  FROM u JOIN f2 ON f2.fold = year(u.date) LEFT JOIN ft h ON h.fold = f2.fold AND h.team = u.home LEFT JOIN ft a ON a.fold = f2.fold AND a.team = u.away WHERE competition = 'UCL'),"""
    + _PMF.replace("SELECT home, away, lh, la, CAST", "SELECT row_id, lh, la, CAST")
    + _DC.replace("SELECT home, away, hg, ag, q / sum(q) OVER (PARTITION BY home, away)", "SELECT row_id, hg, ag, q / sum(q) OVER (PARTITION BY row_id)")
    + f""",
fc AS (SELECT rt.fold, rt.home_goals, rt.away_goals, rt.lh, rt.la, ph, pd, pa, dh, dd, da, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS seen FROM rt
  JOIN (SELECT row_id, {_OUT.replace('p_home', 'ph').replace('p_draw', 'pd').replace('p_away', 'pa')} FROM gr GROUP BY row_id) g ON g.row_id = rt.row_id
  JOIN (SELECT row_id, {_OUT.replace('p_home', 'dh').replace('p_draw', 'dd').replace('p_away', 'da')} FROM dc GROUP BY row_id) c ON c.row_id = rt.row_id)"""
)


def _fold_rates(spark, d):
    """(row_id, fold, home_goals, away_goals, lh, la) of the UCL's matches, each year's rates from the years before."""
    u = materialize(_unique(spark, d), "unique")
    ucl = u.where("competition = 'UCL'").withColumn("fold", F.year("date"))
    folds = materialize(ucl.select("fold").distinct().withColumn("start", F.make_timestamp_ntz("fold", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))), "folds")
    # Every match teaches every later year: as many rows per match as there are years.
    age = (F.unix_micros(F.col("start").cast("timestamp")) - F.unix_micros(F.col("date").cast("timestamp"))) / 86_400_000_000.0
    taught = u.join(F.broadcast(folds), F.col("date") < F.col("start")).withColumn("w", M.decay_weight(age, 365.0))
    sums = taught.groupBy("fold").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("home_goals")).alias("h"), F.sum(F.col("w") * F.col("away_goals")).alias("a"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = folds.join(sums, "fold", "left").select("fold", ((zero("h") + 10 * fit.PRIOR_GOALS * F.exp(F.lit(fit.PRIOR_ADVANTAGE))) / (zero("w") + 10)).alias("hr"), ((zero("a") + 10 * fit.PRIOR_GOALS) / (zero("w") + 10)).alias("ar"))
    base = base.select("fold", F.round(F.log("ar"), 9).alias("mu"), F.round(F.log(F.col("hr") / F.col("ar")), 9).alias("adv"))
    sides = M.by_side(taught).select("fold", "team", "w", "gf", "ga")
    per = sides.groupBy("fold", "team").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("gf")).alias("f"), F.sum(F.col("w") * F.col("ga")).alias("a"))
    mean = per.groupBy("fold").agg((F.sum("f") / F.sum("w")).alias("m"))
    drawn = lambda c: F.log((F.col(c) + 5 * F.col("m")) / ((F.col("w") + 5) * F.col("m")))
    s = materialize(per.join(mean, "fold").select("fold", "team", F.round(drawn("f"), 9).alias("attack"), F.round(-drawn("a"), 9).alias("defence")), "strengths")
    rows = ucl.select("row_id", "fold", "home", "away", "home_goals", "away_goals").join(F.broadcast(base), "fold")  # one row per year
    rows = lookup_join(rows, s.toDF("fold", "home", "ha", "hd"), ["fold", "home"], held=True)
    rows = lookup_join(rows, s.toDF("fold", "away", "aa", "ad"), ["fold", "away"], held=True)
    rates = [dist.link_rate(F.col("mu"), F.col("adv"), zero("ha"), zero("ad")), dist.link_rate(F.col("mu"), F.lit(0.0), zero("aa"), zero("hd"))]
    return rows.select("row_id", "fold", "home_goals", "away_goals", F.round(rates[0], 9).alias("lh"), F.round(rates[1], 9).alias("la"))


def _forecasts(spark, d):
    def make(pdf):
        h, a = pdf["lh"].to_numpy(float), pdf["la"].to_numpy(float)
        own, low = grids.outcomes(grids.grid(h, a)), grids.outcomes(grids.grid(h, a, 0.05))
        return dict(zip(("p_home", "p_draw", "p_away", "dh", "dd", "da"), [*own.T, *low.T], strict=True))

    names = ["p_home", "p_draw", "p_away", "dh", "dd", "da"]
    rows = grids.with_columns(_fold_rates(spark, d), ", ".join(f"{c} double" for c in names), make)
    return materialize(_rounded(rows, *names), "forecasts")


@query(
    _FC
    + """
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, round(avg(-ln(greatest(CASE seen WHEN 0 THEN ph WHEN 1 THEN pd ELSE pa END, 1e-15))), 6) AS log_loss,
  round(avg(pow(ph - (seen = 0)::INT, 2) + pow(pd - (seen = 1)::INT, 2) + pow(pa - (seen = 2)::INT, 2)), 6) AS brier FROM fc GROUP BY fold"""
)
def outcome_metrics(spark, d):
    return _rounded(E.outcome_metrics(_forecasts(spark, d), ["fold"]), "log_loss", "brier")


@query(_FC + "\nSELECT count(*) AS n, round(avg(lh - home_goals * ln(lh) + ln(factorial(least(home_goals, 20))::DOUBLE) + la - away_goals * ln(la) + ln(factorial(least(away_goals, 20))::DOUBLE)), 6) AS goal_log_loss FROM fc")
def goal_log_loss(spark, d):
    rows = _forecasts(spark, d).select(F.col("lh").alias("home_rate"), F.col("la").alias("away_rate"), "home_goals", "away_goals")
    return E.goal_log_loss(rows).select("n", F.round("goal_log_loss", 6).alias("goal_log_loss"))


_BINS = """,
lg AS (SELECT unnest([0, 1, 2]) AS outcome, unnest([ph, pd, pa]) AS p, seen FROM fc),
bn AS (SELECT outcome, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg((seen = outcome)::INT) AS observed FROM lg GROUP BY ALL),
cb AS (SELECT CAST(o.outcome AS INTEGER) AS outcome, CAST(b.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, observed FROM (SELECT unnest([0, 1, 2]) AS outcome) o CROSS JOIN (SELECT unnest(range(0, 10)) AS bin) b LEFT JOIN bn ON bn.outcome = o.outcome AND bn.bin = b.bin)"""


@query(_FC + _BINS + "\nSELECT outcome, bin, n, round(mean_p, 9) AS mean_p, round(observed, 9) AS observed FROM cb")
def calibration_bins(spark, d):
    # Means of six-digit values end in a 5 too often for six digits.
    return E.calibration_bins(_forecasts(spark, d)).withColumns({c: F.round(c, 9) for c in ("mean_p", "observed")})


@query(_FC + _BINS + "\nSELECT round(avg(e), 6) AS ece FROM (SELECT outcome, sum(coalesce(n * abs(mean_p - observed), 0)) / greatest(sum(n), 1) AS e FROM cb GROUP BY outcome)")
def calibration_error(spark, d):
    return E.calibration_error(E.calibration_bins(_forecasts(spark, d))).select(F.round("ece", 6).alias("ece"))


_WS = """,
ab AS (SELECT fold, CASE seen WHEN 0 THEN ph WHEN 1 THEN pd ELSE pa END AS pa_, CASE seen WHEN 0 THEN dh WHEN 1 THEN dd ELSE da END AS pb_ FROM fc),
ws AS (SELECT fold, st, avg(-ln(greatest((1 - st / 20.0) * pa_ + st / 20.0 * pb_, 1e-15))) AS l, count(*) AS n FROM ab, (SELECT unnest(range(0, 21)) AS st) GROUP BY ALL)"""


@query(_FC + _WS + "\nSELECT CAST(fold AS INTEGER) AS fold, st / 20.0 AS weight, n, round(l, 6) AS log_loss FROM ws")
def ensemble_weight_search(spark, d):
    return _weights(spark, d).select("fold", "weight", "n", F.round("log_loss", 6).alias("log_loss"))


def _weights(spark, d):
    f = _forecasts(spark, d)
    seen = dist.outcome(F.col("home_goals"), F.col("away_goals"))
    pick = lambda a, b, c: F.when(seen == 0, F.col(a)).when(seen == 1, F.col(b)).otherwise(F.col(c))
    return E.weight_search(f.select("fold", pick("p_home", "p_draw", "p_away").alias("pa"), pick("dh", "dd", "da").alias("pb")))


@query(_FC + _WS + ",\nm AS (SELECT st, sum(n * l) / sum(n) AS loss FROM ws WHERE st IN (0, 20) GROUP BY st)\nSELECT CASE WHEN a.loss - b.loss >= 0.005 THEN 'low_score' ELSE 'poisson' END AS model, round(a.loss - b.loss, 6) AS gain FROM m a, m b WHERE a.st = 0 AND b.st = 20")
def promotion_rule(spark, d):
    w = _weights(spark, d).where("weight in (0.0, 1.0)")
    scores = w.select(F.when(F.col("weight") == 0, "poisson").otherwise("low_score").alias("model"), F.when(F.col("weight") == 0, 0).otherwise(1).alias("ordinal"), "fold", "n", "log_loss")
    loss = scores.groupBy("model", "ordinal").agg((F.sum(F.col("n") * F.col("log_loss")) / F.sum("n")).alias("l"))
    gain = loss.agg((F.max(F.when(F.col("ordinal") == 0, F.col("l"))) - F.max(F.when(F.col("ordinal") == 1, F.col("l")))).alias("gain"))
    return E.promoted(scores).select("model").join(gain.select(F.round("gain", 6).alias("gain")))


@query(
    """WITH r AS (SELECT row_id, home_goals - away_goals AS gd, 1500.0 + (row_id % 97) AS hr, 1500.0 + (row_id % 89) AS ar FROM history WHERE home_goals IS NOT NULL AND away_goals IS NOT NULL)
SELECT row_id, round(1 / (1 + pow(10.0, -(hr + 55 - ar) / 400.0)), 6) AS expected, CASE WHEN abs(gd) <= 1 THEN 1.0 WHEN abs(gd) = 2 THEN 1.5 ELSE (11 + abs(gd)) / 8.0 END AS multiplier FROM r"""
)
def elo_expected(spark, d):
    r = table(spark, d, "history").where("home_goals is not null and away_goals is not null")
    return r.select("row_id", F.round(dist.expected_score(1500.0 + F.col("row_id") % 97, 1500.0 + F.col("row_id") % 89), 6).alias("expected"), dist.goal_multiplier(F.abs(F.col("home_goals") - F.col("away_goals"))).cast("double").alias("multiplier"))


SQL["elo_expected"] = SQL["elo_expected"].replace("CASE WHEN abs(gd) <= 1 THEN 1.0 WHEN abs(gd) = 2 THEN 1.5 ELSE (11 + abs(gd)) / 8.0 END", "CAST(CASE WHEN abs(gd) <= 1 THEN 1.0 WHEN abs(gd) = 2 THEN 1.5 ELSE (11 + abs(gd)) / 8.0 END AS DOUBLE)")


@query(_RATES + "," + _PMF + f",\nw AS (SELECT home, away, {_OUT} FROM gr GROUP BY home, away)\nUNPIVOT w ON p_home, p_draw, p_away INTO NAME stage VALUE probability".replace(",\nw AS", ",\nwide AS").replace("UNPIVOT w ", "SELECT home, away, stage, probability, round(sqrt(probability * (1 - probability) / 20000), 9) AS mc_se FROM (UNPIVOT wide ") + ")")
def unpivot_probabilities(spark, d, pairs=None):
    wide = grid_outcomes(spark, d, pairs)
    long = wide.unpivot(["home", "away"], ["p_home", "p_draw", "p_away"], "stage", "probability")
    return long.withColumn("mc_se", F.round(F.sqrt(F.col("probability") * (1 - F.col("probability")) / 20000), 9))


# ---- simulation ------------------------------------------------------------------------------------------------------
# A season of 36 teams and 144 fixtures; strengths come from customers' balances, as no schedule here is complete.

_SEASON = """WITH c AS (SELECT c_custkey, c_acctbal::DOUBLE AS b FROM customer),
dd AS (SELECT c_custkey - 1 AS day FROM c WHERE c_custkey BETWEEN 1 AND 8), ii AS (SELECT c_custkey - 1 AS i FROM c WHERE c_custkey BETWEEN 1 AND 18),
fx AS (SELECT day * 18 + i AS fixture, CASE WHEN day % 2 = 0 THEN i ELSE 18 + (i + day) % 18 END AS home, CASE WHEN day % 2 = 0 THEN 18 + (i + day) % 18 ELSE i END AS away FROM dd CROSS JOIN ii),
rt AS (SELECT fixture, home, away, round(exp(0.3 + (h.b - a.b) / 40000), 9) AS lh, round(exp(0.1 + (a.b - h.b) / 40000), 9) AS la FROM fx JOIN c h ON h.c_custkey = home + 1 JOIN c a ON a.c_custkey = away + 1)"""
_SIMS = """,
k AS (SELECT unnest(range(0, 12)) AS k),
cd AS (SELECT lam, k, round(sum(exp(-lam) * pow(lam, k) / factorial(CAST(k AS INTEGER))) OVER (PARTITION BY lam ORDER BY k), 12) AS c FROM (SELECT DISTINCT lh AS lam FROM rt UNION SELECT DISTINCT la FROM rt), k),
cl AS (SELECT lam, list(c ORDER BY k) AS cdf FROM cd GROUP BY lam),
uu AS (SELECT sim, rt.*, x.cdf AS ch, y.cdf AS ca, CAST(('0x' || substr(md5('7:' || sim || ':' || fixture || ':h'), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS uh, CAST(('0x' || substr(md5('7:' || sim || ':' || fixture || ':a'), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS ua
  FROM rt CROSS JOIN (SELECT unnest(range(0, 200)) AS sim) JOIN cl x ON x.lam = lh JOIN cl y ON y.lam = la),
u AS (SELECT sim AS competition, fixture, CAST(home AS VARCHAR) AS home, CAST(away AS VARCHAR) AS away, len(list_filter(ch, lambda c: c <= uh)) AS home_goals, len(list_filter(ca, lambda c: c <= ua)) AS away_goals FROM uu),
s AS (SELECT competition, home AS team, away AS opponent, home_goals AS gf, away_goals AS ga, 0 AS is_away FROM u UNION ALL SELECT competition, away, home, away_goals, home_goals, 1 FROM u)"""


def _season(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("b"))
    g = spark.range(144).select((F.col("id") / 18).cast("bigint").alias("day"), (F.col("id") % 18).alias("i"), F.col("id").alias("fixture"))
    far = 18 + (F.col("i") + F.col("day")) % 18
    even = F.col("day") % 2 == 0
    fx = g.select("fixture", F.when(even, F.col("i")).otherwise(far).alias("home"), F.when(even, far).otherwise(F.col("i")).alias("away"))
    rows = fx.join(c.select((F.col("c_custkey") - 1).alias("home"), F.col("b").alias("hb")), "home").join(c.select((F.col("c_custkey") - 1).alias("away"), F.col("b").alias("ab")), "away")
    gap = (F.col("hb") - F.col("ab")) / 40000
    none = F.lit(None).cast("int")
    return rows.select("fixture", F.col("home").cast("string").alias("home"), F.col("away").cast("string").alias("away"), F.round(F.exp(0.3 + gap), 9).alias("home_rate"), F.round(F.exp(0.1 - gap), 9).alias("away_rate"), none.alias("home_goals"), none.alias("away_goals"))


@query(
    _SEASON
    + _SIMS
    + ","
    + _NINE.replace("opp_gf DESC, team)", "opp_gf DESC, CAST(('0x' || substr(md5('7:' || competition || ':' || team || ':tie'), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496)")
    + """
SELECT team, round(avg((pos <= 8)::INT), 6) AS p_top8, round(avg((pos BETWEEN 9 AND 24)::INT), 6) AS p_playoff, round(avg((pos > 24)::INT), 6) AS p_eliminated, round(avg(points), 6) AS expected_points, round(avg(pos), 6) AS expected_rank FROM rk GROUP BY team"""
)
def league_monte_carlo(spark, d):
    return _league(spark, d, 200)  # as many as the twin draws


@query()
def league_monte_carlo_full(spark, d):
    return _league(spark, d, SIMULATIONS)


def _league(spark, d, n):
    scores = simulate.drawn_scores(_season(spark, d), n, 7)
    return _rounded(simulate.league_probabilities(scores, 7), "p_top8", "p_playoff", "p_eliminated", "expected_points", "expected_rank")


def _season_arrays(spark, d) -> simulate.Season:
    import numpy as np

    rows = _season(spark, d).orderBy("fixture").toPandas()  # 144 fixtures, a fixed size
    balance = {int(r["c_custkey"]) - 1: float(r["c_acctbal"]) for r in table(spark, d, "customer").where("c_custkey between 1 and 36").select("c_custkey", "c_acctbal").collect()}
    b = np.array([balance[i] for i in range(36)]) / 40000
    gap = b[:, None] - b[None, :]
    rates = np.stack([np.stack([np.exp(0.3 - 0.2 * n + gap), np.exp(0.1 + 0.1 * n - gap)], 2) for n in (0, 1)])
    unknown = np.full(len(rows), -1)
    return simulate.Season([str(i) for i in range(36)], rows["home"].astype(int).to_numpy(), rows["away"].astype(int).to_numpy(), unknown, unknown.copy(), rates)


@query()
def knockout_bracket(spark, d):
    return simulate.simulate(spark, _season_arrays(spark, d), SIMULATIONS, 11)


@query()
def conditioned_bracket(spark, d):
    """The knockout after a finished league phase, with its draw, one tie that is over and one leg of another."""
    import numpy as np

    season = _season_arrays(spark, d)
    rng = np.random.default_rng(11)
    goals = rng.poisson(season.rates[0, season.home, season.away])
    season.home_goals, season.away_goals = goals[:, 0], goals[:, 1]
    keys = [-k[0] for k in simulate.nine_keys(season, goals[None, :, 0], goals[None, :, 1])]
    order = [season.teams[i] for i in np.lexsort((np.arange(36), *reversed(keys)))]
    drawn = {key: [order[p[i] - 1] for i in (0, 1) for p in pairs] for key, (_, pairs) in bracket_state.SLOTS.items()}
    leg = lambda h, a: {"home_goals": h, "away_goals": a, "completed_at": "2027-02-20T22:00:00Z"}
    ties = {"po-0": {"legs": [leg(0, 3), leg(0, 0)], "winner": drawn["playoff_seeded"][0]}, "po-1": {"legs": [leg(1, 1)]}}
    state = {"source": "made up", "as_of": "2027-02-21T00:00:00Z", "league_order": order, "ties": ties} | drawn
    return simulate.simulate(spark, bracket_state.applied(season, state), SIMULATIONS, 11)


_LEGS = ", ".join(
    f"len(list_filter({cdf}, lambda c: c <= CAST(('0x' || substr(md5('5:' || fixture || ':{name}'), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496)) AS g{name}"
    for cdf, name in (("hc.cdf", "1h"), ("hc.cdf", "2a"), ("ac.cdf", "1a"), ("ac.cdf", "2h"), ("ec.cdf", "ea"), ("fc.cdf", "eb"))
)


@query(
    _SEASON
    + """,
lm AS (SELECT DISTINCT unnest([lh, la, lh / 3, la / 3]) AS lam FROM rt), k AS (SELECT unnest(range(0, 12)) AS k),
cd AS (SELECT lam, k, round(sum(exp(-lam) * pow(lam, k) / factorial(CAST(k AS INTEGER))) OVER (PARTITION BY lam ORDER BY k), 12) AS c FROM lm, k),
cl AS (SELECT lam, list(c ORDER BY k) AS cdf FROM cd GROUP BY lam),
g AS (SELECT fixture, home, away, """
    + _LEGS
    + """ FROM rt JOIN cl hc ON hc.lam = lh JOIN cl ac ON ac.lam = la JOIN cl ec ON ec.lam = lh / 3 JOIN cl fc ON fc.lam = la / 3),
t AS (SELECT *, g1h + g2a AS a, g1a + g2h AS b, CAST(('0x' || substr(md5('5:' || fixture || ':coin'), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 < 0.5 AS coin FROM g),
e AS (SELECT *, CASE WHEN a = b THEN a + gea ELSE a END AS x, CASE WHEN a = b THEN b + geb ELSE b END AS y FROM t)
SELECT fixture AS tie, x AS first_goals, y AS second_goals, CASE WHEN x > y OR (x = y AND coin) THEN CAST(home AS VARCHAR) ELSE CAST(away AS VARCHAR) END AS winner FROM e"""
)
def two_leg_ties(spark, d):
    r = _season(spark, d)
    ties = r.select(F.col("fixture").alias("tie"), F.col("home").alias("first"), F.col("away").alias("second"), F.col("home_rate").alias("r1h"), F.col("away_rate").alias("r1a"), F.col("away_rate").alias("r2h"), F.col("home_rate").alias("r2a"))
    return simulate.two_leg_winner(ties, 5).select("tie", "first_goals", "second_goals", "winner")


# ---- fitted models ---------------------------------------------------------------------------------------------------


def _normalised(spark, d):
    """(typed, name) of sides that are a team's name or nickname once escapes, blanks and composition are resolved."""
    teams = table(spark, d, "teams").select("name")
    sides = F.explode(F.array("home", "away")).alias("typed")
    typed = table(spark, d, "history").select(sides).union(table(spark, d, "fixtures").select(sides)).where("typed is not null").distinct()
    rows = parsers.normalised_team(typed.withColumn("name", F.col("typed")), "name", _aliases(spark, d))
    return rows.select("typed", "name").join(teams, "name", "left_semi").select("typed", "name")


def _team_rows(spark, d, spellings=_normalised):
    """Matches between known teams under their names, whatever form their dates are printed in, one row per day, sides
    and competition: timed rows before dated ones, then the later row."""
    names = materialize(spellings(spark, d), "spellings")
    rows = read_timestamps(table(spark, d, "history"), table(spark, d, "sources"))
    rows = rows.where("ts_seconds is not null and home_goals >= 0 and away_goals >= 0 and trim(competition) <> ''")
    for side in ("home", "away"):
        rows = lookup_join(rows, names.toDF(side, f"{side}_name"), [side], "inner", held=True)
    rows = rows.select("row_id", ntz_from_unix(F.col("ts_seconds")).alias("date"), "ts_has_time", F.col("home_name").alias("home"), F.col("away_name").alias("away"), "home_goals", "away_goals", "competition", "source", "completed_at", *_SHOTS)
    rows = rows.where("home <> away").withColumn("day", F.col("date").cast("date"))
    key = ["day", "home", "away", "competition"]
    kept = ["ts_has_time", "row_id", "date", "home_goals", "away_goals", "source", "completed_at", *_SHOTS]
    best = rows.groupBy(*key).agg(F.max(F.struct(*kept)).alias("m"))
    return best.select("home", "away", "competition", *[F.col(f"m.{c}").alias(c) for c in kept if c != "ts_has_time"])


_SHOTS = ["home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target"]


def _known(spark, d, matches=_team_rows):
    return materialize(matches(spark, d), "known")


@query()
def poisson_map_fit(spark, d, matches=_team_rows):
    return fit.fit_poisson(_known(spark, d, matches), CUT).strengths(spark)


@query()
def shot_blend_fit(spark, d, matches=_team_rows):
    return fit.fit_poisson(_known(spark, d, matches), CUT, shot_blend=0.3).strengths(spark)


@query()
def low_score_fit(spark, d, matches=_team_rows):
    model = fit.fit_low_score(_known(spark, d, matches), CUT)
    return spark.createDataFrame([(model.elo, model.league, model.rho, model.base.intercept, model.base.advantage)], "elo double, league double, rho double, intercept double, advantage double")


@query()
def calibrator_fit(spark, d):
    got = fit.fit_calibrator(_forecasts(spark, d))
    return spark.createDataFrame([got] if got else [], "log_temperature double, home_offset double, draw_offset double")


REPLAYS = ["2023-07-01 00:00:00", "2024-07-01 00:00:00", CUT]


@query()
def elo_replay(spark, d, matches=_team_rows):
    return ratings.replay(_known(spark, d, matches), REPLAYS)


@query()
def elo_ratings(spark, d, matches=_team_rows):
    return ratings.replay_tables(_known(spark, d, matches), REPLAYS)[1]


@query()
def league_offsets(spark, d, matches=_team_rows):
    return ratings.replay_tables(_known(spark, d, matches), REPLAYS)[2]


@query()
def model_coverage(spark, d, matches=_team_rows):
    """Teams of the open fixtures that the model knows nothing or little of."""
    open_ = table(spark, d, "fixtures").where("home_goals is null and home is not null and away is not null").select("home", "away").distinct()
    return fit.fit_poisson(_known(spark, d, matches), CUT).coverage_warnings(open_)


# ---- reports, serving and remaining selections -----------------------------------------------------------------------


@query(
    _SEASON
    + """, n AS (SELECT unnest([0, 1]) AS neutral), t AS (SELECT CAST(c_custkey - 1 AS INTEGER) AS i, b FROM c WHERE c_custkey BETWEEN 1 AND 36)
SELECT n.neutral, h.i AS home, a.i AS away, round(exp(0.3 - 0.2 * neutral + (h.b - a.b) / 40000), 6) AS home_rate, round(exp(0.1 + 0.1 * neutral + (a.b - h.b) / 40000), 6) AS away_rate FROM n, t h, t a WHERE h.i <> a.i"""
)
def all_pairs_rates(spark, d):
    t = table(spark, d, "customer").where("c_custkey between 1 and 36").select((F.col("c_custkey") - 1).cast("int").alias("i"), F.col("c_acctbal").cast("double").alias("b"))
    # 36 teams of one season against each other at home and on neutral ground: 2,520 rows at any size of the data.
    h, a = t.toDF("home", "hb"), F.broadcast(t.toDF("away", "ab"))
    pairs = h.join(a, F.col("home") != F.col("away")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("neutral"))
    gap = (F.col("hb") - F.col("ab")) / 40000
    return pairs.select("neutral", "home", "away", F.round(F.exp(0.3 - 0.2 * F.col("neutral") + gap), 6).alias("home_rate"), F.round(F.exp(0.1 + 0.1 * F.col("neutral") - gap), 6).alias("away_rate"))


_OPEN = _RATES.replace("SELECT DISTINCT home, away FROM u WHERE competition = 'UCL'", "SELECT DISTINCT home, away FROM fixtures WHERE home_goals IS NULL AND home IS NOT NULL AND away IS NOT NULL")


@query(_OPEN + "," + _PMF + f", o AS (SELECT home, away, {_OUT} FROM gr GROUP BY home, away)\nSELECT x.row_id, p_home, p_draw, p_away FROM fixtures x LEFT JOIN o ON x.home_goals IS NULL AND o.home = x.home AND o.away = x.away")
def fixture_predictions(spark, d):
    fx = table(spark, d, "fixtures").select("row_id", "home", "away", "home_goals")
    pairs = fx.where("home_goals is null and home is not null and away is not null").select("home", "away").distinct()
    out = _rounded(dist.grid_outcomes(dist.grid(_rates(spark, d, pairs), "lh", "la"), ["home", "away"]), "p_home", "p_draw", "p_away")
    played = fx.where("home_goals is not null").select("row_id", *[F.lit(None).cast("double").alias(c) for c in ("p_home", "p_draw", "p_away")])
    return fx.where("home_goals is null").join(out, ["home", "away"], "left").select("row_id", "p_home", "p_draw", "p_away").unionByName(played)


@query(_RATES + "," + _PMF + f", o AS (SELECT home || '|' || away AS team, {_OUT} FROM gr GROUP BY home, away)\nSELECT 'blank_team' AS rule, count(*) FILTER (WHERE team IS NULL OR trim(team) = '') AS violations FROM o UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE NOT isfinite(p_home) OR NOT isfinite(p_draw) OR NOT isfinite(p_away)) FROM o UNION ALL SELECT 'outside_unit', count(*) FILTER (WHERE least(p_home, p_draw, p_away) < 0 OR greatest(p_home, p_draw, p_away) > 1) FROM o UNION ALL SELECT 'repeated_team', count(team) - count(DISTINCT team) FROM o UNION ALL SELECT 'sum_off', count(*) FILTER (WHERE abs(p_home + p_draw + p_away - 1) > 1e-5) FROM o")
def probability_checks(spark, d, pairs=None):
    o = grid_outcomes(spark, d, pairs).select(F.concat_ws("|", "home", "away").alias("team"), "p_home", "p_draw", "p_away")
    off = o.agg(F.lit("sum_off").alias("rule"), F.count_if(F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1) > 1e-5).alias("violations"))
    return validate.probability_report(o, ["p_home", "p_draw", "p_away"]).unionByName(off)


@query(
    V
    + ","
    + SIDES
    + f""", c AS (SELECT team, competition, count(*) AS n FROM s WHERE NOT {EURO} GROUP BY ALL),
b AS (SELECT team, competition AS league FROM c QUALIFY row_number() OVER (PARTITION BY team ORDER BY n DESC, competition) = 1)
SELECT u.row_id, coalesce(h.league, 'OTHER') AS home_league, coalesce(a.league, 'OTHER') AS away_league, coalesce(h.league, 'OTHER') <> coalesce(a.league, 'OTHER') AS cross_league
FROM u LEFT JOIN b h ON h.team = u.home LEFT JOIN b a ON a.team = u.away"""
)
def league_lookup(spark, d):
    u = _unique(spark, d)
    league = materialize(M.modal_league(u), "league")
    rows = u.select("row_id", "home", "away").join(league.toDF("home", "hl"), "home", "left").join(league.toDF("away", "al"), "away", "left")
    other = F.lit("OTHER")
    return rows.select("row_id", F.coalesce("hl", other).alias("home_league"), F.coalesce("al", other).alias("away_league"), (F.coalesce("hl", other) != F.coalesce("al", other)).alias("cross_league"))


@query(
    _RATES
    + ","
    + _PMF
    + """, cu AS (SELECT home, away, hg, ag, hg * 13 + ag AS cell, round(sum(p) OVER (PARTITION BY home, away ORDER BY hg * 13 + ag), 10) AS c FROM gr),
d AS (SELECT home, away, CAST(('0x' || substr(md5('3:' || home || ':' || away), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS u FROM rt)
SELECT d.home, d.away, CAST(least(count(*) FILTER (WHERE c <= u), 168) // 13 AS INTEGER) AS hg, CAST(least(count(*) FILTER (WHERE c <= u), 168) % 13 AS INTEGER) AS ag FROM d JOIN cu ON cu.home = d.home AND cu.away = d.away GROUP BY d.home, d.away"""
)
def sampled_scores(spark, d, pairs=None):
    from matchlake.functions.random import uniform

    cells = dist.grid(_rates(spark, d, pairs), "lh", "la").withColumn("cell", F.col("hg") * 13 + F.col("ag"))
    upto = cells.withColumn("c", F.round(F.sum("p").over(Window.partitionBy("home", "away").orderBy("cell")), 10))
    drawn = upto.groupBy("home", "away").agg(F.least(F.count_if(F.col("c") <= uniform(F.lit(3), F.col("home"), F.col("away"))), F.lit(168)).alias("at"))
    return drawn.select("home", "away", F.floor(F.col("at") / 13).cast("int").alias("hg"), (F.col("at") % 13).cast("int").alias("ag"))


@query("SELECT CAST(row_number() OVER (ORDER BY expected_rank, team) AS BIGINT) AS place, team, round(expected_rank, 4) AS expected_rank, round(p_top8 * 100, 2) AS top8_pct FROM (" + SQL["league_monte_carlo"] + ")")
def projected_table(spark, d):
    return _projected(league_monte_carlo(spark, d))


@query()
def projected_table_full(spark, d):
    return _projected(league_monte_carlo_full(spark, d))


def _projected(league):
    # One season has 36 teams, so the order fits one task.
    return league.select(F.row_number().over(Window.orderBy("expected_rank", "team")).cast("bigint").alias("place"), "team", F.round("expected_rank", 4).alias("expected_rank"), F.round(F.col("p_top8") * 100, 2).alias("top8_pct"))


def _decision(spark, d, matches):
    return selection.select(_known(spark, d, matches), FORECAST_CUT)


@query()
def rolling_evaluation(spark, d, matches=_team_rows):
    """Per fold and model the metrics of forecasts fitted on what was known before the fold, and the model selected."""
    got = _decision(spark, d, matches)
    if got.scores is None:
        return spark.createDataFrame([], "fold int, purpose string, model string, n bigint, log_loss double, brier double, goal_log_loss double, score_log_loss double, ece double, chosen boolean")
    return got.scores.select("fold", "purpose", "model", "n", "log_loss", "brier", "goal_log_loss", "score_log_loss", "ece", (F.col("model") == got.selected_model).alias("chosen"))


@query()
def model_decision(spark, d, matches=_team_rows):
    """One row: what the selection and the general hold-out decide, with the calibration's fate."""
    report, got = selection.evaluated(_known(spark, d, matches), FORECAST_CUT)
    c = got.calibration
    row = (report["selected_model"], report["selection_basis"], got.status, got.ensemble_weight, bool(c["promoted"]), c.get("reason"), json.dumps(got.selection_log_loss, sort_keys=True))
    return spark.createDataFrame([row], "selected_model string, basis string, status string, ensemble_weight double, calibrated boolean, calibration_reason string, selection_log_loss string")


#: What the registered forecast knows.
FORECAST_CUT = "2027-01-12 00:00:00"


def named_sides(spark, d, spellings=_normalised):
    """(typed, name) of the teams' own names and of all spellings that refer to one."""
    own = table(spark, d, "teams").where("name is not null").select(F.col("name").alias("typed"), "name")
    return materialize(spellings(spark, d).unionByName(own).groupBy("typed").agg(F.min("name").alias("name")), "names")


def _schedules(spark, d, spellings):
    return forecast.schedules_as_of(table(spark, d, "fixtures"), table(spark, d, "sources"), named_sides(spark, d, spellings), FORECAST_CUT)


@query()
def known_schedule(spark, d, spellings=_normalised):
    """Every edition's matches as known at FORECAST_CUT."""
    return _schedules(spark, d, spellings)


@query()
def season_forecast(spark, d, matches=_team_rows, spellings=_normalised):
    """The latest season's outcome by the selected model, as of FORECAST_CUT, for the first edition whose schedule is
    complete; no rows where none is."""
    schedules = materialize(_schedules(spark, d, spellings), "schedules")
    whole = forecast.complete_editions(schedules).orderBy(F.col("season").desc(), "edition_id").first()
    if whole is None:
        return simulate.simulate(spark, _season_arrays(spark, d), 1, 0).limit(0)
    schedule = schedules.where(F.col("edition_id") == whole["edition_id"]).drop("edition_id")
    return forecast.run(spark, _known(spark, d, matches), schedule, FORECAST_CUT, SIMULATIONS, strict=False)[0]


_SCHEDULE_TEXT = "Matchday 1\nTuesday 8 September 2026\nAlfa Town 1-0 Beta\nnoise line\nGamma vs Delta SK (18:45)\nMatchday 2\nWednesday 14 October 2026\nBeta vs Gamma\n(20:15)\nDelta SK vs Alfa Town"
_RESULT_TEXT = "Tue Sep 17\n21:00 Alfa (ESP) v Beta (ENG) 3-2 a.e.t. (2-2, 1-1)\nWed Jan 22\nGamma (ITA) v Delta (GER) 1-0\nTue Feb 4 2027\nAlfa (ESP) v Gamma (ITA) 0-0\nMon Jan 5\nBeta (ENG) v Delta (GER) 2-0"


def _text(spark, text):
    return spark.createDataFrame([("inline", i, x) for i, x in enumerate(text.split("\n"), 1)], "file string, line_no int, line string")


@query(
    "SELECT 'ucl-2026-27-' || substr(sha256(home || '|' || away), 1, 16) AS match_id, date, '2026/27' AS season, 'league' AS stage, CAST(matchday AS INTEGER) AS matchday, home, away, CAST(hg AS INTEGER) AS home_goals, CAST(ag AS INTEGER) AS away_goals, CASE WHEN hg IS NULL THEN 'scheduled' ELSE 'finished' END AS status, 'inline' AS source FROM (WITH l AS (SELECT unnest(string_split('"
    + _SCHEDULE_TEXT.replace("\n", "~")
    + """', '~')) AS x, unnest(range(1, 11)) AS i),
k AS (SELECT i, x, last_value(nullif(regexp_extract(x, '^Matchday ([0-9]+)$', 1), '') IGNORE NULLS) OVER w AS matchday, last_value(nullif(regexp_extract(x, '^[A-Z][a-z]+day ([0-9]+ [A-Z][a-z]+ 20[0-9]{2})$', 1), '') IGNORE NULLS) OVER w AS day, lead(x) OVER (ORDER BY i) AS below FROM l WINDOW w AS (ORDER BY i)),
g AS (SELECT *, regexp_extract(x, '^(.+?) (?:vs|([0-9]+)-([0-9]+)) (.+?)(?: \\(([0-9]{2}:[0-9]{2})\\))?$', ['home', 'hg', 'ag', 'away', 'at']) AS m FROM k WHERE regexp_matches(x, '^(.+?) (?:vs|([0-9]+)-([0-9]+)) (.+?)$') AND matchday IS NOT NULL AND day IS NOT NULL)
SELECT matchday, m.home AS home, m.away AS away, nullif(m.hg, '') AS hg, nullif(m.ag, '') AS ag, strftime(strptime(day || ' ' || coalesce(nullif(m.at, ''), nullif(regexp_extract(below, '^\\(([0-9]{2}:[0-9]{2})\\)$', 1), ''), '21:00'), '%d %B %Y %H:%M') - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS date FROM g)"""
)
def parse_schedule_locf(spark, d):
    return parsers.schedule(_text(spark, _SCHEDULE_TEXT))


_RESULT_LINES = "(SELECT unnest(string_split('" + _RESULT_TEXT.replace("\n", "~") + "', '~')) AS x, unnest(range(1, 9)) AS i)"


@query(
    "WITH l AS "
    + _RESULT_LINES
    + """,
h AS (SELECT i, string_split(x, ' ') AS w FROM l WHERE regexp_matches(x, '^[A-Z][a-z]{2} [A-Z][a-z]{2} [0-9]+( 20[0-9]{2})?$')),
m AS (SELECT i, CAST(w[3] AS INTEGER) AS dom, TRY_CAST(w[4] AS INTEGER) AS year, month(strptime(w[2], '%b')) AS month FROM h),
t AS (SELECT *, CASE WHEN year IS NULL AND month < coalesce(lag(month) OVER (ORDER BY i), 7) THEN 1 ELSE 0 END AS turn, count(year) OVER (ORDER BY i) AS part FROM m),
y AS (SELECT i, dom, month, coalesce(max(year) OVER (PARTITION BY part), 2024) + sum(turn) OVER (PARTITION BY part ORDER BY i) AS year FROM t),
g AS (SELECT i, regexp_extract(x, '^(?:[0-9:]{5} )?(.+) \\([A-Z]{3}\\) v (.+) \\([A-Z]{3}\\) ([0-9]+-[0-9]+) ?(.*)$', ['home', 'away', 'score', 'tail']) AS p FROM l WHERE regexp_matches(x, ' v ')),
s AS (SELECT g.i, p.home AS home, p.away AS away, string_split(CASE WHEN regexp_matches(p.tail, 'aet|a\\.e\\.t\\.|pen') THEN regexp_extract(p.tail, '\\(([0-9]+-[0-9]+),', 1) ELSE p.score END, '-') AS score, (SELECT max(y.i) FROM y WHERE y.i < g.i) AS head FROM g)
SELECT strftime(make_date(CAST(y.year AS INTEGER), y.month, y.dom), '%Y-%m-%d') || 'T23:59:59Z' AS date, home, away, CAST(score[1] AS INTEGER) AS home_goals, CAST(score[2] AS INTEGER) AS away_goals, 'UCL' AS competition, 'inline' AS source FROM s JOIN y ON y.i = s.head"""
)
def parse_results_rollover(spark, d):
    return parsers.results(_text(spark, _RESULT_TEXT), "UCL", 2024)


# The distribution queries above take the UCL's pairs, as their twins do; these take every pair of the table.
EVERY_PAIR = (pair_rates, score_grid, grid_outcomes, skellam_outcomes, dixon_coles_grid, ensemble_mixture, calibrated_grid, sampled_scores, unpivot_probabilities, probability_checks)


def _of_every_pair(f):
    return lambda spark, d: f(spark, d, _valid(spark, d).select("home", "away").distinct())


QUERIES |= {f"{f.__name__}_all": _of_every_pair(f) for f in EVERY_PAIR}
SQL |= {f"{f.__name__}_all": SQL[f.__name__].replace("SELECT DISTINCT home, away FROM u WHERE competition = 'UCL'", "SELECT DISTINCT home, away FROM u") for f in EVERY_PAIR}
