"""Queries of the general training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchlake.operators.known_at import history_versions
from matchlake.operators.parse_errors import GOALS, NUMBERS, TEXT, failed_lines, failures, loaded_lines
from matchlake.operators.snapshots import fixture_changes
from matchlake.operators.timestamps import printed_instants, recovered_orders
from matchlake.util import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return failed_lines(table(spark, d, "raw_results"))


def p2_failures(spark: SparkSession, d: str) -> DataFrame:
    return failures(table(spark, d, "raw_results"))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return loaded_lines(table(spark, d, "raw_results"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return fixture_changes(table(spark, d, "fixtures"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return printed_instants({"history": table(spark, d, "history"), "fixtures": table(spark, d, "fixtures")}, table(spark, d, "sources"))


def p4_undeclared(spark: SparkSession, d: str) -> DataFrame:
    """How far the mixture recovers each source's order when no declaration is given."""
    history, fixtures = table(spark, d, "history"), table(spark, d, "fixtures")
    rows = history.select("date", "source").unionByName(fixtures.select("date", "source"))
    return recovered_orders(rows, table(spark, d, "sources"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return history_versions(table(spark, d, "history"), table(spark, d, "competition_versions"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_failures, p2_loaded, p3_found, p4_found, p4_undeclared, p7_found)}


def _field(sep: str) -> str:
    return f'(?:"(?:[^"]|"")*"[ \\t]*|[^"{sep}]*)'


# Lines cut into fields: ``v`` are the bare values of a line whose quoting is sound.
_BLANK = r"[\s\x{A0}]"
_LINES = rf"""
WITH hd AS (SELECT file_name, replace(min(line), chr(65279), '') AS h FROM raw_results WHERE line_no = 1 AND file_name IS NOT NULL GROUP BY file_name),
hs AS (SELECT file_name, h, CASE WHEN len(string_split(h, ';')) > len(string_split(h, ',')) THEN ';' ELSE ',' END AS sep FROM hd),
hc AS (SELECT file_name, sep, list_transform(string_split(h, sep), lambda x: lower(trim(replace(x, '"', '')))) AS cols FROM hs),
b AS (SELECT r.line_id, r.file_name, r.line_no, r.line, sep, cols FROM raw_results r JOIN hc ON hc.file_name = r.file_name
  WHERE (line_no IS NULL OR line_no <> 1) AND regexp_replace(coalesce(line, ''), '{_BLANK}', '', 'g') <> ''),
f AS (SELECT *, CASE sep WHEN ';' THEN regexp_full_match(line, '(?s){_field(';')}(?:;{_field(';')})*') ELSE regexp_full_match(line, '(?s){_field(',')}(?:,{_field(',')})*') END AS formed FROM b),
x AS (SELECT *, CASE sep WHEN ';' THEN regexp_extract_all(';' || line, '(?s);({_field(';')})', 1) ELSE regexp_extract_all(',' || line, '(?s),({_field(',')})', 1) END AS raw FROM f),
w AS (SELECT *, list_transform(raw, lambda q: regexp_replace(CASE WHEN q[1] = '"' THEN replace(regexp_replace(q, '^"|"[ \t]*$', '', 'g'), '""', '"') ELSE q END, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS v FROM x),
t AS (SELECT *, {", ".join(f"coalesce(v[list_position(cols, '{c}')], '') AS c_{c}" for c in (*TEXT, *GOALS, *NUMBERS))},
  CASE sep WHEN ';' THEN ',' ELSE '\.' END AS point FROM w),
k AS (SELECT *, CASE WHEN NOT formed THEN 'quoting' WHEN len(list_filter(v, lambda q: q <> '')) = 0 THEN 'skipped' WHEN len(v) <> len(cols) THEN 'column_count'
  WHEN c_home_goals = '' AND c_away_goals = '' THEN 'skipped'
  WHEN c_home = '' OR c_away = '' OR {" OR ".join(f"NOT regexp_full_match(c_{c}, '[0-9]+(?:' || point || '0+)?')" for c in GOALS)}
    OR {" OR ".join(f"NOT regexp_full_match(c_{c}, '(?:[0-9]+(?:' || point || '[0-9]+)?)?')" for c in NUMBERS)} THEN 'bad_value' ELSE 'loaded' END AS verdict FROM t)"""
_NUMBER = "TRY_CAST(CASE sep WHEN ';' THEN replace(c_{0}, ',', '.') ELSE c_{0} END AS DOUBLE)"

SQL: dict[str, str] = {
    "p2_found": _LINES + "\nSELECT line_id, verdict AS reason FROM k WHERE verdict IN ('quoting', 'column_count', 'bad_value')",
    "p2_loaded": _LINES
    + "\nSELECT line_id, file_name, line_no, "
    + ", ".join([f"nullif(c_{c}, '') AS {c}" for c in TEXT] + [f"CAST({_NUMBER.format(c)} AS INTEGER) AS {c}" for c in GOALS] + [f"{_NUMBER.format(c)} AS {c}" for c in NUMBERS])
    + " FROM k WHERE verdict = 'loaded'",
    "p3_found": """
WITH one AS (
  SELECT edition_id, snapshot_no, match_id, home_goals, away_goals, lower(trim(status)) AS status FROM fixtures
  WHERE edition_id IS NOT NULL AND snapshot_no IS NOT NULL AND match_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY edition_id, snapshot_no, match_id ORDER BY row_id DESC) = 1),
snaps AS (
  SELECT edition_id, snapshot_no AS n, lag(snapshot_no) OVER (PARTITION BY edition_id ORDER BY snapshot_no) AS before
  FROM (SELECT DISTINCT edition_id, snapshot_no FROM one)),
pairs AS (SELECT * FROM snaps WHERE before IS NOT NULL)
SELECT p.edition_id, p.n AS snapshot_no, a.match_id, 'added' AS change_kind
FROM pairs p JOIN one a ON a.edition_id = p.edition_id AND a.snapshot_no = p.n
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.edition_id = p.edition_id AND b.snapshot_no = p.before AND b.match_id = a.match_id)
UNION ALL
SELECT p.edition_id, p.n, b.match_id, 'removed'
FROM pairs p JOIN one b ON b.edition_id = p.edition_id AND b.snapshot_no = p.before
WHERE NOT EXISTS (SELECT 1 FROM one a WHERE a.edition_id = p.edition_id AND a.snapshot_no = p.n AND a.match_id = b.match_id)
UNION ALL
SELECT p.edition_id, p.n, a.match_id, 'changed'
FROM pairs p JOIN one a ON a.edition_id = p.edition_id AND a.snapshot_no = p.n
JOIN one b ON b.edition_id = p.edition_id AND b.snapshot_no = p.before AND b.match_id = a.match_id
WHERE a.home_goals IS DISTINCT FROM b.home_goals OR a.away_goals IS DISTINCT FROM b.away_goals OR a.status IS DISTINCT FROM b.status
""",
    "p7_found": """
WITH h AS (
  SELECT row_id, competition, try_strptime(date, '%Y-%m-%dT%H:%M:%SZ') AS t FROM history
  WHERE regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z'))
SELECT h.row_id, v.version_id
FROM h JOIN competition_versions v ON v.competition = h.competition AND v.valid_from <= h.t AND (v.valid_to IS NULL OR h.t < v.valid_to)
  AND v.known_at <= h.t AND (v.withdrawn_at IS NULL OR h.t < v.withdrawn_at)
QUALIFY row_number() OVER (PARTITION BY h.row_id ORDER BY v.valid_from DESC, v.known_at DESC, v.version_id DESC) = 1
""",
}
