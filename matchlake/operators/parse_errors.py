"""Loading delimited lines and setting aside those that fail, with the reason (problem 2).

Every file names its own columns and separator in its first line. From that header one anchored pattern for whole rows
is generated, a group per field with the values its column admits. A line that matches is loaded from the groups. A
line that does not runs through the schema's field-prefix patterns, each one field longer than the last; the longest
that still matches tells how far the line is sound, so the first broken field and its fault follow.

Reasons, the first that applies: ``quoting`` (a quote not opening a field, not closed, or followed by more text),
``column_count`` (not as many fields as the header), ``bad_value``.

Defined results: a null or blank line, a line of empty fields only, and a line where both goals are empty are skipped;
files without a first line, or with a null name, have no schema, and their lines fail with ``no_header`` (never in
:func:`failed_lines`' three reasons); blanks around values do not count; very long fields are matched by possessive
groups in linear time; an empty table gives empty results; repeated lines stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.util import lookup_join

TEXT = ["date", "home", "away", "competition", "source", "odds_provider", "odds_semantics", "completed_at", "retrieved_at"]
NAMES = ["home", "away"]
GOALS = ["home_goals", "away_goals"]
NUMBERS = ["home_shots", "away_shots", "home_shots_on_target", "away_shots_on_target", "odds_home", "odds_draw", "odds_away", "home_xg", "away_xg"]
#: Files whose schemas are broadcast after their number was counted.
SCHEMA_ROWS = 10_000

_B = r"[\s\u00a0]*+"


def _field(kind: Column, sep: Column, point: Column) -> Column:
    """The pattern of one field, bare or quoted, for the values its column admits."""
    whole = F.concat(F.lit(r"\d++(?:"), point, F.lit(r"0++)?"))
    number = F.concat(F.lit(r"(?:\d++(?:"), point, F.lit(r"\d++)?)?"))

    def both(bare: Column, quoted: Column) -> Column:
        return F.concat(F.lit('(?:"'), quoted, F.lit('"[ \\t]*+|'), bare, F.lit(")"))

    def value(v: Column) -> Column:
        return both(F.concat(F.lit(_B), v, F.lit(_B)), F.concat(F.lit(_B), v, F.lit(_B)))

    any_text = both(F.concat(F.lit("[^\""), sep, F.lit("]*+")), F.lit('(?:[^"]|"")*+'))
    name = both(F.concat(F.lit(_B + r"[^\s\u00a0" + '"'), sep, F.lit("][^\""), sep, F.lit("]*+")), F.lit(_B + r'(?:[^"\s\u00a0]|"")(?:[^"]|"")*+'))
    empty = value(F.lit(""))
    return F.when(kind == "any", any_text).when(kind == "name", name).when(kind == "goals", value(whole)).when(kind == "number", value(number)).when(kind == "empty", empty)


def _kind(column: Column) -> Column:
    return F.when(column.isin(*NAMES), "name").when(column.isin(*GOALS), "goals").when(column.isin(*NUMBERS), "number").otherwise("any")


def schemas(lines: DataFrame) -> DataFrame:
    """One row per file: its columns, separator and generated patterns."""
    head = lines.where((F.col("line_no") == 1) & F.col("file_name").isNotNull()).groupBy("file_name").agg(F.min("line").alias("h"))
    head = head.withColumn("h", F.regexp_replace("h", "^\ufeff", ""))
    head = head.withColumn("sep", F.when(F.size(F.split("h", ";")) > F.size(F.split("h", ",")), ";").otherwise(","))
    head = head.withColumn("columns", F.transform(F.split("h", F.col("sep")), lambda c: F.lower(F.trim(F.replace(c, F.lit('"'), F.lit(""))))))
    sep, point = F.col("sep"), F.when(F.col("sep") == ";", ",").otherwise(r"\.")
    cols = F.col("columns")

    def joined(kinds: Column, group: bool = False) -> Column:
        fields = F.transform(kinds, lambda k: F.concat(F.lit("(" if group else ""), _field(k, sep, point), F.lit(")" if group else "")))
        return F.aggregate(fields, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, sep, x)))

    typed = F.transform(cols, _kind)
    plain = F.transform(cols, lambda _: F.lit("any"))
    nil = F.transform(cols, lambda c: F.when(c.isin(*GOALS), "empty").otherwise("any"))
    head = head.select(
        "file_name",
        "sep",
        "columns",
        F.concat(F.lit("^("), joined(typed), F.lit(")$")).alias("whole"),
        F.concat(F.lit("^("), joined(nil), F.lit(")$")).alias("unplayed"),
        F.transform(F.sequence(F.lit(1), F.size(cols)), lambda n: F.concat(F.lit("^"), joined(F.slice(plain, F.lit(1), n)), F.lit("(?="), sep, F.lit("|$)"))).alias("sound"),
        F.transform(F.sequence(F.lit(1), F.size(cols)), lambda n: F.concat(F.lit("^"), joined(F.slice(typed, F.lit(1), n)), F.lit("(?="), sep, F.lit("|$)"))).alias("typed"),
        _field(F.lit("any"), sep, point).alias("one"),
    )
    return head.withColumn("formed", F.concat(F.lit("^(?s)"), F.col("one"), F.lit("(?:"), F.col("sep"), F.col("one"), F.lit(")*+$"))).drop("one")


def classified(lines: DataFrame) -> DataFrame:
    """``lines`` other than headers with ``verdict`` (loaded, skipped, quoting, column_count, bad_value, no_header),
    ``broken_field`` (the first broken column of a failed line) and the file's ``columns`` and ``sep``."""
    body = lines.where(F.col("line_no").isNull() | (F.col("line_no") != 1)).select("line_id", "file_name", "line_no", "line")
    rows = lookup_join(body, schemas(lines), ["file_name"], limit=SCHEMA_ROWS)
    line = F.col("line")
    blank = F.coalesce(F.regexp_replace(line, r'[\s\u00a0]', ""), F.lit("")) == ""
    # A pattern in a column keeps its compiled form from line to line of a file; rlike would compile it anew.
    whole = F.expr("regexp_extract(line, whole, 0) <> ''")
    unplayed = F.expr("regexp_extract(line, unplayed, 0) <> ''")
    hollow = F.regexp_replace(F.replace(line, F.col("sep"), F.lit("")), r'[\s\u00a0]|""', "") == ""
    sound = F.expr("size(filter(sound, p -> regexp_like(line, p)))")
    typed = F.expr("size(filter(typed, p -> regexp_like(line, p)))")
    n = F.size("columns")
    # How many fields are sound, and what follows them: an end, fields beyond the header's, or a field that is broken.
    rows = rows.withColumn("reach", F.when(~blank & F.col("columns").isNotNull() & ~whole, sound))
    rows = rows.withColumn("rest", F.expr("substring(line, length(regexp_extract(line, get(sound, reach - 1), 0)) + 1)"))
    reach, ended = F.col("reach"), F.coalesce(F.col("rest").rlike("^$"), F.lit(False))
    surplus = F.expr("regexp_like(substring(rest, 2), formed)")
    verdict = (
        F.when(blank, "skipped")
        .when(F.col("columns").isNull(), "no_header")
        .when(reach.isNull(), "loaded")
        .when((reach == 0) | (~ended & ((reach < n) | ~surplus)), "quoting")
        .when(hollow, "skipped")
        .when((reach < n) | ~ended, "column_count")
        .when(unplayed, "skipped")
        .otherwise("bad_value")
    )
    rows = rows.withColumn("verdict", verdict)
    at = F.when(F.col("verdict") == "bad_value", typed).when(F.col("verdict").isin("quoting", "column_count"), reach)
    rows = rows.withColumn("broken_field", F.when(at < n, F.get("columns", at)))
    return rows.select("line_id", "file_name", "line_no", "line", "columns", "sep", "verdict", "broken_field")


def failures(lines: DataFrame) -> DataFrame:
    """``(line_id, reason, broken_field)`` of lines that cannot be loaded; no field where there are too many."""
    return classified(lines).where(F.col("verdict").isin("quoting", "column_count", "bad_value")).select("line_id", F.col("verdict").alias("reason"), "broken_field")


def failed_lines(lines: DataFrame) -> DataFrame:
    """``(line_id, reason)`` of lines that cannot be loaded."""
    return failures(lines).select("line_id", "reason")


def loaded_lines(lines: DataFrame) -> DataFrame:
    """Valid lines as typed columns of the match history; columns a file lacks are null."""
    rows = classified(lines).where(F.col("verdict") == "loaded")
    # One pass cuts a sound line into its fields; an absolute end anchor keeps a trailing empty field.
    cut = F.when(F.col("sep") == ";", F.regexp_extract_all("line", F.lit(r'(?:^|(?<=;))("(?:[^"]|"")*+"[ \t]*+|[^";]*+)'), 1)).otherwise(F.regexp_extract_all("line", F.lit(r'(?:^|(?<=,))("(?:[^"]|"")*+"[ \t]*+|[^",]*+)'), 1))
    bare = F.transform(cut, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, r'^"|"[ \t]*$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    rows = rows.withColumn("v", F.transform(bare, lambda x: F.regexp_replace(x, r"^[\s\u00a0]+|[\s\u00a0]+$", "")))

    def text(name: str) -> Column:
        at = F.array_position("columns", F.lit(name)).cast("int")
        return F.when(at > 0, F.nullif(F.get("v", at - 1), F.lit("")))

    def number(name: str) -> Column:
        return F.when(F.col("sep") == ";", F.translate(text(name), ",", ".")).otherwise(text(name)).try_cast("double")

    return rows.select("line_id", "file_name", "line_no", *[text(c).alias(c) for c in TEXT], *[number(c).cast("int").alias(c) for c in GOALS], *[number(c).alias(c) for c in NUMBERS])
