"""Attributes as known at event time (problem 7).

A version of an entity's attributes can be seen from ``max(valid_from, known_at)`` until ``min(valid_to,
withdrawn_at)``. The ends of these spans are the entity's changes. Counting the changes up to an event's time over
narrow ``(entity, time)`` rows gives the event a version number; between two changes the visible version is one and
the same, so attributes are joined by entity and number alone.

Which version wins between two changes is found without comparing versions pairwise: a span of numbers is cut into
dyadic ranges (at most two per level), each range keeps its best version, and a number takes the best of the ranges
above it.

The running count is made inside ``(entity, day)`` and carried over the days of an entity, so a hot entity is spread
over days; equal times of an entity are counted once before.

Defined results: events with a null entity or time, and events before the first change, get no version; versions with a
null entity, ``valid_from`` or ``known_at`` can never be seen; empty spans never win; ties are settled by the order given,
last by version id; empty tables give no version; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.timestamps import STRICT
from matchlake.util import lookup_join, materialize

DAY = 86_400_000_000


def version_spans(versions: DataFrame, entity: str, version_id: str) -> DataFrame:
    """``(e, lo, hi, best)`` in microseconds; ``hi`` null where open; ``best`` orders versions, largest wins."""
    lo = F.greatest(F.unix_micros(F.col("valid_from").cast("timestamp")), F.unix_micros(F.col("known_at").cast("timestamp")))
    hi = F.least(F.unix_micros(F.col("valid_to").cast("timestamp")), F.unix_micros(F.col("withdrawn_at").cast("timestamp")))
    out = versions.where(F.col("valid_from").isNotNull() & F.col("known_at").isNotNull() & F.col(entity).isNotNull())
    out = out.select(F.col(entity).alias("e"), lo.alias("lo"), hi.alias("hi"), F.struct(F.col("valid_from"), F.col("known_at"), F.col(version_id).alias("id")).alias("best"))
    return out.where(F.col("hi").isNull() | (F.col("lo") < F.col("hi")))


def _counted(times: DataFrame) -> DataFrame:
    """Adds ``number``, the changes of the entity up to and with ``t``. times(e, t, change): distinct rows."""
    times = times.groupBy("e", "t").agg(F.max("change").alias("change")).withColumn("day", F.floor(F.col("t") / DAY))
    days = times.groupBy("e", "day").agg(F.sum("change").alias("n"))
    days = days.withColumn("base", F.sum("n").over(Window.partitionBy("e").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))
    inside = times.withColumn("inside", F.sum("change").over(Window.partitionBy("e", "day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(days.select("e", "day", F.coalesce("base", F.lit(0)).alias("base")), ["e", "day"]).select("e", "t", (F.col("base") + F.col("inside")).alias("number"))


def winners(spans: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(e, number, best)``: the winning version between change ``number`` and the next. numbers(e, t, number)."""
    at = numbers.select("e", F.col("t"), "number")
    most = numbers.agg(F.max("number")).first()[0]  # the number of changes of one entity fixes the levels of the cut
    levels = int(most or 0).bit_length() + 1
    cut = spans.join(at.withColumnsRenamed({"t": "lo", "number": "i"}), ["e", "lo"]).join(at.withColumnsRenamed({"t": "hi", "number": "j"}), ["e", "hi"], "left")
    last = numbers.groupBy("e").agg((F.max("number") + 1).alias("end"))
    cut = cut.join(last, "e").select("e", "i", F.coalesce("j", "end").alias("j"), "best")
    # [i, j) as dyadic ranges: at level l the left end is cut where its bit is set, the right end likewise.
    lv = F.sequence(F.lit(0), F.lit(levels))

    def ranges(l):  # noqa: E741
        power = F.call_function("shiftleft", F.lit(1).cast("bigint"), l)
        a, b = F.floor((F.col("i") + power - 1) / power).cast("bigint"), F.floor(F.col("j") / power).cast("bigint")
        left = F.when((a < b) & (a % 2 == 1), F.struct(l.alias("l"), a.alias("p")))
        right = F.when((a < b) & (b % 2 == 1) & ~((a % 2 == 1) & (b - 1 == a)), F.struct(l.alias("l"), (b - 1).alias("p")))
        return F.array(left, right)

    pieces = cut.select("e", "best", F.explode(F.filter(F.flatten(F.transform(lv, ranges)), lambda x: x.isNotNull())).alias("r"))
    pieces = pieces.groupBy("e", F.col("r.l").alias("l"), F.col("r.p").alias("p")).agg(F.max("best").alias("best"))
    above = numbers.select("e", "number", F.explode(F.transform(lv, lambda l: F.struct(l.alias("l"), F.floor(F.col("number") / F.call_function("shiftleft", F.lit(1).cast("bigint"), l)).cast("bigint").alias("p")))).alias("r"))  # noqa: E741
    above = above.select("e", "number", F.col("r.l").alias("l"), F.col("r.p").alias("p"))
    # Both sides are many times what they are made of, which the planner cannot know: never broadcast them.
    return above.hint("merge").join(pieces.hint("merge"), ["e", "l", "p"]).groupBy("e", "number").agg(F.max("best").alias("best"))


def as_known(events: DataFrame, versions: DataFrame, entity: str, micros: str, version_id: str = "version_id", attributes: list[str] | None = None) -> DataFrame:
    """Left-joins to each event the version of ``entity`` that was valid and known at ``micros`` (UTC microseconds).

    Adds ``version_id`` and the ``attributes`` asked for, named ``known_<attribute>``; columns of the input of these
    names are replaced.
    """
    spans = version_spans(versions, entity, version_id)
    changes = spans.select("e", F.col("lo").alias("t")).union(spans.where("hi is not null").select("e", F.col("hi").alias("t"))).withColumn("change", F.lit(1))
    asked = events.where(F.col(entity).isNotNull() & F.col(micros).isNotNull()).select(F.col(entity).alias("e"), F.col(micros).alias("t")).withColumn("change", F.lit(0))
    numbered = _counted(changes.union(asked))
    best = winners(spans, materialize(_counted(changes), "changes"))
    wide = best.select(F.col("e"), F.col("number"), F.col("best.id").alias("__id"))
    if attributes:
        wide = wide.join(versions.select(F.col(version_id).alias("__id"), *[F.col(a).alias(f"__known_{a}") for a in attributes]), "__id")
    keyed = lookup_join(events.withColumns({"__e": F.col(entity), "__t": F.col(micros)}), numbered.toDF("__e", "__t", "__number"), ["__e", "__t"])
    out = lookup_join(keyed, wide.withColumnsRenamed({"e": "__e", "number": "__number"}), ["__e", "__number"])
    made = ["version_id", *[f"known_{a}" for a in attributes or []]]
    kept = [c for c in events.columns if c not in made]
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept], F.col("__id").alias("version_id"), *[F.col(f"__known_{a}").alias(f"known_{a}") for a in attributes or []])


def history_versions(history: DataFrame, versions: DataFrame) -> DataFrame:
    """``(row_id, version_id)`` of history rows whose date is in the stored form and that have a visible version."""
    micros = F.unix_micros(F.try_to_timestamp("date", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    events = history.where(F.col("date").rlike(STRICT)).select("row_id", "competition", micros.alias("micros"))
    return as_known(events, versions, "competition", "micros").where(F.col("version_id").isNotNull()).select("row_id", "version_id")
