"""Mixed timestamp formats and time zones (problem 4).

A printed date is read in three steps. Row-wise, a fixed catalogue of printed shapes extracts the parts, and every parse
that is a real instant becomes a candidate: the orders of an all-number date, the centuries of a two-digit year, the
units of a plain number, or the one reading of a shape that has no other. Per source, expectation-maximisation over the
mixture of readings weighs the candidates of all values together: a candidate contributes the weight of its reading times
the density of its year among the source's dates, both learned. A declared order enters as a strong prior, worth
DECLARED times the source's own values, and a value that contradicts it may be a misprint, so a few such values mean
nothing while many do overrule the declaration. The posterior picks a candidate or leaves the value marked
ambiguous. Last, the wall time is moved to UTC by offset, abbreviation, zone name or the source's own zone; a time that
occurs twice means the first, a skipped one moves forward by the gap.

Only counts of distinct candidate sets (reading and year) per source are shuffled; their number is bounded by the
catalogue and the years, not by the rows. Dates in the stored form take no part in the parse.

Defined results: null, blank or unreadable text, impossible dates and misprints give a null instant (``status`` says
why); an empty table gives an empty one; repeated rows stay repeated; other columns of the input pass through untouched.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.util import lookup_join, materialize

# What zone abbreviations mean, in hours east of UTC.
ABBREVIATIONS = {
    "UTC": 0,
    "GMT": 0,
    "Z": 0,
    "BST": 1,
    "CET": 1,
    "CEST": 2,
    "EET": 2,
    "EEST": 3,
    "EST": -5,
    "EDT": -4,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
STRICT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
DATE_ONLY_SECONDS = 86_399

_ZONE = r"([Zz]|[+-]\d{2}:?\d{2}|\[[^\]|]+\]|[A-Za-z]{2,5})"
_TAIL = rf"(?:(?:[Tt]|,?\s+)(\d{{1,2}})[:.](\d{{2}})(?:[:.](\d{{2}})(?:[.,]\d+)?)?\s*([AaPp][Mm])?\s*{_ZONE}?)?$"
#: Printed shapes; groups after the date are hour, minute, second, AM or PM, zone.
SHAPES = {
    "year_first": r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TAIL,
    "all_number": r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + _TAIL,
    "day_month_name": r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})(\s+)([A-Za-z]{3,9})\.?,?\s+(\d{4})" + _TAIL,
    "month_name_day": r"^(?:[A-Za-z]{6,9},\s+)?([A-Za-z]{3,9})(\.?\s+)(\d{1,2}),?\s+(\d{4})" + _TAIL,
    "compact": r"^(\d{4})()(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?()" + _ZONE + r"?$",
}
EPOCH = r"^(-?\d{1,18})$"

#: Readings and the density of one value under each, against one printed to the second.
READINGS = {"ISO": 1.0, "COMPACT": 1.0, "NAMED": 1.0, "DMY": 1.0, "MDY": 1.0, "YMD": 1.0, "EITHER": 1.0, "SECONDS": 1.0, "MILLIS": 1e-3, "MICROS": 1e-6, "NANOS": 1e-9}
ORDERS = ["DMY", "MDY", "YMD"]
UNITS = {"SECONDS": 1, "MILLIS": 10**3, "MICROS": 10**6, "NANOS": 10**9}
#: Pseudo-count of a reading, and of an order that contradicts the declared one.
FLAT_PRIOR, CONTRARY = 1.0, 1e-3
#: A declared order counts as much as so many times the source's all-number values.
DECLARED = 10.0
#: Share of all-number values expected to be misprints of the declared order, and their density against a real date: with
#: SURE, another order is taken once about a fifth of a source contradicts its declaration.
MISPRINTS, MISPRINT = 0.01, 0.5
#: Years any date falls in before anything is learned, with the mass left for all other years.
YEARS, OTHER_YEARS = (1970, 2069), 0.1
#: A candidate is taken when its posterior reaches this.
SURE = 0.95


def _digits(c: Column) -> Column:
    return c.try_cast("int")


#: Parts every shape is brought to, in this order, by one replacement.
PARTS = ["shape", "p1", "p2", "p3", "hh", "mi", "ss", "ap", "zone"]


def _fields(value: Column) -> Column:
    """Array of :data:`PARTS` of the shape that matches; null when none does.

    Each pattern is tried once: what it rewrites starts with the shape's name, which no other pattern matches.
    """
    out = value
    for name, pattern in SHAPES.items():
        out = F.regexp_replace(out, pattern, name + "|$1|$3|$4|$5|$6|$7|$8|$9")
    out = F.regexp_replace(out, EPOCH, "epoch|$1|||||||")
    return F.when(~value.contains("|") & out.contains("|"), F.split(out, r"\|"))


def _part(array: str, name: str) -> Column:
    return F.get(array, F.lit(PARTS.index(name)))


def _month(c: Column) -> Column:
    """1 to 12 of an English month name or its first three letters; null otherwise."""
    full = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "sept"]
    name = F.lower(c)
    known = name.isin(*full, *MONTHS)
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(name, 1, 3)).cast("int")
    return F.when(known & (at > 0), at)


def _candidate(reading: str, y: Column, m: Column, d: Column) -> Column:
    """The candidate where year, month and day are a real date; null otherwise."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    real = (y > 0) & m.between(1, 12) & (d >= 1) & (d <= last)
    return F.when(real, F.struct(F.lit(reading).alias("r"), y.alias("y"), m.alias("m"), d.alias("d"), F.lit(None).cast("bigint").alias("s")))


def _counted(unit: str, whole: Column) -> Column:
    """The candidate of a plain number in a unit, where its year has four digits at most."""
    seconds = F.floor(whole / UNITS[unit]).cast("bigint") if unit != "SECONDS" else whole
    y = F.floor(seconds / 31_556_952.0 + 1970).cast("int")
    none = F.lit(None).cast("int")
    return F.when((F.abs(seconds) < 10**12) & y.between(1, 9999), F.struct(F.lit(unit).alias("r"), y.alias("y"), none.alias("m"), none.alias("d"), seconds.alias("s")))


def _candidates(f: dict[str, Column], n: list[Column]) -> Column:
    """Array of ``(r, y, m, d, s)``: every parse of the parts that is a real date or instant."""
    shape, short = f["shape"], F.length(f["p3"]) == 2
    number = shape == "all_number"
    own = number & (n[0] != n[1])
    centuries = lambda r, when, y, m, d: [F.when(when & short, _candidate(r, y + 2000, m, d)), F.when(when & short, _candidate(r, y + 1900, m, d))]
    whole = f["p1"].try_cast("bigint")
    return F.array_compact(
        F.array(
            F.when(shape == "year_first", _candidate("ISO", n[0], n[1], n[2])),
            F.when(shape == "compact", _candidate("COMPACT", n[0], n[1], n[2])),
            F.when(shape == "day_month_name", _candidate("NAMED", n[2], _month(f["p2"]), n[0])),
            F.when(shape == "month_name_day", _candidate("NAMED", n[2], _month(f["p1"]), n[1])),
            F.when(own & ~short, _candidate("DMY", n[2], n[1], n[0])),
            F.when(own & ~short, _candidate("MDY", n[2], n[0], n[1])),
            F.when(number & ~own & ~short, _candidate("EITHER", n[2], n[0], n[1])),
            *centuries("DMY", own, n[2], n[1], n[0]),
            *centuries("MDY", own, n[2], n[0], n[1]),
            *centuries("EITHER", number & ~own, n[2], n[0], n[1]),
            *centuries("YMD", number & (F.length(f["p1"]) == 2), n[0], n[1], n[2]),
            *[F.when(shape == "epoch", _counted(u, whole)) for u in UNITS],
        )
    )


def posteriors(counts: DataFrame, rounds: int = 500) -> DataFrame:
    """EM over the mixture of readings, one source at a time.

    ``counts(source_key, declared, candidates, n)`` holds, per source, how many values have exactly these candidates,
    written ``READING:year|READING:year``. Returns ``(source_key, candidates, at, posterior, misprint)``: the
    place of the candidate taken, null where none is sure, its posterior and that of a misprint.
    """

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(READINGS)
        pick, either, misprint = {r: i for i, r in enumerate(names)}, names.index("EITHER"), len(names)
        sets = [[(r, int(y)) for r, y in (c.split(":") for c in text.split("|"))] for text in pdf["candidates"]]
        n = pdf["n"].to_numpy(float)
        group = np.array([i for i, s in enumerate(sets) for _ in s])
        place = np.array([k for s in sets for k in range(len(s))])
        form = np.array([pick[r] for s in sets for r, _ in s])
        years, year = np.unique([y for s in sets for _, y in s], return_inverse=True)
        density = np.array([READINGS[r] for s in sets for r, _ in s])
        numeric = np.array([any(r in ORDERS for r, _ in s) for s in sets])
        values = float(n[numeric].sum())

        prior = np.full(len(names) + 1, FLAT_PRIOR)
        prior[misprint] = MISPRINTS * values
        declared = pdf["declared"].dropna()
        odd = np.zeros(0, dtype=int)  # values that contradict the declaration may be misprints
        if len(declared) and (order := declared.iloc[0]) in ORDERS:
            prior[[pick[r] for r in ORDERS]] = CONTRARY
            prior[pick[order]] = DECLARED * values + FLAT_PRIOR
            odd = np.flatnonzero(numeric & np.array([all(r not in (order, "EITHER") for r, _ in s) for s in sets]))
        likely = (years >= YEARS[0]) & (years <= YEARS[1])
        base = np.where(likely, (1 - OTHER_YEARS) / (YEARS[1] - YEARS[0] + 1), 0.0) + OTHER_YEARS / 9999
        weight, spread = prior / prior.sum(), base
        posterior = density
        for _ in range(rounds):
            w = weight[form]
            w[form == either] = weight[pick["DMY"]] + weight[pick["MDY"]]
            like = w * density * spread[year]
            top = np.zeros(len(sets))
            np.maximum.at(top, group, density * spread[year])
            slip = np.zeros(len(sets))
            slip[odd] = weight[misprint] * MISPRINT * top[odd]
            total = np.bincount(group, like, len(sets)) + slip
            posterior = like / total[group]
            got = prior + np.bincount(form, posterior * n[group], len(names) + 1)
            got[either] = FLAT_PRIOR
            got[misprint] += float((n * slip / total).sum())
            new = got / got.sum()
            spread = (base + np.bincount(year, posterior * n[group], len(years))) / (1.0 + n.sum())
            moved = np.abs(new - weight).max()
            weight = new
            if moved < 1e-12:
                break
        rows = []
        for i, (key, text) in enumerate(zip(pdf["source_key"], pdf["candidates"], strict=True)):
            mine = np.flatnonzero(group == i)
            best = mine[int(np.argmax(posterior[mine]))]
            rows.append((key, text, int(place[best]) if posterior[best] >= SURE else None, float(posterior[best]), float(slip[i] / total[i])))
        return pd.DataFrame(rows, columns=["source_key", "candidates", "at", "posterior", "misprint"]).astype({"at": "Int32"})

    return counts.groupBy("source_key").applyInPandas(em, "source_key string, candidates string, at int, posterior double, misprint double")


MADE = ("seconds", "utc", "strict", "has_time", "reading", "posterior", "status")


def read_timestamps(rows: DataFrame, sources: DataFrame, value: str = "date", source: str = "source", prefix: str = "ts_") -> DataFrame:
    """Adds ``{prefix}seconds`` (UTC seconds from 1970), ``{prefix}utc`` (stored form), ``{prefix}strict``,
    ``{prefix}has_time``, ``{prefix}reading``, ``{prefix}posterior`` and ``{prefix}status`` (ok, missing, unreadable,
    impossible, misprint, ambiguous, no_zone) to ``rows``.

    ``sources(source, tz_name, date_order)`` gives each source's zone and declared order; both may be null. Columns of
    ``rows`` that have the names made here are replaced.
    """
    rows = rows.drop(*[prefix + k for k in MADE])
    strict = F.coalesce(F.col(value).rlike(STRICT), F.lit(False))
    # Stored dates take the short way, and teach a source's years at the cost of a substring.
    years = rows.where(strict).select(F.col(source).alias("src"), F.concat(F.lit("ISO:"), F.substring(F.col(value), 1, 4)).alias("candidates"))
    seconds = F.unix_seconds(F.try_make_timestamp(*[_digits(F.substring(F.col(value), i, n)) for i, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2))], F.substring(F.col(value), 18, 2).try_cast("decimal(16,6)"), F.lit("UTC")))
    stored = rows.where(strict).withColumn("__seconds", seconds)
    s = F.col("__seconds")
    made = {
        "seconds": s,
        "utc": _stored(s),
        "strict": F.lit(True),
        "has_time": F.pmod(s, F.lit(86_400)) != DATE_ONLY_SECONDS,
        "reading": F.when(s.isNotNull(), "ISO"),
        "posterior": F.when(s.isNotNull(), 1.0),
        "status": F.when(s.isNotNull(), "ok").otherwise("impossible"),
    }
    stored = stored.select(*_all(rows), *[c.alias(prefix + k) for k, c in made.items()])
    return stored.unionByName(read_printed(rows.where(~strict), sources, value, source, prefix, years))


def read_printed(rows: DataFrame, sources: DataFrame, value: str = "date", source: str = "source", prefix: str = "ts_", years: DataFrame | None = None) -> DataFrame:
    """:func:`read_timestamps` of rows whose dates are not in the stored form.

    ``years(src, candidates)`` are further sure values that the mixture learns from.
    """
    p = "__" + prefix
    rows = rows.drop(*[prefix + k for k in MADE])
    text = F.trim(F.col(value))
    d = _held(rows.withColumn(p + "f", _fields(text)), [p + "f"])
    f = {name: _part(p + "f", name) for name in PARTS}
    d = _held(d.withColumn(p + "c", _candidates(f, [_digits(f["p1"]), _digits(f["p2"]), _digits(f["p3"])])), [p + "c"])
    sets = F.when(F.size(p + "c") > 0, F.array_join(F.transform(p + "c", lambda x: F.concat(x["r"], F.lit(":"), x["y"].cast("string"))), "|"))
    d = _held(d.withColumn(p + "set", sets), [p + "set"])

    zones = sources.select(F.col("source").alias(p + "src"), F.col("tz_name").alias(p + "tz"), F.upper("date_order").alias(p + "declared")).where(F.col(p + "src").isNotNull())
    zones = zones.groupBy(p + "src").agg(F.min(p + "tz").alias(p + "tz"), F.min(p + "declared").alias(p + "declared"))
    d = d.withColumn(p + "src", F.col(source))
    zones = materialize(zones, "zones")
    d = lookup_join(d, zones, [p + "src"], held=True)

    counts = d.select(F.col(p + "src").alias("src"), F.col(p + "set").alias("candidates"))
    counts = (counts if years is None else counts.unionByName(years)).where("candidates is not null").groupBy("src", "candidates").agg(F.count("*").alias("n"))
    counts = counts.join(zones.select(F.col(p + "src").alias("src"), F.col(p + "declared").alias("declared")), "src", "left")
    chosen = posteriors(counts.withColumn("source_key", F.coalesce("src", F.lit(""))))
    chosen = chosen.select(F.col("source_key").alias(p + "key"), F.col("candidates").alias(p + "set"), F.col("at").alias(p + "pick"), F.col("posterior").alias(p + "posterior"), F.col("misprint").alias(p + "misprint"))
    d = d.withColumn(p + "key", F.coalesce(p + "src", F.lit("")))
    d = lookup_join(d, chosen, [p + "key", p + "set"])

    d = d.withColumn(p + "at", F.get(p + "c", F.col(p + "pick")))
    at, hh = F.col(p + "at"), _digits(f["hh"])
    half = F.upper(f["ap"])
    hour = F.when(half == "", hh).when((hh < 1) | (hh > 12), F.lit(None).cast("int")).when(half == "PM", hh % 12 + 12).otherwise(hh % 12)
    has_time = (f["shape"] != "epoch") & (f["hh"] != "")
    second = F.coalesce(_digits(f["ss"]), F.lit(0)).cast("decimal(16,6)")
    d = d.withColumn(p + "wall", F.try_make_timestamp(at["y"], at["m"], at["d"], F.when(has_time, hour).otherwise(23), F.when(has_time, _digits(f["mi"])).otherwise(59), F.when(has_time, F.when(second < 60, second)).otherwise(F.lit(59).cast("decimal(16,6)")), F.lit("UTC")))

    zone, wall = f["zone"], F.col(p + "wall")
    known = sorted(zoneinfo.available_timezones() - {"localtime", "posixrules"})
    named = F.regexp_extract(zone, r"^\[(.+)\]$", 1)
    abbreviation = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v * 3600))])
    offset = F.when(zone.rlike(r"^[+-]"), F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (_digits(F.substring(zone, 2, 2)) * 3600 + _digits(F.regexp_extract(zone, r"(\d{2})$", 1)) * 60)).otherwise(F.try_element_at(abbreviation, F.upper(zone)))
    region = F.when(named != "", named).when(zone == "", F.col(p + "tz"))
    region = F.when(region.isin(*known), region)
    seconds = (
        F.when(f["shape"] == "epoch", at["s"])
        .when(~has_time, F.unix_seconds(wall))
        .when(offset.isNotNull(), F.unix_seconds(wall) - offset)
        .when(region.isNotNull(), F.unix_seconds(F.to_utc_timestamp(wall, region)))
    )
    d = d.withColumn(p + "seconds", seconds.cast("bigint"))

    s = F.col(p + "seconds")
    timed = F.when(s.isNull(), F.lit(None).cast("boolean")).otherwise(has_time | (f["shape"] == "epoch"))
    status = (
        F.when(s.isNotNull(), "ok")
        .when(F.coalesce(text, F.lit("")) == "", "missing")
        .when(F.col(p + "f").isNull(), "unreadable")
        .when((F.size(p + "c") > 0) & at.isNull(), F.when(F.col(p + "misprint") > 0.5, "misprint").otherwise("ambiguous"))
        .when(wall.isNull(), "impossible")
        .otherwise("no_zone")
    )
    made = {
        "seconds": s,
        "utc": _stored(s),
        "strict": F.lit(False),
        "has_time": timed,
        "reading": at["r"],
        "posterior": F.col(p + "posterior"),
        "status": status,
    }
    out = d.select(*_all(rows), *[c.alias(prefix + k) for k, c in made.items()])
    return _held(out, [prefix + k for k in made])


def _all(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _held(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows with ``columns`` passed through a one-row generator.

    Otherwise the optimiser pushes every later filter on them below the steps that compute them, with the whole parse
    inlined and repeated, and the plan outgrows the driver.
    """
    keep = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def _stored(seconds: Column) -> Column:
    ntz = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.concat(F.translate(F.substring(ntz.cast("string"), 1, 19), " ", "T"), F.lit("Z"))


def printed_instants(tables: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """``(tbl, row_id, utc)`` of all rows of ``tables`` whose date is not in the stored form and means an instant."""
    both = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("tbl"), "row_id", "date", "source")
        both = part if both is None else both.unionByName(part)
    loose = both.where(F.col("date").isNotNull() & ~F.col("date").rlike(STRICT))
    return read_printed(loose, sources).where(F.col("ts_seconds").isNotNull()).select("tbl", "row_id", F.col("ts_utc").alias("utc"))


def recovered_orders(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, values, ambiguous, misread): all-number dates of each source read with its order withheld, against the
    reading with the declared one. ambiguous values are left open, misread ones are taken for another instant."""
    told = read_timestamps(rows.select("date", "source"), sources, prefix="told_")
    alone = read_timestamps(told, sources.withColumn("date_order", F.lit(None).cast("string")), prefix="own_")
    alone = alone.where(F.col("told_reading").isin(*ORDERS))
    return alone.groupBy("source").agg(F.count("*").alias("values"), F.count_if(F.col("own_status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("own_seconds") != F.col("told_seconds")).alias("misread"))
