"""Landing files of sources, and the union of many sources of which some may fail.

Files are kept by their content: ``objects/<sha256>`` once, ``latest/<name>`` as last retrieved, and beside it what is
known of the retrieval. There is no network here; whoever retrieves a file lands its bytes. Readers isolate every source:
one that cannot be read is reported with its error and leaves the others alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.operators import matches as M
from matchlake.plans.store import Folder, document
from matchlake.schema import HISTORY
from matchlake.sources import parsers
from matchlake.util import materialize

REPORT = "source string, rows bigint, first_date string, last_date string, error string"


def land(spark: SparkSession, root: str, name: str, content: bytes, url: str, etag: str | None = None, at: datetime | None = None) -> str:
    """Keeps the bytes retrieved from ``url`` and returns their digest; the same bytes are stored once."""
    folder, digest = Folder(spark, root), hashlib.sha256(content).hexdigest()
    if not folder.exists("objects", digest):
        folder.write_bytes(content, "objects", digest)
    folder.write_bytes(content, "latest", name)
    known = {"url": url, "etag": etag, "bytes": len(content), "sha256": digest, "retrieved_at": (at or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")}
    folder.write(document(known), "latest", f"{name}.meta.json")
    return digest


def provenance(spark: SparkSession, root: str) -> DataFrame:
    """(url, etag, bytes, sha256, retrieved_at) of what was landed, by file."""
    schema = "url string, etag string, bytes bigint, sha256 string, retrieved_at string"
    return spark.read.schema(schema).option("multiLine", True).json(f"{root}/latest/*.meta.json")


def altered(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256): objects whose bytes are not those of their name."""
    files = spark.read.format("binaryFile").load(f"{root}/objects")
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    return hashed.where(F.substring_index("path", "/", -1) != F.col("sha256"))


def current(spark: SparkSession, root: str, name: str, url: str, fetch: Callable[[], bytes], now: datetime | None = None) -> tuple[str, str | None]:
    """(path of the file, warning): freshly retrieved, or, when that fails, what was landed from the same ``url`` the same
    UTC day; older copies do not count."""
    now = now or datetime.now(UTC)
    folder = Folder(spark, root)
    try:
        content = fetch()
    except OSError as e:
        if folder.exists("latest", f"{name}.meta.json"):
            known = json.loads(folder.read("latest", f"{name}.meta.json"))
            if known["url"] == url and known["retrieved_at"][:10] == now.strftime("%Y-%m-%d"):
                return folder.path("latest", name), f"{name}: not retrieved ({e}); today's copy is used"
        raise
    land(spark, root, name, content, url, at=now)
    return folder.path("latest", name), None


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Rows of CSV files with a header, under a schema; a line that does not fit it raises when it is read."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)


def raw_table(spark: SparkSession, path: str) -> DataFrame:
    """A result table as strings, whatever its columns, in UTF-8 or Latin-1."""
    text = spark.read.format("binaryFile").load(path).select(parsers.decoded(F.col("content")).alias("t"))
    lines = text.select(F.explode(F.split("t", r"\r?\n")).alias("line")).where("trim(line) <> ''")
    header = lines.first()
    if header is None:
        raise ValueError("an empty table")
    columns = [c.strip() for c in header["line"].split(",")]
    row = F.from_csv("line", ", ".join(f"`{c}` string" for c in columns if c))
    return lines.where(F.col("line") != header["line"]).select(row.alias("r")).select("r.*")


def _read(spark: SparkSession, s: dict) -> DataFrame:
    if s["kind"] == "table":
        return parsers.result_table(raw_table(spark, s["path"]), s["competition"], s["source"], s.get("provider", ""), s.get("semantics", ""))
    if s["kind"] == "text":
        return parsers.results(parsers.text_lines(spark, s["path"]), s["competition"], s["start_year"]).withColumn("source", F.lit(s["source"]))
    raise ValueError(f"unknown kind of source {s['kind']}")


def history_of(spark: SparkSession, sources: list[dict], start: str, end: str, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, report) of ``sources``: dicts with kind (table or text), path, source, competition and what the kind needs.

    Dates in [start, end) count. Every source is read and written by itself, so its errors are its own: the report has its
    rows, dates and error. A source without a row is an error, and so is nothing at all. Sides are normalised by
    ``aliases(alias, name)``.
    """
    parts, report = [], []
    for s in sources:
        try:
            rows = _read(spark, s).where((F.col("date") >= start) & (F.col("date") < end))
            for side in ("home", "away"):
                rows = parsers.normalised_team(rows, side, aliases)
            rows = materialize(rows, "source")
            n, first, last = rows.agg(F.count("*"), F.min("date"), F.max("date")).first()
            if not n:
                raise ValueError("no matches")
            parts.append(rows)
            report.append((s["source"], n, first, last, None))
        except Exception as e:  # whatever a reader or the JVM raises belongs to this source
            report.append((s["source"], 0, None, None, str(e).split("\n")[0][:300]))
    if not parts:
        raise ValueError("no source could be read")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for f in HISTORY.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out.select(*HISTORY.names), spark.createDataFrame(report, REPORT)


def reach(history: DataFrame, teams: DataFrame, competition: str = "UCL") -> DataFrame:
    """(team, matches, latest, connected): coverage of the season's teams, and whether matches connect each with the
    team that stands first by name; raises without a match of the competition."""
    if not history.where(F.col("competition") == competition).limit(1).count():
        raise ValueError(f"no match of {competition}")
    own = M.by_side(history).groupBy("team").agg(F.count("*").alias("matches"), F.max("date").alias("latest"))
    seed = teams.agg(F.min("team")).first()[0]
    linked = M.connected_to(history.select("home", "away").distinct(), F.lit(seed)).withColumn("connected", F.lit(True))
    rows = teams.join(own, "team", "left").join(linked, "team", "left")
    return rows.select("team", F.coalesce("matches", F.lit(0)).alias("matches"), "latest", F.coalesce("connected", F.lit(False)).alias("connected"))
