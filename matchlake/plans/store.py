"""Immutable, hash-verified generations of runs behind a pointer, a catalogue of them, replay checks and export.

Folders lie on any Hadoop file system, so the driver needs none of the files on its own disk: tables are written and read
by executors, their files are hashed where they are read, and documents and the pointer go through the file system's
interface. A generation is written completely and hashed before it gets its name, and only then is the pointer moved;
readers verify the hashes before use. Runs that cannot be read are isolated into an issues table, never raised.
"""

from __future__ import annotations

import json
import math
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")
METADATA, POINTER = "metadata.json", "current.json"


class Folder:
    """A folder on a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.path(*parts)))

    def folders(self) -> list[str]:
        if not self.exists():
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory())

    def read(self, *parts: str) -> str:
        try:
            stream = self._fs.open(self._path(self.path(*parts)))
        except Exception as e:  # the JVM's own kinds of missing files
            raise FileNotFoundError(self.path(*parts)) from e
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        self.write_bytes(text.encode("utf-8"), *parts)

    def write_bytes(self, content: bytes, *parts: str) -> None:
        """Through a file of another name that then takes the place of the old one."""
        path = self._path(self.path(*parts))
        draft = self._path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(content))
        stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, options)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(self.path(old)), self._path(self.path(new))):
            raise FileExistsError(new)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)

    def digests(self, name: str) -> dict[str, str]:
        """SHA-256 of every file of a generation but its metadata and hidden ones, hashed by the tasks that read them."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path(name))
        marker = f"/{name}/"
        below = F.substring_index(F.col("path"), marker, -1)
        hashed = files.select(F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))).alias("name"), F.sha2("content", 256).alias("digest"))
        try:
            rows = hashed.collect()  # one row per file of a run
        except (PySparkException, Py4JJavaError) as e:
            raise ValueError(f"{name}: a file cannot be read") from e
        return {r["name"]: r["digest"] for r in rows if r["name"] != METADATA and not r["name"].split("/")[-1].startswith((".", "_"))}


def fingerprint(df: DataFrame) -> str:
    """The same for tables of the same rows, in whatever order and files."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    r = df.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(2**31)))).first()
    return "-".join(str(x) for x in r)


def document(value: object) -> str:
    """UTF-8 JSON without NaN."""
    return json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True, allow_nan=False)


def _checked(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError("a generation's name has letters, digits, dots, dashes and underscores only")
    return name


def publish(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], metadata: dict, documents: dict[str, object] | None = None, csv: bool = False) -> str:
    """Write ``tables`` (parquet, or CSV with a header) and JSON ``documents`` as one generation ``name`` and make it
    current. A generation is never overwritten."""
    folder = Folder(spark, root)
    if folder.exists(_checked(name)):
        raise FileExistsError(name)
    staging = f".staging-{uuid.uuid4().hex}"
    try:
        for t, df in tables.items():
            if csv:
                df.write.csv(folder.path(staging, t), header=True)
            else:
                df.write.parquet(folder.path(staging, t))
        for d, value in (documents or {}).items():
            folder.write(document(value), staging, f"{d}.json")
        folder.write(document(metadata | {"run_id": name, "files": folder.digests(staging)}), staging, METADATA)
        folder.rename(staging, name)
    except BaseException:
        folder.remove(staging)
        raise
    folder.write(document({"generation": name}), POINTER)
    return folder.path(name)


def resolve(spark: SparkSession, root: str, name: str | None = None) -> str:
    """Folder of the current or a named generation, after its hashes were verified."""
    folder = Folder(spark, root)
    name = _checked(name or json.loads(folder.read(POINTER))["generation"])
    if folder.digests(name) != json.loads(folder.read(name, METADATA))["files"]:
        raise ValueError(f"{name}: files differ from their recorded hashes")
    return folder.path(name)


def metadata(spark: SparkSession, root: str, name: str) -> dict:
    return json.loads(Folder(spark, root).read(_checked(name), METADATA))


RUN = "run_id string, cutoff string, created_at string, season string, matchday int, model string, state string"


def catalogue(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(runs, issues): metadata of every readable generation, and those that are broken with the reason.

    ``state`` names the run's input data, the same for runs on the same rows; without it cutoff and matchday do.
    """
    folder = Folder(spark, root)
    runs, issues = [], []
    for name in folder.folders():
        if name.startswith("."):
            continue
        try:
            m = json.loads(folder.read(name, METADATA))
            if str(m["run_id"]) != name or folder.digests(name) != m["files"]:
                raise ValueError("hash mismatch")
            day = m.get("matchday")
            state = json.dumps(m["data_state"], sort_keys=True) if m.get("data_state") else f"{m.get('cutoff')}|{day}"
            runs.append((name, str(m.get("cutoff", "")), str(m.get("created_at", "")), str(m.get("season", "")), None if day is None else int(day), str(m.get("model", "")), state))
        except (OSError, ValueError, KeyError, TypeError) as e:
            issues.append((name, str(e)))
    return spark.createDataFrame(runs, RUN), spark.createDataFrame(issues, "run_id string, issue string")


def run_tables(spark: SparkSession, root: str, runs: DataFrame, table: str = "probabilities") -> DataFrame:
    """The runs' rows of ``table`` joined with their metadata by run; columns a run lacks are null. Its issues are
    checked by :func:`catalogue` before."""
    names = [r["run_id"] for r in runs.select("run_id").collect()]  # runs are published by hand
    folder = Folder(spark, root)
    out = None
    for name in names:
        if folder.exists(name, table):
            part = spark.read.parquet(folder.path(name, table)).withColumn("run_id", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return None if out is None else runs.drop("state").join(out, "run_id")


def headline(runs: DataFrame) -> DataFrame:
    """The run with the latest cutoff, then creation, of the latest season."""
    return runs.agg(F.max(F.struct("season", "cutoff", "created_at", "run_id")).alias("m")).select("m.*")


def differences(fresh: DataFrame, stored: DataFrame, key: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Rows of a replay that differ from what was stored, by key and column."""
    numbers = [f.name for f in fresh.schema if f.name not in key and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    both = fresh.select(*key, F.struct(*numbers).alias("f")).join(stored.select(*key, F.struct(*numbers).alias("s")), key, "full")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f.{c}").cast("double").alias("fresh"), F.col(f"s.{c}").cast("double").alias("stored")) for c in numbers])
    long = both.select(*key, F.inline(cells))
    near = F.abs(F.col("fresh") - F.col("stored")) <= tolerance + tolerance * F.abs("stored")
    return long.where(~F.coalesce(near | F.col("fresh").eqNullSafe(F.col("stored")), F.lit(False)))


def clean(value: object) -> object:
    """Non-finite numbers become null, at any depth."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    return value


def export_page(spark: SparkSession, payload: object, template: str, out: str, marker: str = "/*DATA*/") -> None:
    """Inject a payload as JSON into a page; text that could end a script is escaped."""
    if marker not in template:
        raise ValueError("the template has no data marker")
    text = json.dumps(clean(payload), ensure_ascii=False, separators=(",", ":"), allow_nan=False, default=str)
    text = text.replace("</", "<\\/").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    folder, name = out.rsplit("/", 1) if "/" in out else (".", out)
    Folder(spark, folder).write(template.replace(marker, text, 1), name)
