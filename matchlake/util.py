"""Small helpers shared by every operator: table access, bounded broadcasts, salted joins, materialisation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast after its size was counted.
BROADCAST_ROWS = 20_000
#: Replicas of the unique side in a salted join; a key with a third of all rows then spreads over as many tasks.
SALTS = 8

_own_dirs: dict[str, str] = {}
_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where none is set."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        _own_dirs[app] = tempfile.mkdtemp(prefix="matchlake-")
    return "file://" + _own_dirs[app]


def scratch(spark: SparkSession) -> str:
    """The application's own folder under the shared one; :func:`release` and the end of the driver remove it."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark)}/matchlake-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(release, spark)
    return _scratch[app]


def release(spark: SparkSession) -> None:
    """Removes what the application materialised; results that still read it must have been written before."""
    context = spark.sparkContext
    if context._jsc is None or context.applicationId not in _scratch:
        return
    path = context._jvm.org.apache.hadoop.fs.Path(_scratch.pop(context.applicationId))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it again.

    Cuts the lineage with files every executor can read, so losing an executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def materialize_apart(parts: list[DataFrame], label: str = "step") -> DataFrame:
    """The union of ``parts``, each of one task, materialised with a task for each.

    A union of single partitions is else one partition itself, and its one task would do the parts one after another.
    """
    spark, name = parts[0].sparkSession, "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        return materialize(reduce(DataFrame.unionByName, parts), label)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def lookup_join(big: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS, salts: int = SALTS, held: bool = False) -> DataFrame:
    """Join ``lookup`` (unique on ``on``) to ``big``: broadcast when its counted size is within ``limit``, else salted.

    ``lookup`` is materialised first, so that counting it does not compute it twice, unless it is ``held`` already.
    """
    if not held:
        lookup = materialize(lookup, "lookup")
    if small(lookup, limit):
        return big.join(F.broadcast(lookup), on, how)
    return salted_join(big, lookup, on, how, salts)


def salted_join(big: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join where a key of ``big`` may hold a third of its rows.

    ``lookup`` is replicated ``salts`` times; rows of ``big`` choose a replica by a hash of the whole row, so equal
    rows stay deterministic under task retries. The planner takes the replicated side for as small as its files are
    and would broadcast it; both sides are sorted and merged instead.
    """
    salt = "__salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(_q(c)) for c in big.columns if not _map_like(big, c)]), F.lit(salts)).cast("int"))
    right = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [*on, salt], how).drop(salt)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _map_like(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant", "void")


def ntz_from_unix(seconds: Column) -> Column:
    """TIMESTAMP_NTZ of UTC seconds, whatever the session's zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def stored_form(ntz: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of a TIMESTAMP_NTZ without parts of a second."""
    return F.concat(F.translate(F.substring(ntz.cast("string"), 1, 19), " ", "T"), F.lit("Z"))
