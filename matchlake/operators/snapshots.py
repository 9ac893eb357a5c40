"""What changed between consecutive full snapshots (problem 3).

Keys of a series get persistent ordinals: a registry of ``(series, key, ordinal)`` is kept as a table, keys it knows
keep their number and new ones are appended behind. Each snapshot then is a compressed bitmap over ordinals: only its
non-zero 64-bit words are kept, one row per ``(series, word, snapshot)``, together with the word's column vector, that is
the compared attributes of its set bits in ordinal order. ``now & ~before`` are the additions, ``before & ~now`` the
removals, and where both bits are set the aligned vectors are compared.

New keys are numbered by first snapshot, then by a hash of the key in BUCKETS, then by key; only the buckets' sizes are
summed per series, so no series, however hot, is handled by one task.

Defined results: rows with a null series, snapshot or key are ignored (they name no record); within a snapshot the row
with the largest ``version`` counts and ties are settled by the attributes' order; a series' first snapshot gives
nothing; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.util import lookup_join, materialize

#: Parts in which the new keys of a snapshot are numbered.
BUCKETS = 256


def ordinals(keys: DataFrame, registry: str | None = None) -> DataFrame:
    """(s, k, o) of distinct ``keys(s, k, first)``: numbers from 0 in each series.

    With ``registry``, a folder on a file system all executors share, numbers given before are kept and new ones appended
    there; a run that is repeated finds its own numbers again.
    """
    spark = keys.sparkSession
    held = None
    if registry is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(registry)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.parquet(registry)
    new = keys if held is None else keys.join(held.select("s", "k"), ["s", "k"], "left_anti")
    new = materialize(new.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(BUCKETS)).cast("int")), "keys")
    sizes = new.groupBy("s", "first", "b").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("first", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("s", "first", "b", before.alias("base"))
    if held is not None:
        ends = held.groupBy("s").agg((F.max("o") + 1).alias("end"))
        sizes = sizes.join(ends, "s", "left").withColumn("base", F.col("base") + F.coalesce("end", F.lit(0))).drop("end")
    inside = F.row_number().over(Window.partitionBy("s", "first", "b").orderBy("k")) - 1
    numbered = new.withColumn("i", inside).join(sizes, ["s", "first", "b"]).select("s", "k", (F.col("base") + F.col("i")).alias("o"))
    if registry is None:
        return materialize(numbered, "ordinals")
    numbered.write.mode("append").parquet(registry)
    return spark.read.parquet(registry)


def snapshot_changes(rows: DataFrame, series: str, snapshot: str, key: str, version: str, attributes: dict[str, Column], registry: str | None = None) -> DataFrame:
    """``(series, snapshot, key, change_kind)`` with kinds added, removed and changed against the previous snapshot."""
    narrow = rows.select(F.col(series).alias("s"), F.col(snapshot).alias("n"), F.col(key).alias("k"), F.col(version).alias("v"), F.struct(*[c.alias(a) for a, c in attributes.items()]).alias("a"))
    narrow = narrow.where(F.col("s").isNotNull() & F.col("n").isNotNull() & F.col("k").isNotNull())
    one = narrow.groupBy("s", "n", "k").agg(F.max(F.struct("v", "a")).alias("m")).select("s", "n", "k", F.col("m.a").alias("a"))

    numbers = ordinals(narrow.groupBy("s", "k").agg(F.min("n").alias("first")), registry)
    numbers = numbers.select("s", "k", F.floor(F.col("o") / 64).alias("w"), (F.col("o") % 64).cast("int").alias("bit"))

    order = materialize(one.select("s", "n").distinct().withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("n"))), "order")
    words = (
        one.join(numbers, ["s", "k"])
        .groupBy("s", "w", "n")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("now"), F.sort_array(F.collect_list(F.struct("bit", "k", "a"))).alias("vec"))
    )
    words = lookup_join(words, order, ["s", "n"], "inner", held=True)
    word = Window.partitionBy("s", "w").orderBy("i")
    here = words.withColumn("before", F.lag(F.struct("i", "now", "vec")).over(word)).withColumn("next_i", F.lead("i").over(word))

    fresh = F.coalesce(F.col("before.i") == F.col("i") - 1, F.lit(False))
    was = F.when(fresh, F.col("before.now")).otherwise(F.lit(0).cast("bigint"))
    old = F.when(fresh, F.col("before.vec"))
    now = F.col("now")
    added, gone, common = now.bitwiseAND(F.bitwise_not(was)), was.bitwiseAND(F.bitwise_not(now)), now.bitwiseAND(was)

    def has(bits: Column) -> Column:
        return F.col("i").isNotNull() & (bits != 0)

    def on(bits: Column, x: Column) -> Column:
        return F.getbit(bits, x["bit"]) == 1

    # Both vectors are in ordinal order; those of the common bits therefore line up.
    def common_of(v: Column) -> Column:
        return F.filter(v, lambda x: on(common, x))

    pairs = F.arrays_zip(common_of(F.col("vec")).alias("x"), common_of(old).alias("y"))
    moved = F.when(has(common), F.transform(F.filter(pairs, lambda p: ~p["x"]["a"].eqNullSafe(p["y"]["a"])), lambda p: p["x"]["k"]))
    new = F.when((F.col("i") > 1) & has(added), F.transform(F.filter(F.col("vec"), lambda x: on(added, x)), lambda x: x["k"]))
    lost = F.when(has(gone), F.transform(F.filter(old, lambda x: on(gone, x)), lambda x: x["k"]))
    within = here.select(
        "s",
        F.col("n"),
        F.explode(F.filter(F.array(F.struct(F.lit("added").alias("kind"), new.alias("ks")), F.struct(F.lit("removed").alias("kind"), lost.alias("ks")), F.struct(F.lit("changed").alias("kind"), moved.alias("ks"))), lambda x: x["ks"].isNotNull())).alias("c"),
    ).select("s", "n", F.col("c.kind").alias("kind"), F.explode("c.ks").alias("k"))

    # A word without set bits in the next snapshot has no row there: all its keys are removed.
    ended = here.where(F.col("next_i").isNull() | (F.col("next_i") > F.col("i") + 1)).select("s", (F.col("i") + 1).alias("i"), F.transform("vec", lambda x: x["k"]).alias("ks"))
    ended = lookup_join(ended, order, ["s", "i"], "inner", held=True).select("s", "n", F.lit("removed").alias("kind"), F.explode("ks").alias("k"))
    return within.unionByName(ended).select(F.col("s").alias(series), F.col("n").alias(snapshot), F.col("k").alias(key), F.col("kind").alias("change_kind"))


def fixture_changes(fixtures: DataFrame, registry: str | None = None) -> DataFrame:
    """Changes of scores and status between an edition's deliveries; case and outer blanks of status do not matter."""
    return snapshot_changes(fixtures, "edition_id", "snapshot_no", "match_id", "row_id", {"home_goals": F.col("home_goals"), "away_goals": F.col("away_goals"), "status": F.lower(F.trim("status"))}, registry)
