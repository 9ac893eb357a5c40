"""Folders of intermediate tables."""

from pathlib import Path

from pyspark.sql import functions as F

from matchlake import util


def test_materialised_tables_are_removed_on_release(spark):
    df = util.materialize(spark.range(5).toDF("x"), "t")
    folder = Path(util.scratch(spark).removeprefix("file://"))
    assert df.count() == 5 and any(folder.iterdir())
    util.release(spark)
    assert not folder.exists()
    assert util.materialize(spark.range(3).toDF("x"), "t").count() == 3
    util.release(spark)


def test_salted_and_broadcast_lookups_agree(spark):
    big = spark.createDataFrame([(i % 3 if i % 4 else None, i) for i in range(200)], "k int, v int")
    lookup = spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    one, two = (sorted(map(str, util.lookup_join(big, lookup, ["k"], limit=n).collect())) for n in (10, 0))
    assert one == two and len(one) == 200


def test_replicas_of_a_lookup_are_never_broadcast_by_estimate(spark, tmp_path):
    path = str(tmp_path / "lookup")
    spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v")).write.parquet(path)
    big = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    for how, rows in (("left", 3000), ("inner", 1000)):
        got = util.salted_join(big, spark.read.parquet(path), ["k"], how)
        assert got.count() == rows and got.where("v is not null").count() == 1000
        got.collect()
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_single_tasks_of_a_union_run_apart(spark):
    base = util.materialize(spark.range(100), "base")
    parts = [base.where(f"id >= {i}").coalesce(1).mapInArrow(lambda batches: batches, "id bigint") for i in range(3)]
    got = util.materialize_apart(parts)
    assert len(got.inputFiles()) == 3 and got.count() == 297 and spark.conf.get("spark.sql.unionOutputPartitioning", None) is None
