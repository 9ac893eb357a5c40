"""Generations, tampering, replay and export."""

import json

import pytest

from matchlake.plans import store


def test_publish_resolve_and_tamper(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "team string, p double")
    folder = store.publish(spark, str(tmp_path), "g1", {"t": df}, {"cutoff": "2025-01-01", "created_at": "x", "season": "2024/25"})
    assert store.resolve(spark, str(tmp_path)) == folder
    with pytest.raises(FileExistsError):
        store.publish(spark, str(tmp_path), "g1", {"t": df}, {})
    with pytest.raises(ValueError):
        store.publish(spark, str(tmp_path), "../x", {"t": df}, {})
    store.publish(spark, str(tmp_path), "g2", {"t": df}, {"cutoff": "2025-02-01", "created_at": "y", "season": "2024/25"})
    runs, issues = store.catalogue(spark, str(tmp_path))
    assert store.headline(runs).first()["run_id"] == "g2" and issues.count() == 0
    part = next((tmp_path / "g2" / "t").glob("*.parquet"))
    part.chmod(0o644)
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError):
        store.resolve(spark, str(tmp_path))
    runs, issues = store.catalogue(spark, str(tmp_path))
    assert [r["run_id"] for r in runs.collect()] == ["g1"] and [r["run_id"] for r in issues.collect()] == ["g2"]
    assert store.resolve(spark, str(tmp_path), "g1")


def test_failed_write_keeps_the_pointer(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5)], "team string, p double")
    store.publish(spark, str(tmp_path), "g1", {"t": df}, {})
    with pytest.raises(ValueError):
        store.publish(spark, str(tmp_path), "g2", {"t": df}, {"bad": float("nan")})
    assert json.loads((tmp_path / "current.json").read_text()) == {"generation": "g1"}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".staging")]


def test_differences_and_export(spark, tmp_path):
    a = spark.createDataFrame([("a", 0.5, 1), ("b", None, 2)], "team string, p double, n int")
    b = spark.createDataFrame([("a", 0.5 + 1e-9, 1), ("b", None, 2), ("c", 1.0, 3)], "team string, p double, n int")
    assert store.differences(a, a, ["team"]).count() == 0
    assert {(r["team"], r["column"]) for r in store.differences(a, b, ["team"]).collect()} == {("a", "p"), ("c", "p"), ("c", "n")}
    page = tmp_path / "p.html"
    store.export_page(spark, [{"x": "</script>\u2028", "y": float("nan")}], "<script>/*DATA*/</script>", str(page))
    text = page.read_text()
    assert "<\\/script>" in text and "NaN" not in text and text.count("</script>") == 1
    with pytest.raises(ValueError):
        store.export_page(spark, [], "none", str(page))


def test_documents_csv_and_catalogued_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5)], "team string, expected_rank double")
    store.publish(spark, str(tmp_path), "g1", {"probabilities": df, "history": df}, {"cutoff": "c", "created_at": "1", "season": "s", "matchday": 3}, {"model": {"x": 1}})
    store.publish(spark, str(tmp_path), "g2", {"probabilities": df.withColumnRenamed("expected_rank", "p_top8"), "history": df}, {"cutoff": "c", "created_at": "2", "season": "s"})
    store.publish(spark, f"{tmp_path}/csv", "g1", {"t": df}, {}, csv=True)
    assert spark.read.csv(f"{tmp_path}/csv/g1/t", header=True).collect()[0]["team"] == "a" and store.resolve(spark, f"{tmp_path}/csv")
    runs, issues = store.catalogue(spark, str(tmp_path))
    assert [r["run_id"] for r in issues.collect()] == ["csv"]  # a folder that is no run is told, not raised
    got = {r["run_id"]: (r["matchday"], r["expected_rank"], r["p_top8"]) for r in store.run_tables(spark, str(tmp_path), runs).collect()}
    assert got == {"g1": (3, 0.5, None), "g2": (None, None, 0.5)}
    assert json.loads(store.Folder(spark, str(tmp_path)).read("g1", "model.json")) == {"x": 1}
    with pytest.raises(FileNotFoundError):
        store.Folder(spark, str(tmp_path)).read("none.json")
