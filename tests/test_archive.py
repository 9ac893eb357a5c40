"""Landed files and the union of sources that may fail."""

from datetime import UTC, datetime

import pytest

from matchlake.sources import archive

NOW = datetime(2026, 9, 20, 12, tzinfo=UTC)


def test_landing_is_by_content_and_falls_back_on_the_same_day_only(spark, tmp_path):
    root = str(tmp_path / "raw")
    one = archive.land(spark, root, "a.txt", b"x", "http://u", "tag", NOW)
    assert archive.land(spark, root, "b.txt", b"x", "http://v", at=NOW) == one
    assert {p.name for p in (tmp_path / "raw/objects").iterdir() if not p.name.startswith(".")} == {one}
    got = {r["url"]: (r["sha256"], r["bytes"], r["etag"]) for r in archive.provenance(spark, root).collect()}
    assert got == {"http://u": (one, 1, "tag"), "http://v": (one, 1, None)}
    assert archive.altered(spark, root).count() == 0

    def broken():
        raise OSError("no network")

    assert archive.current(spark, root, "a.txt", "http://u", broken, NOW)[1]
    assert archive.current(spark, root, "a.txt", "http://u", lambda: b"y", NOW) == (f"{root}/latest/a.txt", None)
    for url, now in (("http://other", NOW), ("http://u", NOW.replace(day=21))):
        with pytest.raises(OSError):
            archive.current(spark, root, "a.txt", url, broken, now)


def test_sources_fail_by_themselves(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("\ufeffDate,HomeTeam,AwayTeam,FTHG,FTAG,HS\n13/08/2024,A,B\u00e9,2,1,7\n14/08/2024,C,A,,,\n".encode())
    (tmp_path / "l.csv").write_bytes("Date,Home,Away,HG,AG\n15/08/24,\u00c9,C,0,0\n".encode("latin-1"))
    (tmp_path / "r.txt").write_text("Tue Sep 17\nA (ESP) v C (ENG) 3-1\n")
    (tmp_path / "empty.txt").write_text("nothing here")
    table = {"kind": "table", "competition": "L"}
    sources = [table | {"path": f"{tmp_path}/t.csv", "source": "t"}, table | {"path": f"{tmp_path}/l.csv", "source": "l"}, {"kind": "text", "path": f"{tmp_path}/r.txt", "source": "r", "competition": "UCL", "start_year": 2024}, {"kind": "text", "path": f"{tmp_path}/empty.txt", "source": "e", "competition": "UCL", "start_year": 2024}, table | {"path": f"{tmp_path}/none.csv", "source": "n"}, {"kind": "?", "source": "k"}]
    aliases = spark.createDataFrame([("\u00c9", "Eagles")], "alias string, name string")
    history, report = archive.history_of(spark, sources, "2024-08-01", "2025-01-01", aliases)
    assert {(r["home"], r["away"], r["home_goals"], r["home_shots"], r["source"]) for r in history.collect()} == {("A", "B\u00e9", 2, 7.0, "t"), ("Eagles", "C", 0, None, "l"), ("A", "C", 3, None, "r")}
    assert {r["source"]: (r["rows"], r["error"] is None) for r in report.collect()} == {"t": (1, True), "l": (1, True), "r": (1, True), "e": (0, False), "n": (0, False), "k": (0, False)}
    teams = spark.createDataFrame([("A",), ("Eagles",), ("Zebras",)], "team string")
    assert {r["team"]: (r["matches"], r["connected"]) for r in archive.reach(history, teams).collect()} == {"A": (2, True), "Eagles": (1, True), "Zebras": (0, False)}
    with pytest.raises(ValueError):
        archive.reach(history, teams, "UEL")
    with pytest.raises(ValueError):
        archive.history_of(spark, sources[3:], "2024-08-01", "2025-01-01", aliases)


def test_csv_under_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("team,p\n007,0.5\n")
    assert archive.csv_table(spark, f"{tmp_path}/a.csv", "team string, p double").collect() == [("007", 0.5)]
    (tmp_path / "b.csv").write_text("team,p\nx,y\n")
    with pytest.raises(Exception):
        archive.csv_table(spark, f"{tmp_path}/b.csv", "team string, p double").collect()
