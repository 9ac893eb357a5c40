"""Registered match queries on small made-up tables against brute force."""

import re
import unicodedata

from matchlake.plans.match_queries import QUERIES


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_every_row_is_normalised_with_its_escapes(spark, tmp_path):
    nicknames = {"The Béars": "Union Rañel", "Owls": "Alfa"}
    homes = ["Alfa", " Alfa\u00a0 Town ", r"Union Ra\u00f1el", r"The B\u00E9ars", r"\u004fwls", r"a\u00e9\u00f1", r"half \u00e", "Jose\u0301", "Owls", "", None]
    d = write(spark, tmp_path, history=(list(enumerate(homes)), "row_id bigint, home string"), teams=([(i, n, k) for i, (k, n) in enumerate(nicknames.items())] + [(9, "Beta", None)], "team_id bigint, name string, nickname string"))

    def brute(x):
        if x is None:
            return None
        x = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), x)
        x = unicodedata.normalize("NFC", " ".join(x.split()))
        return nicknames.get(x, x)

    got = {r["row_id"]: r["home"] for r in QUERIES["alias_normalize"](spark, d).collect()}
    assert got == {i: brute(x) for i, x in enumerate(homes)}


def test_published_places_are_drawn_often_enough(spark, data):
    got = {r["team"]: r for r in QUERIES["league_monte_carlo_full"](spark, data).collect()}
    few = {r["team"]: r for r in QUERIES["league_monte_carlo"](spark, data).collect()}
    assert len(got) == 36 and abs(sum(r["p_top8"] for r in got.values()) - 8) < 1e-4
    assert all(abs(r["p_top8"] * 20_000 - round(r["p_top8"] * 20_000)) < 0.05 for r in got.values())
    assert any(abs(r["p_top8"] * 200 - round(r["p_top8"] * 200)) > 0.05 for r in got.values())
    assert all(abs(got[t]["p_top8"] - r["p_top8"]) < 5 * (0.25 / 200) ** 0.5 for t, r in few.items())


def test_every_pair_gets_rates(spark, data):
    from matchlake.plans.match_queries import _unique

    pairs = {(r["home"], r["away"]) for r in _unique(spark, data).select("home", "away").collect()}
    got = {(r["home"], r["away"]): r["lh"] for r in QUERIES["pair_rates_all"](spark, data).collect()}
    ucl = {(r["home"], r["away"]): r["lh"] for r in QUERIES["pair_rates"](spark, data).collect()}
    assert set(got) == pairs and len(ucl) < len(got) and all(got[k] == v for k, v in ucl.items())
    assert QUERIES["grid_outcomes_all"](spark, data).count() == len(pairs)


def test_cells_of_a_mixture_are_not_shuffled(spark, data):
    plan = QUERIES["ensemble_mixture_all"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "Aggregate" not in above and "Join" not in above
