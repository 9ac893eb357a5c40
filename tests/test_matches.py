"""Models, simulation, parsers and streaming: invariants and small worked cases."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchlake.functions import dist, grids
from matchlake.operators import bracket_state, evaluate, fit, models, ratings, simulate
from matchlake.operators import matches as M
from matchlake.sources import parsers
from matchlake.streaming import live

CUT = "2025-01-01 00:00:00"


def history(spark, n=400, seed=1, teams=8):
    rng = np.random.default_rng(seed)
    s = np.linspace(0.6, -0.6, teams)
    rows = []
    for i in range(n):
        h, a = rng.choice(teams, 2, replace=False)
        rows.append((i, f"2024-{1 + i * 11 // n:02d}-{1 + i % 28:02d}T15:00:00Z", f"t{h}", f"t{a}", int(rng.poisson(np.exp(0.35 + s[h] - s[a]))), int(rng.poisson(np.exp(0.1 + s[a] - s[h]))), "UCL" if i % 4 == 0 else f"L{h % 2}", "src", None, None))
    return spark.createDataFrame(rows, "row_id bigint, date string, home string, away string, home_goals int, away_goals int, competition string, source string, home_shots double, completed_at timestamp_ntz")


def test_grid_outcomes_agree_with_full_tails(spark):
    rates = spark.createDataFrame([(1, 1.4, 1.1), (2, 0.2, 3.0)], "k int, h double, a double")
    cells = dist.grid(rates, "h", "a")
    assert cells.groupBy("k").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-12").count() == 0
    grid = {r["k"]: r for r in dist.grid_outcomes(cells, ["k"]).collect()}
    full = {r["k"]: r["s"] for r in rates.select("k", dist.skellam(F.col("h"), F.col("a")).alias("s")).collect()}
    for k in (1, 2):
        assert abs(grid[k]["p_home"] - full[k]["p_home"]) < 1e-5
    extreme = rates.limit(1).select(dist.skellam(F.lit(100.0), F.lit(100.0)).alias("s")).first()["s"]
    assert extreme["p_home"] == pytest.approx(extreme["p_away"], abs=1e-9) and sum(extreme) == pytest.approx(1)
    low = dist.corrected_grid(rates, ["k"], "h", "a", 0.05)
    assert low.groupBy("k").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-12").count() == 0
    tempered = dist.calibrated_grid(cells, ["k"], 0.2, (0.1, 0.0))
    assert tempered.groupBy("k").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-12").count() == 0


def test_blocks_of_grids_agree_with_expressions(spark):
    rates = spark.createDataFrame([(1, 1.4, 1.1), (2, 0.2, 3.0), (3, 20.0, 0.01)], "k int, h double, a double")
    h, a = np.array([1.4, 0.2, 20.0]), np.array([1.1, 3.0, 0.01])
    for rho in (0.0, 0.04):
        long = (dist.corrected_grid(rates, ["k"], "h", "a", rho) if rho else dist.grid(rates, "h", "a")).orderBy("k", "hg", "ag").toPandas()["p"].to_numpy().reshape(3, 13, 13)
        assert np.allclose(grids.grid(h, a, rho), long, atol=1e-12) and not grids.bad(grids.grid(h, a, rho)).any()
    tempered = dist.calibrated_grid(dist.grid(rates, "h", "a"), ["k"], 0.2, (0.1, 0.0)).orderBy("k", "hg", "ag").toPandas()["p"].to_numpy().reshape(3, 13, 13)
    assert np.allclose(grids.tempered(grids.grid(h, a), 0.2, (0.1, 0.0)), tempered, atol=1e-9)
    with pytest.raises(ValueError):
        grids.grid(np.array([5.0]), np.array([5.0]), 0.2)


def test_poisson_fit_recovers_strengths_and_ignores_the_future(spark):
    h = history(spark, 1200)
    rows = M.valid_matches(h)
    model = fit.fit_poisson(rows, CUT)
    assert model.converged and model.attack["t0"] > model.attack["t7"] and model.defence["t0"] > model.defence["t7"]
    future = h.limit(50).withColumn("date", F.lit("2025-06-01T00:00:00Z")).withColumn("home_goals", F.lit(9))
    again = fit.fit_poisson(M.valid_matches(h.unionByName(future)), CUT)
    assert again.attack == pytest.approx(model.attack, abs=1e-9)
    assert models.from_json(model.to_json()) == model
    assert not fit.fit_poisson(rows, CUT, max_iter=1).converged
    assert fit.fit_poisson(rows.limit(0), CUT).model_type == "prior_only"
    with pytest.raises(ValueError):
        models.from_json(model.to_json().replace('"schema_version": 1', '"schema_version": 2'))
    with pytest.raises(ValueError):
        fit.fit_poisson(rows, CUT, shot_blend=2.0)
    base = M.baseline_rates(rows, CUT).first()
    assert fit.fit_baseline(rows, CUT).intercept == pytest.approx(base["intercept"]) and fit.fit_baseline(rows, CUT).advantage == pytest.approx(base["advantage"])


def test_poisson_fit_is_the_minimum_of_its_objective(spark):
    """Every parameter moved alone raises the penalised likelihood of the matches themselves."""
    rows = M.valid_matches(history(spark, 300, teams=5))
    model = fit.fit_poisson(rows, CUT)
    leagues = {r["team"]: r["league"] for r in M.modal_league(rows).collect()}
    games = [r for r in rows.withColumn("w", M.decay_weight(M.age_days(CUT), 365.0)).collect()]
    rates = {(r["home"], r["away"]): (r["home_rate"], r["away_rate"]) for r in model.rates(rows.select("home", "away").distinct()).collect()}
    residual = {}
    for g in games:
        lh, la = rates[g["home"], g["away"]]
        residual[g["home"]] = residual.get(g["home"], 0) + g["w"] * (lh - g["home_goals"])
        residual[g["away"]] = residual.get(g["away"], 0) + g["w"] * (la - g["away_goals"])
    # The attack of a team is a league effect and a deviation: 5 times the deviation balances its residual.
    for league in set(leagues.values()):
        own = [t for t in residual if leagues[t] == league]
        effect = -sum(residual[t] for t in own) / 0.5
        for t in own:
            assert model.attack[t] == pytest.approx(effect - residual[t] / 5.0, abs=1e-5)


def test_fits_bring_teams_and_not_pairs_to_the_driver(spark, monkeypatch):
    rows = M.valid_matches(history(spark, 1500, teams=30))
    frame, got = type(rows), []
    for name, size in (("toPandas", len), ("collect", len), ("toArrow", lambda t: t.num_rows)):
        plain = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, plain=plain, size=size: got.append(size(out := plain(self))) or out)
    model = fit.fit_poisson(rows, CUT)
    assert model.converged and len(model.attack) == 30 and max(got) <= 60 < rows.select("home", "away").distinct().count()


def test_models_leave_their_teams_in_tables(spark, monkeypatch):
    """Strengths, coverage, rates and grids of fitted models neither bring teams to the driver nor ship them with tasks."""
    rows = M.valid_matches(history(spark, 1500, teams=30))
    pairs = spark.createDataFrame([("t0", "t7"), ("new", "t1")], "home string, away string")
    frame, session, got = type(rows), type(spark), []
    for name, size in (("toPandas", len), ("collect", len), ("toArrow", lambda t: t.num_rows)):
        plain = getattr(frame, name)
        monkeypatch.setattr(frame, name, lambda self, plain=plain, size=size: got.append(size(out := plain(self))) or out)
    made = session.createDataFrame
    monkeypatch.setattr(session, "createDataFrame", lambda self, data, *args, **named: got.append(len(data)) or made(self, data, *args, **named))
    goal, low = fit.fit_poisson(rows, CUT), fit.fit_low_score(rows, CUT)
    assert goal.strengths(spark).count() == 30 and goal.coverage_warnings(pairs).count() == 1
    assert models.Mixture(goal, low, 0.3).grids(pairs).where("abs(aggregate(grid, 0D, (a, x) -> a + x) - 1) < 1e-9").count() == 2
    assert max(got) < 30 and not low.bare().ratings and not low.bare().base.attack
    ratings, offset = dict(low.ratings), lambda t: low.offsets.get(low.leagues.get(t), 0.0)
    base = {r["home"]: r["home_rate"] for r in low.base.rates(pairs).collect()}
    moved = {r["home"]: r["home_rate"] for r in low.rates(pairs).collect()}
    assert moved["t0"] == pytest.approx(base["t0"] * np.exp(low.elo * (ratings["t0"] - ratings["t7"]) + low.league * (offset("t0") - offset("t7"))))
    assert models.from_json(low.to_json()) == low


def test_models_nest_and_give_grids(spark):
    rows = M.valid_matches(history(spark, 800))
    goal, low = fit.fit_poisson(rows, CUT), fit.fit_low_score(rows, CUT)
    assert -0.2 <= low.rho <= 0.2 and set(low.ratings) == {f"t{i}" for i in range(8)} and low.ratings["t0"] > low.ratings["t7"]
    nested = models.Calibrated(models.Mixture(goal, low, 0.3), 0.1, 0.05, -0.02)
    assert models.from_json(nested.to_json()) == nested
    pairs = spark.createDataFrame([("t0", "t7", False), ("t7", "t0", True), ("new", "t1", False)], "home string, away string, neutral boolean")
    for model in (goal, low, models.Mixture(goal, low, 0.3), nested):
        got = model.grids(pairs)
        assert got.count() == 3 and all(abs(sum(r["grid"]) - 1) < 1e-9 and min(r["grid"]) >= 0 for r in got.collect())
        p = {r["home"]: r for r in model.outcomes(pairs).collect()}
        assert p["t0"]["p_home"] > 0.5 and all(abs(r["p_home"] + r["p_draw"] + r["p_away"] - 1) < 1e-9 for r in p.values())
    one, two = ({r["home"]: r["home_rate"] for r in m.rates(pairs).collect()} for m in (goal, low))
    assert {r["home"]: r["home_rate"] for r in nested.rates(pairs).collect()} == pytest.approx({k: 0.3 * one[k] + 0.7 * two[k] for k in one})
    assert {(r["team"], r["issue"]) for r in goal.coverage_warnings(pairs).collect()} == {("new", "unknown")}
    drawn = goal.sampled(pairs.limit(1), 4000, 1).agg(F.avg("hg"), F.count("*")).first()
    assert drawn[1] == 4000 and drawn[0] == pytest.approx(one["t0"], abs=0.12)
    for bad in ('"weight": 0.3', '"model_type": "mixture"', '"rho"'):
        with pytest.raises((ValueError, TypeError, KeyError)):
            models.from_json(nested.to_json().replace(bad, bad.replace("0.3", "1.3").replace("mixture", "x").replace("rho", "r")))


def test_low_score_terms_are_a_minimum():
    rng = np.random.default_rng(2)
    n = 4000
    e, l = rng.normal(0, 100, n), rng.normal(0, 30, n)
    lh, la = np.exp(0.2 + 0.002 * e), np.exp(0.1 - 0.002 * e)
    hg, ag = rng.poisson(lh), rng.poisson(la)
    keep = ~(((hg == 0) & (ag == 0)) | ((hg == 1) & (ag == 1))) | (rng.random(n) < 0.9)
    games = pd.DataFrame({"lh": np.exp(0.2), "la": np.exp(0.1), "e": e, "l": l, "hg": hg, "ag": ag, "w": 1.0})[keep]
    x, ok = fit.low_score_terms(games, 8.0, (0.01, 0.01, 0.2))
    assert ok and x[0] == pytest.approx(0.002, abs=3e-4) and abs(x[1]) < 1e-3 and x[2] > 0

    def loss(v):
        move = v[0] * games["e"] + v[1] * games["l"]
        a, b = games["lh"] * np.exp(move), games["la"] * np.exp(-move)
        h, g = games["hg"], games["ag"]
        c = np.where((h == 0) & (g == 0), 1 - a * b * v[2], np.where((h == 0) & (g == 1), 1 + a * v[2], np.where((h == 1) & (g == 0), 1 + b * v[2], np.where((h == 1) & (g == 1), 1 - v[2], 1))))
        return float(-np.sum(h * np.log(a) - a + g * np.log(b) - b + np.log(c)) + 8 * np.sum(np.square(v)))

    for i, step in enumerate((1e-5, 1e-5, 1e-3)):
        for s in (-step, step):
            assert loss(x + s * np.eye(3)[i]) >= loss(x) - 1e-6


def test_calibrator_lowers_loss(spark):
    rows = [(0.94, 0.03, 0.03, *g) for g in [(1, 0)] * 54 + [(0, 0)] * 18 + [(0, 1)] * 18]
    f = spark.createDataFrame(rows, "p_home double, p_draw double, p_away double, home_goals int, away_goals int")
    t, a, b = fit.fit_calibrator(f)
    assert t > 0
    p = dist.tempered([F.col("p_home"), F.col("p_draw"), F.col("p_away")], t, (a, b))
    after = evaluate.outcome_metrics(f.withColumns(dict(zip(["p_home", "p_draw", "p_away"], p, strict=True))), []).first()
    assert after["log_loss"] < evaluate.outcome_metrics(f, []).first()["log_loss"]
    assert fit.fit_calibrator(f.where("home_goals > away_goals")) is None


def brute_ratings(games, cutoff):
    """Match by match, straight from the rules, with every state in a dictionary."""
    cross = {"UCL", "UEL", "UECL"}
    rating, league, offset, seen, abroad, out = {}, {}, {}, {}, {}, {}
    for date in sorted({g["date"] for g in games}):
        same = [g for g in games if g["date"] == date]
        recency = 2 ** (-(cutoff - date).total_seconds() / 86400 / 365)
        moves, pulls, homes = {}, {}, {}
        for g in sorted(same, key=lambda g: (g["competition"], g["home"], g["away"])):
            h, a, c = g["home"], g["away"], g["competition"]
            far = c in cross
            lh, la = (league.get(h), league.get(a)) if far else (c, c)
            weight = lambda t: 0.45 + 0.55 * abroad.get(t, 0) / (abroad.get(t, 0) + 8) if far else 1
            rh, ra = ((rating.get(t, 1500) - 1500) * weight(t) for t in (h, a))
            oh, oa = offset.get(lh, 0), offset.get(la, 0)
            expected = 1 / (1 + 10 ** (-(rh + oh + 55 - ra - oa) / 400))
            out[g["row_id"]] = (1500 + rh, 1500 + ra, lh, la, oh, oa, expected)
            gap = abs(g["home_goals"] - g["away_goals"])
            surprise = (1 if g["home_goals"] > g["away_goals"] else 0.5 if gap == 0 else 0) - expected
            delta = 24 * recency * (1 if gap < 2 else 1.5 if gap == 2 else (11 + gap) / 8) * surprise
            moves.setdefault(h, []).append(delta)
            moves.setdefault(a, []).append(-delta)
            if far and lh and la and lh != la:
                pulls.setdefault(lh, []).append((8 * recency * surprise, h))
                pulls.setdefault(la, []).append((-8 * recency * surprise, a))
            elif not far:
                homes[h] = homes[a] = c
        for t, d in moves.items():
            rating[t] = rating.get(t, 1500) + sum(d)
        for c in {g["competition"] for g in same} - cross - offset.keys():
            offset[c] = {"E0": 55.0, "N1": 14.0}.get(c, 0.0)
        for c, d in pulls.items():
            offset[c] = offset[c] + sum(x for x, _ in d)
            seen[c] = seen.get(c, 0) + recency * len(d)
            for _, t in d:
                abroad[t] = abroad.get(t, 0) + recency
        league.update(homes)
        if sum(seen.values()):
            mean = sum(offset[c] * seen.get(c, 0) for c in offset) / sum(seen.values())
            offset = {c: v - mean for c, v in offset.items()}
    return out, rating, offset, league, abroad


def rated_games(spark, n=250):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        h, a = rng.choice(9, 2, replace=False)
        comp = "UCL" if i % 3 == 0 else ("E0", "N1", "X")[h % 3]
        rows.append((i, datetime(2023, 1, 1) + timedelta(days=int(i // 2)), f"t{h}", f"t{a}", int(rng.integers(0, 5)), int(rng.integers(0, 5)), comp))
    return spark.createDataFrame(rows, "row_id bigint, date timestamp_ntz, home string, away string, home_goals int, away_goals int, competition string")


def test_ratings_follow_their_rules(spark):
    games = rated_games(spark)
    cut = "2023-04-20 00:00:00"
    matches, teams, leagues = ratings.replay_tables(games, [cut, "2023-02-01 00:00:00"])
    known = [r.asDict() for r in games.where(F.col("date") < F.lit(cut).cast("timestamp_ntz")).collect()]
    out, rating, offset, league, abroad = brute_ratings(known, datetime(2023, 4, 20))
    got = {r["row_id"]: r for r in matches.where(F.col("cutoff") == cut).collect()}
    assert set(got) == set(out) and len(out) > 150
    for i, (rh, ra, lh, la, oh, oa, e) in out.items():
        r = got[i]
        assert (r["home_league"], r["away_league"]) == (lh, la)
        assert [r["home_rating"], r["away_rating"], r["home_offset"], r["away_offset"], r["expected"]] == pytest.approx([rh, ra, oh, oa, e], abs=1e-6)
    trust = lambda t: 0.45 + 0.55 * abroad.get(t, 0) / (abroad.get(t, 0) + 8)
    assert {r["name"]: r["rating"] for r in teams.where(F.col("cutoff") == cut).collect()} == pytest.approx({t: 1500 + (v - 1500) * trust(t) for t, v in rating.items()}, abs=1e-6)
    assert {r["name"]: r["league"] for r in teams.where(F.col("cutoff") == cut).collect() if r["league"]} == league
    assert {r["name"]: r["offset"] for r in leagues.where(F.col("cutoff") == cut).collect()} == pytest.approx(offset, abs=1e-6)


def test_ratings_read_only_the_past(spark):
    games = rated_games(spark)
    cut, change = "2023-04-20 00:00:00", "2023-03-01 00:00:00"
    later = F.col("date") >= F.lit(change).cast("timestamp_ntz")
    other = games.withColumns({"competition": F.when(later, "N1").otherwise(F.col("competition")), "home_goals": F.when(later, 9).otherwise(F.col("home_goals"))})
    one, two = ({r["row_id"]: tuple(r)[5:12] for r in ratings.replay(g.orderBy(F.rand(3)), [cut]).where(F.col("date") < F.lit(change).cast("timestamp_ntz")).collect()} for g in (games, other))
    assert one.keys() == two.keys() and len(one) > 100
    assert all(x[2:4] == two[k][2:4] and [*x[:2], *x[4:]] == pytest.approx([*two[k][:2], *two[k][4:]], abs=1e-9) for k, x in one.items())
    with pytest.raises(ValueError):
        ratings.RatingConfig(k=-1).validate()
    assert ratings.replay(games.limit(0), [cut]).count() == 0
    for column, bad in (("home_goals", F.lit(None).cast("int")), ("away_goals", F.lit(-1)), ("home", F.lit(" ")), ("away", F.col("home"))):
        with pytest.raises(Exception, match="complete matches"):
            ratings.replay(games.withColumn(column, F.when(F.col("row_id") == 5, bad).otherwise(F.col(column))), [cut]).count()


def test_a_replay_never_holds_its_matches_as_one_frame(spark, monkeypatch):
    frame = []
    plain = ratings._checked
    monkeypatch.setattr(ratings, "BATCH", 100)
    monkeypatch.setattr(ratings, "_checked", lambda pdf: frame.append(len(pdf)) or plain(pdf))
    games = rated_games(spark, 1000).toArrow()
    out = list(ratings._folding("2025-01-01 00:00:00", ratings.RatingConfig())(iter(games.to_batches(max_chunksize=50))))
    kinds = [b["kind"][0].as_py() for b in out]
    assert max(frame) == 50 and kinds.count("match") == 10 and max(b.num_rows for b in out) == 100
    got = ratings.replay(rated_games(spark, 1000), ["2025-01-01 00:00:00"]).toPandas().sort_values("row_id")
    rows = pd.concat([b.to_pandas() for b, k in zip(out, kinds, strict=True) if k == "match"]).sort_values("row_id")
    assert len(got) == 1000 and np.array_equal(got["expected"], rows["expected"]) and got["home"].tolist() == rows["home"].tolist()


def season(known=None):
    n = 36
    home, away = zip(*[(i, 18 + (i + d) % 18) if d % 2 == 0 else (18 + (i + d) % 18, i) for d in range(8) for i in range(18)], strict=True)
    s = np.linspace(0.4, -0.4, n)
    gap = s[:, None] - s[None, :]
    rates = np.stack([np.stack([np.exp(0.3 + gap), np.exp(0.1 - gap)], 2)] * 2)
    none = np.full(144, -1)
    return simulate.Season([f"T{i:02d}" for i in range(n)], np.array(home), np.array(away), none, none.copy(), rates, known=known or {})


def test_simulation_conserves_places_and_is_partition_free(spark):
    got = simulate.simulate(spark, season(), 600, 3, block=100)
    sums = got.agg(*[F.sum(f"p_{e}") for e in simulate.EVENTS], F.sum("expected_rank")).first()
    assert [round(x, 6) for x in sums] == [8, 16, 8, 8, 12, 16, 8, 4, 2, 1, 666]
    a = {r["team"]: r["p_champion"] for r in got.collect()}
    spark2 = simulate.simulate(spark, season(), 600, 3, block=100).repartition(7).collect()
    assert a == {r["team"]: r["p_champion"] for r in spark2}
    assert got.where("p_champion > p_final or abs(p_top8 + p_playoff + p_eliminated - 1) > 1e-9").count() == 0


def finished():
    s = season()
    rng = np.random.default_rng(1)
    s.home_goals, s.away_goals = rng.integers(0, 4, 144), rng.integers(0, 4, 144)
    keys = [-k[0] for k in simulate.nine_keys(s, s.home_goals[None], s.away_goals[None])]
    return s, [s.teams[i] for i in np.lexsort((np.arange(36), *reversed(keys)))]


def drawn_state(order, **ties):
    drawn = {key: [order[p[i] - 1] for i in (0, 1) for p in pairs] for key, (_, pairs) in bracket_state.SLOTS.items()}
    return {"source": "s", "as_of": "2027-03-01T00:00:00Z", "league_order": order, "ties": ties} | drawn


def leg(h, a, at="2027-02-20T22:00:00Z"):
    return {"home_goals": h, "away_goals": a, "completed_at": at}


def test_observed_scores_and_official_state_are_kept(spark):
    s = season()
    s.home_goals, s.away_goals = np.zeros(144, int), np.zeros(144, int)
    got = {r["team"]: r["expected_points"] for r in simulate.simulate(spark, s, 50, 1).collect()}
    assert set(got.values()) == {8.0}
    s, order = finished()
    state = drawn_state(order)
    state["ties"] = {f"po-{i}": {"legs": [leg(0, 1), leg(0, 0)], "winner": state["playoff_seeded"][i]} for i in range(8)}
    got = simulate.simulate(spark, bracket_state.applied(s, state), 64, 1).collect()
    assert {r["team"] for r in got if r["p_round16"] == 1} == set(state["playoff_seeded"]) | set(order[:8]) and got[0]["tie_groups"] == 0


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s.pop("source"),
        lambda s: s.update(as_of="2028-01-01T00:00:00Z"),
        lambda s: s["league_order"].reverse(),
        lambda s: s["league_order"].pop(),
        lambda s: s["playoff_seeded"].reverse(),
        lambda s: s["ties"].update({"po-9": {}}),
        lambda s: s["ties"].update({"po-0": {"legs": [leg(1, 0), leg(1, 0)]}}),
        lambda s: s["ties"].update({"po-0": {"legs": [leg(1, 0)], "winner": "T00"}}),
        lambda s: s["ties"].update({"po-0": {"legs": [leg(1.5, 0)]}}),
        lambda s: s["ties"].update({"po-0": {"legs": [leg(1, 0, "2027-02-20")]}}),
        lambda s: s["ties"].update({"po-0": {"legs": [leg(1, 0, "2027-03-20T00:00:00Z")]}}),
        lambda s: s["ties"].update({"r16-0": {"legs": [leg(1, 0)]}}),
        lambda s: s["ties"].update({"final-0": {"legs": [leg(1, 0), leg(1, 0)]}}),
    ],
)
def test_states_that_cannot_be_true_raise(change):
    s, order = finished()
    state = drawn_state(order)
    change(state)
    with pytest.raises(ValueError):
        bracket_state.applied(s, state, "2027-04-01T00:00:00Z")


def test_a_winner_that_contradicts_the_score_raises(spark):
    s, order = finished()
    state = drawn_state(order)
    state["ties"] = {"po-0": {"legs": [leg(0, 1), leg(0, 0)], "winner": state["playoff_unseeded"][0]}}
    with pytest.raises(Exception, match="contradicts"):
        simulate.simulate(spark, bracket_state.applied(s, state), 8, 1).collect()


def test_seasons_and_arguments_are_checked(spark):
    for name, value in (("home_goals", np.where(np.arange(144) == 0, 1, -1)), ("rates", np.full((2, 36, 36, 2), -1.0)), ("teams", ["x"] * 36), ("order", list(range(36)))):
        s = season()
        setattr(s, name, value)
        with pytest.raises(ValueError):
            s.check()
    s = season()
    s.home, s.away = s.away.copy(), s.home.copy()
    s.home[0], s.away[0] = s.away[0], s.home[0]
    with pytest.raises(ValueError):
        s.check()
    for bad in ({"simulations": 0}, {"simulations": True}, {"seed": -1}, {"block": 0}):
        with pytest.raises(ValueError):
            simulate.simulate(spark, season(), **({"simulations": 10, "seed": 1} | bad))


def test_league_draws_come_from_the_grid(spark):
    s = season()
    s.grids = np.zeros((36, 36, 169))
    s.grids[..., 3 * 13 + 1] = 1.0  # every home side wins 3-1
    got = simulate.simulate(spark, s, 40, 1)
    assert {r["expected_points"] for r in got.collect()} == {12.0}
    said = simulate.diagnostics(s, got, 40, 1)
    assert said["score_sampling"] == "grids" and said["tied_simulations"] == 40 and said["warnings"]
    s.grids[0, 1] = 0.5
    with pytest.raises(ValueError):
        s.check()


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text.split("\n"), 1)], "file string, line_no int, line string")


def test_schedule_text(spark):
    text = "Matchday 1\n<p>Tuesday 8 September 2026</p>\nAEK Athens 1-0 LASK\nnoise\nLens vs Sporting CP (18:45)\nHighlights: A vs B\nX vs Y\n(20:15)\nMatchday 2\nWednesday 9 September 2026\nA vs B"
    got = [(r["matchday"], r["home"], r["away"], r["date"], r["home_goals"], r["status"]) for r in parsers.schedule(lines(spark, text)).orderBy("matchday", "home").collect()]
    assert got == [
        (1, "AEK Athens", "LASK", "2026-09-08T20:00:00Z", 1, "finished"),
        (1, "Lens", "Sporting CP", "2026-09-08T17:45:00Z", None, "scheduled"),
        (1, "X", "Y", "2026-09-08T19:15:00Z", None, "scheduled"),
        (2, "A", "B", "2026-09-09T20:00:00Z", None, "scheduled"),
    ]


def test_result_text_rolls_years_and_takes_regulation_scores(spark):
    text = "Tue Sep 17\n21:00 A (ESP) v B (ENG) 3-2 a.e.t. (2-2, 1-1)\nWed Jan 22\nC (ITA) v D (GER) 1-0\nE (ITA) v F (GER) 4-3 pen\nTue Feb 4 2027\nG (ITA) v H (GER) 0-0\nMon Jan 5\nI (ITA) v J (GER) 2-0"
    got = [(r["home"], r["date"][:10], r["home_goals"], r["away_goals"]) for r in parsers.results(lines(spark, text), "UCL", 2024).orderBy("date").collect()]
    assert got == [("A", "2024-09-17", 2, 2), ("C", "2025-01-22", 1, 0), ("G", "2027-02-04", 0, 0), ("I", "2028-01-05", 2, 0)]


def test_result_table_dialects(spark):
    raw = spark.createDataFrame([("13/08/24", "A", "B", "2", "1", "1.5", "3", "4"), ("14/08/2024", "C", "D", None, None, None, None, None), ("15/08/2024", "E", "F", "0", "0", "1.5", None, "4")], "Date string, HomeTeam string, AwayTeam string, FTHG string, FTAG string, B365H string, B365D string, B365A string")
    got = [(r["date"], r["home"], r["home_goals"], r["odds_provider"], r["home_shots"]) for r in parsers.result_table(raw, "L", "s", "prov", "closing").collect()]
    assert got == [("2024-08-13T23:59:59Z", "A", 2, "prov", None), ("2024-08-15T23:59:59Z", "E", 0, None, None)]


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿é\nx".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    assert sorted(r["line"] for r in parsers.text_lines(spark, str(tmp_path / "*.txt")).collect()) == ["x", "é", "é"]


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    h = history(spark, 120)
    h.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(h.schema).parquet(str(tmp_path / "in"))
    q = live.windowed_counts(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, live.windowed_counts(h).collect()))
    q = live.first_deliveries(spark.readStream.schema(h.schema).parquet(str(tmp_path / "in")), "400 days").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == live.first_deliveries(h).count()
