"""Spectral ranking against a dense eigenvalue solution and planted strengths."""

import numpy as np

from matchlake.llm.ranking import FEW, SHRINK, ranked, spectral_ranking

SCHEMA = "a bigint, b bigint, a_score int, b_score int, strength string"


def outcomes(n=24, games=1500, seed=5):
    rng = np.random.default_rng(seed)
    s = np.linspace(2, -2, n)
    rows = []
    for _ in range(games):
        i, j = rng.choice(n, 2, replace=False, p=np.linspace(3, 1, n) / np.linspace(3, 1, n).sum())
        win = rng.random() < 1 / (1 + np.exp(-(s[i] - s[j])))
        rows.append((int(i), int(j), int(win), int(not win), "clash"))
    return rows, s


def test_recovers_planted_order_despite_uneven_counts(spark):
    rows, s = outcomes()
    got = {r["item"]: r["strength"] for r in spectral_ranking(spark.createDataFrame(rows, SCHEMA)).collect()}
    v = np.array([got[i] for i in range(len(s))])
    assert np.corrcoef(np.argsort(np.argsort(-v)), np.arange(len(s)))[0, 1] > 0.9
    assert abs(v.mean()) < 1e-9 and abs(v.std() - 1) < 1e-9
    assert all(r["residual"] < 1e-4 for r in spectral_ranking(spark.createDataFrame(rows, SCHEMA)).collect())
    assert spectral_ranking(spark.createDataFrame(rows, SCHEMA), steps=3).first()["residual"] > 1e-4  # an early end is told


def test_items_too_many_to_broadcast_give_the_same(spark, monkeypatch):
    from matchlake.llm import ranking

    df = spark.createDataFrame(outcomes(12, 400)[0], SCHEMA)
    one = {r["item"]: r["strength"] for r in spectral_ranking(df).collect()}
    monkeypatch.setattr(ranking, "small", lambda _: False)
    assert all(abs(one[r["item"]] - r["strength"]) < 1e-9 for r in spectral_ranking(df).collect())


def test_plane_agrees_with_a_dense_solution(spark):
    rows, s = outcomes(12, 600, 8)
    n = len(s)
    won, met = np.zeros((n, n)), np.zeros((n, n))
    first = np.sum([np.sign(x[2] - x[3]) for x in rows]) / (len(rows) + FEW)
    for i, j, x, y, _ in rows:
        m = np.sign(x - y) - first
        won[i, j] += m
        won[j, i] -= m
        met[i, j] += 1
        met[j, i] += 1
    h = won / (met + SHRINK)
    d = (met / (met + SHRINK)).sum(1)
    values, vectors = np.linalg.eig(h / np.sqrt(np.outer(d, d)))
    y = vectors[:, np.argmax(np.abs(values.imag))] / np.sqrt(d)
    plane = np.stack([y.real, y.imag], 1)
    got = {r["item"]: r["strength"] for r in spectral_ranking(spark.createDataFrame(rows, SCHEMA), tolerance=1e-9).collect()}
    v = np.array([got[i] for i in range(n)])
    design = np.column_stack([plane, np.ones(n)])
    fit = design @ np.linalg.lstsq(design, v, rcond=None)[0]
    assert np.corrcoef(fit, v)[0, 1] > 0.999


def test_nulls_repeats_unmet_items_and_empty_input(spark):
    rows = [(1, 2, 1, 0, ""), (1, 2, 1, 0, ""), (2, 3, 2, 1, ""), (3, 3, 5, 0, ""), (None, 1, 1, 0, ""), (1, None, 1, 0, ""), (1, 2, None, 0, "")]
    got = spectral_ranking(spark.createDataFrame(rows, SCHEMA))
    items = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 4, 5)], "id bigint, met string")
    table = {r["id"]: (r["rank"], r["strength"] is None) for r in ranked(items, got, "id").collect()}
    assert sorted(v[0] for v in table.values()) == [1, 2, 3, 4, 5]
    assert table[4] == (4, True) and table[5] == (5, True) and table[1][0] < table[3][0]
    assert spectral_ranking(spark.createDataFrame([], SCHEMA)).count() == 0
    level = spectral_ranking(spark.createDataFrame([(1, 2, 1, 1, "")], SCHEMA)).collect()
    assert [r["strength"] for r in level] == [0.0, 0.0]
