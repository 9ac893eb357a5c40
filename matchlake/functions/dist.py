"""Score distributions as column expressions: goal pmfs, score grids, outcome probabilities, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Goals 0 .. MAX_GOALS of a grid; the last cell holds the tail.
MAX_GOALS = 12
LOW, HIGH = 1e-6, 100.0


def pmf(rate: Column, top: int = MAX_GOALS) -> Column:
    """Poisson probabilities 0 .. top as an array by the recurrence p(k) = p(k-1) * rate / k; the last is the tail."""
    start = F.struct(F.array(F.exp(-rate)).alias("p"), F.exp(-rate).alias("last"))
    run = F.aggregate(
        F.sequence(F.lit(1), F.lit(top - 1)),
        start,
        lambda a, k: F.struct(F.concat(a["p"], F.array(a["last"] * rate / k)).alias("p"), (a["last"] * rate / k).alias("last")),
        lambda a: a["p"],
    )
    return F.concat(run, F.array(F.greatest(F.lit(1.0) - F.aggregate(run, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))))


def grid(pairs: DataFrame, home_rate: str, away_rate: str, top: int = MAX_GOALS) -> DataFrame:
    """Long form of the score grid: adds ``hg, ag, p`` for (top + 1)^2 cells that sum to 1 per row of ``pairs``."""
    rows = pairs.withColumns({"__h": pmf(F.col(home_rate), top), "__a": pmf(F.col(away_rate), top)})
    rows = rows.select("*", F.posexplode("__h").alias("hg", "__ph")).select("*", F.posexplode("__a").alias("ag", "__pa"))
    return rows.withColumn("p", F.col("__ph") * F.col("__pa")).drop("__h", "__a", "__ph", "__pa")


def outcome(hg: Column, ag: Column) -> Column:
    """0 home, 1 draw, 2 away."""
    return F.when(hg > ag, 0).when(hg == ag, 1).otherwise(2)


def grid_outcomes(cells: DataFrame, key: list[str], p: str = "p") -> DataFrame:
    """Home, draw and away probability of each grid."""
    side = outcome(F.col("hg"), F.col("ag"))
    return cells.groupBy(*key).agg(*[F.sum(F.when(side == i, F.col(p)).otherwise(0.0)).alias(n) for i, n in enumerate(("p_home", "p_draw", "p_away"))])


def skellam(home_rate: Column, away_rate: Column, top: int = 260) -> Column:
    """struct(p_home, p_draw, p_away) of independent goals with full tails, for rates up to 100.

    One pass over the goals 0 .. top carries both probabilities of a number and of fewer goals.
    """
    h, a = F.exp(-home_rate), F.exp(-away_rate)
    start = F.struct(F.lit(0.0).alias("home"), (h * a).alias("draw"), h.alias("h"), a.alias("a"), a.alias("below"))

    def step(s: Column, k: Column) -> Column:
        ph, pa = s["h"] * home_rate / k, s["a"] * away_rate / k
        return F.struct((s["home"] + ph * s["below"]).alias("home"), (s["draw"] + ph * pa).alias("draw"), ph.alias("h"), pa.alias("a"), (s["below"] + pa).alias("below"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(top)), start, step)
    return F.struct(total["home"].alias("p_home"), total["draw"].alias("p_draw"), F.greatest(F.lit(1.0) - total["home"] - total["draw"], F.lit(0.0)).alias("p_away"))


def low_score_factor(hg: Column, ag: Column, lh: Column, la: Column, rho: Column) -> Column:
    """The low-score correction of a bivariate goal model on the cells 0-0, 0-1, 1-0 and 1-1."""
    return (
        F.when((hg == 0) & (ag == 0), 1 - lh * la * rho)
        .when((hg == 0) & (ag == 1), 1 + lh * rho)
        .when((hg == 1) & (ag == 0), 1 + la * rho)
        .when((hg == 1) & (ag == 1), 1 - rho)
        .otherwise(1.0)
    )


def corrected_grid(pairs: DataFrame, key: list[str], home_rate: str, away_rate: str, rho: float, top: int = MAX_GOALS) -> DataFrame:
    """The score grid times the low-score factor, normalised per row of ``pairs``, which ``key`` tells apart."""
    cells = _with_corrected(pairs, home_rate, away_rate, rho, top)
    return cells.withColumn("p", F.col("__q")).drop("__q")


def blended_grid(pairs: DataFrame, home_rate: str, away_rate: str, rho: float, weight: float, top: int = MAX_GOALS) -> DataFrame:
    """The mixture of a row's plain grid, with ``weight``, and its corrected one: cells are made and mixed where the row
    lies, none is shuffled."""
    cells = _with_corrected(pairs, home_rate, away_rate, rho, top)
    return cells.withColumn("p", weight * F.col("p") + (1 - weight) * F.col("__q")).drop("__q")


def _with_corrected(pairs: DataFrame, home_rate: str, away_rate: str, rho: float, top: int) -> DataFrame:
    """The score grid with ``__q``, its corrected and normalised cells.

    The sum over a grid is known from the two distributions: that of the plain cells and what the factor adds to four.
    """
    h, a = F.col(home_rate), F.col(away_rate)
    whole = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    rows = pairs.withColumns({"__ph": pmf(h, top), "__pa": pmf(a, top)})
    at = lambda i, j: F.get("__ph", F.lit(i)) * F.get("__pa", F.lit(j)) * (low_score_factor(F.lit(i), F.lit(j), h, a, F.lit(rho)) - 1)
    total = whole(F.col("__ph")) * whole(F.col("__pa")) + at(0, 0) + at(0, 1) + at(1, 0) + at(1, 1)
    cells = grid(rows.withColumn("__total", total).drop("__ph", "__pa"), home_rate, away_rate, top)
    return cells.withColumn("__q", F.col("p") * low_score_factor(F.col("hg"), F.col("ag"), h, a, F.lit(rho)) / F.col("__total")).drop("__total")


def tempered(p: list[Column], log_temperature: float, offsets: tuple[float, float]) -> list[Column]:
    """softmax(log p / exp(t) + offsets); the third offset is minus the sum of the first two."""
    add = (offsets[0], offsets[1], -offsets[0] - offsets[1])
    raw = [F.exp(F.log(F.greatest(x, F.lit(1e-15))) / F.exp(F.lit(log_temperature)) + o) for x, o in zip(p, add, strict=True)]
    total = raw[0] + raw[1] + raw[2]
    return [r / total for r in raw]


def calibrated_grid(cells: DataFrame, key: list[str], log_temperature: float, offsets: tuple[float, float]) -> DataFrame:
    """Rescales the home, draw and away cells of each grid to the tempered outcome probabilities."""
    base = grid_outcomes(cells, key)
    new = tempered([F.col("p_home"), F.col("p_draw"), F.col("p_away")], log_temperature, offsets)
    ratio = base.select(*key, F.array(*[n / F.greatest(F.col(o), F.lit(1e-15)) for n, o in zip(new, ("p_home", "p_draw", "p_away"), strict=True)]).alias("ratio"))
    return cells.join(ratio, key).withColumn("p", F.col("p") * F.get("ratio", outcome(F.col("hg"), F.col("ag")))).drop("ratio")


def link_rate(intercept: Column, advantage: Column, attack: Column, defence: Column) -> Column:
    """exp of the linear predictor, kept within [LOW, HIGH]."""
    return F.exp(F.greatest(F.least(intercept + advantage + attack - defence, F.log(F.lit(HIGH))), F.log(F.lit(LOW))))


def expected_score(home: Column, away: Column, advantage: float = 55.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(home + advantage - away) / 400.0))


def goal_multiplier(difference: Column) -> Column:
    return F.when(difference < 0, F.lit(None)).when(difference <= 1, 1.0).when(difference == 2, 1.5).otherwise((11 + difference) / 8.0)


def decay_weight(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age_days / half_life)


def adjusted_rate(rate: Column, adjustment: Column) -> Column:
    """A rate moved by ``exp(adjustment)``, kept within [LOW, HIGH]."""
    return F.exp(F.greatest(F.least(F.log(rate) + adjustment, F.log(F.lit(HIGH))), F.log(F.lit(LOW))))
