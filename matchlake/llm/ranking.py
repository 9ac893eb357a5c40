"""One ranking from pairwise outcomes (problem 6).

Outcomes become a skew-symmetric matrix of normalised margins: for two items the mean of (won - lost), less the mean
advantage of the side named first, drawn towards zero where they met seldom. The matrix is scaled by its degrees, so
items that met often do not dominate. A distributed Lanczos iteration builds an orthonormal basis, one sparse product
and one narrow written column per step, until the leading singular plane of the small projected matrix has settled. In
that plane the items lie along a line; the direction of the projection is the one whose order agrees with most outcomes.

The iteration ends as soon as the plane has settled, before rounding could bring it a second time, so earlier columns
are needed once more only for the plane itself. Where the steps end first, ``residual`` says how far the plane is off.

Only the projected matrix, of the size of the number of steps, and a histogram of directions of :data:`DIRECTIONS`
bins reach the driver.

Defined results: outcomes with a null item or score, or of an item with itself, are ignored; items that never met
another get strength null and stand last by id; ties of strength are ordered by id; repeated outcomes count each; no
outcomes give null strengths and only level ones strength 0; further columns are ignored. Items of a part of the graph
without any link to the rest are compared with the rest only through the spectrum, which has no meaning across parts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.util import materialize, salted_join, small

DIRECTIONS = 3600
#: Most steps; a plane that has not settled by then is returned with its residual.
STEPS = 200
TOLERANCE = 1e-4
SHRINK = 1.0
#: Level outcomes added before the advantage of the side named first is estimated.
FEW = 100


def margins(outcomes: DataFrame) -> DataFrame:
    """(i, j, x, n): both directions of each pair's margin. outcomes(a, b, a_score, b_score)."""
    met = outcomes.where("a is not null and b is not null and a <> b and a_score is not null and b_score is not null").select("a", "b", F.signum(F.col("a_score") - F.col("b_score")).cast("double").alias("won"))
    first = met.agg(F.sum("won") / (F.count("*") + FEW)).first()[0] or 0.0
    flip = F.col("a") > F.col("b")
    won = F.col("won") - F.lit(float(first))
    pairs = met.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum(F.when(flip, -won).otherwise(won)).alias("s"), F.count("*").alias("n"))
    pairs = pairs.select("i", "j", (F.col("s") / (F.col("n") + SHRINK)).alias("x"), "n")
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("x")).alias("x"), "n"))


def _projected(betas: list[float]) -> np.ndarray:
    """The matrix in the basis: skew-symmetric and tridiagonal."""
    t = np.diag(betas[:-1], -1)
    return t - t.T


def _residual(betas: list[float]) -> float:
    """How far the leading plane of the projected matrix is off, against its singular value."""
    values, vectors = np.linalg.eig(_projected(betas))
    lead = int(np.argmax(np.abs(values.imag)))
    return float(betas[-1] * abs(vectors[-1, lead]) / max(abs(values[lead]), 1e-12))


def spectral_ranking(outcomes: DataFrame, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(item, strength, met, residual) for every item with an outcome; strengths have mean 0 and deviation 1."""
    raw = materialize(margins(materialize(outcomes.select("a", "b", "a_score", "b_score"), "outcomes")), "margins")
    degree = raw.groupBy("i").agg(F.sum(F.col("n") / (F.col("n") + SHRINK)).alias("d"), F.sum("n").alias("met"))
    degree = materialize(degree, "degree")
    few = small(degree)  # then a column of the basis is small enough to be broadcast

    def with_items(df: DataFrame, items: DataFrame, on: str) -> DataFrame:
        return df.join(F.broadcast(items), on) if few else salted_join(df, items, [on], "inner")

    scaled = with_items(raw, degree.select("i", F.col("d").alias("di")), "i")
    scaled = with_items(scaled, degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    edges = materialize(scaled.select("i", "j", (F.col("x") / F.sqrt(F.col("di") * F.col("dj"))).alias("x")), "edges")

    # The plane lies near the roots of the degrees; a fixed pseudo-random part keeps the start from being level. It is
    # the same for the same items, in any partitioning.
    noise = F.pmod(F.xxhash64("i"), F.lit(2_000_003)) / 2_000_003.0
    start = degree.select("i", (F.sqrt("d") * (1 + noise)).alias("w"))
    norm = start.agg(F.sqrt(F.sum(F.col("w") * F.col("w")))).first()[0]
    if not norm:
        return degree.select(F.col("i").alias("item"), F.lit(None).cast("double").alias("strength"), "met", F.lit(None).cast("double").alias("residual"))
    columns = [start.select("i", (F.col("w") / norm).alias("q"))]
    betas: list[float] = []
    residual = math.inf
    for k in range(steps):
        last = columns[-1].select(F.col("i").alias("j"), F.col("q").alias("v"))
        part = with_items(edges, last, "j").select("i", (F.col("x") * F.col("v")).alias("w"))
        if k:  # skew-symmetric: only the last two directions are needed
            part = part.unionByName(columns[-2].select("i", (F.col("q") * betas[-1]).alias("w")))
        held = materialize(part.groupBy("i").agg(F.sum("w").alias("w")), "product")
        beta = float(held.agg(F.sqrt(F.sum(F.col("w") * F.col("w")))).first()[0] or 0.0)
        betas.append(beta)
        residual = _residual(betas) if k else math.inf
        if beta < 1e-9 or k == steps - 1 or (k >= 3 and residual < tolerance):
            break
        columns.append(held.select("i", (F.col("w") / beta).alias("q")))
    values, vectors = np.linalg.eig(_projected(betas))
    if np.abs(values.imag).max() < 1e-9:
        return degree.select(F.col("i").alias("item"), F.lit(0.0).alias("strength"), "met", F.lit(0.0).alias("residual"))
    y = vectors[:, int(np.argmax(np.abs(values.imag)))]
    whole = None
    for q, c in zip(columns, y, strict=True):
        one = q.select("i", (F.col("q") * float(c.real)).alias("u"), (F.col("q") * float(c.imag)).alias("v"))
        whole = one if whole is None else whole.unionByName(one)
    root = 1.0 / F.sqrt("d")  # an item's entries of the scaled matrix grow with the root of its degree
    plane = with_items(whole.groupBy("i").agg(F.sum("u").alias("u"), F.sum("v").alias("v")), degree, "i")
    plane = materialize(plane.select("i", "met", (F.col("u") * root).alias("u"), (F.col("v") * root).alias("v")), "plane")

    a, b = plane.select("i", F.col("u").alias("ui"), F.col("v").alias("vi")), plane.select(F.col("i").alias("j"), F.col("u").alias("uj"), F.col("v").alias("vj"))
    turned = with_items(with_items(raw.where("i < j and x <> 0"), a, "i"), b, "j")
    sign = F.signum("x")
    angle = F.atan2(sign * (F.col("vi") - F.col("vj")), sign * (F.col("ui") - F.col("uj")))
    bins = turned.groupBy(F.pmod(F.floor((angle + math.pi) / (2 * math.pi) * DIRECTIONS), F.lit(DIRECTIONS)).cast("int").alias("bin")).agg(F.sum(F.abs("x") * F.col("n")).alias("w")).collect()
    weight = np.zeros(DIRECTIONS)
    for r in bins:
        weight[r["bin"]] += r["w"]
    half = DIRECTIONS // 2
    around = np.concatenate([weight, weight, weight])
    total = np.concatenate([[0.0], np.cumsum(around)])
    agree = [total[DIRECTIONS + t + half // 2] - total[DIRECTIONS + t - half // 2] for t in range(DIRECTIONS)]
    top = np.flatnonzero(np.isclose(agree, max(agree)))
    theta = (float(top[len(top) // 2]) / DIRECTIONS) * 2 * math.pi - math.pi
    scored = plane.select(F.col("i").alias("item"), "met", (F.col("u") * math.cos(theta) + F.col("v") * math.sin(theta)).alias("s"))
    stats = scored.agg(F.avg("s"), F.stddev_pop("s")).first()
    deviation = stats[1] or 1.0
    return scored.select("item", ((F.col("s") - F.lit(stats[0])) / F.lit(deviation)).alias("strength"), "met", F.lit(residual).alias("residual"))


def ranked(items: DataFrame, strengths: DataFrame, item: str) -> DataFrame:
    """``items`` with strength, met, residual and rank (1 is the strongest).

    Positions are counted in ranges of strength, then inside each range, so no task sorts all items.
    """
    made = ["strength", "met", "residual", "rank"]
    items = items.drop(*made)
    both = items.join(strengths.select(F.col("item").alias(item), "strength", "met", "residual"), item, "left").withColumn("met", F.coalesce("met", F.lit(0)))
    part = F.when(F.col("strength").isNull(), F.lit(10_000)).otherwise(F.floor((F.lit(5.0) - F.greatest(F.least("strength", F.lit(5.0)), F.lit(-5.0))) * 100))
    both = materialize(both.withColumn("__part", part), "ranked")
    sizes = both.groupBy("__part").agg(F.count("*").alias("__size"))  # at most 1,002 ranges
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")
    inside = both.withColumn("__inside", F.row_number().over(Window.partitionBy("__part").orderBy(F.col("strength").desc_nulls_last(), item)))
    return inside.join(F.broadcast(before), "__part").withColumn("rank", (F.col("__before") + F.col("__inside")).cast("bigint")).drop("__part", "__before", "__inside")


def agreement(outcomes: DataFrame, held: str) -> DataFrame:
    """(held_out, spectral, win_share): decided outcomes for which ``held`` is true, and the shares of them won by the
    item that stands higher in the ranking, or in the mean margin, of the other outcomes; equal or unknown items count
    half."""
    known = outcomes.where(~F.col(held)).select("a", "b", "a_score", "b_score")
    test = outcomes.where(F.col(held) & (F.col("a_score") != F.col("b_score")) & F.col("a").isNotNull() & F.col("b").isNotNull())
    sides = F.array(F.struct(F.col("a").alias("i"), F.signum(F.col("a_score") - F.col("b_score")).alias("m")), F.struct(F.col("b").alias("i"), F.signum(F.col("b_score") - F.col("a_score")).alias("m")))
    simple = known.where("a_score is not null and b_score is not null").select(F.inline(sides)).groupBy("i").agg(F.avg("m").alias("simple"))
    both = materialize(spectral_ranking(known).select(F.col("item").alias("i"), "strength").join(simple, "i", "left"), "strengths")
    few = small(both)
    for side in ("a", "b"):
        own = both.toDF(side, f"s_{side}", f"m_{side}")
        test = test.join(F.broadcast(own), side, "left") if few else salted_join(test, own, [side])
    sign = F.signum(F.col("a_score") - F.col("b_score"))
    share = lambda x: F.avg((1 + F.coalesce(F.signum(F.col(f"{x}_a") - F.col(f"{x}_b")) * sign, F.lit(0.0))) / 2)
    return test.agg(F.count("*").alias("held_out"), share("s").alias("spectral"), share("m").alias("win_share"))
