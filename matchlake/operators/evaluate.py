"""Chronological splits, forecast metrics and model selection as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.dist import outcome

FLOOR = 1e-15


def instants_at(counts: DataFrame, positions: list[int]) -> DataFrame:
    """(p, date): the instant in which the row at each 0-based position lies when ``counts(date, k)`` are laid in order.

    Days are summed first, so one task sorts calendar days, and then the instants of the days in question.
    """
    rows = counts.withColumn("day", F.col("date").cast("date"))
    days = rows.groupBy("day").agg(F.sum("k").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("before", before).select("*", F.explode(F.array(*[F.lit(p).cast("bigint") for p in positions])).alias("p"))
    picked = days.where((F.col("before") <= F.col("p")) & (F.col("p") < F.col("before") + F.col("n"))).select("day", "before", "p")
    upto = F.col("before") + F.sum("k").over(Window.partitionBy("p").orderBy("date"))
    inside = rows.join(F.broadcast(picked), "day").withColumn("upto", upto)  # one row per position
    return inside.where("upto > p").groupBy("p").agg(F.min("date").alias("date"))


def temporal_split(matches: DataFrame, train_share: float = 0.8, min_train: int = 100, min_holdout: int = 10, max_holdout: int | None = None) -> DataFrame:
    """One row: the split date and how many matches lie before it and from it on; equal times stay together."""
    total = matches.count()
    at = min(total - min_holdout, max(min_train, int(total * train_share)))
    if at < 0 or at >= total:
        return matches.sparkSession.createDataFrame([], "split_date timestamp_ntz, train_rows bigint, holdout_rows bigint")
    cut = instants_at(matches.groupBy("date").agg(F.count("*").alias("k")), [at]).select(F.col("date").alias("split_date"))
    before = matches.join(F.broadcast(cut)).where(F.col("date") < F.col("split_date")).agg(F.count("*").alias("train_rows"))  # one row
    held = F.lit(total) - F.col("train_rows")
    return cut.join(before).select("split_date", "train_rows", (held if max_holdout is None else F.least(held, F.lit(max_holdout))).alias("holdout_rows"))


def fold_bounds(matches: DataFrame, folds: int = 3) -> DataFrame:
    """(fold, start, end): bounds at the quantiles of the distinct dates; the last fold has no end."""
    dates = matches.select("date").distinct().withColumn("k", F.lit(1))
    n = dates.count()
    at = [(i, n * (i + 1) // (folds + 1)) for i in range(folds)] if n else []
    if not at:
        return matches.sparkSession.createDataFrame([], "fold int, start timestamp_ntz, end timestamp_ntz")
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(p).cast("bigint").alias("q")) for i, p in at]))
    picked = instants_at(dates, sorted({p for _, p in at})).select("p", "date", named.alias("f")).where("p = f.q")
    return picked.select("f.fold", F.col("date").alias("start"), F.lead("date").over(Window.orderBy("f.fold")).alias("end"))  # one row per fold


def long_probabilities(forecasts: DataFrame, key: list[str]) -> DataFrame:
    """key, outcome, p, hit: three rows per forecast with p_home, p_draw, p_away and the score."""
    cells = F.array(*[F.struct(F.lit(i).alias("outcome"), F.col(c).alias("p")) for i, c in enumerate(("p_home", "p_draw", "p_away"))])
    rows = forecasts.select(*key, outcome(F.col("home_goals"), F.col("away_goals")).alias("seen"), F.explode(cells).alias("c"))
    return rows.select(*key, "c.outcome", "c.p", (F.col("seen") == F.col("c.outcome")).cast("int").alias("hit"))


def outcome_metrics(forecasts: DataFrame, group: list[str]) -> DataFrame:
    """Mean log loss (floored) and three-class Brier score per group."""
    seen = outcome(F.col("home_goals"), F.col("away_goals"))
    p = [F.col("p_home"), F.col("p_draw"), F.col("p_away")]
    own = F.when(seen == 0, p[0]).when(seen == 1, p[1]).otherwise(p[2])
    brier = sum((F.pow(x - (seen == i).cast("double"), 2) for i, x in enumerate(p)), F.lit(0.0))
    return forecasts.groupBy(*group).agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest(own, F.lit(FLOOR)))).alias("log_loss"), F.avg(brier).alias("brier"))


def goal_log_loss(rows: DataFrame) -> DataFrame:
    """Mean negative Poisson log-likelihood of both sides' goals. rows(home_rate, away_rate, home_goals, away_goals)."""

    def nll(rate: Column, goals: Column) -> Column:
        return rate - goals * F.log(rate) + F.log(F.factorial(F.least(goals, F.lit(20))).cast("double"))

    return rows.agg(F.count("*").alias("n"), F.avg(nll(F.col("home_rate"), F.col("home_goals")) + nll(F.col("away_rate"), F.col("away_goals"))).alias("goal_log_loss"))


def bin_of(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def calibration_bins(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    """(outcome, bin, n, mean_p, observed) with a row for empty bins too."""
    rows = long_probabilities(forecasts, []).withColumn("bin", bin_of(F.col("p"), bins))
    got = rows.groupBy("outcome", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("hit").alias("observed"))
    frame = forecasts.sparkSession.range(3 * bins).select((F.col("id") / bins).cast("int").alias("outcome"), (F.col("id") % bins).cast("int").alias("bin"))
    return frame.join(got, ["outcome", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error: bins weighted by their size, averaged over the outcomes."""
    gap = F.coalesce(F.col("n") * F.abs(F.col("mean_p") - F.col("observed")), F.lit(0.0))
    per = bins.groupBy("outcome").agg((F.sum(gap) / F.greatest(F.sum("n"), F.lit(1))).alias("e"))
    return per.agg(F.avg("e").alias("ece"))


def weight_search(forecasts: DataFrame, steps: int = 20) -> DataFrame:
    """(fold, weight, log_loss, best): a convex mixture of forecasts a and b over a grid of weights.

    forecasts(fold, pa, pb): both models' probability of what happened.
    """
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    rows = forecasts.withColumn("step", grid)
    w = F.col("step") / float(steps)
    loss = rows.groupBy("fold", "step").agg(F.avg(-F.log(F.greatest((1 - w) * F.col("pa") + w * F.col("pb"), F.lit(FLOOR)))).alias("log_loss"), F.count("*").alias("n"))
    best = loss.groupBy("fold").agg(F.min(F.struct(F.round("log_loss", 9).alias("l"), F.col("step"))).alias("m")).select("fold", F.col("m.step").alias("best_step"))
    return loss.join(best, "fold").select("fold", (F.col("step") / float(steps)).alias("weight"), "n", "log_loss", (F.col("step") == F.col("best_step")).alias("best"))


def promoted(scores: DataFrame, threshold: float = 0.005, min_folds: int = 2) -> DataFrame:
    """One row: the model to use. scores(model, ordinal, fold, n, log_loss); ordinal 0 is the incumbent, which only a
    gain of ``threshold`` in the fold-weighted loss over ``min_folds`` folds replaces; the first minimum wins."""
    mean = scores.groupBy("model", "ordinal").agg((F.sum(F.col("n") * F.col("log_loss")) / F.sum("n")).alias("loss"), F.count("*").alias("folds"))
    best = mean.agg(F.min(F.struct("loss", "ordinal", "model", "folds")).alias("m"), F.min(F.when(F.col("ordinal") == 0, F.struct("ordinal", "model", "loss"))).alias("base"))
    won = (F.col("base.loss") - F.col("m.loss") >= threshold) & (F.col("m.folds") >= min_folds)
    return best.select(F.when(won, F.col("m.model")).otherwise(F.col("base.model")).alias("model"), F.col("m.model").alias("candidate"), (F.col("base.loss") - F.col("m.loss")).alias("gain"))
