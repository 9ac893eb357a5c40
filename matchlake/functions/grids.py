"""Score grids in blocks: one array of 13 x 13 cells per row, made by NumPy in Arrow batches.

The same distributions as in :mod:`matchlake.functions.dist`, for models that need whole grids of many pairs: there an
expression per cell would be evaluated cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from matchlake.functions.dist import MAX_GOALS

SIDE = MAX_GOALS + 1
FLOOR = 1e-15


def pmf(rate: np.ndarray) -> np.ndarray:
    """[row, goals]: Poisson probabilities, the last cell holds the tail."""
    k = np.arange(1, MAX_GOALS)
    p = np.exp(-rate)[:, None] * np.cumprod(np.concatenate([np.ones((len(rate), 1)), rate[:, None] / k], 1), 1)
    return np.concatenate([p, np.maximum(1 - p.sum(1, keepdims=True), 0)], 1)


def grid(home: np.ndarray, away: np.ndarray, rho: float = 0.0) -> np.ndarray:
    """[row, home goals, away goals]; ``rho`` applies the low-score factor."""
    g = pmf(home)[:, :, None] * pmf(away)[:, None, :]
    if rho:
        g[:, 0, 0] *= 1 - home * away * rho
        g[:, 0, 1] *= 1 + home * rho
        g[:, 1, 0] *= 1 + away * rho
        g[:, 1, 1] *= 1 - rho
        if (g < 0).any():
            raise ValueError("the dependence is too strong for these rates")
    return g / g.sum((1, 2), keepdims=True)


def outcomes(g: np.ndarray) -> np.ndarray:
    """[row, (home, draw, away)]."""
    return np.stack([np.tril(g, -1).sum((1, 2)), np.trace(g, axis1=1, axis2=2), np.triu(g, 1).sum((1, 2))], 1)


def tempered(g: np.ndarray, log_temperature: float, offsets: tuple[float, float]) -> np.ndarray:
    """The grid with its outcomes moved to softmax(log p / exp(t) + offsets)."""
    before = np.maximum(outcomes(g), FLOOR)
    score = np.log(before) / np.exp(log_temperature) + np.array([*offsets, -sum(offsets)])
    after = np.exp(score - score.max(1, keepdims=True))
    ratio = after / after.sum(1, keepdims=True) / before
    kind = np.where(np.tri(SIDE, k=-1) > 0, 0, np.where(np.eye(SIDE) > 0, 1, 2))
    out = g * ratio[:, kind]
    return out / out.sum((1, 2), keepdims=True)


def bad(g: np.ndarray) -> np.ndarray:
    """Rows with a cell that is no finite number >= 0, or that do not sum to 1."""
    return ~np.isfinite(g).all((1, 2)) | (g < 0).any((1, 2)) | (np.abs(g.sum((1, 2)) - 1) > 1e-8)


def with_columns(df: DataFrame, added: str, make: Callable[[pd.DataFrame], dict[str, object]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns of ``drop`` and with those of the schema ``added``, which ``make`` computes by batch."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(kept + T.StructType.fromDDL(added).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[f.name for f in kept]].assign(**make(pdf))

    return df.mapInPandas(run, schema)


def cells(g: np.ndarray) -> list[np.ndarray]:
    """One flat array per row, as an array column wants it."""
    return list(g.reshape(len(g), -1))
