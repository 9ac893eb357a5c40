"""Uniform numbers that depend on their keys alone: the same in any partitioning, row order and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 13), 16, 10).cast("double") / float(2**52)


def inverse_cdf(cdf: Column, u: Column) -> Column:
    """Index of the first cell whose cumulative probability exceeds ``u``."""
    return F.size(F.filter(cdf, lambda c: c <= u))
