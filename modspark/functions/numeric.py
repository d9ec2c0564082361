"""Rounding with one IEEE recipe so Spark and SQL engines agree bit for bit.

``r4(x) = floor(x * 10000 + 0.5) / 10000``: half-up at 4 decimals.  Engine
``round`` differs from it (and from Python's ``round``) only on exact decimal
ties; a tie can therefore differ from a Python-computed value by 1e-4.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return (F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def r4(x: Column) -> Column:
    """Scores are kept at 4 decimals everywhere."""
    return half_up(x, 4)


def rnd(x: Column, digits: int) -> Column:
    """Half-up rounding at ``digits`` decimals (report percentages use 2)."""
    return half_up(x, digits)
