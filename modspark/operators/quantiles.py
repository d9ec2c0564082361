"""A2: exact percentiles of any doubles, by distributed selection.

``percentile`` keeps a count per distinct value in one buffer, which is fine
for scores of four decimals and not for raw ones.  Here the driver only ever
holds a few numbers per wanted rank, and every pass is a scan with map-side
combined aggregates:

1. count the values of each group (a condition on the rows);
2. bracket each wanted rank: a sketch of the values inside the bracket gives
   two of them around the rank, and one exact count of the values below and
   inside tells which part holds it;  a bracket shrinks by the sketch's
   accuracy each pass, so n values need about log(n) / log(accuracy) passes;
3. when a bracket holds at most ``small`` values, or one value, its values are
   counted by value and the rank is read off (a sum over at most ``small``
   rows).

Linear interpolation between neighbouring ranks, as ``percentile`` and
``quantile_cont`` do.  NULL and NaN values are left out; an empty group gives
NULL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY, SMALL, MAX_PASSES = 1000, 10_000, 64


@dataclass
class _Bracket:
    """Rank ``k`` (from 0) of a group lies within [low, high]; ``below``
    values of the group are smaller than ``low``, ``inside`` lie within."""

    group: str
    k: int
    low: float
    high: float
    below: int
    inside: int
    value: float | None = None

    def cond(self, value: Column, conds: dict[str, Column]) -> Column:
        return conds[self.group] & (value >= F.lit(self.low)) & (value <= F.lit(self.high))


def select_ranks(df: DataFrame, value: Column, ranks: dict[str, list[int]], conds: dict[str, Column], counts: dict[str, tuple], accuracy: int = ACCURACY, small: int = SMALL) -> dict[tuple[str, int], float]:
    """The values at the given ranks of every group; ``counts``: group ->
    (count, minimum, maximum)."""
    brackets = [
        _Bracket(g, k, counts[g][1], counts[g][2], 0, counts[g][0]) for g, ks in ranks.items() for k in sorted(set(ks))
    ]
    for _ in range(MAX_PASSES):
        for b in brackets:
            if b.value is None and b.low == b.high:
                b.value = b.low
        wide = [b for b in brackets if b.value is None and b.inside > small]
        if not wide:
            break
        # two values around the rank from a sketch of the bracket
        probes = []
        for b in wide:
            p, e = (b.k - b.below) / max(1, b.inside - 1), 1.5 / accuracy
            probes.append(F.array(F.lit(min(max(p - e, 0.0), 1.0)), F.lit(min(max(p + e, 0.0), 1.0))))
        row = df.agg(
            *[F.percentile_approx(F.when(b.cond(value, conds), value), q, F.lit(accuracy)).alias(f"s{i}") for i, (b, q) in enumerate(zip(wide, probes))]
        ).first()
        # exact counts tell where the rank is: below, between or above them
        cols, cuts = [], []
        for i, b in enumerate(wide):
            x, y = row[f"s{i}"]
            cuts.append((x, y))
            inside = b.cond(value, conds)
            cols += [
                F.count_if(inside & (value < F.lit(x))).alias(f"a{i}"), F.count_if(inside & (value <= F.lit(y))).alias(f"b{i}"),
                F.max(F.when(inside & (value < F.lit(x)), value)).alias(f"u{i}"), F.min(F.when(inside & (value > F.lit(y)), value)).alias(f"v{i}"),
            ]
        row = df.agg(*cols).first()
        for i, (b, (x, y)) in enumerate(zip(wide, cuts)):
            under, upto, at = row[f"a{i}"], row[f"b{i}"], b.k - b.below
            if at < under:
                b.high, b.inside = row[f"u{i}"], under
            elif at >= upto:
                b.low, b.below, b.inside = row[f"v{i}"], b.below + upto, b.inside - upto
            elif (x, y) == (b.low, b.high):  # often repeated ends hide what is between
                _strip_ends(df, b, value, conds)
            else:
                b.low, b.high, b.below, b.inside = x, y, b.below + under, upto - under
    for b in brackets:
        if b.value is None:
            b.value = _in_order(df, b, value, conds)
    return {(b.group, b.k): b.value for b in brackets}


def _strip_ends(df: DataFrame, b: _Bracket, value: Column, conds: dict[str, Column]) -> None:
    """Settle a rank that lies in the repeats of an end, or leave both ends."""
    c = b.cond(value, conds)
    between = c & (value > F.lit(b.low)) & (value < F.lit(b.high))
    r = df.agg(
        F.count_if(c & (value == F.lit(b.low))).alias("a"), F.count_if(between).alias("n"),
        F.min(F.when(between, value)).alias("low"), F.max(F.when(between, value)).alias("high"),
    ).first()
    at = b.k - b.below
    if at < r.a:
        b.value = b.low
    elif at >= r.a + r.n:
        b.value = b.high
    else:
        b.low, b.high, b.below, b.inside = r.low, r.high, b.below + r.a, r.n


def _in_order(df: DataFrame, b: _Bracket, value: Column, conds: dict[str, Column]) -> float:
    """The rank read off the counts of a bracket's distinct values, one
    bounded fetch after the other."""
    counts = df.filter(b.cond(value, conds)).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    seen, low = b.below, b.low
    while True:
        part = counts.filter(F.col("v") >= F.lit(low)).orderBy("v").limit(SMALL + 1).collect()
        for r in part[:SMALL]:
            seen += r.n
            if seen > b.k:
                return r.v
        low = part[SMALL].v


def exact_percentiles(
    df: DataFrame, value: str | Column, probs: list[float], conds: dict[str, Column] | None = None, accuracy: int = ACCURACY, small: int = SMALL
) -> dict[str, list[float | None]]:
    """Exact percentiles of ``value`` over the rows of each condition (all
    rows without one); ``df`` is scanned a few times, so it should be stored
    or cheap."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    df = df.filter(value.isNotNull() & ~F.isnan(value))
    conds = {g: F.coalesce(c, F.lit(False)) for g, c in (conds or {"all": F.lit(True)}).items()}
    cols = []
    for g, c in conds.items():
        cols += [F.count_if(c).alias(f"n_{g}"), F.min(F.when(c, value)).alias(f"lo_{g}"), F.max(F.when(c, value)).alias(f"hi_{g}")]
    row = df.agg(*cols).first()
    counts = {g: (row[f"n_{g}"], row[f"lo_{g}"], row[f"hi_{g}"]) for g in conds}
    at = {g: [p * (n - 1) for p in probs] if n else [] for g, (n, *_) in counts.items()}
    ranks = {g: [k for x in xs for k in (math.floor(x), math.ceil(x))] for g, xs in at.items() if xs}
    found = select_ranks(df, value, ranks, conds, counts, accuracy, small)
    out: dict[str, list[float | None]] = {}
    for g, xs in at.items():
        out[g] = [None] * len(probs)
        for i, x in enumerate(xs):
            low, high = found[g, math.floor(x)], found[g, math.ceil(x)]
            out[g][i] = low if low == high else low + (high - low) * (x - math.floor(x))
    return out
