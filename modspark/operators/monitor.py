"""Audit-log monitoring: lookback, score statistics and drift.

All statistics of a check come from **one** scan with filtered aggregates
(the recent and the previous window are conditions, not two reads).  The
exact percentile is safe at any scale because risk scores carry 4 decimals
(at most 10,001 distinct values per aggregation buffer).  For scores of any
precision ``decimals=None`` takes exact percentiles by distributed selection
(``operators.quantiles``), a few scans and no buffer of values.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.functions.numeric import r4, rnd
from modspark.operators.quantiles import exact_percentiles
from modspark.schemas import DRIFT_THRESHOLD, PREVIOUS_HOURS, RECENT_HOURS

STAT_NAMES = ["count", "mean", "std", "min", "max", "p50", "p90", "p99", "pct_removed", "pct_flagged", "pct_approved"]


def ts_literal(df: DataFrame, ts_col: str, value: datetime | str) -> Column:
    """A literal of the same type as ``df[ts_col]`` (keeps the predicate on the
    bare column, so it reaches the Parquet scan as a pushed filter)."""
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    dtype = df.schema[ts_col].dataType
    target = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else "timestamp"
    return F.lit(value).cast(target)


def _as_dt(as_of: datetime | str) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))


def lookback(df: DataFrame, as_of: datetime | str, hours: int = RECENT_HOURS, ts_col: str = "ts") -> DataFrame:
    """Rows with ``ts >= as_of - hours`` (no upper bound).  When the
    frame has a ``dt`` partition column the date predicate is added too, so
    whole partitions are pruned."""
    cutoff = _as_dt(as_of) - timedelta(hours=hours)
    out = df.filter(F.col(ts_col) >= ts_literal(df, ts_col, cutoff))
    if "dt" in df.columns:
        out = out.filter(F.col("dt") >= F.lit(cutoff.date().isoformat()).cast("date"))
    return out


def _stats(cond: Column | None, prefix: str, exact: bool, given: list | None = None) -> list[Column]:
    def w(c: Column) -> Column:
        return c if cond is None else F.when(cond, c)

    risk = w(F.col("risk_score"))
    rows = F.lit(1) if cond is None else F.when(cond, F.lit(1))
    pct = F.array(*[F.lit(v).cast("double") for v in given]) if given is not None else (
        F.percentile(risk, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
        if exact
        else F.percentile_approx(risk, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), 100000)
    )

    def share(action: str) -> Column:
        hit = F.coalesce(F.col("action") == F.lit(action), F.lit(False)).cast("double")
        return rnd(F.avg(w(hit)) * F.lit(100.0), 2)

    return [
        F.count(risk).alias(prefix + "count"),
        r4(F.avg(risk)).alias(prefix + "mean"),
        r4(F.stddev_samp(risk)).alias(prefix + "std"),
        r4(F.min(risk)).alias(prefix + "min"),
        r4(F.max(risk)).alias(prefix + "max"),
        pct.alias(prefix + "_pct"),
        F.count(rows).alias(prefix + "rows"),
        share("auto_remove").alias(prefix + "pct_removed"),
        share("flag_for_review").alias(prefix + "pct_flagged"),
        share("approved").alias(prefix + "pct_approved"),
    ]


def _unpack_pct(df: DataFrame, prefix: str) -> DataFrame:
    p = F.col(prefix + "_pct")
    return df.withColumns(
        {
            prefix + "p50": r4(p[0]),
            prefix + "p90": r4(p[1]),
            prefix + "p99": r4(p[2]),
        }
    ).drop(prefix + "_pct")


PERCENTILES = [0.5, 0.9, 0.99]


def _selected(rows: DataFrame, conds: dict[str, Column], decimals: int | None) -> dict[str, list | None]:
    """Percentiles by selection where scores may have any decimals, else None
    (the aggregate takes them)."""
    if decimals is not None:
        return dict.fromkeys(conds)
    return exact_percentiles(rows, "risk_score", PERCENTILES, conds)


def score_stats(
    audit: DataFrame, as_of: datetime | str, hours: int = RECENT_HOURS, exact: bool = True, decimals: int | None = 4
) -> DataFrame:
    """A1-A3: one row of the 11 statistics over the lookback window.
    ``decimals`` is what the scores are rounded to (None: not at all; the
    percentiles are then selected at once, in a few scans).

    An empty window gives ``count = 0`` and NULL for the rest."""
    rows = lookback(audit, as_of, hours)
    given = _selected(rows, {"all": F.lit(True)}, decimals)["all"]
    agg = rows.agg(*_stats(None, "", exact, given))
    agg = _unpack_pct(agg, "")
    return agg.select(*STAT_NAMES, "rows")


def drift_report(
    audit: DataFrame,
    as_of: datetime | str,
    threshold: float = DRIFT_THRESHOLD,
    baseline: str = "overlapping",
    recent_hours: int = RECENT_HOURS,
    previous_hours: int = PREVIOUS_HOURS,
    exact: bool = True,
    decimals: int | None = 4,
) -> DataFrame:
    """A4-A5: one row: recent_* and previous_* statistics, the shifts and
    the decision.  ``baseline='overlapping'`` compares the last 24 h with the
    last 48 h (which contains them); ``'disjoint'`` with the 24 h before."""
    if baseline not in ("overlapping", "disjoint"):
        raise ValueError("baseline must be 'overlapping' or 'disjoint'")
    at = _as_dt(as_of)
    scan = lookback(audit, at, previous_hours)
    recent_cut = ts_literal(audit, "ts", at - timedelta(hours=recent_hours))
    recent = F.col("ts") >= recent_cut
    previous = F.lit(True) if baseline == "overlapping" else (F.col("ts") < recent_cut)
    given = _selected(scan, {"recent": recent, "previous": previous}, decimals)
    agg = scan.agg(*_stats(recent, "recent_", exact, given["recent"]), *_stats(previous, "previous_", exact, given["previous"]))
    return drift_columns(_unpack_pct(_unpack_pct(agg, "recent_"), "previous_"), threshold)


def drift_columns(agg: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """The shifts and the decision from the statistics of both windows."""
    # pandas keeps no statistics for an empty window
    empty = (F.col("recent_rows") == 0) | (F.col("previous_rows") == 0)
    shift = F.abs(F.col("recent_mean") - F.col("previous_mean"))
    sshift = F.abs(F.col("recent_std") - F.col("previous_std"))
    detected = F.when(empty, F.lit(False)).otherwise(F.coalesce(shift > F.lit(float(threshold)), F.lit(False)))
    return agg.select(
        *[F.col("recent_" + s) for s in STAT_NAMES],
        *[F.col("previous_" + s) for s in STAT_NAMES],
        F.when(~empty, r4(shift)).alias("mean_shift"),
        F.when(~empty, r4(sshift)).alias("std_shift"),
        F.lit(float(threshold)).alias("threshold"),
        detected.alias("drift_detected"),
        F.when(empty, F.lit(None).cast("string"))
        .when(detected, F.lit("retrain"))
        .otherwise(F.lit("monitor"))
        .alias("recommendation"),
        F.when(empty, F.lit("insufficient data")).alias("reason"),
        F.col("recent_count").alias("total_processed"),
    )


def sliding_stats(audit: DataFrame, window: str = "24 hours", slide: str = "6 hours", exact: bool = True) -> DataFrame:
    """X3 (batch form): the statistics per sliding event-time window."""
    # keep the bare column when it already is a timestamp (a streaming
    # watermark is defined on that attribute)
    is_ntz = isinstance(audit.schema["ts"].dataType, T.TimestampNTZType)
    ts = F.col("ts").cast("timestamp") if is_ntz else F.col("ts")
    g = audit.withColumn("_w", F.window(ts, window, slide)).groupBy("_w").agg(*_stats(None, "", exact))
    g = _unpack_pct(g, "")
    return g.select(
        F.date_format(F.col("_w.start"), "yyyy-MM-dd HH:mm").alias("window_start"),
        F.date_format(F.col("_w.end"), "yyyy-MM-dd HH:mm").alias("window_end"),
        *STAT_NAMES,
    )
