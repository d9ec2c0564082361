"""Dashboard data: the summary of a lookback and the hourly timeline, plus
the audit tail."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modspark.functions.numeric import r4
from modspark.operators.monitor import lookback
from modspark.schemas import ACTIONS, RECENT_HOURS


def _action():
    return F.coalesce(F.col("action"), F.lit("unknown"))


def _with_optional(df: DataFrame) -> DataFrame:
    """The review columns are optional in the audit contract."""
    if "agent_verdict" not in df.columns:
        df = df.withColumn("agent_verdict", F.lit(None).cast("string"))
    if "human_review" not in df.columns:
        df = df.withColumn("human_review", F.lit(None).cast("boolean"))
    return df


def summary(
    audit: DataFrame, as_of: datetime | str, hours: int = RECENT_HOURS, generated_at: datetime | None = None
) -> DataFrame:
    """One row: total, per-action counts (map), avg / max risk (4 dp),
    agent reviews (non-empty verdict), human reviews needed, ``generated_at``
    (ISO text of the time given, else of now, UTC).  An empty window gives
    total 0, an empty map and avg 0."""
    made = generated_at or datetime.now(timezone.utc).replace(tzinfo=None)
    rows = _with_optional(lookback(audit, as_of, hours))
    per_action = rows.groupBy(_action().alias("action")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("risk_score").alias("risk_sum"),
        F.count("risk_score").alias("risk_n"),
        F.max("risk_score").alias("risk_max"),
        F.count_if(F.coalesce(F.col("agent_verdict") != F.lit(""), F.lit(False))).alias("agent"),
        F.count_if(F.coalesce(F.col("human_review"), F.lit(False))).alias("human"),
    )
    # per_action has one row per distinct action (a handful): combining them
    # in one task is bounded by the action vocabulary, not by the data.
    out = per_action.agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions"),
        (F.sum("risk_sum") / F.sum("risk_n")).alias("_avg"),
        F.max("risk_max").alias("_max"),
        F.sum("agent").alias("agent_reviews"),
        F.sum("human").alias("human_reviews_needed"),
    )
    return out.select(
        F.coalesce(F.col("total"), F.lit(0)).cast("long").alias("total"),
        F.lit(hours).alias("hours"),
        F.coalesce(F.col("actions"), F.create_map().cast("map<string,bigint>")).alias("actions"),
        F.coalesce(r4(F.col("_avg")), F.lit(0.0)).alias("avg_risk_score"),
        F.coalesce(r4(F.col("_max")), F.lit(0.0)).alias("max_risk_score"),
        F.coalesce(F.col("agent_reviews"), F.lit(0)).cast("long").alias("agent_reviews"),
        F.coalesce(F.col("human_reviews_needed"), F.lit(0)).cast("long").alias("human_reviews_needed"),
        F.lit(made.isoformat()).alias("generated_at"),
    )


def summary_rows(audit: DataFrame, as_of: datetime | str, hours: int = RECENT_HOURS) -> DataFrame:
    """A6 flattened: one row per action with the summary scalars repeated.
    The window over the per-action rows spans one row per action only."""
    rows = _with_optional(lookback(audit, as_of, hours))
    per_action = rows.groupBy(_action().alias("action")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("risk_score").alias("risk_sum"),
        F.count("risk_score").alias("risk_n"),
        F.max("risk_score").alias("risk_max"),
        F.count_if(F.coalesce(F.col("agent_verdict") != F.lit(""), F.lit(False))).alias("agent"),
        F.count_if(F.coalesce(F.col("human_review"), F.lit(False))).alias("human"),
    )
    w = Window.partitionBy()
    return per_action.select(
        "action",
        F.col("n"),
        F.sum("n").over(w).alias("total"),
        r4(F.sum("risk_sum").over(w) / F.sum("risk_n").over(w)).alias("avg_risk_score"),
        r4(F.max("risk_max").over(w)).alias("max_risk_score"),
        F.sum("agent").over(w).alias("agent_reviews"),
        F.sum("human").over(w).alias("human_reviews_needed"),
    )


def hour_bucket(ts) -> F.Column:
    return F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH:00")


def timeline(audit: DataFrame, as_of: datetime | str, hours: int = RECENT_HOURS) -> DataFrame:
    """A7 long form: (time, action, n) for non-empty buckets, sorted by time."""
    rows = lookback(audit, as_of, hours)
    return (
        rows.groupBy(hour_bucket(F.col("ts")).alias("time"), _action().alias("action"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("time", "action")
    )


def timeline_wide(audit: DataFrame, as_of: datetime | str, hours: int = RECENT_HOURS) -> DataFrame:
    """A7 wide form: one row per non-empty bucket, one count column per known
    action, ``unknown`` (no action) and ``other`` (any other action, e.g. a
    reviewer's own), so a row's counts add up to its bucket.  The long form
    names the others.  The columns are fixed: no distinct-values job."""
    a = _action()
    known = ACTIONS + ["unknown"]
    counts = [F.count_if(a == v).alias(v) for v in known] + [F.count_if(~a.isin(known)).alias("other")]
    rows = lookback(audit, as_of, hours)
    return rows.groupBy(hour_bucket(F.col("ts")).alias("time")).agg(*counts).orderBy("time")


def tail(audit: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` records (by time, then id), oldest first.
    ``n <= 0`` gives no rows.  ``orderBy().limit()`` plans a per-partition
    top-n (no full sort)."""
    if n <= 0:
        return audit.limit(0)
    last = audit.orderBy(F.col("ts").desc(), F.col("content_id").desc()).limit(n)
    return last.orderBy(F.col("ts").asc(), F.col("content_id").asc())
