"""A1-A7 from mergeable partials instead of the raw log.

A partial is the number of records (and of those with a reviewer's verdict, and
waiting for a human) per time bucket, action and risk score.  Scores carry four
decimals, so a bucket has at most 10,002 x actions rows whatever its records,
and every statistic of the monitor and the dashboard is a weighted aggregate of
them: counts, shares, mean and deviation (from whole ten-thousandths, so sums
are exact and merge in any order), extremes and exact percentiles.

Partials are published batch by batch (``sources.published``) beside the log,
with the batch's name, so a repeated batch counts once; several partials of one
bucket just add up, and ``compact`` folds them.  Late records land in their old
bucket with the next batch.

Look-backs must start at a bucket's edge; buckets are an hour unless the
table was begun with another width that divides the hour.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.functions.numeric import r4, rnd
from modspark.operators.monitor import STAT_NAMES, _as_dt, drift_columns
from modspark.schemas import DRIFT_THRESHOLD, PREVIOUS_HOURS, RECENT_HOURS
from modspark.sources.published import Published

DDL = "bucket timestamp, action string, risk int, n long, agent long, human long"
UNITS = 10_000


def partial_counts(records: DataFrame, minutes: int = 60) -> DataFrame:
    """The partials of some audit records with a ``ts`` (records without one
    belong to no bucket and are left out, as look-backs leave them out)."""
    if 60 % minutes:
        raise ValueError("the width of a bucket must divide the hour")
    ts, width = F.col("ts").cast("timestamp"), minutes * 60
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / width) * width)
    agent = F.coalesce(F.col("agent_verdict") != F.lit(""), F.lit(False)) if "agent_verdict" in records.columns else F.lit(False)
    human = F.coalesce(F.col("human_review"), F.lit(False)) if "human_review" in records.columns else F.lit(False)
    rows = records.filter(F.col("ts").isNotNull()).select(
        bucket.alias("bucket"), "action", F.round(F.col("risk_score") * UNITS).cast("int").alias("risk"), agent.alias("_a"), human.alias("_h")
    )
    return rows.groupBy("bucket", "action", "risk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_a").alias("agent"), F.count_if("_h").alias("human")
    )


def merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("bucket", "action", "risk").agg(*[F.sum(c).alias(c) for c in ("n", "agent", "human")])


class Partials:
    """The partials beside a log."""

    def __init__(self, spark: SparkSession, path: str, minutes: int = 60):
        self.table, self.minutes = Published(spark, path), minutes

    def update(self, records: DataFrame, batch: str) -> bool:
        """Add the records of one batch; False if it is there already."""
        if self.table.has(batch):
            return False
        return self.table.append(partial_counts(records, self.minutes).coalesce(8), batch, "parquet")

    def read(self) -> DataFrame:
        return self.table.read(DDL, "parquet")

    def compact(self) -> str | None:
        """Fold all partials into one batch, added up."""
        return self.table.compact(DDL, "parquet", change=merged)

    def since(self, as_of: datetime | str, hours: int) -> DataFrame:
        start = _as_dt(as_of) - timedelta(hours=hours)
        if (start.minute * 60 + start.second) % (self.minutes * 60) or start.microsecond:
            raise ValueError(f"look-backs start at a multiple of {self.minutes} minutes")
        return self.read().filter(F.col("bucket") >= F.lit(start).cast("timestamp"))


def _weighted(prefix: str = "", cond: Column | None = None) -> list[Column]:
    """The statistics of ``monitor._stats`` over partials."""

    def w(c: Column) -> Column:
        return c if cond is None else F.when(cond, c)

    n, x = F.col("n"), F.col("risk").cast("long")
    known = F.col("risk").isNotNull()
    count = F.coalesce(F.sum(w(F.when(known, n))), F.lit(0))
    total = F.sum(w(F.when(known, n * x)).cast("decimal(38,0)"))
    squares = F.sum(w(F.when(known, n * x * x)).cast("decimal(38,0)"))
    spread = squares.cast("double") - total.cast("double") * total.cast("double") / count
    rows = F.coalesce(F.sum(w(n)), F.lit(0))

    def share(action: str) -> Column:
        hit = F.sum(w(F.when(F.col("action") == F.lit(action), n).otherwise(F.lit(0))))
        return rnd(hit / F.when(rows > 0, rows) * F.lit(100.0), 2)

    probs = F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))
    pct = F.percentile(w(F.when(known, x / UNITS)), probs, F.coalesce(w(F.when(known, n)), F.lit(0)))
    return [
        count.alias(prefix + "count"),
        r4(total.cast("double") / F.when(count > 0, count) / UNITS).alias(prefix + "mean"),
        r4(F.when(count > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (count - 1)) / UNITS)).alias(prefix + "std"),
        r4(F.min(w(x)) / UNITS).alias(prefix + "min"),
        r4(F.max(w(x)) / UNITS).alias(prefix + "max"),
        pct.alias(prefix + "_pct"),
        rows.alias(prefix + "rows"),
        share("auto_remove").alias(prefix + "pct_removed"),
        share("flag_for_review").alias(prefix + "pct_flagged"),
        share("approved").alias(prefix + "pct_approved"),
    ]


def _unpacked(df: DataFrame, prefix: str) -> DataFrame:
    p = F.col(prefix + "_pct")
    return df.withColumns({prefix + q: r4(p[i]) for i, q in enumerate(("p50", "p90", "p99"))}).drop(prefix + "_pct")


def score_stats(partials: Partials, as_of: datetime | str, hours: int = RECENT_HOURS) -> DataFrame:
    """A1-A3 from partials."""
    return _unpacked(partials.since(as_of, hours).agg(*_weighted()), "").select(*STAT_NAMES, "rows")


def drift_report(
    partials: Partials, as_of: datetime | str, threshold: float = DRIFT_THRESHOLD, baseline: str = "overlapping",
    recent_hours: int = RECENT_HOURS, previous_hours: int = PREVIOUS_HOURS,
) -> DataFrame:
    """A4-A5 from partials."""
    if baseline not in ("overlapping", "disjoint"):
        raise ValueError("baseline must be 'overlapping' or 'disjoint'")
    cut = F.lit(_as_dt(as_of) - timedelta(hours=recent_hours)).cast("timestamp")
    recent = F.col("bucket") >= cut
    previous = F.lit(True) if baseline == "overlapping" else F.col("bucket") < cut
    agg = partials.since(as_of, previous_hours).agg(*_weighted("recent_", recent), *_weighted("previous_", previous))
    return drift_columns(_unpacked(_unpacked(agg, "recent_"), "previous_"), threshold)


def summary_rows(partials: Partials, as_of: datetime | str, hours: int = RECENT_HOURS) -> DataFrame:
    """A6, a row an action with the summary scalars (no window over the rows:
    the totals are one row, joined back)."""
    rows = partials.since(as_of, hours).withColumn("action", F.coalesce("action", F.lit("unknown")))
    known = F.when(F.col("risk").isNotNull(), F.col("n"))
    total = rows.agg(
        F.sum("n").alias("total"), r4(F.sum(known * F.col("risk")) / F.sum(known) / UNITS).alias("avg_risk_score"),
        r4(F.max("risk") / UNITS).alias("max_risk_score"), F.sum("agent").alias("agent_reviews"), F.sum("human").alias("human_reviews_needed"),
    )
    per = rows.groupBy("action").agg(F.sum("n").alias("n"))
    one = F.lit(1).alias("_k")
    return per.select("*", one).join(F.broadcast(total.select("*", one)), "_k").drop("_k")


def timeline(partials: Partials, as_of: datetime | str, hours: int = RECENT_HOURS) -> DataFrame:
    """A7, long form, from partials."""
    rows = partials.since(as_of, hours)
    time = F.date_format(F.date_trunc("hour", "bucket"), "yyyy-MM-dd HH:00").alias("time")
    return rows.groupBy(time, F.coalesce("action", F.lit("unknown")).alias("action")).agg(F.sum("n").alias("n")).orderBy("time", "action")
