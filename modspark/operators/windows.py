"""Per-user time windows that stay balanced when one user is hot.

A ``Window.partitionBy(user)`` puts every row of a user in one task; a user
holding a third of the rows would make that task a third of the job.  These
operators split each user's timeline into fixed time buckets instead and
combine two pieces, both exact:

* within-bucket running values: a window partitioned by ``(user, bucket)``;
* the total of all earlier buckets: a prefix sum over the per-(user, bucket)
  aggregate, which has at most (time span / bucket width) rows per user and
  is combined map-side.

The trailing-range count (W1) is ``A(t) - B(t)``, with ``A(t)`` the number of
rows at or before ``t`` and ``B(t)`` the number of rows more than ``range``
before ``t``; ``B`` is counted on copies of the rows shifted forward by the
range, so both are prefix counts of the same bucketed layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def trailing_count(
    df: DataFrame,
    key: str = "user_id",
    ts_col: str = "ts",
    hours: int = 24,
    bucket_hours: int = 1,
    out: str = "posts_last_24h",
) -> DataFrame:
    """Rows of the same ``key`` with ``ts`` in ``[t - hours, t]`` (peers
    at ``t`` included) - the RANGE frame count - without a per-key partition.

    One scan emits every row twice (a generator, no union of two scans): as
    itself, and as a copy moved forward by the range that carries only the
    key and the time.  The per-bucket totals come from a second, narrow scan
    of the originals; the moved copies' totals are the same totals shifted by
    ``hours / bucket_hours`` buckets, read with a RANGE frame on the bucket
    number.  Rows without a time count their NULL-time peers, as Spark's
    RANGE frame does."""
    if hours % bucket_hours:
        raise ValueError("hours must be a multiple of bucket_hours")
    width = bucket_hours * HOUR_US
    span = hours * HOUR_US
    shift = hours // bucket_hours
    t = _micros(F.col(ts_col))
    payload = F.struct(*[F.col(c) for c in df.columns])
    itself = F.struct(t.alias("_t"), F.lit(1).alias("_o"), payload.alias("_row"))
    moved = F.struct((t + F.lit(span)).alias("_t"), F.lit(0).alias("_o"), F.when(F.lit(False), payload).alias("_row"))
    u = df.select(F.col(key), F.inline(F.array(itself, moved)))
    u = u.withColumn("_b", F.floor(F.col("_t") / F.lit(width)))

    w = Window.partitionBy(key, "_b").orderBy("_t")
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = w.rangeBetween(Window.currentRow, Window.currentRow)
    moved_flag = F.lit(1) - F.col("_o")
    u = u.withColumns(
        {
            "_a_in": F.sum("_o").over(upto),
            "_s_le": F.sum(moved_flag).over(upto),
            "_s_eq": F.sum(moved_flag).over(peers),
        }
    ).filter(F.col("_o") == 1)

    buckets = (
        df.select(F.col(key), F.floor(t / F.lit(width)).alias("_b"))
        .groupBy(key, "_b")
        .agg(F.count(F.lit(1)).alias("_no"))
    )
    per_key = Window.partitionBy(key).orderBy("_b")
    offsets = buckets.select(
        key,
        "_b",
        F.coalesce(F.sum("_no").over(per_key.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off_o"),
        F.coalesce(F.sum("_no").over(per_key.rangeBetween(Window.unboundedPreceding, -(shift + 1))), F.lit(0)).alias(
            "_off_s"
        ),
    )
    # left and null-safe on the key: rows without a key are one group, as in
    # a native window; rows without a time (NULL bucket) have no offsets
    offsets = offsets.withColumnsRenamed({key: "_ok", "_b": "_ob"})
    res = u.join(offsets, u[key].eqNullSafe(offsets["_ok"]) & (u["_b"] == offsets["_ob"]), "left")
    off_o = F.coalesce(F.col("_off_o"), F.lit(0))
    off_s = F.coalesce(F.col("_off_s"), F.lit(0))
    count = (off_o + F.col("_a_in")) - (off_s + F.col("_s_le") - F.col("_s_eq"))
    return res.select("_row.*", count.cast("long").alias(out))


def prior_sum(
    df: DataFrame,
    value: Column,
    key: str = "user_id",
    ts_col: str = "ts",
    tie: str = "content_id",
    bucket_hours: int = 24,
    out: str = "prev_violations",
) -> DataFrame:
    """Per key, the sum of ``value`` over all strictly earlier rows in
    (ts, tie) order - ``rowsBetween(unboundedPreceding, -1)`` - bucketed."""
    width = bucket_hours * HOUR_US
    base = df.withColumn("_t", _micros(F.col(ts_col))).withColumn("_b", F.floor(F.col("_t") / F.lit(width)))
    base = base.withColumn("_v", value.cast("long"))
    w = Window.partitionBy(key, "_b").orderBy("_t", tie).rowsBetween(Window.unboundedPreceding, -1)
    inner = base.withColumn("_in", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    buckets = base.groupBy(key, "_b").agg(F.sum("_v").alias("_nb"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(key, "_b", F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_off"))
    # null-safe: rows without a key are one group, rows without a time its
    # first bucket, both as in a native window
    offsets = offsets.withColumnsRenamed({key: "_ok", "_b": "_ob"})
    same = inner[key].eqNullSafe(offsets["_ok"]) & inner["_b"].eqNullSafe(offsets["_ob"])
    res = inner.join(offsets, same, "left")
    total = F.coalesce(F.col("_off"), F.lit(0)) + F.col("_in")
    return res.withColumn(out, total.cast("long")).drop("_t", "_b", "_v", "_in", "_off", "_ok", "_ob")


def first_seen_age(
    df: DataFrame,
    key: str = "user_id",
    ts_col: str = "ts",
    out: str = "account_age_days",
) -> DataFrame:
    """Days from the key's first ``ts`` to the row's ``ts``.  The first
    time per key is a map-side-combined aggregate joined back (AQE splits a
    hot key on the row side)."""
    first = df.groupBy(F.col(key).alias("_fk")).agg(F.min(ts_col).alias("_first"))
    # null-safe: rows without a key are kept, as one group
    res = df.join(first, df[key].eqNullSafe(first["_fk"]))
    age = F.datediff(F.to_date(F.col(ts_col)), F.to_date("_first")).cast("int")
    return res.withColumn(out, age).drop("_first", "_fk")


def high_velocity(df: DataFrame, col: str = "posts_last_24h", threshold: int = 50, out: str = "high_velocity") -> DataFrame:
    return df.withColumn(out, (F.col(col) > F.lit(threshold)).cast("int"))
