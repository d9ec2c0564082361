"""Bucketed per-user windows against Spark's own (unbucketed) windows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from modspark.operators import windows as wi


def skewed_posts(spark, n=3000, seed=5):
    """One hot user with a third of the rows, exact 24 h gaps and ties."""
    rnd = random.Random(seed)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        u = "hot" if i % 3 == 0 else f"u{rnd.randint(0, 30)}"
        t = base + timedelta(seconds=rnd.randint(0, 6 * 86400))
        rows.append((str(i), u, t))
    # exact boundary: a row exactly 24 h before another, and peers
    rows += [("b1", "edge", base), ("b2", "edge", base + timedelta(hours=24)), ("b3", "edge", base + timedelta(hours=24)),
             ("b4", "edge", base + timedelta(hours=24, microseconds=1))]
    return spark.createDataFrame(rows, "content_id string, user_id string, ts timestamp")


def test_trailing_count_matches_range_window(spark):
    df = skewed_posts(spark)
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("long") * 0 + F.unix_micros("ts")).rangeBetween(
        -24 * 3600 * 1_000_000, 0
    )
    ref = {r.content_id: r.n for r in df.select("content_id", F.count(F.lit(1)).over(w).alias("n")).collect()}
    got = {r.content_id: r.posts_last_24h for r in wi.trailing_count(df).collect()}
    assert got == ref
    assert got["b2"] == 3 and got["b4"] == 3  # b1 at exactly -24h counts; b4 is 1 us later and drops b1


def test_trailing_count_keeps_rows_without_time(spark):
    df = skewed_posts(spark, n=300).union(
        spark.createDataFrame([("n1", "hot", None), ("n2", "hot", None), ("n3", "solo", None)],
                              "content_id string, user_id string, ts timestamp")
    )
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-24 * 3600 * 1_000_000, 0)
    ref = {r.content_id: r.n for r in df.select("content_id", F.count(F.lit(1)).over(w).alias("n")).collect()}
    got = {r.content_id: r.posts_last_24h for r in wi.trailing_count(df).collect()}
    assert got == ref and len(got) == df.count()


def test_prior_sum_matches_rows_window(spark):
    df = skewed_posts(spark).withColumn("flag", (F.abs(F.hash("content_id")) % 3 == 0).cast("int"))
    w = Window.partitionBy("user_id").orderBy("ts", "content_id").rowsBetween(Window.unboundedPreceding, -1)
    ref = {r.content_id: r.n for r in df.select("content_id", F.coalesce(F.sum("flag").over(w), F.lit(0)).alias("n")).collect()}
    got = {r.content_id: r.prev_violations for r in wi.prior_sum(df, F.col("flag")).collect()}
    assert got == ref


def test_prior_sum_keeps_rows_without_time(spark):
    df = skewed_posts(spark, n=300).union(
        spark.createDataFrame([("n1", "hot", None), ("n2", "hot", None), ("n3", "solo", None)],
                              "content_id string, user_id string, ts timestamp")
    ).withColumn("flag", (F.abs(F.hash("content_id")) % 2 == 0).cast("int"))
    w = Window.partitionBy("user_id").orderBy("ts", "content_id").rowsBetween(Window.unboundedPreceding, -1)
    ref = {r.content_id: r.n for r in df.select("content_id", F.coalesce(F.sum("flag").over(w), F.lit(0)).alias("n")).collect()}
    got = {r.content_id: r.prev_violations for r in wi.prior_sum(df, F.col("flag")).collect()}
    assert got == ref and len(got) == df.count()


def test_windows_have_no_single_user_partition(spark):
    plan = wi.trailing_count(skewed_posts(spark))._jdf.queryExecution().executedPlan().toString()
    # every window is partitioned by (user, bucket); the only per-user window is over bucket totals
    assert "hashpartitioning(user_id#" in plan and "_b" in plan
