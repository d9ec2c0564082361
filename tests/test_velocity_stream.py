"""Streamed trailing counts equal the batch ones, with late posts, a restart
and a hot user."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modspark.operators import windows as wi
from modspark.streaming import velocity
from modspark.streaming.state import state_settings

BASE = datetime(2024, 1, 1, 5, 30)
DDL = "content_id string, user_id string, ts timestamp"


def posts():
    rng = random.Random(4)
    rows = []
    for k in range(600):
        user = "hot" if k % 3 == 0 else rng.choice(["a", "b", None])
        minutes = rng.choice([rng.randrange(0, 5 * 24 * 60), 24 * 60 * rng.randrange(0, 5)])  # gaps of exactly a day, ties
        rows.append((f"c{k}", user, BASE + timedelta(minutes=minutes)))
    rows.sort(key=lambda r: r[2])
    for i in range(0, len(rows) - 8, 8):  # out of order within the delay
        if rows[i + 7][2] - rows[i][2] < timedelta(minutes=50):
            rows[i : i + 8] = rng.sample(rows[i : i + 8], 8)
    return rows


def write(spark, rows, path):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.05)  # files are read in the order of their times


def run(spark, src, out, ck):
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(src)
    with state_settings(spark):
        q = velocity.trailing_count(stream).writeStream.format("parquet").option("path", out)
        q = q.option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def as_set(df):
    rows = df.select("content_id", "user_id", F.col("ts").cast("string").alias("ts"), "posts_last_24h").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_stream_equals_batch_over_a_restart(spark, tmpdir_fresh):
    src, out, ck = (os.path.join(tmpdir_fresh, x) for x in ("src", "out", "ck"))
    rows = posts()
    late = [("late1", "a", rows[200][2] - timedelta(hours=8)), ("late2", "hot", rows[200][2] - timedelta(days=2))]
    write(spark, rows[:300], src)
    write(spark, [*rows[300:310], *late], src)  # behind the watermark of the first file
    run(spark, src, out, ck)
    first = as_set(spark.read.parquet(out))
    for i in range(310, 600, 145):
        write(spark, rows[i : i + 145], src)
    write(spark, [("none", "a", None), ("end", "zzz", BASE + timedelta(days=30))], src)
    run(spark, src, out, ck)  # goes on from the checkpoint
    got = as_set(spark.read.parquet(out))
    assert ("none", "a", None, None) in got
    batch = wi.trailing_count(spark.createDataFrame(rows, DDL))
    assert got - {("none", "a", None, None)} == as_set(batch)
    assert first and first < got


@pytest.mark.parametrize("hours", [2])
def test_other_ranges(spark, tmpdir_fresh, hours):
    src, out, ck = (os.path.join(tmpdir_fresh, x) for x in ("src", "out", "ck"))
    rows = [(f"c{k}", "u", BASE + timedelta(minutes=7 * k)) for k in range(60)]
    write(spark, rows, src)
    write(spark, [("end", "u", BASE + timedelta(days=9))], src)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(src)
    with state_settings(spark):
        q = velocity.trailing_count(stream, hours=hours).writeStream.format("parquet").option("path", out)
        q = q.option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    assert as_set(spark.read.parquet(out)) == as_set(wi.trailing_count(spark.createDataFrame(rows, DDL), hours=hours))


def test_state_calls_do_not_grow_with_users(spark, tmpdir_fresh):
    src, out, ck = (os.path.join(tmpdir_fresh, x) for x in ("src", "out", "ck"))
    rows = [(f"c{k}", f"u{k}", BASE + timedelta(seconds=k)) for k in range(1500)]
    write(spark, rows, src)
    stream = spark.readStream.schema(DDL).parquet(src)
    with state_settings(spark):
        q = velocity.trailing_count(stream).writeStream.format("parquet").option("path", out)
        q = q.option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < q.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] < 1500  # a row a user and slice before: 3,000 and more
