"""Batches appear whole and once: repeated, killed, raced and compacted."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modspark.schemas import AUDIT
from modspark.sources import sinks
from modspark.sources.published import Batch, Published
from modspark.sources.readers import read_audit

AS_OF = datetime(2024, 1, 31)


def records(spark, ids, hours=0):
    rows = [
        (f"c{i}", "u", "approved", 0.1, (AS_OF - timedelta(hours=hours + i)).isoformat(), "x", "s", "m", None, None, None, False)
        for i in ids
    ]
    return spark.createDataFrame(rows, AUDIT)


def ids(df):
    return sorted(r.content_id for r in df.collect())


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_a_batch_run_twice_is_there_once(spark, tmpdir_fresh, fmt):
    path = os.path.join(tmpdir_fresh, "log")
    assert sinks.write_audit(records(spark, [1, 2]), path, fmt, "b1")
    assert not sinks.write_audit(records(spark, [1, 2]), path, fmt, "b1")
    assert sinks.write_audit(records(spark, [30, 31]), path, fmt, "b2")
    assert sinks.write_audit(records(spark, [4]), path, fmt)  # no id: still published, under its own
    assert ids(read_audit(spark, path, fmt=fmt)) == ["c1", "c2", "c30", "c31", "c4"]
    assert ids(read_audit(spark, path, AS_OF, 24, fmt)) == ["c1", "c2", "c4"]
    assert {str(r.dt) for r in read_audit(spark, path, fmt=fmt).select("dt").collect()} == {"2024-01-30", "2024-01-29"}


def test_killed_before_publishing(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "log")
    table = Published(spark, path)
    df = records(spark, [1, 2]).withColumn("dt", F.lit("2024-01-31").cast("date"))
    table.stage(df, "b1", "json", ["dt"])  # the writer dies here
    assert ids(read_audit(spark, path)) == [] or not table.exists()
    assert sinks.write_audit(records(spark, [1, 2]), path, "json", "b1")
    assert ids(read_audit(spark, path)) == ["c1", "c2"]
    # the dead attempt goes with the next clean-up, what is read stays
    assert table.vacuum(older_than_s=-5) == 1 and table.vacuum(older_than_s=-5) == 0
    assert ids(read_audit(spark, path)) == ["c1", "c2"]


def test_two_writers_of_a_batch(spark, tmpdir_fresh):
    table = Published(spark, os.path.join(tmpdir_fresh, "t"))
    df = spark.createDataFrame([(1,)], "x int")
    one, two = table.stage(df, "b"), table.stage(df, "b")
    assert table.publish(Batch("b", one)) and not table.publish(Batch("b", two))
    assert [b.folder for b in table.batches()] == [one] and table.read("x int").count() == 1
    with pytest.raises(ValueError):
        table.append(df, "../b")


def test_compaction_is_seen_whole_and_remembers(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "log")
    table = Published(spark, path)
    for k in range(4):
        sinks.write_audit(records(spark, [2 * k, 2 * k + 1]), path, "json", f"b{k}")
    before = ids(read_audit(spark, path))
    name = table.compact(AUDIT, "json", ["dt"])
    assert [b.name for b in table.batches()] == [name] and ids(read_audit(spark, path)) == before
    assert not sinks.write_audit(records(spark, [0, 1]), path, "json", "b0")  # known within the larger batch
    assert table.compact(AUDIT, "json", ["dt"]) is None
    sinks.write_audit(records(spark, [9]), path, "json", "b9")
    table.compact(AUDIT, "json", ["dt"])
    assert len(table.batches()) == 1 and table.has("b2") and table.has("b9")
    assert table.vacuum(older_than_s=-5) == 6 and ids(read_audit(spark, path)) == sorted([*before, "c9"])


def test_reports_and_metrics_once(spark, tmpdir_fresh):
    reports, metrics = os.path.join(tmpdir_fresh, "r"), os.path.join(tmpdir_fresh, "m")
    report = spark.createDataFrame([(0.5,)], "mean_shift double")
    for _ in range(2):
        sinks.write_drift_report(report, reports, AS_OF, batch_id="check-1")
        sinks.log_metrics(spark, "run", {"auc": 0.9, "f1": 0.8}, path=metrics, run_id="r", step=1, batch_id="r-metric-1")
    sinks.write_drift_report(report, reports, AS_OF)
    assert sinks.read_drift_reports(spark, reports, "mean_shift double, checked_at string").count() == 2
    assert sinks.read_metrics(spark, metrics).count() == 2


def test_stream_epochs_are_batches(spark, tmpdir_fresh):
    """An epoch whose commit was lost runs again and is in the log once."""
    import shutil

    from modspark.streaming import jobs as sj

    src, path, ck = (os.path.join(tmpdir_fresh, x) for x in ("src", "log", "ck"))
    for k in range(3):
        records(spark, [2 * k, 2 * k + 1]).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(AUDIT).option("maxFilesPerTrigger", 1).json(src).withColumn("ts", F.to_timestamp("timestamp"))
    sj.start_published_audit(stream, path, ck, "live").awaitTermination()
    assert len(Published(spark, path).batches()) == 3
    copy = os.path.join(tmpdir_fresh, "ck-behind")
    shutil.copytree(ck, copy, ignore=lambda d, names: [n for n in names if d.endswith("commits") and n.strip(".").startswith("2")])
    records(spark, [6]).coalesce(1).write.mode("append").json(src)
    sj.start_published_audit(stream, path, copy, "live").awaitTermination()  # as restarted before the last commit
    assert ids(read_audit(spark, path)) == [f"c{i}" for i in range(7)]
