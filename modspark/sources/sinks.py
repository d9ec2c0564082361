"""Sinks: audit log (S6), drift reports (S7), run metrics.

Model persistence (S9) is MLlib's writer (``operators.risk.Ensemble.save``
and ``PipelineModel.write``).  Tables live under a base path that defaults
to the shared checkpoint folder of the session.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.schemas import AUDIT, METRICS
from modspark.session import scratch_path
from modspark.sources.published import Published


def write_audit(
    records: DataFrame, path: str, fmt: str = "json", batch_id: str | None = None, in_order: bool = False
) -> bool:
    """Append audit records partitioned by ``dt`` (the record date).
    ``fmt='json'`` keeps the one-object-per-line contract; ``'parquet'``
    gives column pruning and pushed-down time predicates to readers.

    With a ``batch_id`` the batch is staged and published by one rename
    (``sources.published``): written twice, or begun, killed and run again, it
    is in the log once.  A log once written so is always appended to so; a
    batch without an id then gets one of its own.  False if the batch was
    there already.

    ``in_order`` keeps the rows of a partition in their order in the file
    (``readers.tail_audit`` reads logs in that order) instead of bringing the
    rows of a day together."""
    cols = [f.name for f in AUDIT.fields]
    out = records.select(*cols).withColumn("dt", F.to_date(F.to_timestamp("timestamp")))
    if fmt == "parquet":  # a typed time, so readers push their lookback down
        out = out.withColumn("ts", F.to_timestamp("timestamp"))
    # rows of a day together (in several tasks if AQE finds the day large): not one file a task and day
    if in_order:  # the day first, as the writer wants them, then as they came
        out = out.withColumn("_at", F.monotonically_increasing_id()).sortWithinPartitions("dt", "_at").drop("_at")
    else:
        out = out.hint("rebalance", "dt")
    if _publishes(records.sparkSession, path, batch_id):
        return Published(records.sparkSession, path).append(out, batch_id or uuid.uuid4().hex, fmt, ["dt"])
    out.write.mode("append").partitionBy("dt").format(fmt).save(path)
    return True


def _publishes(spark: SparkSession, path: str, batch_id: str | None) -> bool:
    return batch_id is not None or Published(spark, path).exists()


def write_drift_report(
    report: DataFrame, path: str, checked_at: datetime | None = None, batch_id: str | None = None
) -> bool:
    """Append one row per check (a table, so two checks in the same
    second never overwrite each other).  With a ``batch_id`` a check that is
    run again is reported once, as in ``write_audit``."""
    at = checked_at or datetime.now(timezone.utc).replace(tzinfo=None)
    rows = report.withColumn("checked_at", F.lit(at.isoformat()))
    if _publishes(report.sparkSession, path, batch_id):
        return Published(report.sparkSession, path).append(rows, batch_id or uuid.uuid4().hex, "json")
    rows.write.mode("append").json(path)
    return True


def read_drift_reports(spark: SparkSession, path: str, schema) -> DataFrame:
    """The reports of a folder, published ones only if it publishes."""
    table = Published(spark, path)
    return table.read(schema) if table.exists() else spark.read.schema(schema).json(path)


def log_metrics(
    spark: SparkSession,
    run_name: str,
    values: dict,
    kind: str = "metric",
    step: int | None = None,
    path: str | None = None,
    run_id: str | None = None,
    batch_id: str | None = None,
) -> str:
    """Append ``(run_id, run_name, kind, key, value, step, ts)`` rows.
    ``values`` are a handful of scalars of one run (never data).  With a
    ``batch_id`` (e.g. run, kind and step) a repeated call logs once."""
    rid = run_id or uuid.uuid4().hex[:12]
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = [(rid, run_name, kind, str(k), str(v), step, now) for k, v in values.items()]
    target = path or scratch_path(spark, "metrics")
    df = spark.createDataFrame(rows, METRICS)
    if _publishes(spark, target, batch_id):
        Published(spark, target).append(df.coalesce(1), batch_id or uuid.uuid4().hex, "parquet")
    else:
        df.write.mode("append").parquet(target)
    return rid


def read_metrics(spark: SparkSession, path: str | None = None) -> DataFrame:
    table = Published(spark, path or scratch_path(spark, "metrics"))
    return table.read(METRICS, "parquet") if table.exists() else spark.read.schema(METRICS).parquet(table.path)
