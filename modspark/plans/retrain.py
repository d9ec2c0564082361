"""Drift check job and check-and-retrain.

The check reads the audit log once (filtered aggregates), writes one report
row and a few metrics; only one boolean comes back to the driver.  On drift
the risk ensemble is trained on labelled features, saved under a new version
folder, and the ``current`` pointer is replaced, so every scorer that loads
``current`` picks the new model up.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.operators.monitor import drift_report
from modspark.schemas import DRIFT_THRESHOLD
from modspark.session import scratch_path
from modspark.sources.sinks import log_metrics, write_drift_report


def run_drift_check(
    spark: SparkSession,
    audit: DataFrame,
    as_of: datetime | str,
    threshold: float = DRIFT_THRESHOLD,
    baseline: str = "overlapping",
    report_path: str | None = None,
    metrics_path: str | None = None,
) -> dict:
    """One check: report row appended to ``report_path``; metrics logged."""
    report = drift_report(audit, as_of, threshold, baseline)
    first = report.first()  # one row of scalars: the log is read once
    row = first.asDict()
    stored = spark.createDataFrame([first], report.schema)
    write_drift_report(stored, report_path or scratch_path(spark, "drift_reports"))
    log_metrics(
        spark,
        "drift_check",
        {
            "mean_risk_score": row["recent_mean"] if row["recent_mean"] is not None else 0,
            "pct_removed": row["recent_pct_removed"] if row["recent_pct_removed"] is not None else 0,
            "drift_detected": int(bool(row["drift_detected"])),
        },
        path=metrics_path,
    )
    return row


def check_and_retrain(
    spark: SparkSession,
    audit: DataFrame,
    as_of: datetime | str,
    training_set: DataFrame,
    model_dir: str,
    n_trees: int = 200,
    threshold: float = DRIFT_THRESHOLD,
    baseline: str = "overlapping",
    report_path: str | None = None,
    metrics_path: str | None = None,
) -> tuple[dict, str | None]:
    """Drift detected -> retrain, save a new version, move ``current``,
    log ``retrain_auc``.  Returns (report row, new version or None)."""
    row = run_drift_check(spark, audit, as_of, threshold, baseline, report_path, metrics_path)
    if not row["drift_detected"]:
        return row, None
    from modspark.plans.training import train_risk_model

    ens, m, _ = train_risk_model(training_set, "content_id", n_trees)
    version = "v" + datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S%f")
    ens.save(f"{model_dir.rstrip('/')}/{version}")
    # appended, never replaced: a scorer that loads meanwhile sees the old or the new version
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(
        f"{model_dir.rstrip('/')}/current"
    )
    auc = m.first()["auc"]
    log_metrics(spark, "auto_retrain", {"trigger": "drift_detected", "version": version}, "param", path=metrics_path)
    log_metrics(spark, "auto_retrain", {"retrain_auc": auc}, path=metrics_path)
    return row, version


def current_version(spark: SparkSession, model_dir: str) -> str | None:
    """The latest published version (versions sort by time), or None."""
    from modspark.sources.readers import path_exists

    path = f"{model_dir.rstrip('/')}/current"
    if not path_exists(spark, path):
        return None
    return spark.read.schema("version string").json(path).agg(F.max("version")).first()[0]


def load_current(spark: SparkSession, model_dir: str):
    from modspark.operators.risk import Ensemble

    v = current_version(spark, model_dir)
    if v is None:
        raise FileNotFoundError(f"no published model under {model_dir}")
    return Ensemble.load(f"{model_dir.rstrip('/')}/{v}")
