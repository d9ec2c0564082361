"""Audit log reading, statistics, drift, dashboard, tail."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modspark.operators import dashboard as db
from modspark.operators import monitor as mo
from modspark.sources.readers import read_audit, read_audit_strict

AS_OF = datetime(2024, 1, 31, 0, 0, 0)


def rec(i, hours_ago, action="approved", risk=0.1, **extra):
    ts = (AS_OF - timedelta(hours=hours_ago)).isoformat()
    r = {"content_id": f"c{i}", "user_id": "u1", "action": action, "risk_score": risk, "timestamp": ts,
         "content_preview": "x", "status": "s", "message": "m"}
    r.update(extra)
    return r


def write_lines(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.json"), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_audit_bad_lines(spark, tmpdir_fresh):
    lines = [
        json.dumps(rec(1, 1)),
        "{not json",
        json.dumps([rec(2, 1)]),
        "",
        json.dumps({**rec(3, 1), "timestamp": ""}),
        json.dumps({k: v for k, v in rec(4, 1).items() if k != "timestamp"}),
        json.dumps({k: v for k, v in rec(5, 1).items() if k != "action"}),
        json.dumps({**rec(6, 1), "risk_score": None}),
        json.dumps(rec(7, 30)),
    ]
    write_lines(tmpdir_fresh, lines)
    all_rows = read_audit(spark, tmpdir_fresh)
    assert sorted(r.content_id for r in all_rows.collect()) == ["c1", "c5", "c6", "c7"]
    recent = read_audit(spark, tmpdir_fresh, AS_OF, 24)
    assert sorted(r.content_id for r in recent.collect()) == ["c1", "c5", "c6"]
    # dashboard: missing action counts as unknown, NULL risk ignored
    s = db.summary(recent, AS_OF, 24).first()
    assert s.total == 3 and s.actions == {"approved": 2, "unknown": 1}
    assert s.avg_risk_score == pytest.approx(0.1)
    # strict read fails on the bad lines
    with pytest.raises(Exception):
        read_audit_strict(spark, tmpdir_fresh).collect()


def test_missing_log_is_empty(spark, tmpdir_fresh):
    df = read_audit(spark, os.path.join(tmpdir_fresh, "absent"), AS_OF, 24)
    assert df.count() == 0
    s = mo.score_stats(df, AS_OF, 24).first()
    assert s["count"] == 0 and s["mean"] is None
    d = db.summary(df, AS_OF, 24).first()
    assert d.total == 0 and d.actions == {} and d.avg_risk_score == 0.0


def _audit(spark, rows):
    return spark.createDataFrame(
        [(r["content_id"], r["action"], r["risk_score"], datetime.fromisoformat(r["timestamp"])) for r in rows],
        "content_id string, action string, risk_score double, ts timestamp",
    )


def test_one_row_stats(spark):
    df = _audit(spark, [rec(1, 1, "auto_remove", 0.9)])
    s = mo.score_stats(df, AS_OF, 24).first()
    assert s["count"] == 1 and s["std"] is None and s["p50"] == 0.9 and s["pct_removed"] == 100.0


def test_percentiles_linear(spark):
    df = _audit(spark, [rec(i, 1, "approved", v) for i, v in enumerate([0.1, 0.4, 0.9])] + [rec(9, 1, "approved", None)])
    s = mo.score_stats(df, AS_OF, 24).first()
    assert (s["p50"], s["p90"], s["p99"]) == (0.4, 0.8, 0.89)
    # NULL score rows still count in the denominators of the shares
    assert s["pct_approved"] == 100.0 and s["rows"] == 4 and s["count"] == 3


@pytest.mark.parametrize("shift,detected", [(0.15, False), (0.1501, True)])
def test_drift_shift(spark, shift, detected):
    # disjoint windows with constant scores: mean shift is exact
    rows = [rec(i, 30, "approved", 0.2) for i in range(5)] + [rec(10 + i, 2, "approved", round(0.2 + shift, 4)) for i in range(5)]
    d = mo.drift_report(_audit(spark, rows), AS_OF, baseline="disjoint").first()
    assert d.mean_shift == pytest.approx(shift)
    assert d.drift_detected is detected
    assert d.recommendation == ("retrain" if detected else "monitor")


def test_drift_overlapping_halves_shift(spark):
    rows = [rec(i, 30, "approved", 0.2) for i in range(5)] + [rec(10 + i, 2, "approved", 0.6) for i in range(5)]
    o = mo.drift_report(_audit(spark, rows), AS_OF, baseline="overlapping").first()
    d = mo.drift_report(_audit(spark, rows), AS_OF, baseline="disjoint").first()
    assert d.mean_shift == pytest.approx(0.4) and o.mean_shift == pytest.approx(0.2)


def test_drift_one_side_empty(spark):
    rows = [rec(i, 30, "approved", 0.2) for i in range(5)]
    d = mo.drift_report(_audit(spark, rows), AS_OF, baseline="disjoint").first()
    assert d.drift_detected is False and d.reason == "insufficient data" and d.mean_shift is None


def test_timeline_sums_to_total(spark):
    import random

    rnd = random.Random(1)
    acts = ["approved", "auto_remove", "warn_user", "flag_for_review"]
    rows = [rec(i, rnd.uniform(0, 30), rnd.choice(acts), rnd.random()) for i in range(200)]
    df = _audit(spark, rows)
    total = db.summary(df, AS_OF, 24).first().total
    long = db.timeline(df, AS_OF, 24).agg(F.sum("n")).first()[0]
    wide = db.timeline_wide(df, AS_OF, 24)
    wsum = wide.select(sum(F.col(c) for c in wide.columns if c != "time").alias("s")).agg(F.sum("s")).first()[0]
    assert total == long == wsum
    times = [r.time for r in db.timeline(df, AS_OF, 24).collect()]
    assert times == sorted(times)


def test_tail(spark):
    rows = [rec(i, 50 - i, "approved", 0.1) for i in range(30)]
    t = [r.content_id for r in db.tail(_audit(spark, rows), 5).collect()]
    assert t == ["c25", "c26", "c27", "c28", "c29"]
    assert db.tail(_audit(spark, rows), 0).count() == 0


def test_lookback_pushdown(spark):
    from modspark.sources.bindings import AS_OF as BAS_OF
    from modspark.sources.tables import table

    e = table(spark, "/root/testdata/sf0.01", "events").select("event_id", "ts")
    plan = mo.lookback(e, BAS_OF, 24)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ts" in plan.split("PushedFilters")[1][:200]
