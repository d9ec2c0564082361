"""Statistics from partials equal those of the raw log; the strict tail keeps
the log's order; a review run goes on where it stopped."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modspark.operators import dashboard as db
from modspark.operators import monitor as mo
from modspark.operators import partials as pt
from modspark.operators.review_log import ReviewLog, Tokens, ask
from modspark.sources.readers import tail_audit

AT = datetime(2024, 1, 31)


def audit(spark, n=400):
    rows = [
        (f"c{k}", ["approved", "auto_remove", None, "own"][k % 4], None if k % 13 == 0 else (k * 37 % 10001) / 10000, AT - timedelta(minutes=11 * k + 1),
         "flag" if k % 5 == 0 else None, k % 7 == 0)
        for k in range(n)
    ]
    return spark.createDataFrame(rows, "content_id string, action string, risk_score double, ts timestamp, agent_verdict string, human_review boolean")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_partials_equal_the_raw_log(spark, tmpdir_fresh):
    log = audit(spark)
    parts = pt.Partials(spark, f"{tmpdir_fresh}/p")
    n = F.substring("content_id", 2, 9).cast("int")
    assert parts.update(log.filter(n % 2 == 0), "even") and parts.update(log.filter(n % 2 == 1), "odd")
    assert not parts.update(log.filter(n % 2 == 1), "odd")  # a repeated batch counts once

    def same():
        assert rows(pt.score_stats(parts, AT)) == rows(mo.score_stats(log, AT))
        for baseline in ("overlapping", "disjoint"):
            assert rows(pt.drift_report(parts, AT, baseline=baseline)) == rows(mo.drift_report(log, AT, baseline=baseline))
        cols = sorted(db.summary_rows(log, AT).columns)
        assert rows(pt.summary_rows(parts, AT).select(cols)) == rows(db.summary_rows(log, AT).select(cols))
        assert rows(pt.timeline(parts, AT)) == rows(db.timeline(log, AT))

    same()
    assert parts.compact() and len(parts.table.batches()) == 1
    same()
    empty = AT + timedelta(days=9)
    assert pt.score_stats(parts, empty).first()["count"] == 0 and pt.score_stats(parts, empty).first()["mean"] is None
    assert pt.drift_report(parts, empty).first().reason == "insufficient data"
    with pytest.raises(ValueError):
        pt.score_stats(parts, AT + timedelta(minutes=7))
    plan = pt.score_stats(parts, AT)._jdf.queryExecution().executedPlan().toString()
    assert f"{tmpdir_fresh}/p/data" in plan  # the log is not read


def record(i):
    return json.dumps({"content_id": f"c{i}", "action": "approved", "risk_score": 0.1, "timestamp": "2024-01-30T00:00:00"})


def test_tail_in_log_order(spark, tmpdir_fresh):
    path = f"{tmpdir_fresh}/log"
    assert tail_audit(spark, path).count() == 0
    for day, name, ids in (("2024-01-29", "a", range(5)), ("2024-01-30", "z", [9, 5]), ("2024-01-30", "b", [7, 30, 2])):
        os.makedirs(f"{path}/dt={day}", exist_ok=True)
        with open(f"{path}/dt={day}/{name}.json", "w") as f:
            f.write("\n".join([record(i) for i in ids]) + "\n")
        stamp = {"a": 1, "z": 2, "b": 3}[name]
        os.utime(f"{path}/dt={day}/{name}.json", (1_700_000_000 + stamp, 1_700_000_000 + stamp))
    with open(f"{path}/dt=2024-01-29/a.json") as f:
        old = f.read()
    with open(f"{path}/dt=2024-01-29/a.json", "w") as f:
        f.write("{broken\n" + old)
    os.utime(f"{path}/dt=2024-01-29/a.json", (1_700_000_001, 1_700_000_001))

    def ids(n):
        return [r.content_id for r in tail_audit(spark, path, n).collect()]

    assert ids(3) == ["c7", "c30", "c2"] and ids(4) == ["c5", "c7", "c30", "c2"]
    assert ids(10) == ["c0", "c1", "c2", "c3", "c4", "c9", "c5", "c7", "c30", "c2"]
    assert ids(0) == []
    with pytest.raises(Exception):
        ids(11)  # the eleventh line is broken


def counting(path, broken=None):
    def call(prompt):
        with open(path, "a") as f:
            f.write(prompt + "\n")
        if broken and prompt == broken:
            raise ConnectionError("no reviewer")
        return f"answer to {prompt}"

    return call


def test_review_run_goes_on_where_it_stopped(spark, tmpdir_fresh):
    calls, path = f"{tmpdir_fresh}/calls", f"{tmpdir_fresh}/log"
    queue = spark.createDataFrame([(f"c{k}", f"p{k}") for k in range(60)] + [("c1", "p1"), (None, "p"), ("x", None)], "content_id string, prompt string")
    log = ReviewLog(spark, path)
    with pytest.raises(Exception):
        log.run(queue, counting(calls, "p31"), partitions=3, retries=1, backoff=0.0, chunk=4)
    answered = log.all().count()
    assert 0 < answered < 60
    left = log.pending(queue).count()
    assert left == 60 - answered
    assert log.run(queue, counting(calls), partitions=3, chunk=4) == left
    assert log.run(queue, counting(calls)) == 0
    with open(calls) as f:
        seen = f.read().split()
    assert sorted(set(seen)) == sorted(f"p{k}" for k in range(60))
    # answered prompts are called once, the failing one twice (a retry) and once more
    assert {p: seen.count(p) for p in set(seen) if seen.count(p) != 1} == {"p31": 3}
    got = {r.content_id: r.raw for r in log.responses().collect()}
    assert len(got) == 60 and got["c31"] == "answer to p31"
    # a changed prompt is asked again and its answer counts
    again = spark.createDataFrame([("c1", "p1 changed"), ("c2", "p2")], "content_id string, prompt string")
    assert log.run(again, counting(calls)) == 1
    assert {r.content_id: r.raw for r in log.responses().collect()}["c1"] == "answer to p1 changed"


def test_keep_going_leaves_failures_pending(spark, tmpdir_fresh):
    queue = spark.createDataFrame([(f"c{k}", f"p{k}") for k in range(10)], "content_id string, prompt string")
    log = ReviewLog(spark, f"{tmpdir_fresh}/log")
    assert log.run(queue, counting(f"{tmpdir_fresh}/calls", "p3"), retries=0, keep_going=True) == 9
    assert [r.content_id for r in log.pending(queue).collect()] == ["c3"]


def test_tokens_and_backoff():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    t = Tokens(2.0, lambda: now[0], sleep)
    for _ in range(6):
        t.take()
    assert now[0] == pytest.approx(2.0) and len(slept) == 4  # two at once, then two a second
    tries = []

    def call(p):
        tries.append(p)
        if len(tries) < 3:
            raise OSError
        return "ok"

    slept.clear()
    assert ask(call, "p", Tokens(None), 3, 0.5, sleep) == ("ok", 3) and slept == [0.5, 1.0]
    with pytest.raises(OSError):
        ask(lambda p: (_ for _ in ()).throw(OSError()), "p", Tokens(None), 1, 0.0, sleep)


def test_ordered_log_is_written_by_many_tasks(spark, monkeypatch):
    from modspark.plans import queries as Q
    from modspark.sources import sinks

    most, write_audit = [], sinks.write_audit

    def spy(records, *args, **kwargs):
        spark_ids = records.select("content_id", F.spark_partition_id().alias("p"))
        sizes = [r["count"] for r in spark_ids.groupBy("p").count().collect()]
        most.append(max(sizes) / sum(sizes))
        return write_audit(records, *args, **kwargs)

    monkeypatch.setattr(sinks, "write_audit", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        rows = Q.audit_tail_log(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(rows) == 40 and len(most) == 3 and max(most) < 0.5  # 1.0 before
