"""Streamed decisions with late answers equal the batch ones over the answers
that came in time."""

import json
import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from modspark.plans.moderate import decide
from modspark.streaming.late_reviews import decide_stream, in_time
from modspark.streaming.state import state_settings

BASE = datetime(2024, 1, 1, 9)
SCORED = "content_id string, ts timestamp, risk_score double, severity string, band_action string"
TOLD = "content_id string, raw string, answered_at timestamp"


def scored_rows(n=60):
    risks = [0.1, 0.5, 0.6, 0.9, 0.35, 0.79]
    return [(f"c{k}", BASE + timedelta(minutes=3 * k), risks[k % 6], "high", "flag_for_review") for k in range(n)]


def answer(k, text="flag"):
    return json.dumps({"verdict": text, "confidence": 0.9, "severity": "high", "reasoning": "r", "key_factors": ["a"],
                       "recommended_action": "auto_remove", "needs_human_review": False})


def answers(rows):
    out = []
    for k, (cid, ts, risk, *_) in enumerate(rows):
        if k % 5 == 0:
            continue  # no answer
        late = timedelta(hours=3) if k % 7 == 0 else timedelta(minutes=20 + k % 3)
        out.append((cid, answer(k) if k % 4 else "I would remove this.", ts + late))
        if k % 6 == 1:
            out.append((cid, answer(k, "approve"), ts + timedelta(minutes=50)))  # a second answer
        if k % 11 == 0:
            out.append((cid, answer(k), ts - timedelta(minutes=1)))  # before its decision
    return out + [("nobody", answer(0), BASE), (None, answer(0), BASE), ("c1", None, BASE + timedelta(minutes=5)), ("c2", answer(2), None)]


def flat(df):
    keep = df.filter("content_id NOT LIKE 'end%'").select(
        "content_id", "route", "final_action", "review_status", "agent_model", "reviewed_at", F.to_json("review").alias("review")
    )
    rows = [tuple(r) for r in keep.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_late_answers_over_a_restart(spark, tmpdir_fresh):
    src, told, out, ck = (os.path.join(tmpdir_fresh, x) for x in ("src", "told", "out", "ck"))
    rows = scored_rows()
    replies = sorted(answers(rows), key=lambda r: r[2] or BASE)
    everything = [*rows, ("untimed", None, 0.5, "high", "flag_for_review")]

    def write(data, ddl, path):
        spark.createDataFrame(data, ddl).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.05)

    def run():
        s = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(src)
        r = spark.readStream.schema(TOLD).option("maxFilesPerTrigger", 1).parquet(told)
        with state_settings(spark):
            q = decide_stream(s, r, model="m").writeStream.format("parquet").option("path", out)
            q = q.option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    cut = BASE + timedelta(minutes=90)
    write([r for r in rows if r[1] <= cut], SCORED, src)
    write([r for r in replies if (r[2] or BASE) <= cut], TOLD, told)
    run()
    early = flat(spark.read.parquet(out))
    write([r for r in everything if r[1] is None or r[1] > cut], SCORED, src)
    write([r for r in replies if (r[2] or BASE) > cut], TOLD, told)
    end = BASE + timedelta(days=2)
    write([("end1", end, 0.9, "x", "x")], SCORED, src)
    write([("end1", "x", end)], TOLD, told)
    write([("end2", end + timedelta(hours=9), 0.5, "x", "x")], SCORED, src)
    write([("end2", "x", end + timedelta(hours=9))], TOLD, told)
    run()
    got = flat(spark.read.parquet(out))
    batch = spark.createDataFrame(everything, SCORED)
    timely = in_time(batch, spark.createDataFrame(replies, TOLD))
    assert got == flat(decide(batch, responses=timely, model="m"))
    assert early and early < got
    by_id = {r[0]: r for r in got}
    assert by_id["c14"][3] == "error" and by_id["untimed"][3] == "error"  # c14 was answered too late
    assert by_id["c1"][4] == "m" and by_id["c1"][5].startswith("2024-01-01T09:")
    assert by_id["c8"][3] == "parse_error" and by_id["c8"][4] is None and by_id["c8"][5]
