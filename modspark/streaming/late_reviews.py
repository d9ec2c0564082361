"""X1 with reviewers who answer later: decisions stream ⟕ response stream.

A queued decision waits for answers for ``wait`` in event time; then it leaves
with the smallest of its answers, or with the no-response fallback, through
the batch ``with_decisions``.  Rows that need no review leave at once.

The join is a watermarked stream-stream left outer join with a time bound, so
its state holds decisions and answers no longer than the wait and the
watermarks.  Several answers to one content meet in a grouped minimum keyed by
the decision, which closes with the same watermark.

Defined cases: an answer before its decision's time, later than the wait, or to
no queued content counts for nothing; an answer without text, content or time
is ignored; a decision without a time cannot wait and takes the fallback at
once; contents are expected once an id (``jobs.dedupe`` sees to it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.operators import triage
from modspark.plans.moderate import with_decisions
from modspark.schemas import TRIAGE_AUTO_APPROVE, TRIAGE_AUTO_REMOVE

def in_time(decisions: DataFrame, responses: DataFrame, wait: str = "2 hours") -> DataFrame:
    """Batch form of the time bound: the responses that count."""
    d = decisions.select(F.col("content_id").alias("_id"), F.col("ts").cast("timestamp").alias("_ts"))
    at = F.col("answered_at")
    near = (at >= F.col("_ts")) & (at <= F.col("_ts") + F.expr(f"INTERVAL {wait}"))
    return responses.join(d, (F.col("content_id") == F.col("_id")) & near, "left_semi")


def decide_stream(
    scored: DataFrame, responses: DataFrame, wait: str = "2 hours", watermark: str = "10 minutes",
    auto_remove: float = TRIAGE_AUTO_REMOVE, auto_approve: float = TRIAGE_AUTO_APPROVE, model: str = "external",
) -> DataFrame:
    """Stream of decisions.  ``scored`` as from ``score_content`` with a
    ``ts``; ``responses`` has ``content_id, raw, answered_at``."""
    routed = triage.with_route(scored.withColumn("ts", F.col("ts").cast("timestamp")), "risk_score", auto_remove, auto_approve)
    waits = (F.col("route") == F.lit("agent_review")) & F.col("ts").isNotNull() & F.col("content_id").isNotNull()
    none = {"raw": F.lit(None).cast("string"), "answered_at": F.lit(None).cast("timestamp")}
    at_once = routed.filter(~waits).withColumns(none)

    rest = [c for c in routed.columns if c not in ("content_id", "ts")]
    queue = routed.filter(waits).select("content_id", "ts", F.struct(*rest).alias("_row")).withWatermark("ts", watermark)
    told = responses.select(
        F.col("content_id").alias("_id"), "raw", F.col("answered_at").cast("timestamp").alias("answered_at")
    ).filter(F.col("_id").isNotNull() & F.col("raw").isNotNull() & F.col("answered_at").isNotNull())
    told = told.withWatermark("answered_at", watermark)
    near = (F.col("answered_at") >= F.col("ts")) & (F.col("answered_at") <= F.col("ts") + F.expr(f"INTERVAL {wait}"))
    joined = queue.join(told, (F.col("content_id") == F.col("_id")) & near, "leftOuter")
    answer = F.when(F.col("raw").isNotNull(), F.struct("raw", "answered_at"))
    one = joined.groupBy("content_id", "ts", "_row").agg(F.min(answer).alias("_a"))
    reviewed = one.select("content_id", "ts", "_row.*", F.col("_a.raw").alias("raw"), F.col("_a.answered_at").alias("answered_at"))
    every = reviewed.select(*at_once.columns).unionByName(at_once)
    return with_decisions(every, model, spread_rows=False)
