"""Audit records: status/message of an action, preview, review fields, and
the record projection written by the audit sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.functions.text import preview
from modspark.schemas import ACTION_STATUS, UNKNOWN_MESSAGE_PREFIX, UNKNOWN_STATUS


def action_status(action: Column) -> Column:
    expr = None
    for act, (status, _) in ACTION_STATUS.items():
        c = action == F.lit(act)
        expr = F.when(c, F.lit(status)) if expr is None else expr.when(c, F.lit(status))
    return expr.otherwise(F.lit(UNKNOWN_STATUS))


def action_message(action: Column) -> Column:
    expr = None
    for act, (_, msg) in ACTION_STATUS.items():
        c = action == F.lit(act)
        expr = F.when(c, F.lit(msg)) if expr is None else expr.when(c, F.lit(msg))
    # f-string of None prints "None"
    return expr.otherwise(F.concat(F.lit(UNKNOWN_MESSAGE_PREFIX), F.coalesce(action, F.lit("None"))))


def with_status(df: DataFrame, action_col: str = "action") -> DataFrame:
    """``status`` and ``message`` of the action."""
    a = F.col(action_col)
    return df.withColumn("status", action_status(a)).withColumn("message", action_message(a))


def iso(ts: Column) -> Column:
    """ISO-8601 text of a UTC timestamp, microseconds always printed."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def audit_records(decisions: DataFrame, review_col: str = "review") -> DataFrame:
    """One audit row per decision.

    Input columns: content_id, user_id, final_action, risk_score, ts, text and
    (optionally) the ``review`` struct.  Review fields are NULL when no review
    exists; otherwise key_factors defaults to [] and needs_human_review to false.
    """
    has_review = review_col in decisions.columns
    r = F.col(review_col) if has_review else F.lit(None)
    present = r.isNotNull() if has_review else F.lit(False)
    out = decisions.select(
        F.col("content_id"),
        F.col("user_id"),
        F.col("final_action").alias("action"),
        F.col("risk_score").cast("double").alias("risk_score"),
        iso(F.col("ts")).alias("timestamp"),
        preview(F.col("text")).alias("content_preview"),
        F.col("ts"),
        *(
            [
                F.when(present, r["verdict"]).alias("agent_verdict"),
                F.when(present, r["reasoning"]).alias("agent_reasoning"),
                F.when(present, F.coalesce(r["key_factors"], F.array().cast("array<string>"))).alias("agent_factors"),
                F.when(present, F.coalesce(r["needs_human_review"], F.lit(False))).alias("human_review"),
            ]
            if has_review
            else [
                F.lit(None).cast("string").alias("agent_verdict"),
                F.lit(None).cast("string").alias("agent_reasoning"),
                F.lit(None).cast("array<string>").alias("agent_factors"),
                F.lit(None).cast("boolean").alias("human_review"),
            ]
        ),
    )
    out = with_status(out, "action")
    return out.select(
        "content_id", "user_id", "action", "risk_score", "timestamp", "content_preview",
        "status", "message", "agent_verdict", "agent_reasoning", "agent_factors", "human_review", "ts",
    )
