"""Structured Streaming forms of the batch operators.

The column functions are the batch ones; only event-time state differs:
watermarks bound it.  Spark guarantees that rows within the watermark delay
are never dropped; rows behind it may or may not be aggregated (a window
already closed is emitted again only in update mode), and deduplication (X5)
bounds its state by the watermark but lets a late row through.  Every
``start_*`` names its own checkpoint folder (shared by all executors): two
queries never share one, and a restarted query resumes with exactly-once
file output.

Event time must be ``timestamp`` (not ``timestamp_ntz``) for watermarks;
``event_time`` casts it (session time zone UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.operators import monitor as mo
from modspark.operators import triage


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


# X1 ------------------------------------------------------------------------


def scoring_stream(content: DataFrame, lexicon: DataFrame | list, users: DataFrame | None = None, **signals) -> DataFrame:
    """X1 transform: stateless scoring of a content stream into audit
    records, by the batch ``score_content`` and ``decide`` themselves
    (``signals``: image_scores, ensemble or probabilities).  Borderline
    rows get the no-response fallback (flag for review); their prompts are
    written by ``review_queue_stream`` for an offline reviewer, whose results
    merge back through the batch ``decide``."""
    from modspark.plans.moderate import audit_records, decide, score_content

    return audit_records(decide(score_content(content, lexicon=lexicon, users=users, **signals)))


def review_queue_stream(content: DataFrame, lexicon: DataFrame | list, users: DataFrame | None = None, **signals) -> DataFrame:
    from modspark.operators.review import review_queue
    from modspark.plans.moderate import score_content

    s = triage.with_route(score_content(content, lexicon=lexicon, users=users, **signals))
    return review_queue(s)


def start_audit_sink(records: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """X1 sink: audit records appended as JSON lines, partitioned by date."""
    out = records.drop("ts").withColumn("dt", F.to_date(F.to_timestamp("timestamp")))
    w = (
        out.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("dt")
        .outputMode("append")
    )
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()


def start_published_audit(records: DataFrame, path: str, checkpoint: str, name: str, trigger_once: bool = True, fmt: str = "json"):
    """X1 sink into a log of published batches (S6): every micro-batch is one
    batch named by the stream and its epoch, so an epoch that is run again
    after a failure is in the log once, and batch jobs may append to the same
    log between epochs."""
    from modspark.sources.sinks import write_audit

    def each(batch: DataFrame, epoch: int) -> None:
        write_audit(batch.drop("ts"), path, fmt, f"{name}-{epoch:012d}")

    w = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()


# X2 ------------------------------------------------------------------------


def hourly_counts(audit: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Tumbling 1-hour counts per action; final once the watermark passes."""
    a = event_time(audit).withWatermark("ts", watermark)
    g = a.groupBy(F.window("ts", "1 hour"), F.coalesce(F.col("action"), F.lit("unknown")).alias("action"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(
        F.date_format(F.col("window.start"), "yyyy-MM-dd HH:00").alias("time"), "action", "n"
    )


# X3 ------------------------------------------------------------------------


def sliding_stats(audit: DataFrame, window: str = "24 hours", slide: str = "6 hours", watermark: str = "1 hour") -> DataFrame:
    """The drift statistics per sliding window (exact percentile runs as
    a streaming aggregate too)."""
    a = event_time(audit).withWatermark("ts", watermark)
    return mo.sliding_stats(a, window, slide)


# X4 ------------------------------------------------------------------------


def user_velocity(posts: DataFrame, window: str = "24 hours", slide: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Posts per user per sliding 24 h window.  Streaming has no
    row-relative range frame, so this approximates W1 (which stays the
    batch truth) by windows aligned to the slide."""
    p = event_time(posts).withWatermark("ts", watermark)
    g = p.groupBy(F.window("ts", window, slide), "user_id").agg(F.count(F.lit(1)).alias("posts"))
    return g.select(
        F.date_format(F.col("window.end"), "yyyy-MM-dd HH:mm").alias("window_end"), "user_id", "posts"
    )


# X5 ------------------------------------------------------------------------


def dedupe(stream: DataFrame, key: str = "content_id", watermark: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries of a content id within the watermark."""
    return event_time(stream).withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


# X6 ------------------------------------------------------------------------


def start_drift_checks(
    trigger_stream: DataFrame,
    audit_loader,
    checkpoint: str,
    as_of_col: str = "ts",
    report_path: str | None = None,
):
    """Run the drift check for every micro-batch of ``trigger_stream``
    (e.g. a rate source or new audit files), at the latest event time of the
    batch.  ``audit_loader(spark)`` returns the audit table to check."""
    from modspark.plans.retrain import run_drift_check

    def each(batch: DataFrame, epoch: int) -> None:
        latest = batch.agg(F.max(F.col(as_of_col).cast("timestamp")).alias("m")).first()["m"]
        if latest is not None:
            run_drift_check(batch.sparkSession, audit_loader(batch.sparkSession), latest, report_path=report_path)

    return (
        trigger_stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_memory(df: DataFrame, name: str, mode: str = "append"):
    """Drive a streaming frame to completion into a memory table (tests, demos)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_of(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """A parquet file stream (one file per trigger by default)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
