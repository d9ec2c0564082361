"""Readers: labelled text corpus (CSV), audit log (JSON lines or Parquet),
labelled image vectors.  Schemas are fixed; nothing is inferred.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.functions.text import WHITESPACE
from modspark.operators.monitor import lookback
from modspark.operators.text_scores import any_label
from modspark.operators.vectors import encode_label
from modspark.schemas import AUDIT, CORPUS_LABELS, LABELLED_CORPUS, VECTORS
from modspark.session import path_exists
from modspark.sources.published import PLACE, Published
from modspark.sources.quoted_csv import read_quoted_csv, typed


# ---------------------------------------------------------------------------
# S1 labelled CSV
# ---------------------------------------------------------------------------


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with quoted multi-line text.  NULL text becomes ''.
    The six label columns must all be present (checked on the header, before
    any data job); the error names the missing ones.  Adds ``label`` (P6).

    Files are read in splits although records may span lines
    (``sources.quoted_csv``)."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    missing = [c for c in CORPUS_LABELS if c not in header]
    if missing:
        raise ValueError(f"Dataset is missing expected columns: {missing}")
    if "comment_text" not in header:
        raise ValueError("Dataset is missing expected columns: ['comment_text']")
    df = typed(read_quoted_csv(spark, path, header), LABELLED_CORPUS)
    df = df.fillna({"comment_text": ""})
    return any_label(df.select(*[f.name for f in LABELLED_CORPUS.fields], *[c for c in df.columns if c not in LABELLED_CORPUS.fieldNames()]))


def to_scorer_names(df: DataFrame) -> DataFrame:
    """Corpus label names -> scorer label names."""
    return df.withColumnRenamed("identity_hate", "identity_attack").withColumnRenamed(
        "severe_toxic", "severe_toxicity"
    ).withColumnRenamed("toxic", "toxicity")


# ---------------------------------------------------------------------------
# S2 / S3 audit log
# ---------------------------------------------------------------------------


def _empty_audit(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], AUDIT).withColumn("ts", F.lit(None).cast("timestamp"))


def parse_audit_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON-lines text -> audit rows.  Lines that are not a JSON object
    (malformed, arrays, blank) and records without a parseable timestamp are
    skipped, as the lenient readers of the log do."""
    v = F.col(col)
    # valid JSON whose first non-blank character is "{" is an object
    first = F.substring(F.trim(v, F.lit(WHITESPACE)), 1, 1)
    is_object = (first == F.lit("{")) & F.try_parse_json(v).isNotNull()
    extra = [c for c in lines.columns if c != col]  # e.g. the ``dt`` partition column
    rows = lines.filter(F.coalesce(is_object, F.lit(False))).select(F.from_json(v, AUDIT).alias("r"), *extra)
    rows = rows.select("r.*", *extra)
    rows = rows.withColumn("ts", F.try_to_timestamp(F.col("timestamp")))
    return rows.filter(F.col("ts").isNotNull())


def read_audit(
    spark: SparkSession,
    path: str,
    as_of: datetime | str | None = None,
    hours: int | None = None,
    fmt: str = "json",
) -> DataFrame:
    """The audit log, optionally restricted to ``ts >= as_of - hours``.
    A missing log is an empty frame.  For the partitioned layout written by
    ``sinks.write_audit`` the ``dt`` predicate prunes whole partitions.  Of a
    log written in published batches only those are read."""
    if not path_exists(spark, path):
        return _empty_audit(spark)
    table = Published(spark, path)
    published = table.exists()
    if fmt == "parquet":
        typed = T.StructType([*AUDIT.fields, T.StructField("ts", T.TimestampType())])
        df = table.read(typed, fmt) if published else spark.read.parquet(path)
        if "ts" not in df.columns:
            df = df.withColumn("ts", F.try_to_timestamp(F.col("timestamp")))
        df = df.filter(F.col("ts").isNotNull())
    else:
        df = parse_audit_lines(table.lines() if published else spark.read.text(path))
    if as_of is not None and hours is not None:
        df = lookback(df, as_of, hours)
    return df


def read_audit_strict(spark: SparkSession, path: str) -> DataFrame:
    """S3 source: every line must be a JSON object (FAILFAST)."""
    if not path_exists(spark, path):
        return _empty_audit(spark)
    df = spark.read.schema(AUDIT).option("mode", "FAILFAST").json(path)
    return df.withColumn("ts", F.to_timestamp("timestamp"))


def tail_audit(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """S3: the last ``n`` records of a written log (JSON lines) in the order of
    the log, oldest first, with their ``ts``: newest date folder first, then
    the files by the time they were written and their names, then the lines.
    Only as many of the newest folders are read as hold ``n`` lines.  Strict:
    one of these lines that is no JSON object fails the read; older lines are
    not looked at.  A missing log has no records."""
    if n <= 0 or not path_exists(spark, path):
        return _empty_audit(spark).limit(0)
    table = Published(spark, path)
    lines = table.lines(place=True) if table.exists() else spark.read.text(path).selectExpr("*", *PLACE)
    dated = "dt" in lines.columns
    if dated:
        days = sorted({d for f in lines.inputFiles() for d in re.findall(r"/dt=([^/]+)/", f)}, reverse=True)
        take = 1
        while take < len(days) and lines.filter(F.col("dt").cast("string").isin(days[:take])).limit(n).count() < n:
            take *= 2
        lines = lines.filter(F.col("dt").cast("string").isin(days[:take]))
    order = (["dt"] if dated else []) + ["_written", "_file", "_block", "_line"]
    last = lines.withColumn("_line", F.monotonically_increasing_id()).orderBy(*[F.col(c).desc() for c in order]).limit(n)
    v = F.trim("value", F.lit(WHITESPACE))
    text = F.when(v.startswith("{"), v).otherwise(F.raise_error(F.concat(F.lit("not a JSON object in the audit log: "), F.col("value"))))
    rows = last.orderBy(*order).select(F.from_json(text, AUDIT, {"mode": "FAILFAST"}).alias("r"))
    return rows.select("r.*").withColumn("ts", F.to_timestamp("timestamp"))


# ---------------------------------------------------------------------------
# S5 labelled vectors
# ---------------------------------------------------------------------------


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(id, embedding, label)`` with ``label_int`` = 1 for 'nsfw'."""
    df = spark.read.schema(VECTORS).parquet(path)
    return df.withColumn("label_int", encode_label(F.col("label")))
