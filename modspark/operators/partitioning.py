"""Execution shape of CPU-heavy per-row work: parallelism and evaluating
expensive columns exactly once.

A small input (one file, one row group) is scanned by one task; scoring whole
texts or vectors in that task leaves the other cores idle.  ``spread`` gives
such work one task per core, up to ``MAX_SPREAD`` tasks.  An input of more
than ``MAX_SPREAD`` splits (4 GB at the default split size) is never touched,
however many cores there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MAX_SPREAD = 32


def _bytes(conf_value: str) -> int:
    v = conf_value.strip().lower()
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    for suffix in ("kb", "mb", "gb", "tb", "k", "m", "g", "t", "b"):
        if v.endswith(suffix):
            return int(float(v[: -len(suffix)]) * units[suffix[0]])
    return int(v)


def spread(df: DataFrame, *keys: str, min_partitions: int | None = None) -> DataFrame:
    """Repartition to one task per core when the largest input relation fits
    in fewer splits than that (by the optimizer's size estimate); a large
    input (or an unknown size) is left as it is.  Nothing runs."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    target = min_partitions or min(spark.sparkContext.defaultParallelism, MAX_SPREAD)
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    if largest_input_bytes(df) >= split * target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


def sized(df: DataFrame, task_bytes: int, *keys: str) -> DataFrame:
    """Repartition by ``keys`` into one partition per ``task_bytes`` of the
    largest input, and at least as many as a shuffle has: for rows that expand
    within the tasks, whose number must grow with the input.  An input of
    unknown size gets the partitions of a shuffle.  Nothing runs."""
    known, least = largest_input_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = -(-known // task_bytes) if known < 1 << 50 else 0
    return df.repartition(max(n, least), *keys)


def dealt(df: DataFrame, task_rows: int) -> DataFrame:
    """Stored rows (a checkpoint) dealt evenly over one task per ``task_rows``
    of them, stored again: for rows that are passed over many times, whose
    tasks must follow their number, not their few bytes.  Rows of one such
    task, or in that many tasks already, stay as they are."""
    want = -(-df.count() // task_rows)
    if want <= max(df.rdd.getNumPartitions(), 1):
        return df
    return df.repartition(want).checkpoint(eager=True)


def gathered(df: DataFrame, rows: int, task_rows: int) -> DataFrame:
    """Stored ``rows`` (a checkpoint) in no more tasks than one per core and
    one per ``task_rows``: nearly empty tasks cost every pass their start."""
    want = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))
    return df.coalesce(want) if want < df.rdd.getNumPartitions() else df


def largest_input_bytes(df: DataFrame) -> int:
    """The size estimate of the largest scanned relation of ``df`` (no job
    runs).  A leaf's estimate (e.g. the files' size) does not depend on the
    plan above it, so the analyzed plan is enough - no optimizer pass."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return max((int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())), default=0)


def computed_once(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Add expensive columns through a one-row-per-row generator.

    A later filter on such a column (e.g. the triage route of a score) would
    otherwise be pushed below the projection with the column's whole
    definition substituted into it, re-running the text or vector work in
    the filter and again in the projection.  Predicates on generator output
    are not pushed below the ``Generate``, so each expression runs once per
    row.  The generator is narrow and code-generated.
    """
    packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
    keep = [F.col(c) for c in df.columns if c not in exprs]  # same-named columns are replaced
    return df.select(*keep, F.inline(F.array(packed)))
