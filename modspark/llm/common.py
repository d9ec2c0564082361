"""Shared helpers: table access, tables stored in the shared folder, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.session import checkpoint_dir

BATCH_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the
    lineage (a lost executor re-reads it) and gives Spark its true size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text modulo ``n`` (a null key counts as '')."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def give_back() -> None:
    """Return what Arrow has freed to the system.  Python workers outlive
    their tasks and stages; its memory pool would keep it in each of them."""
    pa.default_memory_pool().release_unused()


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, done: Callable[[], None] | None = None
) -> DataFrame:
    """One output batch per input batch, in slices of bounded text bytes: a
    batch of very long texts is cut into smaller ones, a text never.
    ``done`` runs at a task's end (to let go of what its worker holds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                yield fn(part)
            give_back()
        if done is not None:
            done()
        give_back()

    return df.mapInArrow(run, schema)


def slices(b: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    n = b.num_rows
    if n == 0:
        return
    step = max(1, int(n * limit / max(limit, b.nbytes)))
    for i in range(0, n, step):
        yield b.slice(i, step)


def texts(col: pa.Array) -> list[str]:
    """Python strings of a text column (null: empty)."""
    return [t or "" for t in col.to_pylist()]


def batch(schema: list[tuple[str, pa.DataType]], *cols) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for (_, t), c in zip(schema, cols)]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(schema))
