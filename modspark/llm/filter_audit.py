"""Audit of how document filters interact, by incremental streaming.

Five filters mark a text: A under 100 words, B under 80 % distinct words,
C over 10 % capital letters, D one of the symbols ``#$%&*|``, E identical to
the text of a smaller id anywhere in the table.  What any order of filters
keeps and removes follows from how many documents have which set of failed
filters (a mask of five bits), so the audit keeps counters a part (language)
and mask.

Files are read as available-now micro-batches.  A narrow pass turns each text
into its mask of A-D and its digest, joins the labels and combines the rows of
a text within its task (a hot text is one row a task and part from there on,
not one a document).  State keyed by text (kept in buckets of some thousand
texts, so that one call serves them) holds the smallest id seen and the
documents that have it.  All documents of a text fail E but those; when a
smaller id arrives the earlier ones are retracted (their old mask leaves the
counters, the mask with E enters) and the new ones take their place.  The
deltas go to an append-only file sink with its own commit log, so a restarted
audit counts every file once; the counters are the sums of the deltas.  Calling
``update`` again with the same folder takes in the files that are new.

Defined cases: a null text is empty, a null part the empty string; a null id
is neither smaller nor larger than another, so its row never fails E and
fails no other; rows with equal ids are not smaller than each other; several
label rows of an id count as their maximum, null labels as 0; empty tables
give no rows; extra columns are ignored.  Ids are integers.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import map_batches, scratch, stored

# The filters in the order of their bits, and their limits.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
E_BIT = 16
DIGEST = 32  # hex digits of SHA-256 that tell texts apart (128 bits)
HELD = 100_000  # texts combined in a task before they are passed on
BATCHES = 8
BUCKET_BYTES = 16 << 20  # of the files of an audit's first run, a bucket of texts
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no disk set aside for every partition
}


def text_mask(text: str) -> tuple[int, str]:
    """Failed filters A-D as bits, and the digest of the text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    mask = (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text)) << 2
        | (SYMBOLS.search(data) is not None) << 3
    )
    return mask, hashlib.sha256(data).hexdigest()[:DIGEST]


def _masked(docs: DataFrame, id_col: str, text: str, part: str) -> DataFrame:
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        masks, keys = zip(*(text_mask(t or "") for t in b.column(2).to_pylist()))
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(keys)], names=["id", "part", "mask", "key"]
        )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return map_batches(rows, fn, "id long, part string, mask int, key string")


_ROW = [("key", pa.string()), ("mask", pa.int32()), ("part", pa.string()), ("flags", pa.int32()), ("known", pa.bool_()),
        ("id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]
_ROW_DDL = "key string, mask int, part string, flags int, known boolean, id long, at long, n long"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text, part and labels within a task as one: the smallest id,
    the rows that have it, all rows.  Null ids are told apart (not known)."""
    held: dict[tuple, list] = {}

    def flush() -> pa.RecordBatch:
        cols = zip(*((*k, *v) for k, v in held.items()))
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _ROW)], schema=pa.schema(_ROW))
        held.clear()
        return out

    for b in batches:
        for i, part, mask, key, flags in zip(*(c.to_pylist() for c in b.columns)):
            k, i = (key, mask, part, flags, i is not None), i or 0
            v = held.get(k)
            if v is None:
                held[k] = [i, 1, 1]
            else:
                v[2] += 1
                if i < v[0]:
                    v[0], v[1] = i, 1
                elif i == v[0]:
                    v[1] += 1
        if len(held) > HELD:
            yield flush()
    if held:
        yield flush()


def step(rows: list[tuple], least: int | None, held: list[list]) -> tuple[int | None, list[list], dict]:
    """One text's new rows (part, flags, known, id, at, n) against its state:
    (smallest id, [[part, flags, documents that have it]], deltas of the
    documents by (part, flags, fails E))."""
    delta: dict[tuple, int] = {}

    def add(part, flags, fails, n):
        delta[part, flags, fails] = delta.get((part, flags, fails), 0) + n

    known = [r for r in rows if r[2]]
    for part, flags, is_known, _, _, n in rows:
        add(part, flags, bool(is_known), n)
    now = min([r[3] for r in known] + ([] if least is None else [least]), default=None)
    have = {(p, f): n for p, f, n in held}
    if least is not None and now < least:
        for (part, flags), n in have.items():
            add(part, flags, False, -n)
            add(part, flags, True, n)
        have = {}
    for part, flags, _, i, at, _ in known:
        if i == now:
            have[part, flags] = have.get((part, flags), 0) + at
            add(part, flags, True, -at)
            add(part, flags, False, at)
    return now, [[p, f, n] for (p, f), n in have.items()], {k: n for k, n in delta.items() if n}


_DELTA = "part string, mask int, flags int, n long"


def _retract(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A bucket's new rows against its texts' state; gives the deltas of the
    bucket, added up."""
    texts: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    new: dict[str, list] = {}
    masks: dict[str, int] = {}
    for f in frames:
        for text, mask, *row in zip(*(f[c].tolist() for c in ("key", "mask", "part", "flags", "known", "id", "at", "n"))):
            new.setdefault(text, []).append(row)
            masks[text] = mask
    delta: dict[tuple, int] = {}
    for text, rows in new.items():
        least, held, changes = step(rows, *texts.get(text, (None, [])))
        if least is not None:
            texts[text] = [least, held]
        for (part, flags, fails), n in changes.items():
            k = (part, masks[text] | (E_BIT if fails else 0), flags)
            delta[k] = delta.get(k, 0) + n
    state.update((json.dumps(texts, separators=(",", ":")),))
    yield pd.DataFrame([(*k, n) for k, n in delta.items() if n], columns=["part", "mask", "flags", "n"]).astype(
        {"part": "object", "mask": "int32", "flags": "int32", "n": "int64"}
    )


def _flags(labels: DataFrame, id_col: str) -> DataFrame:
    def bit(c: str):
        return F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))

    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("lid")).agg(
        (bit("quality") + 2 * bit("toxic")).alias("flags")
    )


def deltas(
    stream: DataFrame, labels: DataFrame, buckets: int, id_col: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """The stream of counter changes (part, mask, flags, n) of a stream of
    documents; flags: 1 good, 2 toxic."""
    marks = _masked(stream, id_col, text, part)
    marks = marks.join(labels, F.col("id") == F.col("lid"), "left").select(
        "id", "part", "mask", "key", F.coalesce("flags", F.lit(0)).alias("flags")
    )
    rows = marks.mapInArrow(_combine, _ROW_DDL).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(_retract, _DELTA, "texts string", "append", GroupStateTimeout.NoTimeout)


def _buckets(docs: DataFrame, folder: str) -> int:
    """The number of buckets an audit was begun with: one for BUCKET_BYTES of
    files, and four a partition of its first run at least."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    rows = [(max(size // BUCKET_BYTES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))),)]
    spark.createDataFrame(rows, "buckets long").coalesce(1).write.mode("ignore").parquet(f"{folder}/buckets")
    return spark.read.schema("buckets long").parquet(f"{folder}/buckets").first().buckets


def update(
    spark: SparkSession, path: str, labels: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", part: str = "lang",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Take in the files under ``path`` that the audit in ``folder`` (shared
    by all executors) has not seen, in micro-batches, and return its counters
    (part, mask, n, good, toxic).  By default a batch holds an eighth of the
    files, so batches grow with the table."""
    docs = spark.read.parquet(path)
    if files_per_batch is None:
        files_per_batch = max(1, -(-len(docs.inputFiles()) // BATCHES))
    # as a pattern, a path may be one file as well as a folder of files
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    changes = deltas(stream, stored(_flags(labels, id_col), "filter-labels"), _buckets(docs, folder), id_col, text, part)
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:  # a query keeps the settings it started with
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        query = (
            changes.writeStream.format("parquet").option("path", f"{folder}/deltas")
            .option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    query.awaitTermination()
    return counters(spark.read.schema(_DELTA).parquet(f"{folder}/deltas"))


def counters(changes: DataFrame) -> DataFrame:
    n = F.sum("n")
    of = F.sum(F.when(F.col("flags").bitwiseAND(1) > 0, F.col("n")).otherwise(0))
    toxic = F.sum(F.when(F.col("flags").bitwiseAND(2) > 0, F.col("n")).otherwise(0))
    return changes.groupBy("part", "mask").agg(n.alias("n"), of.alias("good"), toxic.alias("toxic"))


def _orders() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of all permutations, and for each the 0/1 rows that pick
    the masks of each figure."""
    masks = np.arange(1 << len(FILTERS))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows, pick = [], {k: [] for k in ("kept", "removed", "redundant", "unique")}
    for order in map("".join, itertools.permutations(FILTERS)):
        earlier = 0
        for k, f in enumerate(order):
            fails, gone = masks & bit[f] > 0, masks & earlier > 0
            rows.append((order, k + 1))
            pick["kept"].append(masks & (earlier | bit[f]) == 0)
            pick["removed"].append(fails & ~gone)
            pick["redundant"].append(fails & gone)
            pick["unique"].append(masks == bit[f])
            earlier |= bit[f]
    return rows, {k: np.array(v).astype(np.int64) for k, v in pick.items()}


_REPORT = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [
    (c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
]
_REPORT_DDL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def report(counts: DataFrame) -> DataFrame:
    """600 rows a part: every order of the filters and step of it."""
    order, pick = _orders()
    names, steps = [o for o, _ in order], [s for _, s in order]
    letter = np.array([FILTERS.index(o[s - 1]) for o, s in order])
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.array("n", "good", "toxic"))))
    parts = counts.groupBy("part").agg(cells.alias("cells"))  # at most 32 masks a part
    rows = parts.select("part", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.col("cells")[m]).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, cells in zip(*(c.to_pylist() for c in b.columns)):
                n, good, toxic = np.array([c or (0, 0, 0) for c in cells], np.int64).T
                removed = pick["removed"] @ n
                total = np.zeros(len(FILTERS), np.int64)
                np.add.at(total, letter, removed)
                cols = [
                    [part] * len(names), names, steps, pick["kept"] @ n, removed, pick["redundant"] @ n, pick["unique"] @ n,
                    pick["removed"] @ good, pick["removed"] @ toxic, total[letter],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _REPORT)], schema=pa.schema(_REPORT))

    return rows.filter(F.exists("cells", lambda c: c[0] > 0)).mapInArrow(run, _REPORT_DDL)


def audit(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, **kwargs) -> DataFrame:
    """The report over all files under ``path`` (a new audit without a folder)."""
    return report(update(spark, path, labels, folder or scratch(spark, "filter-audit"), **kwargs))
