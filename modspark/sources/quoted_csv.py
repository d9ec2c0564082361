"""CSV with quoted line breaks, read in splits.

Whether a line starts a record depends on the quotes of all lines before it:
within an odd number of them it goes on inside a quoted field.  The lines are
read by Spark's text source, which splits files of any size and any store, and
the question is settled in two steps:

1. the quotes of every split are counted (combined map-side, a row a split)
   and their running parity along each file tells how each split begins;
2. with it a task knows which of its lines start records, parses the records
   that lie whole in its split, and hands over what does not: the lines before
   its first start, and its last record if that is still open.  These pieces
   (two a split at most) are put together along the file and parsed.

Fields follow RFC 4180: a quote within a quoted field is doubled, separators
and line breaks may be quoted, an empty field is NULL, quoted or not (as in
Spark's own reader).  Records with fewer fields than the header are filled with NULL, further
fields are dropped, blank lines are skipped.  Quotes must not stand bare in
unquoted fields (their parity would lie); ``\\r\\n`` ends are fine.
"""

from __future__ import annotations

import csv
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.session import checkpoint_dir

RECORD, HEAD, TAIL = 0, 1, 2
_PIECE = "kind int, file long, block long, text string, fields array<string>"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
_NAMES = ["kind", "file", "block", "text", "fields"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines in file order within each split."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _odd_splits(lines: DataFrame) -> set[tuple[int, int]]:
    """(file, block) of the splits that begin within a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = splits.withColumn("before", F.sum("n").over(before)).filter(F.col("before") % 2 == 1)
    found = odd.select("file", "block").toArrow()  # two numbers a split
    return set(zip(found["file"].to_pylist(), found["block"].to_pylist()))


def parse(records: list[str]) -> list[list[str | None]]:
    """Fields of whole records."""
    csv.field_size_limit(sys.maxsize)
    whole = (r[:-1] if r.endswith("\r") else r for r in records)
    return [[v or None for v in fields] for fields in csv.reader(whole)]


class _Split:
    """The lines of one split, batch by batch."""

    def __init__(self, file: int, block: int, odd: bool):
        self.file, self.block, self.inside = file, block, odd
        self.open: list[str] = []  # lines of the record (or head) that is going on
        self.head = odd

    def add(self, lines: list[str], quotes: np.ndarray) -> tuple[list[str], str | None]:
        """(records that end before the last start, the head if it ends here)."""
        inside = (int(self.inside) + np.cumsum(quotes)) % 2
        starts = np.flatnonzero(np.r_[int(self.inside), inside[:-1]] == 0)
        self.inside = bool(inside[-1])
        if not len(starts):
            self.open += lines
            return [], None
        done, head = ["\n".join([*self.open, *lines[: starts[0]]])] if self.open or starts[0] else [], None
        if self.head and done:
            head = done.pop()
        self.head = False
        done += ["\n".join(lines[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        self.open = lines[starts[-1] :]
        return done, head

    def end(self) -> tuple[int, str] | None:
        """What is open at the end: a head, a whole record or a tail."""
        if not self.open:
            return None
        text = "\n".join(self.open)
        return (HEAD if self.head else TAIL if self.inside else RECORD), text


def _cut(lines: DataFrame, odd: set[tuple[int, int]], kinds: tuple[int, ...]) -> DataFrame:
    """Records (parsed) and pieces of the wanted kinds."""
    shared = lines.sparkSession.sparkContext.broadcast(odd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, split: _Split, texts: list[str]) -> Iterator[pa.RecordBatch]:
            if kind in kinds and texts:
                fields = [None] * len(texts)
                if kind == RECORD:
                    fields, texts = parse(texts), [None] * len(texts)
                    fields = [f for f in fields if f]  # blank lines
                    texts = texts[: len(fields)]
                n = len(texts)
                cols = [[kind] * n, [split.file] * n, [split.block] * n, texts, fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

        split: _Split | None = None
        for b in batches:
            key = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                at = (int(key[0, lo]), int(key[1, lo]))
                if split is None or (split.file, split.block) != at:
                    if split is not None and (last := split.end()):
                        yield from rows(last[0], split, [last[1]])
                    split = _Split(*at, at in shared.value)
                part = b.column(0).slice(lo, hi - lo)
                done, head = split.add(part.to_pylist(), pc.count_substring(part, '"').to_numpy())
                if head is not None:
                    yield from rows(HEAD, split, [head])
                yield from rows(RECORD, split, done)
        if split is not None and (last := split.end()):
            yield from rows(last[0], split, [last[1]])

    return lines.mapInArrow(run, _PIECE)


def _joined(pieces: DataFrame) -> DataFrame:
    """Records put together from a tail and the heads after it."""
    along = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = pieces.withColumn("chain", F.sum((F.col("kind") == TAIL).cast("long")).over(along))
    parts = F.sort_array(F.collect_list(F.struct("block", F.col("kind"), "text")))
    whole = chained.groupBy("file", "chain").agg(F.min("block").alias("block"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, block, text in zip(*(c.to_pylist() for c in b.columns)):
                if found := [f for f in parse([text]) if f]:
                    cols = [[RECORD], [file], [block], [None], found[:1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    return whole.select("file", "block", "text").mapInArrow(run, _PIECE)


def read_quoted_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All records as text columns named ``columns``; a file's header record
    (equal to ``columns``, at its start) is left out.  Line breaks within
    fields are kept, so the rows equal those of the multi-line reader."""
    lines = _lines(spark, path)
    odd = _odd_splits(lines)
    records = _cut(lines, odd, (RECORD,))
    if odd:
        folder = f"{checkpoint_dir(spark).rstrip('/')}/csv-pieces-{uuid.uuid4().hex}"
        _cut(lines, odd, (HEAD, TAIL)).write.parquet(folder)
        records = records.unionByName(_joined(spark.read.schema(_PIECE).parquet(folder)))
    first = F.regexp_replace(F.col("fields")[0], "^\ufeff", "")
    is_header = (F.col("block") == 0) & (F.concat(F.array(first), F.slice("fields", 2, len(columns))) == F.array(*[F.lit(c) for c in columns]))
    rows = records.filter(~F.coalesce(is_header, F.lit(False)))
    return rows.select(*[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as the types of ``schema`` (text that is none is NULL)."""
    kinds = {f.name: f.dataType for f in schema.fields}
    return df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])
