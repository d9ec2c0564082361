"""Exact removal of repeated passages by sharded suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else
(same document included) is removed.  All such strings are called windows.

1. Sharding.  A window's key is the smallest hash of its ``GRAM``-byte grams,
   so equal windows have equal keys.  Neighbouring windows with the same key
   form a run; runs tile the windows of a text.  Equal runs are counted
   map-side as one class, so copies (of documents or of passages) cost one
   row a task.  A class seen twice is repeated as a whole; a key with one
   class seen once, without the gram twice inside, holds nothing repeated.
2. Sorting.  The bytes of the classes under all other keys are dealt by key
   and sorted by external induced suffix sorting (``induced_sort``) in shards
   of whole keys; windows that share their full length with a neighbour in
   suffix order are repeated.
3. A key with more than ``HOT_CLASSES`` classes (a very common passage with
   ever new surroundings) or ``HOT_BYTES`` bytes of classes (long stretches of
   one repeated character or line) is not sorted in one shard, so a shard has
   at most ``SHARD_BYTES`` + ``HOT_BYTES``: its windows are counted by 128-bit
   hash over all tasks, a row a different window of a class, combined
   map-side, which is exact up to hash collisions.
4. Repeated stretches are carried back to every document that has the class.

Defined cases: null or empty text has no bytes and nothing removed; texts
under LENGTH bytes are kept whole; repeated rows are copies of each other and
lose all they share; a null id is kept (rows are told apart by id and text
hash); extra columns are ignored; no rows give no rows.  Texts are never cut:
texts over ``CHUNK`` bytes are hashed in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, stored
from .induced_sort import repeated_starts

LENGTH, GRAM = 400, 32
CHUNK = 4 << 20
SHARD_BYTES = 4 << 20
HOT_CLASSES, HOT_BYTES = 6_000, SHARD_BYTES
PIECE = 1 << 12
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(a: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Mixed hashes of all ``gram``-byte grams (a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h, p, n = (a.astype(np.uint64) + np.uint64(1)) * _MIX, 0x100000001B3, 1
        while n < gram:
            h = h[:-n] * np.uint64(p) + h[n:]
            p, n = p * p % (1 << 64), n * 2
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from running minima of blocks."""
    n = len(h) - w + 1
    x = np.full(-(-len(h) // w) * w, np.uint64(2**64 - 1))
    x[: len(h)] = h
    x = x.reshape(-1, w)
    ahead = np.minimum.accumulate(x, 1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int, bool]]:
    """(key, hash of the bytes, first byte, end byte, key gram twice inside)
    of the runs of a text; hashes as signed longs."""
    out = []
    span = length - gram + 1
    view = memoryview(data)
    for at in range(0, len(data) - length + 1, CHUNK):
        a = np.frombuffer(view[at : at + CHUNK + length - 1], np.uint8)
        h = gram_hashes(a, gram)
        m = sliding_min(h, span)
        start = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        keys = m[start]
        for s, e, k, key in zip(start.tolist(), np.r_[start[1:], len(m)].tolist(), keys, keys.view(np.int64).tolist()):
            twice = np.count_nonzero(h[s : e - 1 + span] == k) > 1
            lo, hi = at + s, at + e - 1 + length
            body = xxhash.xxh64_intdigest(view[lo:hi])
            out.append((key, body - (1 << 64) if body >> 63 else body, lo, hi, twice))
    return out


def _bytes(col: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in col.to_pylist()]


def _runs_table(docs: DataFrame, id_col: str, length: int) -> DataFrame:
    """(id, c, n_bytes, whole, runs): one pass over the texts."""
    id_type = dict(docs.dtypes)[id_col]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["key", "body", "s", "e", "twice"]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        data = _bytes(b.column(2))
        found = [runs(d, length) for d in data]
        flat = list(zip(*(r for f in found for r in f))) or [()] * 5
        ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds)], names=names)
        whole = pa.array([hashlib.sha256(d).hexdigest() for d in data])
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(d) for d in data], pa.int64()), whole, pa.ListArray.from_arrays(ends, rows)],
            names=[id_col, "c", "n_bytes", "whole", "runs"],
        )

    schema = (
        f"`{id_col}` {id_type}, c long, n_bytes long, whole string, "
        "runs array<struct<key:long,body:long,s:int,e:int,twice:boolean>>"
    )
    return map_batches(docs, fn, schema)


def _bodies(docs: DataFrame, need: DataFrame, id_col: str) -> DataFrame:
    """(key, body, n, hot, data): the bytes of the classes in ``need``."""
    lists = need.groupBy(F.col(id_col).alias("_i"), F.col("c").alias("_c")).agg(
        F.collect_list(F.struct("key", "body", "n", "hot", "s", "e")).alias("want")
    )
    rows = docs.join(lists, docs[id_col].eqNullSafe(F.col("_i")) & (docs["c"] == F.col("_c"))).select("text", "want")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data, want in zip(_bytes(b.column(0)), b.column(1).to_pylist()):
            out += [(w["key"], w["body"], w["n"], w["hot"], data[w["s"] : w["e"]]) for w in want]
        kinds = [pa.int64()] * 3 + [pa.bool_(), pa.binary()]
        cols = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "body", "n", "hot", "data"])

    return map_batches(rows, fn, "key long, body long, n long, hot boolean, data binary")


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_MARKS = "key long, body long, spans array<struct<a:int,b:int>>"


def _spans(marked: np.ndarray, length: int) -> list[dict]:
    """Byte stretches covered by the windows that start at marked places."""
    edge = np.flatnonzero(np.diff(np.r_[False, marked, False]))
    return [{"a": a, "b": b - 1 + length} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _sort_shards(bodies: DataFrame, length: int) -> DataFrame:
    """Suffix-sort whole keys in shards; rows for classes seen once."""

    def shard(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        text = np.zeros(sum(len(d) + 1 for *_, d in rows), np.uint16)
        at, places = 0, []
        for *_, d in rows:
            text[at : at + len(d)] = np.frombuffer(d, np.uint8)
            text[at : at + len(d)] += 1
            places.append(at)
            at += len(d) + 1
        marked = repeated_starts(text, length)
        out = []
        for (key, body, n, d), at in zip(rows, places):
            if n == 1 and (found := _spans(marked[at : at + len(d) - length + 1], length)):
                out.append((key, body, found))
        cols = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), _SPANS))], names=["key", "body", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for whole in batches:
            for b in slices(whole):
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if rows and rows[-1][:2] == row[:2]:
                        continue  # the same class from a repeated row
                    if size >= SHARD_BYTES and row[0] != rows[-1][0]:
                        yield shard(rows)
                        rows, size = [], 0
                    rows.append(row)
                    size += len(row[3])
        if rows:
            yield shard(rows)

    dealt = bodies.select("key", "body", "n", "data").repartition("key").sortWithinPartitions("key", "body")
    return dealt.mapInArrow(run, _MARKS)


def _count_windows(bodies: DataFrame, length: int) -> DataFrame:
    """The windows of hot keys, counted by 128-bit hash."""
    steps = [*range(0, length - GRAM, GRAM), length - GRAM]
    names = ["key", "body", "n", "at", "till", "x", "y", "k"]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 3

    def windows(key: int, body: int, n: int, data: bytes) -> list[tuple]:
        """Columns: each different window of a class with its number there,
        and the stretches of starts of those seen twice (no hash)."""
        h = gram_hashes(np.frombuffer(data, np.uint8))
        k = len(data) - length + 1
        x, y = np.zeros(k, np.uint64), np.zeros(k, np.uint64)
        with np.errstate(over="ignore"):
            for s in steps:
                x = (x ^ (x >> np.uint64(27))) * _MIX + h[s : s + k]
                y = (y ^ (y >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F) + (h[s : s + k] ^ _MIX)
        order = np.lexsort((y, x))
        sx, sy = x[order], y[order]
        first = np.flatnonzero(np.r_[True, (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1])])
        times = np.diff(np.r_[first, k])
        again = np.zeros(k, bool)
        again[order] = np.repeat(times > 1, times)
        edge = np.flatnonzero(np.diff(np.r_[False, again, False]))
        none = pa.nulls(len(edge) // 2, pa.int64())
        at = order[first]
        one, two = len(at), len(none)
        return [
            (np.full(one, key), np.full(one, body), np.full(one, n), at, at + 1, sx[first].view(np.int64), sy[first].view(np.int64), times),
            (np.full(two, key), np.full(two, body), np.full(two, n), edge[::2], edge[1::2], none, none, np.full(two, 2)),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 18):
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    for cols in windows(*row):
                        out = pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, kinds)], names=names)
                        yield from (out.slice(i, 1 << 16) for i in range(0, out.num_rows, 1 << 16))

    def join(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for p, starts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            marked = np.zeros(PIECE, bool)
            marked[np.array(starts) - p * PIECE] = True
            found.append([{"a": x["a"] + p * PIECE, "b": x["b"] + p * PIECE} for x in _spans(marked, length)])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, _SPANS)], names=["key", "body", "spans"])

    one = bodies.select("key", "body", "n", "data").dropDuplicates(["key", "body"])
    rows = stored(one.mapInArrow(run, "key long, body long, n long, at int, till int, x long, y long, k long"), "suffix-hot-windows")
    twice = rows.filter("x IS NOT NULL").groupBy("x", "y").agg(F.sum("k").alias("k")).filter("k > 1").select("x", "y")
    hit = rows.filter("n = 1 AND k = 1").join(twice, ["x", "y"])
    # a class's starts in pieces of bounded length
    pieces = hit.groupBy("key", "body", F.floor(F.col("at") / PIECE).alias("p")).agg(F.collect_list("at").alias("starts"))
    span = F.struct(F.col("at").alias("a"), (F.col("till") - 1 + length).alias("b"))
    own = rows.filter("n = 1 AND x IS NULL").select("key", "body", F.array(span).alias("spans"))
    return map_batches(pieces, join, _MARKS).unionByName(own)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
    hot_classes: int = HOT_CLASSES, hot_bytes: int = HOT_BYTES,
):
    """(rows, spans): ``rows`` is (id, c, n_bytes, whole) of every document,
    ``spans`` (id, c, spans) of those with something to remove, as byte
    stretches that may overlap."""
    src = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("c", F.xxhash64("text"))
    table = stored(_runs_table(src.select(id_col, "c", "text"), id_col, length), "suffix-runs")
    each = table.select(id_col, "c", F.inline("runs"))
    classes = stored(
        each.groupBy("key", "body").agg(
            F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), *(F.first(x).alias(x) for x in (id_col, "c", "s", "e"))
        ),
        "suffix-classes",
    )
    keys = classes.groupBy("key").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("seen"), F.max("twice").alias("any"), F.sum(F.col("e") - F.col("s")).alias("size")
    )
    big = ((F.col("classes") > hot_classes) | (F.col("size") > hot_bytes)).alias("hot")
    live = stored(classes.join(keys.filter("seen > 1 OR any").select("key", "classes", big), "key"), "suffix-live")
    need = live.filter("classes > 1 OR (twice AND n = 1)")
    bodies = stored(_bodies(src.select(id_col, "c", "text"), need, id_col), "suffix-bodies")
    marks = _sort_shards(bodies.filter("NOT hot"), length).unionByName(
        live.filter("n > 1").select(
            "key", "body", F.array(F.struct(F.lit(0).alias("a"), (F.col("e") - F.col("s")).alias("b"))).alias("spans")
        )
    )
    hot = bodies.filter("hot")
    if not hot.isEmpty():
        marks = marks.unionByName(_count_windows(hot, length))
    marks = stored(marks, "suffix-marks")
    placed = each.join(marks, ["key", "body"]).select(
        id_col, "c", F.transform("spans", lambda x: F.struct((x["a"] + F.col("s")).alias("a"), (x["b"] + F.col("s")).alias("b"))).alias("spans")
    )
    spans = placed.groupBy(id_col, "c").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return table.select(id_col, "c", "n_bytes", "whole"), spans


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if
    asked, ``kept``, the remaining bytes (a cut may split a character)."""
    rows, spans = repeated_spans(docs, id_col, text, length)
    spans = stored(spans, "suffix-spans").select(F.col(id_col).alias("_i"), F.col("c").alias("_c"), "spans")
    id_type = dict(docs.dtypes)[id_col]
    src = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("c", F.xxhash64("text"))

    def same(df):
        return df[id_col].eqNullSafe(F.col("_i")) & (df["c"] == F.col("_c"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data, found in zip(_bytes(b.column(1)), b.column(2).to_pylist()):
            merged = merge_spans([(x["a"], x["b"]) for x in found or ()])
            at, parts = 0, []
            for s, e in merged:
                parts.append(data[at:s])
                at = e
            kept = b"".join([*parts, data[at:]])
            out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    if with_kept:
        return map_batches(src.join(spans, same(src), "left").select(id_col, "text", "spans"), fn, schema)
    cut = map_batches(src.join(spans, same(src)).select(id_col, "text", "spans"), fn, schema)
    zero = F.lit(0).cast("long")
    other = rows.join(spans, same(rows), "left_anti").select(
        id_col, "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("whole").alias("kept_sha256")
    )
    return cut.drop("kept").unionByName(other)
