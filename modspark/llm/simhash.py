"""SimHash near-duplicates by a segment-popcount embedding.

A text's 64-bit fingerprint has a bit set if it is set in over half of the
XXH64 (seed 42) hashes of the text's word shingles.  Distinct fingerprints
are mapped to the bit counts of their 32 two-bit segments: the Manhattan
distance of two such count vectors is never above the fingerprints' bit
distance, so it is a lower bound.

Range join: the segments are cut into max_bits // 3 + 1 blocks, so two
fingerprints within max_bits differ by at most 2 (Manhattan) in some block.
Grid cells are the block's count vectors; each fingerprint enters its own
cell and the cells at distance one, and two vectors at distance two or less
always share a cell.  Rows meet by cell; pairs are filtered by the lower
bound over all segments, then by the exact bit distance.  A task emits only
a spanning forest of the links that it found, never the pairs of a group.

Fingerprints are dealt by hash, ``TASK_NODES`` a task, before they enter their
cells (about fifty each): a stored table of them is so small that a few tasks
read it all, whose cell counts would grow with the input.

Cells with more than 1/100,000 of all rows (and at least ``HOT_CELL``) are
hot: there are at most 100,000 of them, so their list is broadcast, and
their members are dealt into chunks that meet two at a time.

Defined cases: null or empty text has fingerprint zero, linked like any
other; fewer words than a shingle: the whole word sequence; a null id never
names a component unless all ids of the component are null; repeated rows
each get a row; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, stored, texts
from .graph import components, forest

SEED = 42
HOT_CELL = 4096
HOT_SHARE = 100_000
CHUNK = 2048
TASK_NODES = 1 << 13
_LOW = np.uint64(0x5555555555555555)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, shingle: int = 4) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    h, seed = xxhash.xxh64_intdigest, SEED
    hashes = [h(whole[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    b = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    if len(b) < 256:
        ones = np.unpackbits(b, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(b[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, fp): the fingerprint as a signed long."""
    types = dict(docs.dtypes)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in texts(b.column(len(keep)))], np.uint64)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return map_batches(docs.select(*keep, text), fn, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", fp long")


def counts(fp: np.ndarray) -> np.ndarray:
    """The 32 two-bit fields hold the bit counts (0 to 2) of the segments."""
    return fp - ((fp >> np.uint64(1)) & _LOW)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed counts: equal fields 00, neighbours have
    their low bit set in the xor, 0 against 2 only the high bit."""
    x = a ^ b
    low, high = x & _LOW, (x >> np.uint64(1)) & _LOW
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)


def cells(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell key, row) of every cell that each fingerprint enters."""
    blocks = max_bits // 3 + 1
    wide = -(-32 // blocks)
    p = counts(fp)
    keys, rows = [], []
    for k in range(blocks):
        lo, n = k * wide, min(wide, 32 - k * wide)
        part = (p >> np.uint64(2 * lo)) & np.uint64((1 << 2 * n) - 1)
        tag = np.uint64(k << 2 * wide) if blocks > 1 else np.uint64(0)
        keys.append(part | tag)
        rows.append(np.arange(len(fp)))
        for i in range(n):
            one = np.uint64(1 << 2 * i)
            field = (part >> np.uint64(2 * i)) & np.uint64(3)
            for step, ok in ((one, field < 2), (~one + np.uint64(1), field > 0)):
                at = np.flatnonzero(ok)
                keys.append((part[at] + step) | tag)
                rows.append(at)
    return np.concatenate(keys), np.concatenate(rows)


def _links(fp: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = fp[i], fp[j]
    near = manhattan(counts(a), counts(b)) <= max_bits
    a, b = a[near], b[near]
    same = np.bitwise_count(a ^ b) <= max_bits
    return a[same], b[same]


def link_cells(key: np.ndarray, fp: np.ndarray, max_bits: int, lag: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links inside the cells of a sorted run of rows.  Cells
    of up to ``lag`` rows are compared by shifting all rows at once, larger
    ones by blocks."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size_at = np.repeat(size, size)
    left = np.repeat(start + size, size) - np.arange(len(key)) - 1  # rows after this one in its cell
    row = np.flatnonzero((size_at > 1) & (size_at <= lag))
    for d in range(1, lag):
        row = row[left[row] >= d]
        if not len(row):
            break
        found.append(_links(fp, row, row + d, max_bits))
    for s, n in zip(start[size > lag].tolist(), size[size > lag].tolist()):
        mine: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, n, 256):
            for j in range(i, n, 4096):
                x, y = np.arange(s + i, s + min(i + 256, n)), np.arange(s + j, s + min(j + 4096, n))
                r, c = np.nonzero(np.bitwise_count(fp[x][:, None] ^ fp[y][None, :]) <= max_bits)
                keep = x[r] < y[c]
                mine.append(_links(fp, x[r[keep]], y[c[keep]], max_bits))
            if sum(len(a) for a, _ in mine) > 1 << 18:
                mine = [forest(*map(np.concatenate, zip(*mine)))]
        found += mine
    if not found:
        return fp[:0], fp[:0]
    return forest(*map(np.concatenate, zip(*found)))


def links(nodes: DataFrame, max_bits: int = 4, fp: str = "fp") -> DataFrame:
    """``nodes`` of distinct fingerprints -> edges (a, b) whose connected
    components are those of all links at ``max_bits`` or fewer."""
    spark = nodes.sparkSession

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                f = b.column(0).slice(i, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                key, row = cells(f, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(f[row].view(np.int64))], names=["cell", "fp"])
        give_back()

    n_nodes = nodes.count()
    spread = nodes.select(F.col(fp).alias("fp")).repartition(-(-n_nodes // TASK_NODES) or 1, "fp")
    rows = spread.mapInArrow(enter, "cell long, fp long")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(sizes.filter(F.col("n") >= HOT_CELL), "simhash-hot")
    # hot cells hold at least 1/HOT_SHARE of the rows: at most HOT_SHARE of them
    total = n_nodes * len(cells(np.zeros(1, np.uint64), max_bits)[0]) * 2
    hot = hot.filter(F.col("n") >= total / HOT_SHARE).withColumn("s", F.ceil(F.col("n") / CHUNK)).select("cell", "s")
    mine = F.pmod(F.xxhash64("fp"), F.col("s"))
    chunks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda j: F.least(j, mine) * F.col("s") + F.greatest(j, mine)
    )
    dealt = rows.join(F.broadcast(hot), "cell", "left").select(
        "cell", "fp", F.explode(F.when(F.col("s").isNull(), F.array(F.lit(0).cast("long"))).otherwise(chunks)).alias("deal")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush(last: bool):
            nonlocal held, n
            cell, deal, f = map(np.concatenate, zip(*held))
            new = np.r_[True, (cell[1:] != cell[:-1]) | (deal[1:] != deal[:-1])]
            end = len(cell) if last else np.flatnonzero(new)[-1]
            held = [(cell[end:], deal[end:], f[end:])]
            n = len(cell) - end
            a, b = link_cells(np.cumsum(new[:end]), f[:end].view(np.uint64), max_bits) if end else (f[:0], f[:0])
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(k).to_numpy() for k in range(3)))
                n += b.num_rows
                if n >= 1 << 19:
                    yield flush(False)
        if n:
            yield flush(True)
        give_back()

    met = dealt.select("cell", "deal", "fp").repartition("cell", "deal").sortWithinPartitions("cell", "deal")
    return met.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id that links reach), ``component`` (the smallest fingerprint, as
    a signed number, that links reach) and the columns in ``keep``."""
    fps = stored(fingerprints(docs, text, shingle, (id_col, *keep)), "simhash-fp")
    nodes = stored(fps.groupBy("fp").agg(F.min(id_col).alias("low")), "simhash-nodes")
    linked = components(links(nodes, max_bits))
    linked = linked.join(nodes, linked["node"] == nodes["fp"]).select("fp", "root", "low")
    roots = linked.groupBy("root").agg(F.min("low").alias("component_low"))
    moved = linked.join(roots, "root").select("fp", "root", "component_low")
    named = nodes.join(moved, "fp", "left").select(
        "fp",
        F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("component_low")).alias("component_id"),
        F.coalesce("root", "fp").alias("component"),
    )
    return fps.join(named, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", *keep
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document of each class left: the one with
    the smallest id (among equal ids, the smallest text hash)."""
    # the columns of ``docs`` travel as one struct: no name can clash
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("c"), F.struct(*docs.columns).alias("row"))
    near = near_duplicates(rows, "id", "text", shingle, max_bits, keep=("c",))
    first = near.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("id", "c")).alias("m"))
    first = stored(first.select(F.col("m.id").alias("_i"), F.col("m.c").alias("_k")), "simhash-first")
    kept = rows.join(first, rows["id"].eqNullSafe(F.col("_i")) & (rows["c"] == F.col("_k")), "left_semi")
    return kept.dropDuplicates(["id", "c"]).select("row.*")
