"""Exact removal of repeated word passages by difference-cover anchors.

Every word covered by a ``window``-word sequence that also starts in a
document with a smaller id is removed (words are ``[^\\x20\\x09-\\x0D]+``).

1. Anchors.  ``COVER`` is a difference cover modulo ``PERIOD``: for any two
   positions i, j some shift below PERIOD takes both onto the cover.  Hashing
   only the sequences of ``window - PERIOD + 1`` words that start at cover
   positions (6 of 31) therefore gives any two equal windows an anchor in
   common, at the same place of both.
2. Heads.  Anchors are grouped by hash with minima and maxima only (combined
   map-side): smallest and largest document, smallest and largest hash of the
   whole context, the words any window around the anchor can reach.  Anchors
   of one document only are done with.
3. Extension.  Where all contexts of an anchor agree, every later document
   loses the whole context.  Elsewhere the occurrences fall into classes of
   equal contexts: a class's later documents lose the whole context again,
   and its first document is extended, a row a window around the anchor (each
   start of a document once); the smallest document of equal windows tells
   what it loses.  Work follows the number of different contexts, at most a
   row a word of their first documents, never the pairs of a group.
4. Stretches are brought together per document and cut from its words.

Equality is by two 64-bit hashes of word hashes (128 bits).

Defined cases: null text has no words; texts under ``window`` words are kept
whole; a null id has no order, so its rows neither lose nor cause anything;
rows with equal ids do not count as smaller than each other (they are told
apart by a hash of their text); extra columns are ignored; no rows give no
rows.  Texts are whole: very long ones are hashed in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

WINDOW = 50
# A perfect difference set modulo 31.
COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31
PIECE = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@lru_cache(maxsize=2)
def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of base ``k`` and of its inverse modulo 2^64."""
    base, inverse = _BASES[k], pow(_BASES[k], -1, 1 << 64)

    def run(b: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64)

    return run(base), run(inverse)


def _scramble(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


class Ranges:
    """Hashes of any stretches of a sequence of word hashes, from running
    sums of words times powers."""

    def __init__(self, words: np.ndarray, k: int):
        n = len(words)
        size = 1 << max(12, n.bit_length())
        power, self.inverse = _powers(k, size)
        with np.errstate(over="ignore"):
            own = words if k == 0 else _scramble(words + np.uint64(k))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[:n], dtype=np.uint64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _scramble((self.sums[end] - self.sums[start]) * self.inverse[start])


def split(text: str | None) -> list[bytes]:
    """Bytes of the words; ASCII white space is what ``bytes.split`` cuts at."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, hash of its context, position, words of context
    after it) at cover positions."""
    size, n = window - PERIOD + 1, len(words)
    reach = window - size
    out = []
    if n >= window:
        cover = np.array(COVER)
        for at in range(0, n - size + 1, PIECE):
            till = min(at + PIECE, n - size + 1)
            p = (np.arange(at // PERIOD, till // PERIOD + 1)[:, None] * PERIOD + cover).ravel()
            p = p[(p >= at) & (p < till)]
            low, high = max(0, at - reach), min(n, till + size + reach)
            one, two = (Ranges(words[low:high], k) for k in (0, 1))
            left, right = np.minimum(p, reach), np.minimum(n - p - size, reach)
            h = one.hash(p - low, p - low + size)
            c = two.hash(p - left - low, p + size + right - low)
            with np.errstate(over="ignore"):
                c ^= _scramble((left * (reach + 1) + right).astype(np.uint64) + np.uint64(1))
            out.append((h.view(np.int64), c.view(np.int64), p.astype(np.int32), right.astype(np.int16)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int16)
    return tuple(np.concatenate(x) for x in zip(*out))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _table(src: DataFrame, id_col: str, window: int) -> DataFrame:
    """(id, t, n_words, whole, anchors): one pass over the texts."""
    id_type = dict(src.dtypes)[id_col]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        n, whole, found = [], [], []
        for key, text in zip(b.column(0), b.column(2).to_pylist()):
            words = split(text)
            n.append(len(words))
            whole.append(_digest(words))
            found.append(anchors(word_hashes(words) if key.is_valid else np.zeros(0, np.uint64), window))
        rows = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["h", "c", "p", "right"])
        ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(whole), pa.ListArray.from_arrays(ends, rows)],
            names=[id_col, "t", "n_words", "whole", "anchors"],
        )

    schema = f"`{id_col}` {id_type}, t long, n_words long, whole string, anchors array<struct<h:long,c:long,p:int,right:smallint>>"
    return map_batches(src, fn, schema)


def _windows(src: DataFrame, places: DataFrame, id_col: str, window: int) -> DataFrame:
    """(r, id, s, x, y): every window around the anchors at ``places``
    (id, t, r, ps), each start of a row once."""
    size = window - PERIOD + 1
    reach = window - size
    id_type = dict(src.dtypes)[id_col]
    lists = places.withColumnsRenamed({id_col: "_i", "t": "_t"})
    rows = src.join(lists, (src[id_col] == F.col("_i")) & (src["t"] == F.col("_t"))).select("r", id_col, "text", "ps")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [(np.zeros(0, np.int64),) * 4]
        for row, (text, ps) in enumerate(zip(b.column(2).to_pylist(), b.column(3))):
            words = word_hashes(split(text))
            n, p = len(words), ps.values.to_numpy().astype(np.int64)
            edge = np.zeros(n + 2, np.int32)
            np.add.at(edge, np.maximum(p - reach, 0), 1)
            np.add.at(edge, np.minimum(p, n - window) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
            for low in range(0, n, PIECE):
                s = starts[(starts >= low) & (starts < low + PIECE)] - low
                if len(s):
                    one, two = (Ranges(words[low : low + PIECE + window], k) for k in (0, 1))
                    x, y = one.hash(s, s + window), two.hash(s, s + window)
                    out.append((np.full(len(s), row), s + low, x.view(np.int64), y.view(np.int64)))
        row, s, x, y = (np.concatenate(c) for c in zip(*out))
        row = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(row), b.column(1).take(row), pa.array(s).cast(pa.int32()), pa.array(x), pa.array(y)], names=["r", id_col, "s", "x", "y"]
        )

    return map_batches(rows, fn, f"r long, `{id_col}` {id_type}, s int, x long, y long")


def repeated_stretches(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW):
    """(rows, stretches): ``rows`` is (id, t, n_words, whole) of every row,
    ``stretches`` (id, t, spans) the word stretches [a, b) to remove of those
    that have some; they may overlap."""
    if window < 2 * PERIOD - 16:
        raise ValueError(f"windows of at least {2 * PERIOD - 16} words are needed")
    size = window - PERIOD + 1
    reach = window - size
    src = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    table = _table(src.select(id_col, "t", "text"), id_col, window)
    table = stored(table.withColumn("r", F.monotonically_increasing_id()), "anchors")
    each = table.filter(F.size("anchors") > 0).select("r", id_col, F.inline("anchors"))
    heads = each.groupBy("h").agg(
        F.min(id_col).alias("m"), F.max(id_col).alias("z"), F.min("c").alias("c0"), F.max("c").alias("c1")
    )
    heads = stored(heads.filter("m < z").select("h", "m", (F.col("c0") != F.col("c1")).alias("open")), "anchor-heads")
    # only anchors with room for a window around them
    left = F.least(F.col("p"), F.lit(reach))
    hits = each.filter(left + F.col("right") >= reach).join(heads, "h").filter(F.col("open") | (F.col(id_col) > F.col("m")))
    hits = stored(hits.drop("m"), "anchor-hits")
    whole = F.struct((F.col("p") - left).cast("int").alias("a"), (F.col("p") + size + F.col("right")).cast("int").alias("b"))
    spans = hits.filter(~F.col("open")).select("r", whole.alias("s"))

    # anchors with different contexts: classes, each with its first document
    mixed = hits.filter("open")
    # stored: a join of its own shuffle, which Spark can split at a hot class
    least = stored(mixed.groupBy("h", "c").agg(F.min(id_col).alias("m")), "anchor-classes")
    at = mixed.join(least, ["h", "c"]).select("r", "p", "right", (F.col(id_col) > F.col("m")).alias("later"))
    at = stored(at, "anchor-places")
    later = at.filter("later").select("r", whole.alias("s"))
    firsts = at.filter(~F.col("later")).groupBy("r").agg(F.collect_list("p").alias("ps"))
    places = table.select("r", id_col, "t").join(firsts, "r")
    rows = stored(_windows(src, places, id_col, window), "anchor-windows")
    twice = rows.groupBy("x", "y").agg(F.min(id_col).alias("m"), F.max(id_col).alias("z")).filter("m < z")
    twice = stored(twice.drop("z"), "anchor-repeats")
    own = rows.join(twice, ["x", "y"]).filter(F.col(id_col) > F.col("m")).select(
        "r", F.struct(F.col("s").alias("a"), (F.col("s") + window).alias("b")).alias("s")
    )
    found = spans.unionByName(later).unionByName(own)
    found = found.groupBy("r").agg(F.collect_list("s").alias("spans"))
    rows = table.select(id_col, "t", "n_words", "whole", "r")
    return rows.drop("r"), rows.join(found, "r").select(id_col, "t", "spans")


def _kept(words: list[bytes], spans: pa.StructScalar) -> list[bytes]:
    n = len(words)
    a, b = (np.clip(spans.values.field(x).to_numpy(), 0, n) for x in "ab")
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, a, 1)
    np.add.at(depth, b, -1)
    keep = np.cumsum(depth[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, with_kept: bool = True) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, if asked, ``kept``,
    the remaining words joined by one space."""
    rows, spans = repeated_stretches(docs, id_col, text, window)
    spans = stored(spans, "anchor-spans").select(F.col(id_col).alias("_i"), F.col("t").alias("_t"), "spans")
    id_type = dict(docs.dtypes)[id_col]
    src = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))

    def same(df):
        return df[id_col].eqNullSafe(F.col("_i")) & (df["t"] == F.col("_t"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(b.column(1).to_pylist(), b.column(2)):
            words = split(text)
            kept = _kept(words, found) if found.is_valid else words
            left = b" ".join(kept).decode("utf-8", "surrogatepass") if with_kept else None
            out.append((len(words), len(words) - len(kept), _digest(kept), left))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    schema = f"`{id_col}` {id_type}, n_words long, n_removed long, kept_sha256 string, kept string"
    if with_kept:
        return map_batches(src.join(spans, same(src), "left").select(id_col, "text", "spans"), fn, schema)
    cut = map_batches(src.join(spans, same(src)).select(id_col, "text", "spans"), fn, schema)
    other = rows.join(spans, same(rows), "left_anti").select(
        id_col, "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole").alias("kept_sha256")
    )
    return cut.drop("kept").unionByName(other)
