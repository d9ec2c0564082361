"""Benchmark decontamination by latent semantic retrieval.

1. Words are lower-cased and split at ASCII punctuation and white space.  The
   vocabulary is the words of the benchmark (the stated query set); document
   frequencies are counted over all documents.
2. A randomised SVD (subspace iteration; one Spark job over the TF-IDF rows a
   step, partial products added up in tasks) gives ``RANK`` right singular
   vectors.  Its rows are all documents, whole, and all benchmark items.
3. Every document is cut into blocks of ``BLOCK`` words; a window is as many
   blocks as an item needs, at every block.  A window's vector is the sum of
   its words' projected TF-IDF vectors; words outside the vocabulary have
   none.  A window is left out for an item only if it and its surroundings
   hold too few of the item's rarest words for ``PARAPHRASE`` of the item to
   be there: a true bound, whatever the other words and the corpus size.
4. Windows at a cosine of ``COSINE`` or more with an item are candidates; of
   items of at most ``SHORT`` words, whose few words leave the cosine little to
   go by, all windows within the bound are (exact for them).  For each, the longest common subsequence of the item and the window with its
   surroundings is measured, and that of the item's answer (its last quarter).
   A document is contaminated if the first is at least ``VERBATIM`` of the
   item, or at least ``PARAPHRASE`` with ``ANSWER`` of the answer kept.

The query set is worked through in blocks of ``ITEMS`` items; only such a
block, its vocabulary and its vectors are sent to the tasks.

Defined cases: null or empty text has no words and is clean; items with fewer
than ``MIN_ITEM`` words (or null) are no evidence and never match; repeated
items match each; an item with a null id counts and is listed as null, last;
a document with a null id is kept; repeated documents are judged each;
extra columns are ignored; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, slices, stored, texts

BLOCK, RANK, OVERSAMPLE, STEPS = 8, 96, 16, 3
FAN_IN, ROWS, ENTRIES = 16, 256, 1 << 15  # partial products added up in a task; matrix rows and entries at a time
ITEMS, MIN_ITEM = 5_000, 5
SHORT = 12  # words of an item whose windows are all verified
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.45, 0.8, 0.6, 0.75

_CUT = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_CUT).split()


def common_subsequence(item: list[bytes], window: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit per item word."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in window:
        if m := where.get(w, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


@dataclass
class Space:
    """The vocabulary's weights and projected vectors, and the items."""

    number: dict[bytes, int]
    weight: np.ndarray  # IDF a word; the last entry is for words outside the vocabulary
    vectors: np.ndarray  # weight times the word's row of the singular vectors; the last row is zero
    items: list[tuple[int | None, list[bytes]]]
    units: np.ndarray  # the items' unit vectors
    wide: np.ndarray  # the items' lengths in blocks; windows have as many or one more
    asked: list[tuple[np.ndarray, int]]  # the items' rarest words and how many of them a leak holds


def _numbers(number: dict[bytes, int], ws: list[bytes]) -> np.ndarray:
    return np.fromiter((number.get(w, len(number)) for w in ws), np.int64, len(ws))


def term_counts(docs: DataFrame, number: dict[bytes, int], text: str = "text") -> DataFrame:
    """(terms, n): a row a document, the vocabulary words in its whole text
    and how often each is there."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        look = shared.value
        for whole in batches:
            for b in slices(whole):
                counted = (Counter(words_of(t)) for t in texts(b.column(0)))
                found = [(c, look.keys() & c.keys()) for c in counted]
                ends = pa.array(np.cumsum([0, *(len(k) for _, k in found)]), pa.int32())
                flat = ([look[w] for _, k in found for w in k], [c[w] for c, k in found for w in k])
                cols = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in flat]
                yield pa.RecordBatch.from_arrays(cols, names=["terms", "n"])

    return docs.select(text).mapInArrow(run, "terms array<int>, n array<int>")


def document_frequencies(counts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each vocabulary word, and all documents."""

    def run(batches):
        n, count = 0, np.zeros(size, np.int64)
        for b in batches:
            n += b.num_rows
            count += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[count[at], n])], names=["term", "n"])

    got = counts.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size)
    total = 0
    for term, n in zip(got["term"].to_pylist(), got["n"].to_pylist()):
        if term < 0:
            total = n
        else:
            df[term] = n
    return df, total


def _products(terms: np.ndarray, tf: np.ndarray, ends: np.ndarray, weight: np.ndarray, basis: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` what some rows of the TF-IDF matrix, each of length 1,
    give: the rows, transposed, times the rows times ``basis``."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    w = (1 + np.log(tf)) * weight[terms]
    w /= np.sqrt(np.bincount(row, w * w))[row]
    seen, at = np.unique(terms, return_inverse=True)  # only the columns that these rows have
    m = np.zeros((len(ends) - 1, len(seen)), np.float32)
    m[row, at] = w
    total[seen] += m.T @ (m @ basis[seen])


def singular_vectors(counts: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the TF-IDF rows, by
    randomised subspace iteration.  A step adds up one partial product a
    task, in tasks too if there are many."""
    n = len(weight) - 1
    width = min(rank + OVERSAMPLE, n)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    spark = counts.sparkSession
    tasks = counts.rdd.getNumPartitions()

    def times(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q.astype(np.float32))

        def run(batches):
            basis, total = shared.value, np.zeros(shared.value.shape)
            for b in batches:
                ends = np.cumsum([0, *b.column(0).value_lengths().to_pylist()])
                terms, tf = (b.column(k).flatten().to_numpy() for k in range(2))
                at = 0
                while at < b.num_rows:  # whole rows, some entries at a time
                    to = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, "right")) - 1))
                    if ends[to] > ends[at]:
                        some = slice(ends[at], ends[to])
                        _products(terms[some], tf[some], ends[at : to + 1] - ends[at], weight, basis, total)
                    at = to
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "part"])

        def add(batches):
            parts = sorted((k, x) for b in batches for k, x in zip(*(c.to_pylist() for c in b.columns)))
            if parts:  # in one order, so that a run again gives the same
                total = sum(np.frombuffer(x) for _, x in parts)
                yield pa.RecordBatch.from_arrays([pa.array([parts[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "part"])

        got = counts.mapInArrow(run, "task int, part binary")
        if tasks > FAN_IN:
            got = got.repartition(-(-tasks // FAN_IN), "task").mapInArrow(add, "task int, part binary")
        found = sorted((r.task, r.part) for r in got.collect())
        shared.unpersist()
        return sum(np.frombuffer(x).reshape(n, width) for _, x in found)

    for _ in range(STEPS):
        z = times(q)
        q, last = np.linalg.qr(z)[0], q
    small = last.T @ z  # the Gram matrix in the last basis
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (last @ turn[:, ::-1])[:, : min(rank, width)]


def build_space(docs: DataFrame, items: list[tuple[int, str]], text: str = "text") -> Space | None:
    cut = [(i, ws) for i, t in items if len(ws := words_of(t or "")) >= MIN_ITEM]
    if not cut:
        return None
    spark = docs.sparkSession
    number = {w: k for k, w in enumerate(sorted({w for _, ws in cut for w in ws}))}
    counts = stored(term_counts(docs, number, text), "lsa-counts")
    df, total = document_frequencies(counts, len(number))
    weight = np.log((1 + total) / (1 + np.minimum(np.r_[df, 0], total))) + 1e-3
    own = term_counts(spark.createDataFrame([(b" ".join(ws).decode("utf-8", "surrogatepass"),) for _, ws in cut], "text string"), number)
    v = singular_vectors(counts.unionByName(own), weight)
    vectors = np.r_[v * weight[:-1, None], np.zeros((1, v.shape[1]))].astype(np.float32)
    units = np.array([vectors[_numbers(number, ws)].sum(0) for _, ws in cut])
    units /= np.maximum(1e-9, np.linalg.norm(units, axis=1, keepdims=True))
    wide = np.array([-(-len(ws) // BLOCK) for _, ws in cut])
    return Space(number, weight, vectors, cut, units, wide, [_asked(number, weight, ws) for _, ws in cut])


def _asked(number: dict[bytes, int], weight: np.ndarray, ws: list[bytes]) -> tuple[np.ndarray, int]:
    """The rarest words of an item and how many of them each leak holds: of
    its words at most ``gone`` are missing, so of any ``gone + least`` there
    are ``least``."""
    at = _numbers(number, ws)
    gone = len(ws) - math.ceil(PARAPHRASE * len(ws) - 1e-9)
    least = max(1, len(ws) // 6)
    return np.unique(at[np.argsort(-weight[at], kind="stable")[: gone + least]]), least


def _possible(space: Space, base: np.ndarray, text: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first block, blocks, item) of all windows whose surroundings hold
    enough of an item's rarest words; no other window can pass :func:`verify`."""
    inside, blocks = np.arange(len(text)) - base[text], np.diff(base)
    order = np.argsort(space.wide, kind="stable")
    step = min(256, max(8, (1 << 24) // max(1, len(text))))
    for i in range(0, len(order), step):
        ks = order[i : i + step]
        asked = np.zeros((len(space.weight) + 1, len(ks)), np.uint8)
        for col, k in enumerate(ks.tolist()):
            asked[space.asked[k][0], col] = 1
        least = np.array([space.asked[k][1] for k in ks.tolist()], np.uint16)
        here = asked[words[:, 0]]
        for d in range(1, BLOCK):
            here += asked[words[:, d]]
        upto = np.zeros((len(text) + 1, len(ks)), np.uint16)  # wraps; the differences are small
        np.cumsum(here, 0, np.uint16, upto[1:])
        for wide in np.unique(space.wide[ks]).tolist():
            on = slice(*np.searchsorted(space.wide[ks], [wide, wide + 1]))
            for n in (wide, wide + 1):
                # a text shorter than the window has one window, at its start
                s = np.flatnonzero((inside + n <= blocks[text]) | (inside == 0))
                lo, hi = np.maximum(s - wide, base[text[s]]), np.minimum(s + n + wide, base[text[s] + 1])
                r, c = np.nonzero(upto[:, on][hi] - upto[:, on][lo] >= least[on])
                yield s[r], np.full(len(r), n), ks[on][c]


def candidates(space: Space, lengths: np.ndarray, at: np.ndarray, cosine: float = COSINE) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, end word) of all windows at the cosine;
    ``at`` has the word numbers of all texts, each padded to whole blocks."""
    blocks = -(-lengths // BLOCK)
    base = np.r_[0, np.cumsum(blocks)]
    text = np.repeat(np.arange(len(lengths)), blocks)
    words = at.reshape(-1, BLOCK)
    s, n, k = map(np.concatenate, zip(*_possible(space, base, text, words)))
    e = np.minimum(s + n, base[text[s] + 1])
    need = np.zeros(len(text) + 1, np.int64)
    np.add.at(need, s, 1)
    np.add.at(need, e, -1)
    use = np.flatnonzero(np.cumsum(need)[:-1] > 0)  # blocks inside some window that is left
    vec = np.zeros((len(use), space.vectors.shape[1]), np.float32)
    step = 1 << 13
    for i in range(0, len(use), step):
        vec[i : i + step] = space.vectors[np.minimum(words[use[i : i + step]], len(space.vectors) - 1)].sum(1)
    place = np.zeros(len(text) + 1, np.int64)
    place[use] = np.arange(len(use))
    out = []
    short = np.array([len(ws) <= SHORT for _, ws in space.items])
    for i in range(0, len(s), step):
        ss, ee, kk = s[i : i + step], e[i : i + step], k[i : i + step]
        x = np.zeros((len(ss), vec.shape[1]), np.float32)
        for d in range(int(n[i : i + step].max())):  # blocks of a window are neighbours in ``use``
            on = np.flatnonzero(ss + d < ee)
            x[on] += vec[place[ss[on] + d]]
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        close = np.einsum("ij,ij->i", x, space.units[kk]) >= np.maximum(cosine * norm, 1e-6)
        near = np.flatnonzero(close | short[kk])
        t = text[ss[near]]
        lo = (ss[near] - base[t]) * BLOCK
        out += zip(t.tolist(), kk[near].tolist(), lo.tolist(), (lo + n[i : i + step][near] * BLOCK).tolist())
    return out


def verify(item: list[bytes], words: list[bytes], lo: int, hi: int) -> float:
    """Share of the item kept around [lo, hi), or 0 if it is no leak."""
    around = words[max(0, lo - len(item)) : hi + len(item)]
    there = set(around)
    if sum(map(there.__contains__, item)) < PARAPHRASE * len(item):  # a bound on the subsequence
        return 0.0
    kept = common_subsequence(item, around) / len(item)
    if kept >= VERBATIM:
        return kept
    answer = item[-max(2, len(item) // 4) :]
    ok = kept >= PARAPHRASE and common_subsequence(answer, around) / len(answer) >= ANSWER
    return kept if ok else 0.0


def search(docs: DataFrame, space: Space, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(*keep, _items, _kept): the benchmark items that a document holds and
    the largest share of one; both cover the whole text."""
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        sp = shared.value
        cut = [words_of(t) for t in texts(b.column(len(keep)))]
        lengths = np.array([len(ws) for ws in cut])
        number, other = sp.number.get, len(sp.number)
        pads = (-lengths) % BLOCK
        flat = np.fromiter(
            (x for ws, p in zip(cut, pads.tolist()) for part in ([number(w, other) for w in ws], [other + 1] * p) for x in part),
            np.int64, int((lengths + pads).sum()),
        )
        found: list[dict[int, float]] = [{} for _ in cut]
        for t, k, lo, hi in candidates(sp, lengths, flat) if len(flat) else ():
            item_id, item = sp.items[k]
            if found[t].get(item_id, 0) < 1 and (kept := verify(item, cut[t], lo, hi)):
                found[t][item_id] = max(kept, found[t].get(item_id, 0))
        ids = pa.array([sorted(f, key=lambda i: (i is None, i or 0)) for f in found], pa.list_(pa.int64()))
        kept = pa.array([max(f.values(), default=0.0) for f in found], pa.float64())
        return pa.RecordBatch.from_arrays([*b.columns[:-1], ids, kept], names=[*keep, "_items", "_kept"])

    def run(batches):
        for whole in batches:
            for part in slices(whole):
                yield fn(part)
            give_back()

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", _items array<long>, _kept double"
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def _query_blocks(benchmark: DataFrame) -> tuple[int, Callable[[int], list[tuple[int, str]]]]:
    """The query set in blocks of some ITEMS items, repeated rows once: their
    number and a function that reads one.  The driver holds one at a time."""
    items = stored(benchmark.select("item_id", "text").distinct(), "lsa-items")
    n = items.count()
    blocks = 1 if n <= ITEMS else -(-2 * n // ITEMS)  # dealt by hash, so half full on average

    def block(k: int) -> list[tuple[int, str]]:
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        return [(r[0], r[1]) for r in mine.orderBy("item_id", "text").collect()]

    return blocks, block


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark item, a query block at a time."""
    names = docs.columns
    blocks, block = _query_blocks(benchmark)
    for k in range(blocks):
        space = build_space(docs, block(k), text)
        if space is not None:
            # the columns travel as one struct: no name can clash
            found = search(docs.select(F.struct(*names).alias("row"), F.col(text).alias("text")), space, ("row",), "text")
            docs = stored(found.filter(F.size("_items") == 0).select("row.*"), "lsa-clean")
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, contaminated, items, kept (largest share of an item)."""
    none = F.array().cast("array<long>")
    blocks, block = _query_blocks(benchmark)
    if blocks == 1:
        space = build_space(docs, block(0), text)
        if space is None:
            found = docs.select(id_col, none.alias("items"), F.lit(0.0).alias("kept"))
        else:
            found = search(docs, space, (id_col,), text).withColumnsRenamed({"_items": "items", "_kept": "kept"})
    else:
        rows = docs.select(id_col, text, F.xxhash64(text).alias("_c"))  # rows are told apart by id and text hash
        parts = [
            stored(search(rows, space, (id_col, "_c"), text).filter(F.size("_items") > 0), "lsa-found")
            for k in range(blocks)
            if (space := build_space(docs, block(k), text)) is not None
        ]
        hits = rows.drop(text).withColumns({"_items": none, "_kept": F.lit(0.0)}).limit(0)
        for p in parts:
            hits = hits.unionByName(p)
        hits = hits.groupBy(F.col(id_col).alias("_i"), F.col("_c").alias("_k")).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("items"), F.max("_kept").alias("kept")
        )
        same = rows[id_col].eqNullSafe(F.col("_i")) & rows["_c"].eqNullSafe(F.col("_k"))
        found = rows.drop(text).join(hits, same, "left").select(
            id_col, F.coalesce("items", none).alias("items"), F.coalesce("kept", F.lit(0.0)).alias("kept")
        )
    return found.select(id_col, (F.size("items") > 0).alias("contaminated"), "items", "kept")
