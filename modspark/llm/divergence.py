"""Divergence of the sources of each language by their words.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a
language keeps the terms of at least ``MIN_DOCS`` of its documents.

1. Vocabulary.  Document frequencies are combined in the tasks and summed by
   Spark; the kept terms are sorted by range over all tasks, which gives each
   its lexicographic ordinal, and every stretch of the order becomes a minimal
   acyclic transducer (``transducer``) of its own in the shared folder.
2. Recount.  Whole texts stream through the transducers, one block after the
   other for some megabytes of text at a time, so a task holds one block
   whatever the size of the vocabulary; occurrences leave as (language,
   source, ordinal, count), combined in the task.
3. Smoothed shares p = 1 + floor(10^9 (count + 1) / (N + V)) and the values
   floor((p - q)^2 / q) are exact whole numbers.  Pairs of sources are compared
   in dense cells of (sources x a stretch of ordinals) of bounded size, added
   up; a language's terms are ranked with ordinals as tie-break.

Defined cases: null text, language and source are ''; a group without terms
counts with all counts 0; a language without kept terms gives pairs of value
0; repeated rows are documents of their own; long terms are whole (see
``transducer``); extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import transducer
from .common import scratch, slices, stored

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
BLOCK_TERMS = 1 << 16  # terms a transducer
HOLD_BYTES = 16 << 20  # text held while the blocks pass by
HOLD_TERMS = 200_000
CELLS, WIDTH = 4_000_000, 4096  # of a dense comparison
# What a byte becomes: itself (A-Z in lower case), or the delimiter.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else transducer.DELIMITER for b in range(256)
)


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def _frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of each term, combined in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, seen in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                    names=["lang", "term", "n"],
                )
            held.clear()

        for whole in batches:
            for b in slices(whole):
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    held.setdefault(lang, Counter()).update(set(fold(text).split()))
                if sum(map(len, held.values())) > HOLD_TERMS:
                    yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, term, ord, block): kept terms with ordinals in the order of
    (lang, term), consecutive over all blocks."""
    found = _frequencies(docs).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = stored(found.filter(F.col("n") >= min_docs).select("lang", "term"), "terms-kept")
    n = max(1, -(-kept.count() // block_terms))
    dealt = kept.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term")
    dealt = stored(dealt.withColumn("m", F.monotonically_increasing_id()), "terms-sorted")
    block = F.shiftright("m", 33)
    sizes = sorted(dealt.groupBy(block.alias("block")).agg(F.max("m").alias("last"), F.min("m").alias("first")).collect())
    base, rows = 0, []  # a row a block
    for r in sizes:
        rows.append((r.block, base - r.first))
        base += r.last - r.first + 1
    shift = docs.sparkSession.createDataFrame(rows, "block long, shift long")
    return dealt.withColumn("block", block).join(F.broadcast(shift), "block").select("lang", "term", (F.col("m") + F.col("shift")).alias("ord"), "block")


def write_blocks(vocab: DataFrame) -> list[str]:
    """A transducer file a block in the shared folder; their paths in order."""
    folder = scratch(vocab.sparkSession, "transducers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        groups: list[tuple[str, int, list[bytes]]] = []

        def close(block: int) -> pa.RecordBatch:
            name = f"{block:08d}-{TaskContext.get().taskAttemptId()}.npz"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(transducer.pack(transducer.build(groups)))
            groups.clear()
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([f"{folder}/{name}"])], names=["block", "path"])

        now = None
        for b in batches:
            for block, ordinal, lang, term in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and block != now:
                    yield close(now)
                now = block
                if not groups or groups[-1][0] != lang:
                    groups.append((lang, ordinal, []))
                groups[-1][2].append(term)
        if now is not None:
            yield close(now)

    dealt = vocab.select("block", "ord", "lang", "term").repartition("block").sortWithinPartitions("block", "ord")
    manifest = stored(dealt.mapInArrow(run, "block long, path string"), "transducer-manifest")
    return [r.path for r in manifest.orderBy("block").collect()]


class _Held:
    """Some megabytes of text: folded bytes, places of the terms, their group."""

    def __init__(self):
        self.parts, self.size, self.groups = [], 0, {}

    def add(self, b: pa.RecordBatch) -> None:
        folded = [fold(t) for t in b.column(2).to_pylist()]
        buf = np.frombuffer(b" ".join([*folded, b""]), np.uint8)
        letter = buf != transducer.DELIMITER
        start = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        ends = np.cumsum([len(x) + 1 for x in folded])
        codes = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
        self.parts.append((buf, start, codes[np.searchsorted(ends, start, "right")] if len(start) else start))
        self.size += len(buf)

    def counts(self, t: transducer.Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, ordinal, occurrences) of the terms in one block."""
        none = (-1, 0)
        root, first = np.array([t.groups.get(lang, none) for lang, _ in self.groups], np.int64).T
        seen = [np.zeros((2, 0), np.int64)]
        for buf, start, group in self.parts:
            mine = np.flatnonzero(root[group] >= 0)
            at, g = start[mine], group[mine]
            term, ordinal = t.walk(buf, at, root[g], first[g])
            seen.append(np.stack([g[term], ordinal]))
        g, o = np.concatenate(seen, axis=1)
        order = np.lexsort((o, g))
        g, o = g[order], o[order]
        edge = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])]) if len(g) else np.zeros(0, np.int64)
        return g[edge], o[edge], np.diff(np.r_[edge, len(g)])


def recount(docs: DataFrame, paths: list[str]) -> DataFrame:
    """(lang, source, ord, n): occurrences of the kept terms."""
    last: list = [None, None]

    def load(path: str) -> transducer.Transducer:
        if last[0] != path:
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as f:
                last[:] = [path, transducer.unpack(f.read())]
        return last[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(held.groups)
            langs, sources = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string())
            for path in paths if names else ():
                g, o, n = held.counts(load(path))
                at = pa.array(g)
                yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), pa.array(o), pa.array(n)], names=["lang", "source", "ord", "n"])

        for whole in batches:
            for b in slices(whole):
                held.add(b)
                if held.size > HOLD_BYTES:
                    yield from flush()
                    held = _Held()
        yield from flush()

    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ord long, n long")
    return rows.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)), exact."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    whole = F.call_function("div", wide, (total + kept).cast("decimal(19,0)"))
    return F.when(kept > 0, 1 + whole)


_PAIR_DDL = "lang string, source string, item string, value long"


def _compare(table: pa.Table) -> pa.Table:
    """Sums of floor((p - q)^2 / q) over a stretch of ordinals, for all
    ordered pairs of sources; rows without an ordinal give the share of a
    term that the source has not."""
    ordinal = table["ord"].combine_chunks()
    head = ordinal.is_null().to_numpy(zero_copy_only=False)
    source, p = np.array(table["source"].to_pylist(), object), table["p"].to_numpy()
    names, none = source[head], p[head]
    code = {s: k for k, s in enumerate(names)}
    row = np.array([code[s] for s in source[~head]], np.int64)
    cols, col = np.unique(ordinal.drop_null().to_numpy(), return_inverse=True)
    cell = np.repeat(none[:, None], len(cols), axis=1)
    cell[row, col] = p[~head]
    out = np.empty((len(names), len(names)), np.int64)
    for k in range(len(names)):
        d = cell[k] - cell
        out[k] = (d * d // cell).sum(axis=1)
    one, two = np.repeat(np.arange(len(names)), len(names)), np.tile(np.arange(len(names)), len(names))
    keep = one != two
    one, two, names = one[keep], two[keep], pa.array(names, pa.string())
    lang = pa.repeat(table["lang"][0], len(one))
    cols = [lang, names.take(pa.array(one)), names.take(pa.array(two)), pa.array(out.ravel()[keep])]
    return pa.Table.from_arrays(cols, names=["lang", "source", "item", "value"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part ('pair', 'term'), item, q, p, value, rank; p is null
    in pairs."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    vocab = stored(vocabulary(docs, min_docs, block_terms), "terms")
    counts = stored(recount(docs, write_blocks(vocab)), "term-counts")

    sizes = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = stored(groups.fillna(0, ["total", "kept"]), "term-groups")
    every = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("sources"))

    own = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
    own = stored(own.select("lang", "source", "ord", "p", "kept"), "term-shares")
    width = F.greatest(F.lit(1), F.least(F.lit(WIDTH), F.lit(CELLS) / F.col("sources"))).cast("long")
    widths = every.select("lang", width.alias("width"))
    cell = F.call_function("div", F.col("ord"), F.col("width")).alias("cell")
    zero = _share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    heads = vocab.join(widths, "lang").select("lang", cell).distinct().join(groups, "lang")
    heads = heads.select("lang", "cell", "source", F.lit(None).cast("long").alias("ord"), zero.alias("p"))
    cells = heads.unionByName(own.join(widths, "lang").select("lang", cell, "source", "ord", "p"))
    parts = cells.groupBy("lang", "cell").applyInArrow(_compare, _PAIR_DDL)
    values = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = pairs.join(values, ["lang", "source", "item"], "left").fillna(0, ["value"])

    def rank(*order) -> Column:
        return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *order)).cast("int")

    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank("item").alias("rank"))

    whole = counts.groupBy("lang", "ord").agg(F.sum("n").alias("n")).join(every, "lang").join(sizes, "lang")
    whole = whole.select("lang", "ord", _share(F.col("n"), F.col("all"), F.col("kept")).alias("q"))
    d = F.col("p") - F.col("q")
    terms = own.join(whole, ["lang", "ord"]).filter("p > q").withColumn("value", F.call_function("div", d * d, F.col("q")))
    terms = terms.withColumn("rank", rank("ord")).filter(F.col("rank") <= top)
    terms = terms.join(vocab.select("ord", F.col("term").cast("string").alias("item")), "ord")
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
