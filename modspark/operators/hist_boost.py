"""M6, second member: second-order boosting over histograms, grown leaf by leaf.

Features are cut into at most ``bins`` quantile bins once and stored as blocks
of bytes; every pass over the rows is one Spark job that adds up, in its tasks,
the gradients, hessians and counts a feature and bin for some leaves.  A tree
starts from its root and splits the leaves of the largest gain, a few a pass;
of a split only the smaller child is counted, the other one is the difference.
Leaves' values come from the histogram that split them, so leaves that cannot
be split any more cost no pass.  Raw scores are folded into the stored rows
every few trees, so a pass applies few trees and a lost executor repeats little.

The driver holds histograms (leaves x features x bins) and trees, never rows;
with many partitions their histograms are added up in a second step of tasks.
Scoring is one Arrow function over the features: hundreds of trees as nested
conditions are too long to plan and to compile.

Defined cases: NULL and NaN features count as smaller than any value; rows
without a label are left out of training; with one class only the model gives
that class's share; no rows are an error; equal gains take the earlier feature
and smaller bin; rows are sampled per tree by a hash of their key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.session import checkpoint_dir

BINS, LEAVES, AT_ONCE, REFRESH, FAN_IN = 64, 15, 4, 10, 32
TASK_ROWS = 25_000  # of smaller tasks, some are put together
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1.  Rows go left if the
    feature is at most the threshold (its bin at most ``cut``)."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        for name, v in zip(("feature", "cut", "threshold", "left", "right", "value", "gain"), (-1, 0, 0.0, -1, -1, value, 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def assign(self, x: np.ndarray, bounds: str = "cut") -> np.ndarray:
        """The leaf of each row of bins (of features: by ``threshold``)."""
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right = (np.array(v) for v in (self.feature, getattr(self, bounds), self.left, self.right))
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])


@dataclass
class Boosted:
    """A fitted model."""

    features: list[str]
    trees: list[Tree]
    base: float

    def probability(self) -> Column:
        trees, base = self.trees, self.base

        @F.arrow_udf("double")
        def p(*features: pa.Array) -> pa.Array:
            x = np.column_stack([f.to_numpy(zero_copy_only=False) for f in features]).astype(float)
            x[np.isnan(x)] = -np.inf
            raw = np.full(len(x), base)
            for t in trees:
                raw += np.array(t.value)[t.assign(x, "threshold")]
            return pa.array(1 / (1 + np.exp(-raw)))

        return p(*[F.col(f).cast("double") for f in self.features])

    def importance(self) -> dict[str, float]:
        """Share of the summed gain a feature."""
        gains = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gains[self.features[f]] += g
        total = sum(gains.values()) or 1.0
        return {f: g / total for f, g in gains.items()}

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, json.dumps(vars(t))) for k, t in enumerate(self.trees)] + [(-1, json.dumps([self.features, self.base]))]
        spark.createDataFrame(rows, "tree int, nodes string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        rows = dict(spark.read.schema("tree int, nodes string").parquet(path).collect())
        features, base = json.loads(rows.pop(-1))
        return cls(features, [Tree(**json.loads(rows[k])) for k in sorted(rows)], base)


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins but the last, from sketches of the columns."""
    probs = [k / bins for k in range(1, bins)]
    plain = df.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features])
    return [np.unique(np.array(q, float)) for q in plain.approxQuantile(features, probs, 0.1 / bins)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: values up to the first edge are 0; NaN is 0."""
    out = np.empty(x.shape, np.uint8)
    for k, e in enumerate(edges):
        out[:, k] = np.searchsorted(e, np.where(np.isnan(x[:, k]), -np.inf, x[:, k]), "left")
    return out


def sampled(key: np.ndarray, tree: int, share: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (key.view(np.uint64) ^ np.uint64(tree + 1) * _MIX) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h >> np.uint64(11)).astype(float) / 2.0**53 < share


def histogram(x: np.ndarray, g: np.ndarray, h: np.ndarray, slot: np.ndarray, slots: int, bins: int) -> np.ndarray:
    """(slots, features, bins, 3): sums of g, h and rows; slot -1 is left out."""
    rows = np.flatnonzero(slot >= 0)
    out = np.zeros((slots, x.shape[1], bins, 3))
    for k in range(x.shape[1]):
        at = slot[rows] * bins + x[rows, k]
        for j, w in enumerate((g[rows], h[rows], None)):
            out[:, k, :, j] = np.bincount(at, w, slots * bins).reshape(slots, bins)
    return out


def best_split(hist: np.ndarray, allowed: np.ndarray, l2: float, least_rows: int, least_hessian: float = 1e-3) -> tuple[float, int, int]:
    """(gain, feature, cut) of a leaf's histogram; gain 0 if it has none."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    total = hist[0].sum(0)
    right = total - left
    ok = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] >= least_hessian) & (right[..., 1] >= least_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2) - total[0] ** 2 / (total[1] + l2)
    gain = np.where(ok & allowed[:, None], gain, 0.0)
    f, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, c]), int(f), int(c)


def _blocks(df: DataFrame, features: list[str], label: str, key: str, edges: list[np.ndarray]) -> RDD:
    """Rows by the batch as (keys, labels, raw scores, bins), each as bytes."""
    known = df.filter(F.col(label).isNotNull()).select(
        F.xxhash64(key).alias("key"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(k + 2).to_numpy(zero_copy_only=False) for k in range(len(features))]).astype(float)
            block = (b.column(0).to_numpy(), b.column(1).to_numpy(), np.zeros(len(x)), binned(x, edges))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in block], names=["key", "y", "raw", "x"])

    blocks = known.mapInArrow(run, "key binary, y binary, raw binary, x binary")
    return blocks.rdd.map(lambda r: tuple(bytes(v) for v in r))


def _kept(blocks: RDD) -> RDD:
    """Blocks in the executors' memory and in the shared checkpoint folder."""
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()
    blocks.count()
    return blocks


def _decoded(block: tuple[bytes, ...], trees: list[Tree], base: float, n: int) -> tuple[np.ndarray, ...]:
    key, y, raw = (np.frombuffer(v, kind) for v, kind in zip(block, (np.int64, float, float)))
    x = np.frombuffer(block[3], np.uint8).reshape(-1, n)
    raw = raw + base
    for t in trees:
        raw = raw + np.array(t.value)[t.assign(x)]
    return key, y, raw, x


class _Passes:
    """Jobs over the stored blocks."""

    def __init__(self, blocks: RDD, n: int, bins: int, share: float, base: float):
        self.blocks, self.n, self.bins, self.share, self.base = blocks, n, bins, share, base
        self.folded: list[Tree] = []  # trees not yet in the stored raw scores
        self.parts = blocks.getNumPartitions()

    def histograms(self, number: int, tree: Tree, leaves: list[int]) -> np.ndarray:
        trees, n, bins, share, base = list(self.folded), self.n, self.bins, self.share, self.base
        shape, groups = (len(leaves), n, bins, 3), math.isqrt(self.parts)

        def run(part: int, blocks: Iterator[tuple[bytes, ...]]) -> Iterator[tuple[int, np.ndarray]]:
            total = np.zeros(shape)
            slot = np.full(len(tree.feature), -1)
            slot[leaves] = np.arange(len(leaves))
            for block in blocks:
                key, y, raw, x = _decoded(block, trees, base, n)
                p = 1 / (1 + np.exp(-raw))
                at = np.where(sampled(key, number, share), slot[tree.assign(x)], -1)
                total += histogram(x, p - y, p * (1 - p), at, len(leaves), bins)
            yield part % groups, total

        out = self.blocks.mapPartitionsWithIndex(run)
        if self.parts > FAN_IN:
            out = out.reduceByKey(lambda a, b: a + b, groups)
        return sum(h for _, h in sorted(out.collect(), key=lambda r: r[0]))

    def fold(self) -> None:
        """Add the scores of the last trees to the stored rows."""
        trees, n = list(self.folded), self.n

        def run(block: tuple[bytes, ...]) -> tuple[bytes, ...]:
            return (*block[:2], _decoded(block, trees, 0.0, n)[2].tobytes(), block[3])

        before, self.blocks = self.blocks, _kept(self.blocks.map(run))
        before.unpersist()
        self.folded = []


def fit(
    train: DataFrame, features: list[str], label: str = "label", key: str = "content_id", trees: int = 30, rate: float = 0.2,
    leaves: int = LEAVES, bins: int = BINS, l2: float = 0.0, least_rows: int = 20, row_share: float = 0.8, column_share: float = 0.8,
    seed: int = 43, at_once: int = AT_ONCE, depth: int | None = None,
) -> Boosted:
    """Boost ``trees`` trees of at most ``leaves`` leaves, ``depth`` levels
    below their roots (None: any)."""
    checkpoint_dir(train.sparkSession)
    edges = bin_edges(train, features, bins)
    stored = _kept(_blocks(train, features, label, key, edges))
    sums = stored.map(lambda b: (len(b[1]) // 8, float(np.frombuffer(b[1]).sum()))).collect()
    n, positive = sum(s[0] for s in sums), sum(s[1] for s in sums)
    if not n:
        raise ValueError("no labelled rows to train on")
    share = positive / n
    if share in (0.0, 1.0):
        return Boosted(features, [], 40.0 if share else -40.0)
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    blocks = stored.coalesce(tasks) if tasks < stored.getNumPartitions() else stored
    model = Boosted(features, [], math.log(share / (1 - share)))
    passes, rng = _Passes(blocks, len(features), bins, row_share, model.base), np.random.default_rng(seed)
    used = max(1, round(column_share * len(features)))
    for number in range(trees):
        allowed = np.zeros(len(features), bool)
        allowed[rng.choice(len(features), used, replace=False)] = True
        tree = _grow(passes, number, edges, allowed, rate, leaves, math.inf if depth is None else depth, l2, least_rows, at_once)
        model.trees.append(tree)
        passes.folded.append(tree)
        if len(passes.folded) == REFRESH and number + 1 < trees:
            passes.fold()
    passes.blocks.unpersist()
    stored.unpersist()
    return model


def _grow(
    passes: _Passes, number: int, edges: list[np.ndarray], allowed: np.ndarray, rate: float, leaves: int, depth: float, l2: float, least_rows: int, at_once: int
) -> Tree:
    tree, level = Tree(), [0]
    tree.leaf(0.0)
    hists = {0: passes.histograms(number, tree, [0])[0]}

    def value(h: np.ndarray) -> float:
        g, s = h[:, 0].sum(), h[:, 1].sum()
        return float(-rate * g / (s + l2)) if s + l2 > 0 else 0.0

    def split_of(h: np.ndarray) -> tuple[float, int, int]:
        return best_split(h, allowed, l2, least_rows)

    tree.value[0] = value(hists[0][0])
    best = {0: split_of(hists[0])} if depth > 0 else {}
    while True:
        room = leaves - sum(f < 0 for f in tree.feature)
        chosen = sorted((b for b in best.items() if b[1][0] > 1e-12), key=lambda b: (-b[1][0], b[0]))[: min(room, at_once)]
        if not chosen:
            return tree
        small = []  # (smaller child, its sibling, their parent) of those that may be split again
        for leaf, (gain, f, cut) in chosen:
            h = hists[leaf][f]
            tree.feature[leaf], tree.cut[leaf], tree.gain[leaf] = f, cut, gain
            tree.threshold[leaf] = float(edges[f][cut]) if cut < len(edges[f]) else math.inf
            tree.left[leaf], tree.right[leaf] = tree.leaf(value(h[: cut + 1])), tree.leaf(value(h[cut + 1 :]))
            level += [level[leaf] + 1] * 2
            rows = h[: cut + 1, 2].sum(), h[cut + 1 :, 2].sum()
            pair = (tree.left[leaf], tree.right[leaf])
            if level[-1] < depth and max(rows) >= 2 * least_rows:
                small.append((pair if rows[0] <= rows[1] else pair[::-1]) + (leaf,))
            else:
                del hists[leaf]
            del best[leaf]
        if len(chosen) == room:
            return tree
        if not small:
            continue
        found = passes.histograms(number, tree, [s for s, _, _ in small])
        for (child, sibling, parent), h in zip(small, found):
            hists[child], hists[sibling] = h, hists.pop(parent) - h
            for node in (child, sibling):
                best[node] = split_of(hists[node])
