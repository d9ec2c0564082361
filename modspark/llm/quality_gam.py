"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes ``FEATURES`` numbers (one pass, stored).  Features are cut
into at most ``BINS`` quantile bins; boosting goes round the features, each
turn fitting one shallow tree (at most four leaves over one feature's bins)
to the log-loss gradient and adding it to that feature's lookup table.  The
``PAIRS`` feature pairs whose four-quadrant split explains most of what is
left are then boosted the same way into two-way tables.  A score is the
logistic function of a sum of table entries, added up by batches.

The model is fitted on the driver from at most ``TRAIN_ROWS`` labelled rows
(those with the smallest hash of their id: a documented bound); nothing else
is sampled.  Labels, language, source and id are not features.

Defined cases: null or empty text is a row of zero features and gets that
row's score; without labelled rows (or with one class only) every score is
the labelled share (0.5 if none); repeated labels of a document count as
their maximum, null labels and labels without a document are ignored; a null
id counts as '' for the hold-out; repeated rows are scored each; extra
columns are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, map_batches, stored, texts

FEATURES = (
    "log_words", "mean_word", "unique_words", "repeated_next", "short_words", "one_char_words", "upper", "lower",
    "digit", "symbol", "bang", "stop", "comma", "non_ascii", "line_words", "dup_lines", "caps_words",
)
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 32, 8, 120, 40, 8, 0.15, 2.0
TRAIN_ROWS = 20_000


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars)] = 1
    return m


_SETS = np.stack(
    [
        _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789"), _mask(b"#*$%&|<>"), _mask(b"!"),
        _mask(b".?"), _mask(b","), _mask(bytes(range(0xC2, 0xF5))),
    ],
    axis=1,
)


def features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = float(lengths.sum())
    share = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _SETS) / chars
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return np.array(
        [
            np.log1p(n), chars / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
            np.count_nonzero(lengths <= 3) / n, np.count_nonzero(lengths == 1) / n, *share, n / len(lines),
            1 - len(set(lines)) / len(lines), sum(map(bytes.isupper, words)) / n,
        ]
    )


def with_features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, f): one pass over the texts."""
    id_type = dict(docs.dtypes)[id_col]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        f = np.array([features(t) for t in texts(b.column(1))])
        ends = np.arange(len(f) + 1, dtype=np.int32) * len(FEATURES)
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, f.ravel())], names=[id_col, "f"])

    return map_batches(docs.select(id_col, text), fn, f"`{id_col}` {id_type}, f array<double>")


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of the best tree of that depth over the bins."""
    out = np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(g) < 2:
        return out
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch)
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= _gain(g.sum(), h.sum()) + 1e-9:
        return out
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best cut of a two-way table into four."""
    def four(a):
        c = a.cumsum(0).cumsum(1)
        p, row, col, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return np.stack([p, row - p, col - p, all_ - row - col + p])

    fg, fh = four(g), four(h)
    gain = _gain(fg, fh).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = -fg[:, i, j] / (fh[:, i, j] + RIDGE)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - _gain(g.sum(), h.sum())), out


class Gam:
    def __init__(self, base: float, edges=(), tables=(), pair_edges=(), pairs=()):
        self.base, self.edges, self.tables, self.pair_edges, self.pairs = base, edges, tables, pair_edges, pairs

    @staticmethod
    def _bin(x: np.ndarray, edges) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Gam:
        n = len(y)
        share = (y.sum() + 0.5) / (n + 1) if n else 0.5
        if n == 0 or y.min() == y.max():
            return cls(float(np.log(share / (1 - share))) if n else 0.0)

        def cut(k):
            return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(x.shape[1])]

        self = cls(float(np.log(share / (1 - share))), cut(BINS), pair_edges=cut(PAIR_BINS), pairs=[])
        bins = cls._bin(x, self.edges)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        z = np.full(n, self.base)

        def slope():
            p = 1 / (1 + np.exp(-z))
            return p - y, np.maximum(p * (1 - p), 1e-6)

        for _ in range(ROUNDS):
            for b, t in zip(bins, self.tables):
                g, h = slope()
                step = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
                t += step
                z += step[b]
        wide = cls._bin(x, self.pair_edges)
        sizes = [len(e) + 1 for e in self.pair_edges]
        g, h = slope()

        def table(i, j, w):
            return np.bincount(wide[i] * sizes[j] + wide[j], w, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

        some = [(i, j) for i in range(x.shape[1]) for j in range(i) if sizes[i] > 1 and sizes[j] > 1]
        some.sort(key=lambda p: -_quadrants(table(*p, g), table(*p, h))[0])
        self.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in some[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                g, h = slope()
                step = RATE * _quadrants(table(i, j, g), table(i, j, h))[1]
                t += step
                z += step[wide[i], wide[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for b, t in zip(self._bin(x, self.edges), self.tables):
            z += t[b]
        wide = self._bin(x, self.pair_edges) if self.pairs else ()
        for i, j, t in self.pairs:
            z += t[wide[i], wide[j]]
        return 1 / (1 + np.exp(-z))


def fit(features_: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Gam:
    """Fit on at most ``train_rows`` rows of ``features_`` that have a label."""
    y = labels.filter(F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y"))
    rows = (
        features_.join(y, id_col).orderBy(F.xxhash64(id_col), id_col, "f").limit(train_rows).select("f", "y").toArrow()
    )
    x = np.array(rows["f"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return Gam.fit(x, rows["y"].to_numpy().astype(float))


def score(features_: DataFrame, model: Gam, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    id_type = dict(features_.dtypes)[id_col]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        s = model.score(x)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"]
        )

    return map_batches(features_.select(id_col, "f"), fn, f"`{id_col}` {id_type}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  Learns only from
    documents whose id's crc32 modulo ``folds`` is not zero."""
    f = stored(with_features(docs), "gam-features")
    model = fit(f.filter(crc_bucket(F.col("doc_id"), folds) != 0), labels)
    return score(f, model, threshold=threshold).select(
        "doc_id", (crc_bucket(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted"
    )
