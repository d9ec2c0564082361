"""Quality rules: hashed n-gram logistic regression with fixed thresholds.

Base figures (words are ``[^\\x20\\x09-\\x0D]+``): word and symbol counts,
repeated lines, words inside five-word windows that occur twice or more.  A
text fails the base rule with fewer than ten words or more than 20 % repeated
words.  The verdict on the others is a logistic regression over hashed word
unigrams and bigrams and the byte 3- and 4-grams of words, as frequencies a
word, calibrated (Platt) on a fifth of the training rows that the weights
have not seen; a text is kept at a probability of ``KEEP`` or more.

The score is linear in word counts, so the n-gram weights of a word are added
up once and kept in a bounded cache; texts are then sums over word numbers.
The model is fitted in one task on at most ``TRAIN_ROWS`` labelled rows (those
with the smallest hash of their id: a documented bound); the driver sees the
weights only.

Defined cases: null text has no words and fails; without labelled rows or
with one class only the verdict is always to keep; repeated labels of a
document count as their maximum, null labels are ignored; ids may be null;
repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, slices, stored, texts

# The base rule and the verdict's threshold.
MIN_WORDS, REPEAT_PERCENT, WINDOW, KEEP = 10, 20, 5, 0.3
SYMBOLS = "#*$%&|<>"
DIM_BITS = 17
TRAIN_ROWS = 4_000
EPOCHS, STEP, RIDGE = 60, 0.3, 1e-6
FIT_ROWS = 200  # rows worked through at a time
CACHE_WORDS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - DIM_BITS)
SAME = 0  # the bigram of a word with itself, for all words


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    """Hashed feature numbers (1 and up)."""
    with np.errstate(over="ignore"):
        return (((h + np.uint64(kind)) * _MIX) >> _SHIFT).astype(np.int64) | 1


def _hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in words], np.uint64)


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word number) of the byte 3- and 4-grams of words, with a
    space on either side."""
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    gap = a == 32
    word = np.cumsum(gap) - 1
    three = a[:-2] << np.uint64(16) | a[1:-1] << np.uint64(8) | a[2:]
    ok3 = np.flatnonzero(~gap[1:-1])
    four = three[:-1] << np.uint64(8) | a[3:]
    ok4 = np.flatnonzero(~gap[1:-2] & ~gap[2:-1])
    slots = np.concatenate([_slot(three[ok3], 3 << 40), _slot(four[ok4], 4 << 40)])
    return slots, np.concatenate([word[ok3 + 1], word[ok4 + 1]])


def _bigrams(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        slots = _slot(h[:-1] * np.uint64(31) + h[1:], 2)
    return np.where(h[:-1] == h[1:], SAME, slots)


def text_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, frequency a word) of a text with words."""
    h = _hashes(words)
    slots = np.concatenate([_slot(h, 1), _bigrams(h), _grams(words)[0]])
    slot, count = np.unique(slots, return_counts=True)
    return slot.astype(np.int32), (count / len(words)).astype(np.float32)


class Model:
    """Linear weights, and the logistic map from raw score to probability."""

    def __init__(self, weights: np.ndarray, slope: float = 1.0, offset: float = 40.0):
        self.weights, self.slope, self.offset = weights, slope, offset

    @classmethod
    def keep_all(cls) -> Model:
        return cls(np.zeros(1 << DIM_BITS))

    @classmethod
    def fit(cls, ends: np.ndarray, slot: np.ndarray, value: np.ndarray, y: np.ndarray) -> Model:
        """Row i has the features slot[ends[i]:ends[i + 1]] (int32) at the
        frequencies ``value`` (float32); worked through a few rows at a time."""
        fold = np.arange(len(y)) % 5 == 0  # rows come in hash order
        if len(y) < 10 or not 0 < y[fold].sum() < fold.sum() or not 0 < y[~fold].sum() < (~fold).sum():
            return cls.keep_all()
        w, b, n = np.zeros(1 << DIM_BITS), 0.0, int((~fold).sum())
        m1 = m2 = np.zeros(len(w) + 1)

        def parts():
            for i in range(0, len(y), FIT_ROWS):
                k = min(i + FIT_ROWS, len(y))
                at = slice(ends[i], ends[k])
                yield slice(i, k), np.repeat(np.arange(k - i), np.diff(ends[i : k + 1])), slot[at], value[at]

        def raw():
            return np.concatenate([np.bincount(r, w[c] * v, k.stop - k.start) for k, r, c, v in parts()]) + b

        for t in range(1, EPOCHS + 1):
            g = RIDGE * np.append(w, 0.0)
            for k, r, c, v in parts():
                z = np.bincount(r, w[c] * v, k.stop - k.start) + b
                e = np.where(fold[k], 0.0, 1 / (1 + np.exp(-z)) - y[k]) / n
                g[:-1] += np.bincount(c, e[r] * v, len(w))
                g[-1] += e.sum()
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            d = STEP * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
            w, b = w - d[:-1], b - d[-1]
        z = raw()
        self = cls(w)
        self.slope, self.offset = _platt(z[fold], y[fold])
        self.offset += self.slope * b
        return self

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for the logistic fit of y on z, with smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([z, np.ones(len(z))], axis=1)
    k = np.array([1.0 / max(z.std(), 1e-6), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ k, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        k = k - np.clip(step, -5, 5)
    return float(max(k[0], 1e-6)), float(k[1])


class Scorer:
    """Scores batches of texts; keeps the hash and weight of known words."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash, self.weight = np.zeros(0, np.uint64), np.zeros(0)

    def learn(self, words: list[bytes]) -> None:
        for i, w in enumerate(words, len(self.number)):
            self.number[w] = i
        h, w = _hashes(words), self.model.weights
        slot, word = _grams(words)
        own = w[_slot(h, 1)] + np.bincount(word, w[slot], len(words))
        self.hash, self.weight = np.concatenate([self.hash, h]), np.concatenate([self.weight, own])

    def batch(self, docs: list[str]) -> dict[str, list]:
        if len(self.number) > CACHE_WORDS:
            self.clear()
        cut = [t.encode("utf-8", "surrogatepass").split() for t in docs]
        if new := {w for ws in cut for w in ws if w not in self.number}:
            self.learn(list(new))
        number, rows = self.number, []
        for t, ws in zip(docs, cut):
            n = len(ws)
            at = np.fromiter(map(number.__getitem__, ws), np.int64, n)
            raw = 0.0
            if n:
                h = self.hash[at]
                raw = (self.weight[at].sum() + self.model.weights[_bigrams(h)].sum()) / n
            lines = [x for x in t.split("\n") if x.encode("utf-8", "surrogatepass").strip()] if n else []
            blank = sum(map(t.count, " \t\n\v\f\r"))
            repeats = _repeats(h) if n >= WINDOW else 0
            rows.append((n, len(t) - blank, sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, raw))
        n, chars, symbols, dup, rep, raw = (np.array(c) for c in zip(*rows))
        p = self.model.probability(raw.astype(float))
        failed = (n < MIN_WORDS) | (100 * rep > REPEAT_PERCENT * n)
        return {
            "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep,
            "base_failed": failed, "kept": ~failed & (p >= KEEP), "p_quality": p,
        }


def _repeats(h: np.ndarray) -> int:
    """Words inside five-word windows found twice or more, by window hash."""
    with np.errstate(over="ignore"):
        win = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            win = (win * _MIX + h[k : len(h) - WINDOW + 1 + k]) ^ (win >> np.uint64(29))
    order = np.argsort(win, kind="stable")
    same = win[order][1:] == win[order][:-1]
    if not same.any():
        return 0
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(mark)[:-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    y = labels.filter(F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias("y"))
    chosen = stored(y.orderBy(F.xxhash64(id_col), id_col).limit(train_rows), "rules-sample")  # at most train_rows rows
    rows = docs.select(id_col, "text").join(F.broadcast(chosen), id_col).select(F.xxhash64(id_col).alias("o"), "y", "text")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [text_features(ws) if (ws := t.encode("utf-8", "surrogatepass").split()) else ([], []) for t in texts(b.column(2))]
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1).cast(pa.int32()), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
            names=["o", "y", "slot", "value"],
        )

    features = map_batches(rows, fn, "o long, y int, slot array<int>, value array<float>").limit(2 * train_rows)
    fitted = features.repartition(1).sortWithinPartitions("o", "y").mapInArrow(_fit_task, "weights binary, slope double, offset double")
    row = stored(fitted, "rules-model").first()
    return Model.keep_all() if row is None else Model(np.frombuffer(row.weights), row.slope, row.offset)  # no row: no training rows


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fits the model on the sample's sorted rows.  Their features go to
    files of the task without a name (gone with it) and are mapped, so the
    task holds a few rows' at a time whatever their number."""
    lens, ys = [np.zeros(0, np.int64)], [np.zeros(0)]
    with tempfile.TemporaryFile() as slots, tempfile.TemporaryFile() as values:
        for whole in batches:
            for b in slices(whole):
                lens.append(np.diff(b.column(2).offsets.to_numpy()).astype(np.int64))
                ys.append(b.column(1).to_numpy().astype(float))
                slots.write(b.column(2).flatten().to_numpy().tobytes())
                values.write(b.column(3).flatten().to_numpy().tobytes())
        slots.flush()
        values.flush()
        ends = np.r_[0, np.cumsum(np.concatenate(lens))]
        model = Model.keep_all()
        if ends[-1]:
            slot, value = np.memmap(slots, np.int32, "r"), np.memmap(values, np.float32, "r")
            model = Model.fit(ends, slot, value, np.concatenate(ys))
            del slot, value
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.slope]), pa.array([model.offset])], names=["weights", "slope", "offset"]
    )


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double"
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds the base figures, the probability and the verdict to ``docs``
    (same-named columns of ``docs`` are replaced)."""
    new = [c.split()[0] for c in _STATS.split(", ")]
    keep = [c for c in docs.columns if c not in new]
    types, at = dict(docs.dtypes), keep.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for whole in batches:
            for b in slices(whole):
                got = scorer.batch(texts(b.column(at)))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(got[c], t) for c, t in zip(new, _TYPES))], names=[*keep, *new])
            give_back()

    return docs.select(*keep).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", " + _STATS)
