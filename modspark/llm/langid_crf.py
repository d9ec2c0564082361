"""Language identification by a linear-chain conditional random field.

Words (a letter, then letters and marks, lower-cased) are labelled with
learned transitions between languages, so code-switched text gets a label
for every word.  A word's emission score adds hashed weights of its byte 2-
to 4-grams (with a mark at either end, which makes the outer ones affixes)
and of itself if it is in the learned lexicon (seen twice or more in
training).  Forward-backward gives each word's label probabilities; a text's
score for a language is their mean over its words, its prediction the best.

Forward-backward runs over all texts of a batch at once: texts are cut into
chunks of ``CHUNK`` words, every chunk's transfer matrix is computed side by
side, messages pass from chunk to chunk, and the insides are filled in.  This
is exact; no text is shortened.

Training (on the driver, numpy): about ``DOCS_PER_LANG`` documents a language
(by hash of the id) give up to ``SPAN_WORDS`` words each from a hash-chosen
place; spans of about ``SWITCH`` words of random languages are spliced into
training sequences.  These are documented bounds on the training sample only.

Defined cases: null text, or text without a letter: ``und`` with score 0; no
training rows: ``und`` for all; languages are all non-null values of the
training rows; ties go to the first language in order; a null id counts as
'' for the hold-out; repeated rows are labelled each; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, slices, texts

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
DIM_BITS = 16
DOCS_PER_LANG, SPAN_WORDS, SWITCH, SEQUENCE = 400, 256, 16, 64
EPOCHS, BATCH, STEP, RIDGE = 3, 256, 0.1, 1e-5
CHUNK = 64
CACHE_WORDS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * _MIX) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def word_features(words: list[str], lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word number): byte 2- to 4-grams and lexicon entries."""
    raw = [w.encode() for w in words]
    a = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8).astype(np.uint64)
    gap = a == 32
    word = np.cumsum(gap) - 1
    slots, owner = [], []
    code = a
    inner = ~gap
    for n in (2, 3, 4):
        code = code[:-1] << np.uint64(8) | a[n - 1 :]
        if n == 2:
            ok = np.flatnonzero(inner[:-1] | inner[1:])
            at = np.where(inner[ok], ok, ok + 1)
        else:
            core = inner[1 : len(a) - n + 2].copy()
            for k in range(2, n - 1):
                core &= inner[k : len(a) - n + 1 + k]
            ok = np.flatnonzero(core[: len(code)])
            at = ok + 1
        slots.append(_slot(code[ok] + np.uint64(n << 40)))
        owner.append(word[at])
    known = [i for i, w in enumerate(words) if w in lexicon]
    h = np.array([xxhash.xxh64_intdigest(raw[i]) for i in known], np.uint64)
    return np.concatenate([*slots, _slot(h)]), np.concatenate([*owner, np.array(known, np.int64)])


class Crf:
    def __init__(self, labels: list[str], weights, trans, start, lexicon):
        self.labels, self.weights, self.trans, self.start, self.lexicon = labels, weights, trans, start, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        slot, owner = word_features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weights[slot, k], len(words)) for k in range(len(self.labels))], axis=1)

    @classmethod
    def fit(cls, docs: list[tuple[str, list[str]]], seed: int = 7) -> Crf | None:
        """``docs``: (language, words) training spans."""
        labels = sorted({lang for lang, ws in docs if ws})
        if not labels:
            return None
        K, rng = len(labels), np.random.default_rng(seed)
        count: dict[str, int] = {}
        for _, ws in docs:
            for w in ws:
                count[w] = count.get(w, 0) + 1
        lexicon = frozenset(w for w, c in count.items() if c > 1)
        number = {w: i for i, w in enumerate(count)}
        slot, owner = word_features(list(count), lexicon)
        order = np.argsort(owner, kind="stable")
        slot, first = slot[order], np.searchsorted(owner[order], np.arange(len(count) + 1))
        # pieces of about SWITCH words, shuffled over languages, then cut into sequences
        pieces = []
        for lang, ws in docs:
            ids, at, y = [number[w] for w in ws], 0, labels.index(lang) if ws else 0
            while at < len(ids):
                n = int(rng.integers(SWITCH // 2, 2 * SWITCH))
                pieces.append((ids[at : at + n], y))
                at += n
        rng.shuffle(pieces)
        word = np.array([i for p, _ in pieces for i in p])
        gold = np.array([y for p, y in pieces for _ in p])
        n_seq = max(1, len(word) // SEQUENCE)
        size = min(SEQUENCE, len(word))
        word, gold = (x[: n_seq * size].reshape(n_seq, size) for x in (word, gold))
        w, trans, start = np.zeros((1 << DIM_BITS, K)), np.zeros((K, K)), np.zeros(K)
        params, grads = [w, trans, start], None
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(n_seq), max(1, n_seq // BATCH)):
                x, y = word[part], gold[part]
                seen, at = np.unique(x, return_inverse=True)
                at = at.reshape(x.shape)
                lens = first[seen + 1] - first[seen]
                flat = slot[np.repeat(first[seen] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())]
                own = np.repeat(np.arange(len(seen)), lens)
                emit = np.stack([np.bincount(own, w[flat, k], len(seen)) for k in range(K)], axis=1)
                node, edge = _marginals(emit[at], trans, start)
                n = x.size
                d = node
                np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
                per_word = np.stack([np.bincount(at.ravel(), d[:, :, k].ravel(), len(seen)) for k in range(K)], axis=1)
                gw = np.stack([np.bincount(flat, per_word[own, k], len(w)) for k in range(K)], axis=1) / n + RIDGE * w
                pairs = np.bincount((y[:, :-1] * K + y[:, 1:]).ravel(), minlength=K * K).reshape(K, K)
                grads = [gw, (edge - pairs) / n, d[:, 0].sum(0) / n]
                t += 1
                for p, g, a, b in zip(params, grads, m1, m2):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= STEP * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        return cls(labels, w, trans, start, lexicon)


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def _marginals(emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of equal-length sequences (n, T, K), and the sum
    of the expected transitions."""
    n, T, K = emit.shape
    u, m = np.exp(emit - emit.max(-1, keepdims=True)), np.exp(trans - trans.max())
    a, b = np.empty_like(u), np.empty_like(u)
    a[:, 0] = _norm(np.exp(start - start.max()) * u[:, 0])
    for t in range(1, T):
        a[:, t] = _norm((a[:, t - 1] @ m) * u[:, t])
    b[:, -1] = 1 / K
    edge = np.zeros((K, K))
    for t in range(T - 1, 0, -1):
        v = u[:, t] * b[:, t]
        x = a[:, t - 1, :, None] * m * v[:, None, :]
        edge += (x / x.sum((1, 2), keepdims=True)).sum(0)
        b[:, t - 1] = _norm(v @ m.T)
    return _norm(a * b), edge


def mean_marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, per_word: bool = False):
    """Mean label probabilities of each text (rows of ``emit`` are the words
    of all texts, one after the other); every length is at least one."""
    K = emit.shape[1]
    u = np.exp(emit - emit.max(1, keepdims=True))
    m = np.exp(trans - trans.max())
    chunks = -(-lengths // CHUNK)
    text = np.repeat(np.arange(len(lengths)), chunks)
    base = np.r_[0, np.cumsum(chunks)[:-1]]
    k = np.arange(len(text)) - base[text]
    begin = (np.r_[0, np.cumsum(lengths)[:-1]])[text] + k * CHUNK
    size = np.minimum(CHUNK, lengths[text] - k * CHUNK)
    order = np.argsort(-size, kind="stable")  # long chunks first: those still open are a prefix
    begin_o, size_o = begin[order], size[order]
    open_ = [int(np.searchsorted(-size_o, -t, side="left")) for t in range(CHUNK)]
    # transfer matrices: diag(u1) m diag(u2) ... m diag(un)
    c = np.zeros((len(text), K, K))
    c[:, np.arange(K), np.arange(K)] = u[begin_o]
    for t in range(1, CHUNK):
        n = open_[t]
        if n:
            x = (c[:n].reshape(n * K, K) @ m).reshape(n, K, K) * u[begin_o[:n] + t][:, None, :]
            c[:n] = x / x.max((1, 2), keepdims=True)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    c = c[back]
    # messages between the chunks of a text, all texts side by side
    into, after = np.empty((len(text), K)), np.empty((len(text), K))
    by_len = np.argsort(-chunks, kind="stable")
    base_s, chunks_s = base[by_len], chunks[by_len]
    msg = np.tile(_norm(np.exp(start - start.max())), (len(lengths), 1))
    for j in range(int(chunks_s[0]) if len(chunks_s) else 0):
        n = int(np.searchsorted(-chunks_s, -j, side="left"))
        at = base_s[:n] + j
        into[at] = msg[:n]
        msg[:n] = _norm(np.einsum("nk,nkl->nl", msg[:n], c[at]) @ m)
    msg = np.full((len(lengths), K), 1 / K)
    for j in range(int(chunks_s[0]) - 1 if len(chunks_s) else -1, -1, -1):
        n = int(np.searchsorted(-chunks_s, -j, side="left"))
        at = base_s[:n] + j
        after[at] = msg[:n]
        msg[:n] = _norm(np.einsum("nkl,nl->nk", c[at], msg[:n]) @ m.T)
    # inside the chunks
    a = np.empty_like(u)
    x = _norm(into[order] * u[begin_o])
    a[begin_o] = x
    for t in range(1, CHUNK):
        n = open_[t]
        if n:
            x = _norm((x[:n] @ m) * u[begin_o[:n] + t])
            a[begin_o[:n] + t] = x
    b = np.empty_like(u)
    y = after[order]
    for t in range(CHUNK - 1, -1, -1):
        n = open_[t]
        if n:
            b[begin_o[:n] + t] = y[:n]
            y[:n] = _norm((u[begin_o[:n] + t] * y[:n]) @ m.T)
    p = _norm(a * b)
    if per_word:
        return p
    return np.add.reduceat(p, np.r_[0, np.cumsum(lengths)[:-1]], axis=0) / lengths[:, None]


class Tagger:
    def __init__(self, model: Crf):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.model.labels)))

    def batch(self, docs: list[str], per_word: bool = False):
        """(words per text, mean label probabilities of texts with words)."""
        if len(self.number) > CACHE_WORDS:
            self.clear()
        cut = [WORD.findall(t.lower()) for t in docs]
        if new := list({w for ws in cut for w in ws if w not in self.number}):
            for i, w in enumerate(new, len(self.number)):
                self.number[w] = i
            self.emit = np.concatenate([self.emit, self.model.emissions(new)])
        lengths = np.array([len(ws) for ws in cut])
        look = self.number.__getitem__
        at = np.fromiter((i for ws in cut for i in map(look, ws)), np.int64, int(lengths.sum()))
        some = lengths[lengths > 0]
        if not len(some):
            return cut, np.zeros((0, len(self.model.labels)))
        return cut, mean_marginals(self.emit[at], some, self.model.trans, self.model.start, per_word)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf | None:
    """Fit on a hash sample of ``docs`` of about DOCS_PER_LANG a language."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rates = {r[0]: DOCS_PER_LANG / r[1] for r in rows.groupBy(lang).count().collect()}  # one row a language
    if not rates:
        return None
    u = (F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) / (1 << 20)).alias("u")
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col(lang))
    sample = rows.filter(u < rate).select(F.xxhash64(id_col).alias("o"), F.col(lang).alias("lang"), F.col(text).alias("text"))

    def spans(batches):
        for b in batches:
            for part in slices(b):
                out = []
                for o, t in zip(part.column(0).to_pylist(), texts(part.column(2))):
                    ws = WORD.findall(t.lower())
                    at = o % max(1, len(ws) - SPAN_WORDS + 1)
                    out.append(" ".join(ws[at : at + SPAN_WORDS]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["o", "lang", "words"])

    got = sample.mapInArrow(spans, "o long, lang string, words string").limit(4 * DOCS_PER_LANG * len(rates)).toArrow()
    got = got.sort_by([("o", "ascending"), ("words", "ascending")])
    return Crf.fit([(x, w.split()) for x, w in zip(got["lang"].to_pylist(), got["words"].to_pylist())])


def predict(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row."""
    id_type = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = Tagger(shared.value) if shared.value else None
        for whole in batches:
            for b in slices(whole):
                lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                if tagger:
                    cut, p = tagger.batch(texts(b.column(1)))
                    at = [i for i, ws in enumerate(cut) if ws]
                    best = p.argmax(1) if len(p) else []
                    for i, k, row in zip(at, best, p):
                        lang[i], score[i] = tagger.model.labels[k], min(1.0, row[k])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")


def label_words(docs: DataFrame, model: Crf, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, words, langs): the most probable language of every word."""
    id_type = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tagger = Tagger(shared.value)
        for whole in batches:
            for b in slices(whole):
                cut, p = tagger.batch(texts(b.column(1)), per_word=True)
                best = iter(p.argmax(1).tolist())
                langs = [[tagger.model.labels[next(best)] for _ in ws] for ws in cut]
                kinds = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, kinds), pa.array(langs, kinds)], names=[id_col, "words", "langs"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {id_type}, words array<string>, langs array<string>")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.  Learns only from
    rows whose id's crc32 modulo ``folds`` is not ``held``."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.filter(crc_bucket(F.col("doc_id"), folds) != held))
    return predict(rows, model).select("doc_id", (crc_bucket(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
