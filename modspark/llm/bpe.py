"""BPE encoding and decoding by speculation and verification.

A word (pre-token) is first cut greedily into the longest vocabulary entries.
That guess is the exact BPE result if and only if every entry encodes to
itself and no merge ever crosses the boundary of two adjacent entries.  The
second test is made for all adjacent pairs of a batch at once: walking back
in time over the right edge of the left entry and the left edge of the right
one, a merge of rank r crosses if both edge pieces exist when r is applied.
Only words with a failing pair are merged exactly.  Words of all three kinds
are kept in a bounded cache.

Texts of characters below U+0180 (but U+0130) are normalised and cut by a plain regular
expression whose classes are checked against the tokenizer in the tests; any
other text goes through the tokenizer's own normaliser and pre-tokenizer.
Special tokens in a text are matched first, as the tokenizers library does.

Defined cases: null text is empty and has no tokens; ids may be null;
repeated rows are encoded each; extra columns are ignored; no rows give no
rows; a text is never cut before it is cut into words.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_batches, texts

SAFE_BELOW = 0x180
CACHE_WORDS = 80_000  # words in each of the two cache generations of a Python worker
NEVER = np.int64(1 << 40)
_NONE = 1 << 40


def _byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> tuple[str, str, str]:
    """Character classes of letters, numbers and white space below SAFE_BELOW."""
    def cls(keep):
        return "".join(f"\\x{c:02x}" if c < 256 else chr(c) for c in range(SAFE_BELOW) if keep(chr(c)))

    return (
        cls(lambda c: unicodedata.category(c)[0] == "L"),
        cls(lambda c: unicodedata.category(c)[0] == "N"),
        cls(lambda c: c in "\t\n\v\f\r \x85\xa0"),
    )


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.lib = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)))
        vocab = model["vocab"]
        self.n = max([*vocab.values(), *self.specials.values()]) + 1
        self.token = [""] * self.n
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.token[i] = s
        # symbols: one character a byte, the last byte of a word from U+0100 on
        to_byte = _byte_chars()
        self.char_of = {v: k for k, v in to_byte.items()}
        self.symbol_id: dict[str, int] = {}
        self.words = ahocorasick.Automaton()
        for s, i in vocab.items():
            end = s.endswith(self.suffix) and len(s) > len(self.suffix)
            body = [to_byte[c] for c in (s[: -len(self.suffix)] if end else s)]
            sym = "".join(map(chr, body[:-1])) + chr(body[-1] + (256 if end else 0))
            self.symbol_id[sym] = i
        # merges
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.left = np.full(self.n, -1, np.int64)
        self.right = np.full(self.n, -1, np.int64)
        self.rank = np.full(self.n, -1, np.int64)
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.merge_made: list[int] = []  # by rank
        for r, (a, b) in enumerate(pairs):
            x, y = vocab[a], vocab[b]
            z = vocab[a + b]
            self.merge_rank.setdefault((x, y), r)
            self.merge_made.append(z)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x * self.n + y for x, y in self.merge_rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array(list(self.merge_rank.values()), np.int64)[order]
        # an entry is proposed only if it encodes to itself
        made = np.flatnonzero(self.rank >= 0)
        parts = np.maximum(self.rank[self.left[made]], self.rank[self.right[made]])
        sound = np.ones(self.n, bool)
        sound[made] = (self.crossing(self.left[made], self.right[made]) == self.rank[made]) & (parts < self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        base = self.rank < 0
        for sym, i in self.symbol_id.items():
            if sound[i] and (len(sym) == 1 or not base[i]):
                self.words.add_word(sym, (i, len(sym)))
        self.words.make_automaton()
        letters, numbers, space = _classes()
        self.unsafe = re.compile(f"[^\\x00-{chr(SAFE_BELOW - 1)}]|\u0130")
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.cache: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    # --- exact tests and merges ------------------------------------------
    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of entries the rank of the first merge over their
        boundary (NEVER if none).  A piece of the left edge exists until its
        parent's merge, strictly; of the right edge, until and including it,
        as equal merges go left to right."""
        out = np.full(len(a), NEVER)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        gone_a, gone_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            r = self._lookup(a, b)
            hit = (r < gone_a) & (r <= gone_b)
            out[live[hit]] = np.minimum(out[live[hit]], r[hit])
            ra, rb = self.rank[a], self.rank[b]
            back_a = (ra >= rb) & (ra >= 0)
            back_b = ~back_a & (rb >= 0)
            gone_a, gone_b = np.where(back_a, ra, gone_a), np.where(back_b, rb, gone_b)
            a, b = np.where(back_a, self.right[a], a), np.where(back_b, self.left[b], b)
            on = back_a | back_b
            live, a, b, gone_a, gone_b = live[on], a[on], b[on], gone_a[on], gone_b[on]
        return out

    def merge_word(self, sym: str) -> list[int]:
        """Exact merging: the lowest-ranked pair first, leftmost among equals."""
        ids = [self.symbol_id[c] for c in sym]
        rank, made = self.merge_rank.get, self.merge_made
        ranks = [rank(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < _NONE:
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NONE)
        return ids

    # --- words ------------------------------------------------------------
    def learn(self, words: list[str]) -> None:
        """Put the encodings of new words into the cache."""
        syms, guess, ok = [], [], []
        for w in words:
            raw = w.encode()
            sym = raw[:-1].decode("latin-1") + chr(raw[-1] + 256)
            found = [v for _, v in self.words.iter_long(sym)]
            syms.append(sym)
            ok.append(sum(n for _, n in found) == len(sym))
            guess.append([i for i, _ in found])
        counts = np.array([len(g) for g in guess])
        flat = np.array([i for g in guess for i in g], np.int64)
        if len(flat) > 1:
            word = np.repeat(np.arange(len(words)), counts)
            inner = np.flatnonzero(word[1:] == word[:-1])
            pair, where = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
            bad = self.crossing(pair // self.n, pair % self.n) < NEVER
            for w in np.unique(word[inner[bad[where]]]).tolist():
                ok[w] = False
        token = self.token
        for w, sym, ids, good in zip(words, syms, guess, ok):
            if not good:
                ids = self.merge_word(sym)
            self.cache[w] = (" ".join(map(str, ids)), " ".join([token[i] for i in ids]))

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.unsafe.search(text):
            chars = self.char_of_inverse
            found = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))
            return [bytes(chars[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in found]
        return self.cut.findall(text.lower())

    @functools.cached_property
    def char_of_inverse(self) -> dict[str, int]:
        return {c: b for b, c in self.char_of.items()}

    def encode_batch(self, docs: list[str]) -> list[tuple[str, str]]:
        """Per text: the decimal ids and the decoded text, both joined by a
        space (the tokenizer has no decoder, so tokens are joined so)."""
        out = []
        cut: list[list[str]] = []
        for t in docs:
            if "<|" in t and self.special_re.search(t):
                at, ws = 0, []
                for m in self.special_re.finditer(t):
                    ws += [*self.pieces(t[at : m.start()]), m.group() + "\0special"]
                    at = m.end()
                cut.append(ws + self.pieces(t[at:]))
            else:
                cut.append(self.pieces(t))
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            self.older, self.cache = cache, {}
            cache = self.cache
        for s, i in self.specials.items():
            cache[s + "\0special"] = (str(i), s)
        new = {w for ws in cut for w in ws if w not in cache}
        known = new & self.older.keys()
        cache.update((w, self.older[w]) for w in known)
        if new := new - known:
            self.learn(list(new))
        for ws in cut:
            e = [cache[w] for w in ws]
            out.append((" ".join([x[0] for x in e]), " ".join([x[1] for x in e])))
        return out

    def forget(self) -> None:
        """Empty the word cache (workers outlive their tasks)."""
        self.cache, self.older = {}, {}

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, if asked, ids; drops
    the text column and columns of these names.  Encoding and decoding run in
    one pass over the texts."""
    out = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])
    keep = [c for c in docs.columns if c not in (text, *out)]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        found = codec(path).encode_batch(texts(b.column(len(keep))))
        counts = [i.count(" ") + 1 if i else 0 for i, _ in found]
        cols = [*b.columns[:-1], pa.array(counts, pa.int64())]
        cols += [
            pa.array([hashlib.sha256(f[k].encode("utf-8", "surrogatepass")).hexdigest() for f in found]) for k in (0, 1)
        ]
        if with_ids:
            flat = np.array(" ".join(i for i, _ in found if i).split(), dtype=np.int32)
            ends = np.cumsum([0, *counts]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.RecordBatch.from_arrays(cols, names=[*keep, *out])

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""
    return map_batches(docs.select(*keep, text), fn, schema, done=lambda: codec(path).forget())


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of an id array column (null: empty)."""
    types = dict(rows.dtypes)
    names, at = rows.columns, rows.columns.index(ids)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([c.decode(x or []) for x in b.column(at).to_pylist()], pa.string())], names=[*names, "decoded"]
        )

    return map_batches(rows, fn, ", ".join(f"`{c}` {types[c]}" for c in names) + ", decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    return encode(docs.select("doc_id", F.col("text")), path, with_ids=False)
