"""Secret scanning with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that every match must contain (AND along a concatenation, OR over branches
and small character classes).  Every block of texts gets an inverted index
(trigram -> posting list of texts, over ASCII-lowered UTF-8 bytes, restricted
to the trigrams some rule asks for); a rule's postings are intersected and
united, and only the candidates are run through the regular expression.
Rules without mandatory trigrams are run over all texts.

Matches are leftmost and non-overlapping per kind; a match whose checked
group is shorter than the rule's minimum is dropped after matching.  Offsets
are code points, ends exclusive.

Defined cases: null text is empty (no spans); null ids are kept; repeated
rows are scanned each; ties in start are ordered by the rules' order; extra
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
import re._parser as sre
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    #: a pattern with the same accepted matches that is faster to run over whole texts
    run: str = ""


# The base rules, in their listed order, then the added ones.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.IGNORECASE | re.ASCII, 2, 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    # a maximal run of 24 or more is exactly an accepted match of the base pattern
    Rule("hex", r"[0-9a-f]+", 0, 0, 24, run=r"[0-9a-f]{24,}"),
)
# A private key to its END line; without one, to the end of its header and base64 lines.
_BREAK = r"(?:\r?\n|\r|\\r\\n|\\n|\\r)[ \t>|]*"  # of lines, also escaped or quoted ones
_PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:"
    r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----|"
    rf"(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*+"
    r"(?:(?:\s|\\[nr]|[>|])*+[A-Za-z0-9+/=]{16,}+|"
    rf"{_BREAK}[A-Za-z0-9+/=]++[ \t]*+(?=[\r\n\\\"'`]|\Z))*+)"
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", _PEM),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + ADDED

MAX_EXACT = 64  # strings tracked exactly per part of an expression; beyond it the part asks for nothing


# --- Boolean trigram queries ---------------------------------------------
# A query is True (asks nothing), a trigram (bytes), or ("and" | "or", parts).

def _all(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]) -> object:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items: list) -> set[bytes] | None:
    """The lowered members of a small character class, else None."""
    out: set[bytes] = set()
    for op, v in items:
        if op is sre.LITERAL:
            out.add(_low(chr(v)))
        elif op is sre.RANGE and v[1] - v[0] < MAX_EXACT:
            out.update(_low(chr(c)) for c in range(v[0], v[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def _low(s: str) -> bytes:
    return s.encode().lower()


def _part(op, v) -> tuple[set[bytes] | None, object]:
    """(the strings the part matches exactly or None, its query)."""
    if op is sre.LITERAL:
        return {_low(chr(v))}, True
    if op is sre.IN:
        return _class(v), True
    if op is sre.SUBPATTERN:
        return _sequence(v[3])
    if op is sre.BRANCH:
        found = [_sequence(x) for x in v[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MAX_EXACT:
            return set().union(*(e for e, _ in found)), True
        return None, _any([q if e is None else _of_strings(e) for e, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, sub = v
        exact, query = _sequence(sub)
        if low == 0:
            return (exact | {b""}, True) if exact is not None and high == 1 else (None, True)
        return None, query if exact is None else _of_strings(exact)
    if op is sre.AT:
        return {b""}, True
    return None, True


def _sequence(items) -> tuple[set[bytes] | None, object]:
    run, asked, whole = {b""}, [], True
    for op, v in items:
        exact, query = _part(op, v)
        if exact is not None and len(run) * len(exact) <= MAX_EXACT:
            run = {a + b for a, b in product(run, exact)}
            continue
        asked += [_of_strings(run), query if exact is None else _of_strings(exact)]
        run, whole = {b""}, False
    return (run, True) if whole else (None, _all([*asked, _of_strings(run)]))


def trigram_query(pattern: str, flags: int = 0) -> object:
    """The Boolean trigram query that each match of ``pattern`` satisfies."""
    exact, query = _sequence(sre.parse(pattern, flags))
    return query if exact is None else _of_strings(exact)


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Index:
    """Inverted index of one block of texts over the trigrams asked for."""

    def __init__(self, docs: list[str], wanted: set[bytes]):
        self.n = len(docs)
        data = [d.encode("utf-8", "surrogatepass").lower() for d in docs]
        ends = np.cumsum([len(d) + 2 for d in data])
        a = np.frombuffer(b"\0\0".join([*data, b""]), dtype=np.uint8)
        table = np.zeros(1 << 16, dtype=bool)  # first two bytes of a wanted trigram
        for w in wanted:
            table[w[0] << 8 | w[1]] = True
        pair = a[:-1].astype(np.uint16) << 8 | a[1:]
        at = np.flatnonzero(table[pair[: max(0, len(a) - 2)]])
        code = pair[at].astype(np.int64) << 8 | a[at + 2]
        order = np.argsort(code, kind="stable")
        code, doc = code[order], np.searchsorted(ends, at[order], side="right")
        self.postings = {}
        for w in wanted:
            c = w[0] << 16 | w[1] << 8 | w[2]
            lo, hi = np.searchsorted(code, [c, c + 1])
            self.postings[w] = np.unique(doc[lo:hi])

    def find(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        found = [self.find(q) for q in query[1]]
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = [
            (r, re.compile(r.run or r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules
        ]
        self.wanted = set().union(*(trigrams(q) for _, _, q in self.rules))

    def scan(self, docs: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans (start, rule number, end), in order."""
        index = Index(docs, self.wanted)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        for k, (r, rx, query) in enumerate(self.rules):
            for i in index.find(query).tolist():
                for m in rx.finditer(docs[i]):
                    if m.end(r.group) - m.start(r.group) >= r.least:
                        spans[i].append((m.start(), k, m.end()))
        for s in spans:
            s.sort()
        return spans


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Per row: the id and ``spans``, an array of (kind, start, end)."""
    id_type = dict(docs.dtypes)[id_col]
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        found = Scanner(rules).scan(texts(b.column(1)))
        rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in found]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], names=[id_col, "spans"])

    schema = f"`{id_col}` {id_type}, spans array<struct<kind:string,start:int,end:int>>"
    return map_batches(docs.select(id_col, text), fn, schema)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", rules=RULES) -> DataFrame:
    """``docs`` with every span (overlapping ones merged) replaced by ``mask``."""
    names, at = docs.columns, docs.columns.index(text)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b.column(at).to_pylist()
        found = Scanner(rules).scan([t or "" for t in raw])
        out = [t if not spans else _cut(t, spans, mask) for t, spans in zip(raw, found)]
        cols = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return map_batches(docs, fn, docs.schema)


def _cut(t: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    start, end = spans[0][0], spans[0][2]
    for s, _, e in [*spans[1:], (len(t) + 1, 0, len(t) + 1)]:
        if s < end:
            end = max(end, e)
            continue
        out += [t[at:start], mask]
        at, start, end = end, s, e
    return "".join([*out, t[at:]])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans and list of all spans of :func:`find_secrets`."""
    base = [r.kind for r in BASE]

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return found.select(
        id_col, *counts,
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
