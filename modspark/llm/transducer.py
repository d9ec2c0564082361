"""Minimal acyclic transducers from sorted terms to their ordinals.

``build`` adds the terms of each group (language) in byte order, joining equal
states as soon as no later term can reach them, and gives every edge the
number of terms that sort before those behind it; the sum along a term's path
is its ordinal.  ``Transducer.walk`` streams whole texts through it: all terms
of a buffer move on by one byte a step, until their delimiter or a byte
without an edge.

Terms over ``LONG`` bytes enter by their first LONG bytes and a mark that sorts
after every byte of UTF-8; those that share them are one accepting state of as
many ordinals and are told apart by their digests.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable

import numpy as np

LONG = 192
MARK = 0xFF
DELIMITER = 0x20


class _Builder:
    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.edges: list[tuple[tuple[int, int], ...]] = []  # a state's (byte, state)
        self.weight: list[int] = []  # terms that end in it
        self.count: list[int] = []  # terms from it on

    def _join(self, node: list) -> int:
        """The state with this node's weight and edges, an old one if there is one."""
        key = (node[0], tuple(node[1]))
        at = self.register.get(key)
        if at is None:
            at = self.register[key] = len(self.edges)
            self.edges.append(key[1])
            self.weight.append(node[0])
            self.count.append(node[0] + sum(self.count[t] for _, t in key[1]))
        return at

    def add(self, terms: Iterable[bytes]) -> int:
        """The root of the sorted ``terms`` (equal ones count)."""
        path, last = [[0, []]], b""  # open nodes: [weight, edges] along the last term
        for term in terms:
            same = 0
            for a, b in zip(last, term):
                if a != b:
                    break
                same += 1
            self._close(path, last, same)
            path.extend([0, []] for _ in range(same, len(term)))
            path[-1][0] += 1
            last = term
        self._close(path, last, 0)
        return self._join(path[0])

    def _close(self, path: list, last: bytes, keep: int) -> None:
        for k in range(len(last), keep, -1):
            path[k - 1][1].append((last[k - 1], self._join(path.pop())))


def coded(term: bytes) -> bytes:
    return term if len(term) <= LONG else term[:LONG] + bytes([MARK])


def digest(term: bytes) -> bytes:
    return hashlib.sha256(term).digest()


class Transducer:
    """States as bitmaps of the bytes they go on with; every edge has its
    target and ordinal step.  ``groups``: group -> (root, first ordinal)."""

    def __init__(self, groups: dict, bits, rank, weight, target, step, long: dict):
        self.groups, self.long = groups, long
        self.bits, self.rank, self.weight, self.target, self.step = bits, rank, weight, target, step

    def _advance(self, b: np.ndarray, live: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """(term, place, state, ordinal) of the terms that have an edge for ``b``."""
        act, at, s, out = live
        word = s * 4 + (b >> 6)
        shift = (b & 63).astype(np.uint64)
        bits = self.bits[word]
        hit = np.flatnonzero((bits >> shift) & np.uint64(1))
        below = bits[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
        edge = self.rank[word[hit]] + np.bitwise_count(below)
        return act[hit], at[hit] + 1, self.target[edge], out[hit] + self.step[edge]

    def walk(self, buf: np.ndarray, start: np.ndarray, state: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term number, ordinal) of the accepted terms.  ``buf`` holds bytes
        with a DELIMITER after every term, ``start`` their first places,
        ``state`` and ``base`` the root and first ordinal of their group."""
        live = (np.arange(len(start)), start, state.astype(np.int64), base)
        terms, ordinals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(LONG + 1):
            act, at, s, out = live
            if not len(act):
                break
            b = buf[at]
            done = np.flatnonzero(b == DELIMITER)
            done = done[self.weight[s[done]] > 0]
            terms.append(act[done])
            ordinals.append(out[done])
            if k < LONG:
                live = self._advance(b, live)
        else:  # terms over LONG bytes are at the mark
            rest = np.flatnonzero(b != DELIMITER)
            act, _, s, out = self._advance(np.full(len(rest), MARK, np.uint8), tuple(x[rest] for x in live))
            for i, o in zip(act.tolist(), out.tolist()):
                place = self.long.get((int(state[i]), digest(_whole(buf, int(start[i])))))
                if place is not None:
                    terms.append(np.array([i]))
                    ordinals.append(np.array([o + place]))
        return np.concatenate(terms), np.concatenate(ordinals)


def _whole(buf: np.ndarray, start: int) -> bytes:
    """The bytes from ``start`` up to the next delimiter."""
    parts, at = [], start
    while True:
        part = buf[at : at + 65536]
        stop = np.flatnonzero(part == DELIMITER)
        if len(stop) or not len(part):
            parts.append(part[: stop[0]] if len(stop) else part)
            return b"".join(x.tobytes() for x in parts)
        parts.append(part)
        at += len(part)


def build(groups: list[tuple[str, int, list[bytes]]]) -> Transducer:
    """``groups``: (name, first ordinal, terms in byte order, each once)."""
    b, roots, long = _Builder(), {}, {}
    for name, first, terms in groups:
        codes = [coded(t) for t in terms]
        root = b.add(codes)
        roots[name] = (root, first)
        place = 0
        for k, (code, term) in enumerate(zip(codes, terms)):
            place = place + 1 if k and codes[k - 1] == code else 0
            if len(term) > LONG:
                long[root, digest(term)] = place
    n = len(b.edges)
    lens = np.array([len(e) for e in b.edges], np.int64)
    flat = np.array([x for e in b.edges for x in e], np.int64).reshape(-1, 2)
    source, byte, target = np.repeat(np.arange(n), lens), flat[:, 0], flat[:, 1]
    weight, count = np.array(b.weight, np.int64), np.array(b.count, np.int64)
    bits = np.zeros(n * 4, np.uint64)
    word = source * 4 + (byte >> 6)
    np.bitwise_or.at(bits, word, np.uint64(1) << (byte & 63).astype(np.uint64))
    rank = np.zeros(n * 4, np.int64)
    rank[1:] = np.cumsum(np.bitwise_count(bits))[:-1]
    # terms before an edge: those that end in its state and those of the edges before
    total = np.cumsum(count[target]) - count[target] if len(target) else target
    begin = np.zeros(n, np.int64)
    begin[lens > 0] = total[(np.cumsum(lens) - lens)[lens > 0]]
    step = total - begin[source] + weight[source]
    return Transducer(roots, bits, rank, weight, target, step, long)


def pack(t: Transducer) -> bytes:
    """The transducer as the bytes of a NumPy archive."""
    names = [g.encode("utf-8", "surrogatepass") for g in t.groups]
    out = io.BytesIO()
    np.savez(
        out, names=np.frombuffer(b"".join(names), np.uint8), ends=np.cumsum([len(x) for x in names]).astype(np.int64),
        groups=np.array(list(t.groups.values()), np.int64).reshape(-1, 2), bits=t.bits, rank=t.rank.astype(np.int32),
        weight=t.weight.astype(np.int32), target=t.target.astype(np.int32), step=t.step.astype(np.int32),
        long=np.array([(r, p) for (r, _), p in t.long.items()], np.int64).reshape(-1, 2),
        digests=np.frombuffer(b"".join(d for _, d in t.long), np.uint8),
    )
    return out.getvalue()


def unpack(data: bytes) -> Transducer:
    f = np.load(io.BytesIO(data), allow_pickle=False)
    raw, ends = f["names"].tobytes(), [0, *f["ends"].tolist()]
    names = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:])]
    groups = {g: (r, first) for g, (r, first) in zip(names, f["groups"].tolist())}
    raw = f["digests"].tobytes()
    long = {(r, raw[32 * k : 32 * k + 32]): p for k, (r, p) in enumerate(f["long"].tolist())}
    return Transducer(groups, f["bits"], f["rank"], f["weight"], f["target"], f["step"], long)
