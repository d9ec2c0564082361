"""External induced suffix sorting with common-prefix values.

``repeated_starts`` finds every position of a shard's text whose next
``depth`` symbols also start at another position.  Suffixes are sorted to
that depth in three steps:

1. The S* suffixes (a smaller-than-next symbol after a larger-than-next one)
   are ranked: the pieces between them get order-preserving names, and names
   of neighbouring pieces are joined two, four, eight ... at a time (the
   recursion's levels) until the depth is covered.
2. Going up through the buckets of first symbols, each sorted suffix induces
   the larger-than-next suffix before it; 3. going down, the smaller-than-next
   one.  Tuples (position, length of the common prefix with the tuple before
   it) wait in a priority queue ordered by first symbol, then arrival, whose
   buckets go to an anonymous file when more than ``memory`` tuples wait.  A
   tuple's common prefix is one more than the minimum over the tuples scanned
   since its bucket's last arrival.

Batches of a bucket are handled with numpy, and so are stretches of one
repeated symbol, whose rounds differ by a place only; symbols are 16-bit, 0 parts the
strings of a shard.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

_FAR = np.int16(32000)
_STEP, _BLOCK = 1 << 16, 1 << 18


class BucketQueue:
    """Tuples by bucket, in order of arrival, spilled beyond ``memory``."""

    def __init__(self, buckets: int, memory: int):
        self.parts: list[list] = [[] for _ in range(buckets)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, bucket: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[bucket].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # has no name: gone with the task
        for parts in self.parts:
            for i, part in enumerate(parts):
                if not isinstance(part[0], int):
                    at = self.file.seek(0, 2)
                    self.file.write(part[0].astype(np.int32).tobytes() + part[1].astype(np.int16).tobytes())
                    parts[i] = (at, len(part[0]))
        self.held = 0

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts[bucket] = self.parts[bucket], []
        out = []
        for a, b in parts:
            if isinstance(a, int):
                self.file.seek(a)
                raw = self.file.read(6 * b)
                out.append((np.frombuffer(raw, np.int32, b), np.frombuffer(raw, np.int16, b, 4 * b)))
            else:
                out.append((a, b))
                self.held -= len(a)
        if not out:
            return np.zeros(0, np.int32), np.zeros(0, np.int16)
        return tuple(map(np.concatenate, zip(*out))) if len(out) > 1 else out[0]


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of x[lo .. hi] (inclusive) for each pair, by a sparse table."""
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    table, j = x, 0
    while True:
        at = np.flatnonzero(level == j)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << j) + 1])
        if j >= level.max(initial=0):
            return out
        table = np.minimum(table[: -(1 << j)], table[1 << j :])
        j += 1


class _Pass:
    """One direction: scanned batches push the suffixes before them."""

    def __init__(self, text, small: np.ndarray, want: bool, depth: int, memory: int, buckets: int):
        self.text, self.small, self.want, self.depth = text, small, want, depth
        self.queue = BucketQueue(buckets, memory)
        self.low = np.zeros(buckets, np.int16)  # minimum since each bucket's last arrival

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for i in range(0, len(pos), _STEP):
            self._scan(pos[i : i + _STEP], lcp[i : i + _STEP])

    def _scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        k = np.flatnonzero((pos > 0) & (self.small[before] == self.want))
        least = lcp.min()
        if len(k):
            ch = self.text[before[k]]
            order = np.argsort(ch, kind="stable")
            ch, k = ch[order], k[order]
            first = np.r_[True, ch[1:] != ch[:-1]]
            lo = np.where(first, 0, np.r_[0, k[:-1] + 1])
            got = _range_min(lcp, lo, k)
            starts = np.flatnonzero(first)
            chars = ch[starts]
            got[starts] = np.minimum(got[starts], self.low[chars])
            got = np.minimum(got + 1, self.depth).astype(np.int16)
            out = before[k].astype(np.int32)
            ends = np.r_[starts[1:], len(k)]
            for c, s, e in zip(chars.tolist(), starts.tolist(), ends.tolist()):
                self.queue.push(c, out[s:e], got[s:e])
            self.low = np.minimum(self.low, least)
            last = k[ends - 1]
            tail = np.full(len(chars), _FAR)
            more = last + 1 < len(lcp)
            if more.any():
                tail[more] = _range_min(lcp, last[more] + 1, np.full(int(more.sum()), len(lcp) - 1))
            self.low[chars] = tail
        else:
            self.low = np.minimum(self.low, least)


    def rounds(self, c: int, pos: np.ndarray, lcp: np.ndarray, many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The next ``many`` rounds of bucket ``c`` at once: while each of its
        suffixes has the bucket's symbol before it, a round is the one before
        moved back by one place, with common prefixes longer by one.  The
        round after them is left in the queue."""
        first = min(int(lcp[0]), int(self.low[c]))

        def block(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = pos[None, :] - k[:, None]
            long = np.minimum(lcp.astype(np.int32)[None, :] + k[:, None], self.depth)
            long[:, 0] = np.where(k == 0, lcp[0], np.minimum(first + k, self.depth))
            return at.ravel().astype(np.int32), long.ravel().astype(np.int16)

        step = max(1, _BLOCK // len(pos))
        for k in range(0, many, step):
            yield block(np.arange(k, min(k + step, many)))
        self.low = np.minimum(self.low, min(int(lcp.min()), first + 1)).astype(np.int16)
        self.low[c] = _FAR
        self.queue.push(c, *block(np.array([many])))


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller than the next suffix, run length of the first symbol)."""
    n = len(text)
    sign = np.full(n, -1, np.int8)  # the end of the text is below everything
    sign[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    at = np.arange(n, dtype=np.int32)
    turn = np.minimum.accumulate(np.where(sign != 0, at, n)[::-1])[::-1]
    return sign[turn] > 0, (turn - at + 1).astype(np.int32)


def _regroup(rank: np.ndarray, who: np.ndarray, key: np.ndarray) -> None:
    """Refine the ranks (first place of a group) of ``who`` by ``key``; the
    groups of ``who`` must be whole."""
    order = np.lexsort((key, rank[who]))
    w, k, r = who[order], key[order], rank[who[order]]
    new = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]
    old = np.r_[True, r[1:] != r[:-1]]
    at = np.arange(len(w))
    rank[w] = r + (np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0)))


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _star_order(text: np.ndarray, small: np.ndarray, star: np.ndarray, depth: int) -> np.ndarray:
    """The S* suffixes in order, to ``depth`` symbols."""
    m = len(star)
    length = np.minimum(np.append(star[1:], len(text) - 1) - star + 1, depth)
    symbol = np.append(text.astype(np.int64) * 2 + small, 0)
    rank = np.zeros(m, np.int64)
    who = np.arange(m)
    for done in range(0, int(length.max()), 6):
        key = np.zeros(len(who), np.int64)
        for d in range(done, done + 6):
            key = key << 10 | np.where(d < length[who], symbol[np.minimum(star[who] + d, len(text))], 0)
        _regroup(rank, who, key)
        who = _tied(rank)
        who = who[length[who] > done + 6]
        if not len(who):
            break
    step = 1
    while step < depth:
        who = _tied(rank)
        if not len(who):
            break
        after = who + step
        _regroup(rank, who, np.where(after < m, rank[np.minimum(after, m - 1)], -1))
        step *= 2
    return star[np.argsort(rank, kind="stable")]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths of suffix pairs, to ``depth``."""
    wide = 32
    padded = np.concatenate([text, np.zeros(depth + wide, text.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(padded, wide)
    out = np.zeros(len(a), np.int16)
    for i in range(0, len(a), 1 << 17):
        who = np.arange(i, min(i + (1 << 17), len(a)))
        done = 0
        while len(who) and done < depth:
            differ = view[a[who] + done] != view[b[who] + done]
            hit = differ.any(1)
            out[who] = done + np.where(hit, differ.argmax(1), wide)
            who, done = who[~hit], done + wide
    return np.minimum(out, depth)


def repeated_starts(text: np.ndarray, depth: int, memory: int = 1 << 22) -> np.ndarray:
    """Marks the positions of ``text`` (uint16, ends with 0) whose next
    ``depth`` symbols start elsewhere too.  Positions fewer than ``depth``
    symbols before their string's end may be marked wrongly."""
    n, buckets = len(text), int(text.max()) + 1
    small, run = _types(text)
    same = np.r_[False, text[1:] == text[:-1]]
    at = np.arange(n, dtype=np.int32)
    behind = at - np.maximum.accumulate(np.where(same, 0, at))  # equal symbols before each place
    star = np.flatnonzero(small & np.r_[False, ~small[:-1]]).astype(np.int32)
    if len(star):
        star = _star_order(text, small, star, depth)
        star_lcp = np.r_[np.int16(0), _common(text, star[:-1], star[1:], depth)].astype(np.int16)
        star_at = np.searchsorted(text[star], np.arange(buckets + 1))
    else:
        star_at = np.zeros(buckets + 1, int)

    def cross(x: int, y: int) -> int:  # a larger-than-next against a smaller-than-next suffix of a bucket
        return min(int(run[x]), int(run[y]), depth)

    up = _Pass(text, small, False, depth, memory, buckets)
    large = BucketQueue(buckets, memory)
    up.scan(np.array([n], np.int32), np.zeros(1, np.int16))
    for c in range(buckets):
        end = -1
        while True:
            pos, lcp = up.queue.pop(c)
            if not len(pos):
                break
            if end < 0:
                lcp = lcp.copy()
                lcp[0] = 0
            if (many := int(behind[pos].min())) > 1:
                for p, x in up.rounds(c, pos, lcp, many):
                    large.push(c, p, x)
                    end = int(p[-1])
                continue
            large.push(c, pos, lcp)
            up.scan(pos, lcp)
            end = int(pos[-1])
        s, e = star_at[c], star_at[c + 1]
        if s < e:
            lcp = star_lcp[s:e].copy()
            lcp[0] = cross(end, int(star[s])) if end >= 0 else 0
            up.scan(star[s:e], lcp)

    marked = np.zeros(n, bool)

    def mark(pos, lcp, before: int) -> None:
        hit = np.flatnonzero(lcp >= depth)
        if len(hit):
            marked[pos[hit]] = True
            marked[np.where(hit > 0, pos[hit - 1], before)] = True

    down = _Pass(text, small, True, depth, memory, buckets)
    for c in range(buckets - 1, -1, -1):
        end = -1
        while True:
            pos, lcp = down.queue.pop(c)
            if not len(pos):
                break
            if end < 0:
                lcp = lcp.copy()
                lcp[0] = 0
            if (many := int(behind[pos].min())) > 1:
                for p, x in down.rounds(c, pos, lcp, many):
                    mark(p, x, end)
                    end = int(p[-1])
                continue
            mark(pos, lcp, end)
            down.scan(pos, lcp)
            end = int(pos[-1])
        pos, lcp = large.pop(c)
        if len(pos):
            back = np.empty_like(lcp)
            back[0] = cross(int(pos[-1]), end) if end >= 0 else 0
            back[1:] = lcp[:0:-1]
            pos = pos[::-1]
            mark(pos, back, end)
            down.scan(pos, back)
    return marked
