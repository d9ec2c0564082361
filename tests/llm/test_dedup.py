"""SimHash classes and removal of repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from modspark.llm import graph, simhash, suffix_dedup
from modspark.llm.induced_sort import repeated_starts


def brute_fingerprint(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(fps, ids, bits=4):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root(i), []).append(i)
    out = {}
    for g in groups.values():
        known = [ids[i] for i in g if ids[i] is not None]
        out.update({i: min(known, default=None) for i in g})
    return out


def near_texts(words):
    base = words(120, 1)
    out = [base, base, base + " tail", base.upper(), words(80, 2), words(80, 3), "", None, "   ", "one", "one two three", "ÀÉ x"]
    for k in range(40):
        w = base.split()
        w[(7 * k) % len(w)] = f"edit{k}"
        out.append(" ".join(w))
    return out + ["z" * 300_000, words(30_000, 5), words(30_000, 5)]


def test_simhash_against_all_pairs(make_docs, words):
    texts = near_texts(words)
    ids = [None if k in (4, 20) else 1000 - k for k in range(len(texts))]
    got = simhash.near_duplicates(make_docs(texts, ids)).collect()
    assert len(got) == len(texts)
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_classes(fps, ids)
    expect = sorted((str(ids[i]), f"{fps[i]:016x}", str(want[i])) for i in range(len(texts)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expect


def test_simhash_keep_one_per_class(make_docs, words):
    texts = near_texts(words) + ["one", "one"]
    ids = [*range(len(texts) - 2), 5, 5]  # an id used by several texts, a row that is repeated
    kept = simhash.keep_one(make_docs(texts, ids)).collect()
    classes = {r.component for r in simhash.near_duplicates(make_docs(texts, ids)).collect()}
    assert len(kept) == len(classes)
    assert sum(r.text == "one" for r in kept) == 1


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 6])
def test_links_lose_no_pair(spark, bits, monkeypatch):
    rng = random.Random(bits)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for _ in range(6):  # clouds of near fingerprints
            x = f
            for _ in range(rng.randint(0, 9)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps) | {0, 2**64 - 1})
    monkeypatch.setattr(simhash, "HOT_CELL", 8)  # many cells are dealt in chunks
    monkeypatch.setattr(simhash, "CHUNK", 4)
    monkeypatch.setattr(simhash, "HOT_SHARE", 10**9)
    nodes = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(nodes, bits)).collect()}
    want = brute_classes(fps, fps, bits)
    mine = {}
    for f in fps:
        s = f - (f >> 63 << 64)
        mine.setdefault(got.get(s, s), set()).add(f)
    theirs = {}
    for i, f in enumerate(fps):
        theirs.setdefault(want[i], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_fingerprints_enter_their_cells_in_tasks_of_bounded_size(spark, monkeypatch):
    """A few stored files held all fingerprints: one task counted all cells."""
    monkeypatch.setattr(simhash, "TASK_NODES", 16)
    rng = random.Random(3)
    fps = [rng.getrandbits(63) for _ in range(200)]
    nodes = spark.createDataFrame([(f,) for f in fps + [f ^ 5 for f in fps]], "fp long").coalesce(1)
    got = simhash.links(nodes)
    assert "hashpartitioning(fp" in (plan := got._jdf.queryExecution().toString()) and ", 25), REPARTITION_BY_NUM" in plan
    assert {frozenset(r) for r in got.collect()} == {frozenset((f, f ^ 5)) for f in fps}


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    m = simhash.manhattan(simhash.counts(a), simhash.counts(b))
    seg = [[int(x) >> 2 * i & 3 for i in range(32)] for x in (a[0], b[0])]
    assert m[0] == sum(abs(x.bit_count() - y.bit_count()) for x, y in zip(*seg))
    assert (m <= np.bitwise_count(a ^ b)).all()


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [6000, 1])
def test_repeats_against_brute_force(make_docs, words, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, i, t, n, f=suffix_dedup.repeated_spans: f(d, i, t, n, hot))
    passage = words(90, 9)
    texts = [words(150, k) for k in range(12)]
    texts += [words(40, 50 + k) + passage + words(60 + k, 70 + k) for k in range(8)]  # a common passage
    texts += [texts[3], texts[3], "ab" * 700, "x" * 900, "é" * 350, "", None, "y" * 399, words(3000, 99)]
    ids = [None if k in (2, 14) else k // 2 for k in range(len(texts))]
    got = suffix_dedup.remove_repeats(make_docs(texts, ids), with_kept=False).collect()
    rows = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert rows == sorted((str(i), *x) for i, x in zip(ids, brute_removal(texts, 400)))


def test_kept_bytes(make_docs, words):
    passage = words(120, 1)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(make_docs(["a " + passage, "b " + passage, "c"])).collect()}
    assert [bytes(got[i].kept) for i in range(3)] == [b"a", b"b", b"c"]


def test_long_texts_are_hashed_in_pieces(words, monkeypatch):
    data = (words(400, 1) + words(400, 2)).encode()
    whole = suffix_dedup.runs(data)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    pieces = suffix_dedup.runs(data)

    def windows(runs):
        return [(key, s) for key, _, lo, hi, _ in runs for s in range(lo, hi - 400 + 1)]

    assert windows(whole) == windows(pieces) and len(windows(whole)) == len(data) - 399


def test_induced_sort_finds_all_repeats():
    rng = np.random.default_rng(3)
    for trial in range(300):
        base = rng.integers(1, int(rng.integers(2, 6)), size=60)
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            s = int(rng.integers(0, 60))
            parts += [rng.integers(1, 5, size=int(rng.integers(0, 20))), base[s : s + int(rng.integers(1, 40))], [0]]
        text = np.concatenate(parts).astype(np.uint16)
        depth = int(rng.integers(1, 14))
        got = repeated_starts(text, depth, memory=int(rng.choice([5, 1000])))
        zeros = np.flatnonzero(text == 0)
        inside = zeros[np.searchsorted(zeros, np.arange(len(text)))] - np.arange(len(text)) >= depth
        grams = [tuple(text[i : i + depth].tolist()) if inside[i] else None for i in range(len(text))]
        assert got[inside].tolist() == [grams.count(g) > 1 for g in grams if g], trial


def test_empty_tables(make_docs):
    empty = make_docs([])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty, with_kept=False).count() == 0


def test_a_key_of_many_bytes_is_not_sorted_in_one_shard(make_docs, words, monkeypatch):
    """Filler of different lengths: few classes, one key, many bytes."""
    texts = [words(20, k) + " " + "-" * (3_000 + 97 * k) + " " + words(20, 50 + k) for k in range(12)]
    texts += [words(20, 99) + "- " * 2_000, "- " * 1_700 + words(20, 98), words(150, 1)]
    whole = []  # bytes a key left to the sorter
    real = suffix_dedup._sort_shards

    def spy(bodies, length):
        whole.extend(r[1] for r in bodies.selectExpr("key", "length(data) n").groupBy("key").sum("n").collect())
        return real(bodies, length)

    monkeypatch.setattr(suffix_dedup, "_sort_shards", spy)
    monkeypatch.setattr(suffix_dedup, "PIECE", 512, raising=False)
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", tuple(8_000 if d == suffix_dedup.SHARD_BYTES else d for d in suffix_dedup.repeated_spans.__defaults__))
    got = suffix_dedup.remove_repeats(make_docs(texts), with_kept=False).collect()
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert rows == sorted((i, *x) for i, x in enumerate(brute_removal(texts, 400)))
    assert max(whole, default=0) <= 8_000


def brute_marks(text, depth):
    """(positions with ``depth`` symbols left, those of them that repeat)."""
    t, ends, places = text.tolist(), len(text), {}
    for i in range(len(t) - 1, -1, -1):
        if t[i] == 0:
            ends = i
        if ends - i >= depth:
            places.setdefault(tuple(t[i : i + depth]), []).append(i)
    valid = sorted(i for v in places.values() for i in v)
    return valid, {i for v in places.values() if len(v) > 1 for i in v}


@pytest.mark.parametrize("memory", [1 << 22, 5])
def test_repeated_symbols_against_brute_force(memory):
    """Stretches of one symbol, of several lengths and beside each other, with
    queues that spill all the time and never."""
    rng = random.Random(memory)
    for _ in range(150):
        depth, parts = rng.choice([4, 8, 16]), []
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            if kind < 0.4:
                parts += [rng.randint(1, 4)] * rng.randint(1, 60)
            elif kind < 0.7:
                parts += [rng.randint(1, 3) for _ in range(rng.randint(1, 50))]
            else:
                parts += ([1] * rng.randint(1, 9) + [rng.randint(1, 3)]) * rng.randint(1, 9)
            if rng.random() < 0.4:
                parts.append(0)
        text = np.array([*parts, 0], np.uint16)
        valid, want = brute_marks(text, depth)
        got = repeated_starts(text, depth, memory)
        assert {i for i in valid if got[i]} == want


def test_megabytes_of_one_symbol_take_seconds():
    import time

    n = 4 << 20
    began = time.monotonic()
    marks = repeated_starts(np.r_[np.full(n, 33), [0]].astype(np.uint16), 400)
    assert marks[: n - 399].all() and time.monotonic() - began < 30
