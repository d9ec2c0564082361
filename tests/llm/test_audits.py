"""Difference-cover removal, retraction audit and source divergence against
brute force on small tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from modspark.llm import anchor_dedup, divergence, filter_audit, transducer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# op13 ----------------------------------------------------------------------


def brute_removal(ids, texts, window=50):
    docs = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in zip(ids, docs):
        for s in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in zip(ids, docs):
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_cover_meets_every_shift():
    cover = set(anchor_dedup.COVER)
    n = anchor_dedup.PERIOD
    for i, j in itertools.product(range(n), range(n)):
        assert any((i + d) % n in cover and (j + d) % n in cover for d in range(n))


def passages(words):
    """Documents that share passages of 49, 50, 51 and more words at all
    offsets, with equal and different surroundings."""
    rng = random.Random(5)
    shared = words(400, 90).split()
    texts = []
    for k in range(60):
        a, n = rng.randrange(300), rng.choice([49, 50, 51, 60, 100])
        front, back = words(rng.randrange(0, 40), k).split(), words(rng.randrange(0, 40), 1000 + k).split()
        texts.append(" ".join(front + shared[a : a + n] + back))
    whole = words(120, 7)
    texts += [whole, whole, whole + " end", "start " + whole, whole.replace(" ", "\n\t"), whole + " " + whole]
    texts += [None, "", " \x0b\x0c\r ", "one", "a " * 120, "a " * 60, "À é " * 40, words(49, 8), words(49, 8), words(50, 9), words(50, 9)]
    long = words(9_000, 4)
    return texts + [long, " ".join(long.split()[2_000:2_300]), "z" * 200_000]


def test_anchor_removal_against_brute_force(make_docs, words, monkeypatch):
    monkeypatch.setattr(anchor_dedup, "PIECE", 4096)  # long texts in several pieces
    texts = passages(words)
    ids = [(k * 37) % 101 for k in range(len(texts))]
    ids[3], ids[61], ids[10] = None, None, ids[11]  # null ids, an id of two rows
    got = anchor_dedup.remove_repeats(make_docs(texts, ids), with_kept=False).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removal(ids, texts)


def test_anchor_removal_kept_words_and_empty(make_docs, words):
    texts = [words(80, 1), "x " + words(80, 1) + " y", None]
    got = {r.doc_id: r for r in anchor_dedup.remove_repeats(make_docs(texts, [1, 2, 3])).collect()}
    assert got[1].kept == words(80, 1) and got[2].kept == "x y" and got[3].kept == ""
    assert anchor_dedup.remove_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("window", [46, 64])
def test_anchor_windows_of_other_lengths(make_docs, words, window):
    texts = passages(words)[:40]
    got = anchor_dedup.remove_repeats(make_docs(texts), window=window, with_kept=False).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removal(range(40), texts, window)


def test_anchor_hot_passage_rows_follow_the_documents(make_docs, words):
    """A passage that all documents share is one class where its surroundings
    agree; window rows follow the different surroundings, not the pairs."""
    shared = words(60, 3)
    texts = [f"{words(30, 2 * k)} {shared} {words(30, 2 * k + 1)}" for k in range(80)]
    rows, spans = anchor_dedup.repeated_stretches(make_docs(texts))
    assert rows.count() == 80 and spans.count() == 79
    got = anchor_dedup.remove_repeats(make_docs(texts), with_kept=False).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removal(range(80), texts)
    assert min(r.n_removed for r in got if r.doc_id) >= 60


# op12 ----------------------------------------------------------------------


def brute_audit(rows, labels):
    """rows (id, text, lang); labels {id: (quality, toxic)}."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = {}
    for i, t, g in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = set()
        if len(w) < 100:
            fails.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and least[t] < i:
            fails.add("E")
        parts.setdefault(g or "", []).append((fails, *labels.get(i, (0, 0))))
    out = set()
    for part, docs in parts.items():
        shap = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [d for d in docs if f in d[0] and not d[0] & before]
                shap[f] += len(gone)
                lines.append((
                    part, order, k + 1, sum(not d[0] & (before | {f}) for d in docs), len(gone), sum(f in d[0] and bool(d[0] & before) for d in docs),
                    sum(d[0] == {f} for d in docs), sum(d[1] == 1 for d in gone), sum(d[2] == 1 for d in gone), f,
                ))
        out |= {(*x[:-1], shap[x[-1]]) for x in lines}
    return out


def audit_rows(words):
    rng = random.Random(9)
    base = [words(120, 1), words(30, 2), "ABC DEF " + words(10, 3), "same " * 150, "a # b", "", "   ", words(130, 4) + " $"]
    rows = []
    for k in range(160):
        t = rng.choice(base) if rng.random() < 0.7 else words(rng.choice([20, 110]), 50 + k)
        rows.append((rng.randrange(400) if rng.random() < 0.95 else None, rng.choice([t, t, t, None]), rng.choice(["en", "de", None, ""])))
    return rows + [(5, base[0], "en"), (5, base[0], "en"), (5, base[0], "de")]


DOC_DDL = "doc_id long, text string, lang string, mask string, n string"


def test_filter_audit_over_several_runs(spark, words, tmp_path):
    rows = audit_rows(words)
    labels = {i: (i % 2, int(i % 3 == 0)) for i in range(0, 400, 4)}
    table = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "audit")
    # the largest ids come first: later files retract earlier minima
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    steps = [known[:60], known[60:61], known[61:] + [r for r in rows if r[0] is None]]
    done = []
    for k, part in enumerate(steps):
        docs = spark.createDataFrame([(*r, "x", "y") for r in part], DOC_DDL)
        docs.repartition(3).write.mode("append").parquet(path)
        done += part
        # the same folder again: only the new files are read, one a batch
        got = filter_audit.audit(spark, path, table, folder, files_per_batch=1).collect()
        assert len(got) == 600 * len({g or "" for _, _, g in done})
        assert {tuple(r) for r in got} == brute_audit(done, labels)
    again = filter_audit.audit(spark, path, table, folder).collect()  # nothing new
    assert {tuple(r) for r in again} == brute_audit(rows, labels)
    assert {tuple(r) for r in filter_audit.audit(spark, path, table).collect()} == brute_audit(rows, labels)


def test_filter_audit_empty(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], DOC_DDL).write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, path, labels).count() == 0


def test_step_retracts_the_earlier_minimum():
    least, held, d = filter_audit.step([("en", 1, True, 7, 2, 5), ("de", 0, False, 0, 1, 1)], None, [])
    assert (least, held) == (7, [["en", 1, 2]])
    assert d == {("en", 1, True): 3, ("en", 1, False): 2, ("de", 0, False): 1}
    least, held, d = filter_audit.step([("fr", 0, True, 3, 1, 1)], least, held)
    assert (least, held) == (3, [["fr", 0, 1]])
    assert d == {("en", 1, False): -2, ("en", 1, True): 2, ("fr", 0, False): 1}
    assert filter_audit.step([("fr", 0, True, 9, 1, 1)], least, held)[2] == {("fr", 0, True): 1}


# op11 ----------------------------------------------------------------------


def brute_divergence(rows, top=200, min_docs=3):
    docs = [(g or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for t, g, s in rows]
    out = set()
    for lang in {g for g, _, _ in docs}:
        mine = [(s, w) for g, s, w in docs if g == lang]
        df = {}
        for _, w in mine:
            for t in set(w):
                df[t] = df.get(t, 0) + 1
        kept = sorted((t for t in df if df[t] >= min_docs), key=lambda t: t.encode())

        def shares(words):
            c = {}
            for t in words:
                c[t] = c.get(t, 0) + 1
            n = sum(c.get(t, 0) for t in kept)
            return {t: 1 + 10**9 * (c.get(t, 0) + 1) // (n + len(kept)) for t in kept}, c

        whole, _ = shares([t for _, w in mine for t in w])
        by = {s: shares([t for x, w in mine if x == s for t in w]) for s in {s for s, _ in mine}}
        for s, (p, c) in by.items():
            pairs = sorted(((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o.encode(), o) for o, (q, _) in by.items() if o != s))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((-((p[t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept if c.get(t) and p[t] > whole[t])
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)}
    return out


def source_rows(words):
    rng = random.Random(2)
    long = ["é" * 96, "é" * 97, "b" * 192, "b" * 193, "b" * 193 + "c", "c" * 70_000]
    rows = []
    for k in range(150):
        text = words(rng.randrange(0, 60), k).title() + "; " + rng.choice(["Été-x9y", "中文字", "don't", *long]) + "!"
        rows.append((rng.choice([text, text, text, None]), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", "", None])))
    return rows + [("only here", "xx", "a"), (None, "xx", "b"), ("123 456", "yy", None)] + [("tie one", "zz", "a"), ("tie one", "zz", "b")] * 3


@pytest.mark.parametrize("block_terms,hold", [(1 << 16, 16 << 20), (40, 4096)])
def test_divergence_against_brute_force(spark, words, monkeypatch, block_terms, hold):
    monkeypatch.setattr(divergence, "HOLD_BYTES", hold)
    monkeypatch.setattr(divergence, "HOLD_TERMS", 50)
    rows = source_rows(words)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    got = divergence.divergence(docs.repartition(5), top=20, block_terms=block_terms)
    assert {tuple(r) for r in got.collect()} == brute_divergence(rows, top=20)
    assert [f.dataType.simpleString() for f in got.schema][-2:] == ["bigint", "int"]


def test_divergence_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergence(docs).count() == 0


def test_transducer_ordinals_and_minimality():
    rng = random.Random(3)
    terms = sorted({bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(1, 9))) for _ in range(2000)} | {b"a" * n for n in (191, 192, 193, 300)})
    t = transducer.unpack(transducer.pack(transducer.build([("x", 100, terms), ("y", 7, terms[::3])])))
    text = [*terms, b"zz", b"a" * 301, b"a" * 190 + b"c"]
    rng.shuffle(text)
    buf = np.frombuffer(b" ".join(text) + b" ", np.uint8)
    start = np.cumsum([0] + [len(x) + 1 for x in text])[:-1]
    for name, own in (("x", terms), ("y", terms[::3])):
        root, first = t.groups[name]
        term, ordinal = t.walk(buf, start, np.full(len(start), root), np.full(len(start), first))
        place = {x: first + k for k, x in enumerate(own)}
        assert dict(zip(term.tolist(), ordinal.tolist())) == {k: place[x] for k, x in enumerate(text) if x in place}
    # all words over two letters of length 12: one state a length, not 2^13
    full = [bytes(w) for w in itertools.product(b"ab", repeat=12)]
    assert len(transducer.build([("x", 0, full)]).weight) == 13
