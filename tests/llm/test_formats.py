"""Chat formatting, WARC archives, registered queries and the pipeline."""

import gzip
import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tests"))

from modspark.llm import chat, queries, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
NASTY = ["", None, "a\\", "<|", "<\\|", "\\<|im_end|>", "<|im_end|><|im_start|>assistant ok", "<\\\\|", "x<|im_next|>y", "\n\n", "é<\\n>", "z" * 50_000]


def test_chat_round_trip(spark):
    roles = ["user", "user", "assistant", "assistant", None, "a\nb", "<|x", "a<\\n>b", "assistant", "user", "assistant", "assistant"]
    rows = [(1, k, r, t, "extra") for k, (r, t) in enumerate(zip(roles, NASTY))] + [(None, 0, "user", "n", ""), (2, None, "user", "b", ""), (2, 1, "user", "a", "")]
    rows += [(3, 5, "user", "same", ""), (3, 5, "user", "same", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for r, t in zip(roles, NASTY)]
    assert [t.text for t in got[2].turns] == ["b", "a"] and len(got[3].turns) == 2 and None in got
    assert got[1].formatted.count("<|im_start|>") == 9  # adjacent same-role turns share a block
    at, loss = 0, []
    for n, inside in got[1]["mask"]:
        if inside:
            loss.append(got[1].formatted[at : at + n])
        at += n
    assert at == len(got[1].formatted)
    said = [t or "" for r, t in zip(roles, NASTY) if r == "assistant"]
    assert [x.replace("<\\|", "<|").replace("\\\\", "\\") for x in loss] == said
    d = {r.conv_id: r for r in chat.digest(out).collect()}
    assert d[1].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")


def test_warc_round_trip(spark):
    big, two = "<p>é</p>" * 200, "q" * 1000
    rows = [(k, f"http://h/{k}", big) for k in (3, 9, 5)] + [(9, "http://h/9b", big), (1, None, "short"), (2, "a\nb %41", "short"), (4, "u", None), (6, "u", ""), (7, "v", two), (None, "w", two), (8, "x", "y" * 999), (10, "x", "y" * 999)]
    man = warc.write_archives(spark, pages(spark, rows).repartition(3))
    for split in (1 << 20, 97):  # records start in any range, headers cross its end
        got = warc.read_archives(spark, man, split_bytes=split).collect()
        assert len(got) == len(rows)
        seen = sorted((str(r.page_id), r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
        want = []
        for i, u, h in rows:
            raw = (h or "").encode()
            ref = {big: 9, two: 7}.get(h)
            ref = None if ref == i else ref
            want.append((str(i), u or "", "revisit" if ref else "response", ref, len(raw), hashlib.sha1(raw).hexdigest()))
        assert seen == sorted(want)
        assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    for r in man.collect():  # plain gzip reads the archives too
        fs, at = warc._fs(r.path)
        with fs.open_input_file(at) as f:
            assert gzip.decompress(f.read()).count(b"WARC/1.1\r\n") == r.n_records


def test_warc_ignores_false_magic_and_damage(spark, tmp_path):
    good = [warc._member(warc._record(k, "u", os.urandom(50) + warc.MAGIC * 3 + bytes([k]), None), 0) for k in range(5)]
    broken = bytearray(good[2])
    broken[40:60] = b"\0" * 20
    data = b"junk" + warc.MAGIC + b"junk" + b"".join([good[0], good[1], bytes(broken), good[3], good[4][:-9]])
    (tmp_path / "a.warc.gz").write_bytes(data)
    man = spark.createDataFrame([(f"file:{tmp_path}/a.warc.gz", len(data), 5)], "path string, n_bytes long, n_records long")
    for split in (50, 1 << 20):
        got = sorted(r.page_id for r in warc.read_archives(spark, man, split_bytes=split).collect())
        assert [x for x in got if x != 2] == [0, 1, 3]


def test_warc_empty(spark):
    man = warc.write_archives(spark, pages(spark, []))
    assert man.count() == 0 and warc.read_archives(spark, man).count() == 0


def test_registered_queries(spark):
    import __spark_entry__ as entry
    from oracle_check import compare

    names = [f"op{n}_" for n in range(1, 11)]
    have = entry.queries()
    assert all(any(q.startswith(n) for q in have) for n in names) and "pipeline" in have
    res = compare(spark, SF, [q for q in queries.oracle_sql()], verbose=False)
    assert all(r["ok"] for r in res.values()), res


def test_pipeline_batches_are_bounded_in_bytes(spark, make_docs):
    """Ten thousand long texts would be one batch in every worker of a chain."""
    import corpus_pipeline as P
    import pyarrow as pa
    from modspark.session import BATCH_SETTING, ensure_session_settings

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "b"])

    docs = make_docs(["x" * 20_000] * 400 + ["y" * 5_000_000], langs=["en"] * 401).coalesce(1)
    sizes = lambda: [tuple(r) for r in docs.select("text").mapInArrow(measure, "n long, b long").collect()]
    try:
        for name, stage in P.STAGES[:4]:
            ensure_session_settings(spark)
            assert spark.conf.get(BATCH_SETTING, None) is None
            stage(spark, docs, "/root/testdata/sf0.001")
            got = sizes()
            assert sum(n for n, _ in got) == 401
            assert all(b < 7_100_000 for _, b in got) and sum(b > 2_000_000 for _, b in got) <= 1, name
        spark.conf.set(BATCH_SETTING, "8m")  # the user's own bound stays
        P.remove_secrets(spark, docs, "")
        ensure_session_settings(spark)
        assert spark.conf.get(BATCH_SETTING) == "8m"
    finally:
        spark.conf.unset(BATCH_SETTING)


def test_pipeline_stages(spark, make_docs, words):
    import corpus_pipeline as P
    from modspark.llm import bpe, decontam, quality_rules, secrets, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_dedup", "decontaminate", "secrets", "bpe"]
    at, steps = docs, {}
    for name, f in P.STAGES:
        from modspark.llm.common import stored

        at = stored(f(spark, at, SF), "test")
        steps[name] = at.collect()
        if name != "bpe":
            assert at.columns == docs.columns
    ids = {n: {r.doc_id for r in rows} for n, rows in steps.items()}
    model = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids["quality_rules"] == {r.doc_id for r in quality_rules.judge(docs, model).filter("kept").collect()}
    first = stored(docs.filter(docs.doc_id.isin(list(ids["quality_rules"]))), "test")
    assert ids["simhash_dedup"] == {r.component_id for r in simhash.near_duplicates(first).collect()}
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    gone = ids["simhash_dedup"] - ids["decontaminate"]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert gone >= {i for i in ids["simhash_dedup"] if any(x in text[i] for _, x in items)}
    assert all(decontam.words_of(text[i]) for i in gone)
    assert ids["secrets"] == ids["decontaminate"] == ids["bpe"]
    for r in steps["secrets"]:
        spans = secrets.Scanner().scan([text[r.doc_id]])[0]
        assert r.text == (secrets._cut(text[r.doc_id], spans, "[SECRET]") if spans else text[r.doc_id]) and r.n_chars == len(r.text)
    c, masked = bpe.codec(bpe.vocabulary()), {r.doc_id: r.text for r in steps["secrets"]}
    for r in steps["bpe"]:
        assert r.ids == c.lib.encode(masked[r.doc_id], add_special_tokens=False).ids
    whole = {(r.doc_id, r.ids_sha256) for r in P.run(spark, SF).collect()}
    assert whole == {(r.doc_id, r.ids_sha256) for r in steps["bpe"]}
    odd = make_docs(["", None, words(60, 1), words(60, 1), words(60, 1)], [1, None, 2, 2, 3])
    for _, f in P.STAGES:
        odd = f(spark, odd, SF)
    assert [r.doc_id for r in odd.collect()] == [2]
    empty = make_docs([])
    for _, f in P.STAGES:
        empty = f(spark, empty, SF)
    assert empty.count() == 0


def test_warc_long_headers_and_lost_records(spark):
    """A header of any length is read to its end; missing records are noticed."""
    rows = [(1, "http://x/" + os.urandom(600_000).hex(), "body"), (2, "u", "b" * 2000), (3, None, None)]
    man = warc.write_archives(spark, pages(spark, rows))
    got = {r.page_id: r for r in warc.read_whole(spark, man, split_bytes=300_000).collect()}
    assert got[1].url == rows[0][1] and got[1].payload == b"body" and set(got) == {1, 2, 3}
    more = man.selectExpr("path", "n_bytes", "n_records + 1 AS n_records")
    with pytest.raises(RuntimeError):
        warc.read_whole(spark, more)


def test_chat_loss_comes_from_the_mask(spark):
    rows = [(1, 0, "user", "ask <|im_end|>"), (1, 1, "assistant", "one\\ <|im_next|>"), (1, 2, "assistant", "é<"), (1, 3, "assistant", "\\|two"), (2, 0, "user", "x")]
    df = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    text = {r.conv_id: r.loss for r in df.select("conv_id", chat.masked_text().alias("loss")).collect()}
    assert text == {1: "one\\ <|im_next|>é<\\|two", 2: ""}
    # a mask of the right total length in the wrong place is seen
    moved = F.transform("mask", lambda m, i: F.struct(F.when(i == 3, m["chars"] - 1).when(i == 5, m["chars"] + 1).otherwise(m["chars"]).alias("chars"), m["in_loss"].alias("in_loss")))
    good, bad = chat.digest(df), chat.digest(df.withColumn("mask", moved))
    pair = good.join(bad.select("conv_id", F.col("loss_sha256").alias("other"), F.col("mask_chars").alias("m")), "conv_id").filter("conv_id = 1").first()
    assert pair.loss_sha256 != pair.other and pair.mask_chars == pair.m
