"""Labelled CSV, vectors, metrics and audit sinks."""

import os

import pytest

from modspark.sources.readers import read_labelled_csv, read_vectors, to_scorer_names

CSV = '''comment_text,toxic,severe_toxic,obscene,threat,insult,identity_hate
"plain text",0,0,0,0,0,0
"line one
line two, with ""quotes""",1,0,0,0,0,0
,0,0,1,0,0,0
"only insult",0,0,0,0,1,0
'''


def test_label_csv(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "train.csv")
    with open(p, "w") as f:
        f.write(CSV)
    df = read_labelled_csv(spark, p)
    rows = df.orderBy("comment_text").collect()
    assert len(rows) == 4
    texts = sorted(r.comment_text for r in rows)
    assert "" in texts and 'line one\nline two, with "quotes"' in texts
    by_text = {r.comment_text: r for r in rows}
    assert by_text[""].label == 1 and by_text["plain text"].label == 0 and by_text["only insult"].label == 1
    assert "identity_attack" in to_scorer_names(df).columns


def test_label_csv_missing_column(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "bad.csv")
    with open(p, "w") as f:
        f.write("comment_text,toxic,obscene\nx,0,0\n")
    with pytest.raises(ValueError) as e:
        read_labelled_csv(spark, p)
    assert "severe_toxic" in str(e.value) and "identity_hate" in str(e.value)


def test_vectors(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "vec")
    spark.createDataFrame([(1, [0.1, 0.2], "nsfw"), (2, [0.3, 0.4], "sfw")], "id long, embedding array<float>, label string").write.parquet(p)
    got = {r.id: r.label_int for r in read_vectors(spark, p).collect()}
    assert got == {1: 1, 2: 0}


def test_metrics_sink(spark, tmpdir_fresh):
    from modspark.sources.sinks import log_metrics, read_metrics

    p = os.path.join(tmpdir_fresh, "metrics")
    rid = log_metrics(spark, "run", {"auc": 0.7, "f1": 0.5}, path=p)
    log_metrics(spark, "run", {"loss": 0.3}, step=2, path=p, run_id=rid)
    m = read_metrics(spark, p).collect()
    assert len(m) == 3 and {r.key for r in m} == {"auc", "f1", "loss"} and all(r.run_id == rid for r in m)


def test_audit_sink_partitions_and_pruning(spark, tmpdir_fresh):
    from modspark.sources import bindings as B
    from modspark.sources.readers import read_audit
    from modspark.sources.sinks import write_audit

    p = os.path.join(tmpdir_fresh, "audit")
    write_audit(B.audit_log(spark, "/root/testdata/sf0.001"), p, "parquet")
    assert any(d.startswith("dt=") for d in os.listdir(p))
    r = read_audit(spark, p, B.AS_OF, 24, fmt="parquet")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dt" in plan.split("PartitionFilters")[1][:120]
    full = B.audit_log(spark, "/root/testdata/sf0.001")
    from modspark.operators.monitor import lookback

    assert r.count() == lookback(full, B.AS_OF, 24).count()
