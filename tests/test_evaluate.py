"""AUC, class report, splits against brute force."""

import random

import pytest

from modspark.operators import evaluate as ev


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = 0.0
    for p in pos:
        for n in neg:
            tot += 1.0 if p > n else 0.5 if p == n else 0.0
    return tot / (len(pos) * len(neg))


def auc(spark, rows):
    df = spark.createDataFrame(rows, "label int, score double")
    return ev.roc_auc(df, "label", "score").first().auc


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], 0.5),
        ([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)], 1.0),
        ([(0, 0.9), (0, 0.8), (1, 0.1), (1, 0.2)], 0.0),
    ],
)
def test_auc_ties(spark, rows, expected):
    assert auc(spark, rows) == pytest.approx(expected)


def test_auc_partial_ties_and_flip(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)]
    a = auc(spark, rows)
    assert a == pytest.approx(brute_auc(rows))
    flipped = [(1 - y, s) for y, s in rows]
    assert auc(spark, flipped) == pytest.approx(1 - a)


def test_auc_scores_outside_unit(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 1), rnd.uniform(-5, 5)) for _ in range(300)]
    assert auc(spark, rows) == pytest.approx(brute_auc(rows))


def test_auc_fixed_decimals_path(spark):
    rnd = random.Random(10)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 4)) for _ in range(500)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = ev.roc_auc(df, "label", "score", decimals=4).first().auc
    assert got == pytest.approx(brute_auc(rows))


def test_auc_clustered_raw_scores_stay_balanced(spark):
    """A third of the rows have distinct scores inside a 1e-9 range (a
    saturated model): exact result, and no quantile bucket holds the cluster."""
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), 0.999 + rnd.random() * 1e-9) for _ in range(300)]
    rows += [(rnd.randint(0, 1), rnd.random()) for _ in range(600)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert ev.roc_auc(df, "label", "score", buckets=64).first().auc == pytest.approx(brute_auc(rows))
    b = ev._quantile_buckets(df.select("score").distinct(), "score", 64)
    largest = b.groupBy("_b").count().agg({"count": "max"}).first()[0]
    assert largest <= 3 * 900 // 64


def test_class_report_brute(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    rep = {r.class_name: r for r in ev.class_report(df).collect()}
    tp = sum(1 for y, p in rows if y == 1 and p == 1)
    fp = sum(1 for y, p in rows if y == 0 and p == 1)
    fn = sum(1 for y, p in rows if y == 1 and p == 0)
    prec, rec = tp / (tp + fp), tp / (tp + fn)
    assert rep["1"].precision == pytest.approx(prec, abs=1e-6)
    assert rep["1"].recall == pytest.approx(rec, abs=1e-6)
    assert rep["1"].f1 == pytest.approx(2 * prec * rec / (prec + rec), abs=1e-6)
    assert rep["accuracy"].support == 200


def test_class_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    rep = {r.class_name: r for r in ev.class_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1 == 0.0


def test_exact_split_counts(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, label int")
    out = ev.exact_split(df, "id", "label", 0.2, 42).collect()
    for lab in (0, 1):
        n = sum(1 for _, y in rows if y == lab)
        t = sum(1 for r in out if r.label == lab and r.split == "test")
        assert t == int(n * 0.2 + 0.5)
    # deterministic
    again = {r.id: r.split for r in ev.exact_split(df, "id", "label", 0.2, 42).collect()}
    assert all(again[r.id] == r.split for r in out)


def test_hash_split_fraction(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    frac = ev.hash_split(df, "k").filter("split = 'test'").count() / 20000
    assert 0.18 < frac < 0.22


def test_auc_empty_input(spark):
    df = spark.createDataFrame([], "label int, score double")
    for kwargs in ({}, {"decimals": 4}):
        r = ev.roc_auc(df, "label", "score", **kwargs).first()
        assert r.auc is None and r.n_pos == 0 and r.n_neg == 0
