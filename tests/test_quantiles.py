"""Exact percentiles of any doubles against numpy, over brackets that must be
refined many times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modspark.operators import quantiles as qu

PROBS = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]


def columns():
    rng = np.random.default_rng(3)
    n = 4000
    return {
        "raw": rng.random(n),
        "wide": np.exp(rng.normal(0, 100, n)) * rng.choice([-1, 1], n),
        "ends": np.r_[np.zeros(1990), rng.random(20), np.ones(1990)],
        "few": rng.choice([0.1, 0.2, 0.3], n),
        "one": np.full(n, 0.25),
        "steps": np.round(rng.random(n), 2),
    }


@pytest.mark.parametrize("accuracy,small", [(1000, 10_000), (20, 7), (5, 1)])
def test_against_numpy(spark, accuracy, small, monkeypatch):
    monkeypatch.setattr(qu, "SMALL", max(small, 2))
    cols = columns()
    df = spark.createDataFrame(list(zip(range(4000), *(c.tolist() for c in cols.values()))), "i long, " + ", ".join(f"{c} double" for c in cols)).persist()
    names = list(cols) if small > 1 else ["wide", "ends"]
    for name in names:
        got = qu.exact_percentiles(df, name, PROBS, {"all": F.lit(True), "some": F.col("i") % 3 == 0}, accuracy, small)
        assert got["all"] == pytest.approx(np.quantile(cols[name], PROBS).tolist(), rel=1e-12), name
        assert got["some"] == pytest.approx(np.quantile(cols[name][::3], PROBS).tolist(), rel=1e-12), name
    df.unpersist()


def test_missing_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert qu.exact_percentiles(df, "v", [0.5]) == {"all": [2.0]}
    assert qu.exact_percentiles(df, "v", [0.5, 1.0], {"none": F.col("v") > 9, "x": F.col("v") > 1}) == {"none": [None, None], "x": [3.0, 3.0]}
    assert qu.exact_percentiles(df.filter("v > 9"), "v", [0.5]) == {"all": [None]}


def test_drift_of_unrounded_scores(spark):
    from datetime import datetime, timedelta

    from modspark.operators import monitor as mo

    at = datetime(2024, 1, 31)
    rng = np.random.default_rng(1)
    rows = [(f"c{k}", "approved", float(rng.random()), at - timedelta(minutes=k)) for k in range(2500)]
    df = spark.createDataFrame(rows, "content_id string, action string, risk_score double, ts timestamp")
    a, b = mo.drift_report(df, at).first().asDict(), mo.drift_report(df, at, decimals=None).first().asDict()
    assert a == b
