"""Zero-shot head: softmax, guard and thresholds."""

import math

import numpy as np
import pytest

from modspark.operators import vectors as ve


def run(spark, vec, prompts, n_harmful, scale=1.0):
    df = spark.createDataFrame([(1, [float(x) for x in vec])], "id long, embedding array<double>")
    names = [f"p{i}" for i in range(len(prompts))]
    return ve.zero_shot(df, names, prompts, n_harmful, logit_scale=scale).first()


def numpy_ref(vec, prompts, n_harmful, scale):
    v = np.asarray(vec, float)
    v = v / np.linalg.norm(v)
    P = np.asarray(prompts, float)
    P = P / np.linalg.norm(P, axis=1, keepdims=True)
    s = (P @ v) * scale
    p = np.exp(s - s.max())
    p = p / p.sum()
    return p[:n_harmful].sum(), p.std(), p


def test_matches_numpy(spark):
    rng = np.random.default_rng(3)
    prompts = rng.normal(size=(11, 16)).tolist()
    vec = rng.normal(size=16).tolist()
    harm, std, p = numpy_ref(vec, prompts, 5, 30.0)
    r = run(spark, vec, prompts, 5, 30.0)
    assert r.prob_std == pytest.approx(std)
    if std >= 0.015:
        assert r.harmful_score == pytest.approx(round(harm, 4), abs=1e-4)
        assert r.label == ("harmful" if harm > 0.4 else "safe")
        assert r.prompt_scores["p0"] == pytest.approx(round(p[0], 4), abs=1e-4)


def test_guard_near_uniform(spark):
    # orthogonal-ish prompts and scale 1 -> near-uniform -> guard
    prompts = np.eye(11, 16).tolist()
    r = run(spark, [1.0] * 16, prompts, 5, 1.0)
    assert r.prob_std < 0.015
    assert (r.harmful_score, r.safe_score, r.risk_score, r.label) == (0.0, 1.0, 0.0, "safe")
    assert r.confidence.startswith("low") and r.note is not None


def test_guard_boundary(spark):
    # two prompts: std = |p0 - 0.5|; choose scale so std crosses .015
    prompts = [[1.0, 0.0], [0.0, 1.0]]
    for target, low in ((0.0149, True), (0.0151, False)):
        # p0 = 0.5 + target = sigmoid(scale * (cos0 - cos1)); with vec (1,0): cos diff = 1
        scale = math.log((0.5 + target) / (0.5 - target))
        r = run(spark, [1.0, 0.0], prompts, 1, scale)
        assert (r.confidence == "high") is (not low)


def test_harmful_threshold(spark):
    prompts = [[1.0, 0.0], [0.0, 1.0]]
    for p0, label in ((0.4, "safe"), (0.4001, "harmful")):
        scale = math.log(p0 / (1 - p0))  # p0 < .5 -> negative scale flips the preference
        r = run(spark, [1.0, 0.0], prompts, 1, scale)
        assert r.label == label, (p0, r)


def test_vectors_without_direction(spark):
    prompts = [[1.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 0.0])], "id long, embedding array<double>")
    rows = {r.id: r for r in ve.zero_shot(df, ["a", "b"], prompts, 1, logit_scale=10.0).collect()}
    for i in (1, 2, 3):
        assert rows[i].risk_score is None and rows[i].top_prompt is None and rows[i].label == "safe"
    assert rows[4].top_prompt == "a" and rows[4].label == "harmful"


def test_plan_cost_does_not_grow_with_dimensions(spark):
    import time

    def seconds(dim):
        rng = np.random.default_rng(dim)
        prompts, vecs = rng.normal(size=(11, dim)).tolist(), rng.normal(size=(50, dim)).tolist()
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, embedding array<double>")
        t0 = time.perf_counter()
        rows = ve.zero_shot(df, [f"p{i}" for i in range(11)], prompts, 5, logit_scale=30.0).collect()
        took = time.perf_counter() - t0
        for r in rows[:5]:
            harm, std, p = numpy_ref(vecs[r.id], prompts, 5, 30.0)
            assert r.prob_std == pytest.approx(std) and r.top_prompt == f"p{p.argmax()}"
        return took

    seconds(8)  # code generation warm-up
    assert seconds(512) <= 10 * seconds(64)
