"""Trained models: values, saving and loading."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modspark.plans import queries as Q
from modspark.plans.training import TextModel
from modspark.sources import bindings as B

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def text_model(spark):
    return Q._text_model(spark, SF)


def test_text_model_equals_a_numpy_fit(spark, text_model):
    """The trained coefficients are the minimum of the regularised loss, and
    the JVM-side score is their linear score."""
    from modspark.operators import text_model as tm

    model, metrics, scored = text_model
    rows = scored.select("doc_id", "p", "label").collect()
    assert rows and all(0 <= r.p <= 1 for r in rows)
    corpus = B.labelled_corpus(spark, SF).select("doc_id", F.col("comment_text").alias("text"))
    w = tm.tfidf(corpus, model.terms, model.n_docs).toPandas()
    coef = {r["index"]: r.coef for r in model.terms.select("index", "coef").collect()}
    z = w.assign(z=w["weight"] * w["index"].map(coef)).groupby("doc_id")["z"].sum()
    for r in rows:
        assert r.p == pytest.approx(1 / (1 + np.exp(-(z.get(r.doc_id, 0.0) + model.intercept))), abs=1e-9)
    assert 0 <= metrics.first()["auc"] <= 1


def test_text_model_gradient_is_flat(spark, text_model):
    from modspark.operators import evaluate as ev
    from modspark.operators import text_model as tm
    from modspark.operators import text_scores as ts

    model, _, _ = text_model
    corpus = ts.any_label(B.labelled_corpus(spark, SF))
    split = ev.exact_split(corpus.select("doc_id", "comment_text", "label"), "doc_id", "label", 0.2, 42)
    train = split.filter("split = 'train'").select("doc_id", F.col("comment_text").alias("text"), "label").toPandas()
    w = tm.tfidf(spark.createDataFrame(train[["doc_id", "text"]]), model.terms, model.n_docs).toPandas()
    row = {d: i for i, d in enumerate(train["doc_id"])}
    k = int(w["index"].max()) + 1
    x = np.zeros((len(row), k))
    x[[row[d] for d in w["doc_id"]], w["index"]] = w["weight"]
    coef = np.zeros(k)
    for r in model.terms.collect():
        if r["index"] < k:
            coef[r["index"]] = r.coef
    n = len(row)
    err = 1 / (1 + np.exp(-(x @ coef + model.intercept))) - train["label"].to_numpy()
    # gradient of mean log-loss + |w|^2 / (2 C n), C = 1, intercept free
    assert np.abs(x.T @ err / n + coef / n).max() < 5e-3
    assert abs(err.mean()) < 5e-3


def test_text_model_scores_without_python(spark, text_model):
    docs = B.labelled_corpus(spark, SF).select("doc_id", F.col("comment_text").alias("text"))
    plan = text_model[0].score(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_text_model_save_and_load(spark, text_model, tmpdir_fresh):
    model, _, _ = text_model
    path = tmpdir_fresh + "/text-model"
    with pytest.raises(RuntimeError):
        TextModel().save(path)
    with pytest.raises(FileNotFoundError):
        TextModel.load(spark, path)
    model.save(path)
    docs = spark.createDataFrame([(1, "you stupid idiot"), (2, "a nice day"), (3, None)], "doc_id long, text string")
    want = sorted(map(tuple, model.score(docs).collect()))
    assert sorted(map(tuple, TextModel.load(spark, path).score(docs).collect())) == want and len(want) == 3
    with pytest.warns(UserWarning):
        model.save(path)


def test_vector_probe_learns(spark):
    model, rounds, metrics, scored = Q._probe(spark, SF)
    assert [r["step"] for r in rounds] == [0, 1, 2, 3, 4] and rounds[-1]["loss"] < rounds[0]["loss"]
    assert all(0 <= r[c] <= 1 for r in rounds for c in ("auc", "precision", "recall", "f1"))
    x = np.array([r.embedding for r in B.vectors(spark, SF).orderBy("id").collect()])
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.intercept)))
    from modspark.plans.training import vector_scores

    got = {r.id: r for r in vector_scores(model, B.vectors(spark, SF)).collect()}
    ids = [r.id for r in B.vectors(spark, SF).orderBy("id").collect()]
    for i, q in zip(ids, p):
        assert got[i].risk_score == pytest.approx(q, abs=6e-5)
        assert got[i].label == ("nsfw" if q > 0.5 else "safe")


def test_risk_ensemble_learns_and_explains(spark):
    from modspark.operators import risk as rk
    from modspark.plans.training import train_risk_model

    ens, metrics, scored = train_risk_model(Q._risk_training(spark, SF), "content_id", 5)
    rows = scored.collect()
    assert metrics.first()["auc"] > 0.7
    assert all(r.final_risk_score == pytest.approx((r.xgb_score + r.lgb_score) / 2, abs=1.1e-4) for r in rows)
    assert all(r.prediction == int(r.raw_risk > 0.5) for r in rows)
    imp = rk.feature_importance(spark, ens, 22).collect()
    assert len(imp) == 22 and sum(r.importance for r in imp) == pytest.approx(1.0)
    assert [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)


def test_moderation_with_the_trained_ensemble(spark, monkeypatch):
    """The flagship's risk is the mean of both trained models over its features."""
    from modspark.operators import risk as rk

    monkeypatch.setattr(Q, "RISK_TREES", 4)
    Q._MODELS.pop(("risk", spark.sparkContext.applicationId, SF), None)
    got = {r.content_id: r for r in Q.moderation_ensemble(spark, SF).collect()}
    ens, _, _ = Q._risk_model(spark, SF)
    want = {r.content_id: r for r in rk.score(ens, Q.content_features(spark, SF)).collect()}
    assert len(got) == len(want) and all(got[k].risk_score == pytest.approx(want[k].final_risk_score) for k in want)
    assert all(got[k].severity == want[k].severity for k in want)
    Q._MODELS.pop(("risk", spark.sparkContext.applicationId, SF), None)


def test_probe_rounds_against_numpy(spark, tmpdir_fresh):
    """One partition: a round is plain mini-batch descent; several: their mean."""
    from modspark.operators import probe as pr

    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, (300, 5))
    y = (x @ [1, -1, 0.5, 0, 2] > 8).astype(float)
    rows = [(str(i), v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))] + [("bad", [1.0], 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, label int").coalesce(1)
    order = [int(r.id) for r in df.filter("size(embedding) = 5").sortWithinPartitions(F.xxhash64(F.xxhash64("id"), F.lit(0))).collect()]
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(300)])
    w = np.zeros(6)
    for i in range(0, 300, 32):
        at = order[i : i + 32]
        w = w - 1.0 * 5 / 2 / 6 * z[at].T @ (1 / (1 + np.exp(-(z[at] @ w))) - y[at]) / len(at)
    first, _ = next(pr.train(df, 1))
    assert first.weights == pytest.approx((w[:-1] / x.std(0)).tolist(), rel=1e-9)
    last = list(pr.train(df.repartition(4), 5))[-1][0]
    p = {r.id: r.p for r in df.withColumn("p", last.probability()).collect()}
    assert p["bad"] is None and p["none"] is None
    assert np.mean([(p[str(i)] > 0.5) == (y[i] > 0.5) for i in range(300)]) > 0.9
    with pytest.raises(RuntimeError):
        pr.Probe().save(spark, tmpdir_fresh + "/p")
    with pytest.raises(FileNotFoundError):
        pr.Probe.load(spark, tmpdir_fresh + "/p")
    last.save(spark, tmpdir_fresh + "/p")
    assert pr.Probe.load(spark, tmpdir_fresh + "/p") == last
    with pytest.warns(UserWarning):
        last.save(spark, tmpdir_fresh + "/p")


def test_vocabulary_counts_terms_and_documents_in_one_pass(spark, monkeypatch):
    import collections

    import pyarrow as pa

    from modspark.operators import text_model as tm

    texts = ["a bb cc bb cc", None, "", "bb", "cc bb cc bb", "Bb\n bb", "bb cc", "bb cc"]
    freq, doc_freq = collections.Counter(), collections.Counter()
    for t in texts:
        w = [x for x in (t or "").lower().split() if len(x) > 1]
        grams = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        freq.update(grams)
        doc_freq.update(set(grams))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab = tm.vocabulary(df)
    assert {(r.term, r.freq, r.doc_freq) for r in vocab.collect()} == {(t, n, doc_freq[t]) for t, n in freq.items()}
    assert "BroadcastHashJoin" not in vocab._jdf.queryExecution().executedPlan().toString()
    assert [r.term for r in tm.vocabulary(df, 2).orderBy("index").collect()] == ["bb", "cc"]
    # a batch is counted in parts; a document stays whole
    monkeypatch.setattr(tm, "BATCH_TOKENS", 3)
    monkeypatch.setattr(tm, "BATCH_ROWS", 2)
    tokens = [[x for x in (t or "").lower().split() if len(x) > 1] if t is not None else None for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string()))], names=["t"])
    got, got_docs = collections.Counter(), collections.Counter()
    for b in tm._term_counts(iter([batch, batch.slice(0, 0)])):
        assert b.num_rows <= 2
        for r in b.to_pylist():
            got[r["term"]] += r["freq"]
            got_docs[r["term"]] += r["doc_freq"]
    assert got == freq and got_docs == doc_freq


class _Stop(Exception):
    pass


def _stopped_at(monkeypatch, module, name):
    """Replaces a training step by one that keeps its rows and ends the training."""
    seen = []

    def step(rows, *args, **kwargs):
        seen.append(rows)
        raise _Stop

    monkeypatch.setattr(module, name, step)
    return seen


def test_text_training_tasks_are_not_nearly_empty(spark, monkeypatch):
    """Vectors lie in no more tasks than cores until a task has its rows."""
    from modspark.operators import text_model as tm
    from modspark.plans import training as tr

    rows = spark.range(100).selectExpr("id AS doc_id", "concat('some words ', sha2(cast(id AS string), 256)) AS comment_text", "cast(id % 4 = 0 AS int) AS label")
    seen = _stopped_at(monkeypatch, tm, "train_logistic")
    for task_rows in (5000, 16):
        monkeypatch.setattr(tr, "VECTOR_TASK_ROWS", task_rows, raising=False)
        with pytest.raises(_Stop):
            tr.train_text_model(rows, k=50)
    assert [v.rdd.getNumPartitions() for v in seen] == [4, 5] and all(v.count() == 80 for v in seen)


def test_risk_training_tasks_follow_the_rows(spark, monkeypatch):
    """Trees pass over the rows a thousand times: one task holds a bounded number."""
    from modspark.operators import risk as rk
    from modspark.plans import training as tr

    rows = spark.range(1000).selectExpr("cast(id AS string) AS content_id", "cast(id % 3 = 0 AS int) AS label", "id AS x").coalesce(1)
    seen = _stopped_at(monkeypatch, rk, "train_ensemble")
    with pytest.raises(_Stop):
        tr.train_risk_model(rows)
    assert seen[0].count() == 800
    monkeypatch.setattr(tr, "TREE_TASK_ROWS", 50, raising=False)
    with pytest.raises(_Stop):
        tr.train_risk_model(rows)
    sizes = [len(p) for p in seen[1].rdd.glom().collect()]
    assert sum(sizes) == 800 and len(sizes) == 20 and max(sizes) <= 60
    assert {r.content_id for r in seen[0].collect()} == {r.content_id for r in seen[1].collect()}
