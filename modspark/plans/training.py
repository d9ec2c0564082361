"""Training jobs: the TF-IDF text classifier, the risk ensemble and the
linear probe on image vectors.  Each returns the fitted model(s), a one-row
metrics frame, and the scored test rows; metrics go to the metrics table
when ``log=True``.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.functions.numeric import half_up
from modspark.operators import evaluate as ev
from modspark.operators import probe as pr
from modspark.operators import risk as rk
from modspark.operators import text_model as tm
from modspark.operators.partitioning import dealt, gathered
from modspark.operators.vectors import encode_label, image_classifier_output
from modspark.schemas import TEXT_CLASSIFIER_THRESHOLD
from modspark.session import path_exists

# Rows of a task in the many passes of a fit.
TREE_TASK_ROWS = 25_000  # of 22 features
VECTOR_TASK_ROWS = 5_000  # of sparse vectors, a few hundred terms each


def _metrics(scored: DataFrame, label: str, score: str, pred: str) -> DataFrame:
    """One row: auc + precision / recall / f1 of class 1 (6 dp)."""
    auc = ev.roc_auc(scored, label, score).select(half_up(F.col("auc"), 6).alias("auc"))
    rep = ev.class_report(scored, label, pred).filter(F.col("class_name") == "1").select("precision", "recall", "f1")
    # both sides are single rows built from aggregates: a 1 x 1 key join
    one = F.lit(1).alias("_k")
    return auc.select("*", one).join(rep.select("*", one), "_k").drop("_k")


@dataclass
class TextModel:
    """M2's result: ``terms`` (term, freq, doc_freq, index, coef), the number
    of fitted documents and the intercept.  Scoring is the J5 join."""

    terms: DataFrame | None = None
    n_docs: int = 0
    intercept: float = 0.0

    def _trained(self) -> None:
        if self.terms is None:
            raise RuntimeError("the text model is not trained; train or load it first")

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """M3: label toxic/clean at p > .5; confidence = risk = p (4 dp)."""
        self._trained()
        w = tm.tfidf(docs, self.terms, self.n_docs, id_col, text_col)
        return tm.linear_score(w, self.terms, self.intercept, docs, id_col, with_p=True)

    def save(self, path: str) -> None:
        """A folder with the terms and the scalars; replacing one warns."""
        self._trained()
        spark, base = self.terms.sparkSession, path.rstrip("/")
        if path_exists(spark, base):
            warnings.warn(f"{base} holds a model already; it is replaced", stacklevel=2)
        self.terms.write.mode("overwrite").parquet(f"{base}/terms")
        one = spark.createDataFrame([(self.n_docs, self.intercept)], "n_docs long, intercept double")
        one.write.mode("overwrite").parquet(f"{base}/scalars")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        base = path.rstrip("/")
        if not path_exists(spark, f"{base}/scalars"):
            raise FileNotFoundError(f"no text model in {base}")
        n, b = spark.read.parquet(f"{base}/scalars").first()
        return cls(spark.read.parquet(f"{base}/terms"), n, b)


def train_text_model(
    corpus: DataFrame, id_col: str = "doc_id", text_col: str = "comment_text", label: str = "label",
    test: float = 0.2, seed: int = 42, k: int = tm.MAX_FEATURES, c: float = 1.0, max_iter: int = 1000,
    log: bool = False,
):
    """M2: exact stratified split -> TF-IDF fitted on the training split ->
    logistic regression -> exact AUC and class-1 P/R/F1 on the test split."""
    spark = corpus.sparkSession
    # stored: the split reads its rows twice, and labels may cost a pass over the texts
    rows = corpus.select(id_col, text_col, label).checkpoint(eager=True)
    split = ev.exact_split(rows, id_col, label, test, seed)
    split = split.checkpoint(eager=True)  # the split is reused by every later step
    train = split.filter(F.col("split") == "train").select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), label)
    testd = split.filter(F.col("split") == "test").select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), label)
    vocab, n_docs = tm.fit_tfidf(train, "text", k)
    wtrain = tm.tfidf(train, vocab, n_docs)
    vtrain = tm.to_vectors(wtrain, vocab.count(), train.select("doc_id"))
    vtrain = vtrain.join(train.select("doc_id", F.col(label).alias("label")), "doc_id").select("label", "features")
    vtrain = gathered(vtrain.checkpoint(eager=True), n_docs, VECTOR_TASK_ROWS)
    model = tm.train_logistic(vtrain, c=c, max_iter=max_iter, n=n_docs)
    coef = spark.createDataFrame(list(enumerate(model.coefficients.toArray().tolist())), "index int, coef double")
    tmodel = TextModel(vocab.join(coef, "index").checkpoint(eager=True), n_docs, float(model.intercept))
    scored = tmodel.score(testd, "doc_id", "text").withColumnRenamed("label", "text_label")
    scored = scored.join(testd.select("doc_id", F.col(label).alias("label")), "doc_id")
    scored = scored.withColumn("prediction", (F.col("p") > F.lit(TEXT_CLASSIFIER_THRESHOLD)).cast("int"))
    scored = scored.checkpoint(eager=True)  # the metrics read it several times
    m = _metrics(scored, "label", "p", "prediction").withColumns(
        {"n_train": F.lit(n_docs).cast("long"), "n_test": F.lit(testd.count()).cast("long")}
    )
    if log:
        from modspark.sources.sinks import log_metrics

        row = m.first().asDict()
        log_metrics(spark, "tfidf_logreg_toxicity", {"max_features": k, "ngram_range": "(1,2)", "C": c}, "param")
        log_metrics(spark, "tfidf_logreg_toxicity", {"roc_auc": row["auc"], "precision": row["precision"],
                                                     "recall": row["recall"], "f1": row["f1"]})
    return tmodel, m, scored


def train_risk_model(
    training: DataFrame, key: str = "content_id", n_trees: int = rk.N_TREES, test: float = 0.2, seed: int = 42,
    log: bool = False,
):
    """M6 + M7: exact stratified split -> two GBTs -> averaged test scores ->
    exact AUC and class-1 P/R/F1 at the .5 ensemble threshold."""
    spark = training.sparkSession
    split = ev.exact_split(training, key, "label", test, seed).checkpoint(eager=True)
    split = dealt(split, TREE_TASK_ROWS)
    train = split.filter(F.col("split") == "train").drop("split")
    testd = split.filter(F.col("split") == "test").drop("split")
    ens = rk.train_ensemble(train, n_trees, key=key)
    scored = rk.score(ens, testd).checkpoint(eager=True)  # the metrics read it several times
    m = _metrics(scored, "label", "raw_risk", "prediction")
    if log:
        from modspark.sources.sinks import log_metrics

        row = m.first().asDict()
        log_metrics(spark, "gbt_risk_ensemble", {"ensemble_auc": row["auc"], "precision": row["precision"],
                                                 "recall": row["recall"], "f1": row["f1"]})
        log_metrics(spark, "gbt_risk_ensemble", {"a_trees": n_trees, "b_trees": n_trees}, "param")
    return ens, m, scored


def train_vector_probe(
    vectors: DataFrame, epochs: int = 5, test: float = 0.2, seed: int = 42, log: bool = False
):
    """M8: unstratified hash split -> mini-batch rounds of the probe, each
    evaluated on the test rows.  Returns the last round's probe, its rounds
    (training loss, test AUC, precision, recall, F1), the last metrics and the
    scored test rows."""
    spark = vectors.sparkSession
    d = vectors.select("id", "embedding", encode_label(F.col("label")).alias("label"))
    d = ev.hash_split(d, "id", test, seed).checkpoint(eager=True)  # read once a round
    train, testd = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    rounds, m, scored = [], None, None
    for k, (model, loss) in enumerate(pr.train(train, epochs)):
        scored = testd.select("id", "label", model.probability().alias("p"))
        scored = scored.withColumn("prediction", (F.col("p") > F.lit(0.5)).cast("int"))
        scored = scored.checkpoint(eager=True)  # the metrics read it several times
        m = _metrics(scored, "label", "p", "prediction")
        rounds.append({"step": k, "loss": loss} | m.first().asDict())
        if log:
            from modspark.sources.sinks import log_metrics

            log_metrics(spark, "vector_probe", {c: v for c, v in rounds[-1].items() if c != "step"}, step=k)
    return model, rounds, m, scored


def vector_scores(model: pr.Probe, vectors: DataFrame) -> DataFrame:
    """M9: P21 image output of the probe: label nsfw/safe, confidence max(p, 1-p)."""
    cols = image_classifier_output(F.col("p"))
    return vectors.select("id", model.probability().alias("p")).select("id", *[v.alias(k) for k, v in cols.items()])
