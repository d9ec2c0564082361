"""Risk ensemble: training set, two boosted-tree models, the averaged
score with bands, feature importance and persistence.

Two different learners stand in for two boosting libraries: A is MLlib's
``GBTClassifier`` (level by level, gradients of the logistic loss), B the
second-order histogram boosting of ``hist_boost`` (leaf by leaf).  Both have
all the trees asked for, at the same rate and depth.
Probabilities differ from the original libraries'; the contract (mean of two,
4 dp, bands) is the same.  A checkpoints its lineage every 10 iterations into
the shared checkpoint folder, B writes its rows' scores there every 10 trees,
so a lost executor does not replay the whole fit.
"""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.functions.numeric import r4
from modspark.operators import hist_boost, triage
from modspark.operators.hist_boost import Boosted
from modspark.schemas import ENSEMBLE_THRESHOLD, FEATURE_COLUMNS
from modspark.session import path_exists

N_TREES, RATE, DEPTH, LEAVES = 200, 0.05, 5, 31


def training_set(features: DataFrame, labels: DataFrame, key: str = "content_id", label: str = "label") -> DataFrame:
    """M5: the 22 features of labelled rows + ``label`` (inner join)."""
    return features.select(key, *FEATURE_COLUMNS).join(labels.select(key, F.col(label).cast("int").alias("label")), key)


@dataclass
class Ensemble:
    """Model A (a fitted pipeline), model B (``hist_boost.Boosted``) and the
    frozen feature order."""

    model_a: object | None = None
    model_b: Boosted | None = None
    feature_columns: list[str] = field(default_factory=lambda: list(FEATURE_COLUMNS))

    def trained(self) -> None:
        if self.model_a is None or self.model_b is None:
            raise RuntimeError("the risk ensemble is not trained; train or load it first")

    def save(self, path: str, overwrite: bool = True) -> None:
        """Both models in one folder; the feature order is kept in the
        assembler of A and in B.  Replacing a model warns."""
        self.trained()
        spark, base = SparkSession.active(), path.rstrip("/")
        if path_exists(spark, base):
            if not overwrite:
                raise FileExistsError(f"{base} holds a model already")
            warnings.warn(f"{base} holds a model already; it is replaced", stacklevel=2)
        self.model_a.write().overwrite().save(f"{base}/model_a")
        self.model_b.save(spark, f"{base}/model_b")

    @classmethod
    def load(cls, path: str) -> "Ensemble":
        from pyspark.ml import PipelineModel

        spark, base = SparkSession.active(), path.rstrip("/")
        for part in ("model_a", "model_b"):
            if not path_exists(spark, f"{base}/{part}"):
                raise FileNotFoundError(f"no risk ensemble in {base}: {part} is missing")
        a = PipelineModel.load(f"{base}/model_a")
        return cls(a, Boosted.load(spark, f"{base}/model_b"), list(a.stages[0].getInputCols()))


def train_ensemble(train: DataFrame, n_trees: int = N_TREES, label: str = "label", key: str = "content_id") -> Ensemble:
    """M6: an MLlib GBT pipeline (assembler -> trees) and histogram boosting of
    ``n_trees`` trees each, of ``DEPTH`` levels, on the same rows.  Their jobs,
    a thousand short ones each, run side by side."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    asm = VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features", handleInvalid="keep")
    a = GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=n_trees, maxDepth=DEPTH, stepSize=RATE, maxBins=32, seed=42,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", checkpointInterval=10,
    )

    def second() -> Boosted:
        return hist_boost.fit(
            train, list(FEATURE_COLUMNS), label, key, trees=n_trees, rate=RATE, leaves=LEAVES, depth=DEPTH, at_once=2 ** (DEPTH - 1)
        )

    with ThreadPoolExecutor(1) as pool:
        mb = pool.submit(inheritable_thread_target(train.sparkSession)(second))
        ma = Pipeline(stages=[asm, a]).fit(train)
        return Ensemble(ma, mb.result(), list(FEATURE_COLUMNS))


def ensemble_columns(pa: F.Column, pb: F.Column) -> dict[str, F.Column]:
    """M7 + P10: the averaged score (4 dp), both parts (4 dp), severity, the
    band action, and the mean before rounding (thresholds and rankings)."""
    raw = (pa + pb) / F.lit(2.0)
    final = r4(raw)
    return {
        "final_risk_score": final,
        "xgb_score": r4(pa),
        "lgb_score": r4(pb),
        "severity": triage.severity(final),
        "action": triage.band_action(final),
        "raw_risk": raw,
    }


def score(ensemble: Ensemble, df: DataFrame) -> DataFrame:
    """Score every row with both models (a narrow ``transform`` and a column)."""
    from pyspark.ml.functions import vector_to_array

    ensemble.trained()
    a = ensemble.model_a.transform(df).withColumn("_pa", vector_to_array("probability")[1])
    a = a.drop("features", "rawPrediction", "probability", "prediction")
    scored = a.withColumn("_pb", ensemble.model_b.probability())
    return scored.withColumns(ensemble_columns(F.col("_pa"), F.col("_pb"))).withColumn(
        "prediction", (F.col("raw_risk") > F.lit(ENSEMBLE_THRESHOLD)).cast("int")
    ).drop("_pa", "_pb")


def feature_importance(spark: SparkSession, ensemble: Ensemble, top: int = 10) -> DataFrame:
    """A13 + T3: importances of model A, sorted descending (22 rows)."""
    imp = ensemble.model_a.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(ensemble.feature_columns, [float(x) for x in imp]))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)
