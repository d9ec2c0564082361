"""M8: the linear probe on image vectors, trained in mini-batches a round.

A round is one pass over the training rows: every task runs mini-batch
gradient steps over its rows from the round's common weights and gives back
its weights and number of rows; their mean by rows is the next round's start.
Tasks hold one Arrow batch, the driver a vector a task.  After each round the
test rows are scored for loss, exact AUC and class-1 precision / recall / F1.

Defined cases: rows without a vector, or of another length than most, are left
out of training and score NULL; rows come in the order of a hash of their id
and the round, so a round's steps do not depend on file order.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.session import path_exists

BATCH, RATE = 32, 1.0


@dataclass
class Probe:
    """Weights and intercept over standardised vectors, folded back to the
    plain ones, so scoring is one product."""

    weights: list[float] | None = None
    intercept: float = 0.0

    def trained(self) -> None:
        if self.weights is None:
            raise RuntimeError("the probe is not trained; train or load it first")

    def probability(self, vector: str = "embedding") -> Column:
        self.trained()
        v, n = F.col(vector), len(self.weights)
        w = F.array(*[F.lit(float(x)) for x in self.weights])
        dot = F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(v) == n, F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(float(self.intercept))))))

    def save(self, spark: SparkSession, path: str) -> None:
        """A folder of one record; replacing one warns."""
        self.trained()
        if path_exists(spark, path):
            warnings.warn(f"{path} holds a model already; it is replaced", stacklevel=2)
        row = [(json.dumps(list(map(float, self.weights))), float(self.intercept))]
        spark.createDataFrame(row, "weights string, intercept double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Probe:
        if not path_exists(spark, path):
            raise FileNotFoundError(f"no probe in {path}")
        row = spark.read.schema("weights string, intercept double").parquet(path).first()
        return cls(json.loads(row.weights), row.intercept)


def _moments(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every component (map-side combined)."""
    parts = rows.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    found = {r.k: (r.m, r.s or 1.0) for r in parts.collect()}
    return np.array([found[k][0] for k in range(n)]), np.array([found[k][1] for k in range(n)])


def round_of(rows: DataFrame, w: np.ndarray, mean: np.ndarray, dev: np.ndarray, rate: float, batch: int) -> tuple[np.ndarray, float]:
    """One pass: (the tasks' mean weights, mean training loss met on the way)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, n, loss = w.copy(), 0, 0.0
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
            x, y = np.column_stack([(x - mean) / dev, np.ones(len(x))]), b.column(1).to_numpy()
            for i in range(0, len(y), batch):
                xs, ys = x[i : i + batch], y[i : i + batch]
                p = 1 / (1 + np.exp(-np.clip(xs @ mine, -30, 30)))
                loss -= float(np.log(np.where(ys > 0, p, 1 - p)).sum())
                mine = mine - rate / xs.shape[1] * xs.T @ (p - ys) / len(ys)
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([mine.tobytes()], pa.binary()), pa.array([n]), pa.array([loss])], names=["w", "n", "loss"])

    parts = rows.mapInArrow(run, "w binary, n long, loss double").collect()
    total = sum(r.n for r in parts)
    return sum(np.frombuffer(r.w) * r.n for r in parts) / total, sum(r.loss for r in parts) / total


def train(
    rows: DataFrame, rounds: int = 5, batch: int = BATCH, rate: float = RATE, vector: str = "embedding", label: str = "label", key: str = "id"
) -> Iterator[tuple[Probe, float]]:
    """The probe after every round, with the loss met in the round.  ``rows``
    should be stored: they are read once a round."""
    rows = rows.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(
        F.transform(vector, lambda x: x.cast("double")).alias("v"), F.col(label).cast("double").alias("y"), F.xxhash64(key).alias("_k")
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        raise ValueError("no labelled vectors to train on")
    rows = rows.filter(F.size("v") == sizes.n)
    mean, dev = _moments(rows, sizes.n)
    w = np.zeros(sizes.n + 1)
    for k in range(rounds):
        ordered = rows.sortWithinPartitions(F.xxhash64("_k", F.lit(k))).select("v", "y")
        # smaller steps in later rounds
        w, loss = round_of(ordered, w, mean, dev, rate * sizes.n / (2 + k), batch)
        if not math.isfinite(loss):
            raise ArithmeticError("the probe's training diverged; lower the rate")
        plain = w[:-1] / dev
        yield Probe(plain.tolist(), float(w[-1] - plain @ mean)), loss
