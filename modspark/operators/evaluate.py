"""Evaluation: label distribution, train/test splits, exact ROC AUC, the
classification report and label coverage.

Rank-based statistics (AUC, the exact split) need positions in a global
order.  Instead of one global window they use the bucketed prefix sum of
``operators.windows``: exact within-bucket positions from a window per
bucket, plus offsets from a per-bucket aggregate that is small by
construction (AUC: one row per 1e-4 of score; split: 65,536 hash buckets
per label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspark.functions.numeric import half_up
from modspark.schemas import CORPUS_LABELS


def label_distribution(df: DataFrame, label_cols: list[str] | None = None, label: str = "label") -> DataFrame:
    """One row: rows, sum of every label column, toxic/clean counts of
    the any-of label (partial aggregation, one row per task shuffled)."""
    cols = label_cols or CORPUS_LABELS
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(F.col(c)).cast("long").alias(f"sum_{c}") for c in cols],
        F.count_if(F.col(label) == 1).alias("n_toxic"),
        F.count_if(F.col(label) == 0).alias("n_clean"),
    )


# ---------------------------------------------------------------------------
# Splits
# ---------------------------------------------------------------------------


def hash_fraction(key: Column, seed: int = 42) -> Column:
    """Deterministic uniform number in [0, 1) from md5(key # seed)."""
    h = F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """W4 default: per-row hash bucket; test iff fraction < ``test``.  No
    shuffle; stratified in expectation."""
    return df.withColumn(out, F.when(hash_fraction(F.col(key), seed) < F.lit(test), F.lit("test")).otherwise(F.lit("train")))


def exact_split(
    df: DataFrame, key: str, label: str, test: float = 0.2, seed: int = 42, out: str = "split"
) -> DataFrame:
    """W4 exact: per label, rows ordered by md5(key # seed); the first
    ``round_half_up(test * n_label)`` are test.  Positions are bucketed prefix
    counts (65,536 md5 buckets per label, so a label of 10^10 rows is ranked
    in windows of ~150k rows); no task holds a whole label, and the
    per-bucket offsets are at most 65,536 rows per label."""
    h = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))
    base = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 4))
    w = Window.partitionBy(label, "_b").orderBy("_h", key)
    inner = base.withColumn("_rn", F.row_number().over(w))
    buckets = base.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(label)
    offsets = buckets.select(
        F.col(label).alias("_ol"),
        F.col("_b").alias("_ob"),
        F.coalesce(F.sum("_nb").over(before), F.lit(0)).alias("_off"),
        F.sum("_nb").over(whole).alias("_n"),
    )
    # null-safe: rows without a label are a class of their own
    res = inner.join(offsets, inner[label].eqNullSafe(offsets["_ol"]) & (inner["_b"] == offsets["_ob"]))
    k = F.floor(F.col("_n") * F.lit(float(test)) + F.lit(0.5))
    pos = F.col("_off") + F.col("_rn")
    return res.withColumn(out, F.when(pos <= k, F.lit("test")).otherwise(F.lit("train"))).drop(
        "_h", "_b", "_rn", "_off", "_n", "_ol", "_ob"
    )


# ---------------------------------------------------------------------------
# ROC AUC (Mann-Whitney, ties count one half)
# ---------------------------------------------------------------------------


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "score", decimals: int | None = None, buckets: int = 4096
) -> DataFrame:
    """One row ``(auc, n_pos, n_neg)``, exact.

    Per distinct score: positives and negatives (combined map-side).  With
    scores grouped into ordered buckets, the Mann-Whitney sum splits into

    * within buckets: ``pos * (negatives of lower scores in the bucket +
      neg / 2)``, from a window per bucket, and
    * across buckets: ``positives of the bucket * negatives of all lower
      buckets``, from a prefix over the per-bucket totals (bounded by the
      bucket count),

    two one-row aggregates over the same per-score table (its shuffle is
    shared), combined without a join.  All terms are whole or half counts,
    so the sum is exact in doubles.

    Buckets: scores known to carry ``decimals`` decimals in [0, 1] use one
    bucket per possible value (``10**decimals + 1``, no extra job).  Other
    scores (raw probabilities) use ``buckets`` equal-count ranges of the
    distinct scores, from an approximate-quantile pass: the edges only
    decide the balance, never the result, and no bucket holds much more than
    ``1/buckets`` of the distinct scores however they cluster.
    """
    s = F.col(score).cast("double")
    g = df.filter(s.isNotNull() & F.col(label).isNotNull()).groupBy(s.alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"),
    )
    if decimals is not None:
        g = g.withColumn("_b", F.floor(F.col("s") * F.lit(float(10**decimals))))
    else:
        g = _quantile_buckets(g, "s", buckets)
    w = Window.partitionBy("_b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below_in = F.coalesce(F.sum("neg").over(w), F.lit(0))
    within = g.select((F.col("pos") * (below_in + F.lit(0.5) * F.col("neg"))).alias("_u")).agg(
        F.sum("_u").alias("_u"), F.lit(0).cast("long").alias("n_pos"), F.lit(0).cast("long").alias("n_neg")
    )
    per_bucket = g.groupBy("_b").agg(F.sum("pos").alias("_pb"), F.sum("neg").alias("_nb"))
    # one row per bucket (bounded by the bucket count, not by the data)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("_nb").over(before), F.lit(0))
    across = per_bucket.select((F.col("_pb") * lower).cast("double").alias("_u"), "_pb", "_nb").agg(
        F.sum("_u").alias("_u"), F.sum("_pb").alias("n_pos"), F.sum("_nb").alias("n_neg")
    )
    agg = within.unionByName(across).agg(
        F.sum("_u").alias("_u"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")
    )
    return agg.select(
        (F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
        F.col("n_pos").cast("long"),
        F.col("n_neg").cast("long"),
    )


def _quantile_buckets(df: DataFrame, col: str, buckets: int, out: str = "_b") -> DataFrame:
    """Bucket ``col`` into about ``buckets`` equal-count ranges: edges from a
    distributed approximate-quantile pass (bounded sketch, ``buckets`` values
    to the driver), assignment by binary search in the JVM (Bucketizer)."""
    from pyspark.ml.feature import Bucketizer

    probs = [i / buckets for i in range(1, buckets)]
    edges = sorted({float(x) for x in df.approxQuantile(col, probs, 1.0 / (4 * buckets))}) or [0.0]
    splits = [float("-inf")] + edges + [float("inf")]
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep")
    return b.transform(df)


# ---------------------------------------------------------------------------
# Classification report
# ---------------------------------------------------------------------------


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 6) -> DataFrame:
    """A10: rows for class 0, class 1, accuracy, macro avg, weighted avg
    with precision / recall / f1 / support (0 where undefined).  The
    confusion counts are one partial aggregate (one row)."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    m = c.select(
        "tp", "fp", "fn", "tn",
        p1.alias("p1"), r1.alias("r1"), _div(2 * p1 * r1, p1 + r1).alias("f1"),
        p0.alias("p0"), r0.alias("r0"), _div(2 * p0 * r0, p0 + r0).alias("f0"),
        (tp + fn).alias("s1"), (tn + fp).alias("s0"),
    ).withColumn("n", F.col("s0") + F.col("s1"))
    n = F.col("n")

    def wavg(a: str, b: str) -> Column:
        return _div(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), n)

    def rnd(x: Column) -> Column:
        return half_up(x, digits)

    def row(name: str, prec: Column, rec: Column, f1: Column, sup: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class_name"), prec.cast("double").alias("precision"),
            rec.cast("double").alias("recall"), f1.cast("double").alias("f1"), sup.cast("long").alias("support"),
        )

    rows = F.array(
        row("0", rnd(F.col("p0")), rnd(F.col("r0")), rnd(F.col("f0")), F.col("s0")),
        row("1", rnd(F.col("p1")), rnd(F.col("r1")), rnd(F.col("f1")), F.col("s1")),
        row("accuracy", F.lit(None), F.lit(None), rnd(_div(F.col("tp") + F.col("tn"), n)), n),
        row("macro avg", rnd((F.col("p0") + F.col("p1")) / 2), rnd((F.col("r0") + F.col("r1")) / 2),
            rnd((F.col("f0") + F.col("f1")) / 2), n),
        row("weighted avg", rnd(wavg("p0", "p1")), rnd(wavg("r0", "r1")), rnd(wavg("f0", "f1")), n),
    )
    return m.select(F.inline(rows)).select(
        "class_name", "precision", "recall", "f1", F.col("support").cast("long").alias("support")
    )


# ---------------------------------------------------------------------------
# Label coverage
# ---------------------------------------------------------------------------


def labelled(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows with a label (left semi join)."""
    return df.join(labels.select(key), key, "left_semi")


def unlabelled(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows without a label (left anti join)."""
    return df.join(labels.select(key), key, "left_anti")


def with_labels(df: DataFrame, labels: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows with their labels (inner join; unlabelled rows are excluded)."""
    return df.join(labels.select(key, *cols), key)
