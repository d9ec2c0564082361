"""Image-vector operators: class prototypes, the zero-shot head, label
encoding and the linear-probe scoring.

Prototypes (prompt vectors) are a model parameter bounded by the number of
prompts/classes: they are computed by a Spark aggregation, size-checked,
and inlined into the plan, so scoring every vector is a narrow per-row
computation (no join, no pairs, no shuffle).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.functions.numeric import r4
from modspark.schemas import (
    LOW_CONFIDENCE_LABEL,
    LOW_CONFIDENCE_NOTE,
    ZERO_SHOT_GUARD_STD,
    ZERO_SHOT_HARMFUL,
)

MAX_PROMPTS = 1024


def class_centroids(vectors: DataFrame, class_col: str = "class_id", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per class (``class_id``, ``centroid array<double>``).

    ``posexplode`` is narrow; the (class, position) average is combined
    map-side, so only classes x dimensions partial rows are shuffled."""
    e = vectors.select(F.col(class_col).alias("class_id"), F.posexplode(vec_col).alias("pos", "v"))
    per_dim = e.groupBy("class_id", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return per_dim.groupBy("class_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("centroid")
    )


def collect_prompts(prompts: DataFrame, name_col: str, vec_col: str, order_col: str) -> tuple[list[str], list[list[float]]]:
    """Bring a bounded prompt table to the driver (refuses oversize tables)."""
    rows = prompts.select(name_col, vec_col, order_col).limit(MAX_PROMPTS + 1).collect()
    if len(rows) > MAX_PROMPTS:
        raise ValueError(f"more than {MAX_PROMPTS} prompts; prompt sets are parameters, not data")
    rows.sort(key=lambda r: r[order_col])
    return [str(r[name_col]) for r in rows], [[float(x) for x in r[vec_col]] for r in rows]


def zero_shot(
    vectors: DataFrame,
    names: list[str],
    prompt_vectors: list[list[float]],
    n_harmful: int,
    vec_col: str = "embedding",
    logit_scale: float = 1.0,
    guard_std: float = ZERO_SHOT_GUARD_STD,
    harmful_threshold: float = ZERO_SHOT_HARMFUL,
) -> DataFrame:
    """A11-A12 (+J4 as per-row arithmetic): add the ``image_scores`` columns.

    Cosine similarity to each prompt, softmax (``logit_scale`` 1.0 = no
    temperature), harmful = sum over the first ``n_harmful`` prompts, safe =
    the rest; a near-uniform distribution (population std < ``guard_std``)
    defaults to safe.

    The prompts are one constant array of unit vectors and every step is an
    array expression over it, so the plan has the same few nodes for any
    number of prompts and dimensions.  Sums are left folds in element order.
    A vector that is null, all zeros or of another length than the prompts
    has no similarities: its scores are null, its label 'safe'.
    """
    from modspark.operators.partitioning import computed_once, spread

    if not prompt_vectors:
        raise ValueError("no prompts")
    k = len(prompt_vectors)
    units = json.dumps([l2_unit(p) for p in prompt_vectors])
    tags = ", ".join(_slit(n) for n in names)
    std, scale, over = _dlit(float(guard_std)), _dlit(float(logit_scale)), _dlit(float(harmful_threshold))

    def total(xs: str) -> str:
        return f"aggregate({xs}, 0.0D, (a, x) -> a + x)"

    def r4s(x: str) -> str:
        return f"CAST(FLOOR(({x}) * 10000.0D + 0.5D) / 10000.0D AS DOUBLE)"

    # One array a step, each from a generator row: computed once a vector.
    out = spread(vectors)
    for name, expr in {
        "_v": f"CAST(`{vec_col}` AS ARRAY<DOUBLE>)",
        "_n": f"nullif(sqrt({total('transform(_v, x -> x * x)')}), 0.0D)",
        "_s": f"transform(from_json('{units}', 'array<array<double>>'), "
        f"u -> {total('zip_with(_v, u, (x, y) -> x * y)')} / _n * {scale})",
        "_e": "transform(_s, x -> exp(x - array_max(_s)))",
        "_z": total("_e"),
        "_p": "transform(_e, x -> x / _z)",
        "_mean": _dlit(1.0 / k),
        "_std": f"sqrt({total('transform(_p, x -> (x - _mean) * (x - _mean))')} / {_dlit(float(k))})",
        "_harm": total(f"slice(_p, 1, {n_harmful})"),
        "_safe": total(f"slice(_p, {n_harmful + 1}, {k})"),
        "_top": "array_max(_p)",
    }.items():
        out = computed_once(out, {name: F.expr(expr)})
    low = f"(_std < {std})"
    exprs = {
        "prob_std": "_std",
        "harmful_score": f"CASE WHEN {low} THEN 0.0D ELSE {r4s('_harm')} END",
        "safe_score": f"CASE WHEN {low} THEN 1.0D ELSE {r4s('_safe')} END",
        "risk_score": f"CASE WHEN {low} THEN 0.0D ELSE {r4s('_harm')} END",
        "prompt_scores": f"map_from_arrays(array({tags}), transform(_p, p -> {r4s('p')}))",
        "label": f"CASE WHEN {low} THEN 'safe' WHEN _harm > {over} THEN 'harmful' ELSE 'safe' END",
        "confidence": f"CASE WHEN {low} THEN {_slit(LOW_CONFIDENCE_LABEL)} ELSE 'high' END",
        "note": f"CASE WHEN {low} THEN {_slit(LOW_CONFIDENCE_NOTE)} END",
        "top_prompt": f"get(array({tags}), CAST(array_position(_p, _top) - 1 AS INT))",
        "top_score": r4s("_top"),
    }
    out = computed_once(out, {n: F.expr(x) for n, x in exprs.items()})
    return out.drop("_v", "_n", "_s", "_e", "_z", "_p", "_mean", "_std", "_harm", "_safe", "_top")


def _slit(x: str) -> str:
    """A SQL string literal of ``x``."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _dlit(x: float) -> str:
    """A SQL DOUBLE literal that round-trips ``x`` exactly."""
    return "(" + ("%.17g" % x) + "D)"


def l2_unit(p: list[float]) -> list[float]:
    n = sum(x * x for x in p) ** 0.5
    return [x / n for x in p] if n else list(p)


def encode_label(label: Column, positive: str = "nsfw") -> Column:
    """S5: 'nsfw' -> 1, anything else -> 0."""
    return F.when(label == F.lit(positive), F.lit(1)).otherwise(F.lit(0))


def image_classifier_output(prob: Column, threshold: float = 0.5) -> dict[str, Column]:
    """P21 (image): label nsfw/safe at ``p > t``; confidence max(p, 1-p)."""
    return {
        "risk_score": r4(prob),
        "label": F.when(prob > F.lit(threshold), F.lit("nsfw")).otherwise(F.lit("safe")),
        "confidence": r4(F.greatest(prob, F.lit(1.0) - prob)),
    }
