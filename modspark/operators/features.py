"""The 22 risk features and the joins that bring their inputs together.

Inputs are three nullable structs on the content row: ``text_scores``,
``image_scores`` and ``user_meta``.  A missing struct, a missing field and
an explicit NULL all take the same default, so one ``select`` of coalesces
covers every NULL pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.functions.numeric import r4
from modspark.schemas import (
    BOTH_FLAGGED,
    COMBINED_IMAGE_W,
    COMBINED_TEXT_W,
    FEATURE_COLUMNS,
    HIGH_VELOCITY,
    REPEAT_OFFENDER,
    TEXT_HIGH,
    USER_DEFAULTS,
    USER_META,
    VIOLATION_CAP,
    VIOLATION_WEIGHT,
)


def _field(struct_col: str, field: str, default) -> Column:
    return F.coalesce(F.col(f"{struct_col}.{field}"), F.lit(default))


def feature_columns() -> dict[str, Column]:
    """Column expressions of the 22 features, keyed by name, in frozen order."""
    tox = _field("text_scores", "toxicity", 0.0).cast("double")
    sev = _field("text_scores", "severe_toxicity", 0.0).cast("double")
    obs = _field("text_scores", "obscene", 0.0).cast("double")
    thr = _field("text_scores", "threat", 0.0).cast("double")
    ins = _field("text_scores", "insult", 0.0).cast("double")
    idt = _field("text_scores", "identity_attack", 0.0).cast("double")
    trs = _field("text_scores", "risk_score", 0.0).cast("double")

    irs = _field("image_scores", "risk_score", 0.0).cast("double")
    ihs = _field("image_scores", "harmful_score", 0.0).cast("double")
    iss = _field("image_scores", "safe_score", 1.0).cast("double")
    ilab = _field("image_scores", "label", "safe")

    age = _field("user_meta", "account_age_days", USER_DEFAULTS["account_age_days"]).cast("int")
    vio = _field("user_meta", "prev_violations", USER_DEFAULTS["prev_violations"]).cast("int")
    rep = _field("user_meta", "reports_received", USER_DEFAULTS["reports_received"]).cast("int")
    posts = _field("user_meta", "posts_last_24h", USER_DEFAULTS["posts_last_24h"]).cast("int")
    ver = _field("user_meta", "is_verified", USER_DEFAULTS["is_verified"]).cast("int")

    high = F.lit(TEXT_HIGH)
    cols = {
        "text_toxicity": tox,
        "text_severe_toxicity": sev,
        "text_obscene": obs,
        "text_threat": thr,
        "text_insult": ins,
        "text_identity_attack": idt,
        "text_risk_score": trs,
        "text_max_score": F.greatest(tox, sev, thr),
        "text_any_high": ((tox > high) | (sev > high) | (thr > high)).cast("int"),
        "image_risk_score": irs,
        "image_harmful_score": ihs,
        "image_safe_score": iss,
        "image_is_harmful": (ilab != F.lit("safe")).cast("int"),
        "user_account_age_days": age,
        "user_prev_violations": vio,
        "user_reports_received": rep,
        "user_posts_last_24h": posts,
        "user_is_verified": ver,
        "user_high_velocity": (posts > F.lit(HIGH_VELOCITY)).cast("int"),
        "user_repeat_offender": (vio > F.lit(REPEAT_OFFENDER)).cast("int"),
        "both_modalities_flagged": ((trs > F.lit(BOTH_FLAGGED)) & (irs > F.lit(BOTH_FLAGGED))).cast("int"),
        "combined_raw_score": r4(
            trs * F.lit(COMBINED_TEXT_W)
            + irs * F.lit(COMBINED_IMAGE_W)
            + F.least(vio * F.lit(VIOLATION_WEIGHT), F.lit(VIOLATION_CAP))
        ),
    }
    assert list(cols) == FEATURE_COLUMNS
    return cols


def with_features(df: DataFrame) -> DataFrame:
    """Add the 22 feature columns (inputs: ``text_scores``, ``image_scores``,
    ``user_meta`` structs; any of them may be absent from the frame)."""
    for name, dtype in (
        ("text_scores", "struct<toxicity:double,severe_toxicity:double,obscene:double,threat:double,"
                        "insult:double,identity_attack:double,risk_score:double>"),
        ("image_scores", "struct<harmful_score:double,safe_score:double,risk_score:double,label:string>"),
        ("user_meta", "struct<account_age_days:int,prev_violations:int,reports_received:int,"
                      "posts_last_24h:int,is_verified:boolean>"),
    ):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(dtype))
    return parse_user_meta(df).withColumns(feature_columns())


def _spread_null(key: Column, content: DataFrame) -> Column:
    """The key as text, NULL replaced by one of 4,096 values no key has: rows
    without a key match nothing, so they need not meet in one task."""
    of = [F.col(c) for c in ("content_id", "ts", "text") if c in content.columns]
    salt = F.pmod(F.xxhash64(*(of or [F.lit(0)])), F.lit(4096))
    return F.coalesce(key.cast("string"), F.concat(F.lit("\x00none "), salt.cast("string")))


def parse_user_meta(content: DataFrame) -> DataFrame:
    """A ``user_meta`` that is JSON text as the struct of its known fields;
    other columns as they are.  Fields that are missing or of another type
    are NULL; text that is no JSON object gives NULL
    (``validate.with_validation`` quarantines such rows)."""
    if "user_meta" not in content.columns or not isinstance(content.schema["user_meta"].dataType, T.StringType):
        return content
    return content.withColumn("user_meta", F.from_json("user_meta", USER_META))


def with_image_scores(content: DataFrame, image_scores: DataFrame, key: str = "image_ref") -> DataFrame:
    """Attach ``image_scores`` (struct) by the content's image reference.

    ``image_scores`` has one row per image (``image_ref`` + score columns);
    a content row without an image, or whose image has no scores, gets NULL.
    """
    scores = image_scores.select(
        F.col("image_ref").alias("_iref"),
        F.struct("harmful_score", "safe_score", "risk_score", "label").alias("image_scores"),
    )
    ref = _spread_null(content[key], content)
    return content.join(scores, ref == scores["_iref"].cast("string"), "left").drop("_iref")


def with_user_meta(content: DataFrame, users: DataFrame) -> DataFrame:
    """Attach ``user_meta`` (struct) by ``user_id``.  Metadata that came
    with the content wins, field by field; users are the fallback, and unknown
    users without own metadata get NULL (the defaults).  AQE picks broadcast or sort-merge from the
    runtime size of ``users`` and splits a skewed user on the content side."""
    meta = users.select(
        F.col("user_id").alias("_uid"),
        F.struct(
            "account_age_days", "prev_violations", "reports_received", "posts_last_24h", "is_verified"
        ).alias("user_meta"),
    )
    content = parse_user_meta(content)
    own = "user_meta" in content.columns
    out = content.withColumnRenamed("user_meta", "_own") if own else content
    user = _spread_null(out["user_id"], out)
    out = out.join(meta, user == meta["_uid"].cast("string"), "left").drop("_uid")
    if own:
        fields = [
            F.coalesce(F.col("_own")[f], F.col("user_meta")[f]).alias(f)
            for f in ("account_age_days", "prev_violations", "reports_received", "posts_last_24h", "is_verified")
        ]
        known = F.col("_own").isNotNull() | F.col("user_meta").isNotNull()
        out = out.withColumn("user_meta", F.when(known, F.struct(*fields))).drop("_own")
    return out


def assemble(df: DataFrame, output_col: str = "features") -> DataFrame:
    """The frozen feature order as one ML vector column."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol=output_col).transform(df)
