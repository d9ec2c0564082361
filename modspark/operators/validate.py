"""Content identity, modality presence and input validation.

Validation never fails a batch: rows the text scorer would refuse go to a
quarantine with a reason, everything else is accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modspark.functions.text import WHITESPACE, is_blank


def content_key(user_id: Column, ts: Column, text: Column, image_ref: Column) -> Column:
    """Deterministic, retry-safe content id: sha-256 hex of user, time (to the
    microsecond), text and image reference, each with its length before it
    (a missing one is '-'), so no two different contents share an encoding."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    micros = F.unix_micros(ts.cast("timestamp"))
    return F.sha2(F.concat_ws("|", part(user_id), part(micros), part(text), part(image_ref)), 256)


def with_content_ids(df: DataFrame) -> DataFrame:
    """``content_key`` (full) and ``content_short`` (8-char display prefix).

    The prefix is for display only: 32 bits collide at ~1e5 rows, so joins
    always use the full key.
    """
    image = F.col("image_ref") if "image_ref" in df.columns else F.lit(None)
    key = content_key(F.col("user_id"), F.col("ts"), F.col("text"), image)
    return df.withColumn("content_key", key).withColumn("content_short", F.substring("content_key", 1, 8))


def with_modalities(df: DataFrame) -> DataFrame:
    """``has_text``: non-empty text; ``has_image``: an image reference is present."""
    return df.withColumn(
        "has_text", F.col("text").isNotNull() & (F.col("text") != F.lit(""))
    ).withColumn("has_image", F.col("image_ref").isNotNull())


def with_validation(df: DataFrame) -> DataFrame:
    """``status`` accepted / quarantine and ``reason`` (NULL when accepted).

    Text that is present but blank (whitespace only) is refused by the text
    scorer, so those rows are quarantined; absent text is simply a missing
    modality.  So are rows whose ``user_meta`` came as text that is not a JSON
    object (absent metadata is fine).
    """
    present = F.col("text").isNotNull() & (F.col("text") != F.lit(""))
    reason = F.when(present & is_blank(F.col("text")), F.lit("blank_text"))
    if "user_meta" in df.columns and isinstance(df.schema["user_meta"].dataType, T.StringType):
        meta = F.col("user_meta")
        is_object = F.substring(F.trim(meta, F.lit(WHITESPACE)), 1, 1) == F.lit("{")
        bad = meta.isNotNull() & ~(is_object & F.try_parse_json(meta).isNotNull())
        reason = reason.when(bad, F.lit("invalid_user_meta"))
    return df.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("accepted")).otherwise(F.lit("quarantine"))
    )


def accepted(df: DataFrame) -> DataFrame:
    return with_validation(df).filter(F.col("status") == "accepted").drop("status", "reason")
