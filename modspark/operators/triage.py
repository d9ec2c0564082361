"""Severity bands, triage routes and the final action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.schemas import (
    BAND_FLOOR,
    BANDS,
    DEFAULT_REVIEW_ACTION,
    TRIAGE_AUTO_APPROVE,
    TRIAGE_AUTO_REMOVE,
)


def severity(risk: Column) -> Column:
    expr = None
    for lo, sev, _ in BANDS:
        expr = F.when(risk >= F.lit(lo), F.lit(sev)) if expr is None else expr.when(risk >= F.lit(lo), F.lit(sev))
    return expr.otherwise(F.lit(BAND_FLOOR[0]))


def band_action(risk: Column) -> Column:
    expr = None
    for lo, _, act in BANDS:
        expr = F.when(risk >= F.lit(lo), F.lit(act)) if expr is None else expr.when(risk >= F.lit(lo), F.lit(act))
    return expr.otherwise(F.lit(BAND_FLOOR[1]))


def with_bands(df: DataFrame, risk_col: str = "risk_score") -> DataFrame:
    """P10: ``severity`` and ``band_action`` (inclusive lower bounds)."""
    r = F.col(risk_col)
    return df.withColumn("severity", severity(r)).withColumn("band_action", band_action(r))


def route(risk: Column, auto_remove: float = TRIAGE_AUTO_REMOVE, auto_approve: float = TRIAGE_AUTO_APPROVE) -> Column:
    return (
        F.when(risk >= F.lit(auto_remove), F.lit("auto_remove"))
        .when(risk <= F.lit(auto_approve), F.lit("auto_approve"))
        .otherwise(F.lit("agent_review"))
    )


def with_route(
    df: DataFrame,
    risk_col: str = "risk_score",
    auto_remove: float = TRIAGE_AUTO_REMOVE,
    auto_approve: float = TRIAGE_AUTO_APPROVE,
) -> DataFrame:
    """``route`` in auto_remove / auto_approve / agent_review."""
    return df.withColumn("route", route(F.col(risk_col), auto_remove, auto_approve))


def final_action(route_col: Column, recommended: Column) -> Column:
    """Reviewed rows take the review's recommendation (default flag);
    the band action never becomes the final action."""
    return (
        F.when(route_col == F.lit("agent_review"), F.coalesce(recommended, F.lit(DEFAULT_REVIEW_ACTION)))
        .when(route_col == F.lit("auto_remove"), F.lit("auto_remove"))
        .otherwise(F.lit("approved"))
    )


def with_final_action(df: DataFrame, review_col: str = "review") -> DataFrame:
    rec = F.col(f"{review_col}.recommended_action") if review_col in df.columns else F.lit(None).cast("string")
    return df.withColumn("final_action", final_action(F.col("route"), rec))
