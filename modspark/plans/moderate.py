"""End-to-end moderation job: content -> decisions -> audit records.

One lazy plan, narrow up to the joins with image scores and users; the
review step is the only materialisation point (so the reviewer is called
once per queued row).

    content -> validate -> text scores -> (+ image scores, + users) ->
    22 features -> risk (model ensemble, or the text risk without a model) ->
    bands -> triage -> reviews for borderline rows -> final action -> audit
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.operators import audit as au
from modspark.operators import features as fe
from modspark.operators import review as rv
from modspark.operators import text_scores as ts
from modspark.operators import triage, validate
from modspark.operators.plugins import apply_text_scorer
from modspark.operators.plugins import review_responses as run_reviewer
from modspark.schemas import TEXT_LABELS, TRIAGE_AUTO_APPROVE, TRIAGE_AUTO_REMOVE


def score_content(
    content: DataFrame,
    lexicon: DataFrame | list[tuple[str, str, float]] | None = None,
    text_scorer: Callable[[Iterator], Iterator] | None = None,
    image_scores: DataFrame | None = None,
    users: DataFrame | None = None,
    ensemble=None,
    probabilities: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Accepted content with text_scores / image_scores / user_meta structs,
    the 22 features, the risk struct, ``risk_score``, severity and band action.
    The risk is the mean of the two models of ``ensemble``, or of two given
    ``probabilities`` over the features, else the text risk.  Quarantined rows
    are not returned (``validate.with_validation`` tells why)."""
    c = validate.accepted(validate.with_modalities(content))
    if text_scorer is not None:
        c = apply_text_scorer(c, text_scorer)
    elif lexicon is not None:
        c = ts.lexicon_scores(c, lexicon)
    else:
        raise ValueError("a lexicon or a text scorer is required")
    c = c.withColumn("text_scores", F.when(F.col("has_text"), ts.text_scores_struct())).drop(*TEXT_LABELS, "text_risk_score")
    if image_scores is not None:
        c = fe.with_image_scores(c, image_scores)
    if users is not None:
        c = fe.with_user_meta(c, users)
    c = fe.with_features(c)
    if ensemble is not None:
        from modspark.operators import risk as rk

        c = rk.score(ensemble, c).withColumn("risk_score", F.col("final_risk_score"))
    elif probabilities is not None:
        from modspark.operators import risk as rk

        c = c.withColumns(rk.ensemble_columns(*probabilities)).withColumn("risk_score", F.col("final_risk_score"))
    else:
        c = c.withColumn("risk_score", F.col("text_risk_score"))
    c = triage.with_bands(c)
    return c.withColumn(
        "risk", F.struct(F.col("risk_score").alias("final_risk_score"), "severity", F.col("band_action").alias("action"))
    )


def decide(
    scored: DataFrame,
    reviewer: Callable[[Iterator], Iterator] | None = None,
    responses: DataFrame | None = None,
    auto_remove: float = TRIAGE_AUTO_REMOVE,
    auto_approve: float = TRIAGE_AUTO_APPROVE,
    reviewer_partitions: int | None = None,
    model: str = "external",
) -> DataFrame:
    """Triage, reviews for the ``agent_review`` rows only, final action.

    Responses come from ``reviewer`` (a U2 plug-in) or a ``responses`` table
    ``(content_id, raw)``, with ``answered_at`` where known (``reviewed_at``); a queued row without a response gets the error
    fallback, so its action is flag_for_review.  Of several responses to one
    content the smallest text counts (one decision a content); responses
    without a queued content are ignored."""
    d = triage.with_route(scored, "risk_score", auto_remove, auto_approve)
    if reviewer is not None:
        # scored once: the queue and the decisions read the same stored rows
        d = d.checkpoint(eager=True)
        # the reviewer runs on the queue only; its responses are checkpointed
        # so the decisions below never call it again
        queue = rv.review_queue(d, low=auto_approve, high=auto_remove)
        responses = run_reviewer(queue, reviewer, reviewer_partitions)
    if responses is None:
        # no reviewer and no responses: every queued row takes the
        # no-response fallback; no join (and no shuffle of the decisions)
        j = d.withColumns({"raw": F.lit(None).cast("string"), "answered_at": F.lit(None).cast("timestamp")})
    else:
        # J3 as one left join; rows that were not queued carry no review
        j = d.join(first_answer(responses), "content_id", "left")
    return with_decisions(j, model, spread_rows=responses is not None)


def first_answer(responses: DataFrame) -> DataFrame:
    """One row a content: the smallest response text and, where responses
    have an ``answered_at``, when that text came first."""
    at = F.col("answered_at") if "answered_at" in responses.columns else F.lit(None)
    told = responses.filter(F.col("raw").isNotNull()).withColumn("_at", at.cast("timestamp"))
    one = told.groupBy("content_id").agg(F.min(F.struct("raw", "_at")).alias("_r"))
    return one.select("content_id", F.col("_r.raw").alias("raw"), F.col("_r._at").alias("answered_at"))


def with_decisions(joined: DataFrame, model: str = "external", spread_rows: bool = True) -> DataFrame:
    """Routed rows with their response (``raw``, ``answered_at``; NULL without
    one) -> review, ``review_status``, ``agent_model`` (of completed reviews),
    ``reviewed_at`` (ISO text, of rows with a response) and the final action."""
    queued = F.col("route") == F.lit("agent_review")
    j = rv.parse_reviews(joined, "raw", model, spread_rows=spread_rows)
    done = queued & (F.col("review_status") == F.lit("completed"))
    j = j.withColumns(
        {
            "review": F.when(queued, F.col("review")),
            "review_status": F.when(queued, F.col("review_status")),
            "agent_model": F.when(done, F.col("agent_model")),
            "reviewed_at": F.when(queued, F.date_format("answered_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        }
    )
    return triage.with_final_action(j.drop("raw", "answered_at"), "review")


def decision_view(decisions: DataFrame) -> DataFrame:
    """The nine-field response (severity from the scorer, not the review)."""
    return decisions.select(
        "content_id", "user_id", "risk_score", "severity", "route", "final_action",
        F.col("review").alias("agent_result"), "text_scores", "image_scores",
    )


def audit_records(decisions: DataFrame) -> DataFrame:
    return au.audit_records(decisions, "review")


def moderate(content: DataFrame, **kwargs) -> DataFrame:
    """Score and decide in one call (keyword arguments of both steps)."""
    score_keys = {"lexicon", "text_scorer", "image_scores", "users", "ensemble", "probabilities"}
    s = score_content(content, **{k: v for k, v in kwargs.items() if k in score_keys})
    return decide(s, **{k: v for k, v in kwargs.items() if k not in score_keys})
