"""Query catalogue: one builder per operator of the inventory.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame of flat,
named scalar columns (so an order-insensitive value hash compares like with
like against ``plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.operators import audit as au
from modspark.operators import dashboard as db
from modspark.operators import features as fe
from modspark.operators import monitor as mo
from modspark.operators import review as rv
from modspark.operators import text_scores as ts
from modspark.operators import triage, validate
from modspark.operators import vectors as ve
from modspark.operators import windows as wi
from modspark.schemas import AUDIT, FEATURE_COLUMNS, TEXT_LABELS
from modspark.sources import bindings as B

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Builder] = {}


def query(name: str):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------------------
# Rule core
# ---------------------------------------------------------------------------


def scored_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted content with text, scored by the lexicon."""
    c = validate.with_modalities(B.content(spark, sf_dir))
    c = validate.accepted(c).filter(F.col("has_text"))
    return ts.lexicon_scores(c, B.lexicon_entries())


@query("moderation_slice")
def moderation_slice(spark, sf_dir):
    """Flagship: documents -> validate -> lexicon scores -> text risk ->
    bands -> triage -> decisions per (route, severity)."""
    s = scored_content(spark, sf_dir).withColumn("risk_score", F.col("text_risk_score"))
    d = triage.with_route(triage.with_bands(s))
    return d.groupBy("route", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("text_risk")
def text_risk(spark, sf_dir):
    s = scored_content(spark, sf_dir)
    return s.select("content_id", *TEXT_LABELS, F.col("text_risk_score").alias("risk_score"))


@query("severity_bands")
def severity_bands(spark, sf_dir):
    return B.scored_events(spark, sf_dir).select("content_id", "risk_score", "severity", "band_action")


@query("triage_routes")
def triage_routes(spark, sf_dir):
    return B.scored_events(spark, sf_dir).select("content_id", "risk_score", "route")




@query("any_label")
def any_label(spark, sf_dir):
    """P6 + A8: any-of label over the labelled corpus, and label sums."""
    c = ts.any_label(B.labelled_corpus(spark, sf_dir))
    from modspark.operators.evaluate import label_distribution

    return label_distribution(c)


@query("validate_quarantine")
def validate_quarantine(spark, sf_dir):
    c = validate.with_validation(validate.with_modalities(B.content(spark, sf_dir)))
    return c.select("content_id", "has_text", "has_image", "status", "reason")


@query("content_ids")
def content_ids(spark, sf_dir):
    c = validate.with_content_ids(B.content(spark, sf_dir))
    return c.select("content_id", "content_key", "content_short")


# ---------------------------------------------------------------------------
# Vectors
# ---------------------------------------------------------------------------


def centroid_prompts(spark, sf_dir):
    """Prompt vectors = class centroids; classes 0-4 harmful, 5-9 safe."""
    cents = ve.class_centroids(B.vectors(spark, sf_dir))
    cents = cents.withColumn("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    names, vecs = ve.collect_prompts(cents, "name", "centroid", "class_id")
    n_harmful = sum(1 for n in names if int(n.split("_")[1]) < B.HARMFUL_CLASSES)
    return names, vecs, n_harmful


def image_scores(spark, sf_dir, logit_scale: float = B.ZERO_SHOT_SCALE):
    names, vecs, n_harmful = centroid_prompts(spark, sf_dir)
    return ve.zero_shot(B.vectors(spark, sf_dir), names, vecs, n_harmful, logit_scale=logit_scale)


@query("zero_shot")
def zero_shot(spark, sf_dir):
    z = image_scores(spark, sf_dir, 1.0)
    return z.select("id", "harmful_score", "safe_score", "risk_score", "label", "confidence", "top_prompt", "top_score")


@query("zero_shot_scaled")
def zero_shot_scaled(spark, sf_dir):
    z = image_scores(spark, sf_dir, B.ZERO_SHOT_SCALE)
    return z.select("id", "harmful_score", "safe_score", "risk_score", "label", "confidence", "top_prompt", "top_score")


@query("class_centroids")
def class_centroids(spark, sf_dir):
    c = ve.class_centroids(B.vectors(spark, sf_dir))
    from modspark.functions.numeric import half_up

    return c.select("class_id", F.posexplode("centroid").alias("pos", "v")).select(
        "class_id", (F.col("pos") + 1).alias("dim"), half_up(F.col("v"), 6).alias("value")
    )


# ---------------------------------------------------------------------------
# Features and content decisions
# ---------------------------------------------------------------------------


def content_features(spark, sf_dir, content=None, with_images=True, with_users=True):
    """J1 + J2 + P8: accepted content with text scores, image scores (by
    image reference) and user metadata, and the 22 features."""
    c = content if content is not None else B.content(spark, sf_dir)
    c = validate.accepted(validate.with_modalities(c))
    c = ts.lexicon_scores(c, B.lexicon_entries())
    c = c.withColumn("text_scores", F.when(F.col("has_text"), ts.text_scores_struct()))
    c = c.drop(*TEXT_LABELS, "text_risk_score")
    if with_images:
        imgs = image_scores(spark, sf_dir).withColumn("image_ref", F.col("id").cast("string"))
        c = fe.with_image_scores(c, imgs)
    if with_users:
        c = fe.with_user_meta(c, B.users(spark, sf_dir))
    return fe.with_features(c)


@query("features_full")
def features_full(spark, sf_dir):
    return content_features(spark, sf_dir).select("content_id", *FEATURE_COLUMNS)


@query("features_defaults")
def features_defaults(spark, sf_dir):
    """Text-only items without image or user: every default branch."""
    from modspark.sources.tables import table

    b = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("content_id"),
        F.lit(None).cast("string").alias("user_id"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("text"),
        F.lit(None).cast("string").alias("image_ref"),
    )
    return content_features(spark, sf_dir, b, with_images=False, with_users=False).select(
        "content_id", *FEATURE_COLUMNS
    )


@query("cross_modal")
def cross_modal(spark, sf_dir):
    f = content_features(spark, sf_dir)
    return f.select("content_id", "text_risk_score", "image_risk_score", "user_prev_violations",
                    "both_modalities_flagged", "combined_raw_score")


def content_decisions(spark, sf_dir):
    """Content features + a rule risk (the text risk stands in for the model
    ensemble, which is checked separately) + bands + route."""
    f = content_features(spark, sf_dir).withColumn("risk_score", F.col("text_risk_score"))
    f = triage.with_route(triage.with_bands(f))
    return f.withColumn(
        "risk", F.struct(F.col("risk_score").alias("final_risk_score"), "severity", F.col("band_action").alias("action"))
    )


@query("review_prompt")
def review_prompt(spark, sf_dir):
    d = content_decisions(spark, sf_dir)
    return rv.review_queue(d)


# ---------------------------------------------------------------------------
# Review loop and audit records (events as decisions)
# ---------------------------------------------------------------------------


@query("review_parse")
def review_parse(spark, sf_dir):
    d = B.reviewed_events(spark, sf_dir).filter(F.col("route") == "agent_review")
    r = F.col("review")
    return d.select(
        "content_id",
        "review_status",
        r["verdict"].alias("verdict"),
        r["confidence"].alias("confidence"),
        r["severity"].alias("review_severity"),
        r["reasoning"].alias("reasoning"),
        F.concat_ws("|", r["key_factors"]).alias("key_factors"),
        r["recommended_action"].alias("recommended_action"),
        r["needs_human_review"].alias("needs_human_review"),
    )


@query("review_parse_free_text")
def review_parse_free_text(spark, sf_dir):
    """Assistant turns of ``conversations`` as raw responses (prose: parse errors)."""
    from modspark.sources.tables import table

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c = c.filter(F.col("role") == "assistant").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("content_id"),
        F.col("text").alias("raw"),
    )
    p = rv.parse_reviews(c)
    return p.select("content_id", "review_status", F.col("review.verdict").alias("verdict"),
                    F.col("review.recommended_action").alias("recommended_action"))


@query("final_actions")
def final_actions(spark, sf_dir):
    d = B.reviewed_events(spark, sf_dir)
    return d.select("content_id", "route", "band_action", F.coalesce("review_status", F.lit("none")).alias("review_status"),
                    "final_action")


@query("action_messages")
def action_messages(spark, sf_dir):
    d = au.with_status(B.reviewed_events(spark, sf_dir), "final_action")
    return d.select("content_id", F.col("final_action").alias("action"), "status", "message")


def _flat_audit(a):
    return a.select(
        "content_id", "user_id", "action", "risk_score", "timestamp", "content_preview", "status", "message",
        "agent_verdict", "agent_reasoning",
        F.when(F.col("agent_factors").isNotNull(), F.concat_ws("|", "agent_factors")).alias("agent_factors"),
        "human_review",
    )


@query("audit_rows")
def audit_rows(spark, sf_dir):
    return _flat_audit(B.audit_log(spark, sf_dir))


@query("audit_tail")
def audit_tail(spark, sf_dir):
    t = db.tail(B.audit_log(spark, sf_dir), 20)
    return t.select("content_id", "action", "risk_score", "timestamp")


@query("recent_window")
def recent_window(spark, sf_dir):
    r = mo.lookback(B.audit_log(spark, sf_dir), B.AS_OF, 24)
    return r.select("content_id", "action", "risk_score", "timestamp")


@query("score_stats")
def score_stats(spark, sf_dir):
    return mo.score_stats(B.audit_log(spark, sf_dir), B.AS_OF, 24)


@query("drift_overlapping")
def drift_overlapping(spark, sf_dir):
    return mo.drift_report(B.audit_log(spark, sf_dir), B.AS_OF, baseline="overlapping")


@query("drift_disjoint")
def drift_disjoint(spark, sf_dir):
    return mo.drift_report(B.audit_log(spark, sf_dir), B.AS_OF, baseline="disjoint")


@query("dashboard_summary")
def dashboard_summary(spark, sf_dir):
    return db.summary_rows(B.audit_log(spark, sf_dir), B.AS_OF, 24)


@query("timeline_long")
def timeline_long(spark, sf_dir):
    return db.timeline(B.audit_log(spark, sf_dir), B.AS_OF, 24)


@query("timeline_wide")
def timeline_wide(spark, sf_dir):
    return db.timeline_wide(B.audit_log(spark, sf_dir), B.AS_OF, 24)


@query("sliding_stats")
def sliding_stats(spark, sf_dir):
    return mo.sliding_stats(B.audit_log(spark, sf_dir), "24 hours", "6 hours")


# ---------------------------------------------------------------------------
# User windows (events as posts)
# ---------------------------------------------------------------------------


def _posts(spark, sf_dir):
    from modspark.sources.tables import table

    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return e.select(F.col("event_id").cast("string").alias("content_id"), F.col("user_id").cast("string").alias("user_id"), "ts")


@query("user_velocity")
def user_velocity(spark, sf_dir):
    v = wi.trailing_count(_posts(spark, sf_dir), "user_id", "ts", 24, 1, "posts_last_24h")
    v = wi.high_velocity(v, "posts_last_24h", B.VELOCITY_TEST_THRESHOLD)
    return v.select("content_id", "user_id", "posts_last_24h", "high_velocity")


@query("prior_violations")
def prior_violations(spark, sf_dir):
    a = B.audit_log(spark, sf_dir)
    v = wi.prior_sum(a, F.col("action").isin("auto_remove", "flag_for_review").cast("int"), "user_id", "ts", "content_id")
    return v.select("content_id", "user_id", "prev_violations",
                    (F.col("prev_violations") > F.lit(2)).cast("int").alias("repeat_offender"))


@query("account_age")
def account_age(spark, sf_dir):
    v = wi.first_seen_age(_posts(spark, sf_dir))
    return v.select("content_id", "user_id", "account_age_days")




# ---------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------


def labelled_scores(spark, sf_dir):
    """Documents with a label row, scored by the lexicon (J6 inner)."""
    from modspark.operators import evaluate as ev
    from modspark.sources.tables import table

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = ev.with_labels(d, lab, "doc_id", ["toxic"])
    return ts.lexicon_scores(j, B.lexicon_entries())


@query("auc_exact")
def auc_exact(spark, sf_dir):
    from modspark.functions.numeric import half_up
    from modspark.operators import evaluate as ev

    # text risk scores carry 4 decimals: one bucket per possible score
    a = ev.roc_auc(labelled_scores(spark, sf_dir), "toxic", "text_risk_score", decimals=4)
    return a.select(half_up(F.col("auc"), 6).alias("auc"), "n_pos", "n_neg")


@query("class_report")
def class_report(spark, sf_dir):
    """P21 (text classifier rule p > .5 on the toxicity score) + A10."""
    from modspark.operators import evaluate as ev

    s = labelled_scores(spark, sf_dir).withColumn("prediction", (F.col("toxicity") > F.lit(0.5)).cast("int"))
    return ev.class_report(s, "toxic", "prediction")


@query("hash_split")
def hash_split(spark, sf_dir):
    from modspark.operators import evaluate as ev
    from modspark.sources.tables import table

    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return ev.hash_split(lab, "doc_id", 0.2, 42).select("doc_id", "toxic", "split")


@query("strat_split_exact")
def strat_split_exact(spark, sf_dir):
    from modspark.operators import evaluate as ev
    from modspark.sources.tables import table

    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return ev.exact_split(lab, "doc_id", "toxic", 0.2, 42).select("doc_id", "toxic", "split")


@query("label_coverage")
def label_coverage(spark, sf_dir):
    from modspark.operators import evaluate as ev
    from modspark.sources.tables import table

    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    yes = ev.labelled(d, lab, "doc_id").withColumn("labelled", F.lit(True))
    no = ev.unlabelled(d, lab, "doc_id").withColumn("labelled", F.lit(False))
    return yes.unionByName(no)


# ---------------------------------------------------------------------------
# Text model
# ---------------------------------------------------------------------------


def _docs(spark, sf_dir):
    from modspark.sources.tables import table

    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("vocab_topk")
def vocab_topk(spark, sf_dir):
    from modspark.operators import text_model as tm

    v = tm.vocabulary(_docs(spark, sf_dir), tm.MAX_FEATURES)
    return v.select("term", "freq", "doc_freq")


@query("tfidf_weights")
def tfidf_weights(spark, sf_dir):
    from modspark.functions.numeric import half_up
    from modspark.operators import text_model as tm

    docs = _docs(spark, sf_dir)
    vocab, n_docs = tm.fit_tfidf(docs)
    w = tm.tfidf(docs, vocab, n_docs)
    return w.select("doc_id", "term", half_up(F.col("weight"), 6).alias("weight"))


# Fixed linear model for the join-scoring check: every lexicon word weighs
# LINEAR_COEF, intercept LINEAR_INTERCEPT.
LINEAR_COEF = 4.0
LINEAR_INTERCEPT = -1.0


@query("linear_text_score")
def linear_text_score(spark, sf_dir):
    from modspark.operators import text_model as tm

    docs = _docs(spark, sf_dir)
    vocab, n_docs = tm.fit_tfidf(docs)
    w = tm.tfidf(docs, vocab, n_docs)
    coef = spark.createDataFrame([(t, LINEAR_COEF) for t in B.LEXICON_WORDS], "term string, coef double")
    return tm.linear_score(w, coef, LINEAR_INTERCEPT, docs)


# ---------------------------------------------------------------------------
# Risk ensemble
# ---------------------------------------------------------------------------


def _risk_training(spark, sf_dir):
    from modspark.operators import risk as rk
    from modspark.sources.tables import table

    f = content_features(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("content_id"),
                                                 F.col("toxic").alias("label"))
    return rk.training_set(f, lab)


@query("risk_training_set")
def risk_training_set(spark, sf_dir):
    return _risk_training(spark, sf_dir)


@query("ensemble_average")
def ensemble_average(spark, sf_dir):
    """M7 with fixed probabilities: part A = text risk, part B = combined raw score."""
    from modspark.operators import risk as rk

    f = content_features(spark, sf_dir)
    cols = rk.ensemble_columns(F.col("text_risk_score"), F.col("combined_raw_score"))
    cols.pop("raw_risk")  # the mean before rounding
    return f.select("content_id", *[v.alias(k) for k, v in cols.items()])


# ---------------------------------------------------------------------------
# Trained models (rows-only in the driver; values in tests)
# ---------------------------------------------------------------------------

# Fitted models per (name, sf_dir) within one process, so a second query on
# the same model does not train it again.
_MODELS: dict = {}


def _text_model(spark, sf_dir):
    key = ("text", spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        from modspark.plans.training import train_text_model

        corpus = ts.any_label(B.labelled_corpus(spark, sf_dir))
        _MODELS[key] = train_text_model(corpus, "doc_id", "comment_text", "label")
    return _MODELS[key]


@query("text_model_auc")
def text_model_auc(spark, sf_dir):
    _, m, _ = _text_model(spark, sf_dir)
    return m


@query("text_model_scores")
def text_model_scores(spark, sf_dir):
    _, _, scored = _text_model(spark, sf_dir)
    return scored.select("doc_id", "label", "risk_score", "confidence", "prediction")


RISK_TREES = 200


def _risk_model(spark, sf_dir):
    key = ("risk", spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        from modspark.plans.training import train_risk_model

        _MODELS[key] = train_risk_model(_risk_training(spark, sf_dir), "content_id", RISK_TREES)
    return _MODELS[key]


@query("risk_model_scores")
def risk_model_scores(spark, sf_dir):
    _, _, scored = _risk_model(spark, sf_dir)
    return scored.select("content_id", "label", "xgb_score", "lgb_score", "final_risk_score", "severity", "action",
                         "prediction")


@query("risk_model_metrics")
def risk_model_metrics(spark, sf_dir):
    _, m, _ = _risk_model(spark, sf_dir)
    return m


@query("feature_importance")
def feature_importance(spark, sf_dir):
    from modspark.operators import risk as rk

    ens, _, _ = _risk_model(spark, sf_dir)
    return rk.feature_importance(spark, ens, 10)


def _probe(spark, sf_dir):
    key = ("probe", spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        from modspark.plans.training import train_vector_probe

        _MODELS[key] = train_vector_probe(B.vectors(spark, sf_dir), 5)
    return _MODELS[key]


@query("vector_probe")
def vector_probe(spark, sf_dir):
    """M8: training loss, test AUC, precision, recall and F1 of every round."""
    _, rounds, _, _ = _probe(spark, sf_dir)
    names = ["step", "loss", "auc", "precision", "recall", "f1"]
    ddl = "step int, " + ", ".join(f"{c} double" for c in names[1:])
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rounds], ddl)


@query("vector_scores")
def vector_scores(spark, sf_dir):
    from modspark.plans.training import vector_scores as vs

    model, _, _, _ = _probe(spark, sf_dir)
    return vs(model, B.vectors(spark, sf_dir))


# ---------------------------------------------------------------------------
# End to end and the audit round trip
# ---------------------------------------------------------------------------


def reviews(spark, sf_dir):
    """A table of raw reviewer responses: those of the queued events, keyed by
    their number, every fifth delivered twice; some contents have none, and
    most responses belong to no queued content."""
    r = B.review_responses(B.scored_events(spark, sf_dir))
    return r.unionByName(r.filter(F.col("content_id").cast("long") % 5 == 0))


def moderated(spark, sf_dir, images: bool = True, users: bool = True):
    """Documents through the whole moderation job: text, image and user
    signals -> features -> mean of two fixed probabilities -> bands -> triage
    -> join with the response table -> final action."""
    from modspark.plans import moderate as md

    imgs = image_scores(spark, sf_dir).withColumn("image_ref", F.col("id").cast("string")) if images else None
    s = md.score_content(
        B.content(spark, sf_dir), lexicon=B.lexicon_entries(), image_scores=imgs,
        users=B.users(spark, sf_dir) if users else None,
        probabilities=(F.col("text_risk_score"), F.col("combined_raw_score")),
    )
    return md.decide(s, responses=reviews(spark, sf_dir))


@query("moderation_decisions")
def moderation_decisions(spark, sf_dir):
    d = moderated(spark, sf_dir)
    return d.select("content_id", "user_id", "risk_score", "severity", "route", "final_action",
                    F.coalesce("review_status", F.lit("none")).alias("review_status"))


@query("moderation_ensemble")
def moderation_ensemble(spark, sf_dir):
    """The whole moderation job with the trained ensemble as its risk."""
    from modspark.plans import moderate as md

    ens, _, _ = _risk_model(spark, sf_dir)
    imgs = image_scores(spark, sf_dir).withColumn("image_ref", F.col("id").cast("string"))
    s = md.score_content(
        B.content(spark, sf_dir), lexicon=B.lexicon_entries(), image_scores=imgs, users=B.users(spark, sf_dir), ensemble=ens
    )
    d = md.decide(s, responses=reviews(spark, sf_dir))
    return d.select("content_id", "user_id", "risk_score", "severity", "route", "final_action",
                    F.coalesce("review_status", F.lit("none")).alias("review_status"))


@query("decision_view")
def decision_view(spark, sf_dir):
    """The nine-field decision, its three structs by one field each."""
    from modspark.plans import moderate as md

    v = md.decision_view(moderated(spark, sf_dir))
    return v.select(
        "content_id", "user_id", "risk_score", "severity", "route", "final_action",
        F.col("agent_result.verdict").alias("agent_verdict"), F.col("text_scores.risk_score").alias("text_risk"),
        F.col("image_scores.risk_score").alias("image_risk"),
    )


@query("moderation_audit")
def moderation_audit(spark, sf_dir):
    from modspark.plans import moderate as md

    return _flat_audit(md.audit_records(moderated(spark, sf_dir)))


@query("audit_roundtrip")
def audit_roundtrip(spark, sf_dir):
    """S6 then S2: the audit log written as date-partitioned JSON lines to
    the shared folder, read back leniently, last 24 hours."""
    import uuid

    from modspark.session import scratch_path
    from modspark.sources.readers import read_audit
    from modspark.sources.sinks import write_audit

    path = scratch_path(spark, f"audit-{uuid.uuid4().hex[:8]}")
    write_audit(B.audit_log(spark, sf_dir), path, "json")
    r = read_audit(spark, path, B.AS_OF, 24)
    return r.select("content_id", "action", "risk_score", "timestamp")


@query("late_reviews")
def late_reviews(spark, sf_dir):
    """J3 with answers that came late (batch form of the streamed join): of
    the queued events two in twelve are answered after the two hours that
    count; P19 fields of the others."""
    from modspark.plans.moderate import decide
    from modspark.streaming.late_reviews import in_time

    d = B.scored_events(spark, sf_dir)
    n = F.col("content_id").cast("long")
    minutes = F.when(n % 6 == 2, 180).otherwise(n % 50)
    at = d.select("content_id", (F.col("ts") + F.make_dt_interval(mins=minutes)).cast("timestamp").alias("answered_at"))
    told = B.review_responses(d).join(at, "content_id")
    out = decide(d, responses=in_time(d, told), model="m1")
    return out.select("content_id", F.coalesce("review_status", F.lit("none")).alias("review_status"), "agent_model", "reviewed_at", "final_action")


@query("stream_velocity")
def stream_velocity(spark, sf_dir):
    """Events as a stream, exact trailing counts of the posts whose hour
    the watermark has passed."""
    import uuid

    from modspark.session import scratch_path
    from modspark.sources.tables import table_stream
    from modspark.streaming import velocity
    from modspark.streaming.state import state_settings

    folder = scratch_path(spark, f"velocity-{uuid.uuid4().hex[:8]}")
    e = table_stream(spark, sf_dir, "events").select(F.col("event_id").alias("content_id"), "user_id", "ts")
    with state_settings(spark):
        counts = velocity.trailing_count(e)
        q = counts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        q = q.outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(counts.schema).parquet(f"{folder}/out")
    return out.select("content_id", "user_id", "posts_last_24h")


@query("score_stats_unrounded")
def score_stats_unrounded(spark, sf_dir):
    """A1-A3 of scores of any precision: exact percentiles by selection."""
    raw = B.audit_log(spark, sf_dir).join(_raw_risk(spark, sf_dir), "content_id").withColumn("risk_score", F.col("raw_risk"))
    return mo.score_stats(raw, B.AS_OF, 24 * 365, decimals=None)


def _raw_risk(spark, sf_dir):
    from modspark.sources.tables import table

    e = table(spark, sf_dir, "events").select("event_id", "value")
    return e.select(F.col("event_id").cast("string").alias("content_id"), F.least(F.col("value") / F.lit(B.RISK_DIVISOR), F.lit(1.0)).alias("raw_risk"))


@query("text_risk_phrases")
def text_risk_phrases(spark, sf_dir):
    """M4 with phrases and terms in any case."""
    c = validate.accepted(validate.with_modalities(B.content(spark, sf_dir))).filter(F.col("has_text"))
    return ts.lexicon_scores(c, B.PHRASE_LEXICON).select("content_id", "toxicity", "insult", "threat", F.col("text_risk_score").alias("risk_score"))


@query("user_meta_json")
def user_meta_json(spark, sf_dir):
    """Metadata that came as JSON text; broken text is quarantined."""
    n = F.col("content_id").cast("long")
    meta = F.when(n % 7 == 0, F.lit("{broken")).when(n % 7 == 1, F.lit("[]")).when(n % 7 == 2, F.lit("{}")).when(
        n % 7 < 6, F.format_string('{"account_age_days": %d, "prev_violations": %d}', n % 90, n % 4)
    )
    c = validate.with_validation(validate.with_modalities(B.content(spark, sf_dir).withColumn("user_meta", meta)))
    f = fe.with_features(fe.with_user_meta(c, B.users(spark, sf_dir)))
    return f.select("content_id", "status", "reason", "user_account_age_days", "user_prev_violations")


@query("audit_tail_log")
def audit_tail_log(spark, sf_dir):
    """S3 in the order of a written log: records of one day have the same time
    and are appended in three steps, so only their place in the log tells.  A
    step's records of a day are one file, in order; its days are dealt over tasks."""
    import uuid

    from modspark.session import scratch_path
    from modspark.sources.readers import tail_audit
    from modspark.sources.sinks import write_audit

    path = scratch_path(spark, f"tail-{uuid.uuid4().hex[:8]}")
    log = B.audit_log(spark, sf_dir).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'00:00:00.000000"))
    n = F.col("content_id").cast("long")
    for k in range(3):
        step = log.filter(n % 3 == k).repartition("timestamp").sortWithinPartitions("timestamp", n.desc())
        write_audit(step, path, batch_id=f"step-{k}", in_order=True)
    return tail_audit(spark, path, 40).select("content_id", "action", "risk_score", "timestamp")


def _partials(spark, sf_dir):
    """The partials of the audit log, written in three batches, one of them
    twice, and folded."""
    import uuid

    from modspark.operators.partials import Partials
    from modspark.session import scratch_path

    parts = Partials(spark, scratch_path(spark, f"partials-{uuid.uuid4().hex[:8]}"))
    log = B.audit_log(spark, sf_dir)
    for k in (0, 1, 1, 2):
        parts.update(log.filter(F.col("content_id").cast("long") % 3 == k), f"b{k}")
    parts.compact()
    return parts


@query("score_stats_partials")
def score_stats_partials(spark, sf_dir):
    """A1-A3 from hourly partials."""
    from modspark.operators import partials as pt

    return pt.score_stats(_partials(spark, sf_dir), B.AS_OF, 24)


@query("drift_partials")
def drift_partials(spark, sf_dir):
    """A4-A5 from hourly partials."""
    from modspark.operators import partials as pt

    return pt.drift_report(_partials(spark, sf_dir), B.AS_OF, baseline="disjoint")


@query("dashboard_partials")
def dashboard_partials(spark, sf_dir):
    """A6 from hourly partials."""
    from modspark.operators import partials as pt

    return pt.summary_rows(_partials(spark, sf_dir), B.AS_OF, 24)


@query("timeline_partials")
def timeline_partials(spark, sf_dir):
    """A7 from hourly partials."""
    from modspark.operators import partials as pt

    return pt.timeline(_partials(spark, sf_dir), B.AS_OF, 24)


@query("audit_published")
def audit_published(spark, sf_dir):
    """S6 with published batches: the log is written in two batches, one of
    them twice, and an attempt is left unpublished, as by a job that died;
    the batches are folded into one and written again, to no effect."""
    import uuid

    from modspark.session import scratch_path
    from modspark.sources.published import Published
    from modspark.sources.readers import read_audit
    from modspark.sources.sinks import write_audit

    path = scratch_path(spark, f"published-{uuid.uuid4().hex[:8]}")
    log = B.audit_log(spark, sf_dir)
    odd = F.col("content_id").cast("long") % 2 == 1
    write_audit(log.filter(odd), path, "json", "odd")
    table = Published(spark, path)
    table.stage(log.drop("ts"), "even")  # never published
    write_audit(log.filter(~odd), path, "json", "even")
    write_audit(log.filter(odd), path, "json", "odd")
    table.compact(AUDIT, "json", ["dt"])
    write_audit(log.filter(odd), path, "json", "odd")
    r = read_audit(spark, path)
    return r.select("content_id", "action", "risk_score", "timestamp")


# ---------------------------------------------------------------------------
# Rows that are easily lost: missing keys and labels, unlisted actions, own
# metadata, repeated ids
# ---------------------------------------------------------------------------


def _some_null(df, col="user_id"):
    return df.withColumn(col, F.when(F.col(col).cast("long") % 7 != 0, F.col(col)))


@query("velocity_null_users")
def velocity_null_users(spark, sf_dir):
    v = wi.trailing_count(_some_null(_posts(spark, sf_dir)), "user_id", "ts", 24, 1, "posts_last_24h")
    return v.select("content_id", "user_id", "posts_last_24h")


@query("prior_violations_null_users")
def prior_violations_null_users(spark, sf_dir):
    a = _some_null(B.audit_log(spark, sf_dir))
    v = wi.prior_sum(a, F.col("action").isin("auto_remove", "flag_for_review").cast("int"), "user_id", "ts", "content_id")
    return v.select("content_id", "user_id", "prev_violations")


@query("account_age_null_users")
def account_age_null_users(spark, sf_dir):
    v = wi.first_seen_age(_some_null(_posts(spark, sf_dir)))
    return v.select("content_id", "user_id", "account_age_days")


@query("split_null_labels")
def split_null_labels(spark, sf_dir):
    from modspark.operators import evaluate as ev
    from modspark.sources.tables import table

    lab = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("toxic"))
    return ev.exact_split(lab, "doc_id", "toxic", 0.2, 42).select("doc_id", "toxic", "split")


@query("timeline_unlisted")
def timeline_unlisted(spark, sf_dir):
    """A7 wide with actions outside the list (a reviewer's own) and without one."""
    kind = F.regexp_extract("content_preview", r"^(\w+)", 1)
    action = F.when(kind == "error", F.lit("escalate")).when(kind != "signup", F.col("action"))
    return db.timeline_wide(B.audit_log(spark, sf_dir).withColumn("action", action), B.AS_OF, 24)


@query("own_user_meta")
def own_user_meta(spark, sf_dir):
    """J2 with metadata that came with some of the contents, some fields only."""
    n = F.col("content_id").cast("long")
    own = F.when(
        n % 3 == 0,
        F.struct(
            (n % 90).cast("int").alias("account_age_days"),
            F.when(n % 2 == 0, F.lit(5)).alias("prev_violations"),
            F.lit(None).cast("int").alias("reports_received"),
            F.lit(None).cast("int").alias("posts_last_24h"),
            F.lit(None).cast("boolean").alias("is_verified"),
        ),
    )
    c = fe.with_user_meta(B.content(spark, sf_dir).withColumn("user_meta", own), B.users(spark, sf_dir))
    return fe.with_features(c).select("content_id", "user_account_age_days", "user_prev_violations", "user_posts_last_24h")


@query("text_risk_repeated_ids")
def text_risk_repeated_ids(spark, sf_dir):
    """Scores do not depend on ids: repeated and missing ones, and a lexicon table."""
    c = validate.accepted(validate.with_modalities(B.content(spark, sf_dir))).filter(F.col("has_text"))
    n = F.col("content_id").cast("long")
    c = c.withColumn("content_id", F.when(n % 4 != 0, (n % 10).cast("string")))
    return ts.lexicon_scores(c, B.lexicon(spark)).select("content_id", F.col("text_risk_score").alias("risk_score"))


def queries() -> dict[str, Builder]:
    return dict(REGISTRY)
