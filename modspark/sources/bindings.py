"""Bindings of the driver tables to the moderation entities.

These are test- and benchmark-side choices (deterministic, documented in the
README); engine functions only ever see entities.  Every binding is a Spark
projection of the given tables, so its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.functions.numeric import r4
from modspark.operators import triage
from modspark.operators.text_scores import lexicon_frame
from modspark.sources.tables import table

# Fixed binding values.
BASE_EPOCH_S = 1704067200      # 2024-01-01 00:00:00 UTC
CONTENT_STEP_S = 97            # content i is posted at base + 97 s * i
N_USERS = 150                  # content i belongs to user i % 150
AS_OF = "2024-01-31 00:00:00"  # analysis time of the audit / user snapshot
RISK_DIVISOR = 125.0           # audit risk = least(r4(value / 125), 1)
HARMFUL_CLASSES = 5            # embedding classes 0-4 are "harmful" prototypes
ZERO_SHOT_SCALE = 10.0         # logit scale of the scaled zero-shot form (1.0 = faithful)
VELOCITY_TEST_THRESHOLD = 5    # events peak at ~11 per user-day, so test the flag at 5

# Lexicon (term, category, weight): ten words the toxic documents carry.
LEXICON_WORDS = ["trash", "clown", "scum", "idiot", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting"]
LEXICON_WEIGHT = 0.6
LEXICON_CATEGORIES = {
    "toxicity": LEXICON_WORDS,
    "insult": LEXICON_WORDS,
    "severe_toxicity": ["trash", "scum", "worthless"],
    "obscene": ["disgusting", "clown"],
    "threat": ["loser", "moron", "pathetic"],
    "identity_attack": ["idiot", "stupid"],
}


# Phrases and terms in mixed case, some of them one another's parts.
PHRASE_LEXICON = [
    ("The And", "toxicity", 0.05), ("the  of", "toxicity", 0.02), ("DER", "insult", 0.01), ("de la", "threat", 0.02),
    ("orre ORRE orre", "threat", 0.03), ("Idiot", "insult", 0.2),
]


def lexicon_entries() -> list[tuple[str, str, float]]:
    return [(w, cat, LEXICON_WEIGHT) for cat, words in LEXICON_CATEGORIES.items() for w in words]


def lexicon(spark: SparkSession) -> DataFrame:
    return lexicon_frame(spark, lexicon_entries())


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as content: id, user, post time, text, and an image
    reference on even ids (the image may or may not have a vector)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return d.select(
        F.col("doc_id").cast("string").alias("content_id"),
        (F.col("doc_id") % N_USERS).cast("string").alias("user_id"),
        F.timestamp_seconds(F.lit(BASE_EPOCH_S) + F.col("doc_id") * CONTENT_STEP_S).alias("ts"),
        F.col("text"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("image_ref"),
        F.col("lang"),
    )


def as_of_literal(col_type: str = "timestamp_ntz", as_of: str = AS_OF):
    return F.lit(as_of).cast(col_type)


def users(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """User metadata from ``events`` (one row per user, partial aggregation):
    age = days from the first event to ``as_of``; violations = error events;
    reports = signup events; verified = any purchase; posts in the 24 h
    before ``as_of``."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    t_end = as_of_literal("timestamp_ntz", as_of)
    t_start = t_end - F.expr("INTERVAL 24 HOURS")
    agg = e.groupBy("user_id").agg(
        F.min("ts").alias("first_ts"),
        F.count_if(F.col("event_type") == "error").alias("prev_violations"),
        F.count_if(F.col("event_type") == "signup").alias("reports_received"),
        F.count_if((F.col("ts") >= t_start) & (F.col("ts") <= t_end)).alias("posts_last_24h"),
        F.bool_or(F.col("event_type") == "purchase").alias("is_verified"),
    )
    return agg.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.datediff(F.to_date(t_end), F.to_date("first_ts")).cast("int").alias("account_age_days"),
        F.col("prev_violations").cast("int"),
        F.col("reports_received").cast("int"),
        F.col("posts_last_24h").cast("int"),
        F.col("is_verified"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as scored decisions: risk = least(r4(value/125), 1), bands,
    route; ``text`` is the event type and its properties."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    d = e.select(
        F.col("event_id"),
        F.col("event_id").cast("string").alias("content_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts"),
        F.col("event_type"),
        F.concat_ws(" ", F.col("event_type"), F.col("props")).alias("text"),
        F.least(r4(F.col("value") / F.lit(RISK_DIVISOR)), F.lit(1.0)).alias("risk_score"),
    )
    return triage.with_route(triage.with_bands(d))


_VERDICT = {"auto_remove": "remove", "flag_for_review": "flag", "warn_user": "flag", "approved": "approve"}
RESPONSE_JSON = (
    '{"verdict": "%s", "confidence": %.4f, "severity": "%s", "reasoning": "Risk %.4f for %s", '
    '"key_factors": ["%s", "risk_%s"], "recommended_action": "%s", "needs_human_review": %s}'
)


def review_responses(decisions: DataFrame) -> DataFrame:
    """Raw reviewer text for queued rows, wrapped by ``event_id % 8``:
    json fence, plain fence, bare, broken text, json fence, plain fence,
    JSON array, bare.  Ids ending in 9 get no response at all."""
    return decisions.filter(_has_response()).select("content_id", response_text().alias("raw"))


def _has_response() -> Column:
    return (F.col("route") == "agent_review") & (F.col("event_id") % 10 != 9)


def response_text() -> Column:
    """The generated reviewer text of one scored event (see ``review_responses``)."""
    verdict = None
    for k, v in _VERDICT.items():
        verdict = (F.when if verdict is None else verdict.when)(F.col("band_action") == k, F.lit(v))
    body = F.format_string(
        RESPONSE_JSON,
        verdict,
        F.col("risk_score"),
        F.col("severity"),
        F.col("risk_score"),
        F.col("event_type"),
        F.col("event_type"),
        F.col("severity"),
        F.col("band_action"),
        F.when(F.col("risk_score") >= 0.6, F.lit("true")).otherwise(F.lit("false")),
    )
    k = F.col("event_id") % 8
    raw = (
        F.when(k.isin(0, 4), F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k.isin(1, 5), F.concat(F.lit("Here is my decision:\n```\n"), body, F.lit("\n```")))
        .when(k == 3, F.concat(F.lit("I would "), verdict, F.lit(" this content.")))
        .when(k == 6, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(F.concat(F.lit("  "), body, F.lit("\n")))
    )
    return raw


def reviewed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events with the parsed review (agent_review rows) and the final action."""
    from modspark.operators import review as rv

    d = scored_events(spark, sf_dir)
    # The response of a row is a function of the row itself, so the reviews
    # are parsed in the same pass (no self-join): a predicate on the result
    # (e.g. a lookback on ts) reaches the one scan, and only surviving rows
    # are parsed.  Queued rows without a response take the error fallback;
    # rows that were not queued carry no review.
    queued = F.col("route") == "agent_review"
    d = d.withColumn("raw", F.when(_has_response(), response_text()))
    d = rv.parse_reviews(d, "raw").drop("raw", "agent_model")
    d = d.withColumn("review", F.when(queued, F.col("review"))).withColumn(
        "review_status", F.when(queued, F.col("review_status"))
    )
    return triage.with_final_action(d, "review")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log of the scored events (12 record columns + ``ts``)."""
    from modspark.operators.audit import audit_records

    return audit_records(reviewed_events(spark, sf_dir), "review")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as labelled image vectors: classes 0-4 are 'nsfw'."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding"),
        F.when(F.col("label") < HARMFUL_CLASSES, F.lit("nsfw")).otherwise(F.lit("sfw")).alias("label"),
        F.col("label").alias("class_id"),
    )


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled text corpus: ``documents`` with a row in ``labels`` (inner
    join); ``toxic`` from the label table, the other five labels = the
    lexicon category fired."""
    from modspark.operators.text_scores import lexicon_scores

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = d.join(lab, "doc_id")
    s = lexicon_scores(j, lexicon_entries())
    return s.select(
        F.col("doc_id"),
        F.col("text").alias("comment_text"),
        F.col("toxic").cast("int").alias("toxic"),
        (F.col("severe_toxicity") > 0).cast("int").alias("severe_toxic"),
        (F.col("obscene") > 0).cast("int").alias("obscene"),
        (F.col("threat") > 0).cast("int").alias("threat"),
        (F.col("insult") > 0).cast("int").alias("insult"),
        (F.col("identity_attack") > 0).cast("int").alias("identity_hate"),
    )
