"""Entity schemas and the fixed values results depend on.

Schemas are declared once here; readers never infer them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced; keep as plain text)
# ---------------------------------------------------------------------------

# Text label names, in scorer order, and the weight of each in the text risk.
TEXT_LABELS = ["toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack"]
TEXT_RISK_WEIGHTS = {
    "toxicity": 0.4,
    "severe_toxicity": 0.2,
    "obscene": 0.1,
    "threat": 0.15,
    "insult": 0.1,
    "identity_attack": 0.05,
}
# Labels of the labelled text corpus (note identity_hate, not identity_attack).
CORPUS_LABELS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]

# Severity bands of the ensemble risk (inclusive lower bounds), high to low.
BANDS = [
    (0.8, "critical", "auto_remove"),
    (0.6, "high", "flag_for_review"),
    (0.4, "medium", "warn_user"),
]
BAND_FLOOR = ("low", "approved")

# Triage thresholds: >= remove -> auto_remove, <= approve -> auto_approve.
TRIAGE_AUTO_REMOVE = 0.8
TRIAGE_AUTO_APPROVE = 0.35

# Action -> (status, message); anything else is unknown.
ACTION_STATUS = {
    "auto_remove": ("removed", "Content automatically removed — high risk score"),
    "flag_for_review": ("flagged", "Content flagged — queued for human review"),
    "warn_user": ("warned", "User warned — content kept with warning label"),
    "approved": ("approved", "Content approved — passed moderation"),
}
UNKNOWN_STATUS = "unknown"
UNKNOWN_MESSAGE_PREFIX = "Unknown action: "
ACTIONS = ["auto_remove", "flag_for_review", "warn_user", "approved"]

# Review fallbacks.
PARSE_ERROR_REVIEW = {
    "verdict": "flag",
    "confidence": 0.5,
    "severity": "medium",
    "reasoning": "Agent returned malformed response. Flagging for human review as a precaution.",
    "key_factors": ["agent_parse_error"],
    "recommended_action": "flag_for_review",
    "needs_human_review": True,
    "review_status": "parse_error",
}
ERROR_REVIEW = {
    "verdict": "flag",
    "confidence": 0.0,
    "severity": "unknown",
    "reasoning_prefix": "Agent error: ",
    "key_factors": ["agent_error"],
    "recommended_action": "flag_for_review",
    "needs_human_review": True,
    "review_status": "error",
}
DEFAULT_REVIEW_ACTION = "flag_for_review"

# Feature defaults when a modality or a field is absent.
USER_DEFAULTS = {
    "account_age_days": 365,
    "prev_violations": 0,
    "reports_received": 0,
    "posts_last_24h": 1,
    "is_verified": False,
}
TEXT_HIGH = 0.7          # text_any_high: any of tox / severe / threat above
HIGH_VELOCITY = 50       # posts_last_24h above
REPEAT_OFFENDER = 2      # prev_violations above
BOTH_FLAGGED = 0.5       # text and image risk both above
VIOLATION_WEIGHT = 0.05  # combined_raw_score: per previous violation ...
VIOLATION_CAP = 0.2      # ... capped here
COMBINED_TEXT_W = 0.5
COMBINED_IMAGE_W = 0.3

# Monitoring.
DRIFT_THRESHOLD = 0.15
RECENT_HOURS = 24
PREVIOUS_HOURS = 48

# Zero-shot image head.
ZERO_SHOT_GUARD_STD = 0.015
ZERO_SHOT_HARMFUL = 0.4
LOW_CONFIDENCE_LABEL = "low — defaulted to safe"
LOW_CONFIDENCE_NOTE = "Model was uncertain. Likely a chart, diagram, or uncommon image type."

# Binary thresholds of the trained classifiers (strict).
TEXT_CLASSIFIER_THRESHOLD = 0.5
ENSEMBLE_THRESHOLD = 0.5

# The 22 feature columns in their frozen training order.
FEATURE_COLUMNS = [
    "text_toxicity",
    "text_severe_toxicity",
    "text_obscene",
    "text_threat",
    "text_insult",
    "text_identity_attack",
    "text_risk_score",
    "text_max_score",
    "text_any_high",
    "image_risk_score",
    "image_harmful_score",
    "image_safe_score",
    "image_is_harmful",
    "user_account_age_days",
    "user_prev_violations",
    "user_reports_received",
    "user_posts_last_24h",
    "user_is_verified",
    "user_high_velocity",
    "user_repeat_offender",
    "both_modalities_flagged",
    "combined_raw_score",
]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

USER_META = T.StructType(
    [
        T.StructField("account_age_days", T.IntegerType()),
        T.StructField("prev_violations", T.IntegerType()),
        T.StructField("reports_received", T.IntegerType()),
        T.StructField("posts_last_24h", T.IntegerType()),
        T.StructField("is_verified", T.BooleanType()),
    ]
)

CONTENT = T.StructType(
    [
        T.StructField("content_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("text", T.StringType()),
        T.StructField("image_ref", T.StringType()),
        T.StructField("user_meta", USER_META),
    ]
)

TEXT_SCORES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in TEXT_LABELS + ["risk_score"]]
)

IMAGE_SCORES = T.StructType(
    [
        T.StructField("harmful_score", T.DoubleType()),
        T.StructField("safe_score", T.DoubleType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("prompt_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)

REVIEW = T.StructType(
    [
        T.StructField("verdict", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("key_factors", T.ArrayType(T.StringType())),
        T.StructField("recommended_action", T.StringType()),
        T.StructField("needs_human_review", T.BooleanType()),
    ]
)

# One audit record per decision (the JSON-lines contract).
AUDIT = T.StructType(
    [
        T.StructField("content_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("content_preview", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("agent_verdict", T.StringType()),
        T.StructField("agent_reasoning", T.StringType()),
        T.StructField("agent_factors", T.ArrayType(T.StringType())),
        T.StructField("human_review", T.BooleanType()),
    ]
)

LABELLED_CORPUS = T.StructType(
    [T.StructField("comment_text", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in CORPUS_LABELS]
)

VECTORS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
