"""Borderline-review loop: prompt rendering, response clean-up and parsing,
fallbacks, and the join of responses back to the queue.

Only rows routed to ``agent_review`` are queued (the cheap triage filter runs
before any reviewer call).  Responses arrive as raw text from a review
plug-in (``operators.plugins.review_responses``) or from a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspark.functions.numeric import half_up
from modspark.functions.text import WHITESPACE
from modspark.schemas import ERROR_REVIEW, PARSE_ERROR_REVIEW, REVIEW, TRIAGE_AUTO_APPROVE, TRIAGE_AUTO_REMOVE

# Python's messages when a valid JSON value is not an object.
NON_OBJECT_ERRORS = {
    "ARRAY": "list indices must be integers or slices, not str",
    "STRING": "'str' object does not support item assignment",
    "NUMBER": "'int' object does not support item assignment",
    "BOOLEAN": "'bool' object does not support item assignment",
    "NULL": "'NoneType' object does not support item assignment",
}
NO_RESPONSE_ERROR = "no response"


def _f3(x: Column) -> Column:
    """``.3f`` of a score, half-up at 3 decimals first so formatting never
    meets an exact binary tie."""
    return F.format_string("%.3f", half_up(F.coalesce(x, F.lit(0.0)).cast("double"), 3))


def review_prompt(
    text: str = "text",
    image_description: str | None = None,
    text_scores: str | None = "text_scores",
    image_scores: str | None = "image_scores",
    risk: str | None = "risk",
    user_meta: str | None = "user_meta",
    low: float = TRIAGE_AUTO_APPROVE,
    high: float = TRIAGE_AUTO_REMOVE,
) -> Column:
    """The review prompt of one row.  Sections whose input is NULL drop
    out of ``concat_ws``; the task text prints the actual triage range."""
    t = F.col(text)
    parts: list[Column] = [F.lit("## Content Under Review\n")]
    parts.append(F.when(t.isNotNull() & (t != ""), F.concat(F.lit('**Text content:**\n"'), t, F.lit('"\n'))))
    if image_description:
        d = F.col(image_description)
        parts.append(F.when(d.isNotNull() & (d != ""), F.concat(F.lit("**Image description:** "), d, F.lit("\n"))))
    parts.append(F.lit("\n## Detector Scores\n"))
    if text_scores:
        ts = F.col(text_scores)
        block = F.concat_ws(
            "\n",
            F.lit("**NLP Detector:**"),
            F.concat(F.lit("- Toxicity: "), _f3(ts["toxicity"])),
            F.concat(F.lit("- Severe toxicity: "), _f3(ts["severe_toxicity"])),
            F.concat(F.lit("- Threat: "), _f3(ts["threat"])),
            F.concat(F.lit("- Insult: "), _f3(ts["insult"])),
            F.concat(F.lit("- Identity attack: "), _f3(ts["identity_attack"])),
            F.concat(F.lit("- Overall text risk: "), _f3(ts["risk_score"]), F.lit("\n")),
        )
        parts.append(F.when(ts.isNotNull(), block))
    if image_scores:
        im = F.col(image_scores)
        block = F.concat_ws(
            "\n",
            F.lit("**Vision Detector:**"),
            F.concat(F.lit("- Image risk score: "), _f3(im["risk_score"])),
            F.concat(F.lit("- Harmful score: "), _f3(im["harmful_score"])),
            F.concat(F.lit("- Label: "), F.coalesce(im["label"], F.lit("unknown")), F.lit("\n")),
        )
        parts.append(F.when(im.isNotNull(), block))
    if risk:
        rk = F.col(risk)
        block = F.concat_ws(
            "\n",
            F.lit("**Risk Scorer (ensemble):**"),
            F.concat(F.lit("- Final risk score: "), _f3(rk["final_risk_score"])),
            F.concat(F.lit("- Severity: "), F.coalesce(rk["severity"], F.lit("unknown"))),
            F.concat(F.lit("- Initial action: "), F.coalesce(rk["action"], F.lit("unknown")), F.lit("\n")),
        )
        parts.append(F.when(rk.isNotNull(), block))
    parts.append(F.lit("\n## User History\n"))
    if user_meta:
        um = F.col(user_meta)
        block = F.concat_ws(
            "\n",
            F.concat(F.lit("- Account age: "), F.coalesce(um["account_age_days"].cast("string"), F.lit("unknown")), F.lit(" days")),
            F.concat(F.lit("- Previous violations: "), F.coalesce(um["prev_violations"], F.lit(0)).cast("string")),
            F.concat(F.lit("- Reports received: "), F.coalesce(um["reports_received"], F.lit(0)).cast("string")),
            F.concat(F.lit("- Posts in last 24h: "), F.coalesce(um["posts_last_24h"], F.lit(0)).cast("string")),
            F.concat(
                F.lit("- Verified account: "),
                F.when(F.coalesce(um["is_verified"], F.lit(False)), F.lit("True")).otherwise(F.lit("False")),
            ),
        )
        parts.append(F.when(um.isNotNull(), block).otherwise(F.lit("- No user history available")))
    else:
        parts.append(F.lit("- No user history available"))
    parts.append(
        F.lit(
            "\n## Your Task\n"
            f"This content scored in the borderline range ({low}–{high}). "
            "The automated system was not confident enough to act automatically. "
            "Review all signals above and make the final moderation decision. "
            "Respond ONLY with the JSON format specified."
        )
    )
    return F.concat_ws("\n", *parts)


def review_queue(decisions: DataFrame, id_col: str = "content_id", **prompt_args) -> DataFrame:
    """``(content_id, prompt)`` for rows routed to ``agent_review`` only."""
    return decisions.filter(F.col("route") == "agent_review").select(
        F.col(id_col).alias("content_id"), review_prompt(**prompt_args).alias("prompt")
    )


def clean_response(raw: Column) -> Column:
    """Prefer a json fence, else a plain fence, else the raw text; strip."""
    after_json = F.element_at(F.split(raw, "```json", 2), 2)
    after_fence = F.element_at(F.split(raw, "```", 2), 2)
    body = (
        F.when(F.instr(raw, "```json") > 0, F.substring_index(after_json, "```", 1))
        .when(F.instr(raw, "```") > 0, F.substring_index(after_fence, "```", 1))
        .otherwise(raw)
    )
    return F.trim(body, F.lit(WHITESPACE))


def _json_kind(clean: Column) -> Column:
    """OBJECT / ARRAY / STRING / NUMBER / BOOLEAN / NULL, or NULL when the
    (stripped) text is not JSON.  One parse for validity; for valid JSON the
    first character tells the kind, so no schema of the value is computed."""
    first = F.substring(clean, 1, 1)
    valid = (clean == F.lit("null")) | F.try_parse_json(clean).isNotNull()
    return F.when(
        valid,
        F.when(first == "{", F.lit("OBJECT"))
        .when(first == "[", F.lit("ARRAY"))
        .when(first == '"', F.lit("STRING"))
        .when(clean.isin("true", "false"), F.lit("BOOLEAN"))
        .when(clean == "null", F.lit("NULL"))
        .otherwise(F.lit("NUMBER")),
    )


def parse_reviews(
    responses: DataFrame, raw_col: str = "raw", model: str = "external", spread_rows: bool = True
) -> DataFrame:
    """``review`` struct + ``review_status`` for every response row.

    completed: the cleaned text is a JSON object; parse_error: not JSON;
    error: valid JSON that is not an object, or no response (NULL raw).
    ``spread_rows=False`` keeps the input partitioning (nothing to parse,
    e.g. a constant NULL response that the optimizer folds away).
    """
    raw = F.col(raw_col)
    clean = clean_response(raw)
    kind = F.col("_kind")
    pe, er = PARSE_ERROR_REVIEW, ERROR_REVIEW

    def const(d: dict, reasoning: Column) -> Column:
        return F.struct(
            F.lit(d["verdict"]).alias("verdict"),
            F.lit(float(d["confidence"])).alias("confidence"),
            F.lit(d["severity"]).alias("severity"),
            reasoning.alias("reasoning"),
            F.array(*[F.lit(x) for x in d["key_factors"]]).alias("key_factors"),
            F.lit(d["recommended_action"]).alias("recommended_action"),
            F.lit(d["needs_human_review"]).alias("needs_human_review"),
        )

    err_msg = F.concat(
        F.lit(er["reasoning_prefix"]),
        F.coalesce(
            F.element_at(F.create_map(*[x for k, v in NON_OBJECT_ERRORS.items() for x in (F.lit(k), F.lit(v))]), kind),
            F.lit(NO_RESPONSE_ERROR),
        ),
    )
    review = (
        F.when(kind == "OBJECT", F.col("_parsed"))
        .when(raw.isNotNull() & kind.isNull(), const(pe, F.lit(pe["reasoning"])))
        .otherwise(const(er, err_msg))
    )
    status = (
        F.when(kind == "OBJECT", F.lit("completed"))
        .when(raw.isNotNull() & kind.isNull(), F.lit(pe["review_status"]))
        .otherwise(F.lit(er["review_status"]))
    )
    from modspark.operators.partitioning import spread

    return (
        (spread(responses) if spread_rows else responses).withColumn("_clean", clean)
        .withColumn("_kind", F.when(raw.isNotNull(), _json_kind(F.col("_clean"))))
        .withColumn("_parsed", F.from_json(F.col("_clean"), REVIEW))
        .withColumn("review", review)
        .withColumn("review_status", status)
        .withColumn("agent_model", F.lit(model))
        .drop("_clean", "_kind", "_parsed")
    )


def with_reviews(queue: DataFrame, responses: DataFrame, model: str = "external") -> DataFrame:
    """Queue LEFT JOIN responses on ``content_id``; a queued row without a
    response takes the error fallback."""
    joined = queue.join(responses.select("content_id", "raw"), "content_id", "left")
    return parse_reviews(joined, "raw", model)
