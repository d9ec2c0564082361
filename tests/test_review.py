"""Review response forms, fallbacks and the prompt."""

from pyspark.sql import functions as F

from modspark.operators import review as rv

OBJ = '{"verdict": "remove", "confidence": 0.9, "severity": "high", "reasoning": "r", "key_factors": ["a", "b"], "recommended_action": "auto_remove", "needs_human_review": false}'


def parse(spark, raws):
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "content_id string, raw string")
    return {r.content_id: r for r in rv.parse_reviews(df).collect()}


def test_review_raw_forms(spark):
    raws = [
        OBJ,
        "```json\n" + OBJ + "\n```",
        "Sure:\n```\n" + OBJ + "\n```\nthanks",
        "  " + OBJ + "  \n",
        "[" + OBJ + "]",
        "I think this is fine.",
        None,
        '{"verdict": "flag", "recommended_action": "escalate"}',
        '{"verdict": "approve"}',
    ]
    got = parse(spark, raws)
    for i in "0123":
        assert got[i].review_status == "completed"
        assert got[i].review.recommended_action == "auto_remove"
        assert got[i].review.key_factors == ["a", "b"]
    assert got["4"].review_status == "error"
    assert got["4"].review.reasoning.startswith("Agent error: list indices")
    assert got["5"].review_status == "parse_error"
    assert got["5"].review.key_factors == ["agent_parse_error"] and got["5"].review.confidence == 0.5
    assert got["6"].review_status == "error" and got["6"].review.key_factors == ["agent_error"]
    assert got["7"].review.recommended_action == "escalate"
    assert got["8"].review_status == "completed" and got["8"].review.recommended_action is None


def test_missing_recommendation_defaults_to_flag(spark):
    from modspark.operators import triage

    got = parse(spark, ['{"verdict": "approve"}'])
    df = spark.createDataFrame([("agent_review",)], "route string")
    df = df.withColumn("review", F.lit(None).cast("struct<recommended_action:string>"))
    assert triage.with_final_action(df).first().final_action == "flag_for_review"
    assert got["0"].review.recommended_action is None


def test_prompt_sections(spark):
    from modspark.schemas import REVIEW  # noqa: F401

    df = spark.createDataFrame(
        [("1", "hello", 0.0625, None)],
        "content_id string, text string, tox double, u int",
    )
    df = df.select(
        "content_id", "text",
        F.struct(*[F.col("tox").alias(c) for c in ["toxicity", "severe_toxicity", "threat", "insult", "identity_attack", "risk_score"]]).alias("text_scores"),
        F.lit(None).cast("struct<risk_score:double,harmful_score:double,label:string>").alias("image_scores"),
        F.struct(F.lit(0.5).alias("final_risk_score"), F.lit("medium").alias("severity"), F.lit("warn_user").alias("action")).alias("risk"),
        F.lit(None).cast("struct<account_age_days:int,prev_violations:int,reports_received:int,posts_last_24h:int,is_verified:boolean>").alias("user_meta"),
        F.lit("agent_review").alias("route"),
    )
    p = rv.review_queue(df).first().prompt
    assert '**Text content:**\n"hello"\n' in p
    assert "- Toxicity: 0.063" in p  # half-up at 3 dp
    assert "**Vision Detector:**" not in p
    assert "- No user history available" in p
    assert "borderline range (0.35–0.8)" in p
