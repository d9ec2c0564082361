"""Bands, triage, final action, status/message and the 22 features."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modspark.operators import audit as au
from modspark.operators import features as fe
from modspark.operators import text_scores as ts
from modspark.operators import triage
from modspark.schemas import FEATURE_COLUMNS

RISKS = [0.0, 0.35, 0.3501, 0.3999, 0.4, 0.5999, 0.6, 0.7999, 0.8, 1.0]
# hand-computed expectations
EXPECTED = {
    0.0: ("low", "approved", "auto_approve"),
    0.35: ("low", "approved", "auto_approve"),
    0.3501: ("low", "approved", "agent_review"),
    0.3999: ("low", "approved", "agent_review"),
    0.4: ("medium", "warn_user", "agent_review"),
    0.5999: ("medium", "warn_user", "agent_review"),
    0.6: ("high", "flag_for_review", "agent_review"),
    0.7999: ("high", "flag_for_review", "agent_review"),
    0.8: ("critical", "auto_remove", "auto_remove"),
    1.0: ("critical", "auto_remove", "auto_remove"),
}


def test_risk_boundaries(spark):
    df = spark.createDataFrame([(r,) for r in RISKS], "risk_score double")
    out = triage.with_route(triage.with_bands(df)).collect()
    for r in out:
        assert (r.severity, r.band_action, r.route) == EXPECTED[r.risk_score], r


def test_final_action(spark):
    rows = [
        ("agent_review", "warn_user"),
        ("agent_review", None),
        ("auto_remove", "approved"),
        ("auto_approve", "auto_remove"),
    ]
    df = spark.createDataFrame(rows, "route string, rec string")
    got = [r.a for r in df.select(triage.final_action(F.col("route"), F.col("rec")).alias("a")).collect()]
    assert got == ["warn_user", "flag_for_review", "auto_remove", "approved"]


def test_action_status_unknown(spark):
    df = spark.createDataFrame([("auto_remove",), ("escalate",), (None,)], "action string")
    got = [(r.status, r.message) for r in au.with_status(df).collect()]
    assert got[0] == ("removed", "Content automatically removed — high risk score")
    assert got[1] == ("unknown", "Unknown action: escalate")
    assert got[2] == ("unknown", "Unknown action: None")


TEXT = "struct<toxicity:double,severe_toxicity:double,obscene:double,threat:double,insult:double,identity_attack:double,risk_score:double>"
IMAGE = "struct<harmful_score:double,safe_score:double,risk_score:double,label:string>"
USER = "struct<account_age_days:int,prev_violations:int,reports_received:int,posts_last_24h:int,is_verified:boolean>"
SCHEMA = f"id int, text_scores {TEXT}, image_scores {IMAGE}, user_meta {USER}"


def py_features(t, i, u):
    """Brute-force reference of the feature rules (dict-based, as specified)."""
    f = {}
    t = t or {}
    i = i or {}
    u = u or {}
    g = lambda d, k, dv: dv if d.get(k) is None else d.get(k)
    tox, sev, obs, thr = g(t, "toxicity", 0.0), g(t, "severe_toxicity", 0.0), g(t, "obscene", 0.0), g(t, "threat", 0.0)
    ins, idt, trs = g(t, "insult", 0.0), g(t, "identity_attack", 0.0), g(t, "risk_score", 0.0)
    f.update(text_toxicity=tox, text_severe_toxicity=sev, text_obscene=obs, text_threat=thr, text_insult=ins,
             text_identity_attack=idt, text_risk_score=trs, text_max_score=max(tox, sev, thr),
             text_any_high=int(any(v > 0.7 for v in (tox, sev, thr))))
    irs = g(i, "risk_score", 0.0)
    f.update(image_risk_score=irs, image_harmful_score=g(i, "harmful_score", 0.0), image_safe_score=g(i, "safe_score", 1.0),
             image_is_harmful=int(g(i, "label", "safe") != "safe"))
    vio, posts = g(u, "prev_violations", 0), g(u, "posts_last_24h", 1)
    f.update(user_account_age_days=g(u, "account_age_days", 365), user_prev_violations=vio,
             user_reports_received=g(u, "reports_received", 0), user_posts_last_24h=posts,
             user_is_verified=int(g(u, "is_verified", False)), user_high_velocity=int(posts > 50),
             user_repeat_offender=int(vio > 2))
    f["both_modalities_flagged"] = int(trs > 0.5 and irs > 0.5)
    import math

    raw = trs * 0.5 + irs * 0.3 + min(vio * 0.05, 0.2)
    f["combined_raw_score"] = math.floor(raw * 10000 + 0.5) / 10000
    return f


def _rows_for(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.id: r.asDict() for r in fe.with_features(df).collect()}


def test_feature_nulls(spark):
    full_t = dict(toxicity=0.9, severe_toxicity=0.1, obscene=0.2, threat=0.3, insult=0.4, identity_attack=0.5, risk_score=0.6)
    part_t = dict(toxicity=0.8, severe_toxicity=None, obscene=None, threat=None, insult=None, identity_attack=None, risk_score=None)
    full_i = dict(harmful_score=0.7, safe_score=0.3, risk_score=0.7, label="harmful")
    part_i = dict(harmful_score=None, safe_score=None, risk_score=None, label=None)
    full_u = dict(account_age_days=10, prev_violations=5, reports_received=2, posts_last_24h=60, is_verified=True)
    part_u = dict(account_age_days=None, prev_violations=None, reports_received=None, posts_last_24h=None, is_verified=None)
    cases = []
    k = 0
    for t in (None, full_t, part_t):
        for i in (None, full_i, part_i):
            for u in (None, full_u, part_u):
                cases.append((k, t, i, u))
                k += 1
    got = _rows_for(spark, cases)
    for k, t, i, u in cases:
        exp = py_features(t, i, u)
        for c in FEATURE_COLUMNS:
            assert got[k][c] == pytest.approx(exp[c]), (k, c)


def test_feature_thresholds(spark):
    def t(x):
        return dict(toxicity=x, severe_toxicity=0.0, obscene=0.0, threat=0.0, insult=0.0, identity_attack=0.0, risk_score=x)

    def u(posts, vio):
        return dict(account_age_days=1, prev_violations=vio, reports_received=0, posts_last_24h=posts, is_verified=False)

    img = lambda r: dict(harmful_score=r, safe_score=1 - r, risk_score=r, label="safe")
    cases = [
        (0, t(0.7), None, u(50, 2)),
        (1, t(0.7001), None, u(51, 3)),
        (2, t(0.5), img(0.5001), u(1, 4)),
        (3, t(0.5001), img(0.5001), u(1, 5)),
    ]
    got = _rows_for(spark, cases)
    assert got[0]["text_any_high"] == 0 and got[1]["text_any_high"] == 1
    assert got[0]["user_high_velocity"] == 0 and got[1]["user_high_velocity"] == 1
    assert got[0]["user_repeat_offender"] == 0 and got[1]["user_repeat_offender"] == 1
    assert got[2]["both_modalities_flagged"] == 0 and got[3]["both_modalities_flagged"] == 1
    # violation weight capped at .2 from 4 violations on
    assert got[2]["combined_raw_score"] == pytest.approx(round(0.25 + 0.5001 * 0.3 + 0.2, 4))
    assert got[3]["combined_raw_score"] == pytest.approx(round(0.25005 + 0.15003 + 0.2, 4), abs=1e-4)


scores = st.one_of(st.none(), st.floats(min_value=0, max_value=1, allow_nan=False))
ints = st.one_of(st.none(), st.integers(min_value=0, max_value=200))


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.tuples(scores, scores, scores, st.one_of(st.none(), st.sampled_from(["safe", "harmful"])), ints, ints,
                  st.one_of(st.none(), st.booleans()), st.booleans(), st.booleans(), st.booleans()),
        min_size=1, max_size=8,
    )
)
def test_features_total_for_any_null_pattern(spark, rows):
    cases = []
    for k, (a, b, c, lab, vio, posts, ver, has_t, has_i, has_u) in enumerate(rows):
        t = dict(toxicity=a, severe_toxicity=b, obscene=None, threat=c, insult=None, identity_attack=None, risk_score=a) if has_t else None
        i = dict(harmful_score=b, safe_score=None, risk_score=b, label=lab) if has_i else None
        u = dict(account_age_days=None, prev_violations=vio, reports_received=None, posts_last_24h=posts, is_verified=ver) if has_u else None
        cases.append((k, t, i, u))
    got = _rows_for(spark, cases)
    for k, t, i, u in cases:
        exp = py_features(t, i, u)
        for c in FEATURE_COLUMNS:
            assert got[k][c] is not None
            assert got[k][c] == pytest.approx(exp[c], abs=1e-4), (k, c)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1, allow_nan=False), min_size=2, max_size=20))
def test_triage_monotone(spark, risks):
    order = {"auto_approve": 0, "agent_review": 1, "auto_remove": 2}
    df = spark.createDataFrame([(r,) for r in risks], "risk_score double")
    out = sorted((r.risk_score, order[r.route]) for r in triage.with_route(df).collect())
    routes = [x[1] for x in out]
    assert routes == sorted(routes)


def test_lexicon_scores_do_not_depend_on_its_size_or_on_ids(spark):
    """A lexicon of any size, as a table or as entries, gives the same scores
    for repeated and missing ids."""
    from modspark.operators import text_scores as ts
    from modspark.schemas import TEXT_LABELS
    from modspark.sources import bindings as B

    texts = ["You idiot, total TRASH!", "nice day", "", "stupid stupid scum-bag", None, "clowns and a clown"]
    docs = spark.createDataFrame(list(zip(["1", "1", None, None, "5", "1"], texts)), "content_id string, text string")
    cols = ["text", *TEXT_LABELS, "text_risk_score"]
    small = B.lexicon_entries()
    large = small + [(f"unused{i}", c, 0.1 + i % 7) for i in range(5001) for c in ("toxicity", "threat")]

    def scores(lexicon):
        return sorted(map(str, ts.lexicon_scores(docs, lexicon).select(cols).collect()))

    assert scores(small) == scores(B.lexicon(spark)) == scores(large) == scores(ts.lexicon_frame(spark, large))
    by = {r.text: r for r in ts.lexicon_scores(docs, small).collect()}
    assert by[texts[0]].toxicity == 1.0 and by["nice day"].toxicity == 0 and by[texts[3]].toxicity == 1.0


def test_unicode_blank_text_is_refused(spark):
    from modspark.operators import validate

    texts = ["\u00a0", "\u3000 \n", " \x1c\x85", "a\u00a0", "", None]
    df = spark.createDataFrame([(t, None) for t in texts], "text string, image_ref string")
    got = [r.status for r in validate.with_validation(validate.with_modalities(df)).collect()]
    assert got == ["quarantine"] * 3 + ["accepted"] * 3


def test_content_ids_tell_contents_apart(spark):
    from modspark.operators import validate

    rows = [("u", "2024-01-01 00:00:00.000001", "t", "i1"), ("u", "2024-01-01 00:00:00.000002", "t", "i1"),
            ("u", "2024-01-01 00:00:00.000001", "t", "i2"), ("u", "2024-01-01 00:00:00.000001", "t", None),
            ("u", "2024-01-01 00:00:00.000001", None, "t"), ("u#", None, "t", None), ("u", None, "#t", None),
            ("u", None, "-", None), ("u", None, None, "-"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "user_id string, t string, text string, image_ref string")
    df = df.withColumn("ts", F.to_timestamp("t"))
    assert validate.with_content_ids(df).select("content_key").distinct().count() == len(rows)


def test_ensemble_label_uses_the_mean_before_rounding(spark):
    from modspark.operators import risk as rk

    df = spark.createDataFrame([(0.50004, 0.50004)], "a double, b double")
    r = df.select([v.alias(k) for k, v in rk.ensemble_columns(F.col("a"), F.col("b")).items()]).first()
    assert r.final_risk_score == 0.5 and r.raw_risk > 0.5


def test_accents_are_stripped_as_by_decomposition(spark):
    import unicodedata

    from modspark.functions.text import normalise

    texts = ["Zażółć gęślą jaźń", "Příliš žluťoučký kůň", "İstanbul'da çığ", "Árvíztűrő tükörfúrógép", "ｆｕｌｌ ｗｉｄｔｈ", "e\u0301a\u0308", "Übergröße ñandú", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(normalise(F.col("t"))).collect()]

    def strip(t):
        return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))

    assert got == [strip(t) for t in texts]


def test_json_user_meta_and_null_keys(spark):
    from modspark.operators import features as fe
    from modspark.operators import validate

    ddl = "content_id string, user_id string, ts timestamp, text string, image_ref string, user_meta string"
    rows = [
        ("a", "u1", None, "x", None, '{"account_age_days": 3, "is_verified": true, "other": 1}'),
        ("b", "u1", None, "x", "i1", "{}"),
        ("c", None, None, "x", None, None),
        ("d", "u2", None, "x", "i1", '{"prev_violations": "many"}'),
        ("e", "u2", None, "x", None, "[1]"),
        ("f", "u2", None, "x", None, "{bad"),
        ("g", "u2", None, "x", None, ""),
    ]
    content = spark.createDataFrame(rows, ddl)
    checked = {r.content_id: r.reason for r in validate.with_validation(content).collect()}
    assert checked == {"a": None, "b": None, "c": None, "d": None, "e": "invalid_user_meta", "f": "invalid_user_meta", "g": "invalid_user_meta"}
    users = spark.createDataFrame(
        [("u1", 100, 7, 0, 0, False)],
        "user_id string, account_age_days int, prev_violations int, reports_received int, posts_last_24h int, is_verified boolean",
    )
    got = fe.with_features(fe.with_user_meta(validate.accepted(validate.with_modalities(content)), users))
    meta = {r.content_id: (r.user_account_age_days, r.user_prev_violations) for r in got.collect()}
    assert meta["a"] == (3, 7) and meta["b"] == (100, 7) and meta["c"] == meta["d"]
    plain = fe.with_features(content.select("content_id", "user_meta"))  # without users: the JSON alone
    assert {r.content_id: r.user_account_age_days for r in plain.collect()}["a"] == 3


def test_rows_without_a_key_are_spread(spark):
    """Rows without an image or user do not meet in one task."""
    from modspark.operators import features as fe

    content = spark.range(4000).selectExpr("cast(id as string) content_id", "cast(null as string) user_id", "cast(null as string) image_ref")
    images = spark.createDataFrame([("i", 0.1, 0.9, 0.1, "safe")], "image_ref string, harmful_score double, safe_score double, risk_score double, label string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = fe.with_image_scores(content, images)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 700


def test_lexicon_phrases_and_case(spark):
    import pytest

    lex = [("Idiot", "insult", 0.25), ("idiot", "insult", 0.25), ("Kill Yourself", "threat", 0.3), ("don't", "toxicity", 0.1), ("a b a", "obscene", 0.2)]
    rows = [("x", "IDIOT, go kill  yourself! kill\nyourself"), ("y", "I don't; don t"), ("z", "a b a b a"), ("e", ""), ("n", None), ("k", "kill"), ("i", "...a b a")]
    df = spark.createDataFrame(rows, "content_id string, text string")
    got = {r.content_id: (r.insult, r.threat, r.toxicity, r.obscene) for r in ts.lexicon_scores(df, lex).collect()}
    assert got == {"x": (0.5, 0.6, 0, 0), "y": (0, 0, 0.2, 0), "z": (0, 0, 0, 0.4), "e": (0, 0, 0, 0), "n": (0, 0, 0, 0), "k": (0, 0, 0, 0), "i": (0, 0, 0, 0.2)}
    with pytest.raises(ValueError):
        ts.lexicon_scores(df, [("!!", "insult", 0.1)])


def test_lexicon_phrases_only_where_a_first_word_stands(spark):
    """Runs of words are put together at first words of phrases only, not at
    every word of the text (by pairing words with words beside them)."""
    lex = [("a b", "insult", 0.1), ("a b c", "threat", 0.2), ("c", "toxicity", 0.3), ("b c d", "obscene", 0.4)]
    df = spark.createDataFrame([("p", "x A b,c a-b!"), ("q", "a"), ("r", " b c "), ("s", "a a b c d"), ("n", None)], "content_id string, text string")
    scored = ts.lexicon_scores(df, lex)
    got = {r.content_id: (r.insult, r.threat, r.toxicity, r.obscene) for r in scored.collect()}
    assert got == {"p": (0.2, 0.2, 0.3, 0), "q": (0, 0, 0, 0), "r": (0, 0, 0.3, 0), "s": (0.1, 0.2, 0.3, 0.4), "n": (0, 0, 0, 0)}
    assert "zip_with" not in scored._jdf.queryExecution().optimizedPlan().toString()
