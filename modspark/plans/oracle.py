"""Equivalent SQL of every catalogue query, runnable by DuckDB on the same
tables (pre-registered views).  Shared bindings are CTE snippets; every
numeric literal is written as DOUBLE so no engine takes the decimal path.
"""

from __future__ import annotations

from modspark.schemas import TEXT_LABELS, TEXT_RISK_WEIGHTS
from modspark.sources import bindings as B


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def r4(x: str) -> str:
    return f"(floor(({x}) * CAST(10000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE))"


def rnd(x: str, digits: int) -> str:
    s = float(10 ** digits)
    return f"(floor(({x}) * {dbl(s)} + CAST(0.5 AS DOUBLE)) / {dbl(s)})"


TOKEN = r"[\p{L}\p{N}_]+"

LEXICON_VALUES = ",\n  ".join(
    f"('{t}', '{c}', {dbl(w)})" for t, c, w in B.lexicon_entries()
)

CONTENT_CTE = f"""
content AS (
  SELECT CAST(doc_id AS VARCHAR) AS content_id,
         CAST(doc_id % {B.N_USERS} AS VARCHAR) AS user_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * {B.CONTENT_STEP_S}) AS ts,
         text,
         CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS image_ref,
         lang
  FROM documents
),
lex(term, category, weight) AS (VALUES
  {LEXICON_VALUES}
)"""

ACCEPTED_TEXT = (
    "text IS NOT NULL AND text <> '' AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0"
)

BLANK_TEXT = "(text IS NOT NULL AND text <> '' AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0)"

# Lexicon scores of an id/text relation ``src``: one row per input row.
def lexicon_scores_cte(name: str, src: str, id_col: str = "content_id") -> str:
    cats = ",\n    ".join(
        f"{r4(f'least(CAST(1 AS DOUBLE), coalesce(sum(l.weight) FILTER (WHERE l.category = {chr(39)}{c}{chr(39)}), CAST(0 AS DOUBLE)))')} AS {c}"
        for c in TEXT_LABELS
    )
    risk = " + ".join(f"{c} * {dbl(TEXT_RISK_WEIGHTS[c])}" for c in TEXT_LABELS)
    return f"""
{name}_tok AS (
  SELECT {id_col}, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM {src}
),
{name}_sum AS (
  SELECT s.{id_col},
    {cats}
  FROM {src} s LEFT JOIN {name}_tok t ON s.{id_col} = t.{id_col}
  LEFT JOIN lex l ON t.term = l.term
  GROUP BY s.{id_col}
),
{name} AS (
  SELECT *, {r4(risk)} AS text_risk_score FROM {name}_sum
)"""


def severity_sql(r: str) -> str:
    return (
        f"CASE WHEN {r} >= {dbl(0.8)} THEN 'critical' WHEN {r} >= {dbl(0.6)} THEN 'high' "
        f"WHEN {r} >= {dbl(0.4)} THEN 'medium' ELSE 'low' END"
    )


def band_action_sql(r: str) -> str:
    return (
        f"CASE WHEN {r} >= {dbl(0.8)} THEN 'auto_remove' WHEN {r} >= {dbl(0.6)} THEN 'flag_for_review' "
        f"WHEN {r} >= {dbl(0.4)} THEN 'warn_user' ELSE 'approved' END"
    )


def route_sql(r: str) -> str:
    return (
        f"CASE WHEN {r} >= {dbl(0.8)} THEN 'auto_remove' WHEN {r} <= {dbl(0.35)} THEN 'auto_approve' "
        "ELSE 'agent_review' END"
    )


SCORED_TEXT_CTE = f"""WITH {CONTENT_CTE},
acc AS (SELECT * FROM content WHERE {ACCEPTED_TEXT}),
{lexicon_scores_cte('sc', 'acc')}"""

SCORED_EVENTS_CTE = f"""
ev0 AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS content_id, CAST(user_id AS VARCHAR) AS user_id, ts, event_type,
         concat_ws(' ', event_type, props) AS text,
         least({r4(f'value / {dbl(B.RISK_DIVISOR)}')}, CAST(1 AS DOUBLE)) AS risk_score
  FROM events
),
ev AS (
  SELECT *, {severity_sql('risk_score')} AS severity, {band_action_sql('risk_score')} AS band_action,
         {route_sql('risk_score')} AS route
  FROM ev0
)"""

SQL: dict[str, str] = {}

SQL["moderation_slice"] = f"""{SCORED_TEXT_CTE}
SELECT {route_sql('text_risk_score')} AS route, {severity_sql('text_risk_score')} AS severity, count(*) AS n
FROM sc GROUP BY ALL"""

SQL["text_risk"] = f"""{SCORED_TEXT_CTE}
SELECT content_id, {', '.join(TEXT_LABELS)}, text_risk_score AS risk_score FROM sc"""

SQL["severity_bands"] = f"""WITH {SCORED_EVENTS_CTE}
SELECT content_id, risk_score, severity, band_action FROM ev"""

SQL["triage_routes"] = f"""WITH {SCORED_EVENTS_CTE}
SELECT content_id, risk_score, route FROM ev"""


NL = "chr(10)"
STRIP = r"'^\s+|\s+$'"


def hu(x: str, digits: int) -> str:
    return rnd(x, digits)


# ---------------------------------------------------------------------------
# Reviews and the audit log of the scored events
# ---------------------------------------------------------------------------

RESPONSE_FMT = B.RESPONSE_JSON.replace("'", "''")

REVIEW_PARSE = f"""rc AS (
  SELECT content_id, raw,
    regexp_replace(
      CASE WHEN strpos(raw, '```json') > 0 THEN split_part(substr(raw, strpos(raw, '```json') + 7), '```', 1)
           WHEN strpos(raw, '```') > 0 THEN split_part(substr(raw, strpos(raw, '```') + 3), '```', 1)
           ELSE raw END, {STRIP}, '', 'g') AS clean
  FROM rq
),
rk AS (
  SELECT *, CASE WHEN raw IS NULL THEN NULL
                 WHEN json_valid(clean) THEN json_type(CAST(clean AS JSON)) END AS kind
  FROM rc
),
rv AS (
  SELECT content_id,
    CASE WHEN kind = 'OBJECT' THEN 'completed' WHEN raw IS NOT NULL AND kind IS NULL THEN 'parse_error' ELSE 'error' END
      AS review_status,
    CASE WHEN kind = 'OBJECT' THEN json_extract_string(clean, '$.verdict') ELSE 'flag' END AS verdict,
    CASE WHEN kind = 'OBJECT' THEN CAST(json_extract(clean, '$.confidence') AS DOUBLE)
         WHEN raw IS NOT NULL AND kind IS NULL THEN {dbl(0.5)} ELSE {dbl(0.0)} END AS confidence,
    CASE WHEN kind = 'OBJECT' THEN json_extract_string(clean, '$.severity')
         WHEN raw IS NOT NULL AND kind IS NULL THEN 'medium' ELSE 'unknown' END AS review_severity,
    CASE WHEN kind = 'OBJECT' THEN json_extract_string(clean, '$.reasoning')
         WHEN raw IS NOT NULL AND kind IS NULL
           THEN 'Agent returned malformed response. Flagging for human review as a precaution.'
         WHEN kind = 'ARRAY' THEN 'Agent error: list indices must be integers or slices, not str'
         ELSE 'Agent error: no response' END AS reasoning,
    CASE WHEN kind = 'OBJECT' THEN array_to_string(CAST(json_extract(clean, '$.key_factors') AS VARCHAR[]), '|')
         WHEN raw IS NOT NULL AND kind IS NULL THEN 'agent_parse_error' ELSE 'agent_error' END AS key_factors,
    CASE WHEN kind = 'OBJECT' THEN json_extract_string(clean, '$.recommended_action') ELSE 'flag_for_review' END
      AS recommended_action,
    CASE WHEN kind = 'OBJECT' THEN CAST(json_extract(clean, '$.needs_human_review') AS BOOLEAN) ELSE true END
      AS needs_human_review
  FROM rk
)"""

REVIEWED_CTE = SCORED_EVENTS_CTE + f""",
evv AS (
  SELECT *, CASE band_action WHEN 'auto_remove' THEN 'remove' WHEN 'flag_for_review' THEN 'flag'
                             WHEN 'warn_user' THEN 'flag' WHEN 'approved' THEN 'approve' END AS verdict0
  FROM ev
),
resp AS (
  SELECT content_id,
    CASE WHEN event_id % 8 IN (0, 4) THEN '```json' || {NL} || body || {NL} || '```'
         WHEN event_id % 8 IN (1, 5) THEN 'Here is my decision:' || {NL} || '```' || {NL} || body || {NL} || '```'
         WHEN event_id % 8 = 3 THEN 'I would ' || verdict0 || ' this content.'
         WHEN event_id % 8 = 6 THEN '[' || body || ']'
         ELSE '  ' || body || {NL} END AS raw
  FROM (
    SELECT *, printf('{RESPONSE_FMT}', verdict0, risk_score, severity, risk_score, event_type, event_type,
                     severity, band_action, CASE WHEN risk_score >= {dbl(0.6)} THEN 'true' ELSE 'false' END) AS body
    FROM evv WHERE route = 'agent_review' AND event_id % 10 <> 9
  )
),
rq AS (
  SELECT q.content_id, r.raw FROM (SELECT content_id FROM ev WHERE route = 'agent_review') q
  LEFT JOIN resp r USING (content_id)
),
{REVIEW_PARSE},
dec AS (
  SELECT ev.*, rv.review_status, rv.verdict, rv.reasoning, rv.key_factors, rv.recommended_action, rv.needs_human_review,
    rv.content_id IS NOT NULL AS has_review,
    CASE WHEN route = 'agent_review' THEN coalesce(rv.recommended_action, 'flag_for_review')
         WHEN route = 'auto_remove' THEN 'auto_remove' ELSE 'approved' END AS final_action
  FROM ev LEFT JOIN rv USING (content_id)
),
audit AS (
  SELECT content_id, user_id, final_action AS action, risk_score,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
    CASE WHEN text IS NOT NULL AND text <> '' THEN substring(text, 1, 100) END AS content_preview,
    CASE final_action WHEN 'auto_remove' THEN 'removed' WHEN 'flag_for_review' THEN 'flagged'
         WHEN 'warn_user' THEN 'warned' WHEN 'approved' THEN 'approved' ELSE 'unknown' END AS status,
    CASE final_action WHEN 'auto_remove' THEN 'Content automatically removed — high risk score'
         WHEN 'flag_for_review' THEN 'Content flagged — queued for human review'
         WHEN 'warn_user' THEN 'User warned — content kept with warning label'
         WHEN 'approved' THEN 'Content approved — passed moderation'
         ELSE 'Unknown action: ' || coalesce(final_action, 'None') END AS message,
    CASE WHEN has_review THEN verdict END AS agent_verdict,
    CASE WHEN has_review THEN reasoning END AS agent_reasoning,
    CASE WHEN has_review THEN coalesce(key_factors, '') END AS agent_factors,
    CASE WHEN has_review THEN coalesce(needs_human_review, false) END AS human_review,
    ts
  FROM dec
)"""

SQL["review_parse"] = f"""WITH {REVIEWED_CTE}
SELECT content_id, review_status, verdict, confidence, review_severity, reasoning, key_factors,
       recommended_action, needs_human_review FROM rv"""

SQL["final_actions"] = f"""WITH {REVIEWED_CTE}
SELECT content_id, route, band_action, coalesce(review_status, 'none') AS review_status, final_action FROM dec"""

SQL["action_messages"] = f"""WITH {REVIEWED_CTE}
SELECT content_id, action, status, message FROM audit"""

SQL["audit_rows"] = f"""WITH {REVIEWED_CTE}
SELECT content_id, user_id, action, risk_score, timestamp, content_preview, status, message,
       agent_verdict, agent_reasoning, agent_factors, human_review FROM audit"""

SQL["audit_tail"] = f"""WITH {REVIEWED_CTE}
SELECT content_id, action, risk_score, timestamp FROM audit ORDER BY ts DESC, content_id DESC LIMIT 20"""

AS_OF = f"TIMESTAMP '{B.AS_OF}'"
RECENT = f"({AS_OF} - INTERVAL 24 HOURS)"
PREVIOUS = f"({AS_OF} - INTERVAL 48 HOURS)"

SQL["recent_window"] = f"""WITH {REVIEWED_CTE}
SELECT content_id, action, risk_score, timestamp FROM audit WHERE ts >= {RECENT}"""


def stats_sql(cond: str | None, prefix: str) -> str:
    f = f" FILTER (WHERE {cond})" if cond else ""

    def share(a: str) -> str:
        return f"{hu(f'avg(CASE WHEN coalesce(action = {chr(39)}{a}{chr(39)}, false) THEN {dbl(1.0)} ELSE {dbl(0.0)} END){f} * {dbl(100.0)}', 2)}"

    return ",\n  ".join(
        [
            f"count(risk_score){f} AS {prefix}count",
            f"{r4(f'avg(risk_score){f}')} AS {prefix}mean",
            f"{r4(f'stddev_samp(risk_score){f}')} AS {prefix}std",
            f"{r4(f'min(risk_score){f}')} AS {prefix}min",
            f"{r4(f'max(risk_score){f}')} AS {prefix}max",
            f"{r4(f'quantile_cont(risk_score, 0.5){f}')} AS {prefix}p50",
            f"{r4(f'quantile_cont(risk_score, 0.9){f}')} AS {prefix}p90",
            f"{r4(f'quantile_cont(risk_score, 0.99){f}')} AS {prefix}p99",
            f"{share('auto_remove')} AS {prefix}pct_removed",
            f"{share('flag_for_review')} AS {prefix}pct_flagged",
            f"{share('approved')} AS {prefix}pct_approved",
            f"count(*){f} AS {prefix}rows",
        ]
    )


SQL["score_stats"] = f"""WITH {REVIEWED_CTE}
SELECT {stats_sql(None, '')} FROM audit WHERE ts >= {RECENT}"""

STAT_NAMES = ["count", "mean", "std", "min", "max", "p50", "p90", "p99", "pct_removed", "pct_flagged", "pct_approved"]


def drift_sql(previous_cond: str) -> str:
    cols = ", ".join([f"recent_{n}" for n in STAT_NAMES] + [f"previous_{n}" for n in STAT_NAMES])
    return f"""WITH {REVIEWED_CTE},
st AS (
  SELECT {stats_sql(f'ts >= {RECENT}', 'recent_')},
  {stats_sql(previous_cond, 'previous_')}
  FROM audit WHERE ts >= {PREVIOUS}
),
e AS (SELECT *, (recent_rows = 0 OR previous_rows = 0) AS empty,
             abs(recent_mean - previous_mean) AS shift, abs(recent_std - previous_std) AS sshift FROM st)
SELECT {cols},
  CASE WHEN NOT empty THEN {r4('shift')} END AS mean_shift,
  CASE WHEN NOT empty THEN {r4('sshift')} END AS std_shift,
  {dbl(0.15)} AS threshold,
  CASE WHEN empty THEN false ELSE coalesce(shift > {dbl(0.15)}, false) END AS drift_detected,
  CASE WHEN empty THEN NULL WHEN coalesce(shift > {dbl(0.15)}, false) THEN 'retrain' ELSE 'monitor' END AS recommendation,
  CASE WHEN empty THEN 'insufficient data' END AS reason,
  recent_count AS total_processed
FROM e"""


SQL["drift_overlapping"] = drift_sql("true")
SQL["drift_disjoint"] = drift_sql(f"ts < {RECENT}")

SQL["dashboard_summary"] = f"""WITH {REVIEWED_CTE},
pa AS (
  SELECT coalesce(action, 'unknown') AS action, count(*) AS n, sum(risk_score) AS risk_sum,
         count(risk_score) AS risk_n, max(risk_score) AS risk_max,
         count_if(coalesce(agent_verdict <> '', false)) AS agent, count_if(coalesce(human_review, false)) AS human
  FROM audit WHERE ts >= {RECENT} GROUP BY 1
)
SELECT action, n, CAST(sum(n) OVER () AS BIGINT) AS total,
  {r4('sum(risk_sum) OVER () / sum(risk_n) OVER ()')} AS avg_risk_score,
  {r4('max(risk_max) OVER ()')} AS max_risk_score,
  CAST(sum(agent) OVER () AS BIGINT) AS agent_reviews, CAST(sum(human) OVER () AS BIGINT) AS human_reviews_needed
FROM pa"""

HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00')"

SQL["timeline_long"] = f"""WITH {REVIEWED_CTE}
SELECT {HOUR} AS time, coalesce(action, 'unknown') AS action, count(*) AS n
FROM audit WHERE ts >= {RECENT} GROUP BY 1, 2 ORDER BY 1, 2"""

SQL["timeline_wide"] = f"""WITH {REVIEWED_CTE}
SELECT {HOUR} AS time,
  CAST(count_if(action = 'auto_remove') AS BIGINT) AS auto_remove,
  CAST(count_if(action = 'flag_for_review') AS BIGINT) AS flag_for_review,
  CAST(count_if(action = 'warn_user') AS BIGINT) AS warn_user,
  CAST(count_if(action = 'approved') AS BIGINT) AS approved,
  CAST(count_if(action IS NULL OR action = 'unknown') AS BIGINT) AS unknown,
  CAST(count_if(action NOT IN ('auto_remove', 'flag_for_review', 'warn_user', 'approved', 'unknown')) AS BIGINT) AS other
FROM audit WHERE ts >= {RECENT} GROUP BY 1 ORDER BY 1"""

SQL["sliding_stats"] = f"""WITH {REVIEWED_CTE},
w AS (
  SELECT a.*, time_bucket(INTERVAL 6 HOURS, ts) - k * INTERVAL 6 HOURS AS ws
  FROM audit a, (SELECT unnest(range(0, 4)) AS k)
)
SELECT strftime(ws, '%Y-%m-%d %H:%M') AS window_start, strftime(ws + INTERVAL 24 HOURS, '%Y-%m-%d %H:%M') AS window_end,
  {stats_sql(None, '').rsplit(',', 1)[0]}
FROM w GROUP BY ws"""

SQL["prior_violations"] = f"""WITH {REVIEWED_CTE},
pv AS (
  SELECT content_id, user_id,
    CAST(coalesce(sum(CASE WHEN action IN ('auto_remove', 'flag_for_review') THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY ts, content_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
      AS prev_violations
  FROM audit
)
SELECT content_id, user_id, prev_violations, CAST(prev_violations > 2 AS INTEGER) AS repeat_offender FROM pv"""

POSTS_CTE = """posts AS (
  SELECT CAST(event_id AS VARCHAR) AS content_id, CAST(user_id AS VARCHAR) AS user_id, ts FROM events
)"""

SQL["user_velocity"] = f"""WITH {POSTS_CTE},
v AS (
  SELECT content_id, user_id,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)
      AS posts_last_24h
  FROM posts
)
SELECT content_id, user_id, posts_last_24h, CAST(posts_last_24h > {B.VELOCITY_TEST_THRESHOLD} AS INTEGER) AS high_velocity
FROM v"""

SQL["account_age"] = f"""WITH {POSTS_CTE}
SELECT content_id, user_id,
  CAST(date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id) AS DATE), CAST(ts AS DATE)) AS INTEGER)
    AS account_age_days
FROM posts"""

# ---------------------------------------------------------------------------
# Content validation, ids, labelled corpus
# ---------------------------------------------------------------------------

SQL["validate_quarantine"] = f"""WITH {CONTENT_CTE},
m AS (
  SELECT content_id, coalesce(text IS NOT NULL AND text <> '', false) AS has_text, image_ref IS NOT NULL AS has_image,
    CASE WHEN text IS NOT NULL AND text <> '' AND length(regexp_replace(text, {STRIP}, '', 'g')) = 0
         THEN 'blank_text' END AS reason
  FROM content
)
SELECT content_id, has_text, has_image, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'quarantine' END AS status, reason
FROM m"""

SQL["content_ids"] = f"""WITH {CONTENT_CTE},
k AS (SELECT content_id, sha256(concat_ws('|',
        coalesce(length(user_id) || ':' || user_id, '-'),
        coalesce(length(CAST(epoch_us(ts) AS VARCHAR)) || ':' || CAST(epoch_us(ts) AS VARCHAR), '-'),
        coalesce(length(text) || ':' || text, '-'), coalesce(length(image_ref) || ':' || image_ref, '-'))) AS content_key
      FROM content)
SELECT content_id, content_key, substring(content_key, 1, 8) AS content_short FROM k"""

CORPUS_CTE = f"""WITH {CONTENT_CTE},
lc AS (SELECT d.doc_id, d.text, l.toxic FROM documents d JOIN labels l USING (doc_id)),
{lexicon_scores_cte('ls', 'lc', 'doc_id')},
corpus AS (
  SELECT lc.doc_id, lc.text AS comment_text, CAST(lc.toxic AS INTEGER) AS toxic,
    CAST(ls.severe_toxicity > 0 AS INTEGER) AS severe_toxic, CAST(ls.obscene > 0 AS INTEGER) AS obscene,
    CAST(ls.threat > 0 AS INTEGER) AS threat, CAST(ls.insult > 0 AS INTEGER) AS insult,
    CAST(ls.identity_attack > 0 AS INTEGER) AS identity_hate
  FROM lc JOIN ls USING (doc_id)
),
lab AS (
  SELECT *, CAST(coalesce(toxic, 0) + coalesce(severe_toxic, 0) + coalesce(obscene, 0) + coalesce(threat, 0)
    + coalesce(insult, 0) + coalesce(identity_hate, 0) > 0 AS INTEGER) AS label FROM corpus
)"""

SQL["any_label"] = f"""{CORPUS_CTE}
SELECT count(*) AS rows,
  CAST(sum(toxic) AS BIGINT) AS sum_toxic, CAST(sum(severe_toxic) AS BIGINT) AS sum_severe_toxic,
  CAST(sum(obscene) AS BIGINT) AS sum_obscene, CAST(sum(threat) AS BIGINT) AS sum_threat,
  CAST(sum(insult) AS BIGINT) AS sum_insult, CAST(sum(identity_hate) AS BIGINT) AS sum_identity_hate,
  count_if(label = 1) AS n_toxic, count_if(label = 0) AS n_clean
FROM lab"""

# ---------------------------------------------------------------------------
# Vectors: centroids and the zero-shot head
# ---------------------------------------------------------------------------

EMB_CTE = """emb AS (SELECT vec_id AS id, embedding AS e, label AS class_id FROM embeddings),
edim AS (SELECT id, class_id, unnest(generate_series(1, len(e))) AS pos, CAST(unnest(e) AS DOUBLE) AS v FROM emb),
cent AS (SELECT class_id, pos, avg(v) AS v FROM edim GROUP BY class_id, pos)"""

SQL["class_centroids"] = f"""WITH {EMB_CTE}
SELECT class_id, CAST(pos AS INTEGER) AS dim, {hu('v', 6)} AS value FROM cent"""


def zero_shot_cte(scale: float, name: str = "zs") -> str:
    return f"""{EMB_CTE},
cn AS (SELECT class_id, sqrt(sum(v * v)) AS n FROM cent GROUP BY class_id),
cu AS (SELECT c.class_id, c.pos, c.v / cn.n AS v FROM cent c JOIN cn USING (class_id)),
en AS (SELECT id, sqrt(sum(v * v)) AS n FROM edim GROUP BY id),
sim AS (
  SELECT d.id, cu.class_id, sum((d.v / en.n) * cu.v) * {dbl(scale)} AS s
  FROM edim d JOIN en USING (id) JOIN cu ON d.pos = cu.pos GROUP BY d.id, cu.class_id
),
sm AS (SELECT id, class_id, exp(s - max(s) OVER (PARTITION BY id)) AS x FROM sim),
pr AS (SELECT id, class_id, x / sum(x) OVER (PARTITION BY id) AS p, count(*) OVER (PARTITION BY id) AS k FROM sm),
za AS (
  SELECT id, sum(p) FILTER (WHERE class_id < {B.HARMFUL_CLASSES}) AS harm,
         sum(p) FILTER (WHERE class_id >= {B.HARMFUL_CLASSES}) AS safe,
         sqrt(sum((p - 1.0 / k) * (p - 1.0 / k)) / max(k)) AS sd,
         max(p) AS mx, arg_max(class_id, p) AS top
  FROM pr GROUP BY id
),
{name} AS (
  SELECT id,
    CASE WHEN sd < {dbl(0.015)} THEN {dbl(0.0)} ELSE {r4('harm')} END AS harmful_score,
    CASE WHEN sd < {dbl(0.015)} THEN {dbl(1.0)} ELSE {r4('safe')} END AS safe_score,
    CASE WHEN sd < {dbl(0.015)} THEN {dbl(0.0)} ELSE {r4('harm')} END AS risk_score,
    CASE WHEN sd < {dbl(0.015)} THEN 'safe' WHEN harm > {dbl(0.4)} THEN 'harmful' ELSE 'safe' END AS label,
    CASE WHEN sd < {dbl(0.015)} THEN 'low — defaulted to safe' ELSE 'high' END AS confidence,
    'class_' || CAST(top AS VARCHAR) AS top_prompt,
    {r4('mx')} AS top_score
  FROM za
)"""


SQL["zero_shot"] = f"""WITH {zero_shot_cte(1.0)}
SELECT * FROM zs"""

SQL["zero_shot_scaled"] = f"""WITH {zero_shot_cte(B.ZERO_SHOT_SCALE)}
SELECT * FROM zs"""

# ---------------------------------------------------------------------------
# Features, cross-modal, review prompts (documents as content)
# ---------------------------------------------------------------------------

USERS_CTE = f"""users AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id,
    CAST(date_diff('day', CAST(min(ts) AS DATE), CAST({AS_OF} AS DATE)) AS INTEGER) AS account_age_days,
    CAST(count_if(event_type = 'error') AS INTEGER) AS prev_violations,
    CAST(count_if(event_type = 'signup') AS INTEGER) AS reports_received,
    CAST(count_if(ts >= {RECENT} AND ts <= {AS_OF}) AS INTEGER) AS posts_last_24h,
    bool_or(event_type = 'purchase') AS is_verified
  FROM events GROUP BY user_id
)"""


def features_select(t: str, z: str, u: str) -> str:
    tox, sev, obs, thr, ins, idt, trs = (
        f"coalesce({t}.{c}, {dbl(0.0)})" for c in TEXT_LABELS + ["text_risk_score"]
    )
    irs = f"coalesce({z}.risk_score, {dbl(0.0)})"
    vio = f"coalesce({u}.prev_violations, 0)"
    posts = f"coalesce({u}.posts_last_24h, 1)"
    hi = dbl(0.7)
    return f"""{tox} AS text_toxicity, {sev} AS text_severe_toxicity, {obs} AS text_obscene, {thr} AS text_threat,
    {ins} AS text_insult, {idt} AS text_identity_attack, {trs} AS text_risk_score,
    greatest({tox}, {sev}, {thr}) AS text_max_score,
    CAST(({tox} > {hi} OR {sev} > {hi} OR {thr} > {hi}) AS INTEGER) AS text_any_high,
    {irs} AS image_risk_score, coalesce({z}.harmful_score, {dbl(0.0)}) AS image_harmful_score,
    coalesce({z}.safe_score, {dbl(1.0)}) AS image_safe_score,
    CAST(coalesce({z}.label, 'safe') <> 'safe' AS INTEGER) AS image_is_harmful,
    coalesce({u}.account_age_days, 365) AS user_account_age_days, {vio} AS user_prev_violations,
    coalesce({u}.reports_received, 0) AS user_reports_received, {posts} AS user_posts_last_24h,
    CAST(coalesce({u}.is_verified, false) AS INTEGER) AS user_is_verified,
    CAST({posts} > 50 AS INTEGER) AS user_high_velocity,
    CAST({vio} > 2 AS INTEGER) AS user_repeat_offender,
    CAST(({trs} > {dbl(0.5)} AND {irs} > {dbl(0.5)}) AS INTEGER) AS both_modalities_flagged,
    {r4(f'{trs} * {dbl(0.5)} + {irs} * {dbl(0.3)} + least({vio} * {dbl(0.05)}, {dbl(0.2)})')} AS combined_raw_score"""


FEATURES_CTE = f"""WITH {CONTENT_CTE},
{zero_shot_cte(B.ZERO_SHOT_SCALE)},
{USERS_CTE},
acc AS (SELECT * FROM content WHERE NOT (text IS NOT NULL AND text <> '' AND length(regexp_replace(text, {STRIP}, '', 'g')) = 0)),
{lexicon_scores_cte('sc', 'acc')},
feat AS (
  SELECT a.content_id, a.text, a.image_ref, a.user_id,
    (a.text IS NOT NULL AND a.text <> '') AS has_text,
    {features_select('t', 'z', 'u')},
    t.toxicity AS t_tox, t.severe_toxicity AS t_sev, t.threat AS t_thr, t.insult AS t_ins,
    t.identity_attack AS t_idt, t.text_risk_score AS t_risk,
    z.risk_score AS z_risk, z.harmful_score AS z_harm, z.label AS z_label, z.id IS NOT NULL AS has_z,
    u.account_age_days AS u_age, u.prev_violations AS u_vio, u.reports_received AS u_rep,
    u.posts_last_24h AS u_posts, u.is_verified AS u_ver, u.user_id IS NOT NULL AS has_u
  FROM acc a
  LEFT JOIN (SELECT * FROM sc WHERE content_id IN (SELECT content_id FROM acc WHERE text IS NOT NULL AND text <> '')) t
    ON a.content_id = t.content_id
  LEFT JOIN zs z ON a.image_ref = CAST(z.id AS VARCHAR)
  LEFT JOIN users u ON a.user_id = u.user_id
)"""

FEATURE_LIST = ", ".join(
    __import__("modspark.schemas", fromlist=["FEATURE_COLUMNS"]).FEATURE_COLUMNS
)

SQL["features_full"] = f"""{FEATURES_CTE}
SELECT content_id, {FEATURE_LIST} FROM feat"""

SQL["cross_modal"] = f"""{FEATURES_CTE}
SELECT content_id, text_risk_score, image_risk_score, user_prev_violations, both_modalities_flagged, combined_raw_score
FROM feat"""

SQL["features_defaults"] = f"""WITH {CONTENT_CTE},
bc AS (SELECT 'b' || CAST(item_id AS VARCHAR) AS content_id, text FROM benchmark),
acc AS (SELECT * FROM bc WHERE NOT (text IS NOT NULL AND text <> '' AND length(regexp_replace(text, {STRIP}, '', 'g')) = 0)),
{lexicon_scores_cte('sc', 'acc')},
z AS (SELECT NULL::DOUBLE AS risk_score, NULL::DOUBLE AS harmful_score, NULL::DOUBLE AS safe_score, NULL::VARCHAR AS label),
u AS (SELECT NULL::INTEGER AS account_age_days, NULL::INTEGER AS prev_violations, NULL::INTEGER AS reports_received,
             NULL::INTEGER AS posts_last_24h, NULL::BOOLEAN AS is_verified)
SELECT a.content_id, {features_select('t', 'z', 'u')}
FROM acc a
LEFT JOIN (SELECT * FROM sc WHERE content_id IN (SELECT content_id FROM acc WHERE text IS NOT NULL AND text <> '')) t
  ON a.content_id = t.content_id
CROSS JOIN z CROSS JOIN u"""


def f3(x: str) -> str:
    return f"printf('%.3f', {hu(f'coalesce({x}, {dbl(0.0)})', 3)})"


SQL["review_prompt"] = f"""{FEATURES_CTE},
d AS (
  SELECT *, text_risk_score AS risk_score, {severity_sql('text_risk_score')} AS severity,
         {band_action_sql('text_risk_score')} AS band_action, {route_sql('text_risk_score')} AS route
  FROM feat
)
SELECT content_id, concat_ws({NL},
  '## Content Under Review' || {NL},
  CASE WHEN text IS NOT NULL AND text <> '' THEN '**Text content:**' || {NL} || '"' || text || '"' || {NL} END,
  {NL} || '## Detector Scores' || {NL},
  CASE WHEN t_risk IS NOT NULL AND has_text THEN concat_ws({NL}, '**NLP Detector:**',
    '- Toxicity: ' || {f3('t_tox')}, '- Severe toxicity: ' || {f3('t_sev')}, '- Threat: ' || {f3('t_thr')},
    '- Insult: ' || {f3('t_ins')}, '- Identity attack: ' || {f3('t_idt')},
    '- Overall text risk: ' || {f3('t_risk')} || {NL}) END,
  CASE WHEN has_z THEN concat_ws({NL}, '**Vision Detector:**', '- Image risk score: ' || {f3('z_risk')},
    '- Harmful score: ' || {f3('z_harm')}, '- Label: ' || coalesce(z_label, 'unknown') || {NL}) END,
  concat_ws({NL}, '**Risk Scorer (ensemble):**', '- Final risk score: ' || {f3('risk_score')},
    '- Severity: ' || coalesce(severity, 'unknown'), '- Initial action: ' || coalesce(band_action, 'unknown') || {NL}),
  {NL} || '## User History' || {NL},
  CASE WHEN has_u THEN concat_ws({NL},
    '- Account age: ' || coalesce(CAST(u_age AS VARCHAR), 'unknown') || ' days',
    '- Previous violations: ' || CAST(coalesce(u_vio, 0) AS VARCHAR),
    '- Reports received: ' || CAST(coalesce(u_rep, 0) AS VARCHAR),
    '- Posts in last 24h: ' || CAST(coalesce(u_posts, 0) AS VARCHAR),
    '- Verified account: ' || CASE WHEN coalesce(u_ver, false) THEN 'True' ELSE 'False' END)
    ELSE '- No user history available' END,
  {NL} || '## Your Task' || {NL} || 'This content scored in the borderline range (0.35–0.8). '
    || 'The automated system was not confident enough to act automatically. '
    || 'Review all signals above and make the final moderation decision. '
    || 'Respond ONLY with the JSON format specified.'
) AS prompt
FROM d WHERE route = 'agent_review'"""

SQL["review_parse_free_text"] = f"""WITH c AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS content_id, text AS raw
  FROM conversations WHERE role = 'assistant'
),
rc AS (
  SELECT content_id, raw,
    regexp_replace(
      CASE WHEN strpos(raw, '```json') > 0 THEN split_part(substr(raw, strpos(raw, '```json') + 7), '```', 1)
           WHEN strpos(raw, '```') > 0 THEN split_part(substr(raw, strpos(raw, '```') + 3), '```', 1)
           ELSE raw END, {STRIP}, '', 'g') AS clean
  FROM c
),
rk AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN json_valid(clean) THEN json_type(CAST(clean AS JSON)) END AS kind FROM rc)
SELECT content_id,
  CASE WHEN kind = 'OBJECT' THEN 'completed' WHEN raw IS NOT NULL AND kind IS NULL THEN 'parse_error' ELSE 'error' END
    AS review_status,
  CASE WHEN kind = 'OBJECT' THEN json_extract_string(clean, '$.verdict') ELSE 'flag' END AS verdict,
  CASE WHEN kind = 'OBJECT' THEN json_extract_string(clean, '$.recommended_action') ELSE 'flag_for_review' END
    AS recommended_action
FROM rk"""


# ---------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------

LABELLED_SCORES_CTE = f"""WITH {CONTENT_CTE},
lc AS (SELECT d.doc_id, d.text, l.toxic FROM documents d JOIN labels l USING (doc_id)),
{lexicon_scores_cte('ls', 'lc', 'doc_id')},
s AS (SELECT lc.doc_id, lc.toxic, ls.* EXCLUDE (doc_id) FROM lc JOIN ls USING (doc_id))"""

SQL["auc_exact"] = f"""{LABELLED_SCORES_CTE},
g AS (SELECT text_risk_score AS sc, sum(toxic) AS pos, count(*) - sum(toxic) AS neg FROM s GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT {hu(f'sum(pos * (below + {dbl(0.5)} * neg)) / (sum(pos) * sum(neg))', 6)} AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c"""


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {dbl(0.0)})"


SQL["class_report"] = f"""{LABELLED_SCORES_CTE},
cm AS (
  SELECT count_if(toxic = 1 AND toxicity > {dbl(0.5)}) AS tp, count_if(toxic = 0 AND toxicity > {dbl(0.5)}) AS fp,
         count_if(toxic = 1 AND NOT toxicity > {dbl(0.5)}) AS fn, count_if(toxic = 0 AND NOT toxicity > {dbl(0.5)}) AS tn
  FROM s
),
m AS (
  SELECT *, {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1,
            {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0,
            tp + fn AS s1, tn + fp AS s0, tp + fn + tn + fp AS n FROM cm
),
m2 AS (SELECT *, {_div('2 * p1 * r1', 'p1 + r1')} AS f1, {_div('2 * p0 * r0', 'p0 + r0')} AS f0 FROM m)
SELECT '0' AS class_name, {hu('p0', 6)} AS precision, {hu('r0', 6)} AS recall, {hu('f0', 6)} AS f1, CAST(s0 AS BIGINT) AS support FROM m2
UNION ALL SELECT '1', {hu('p1', 6)}, {hu('r1', 6)}, {hu('f1', 6)}, CAST(s1 AS BIGINT) FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, {hu(_div('tp + tn', 'n'), 6)}, CAST(n AS BIGINT) FROM m2
UNION ALL SELECT 'macro avg', {hu('(p0 + p1) / 2', 6)}, {hu('(r0 + r1) / 2', 6)}, {hu('(f0 + f1) / 2', 6)}, CAST(n AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', {hu(_div('p0 * s0 + p1 * s1', 'n'), 6)}, {hu(_div('r0 * s0 + r1 * s1', 'n'), 6)},
  {hu(_div('f0 * s0 + f1 * s1', 'n'), 6)}, CAST(n AS BIGINT) FROM m2"""

MD5 = "md5(concat_ws('#', CAST(doc_id AS VARCHAR), '42'))"

SQL["hash_split"] = f"""SELECT doc_id, toxic,
  CASE WHEN CAST(('0x' || substr({MD5}, 1, 8)) AS BIGINT) / {dbl(4294967296.0)} < {dbl(0.2)} THEN 'test' ELSE 'train' END
    AS split
FROM labels"""

SQL["strat_split_exact"] = f"""WITH r AS (
  SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {MD5}, doc_id) AS rn,
         count(*) OVER (PARTITION BY toxic) AS n FROM labels
)
SELECT doc_id, toxic, CASE WHEN rn <= floor(n * {dbl(0.2)} + {dbl(0.5)}) THEN 'test' ELSE 'train' END AS split FROM r"""

SQL["label_coverage"] = """SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents"""

# ---------------------------------------------------------------------------
# Text model
# ---------------------------------------------------------------------------

from modspark.functions.text import ACCENTED, UNACCENTED  # noqa: E402

_quote = str.maketrans({"'": "''"})

TERMS_CTE = rf"""tk AS (
  SELECT doc_id, regexp_extract_all(translate(lower(text), '{ACCENTED.translate(_quote)}', '{UNACCENTED.translate(_quote)}'), '[\p{{L}}\p{{N}}_]{{2,}}') AS t
  FROM documents
),
gr AS (
  SELECT doc_id, list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
                                     ELSE CAST([] AS VARCHAR[]) END) AS grams FROM tk
),
dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(grams) AS term FROM gr) GROUP BY doc_id, term),
pt AS (SELECT term, CAST(sum(tf) AS BIGINT) AS freq, count(*) AS doc_freq FROM dt GROUP BY term),
vocab AS (SELECT * FROM pt ORDER BY freq DESC, term ASC LIMIT 10000),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
tw AS (
  SELECT dt.doc_id, dt.term, (1 + ln(CAST(tf AS DOUBLE))) * (ln((1 + nd.n) / (1 + CAST(v.doc_freq AS DOUBLE))) + 1) AS w
  FROM dt JOIN vocab v USING (term) CROSS JOIN nd
),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM tw)"""

SQL["vocab_topk"] = f"""WITH {TERMS_CTE}
SELECT term, freq, doc_freq FROM vocab"""

SQL["tfidf_weights"] = f"""WITH {TERMS_CTE}
SELECT doc_id, term, {hu('weight', 6)} AS weight FROM tfidf"""


def _linear_values() -> str:
    from modspark.plans.queries import LINEAR_COEF

    return ", ".join(f"('{w}', {dbl(LINEAR_COEF)})" for w in B.LEXICON_WORDS)


def _linear_sql() -> str:
    from modspark.plans.queries import LINEAR_INTERCEPT

    return f"""WITH {TERMS_CTE},
coef(term, coef) AS (VALUES {_linear_values()}),
z AS (SELECT doc_id, sum(coef * weight) AS z FROM tfidf JOIN coef USING (term) GROUP BY doc_id),
p AS (SELECT d.doc_id, 1.0 / (1.0 + exp(-({dbl(LINEAR_INTERCEPT)} + coalesce(z.z, {dbl(0.0)})))) AS p
      FROM documents d LEFT JOIN z USING (doc_id))
SELECT doc_id, {r4('p')} AS risk_score, {r4('p')} AS confidence, CASE WHEN p > {dbl(0.5)} THEN 'toxic' ELSE 'clean' END AS label
FROM p"""


SQL["linear_text_score"] = _linear_sql()

# ---------------------------------------------------------------------------
# Risk ensemble
# ---------------------------------------------------------------------------

SQL["risk_training_set"] = f"""{FEATURES_CTE}
SELECT f.content_id, {', '.join('f.' + c for c in FEATURE_LIST.split(', '))}, CAST(l.toxic AS INTEGER) AS label
FROM feat f JOIN labels l ON f.content_id = CAST(l.doc_id AS VARCHAR)"""

SQL["ensemble_average"] = f"""{FEATURES_CTE},
e AS (SELECT content_id, {r4('(text_risk_score + combined_raw_score) / 2.0')} AS final_risk_score,
             {r4('text_risk_score')} AS xgb_score, {r4('combined_raw_score')} AS lgb_score FROM feat)
SELECT content_id, final_risk_score, xgb_score, lgb_score, {severity_sql('final_risk_score')} AS severity,
       {band_action_sql('final_risk_score')} AS action FROM e"""


# ---------------------------------------------------------------------------
# End to end (documents as content, no reviewer: borderline -> error fallback)
# ---------------------------------------------------------------------------

RESP_CTE = REVIEWED_CTE[len(SCORED_EVENTS_CTE) + 2 : REVIEWED_CTE.index("rq AS (")]
TEXT_JSON = "CASE WHEN has_text THEN concat_ws('|', t_tox, t_sev, t_thr, t_ins, t_idt, t_risk) END"

DECISIONS_CTE = f"""{FEATURES_CTE},
{SCORED_EVENTS_CTE},
{RESP_CTE}
dd0 AS (
  SELECT f.*, c.ts, {r4('(text_risk_score + combined_raw_score) / 2.0')} AS risk_score
  FROM feat f JOIN content c USING (content_id)
),
dd AS (SELECT *, {severity_sql('risk_score')} AS severity, {route_sql('risk_score')} AS route FROM dd0),
rq AS (
  SELECT d.content_id, min(r.raw) AS raw FROM dd d LEFT JOIN resp r USING (content_id)
  WHERE d.route = 'agent_review' GROUP BY 1
),
{REVIEW_PARSE},
dec2 AS (
  SELECT dd.*, review_status, verdict, reasoning, key_factors, recommended_action, needs_human_review,
         rv.content_id IS NOT NULL AS has_review,
         CASE WHEN route = 'agent_review' THEN coalesce(recommended_action, 'flag_for_review')
              WHEN route = 'auto_remove' THEN 'auto_remove' ELSE 'approved' END AS final_action
  FROM dd LEFT JOIN rv USING (content_id)
)"""

SQL["moderation_decisions"] = f"""{DECISIONS_CTE}
SELECT content_id, user_id, risk_score, severity, route, final_action, coalesce(review_status, 'none') AS review_status
FROM dec2"""

SQL["decision_view"] = f"""{DECISIONS_CTE}
SELECT content_id, user_id, risk_score, severity, route, final_action, verdict AS agent_verdict,
       t_risk AS text_risk, z_risk AS image_risk
FROM dec2"""

SQL["moderation_audit"] = f"""{DECISIONS_CTE}
SELECT content_id, user_id, final_action AS action, risk_score, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
  CASE WHEN text IS NOT NULL AND text <> '' THEN substring(text, 1, 100) END AS content_preview,
  CASE final_action WHEN 'auto_remove' THEN 'removed' WHEN 'flag_for_review' THEN 'flagged'
       WHEN 'warn_user' THEN 'warned' WHEN 'approved' THEN 'approved' ELSE 'unknown' END AS status,
  CASE final_action WHEN 'auto_remove' THEN 'Content automatically removed — high risk score'
       WHEN 'flag_for_review' THEN 'Content flagged — queued for human review'
       WHEN 'warn_user' THEN 'User warned — content kept with warning label'
       WHEN 'approved' THEN 'Content approved — passed moderation' END AS message,
  verdict AS agent_verdict, reasoning AS agent_reasoning, key_factors AS agent_factors,
  needs_human_review AS human_review
FROM dec2"""

# ---------------------------------------------------------------------------
# Rows that are easily lost: missing keys and labels, unlisted actions, own
# metadata, repeated ids.  Native windows and plain groups on the same inputs.
# ---------------------------------------------------------------------------

NULL_USERS = "CASE WHEN CAST(user_id AS BIGINT) % 7 <> 0 THEN user_id END"

SQL["velocity_null_users"] = f"""WITH {POSTS_CTE},
n AS (SELECT content_id, {NULL_USERS} AS user_id, ts FROM posts)
SELECT content_id, user_id,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)
    AS posts_last_24h
FROM n"""

SQL["prior_violations_null_users"] = f"""WITH {REVIEWED_CTE},
n AS (SELECT content_id, {NULL_USERS} AS user_id, ts, action FROM audit)
SELECT content_id, user_id,
  CAST(coalesce(sum(CASE WHEN action IN ('auto_remove', 'flag_for_review') THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, content_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    AS prev_violations
FROM n"""

SQL["account_age_null_users"] = f"""WITH {POSTS_CTE},
n AS (SELECT content_id, {NULL_USERS} AS user_id, ts FROM posts)
SELECT content_id, user_id,
  CAST(date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id) AS DATE), CAST(ts AS DATE)) AS INTEGER)
    AS account_age_days
FROM n"""

SQL["split_null_labels"] = f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN toxic END AS toxic FROM labels),
r AS (
  SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {MD5}, doc_id) AS rn,
         count(*) OVER (PARTITION BY toxic) AS n FROM n
)
SELECT doc_id, toxic, CASE WHEN rn <= floor(n * {dbl(0.2)} + {dbl(0.5)}) THEN 'test' ELSE 'train' END AS split FROM r"""

SQL["timeline_unlisted"] = f"""WITH {REVIEWED_CTE},
n AS (SELECT a.ts, CASE e.event_type WHEN 'error' THEN 'escalate' WHEN 'signup' THEN NULL ELSE a.action END AS action
      FROM audit a JOIN ev e USING (content_id))
SELECT {HOUR} AS time,
  CAST(count_if(action = 'auto_remove') AS BIGINT) AS auto_remove,
  CAST(count_if(action = 'flag_for_review') AS BIGINT) AS flag_for_review,
  CAST(count_if(action = 'warn_user') AS BIGINT) AS warn_user,
  CAST(count_if(action = 'approved') AS BIGINT) AS approved,
  CAST(count_if(action IS NULL) AS BIGINT) AS unknown,
  CAST(count_if(action = 'escalate') AS BIGINT) AS other
FROM n WHERE ts >= {RECENT} GROUP BY 1 ORDER BY 1"""

SQL["own_user_meta"] = f"""WITH {CONTENT_CTE},
{USERS_CTE},
o AS (SELECT content_id, user_id, CASE WHEN CAST(content_id AS BIGINT) % 3 = 0 THEN CAST(content_id AS INTEGER) % 90 END AS age,
             CASE WHEN CAST(content_id AS BIGINT) % 3 = 0 AND CAST(content_id AS BIGINT) % 2 = 0 THEN 5 END AS vio FROM content)
SELECT o.content_id, coalesce(o.age, u.account_age_days, 365) AS user_account_age_days,
       coalesce(o.vio, u.prev_violations, 0) AS user_prev_violations,
       coalesce(u.posts_last_24h, 1) AS user_posts_last_24h
FROM o LEFT JOIN users u USING (user_id)"""

SQL["text_risk_repeated_ids"] = f"""WITH {CONTENT_CTE},
acc AS (SELECT content_id, text FROM content WHERE {ACCEPTED_TEXT}),
{lexicon_scores_cte('sc', 'acc')}
SELECT CASE WHEN CAST(a.content_id AS BIGINT) % 4 <> 0 THEN CAST(CAST(a.content_id AS BIGINT) % 10 AS VARCHAR) END AS content_id,
       a.text_risk_score AS risk_score
FROM sc a"""

SQL["audit_roundtrip"] = SQL["recent_window"]

SQL["late_reviews"] = f"""WITH {REVIEWED_CTE}
SELECT content_id,
  CASE WHEN route <> 'agent_review' THEN 'none' WHEN event_id % 6 = 2 THEN 'error' ELSE review_status END AS review_status,
  CASE WHEN event_id % 6 <> 2 AND review_status = 'completed' THEN 'm1' END AS agent_model,
  CASE WHEN route = 'agent_review' AND event_id % 6 <> 2 AND event_id % 10 <> 9
    THEN strftime(ts + to_minutes(event_id % 50), '%Y-%m-%dT%H:%M:%S.%f') END AS reviewed_at,
  CASE WHEN route = 'agent_review' AND event_id % 6 = 2 THEN 'flag_for_review' ELSE final_action END AS final_action
FROM dec"""

SQL["stream_velocity"] = """WITH v AS (
  SELECT event_id, user_id, ts,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS posts_last_24h
  FROM events)
SELECT CAST(event_id AS VARCHAR) AS content_id, CAST(user_id AS VARCHAR) AS user_id, posts_last_24h FROM v
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR"""

SQL["score_stats_unrounded"] = f"""WITH {REVIEWED_CTE},
raw AS (
  SELECT a.* REPLACE (least(e.value / {dbl(B.RISK_DIVISOR)}, CAST(1 AS DOUBLE)) AS risk_score)
  FROM audit a JOIN events e ON a.content_id = CAST(e.event_id AS VARCHAR))
SELECT {stats_sql(None, '')} FROM raw WHERE ts >= {AS_OF} - INTERVAL 365 DAYS"""


def _phrase_hits(term: str) -> str:
    words = term.lower().split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"len(list_filter(range(1, len(w) + 1), lambda i: {same}))"


def _phrase_score(category: str) -> str:
    total = " + ".join(f"{dbl(x)} * {_phrase_hits(t)}" for t, c, x in B.PHRASE_LEXICON if c == category)
    return r4(f"least(CAST(1 AS DOUBLE), {total})")


SQL["text_risk_phrases"] = f"""WITH {CONTENT_CTE},
acc AS (SELECT content_id, regexp_extract_all(lower(text), '{TOKEN}') w FROM content WHERE {ACCEPTED_TEXT}),
s AS (SELECT content_id, {', '.join(f'{_phrase_score(c)} AS {c}' for c in ('toxicity', 'insult', 'threat'))} FROM acc)
SELECT content_id, toxicity, insult, threat,
  {r4(' + '.join(f'{c} * {dbl(TEXT_RISK_WEIGHTS[c])}' for c in TEXT_LABELS if c in ('toxicity', 'insult', 'threat')))} AS risk_score FROM s"""

SQL["user_meta_json"] = f"""WITH {CONTENT_CTE},
{USERS_CTE},
o AS (
  SELECT content_id, user_id, text, CAST(content_id AS INTEGER) n, CAST(content_id AS INTEGER) % 7 k FROM content)
SELECT o.content_id,
  CASE WHEN {BLANK_TEXT} OR k IN (0, 1) THEN 'quarantine' ELSE 'accepted' END AS status,
  CASE WHEN {BLANK_TEXT} THEN 'blank_text' WHEN k IN (0, 1) THEN 'invalid_user_meta' END AS reason,
  coalesce(CASE WHEN k IN (3, 4, 5) THEN n % 90 END, u.account_age_days, 365) AS user_account_age_days,
  coalesce(CASE WHEN k IN (3, 4, 5) THEN n % 4 END, u.prev_violations, 0) AS user_prev_violations
FROM o LEFT JOIN users u USING (user_id)"""

SQL["audit_tail_log"] = f"""WITH {REVIEWED_CTE}
SELECT content_id, action, risk_score, strftime(ts, '%Y-%m-%dT00:00:00.000000') AS timestamp FROM audit
ORDER BY CAST(ts AS DATE) DESC, CAST(content_id AS BIGINT) % 3 DESC, CAST(content_id AS BIGINT) LIMIT 40"""

for _name, _raw in (
    ("score_stats_partials", "score_stats"), ("drift_partials", "drift_disjoint"),
    ("dashboard_partials", "dashboard_summary"), ("timeline_partials", "timeline_long"),
):
    SQL[_name] = SQL[_raw]

SQL["audit_published"] = f"""WITH {REVIEWED_CTE}
SELECT content_id, action, risk_score, timestamp FROM audit"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
