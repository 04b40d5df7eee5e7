"""The registered queries in DuckDB SQL.

DuckDB's regexes are RE2, so the patterns stand here as written, untranslated.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from promptgov.functions import patterns as P
from promptgov.operators import anomaly as A
from promptgov.operators import gate as G
from promptgov.operators import policy_rules as R
from promptgov.operators import verdicts as V
from promptgov.plans import workloads as W
from promptgov.sources.audit import ESCAPED


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(texts) -> str:
    return ", ".join(f"({i}, {lit(t)})" for i, t in enumerate(texts))


def replace_all(s: str, pattern: str, by: str) -> str:
    return f"regexp_replace({s}, {lit(pattern)}, {lit(by.replace('$1', chr(92) + '1'))}, 'g')"


def matches(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, {lit(pattern)})"


def offset(s: str, pattern: str) -> str:
    return f"strlen(regexp_extract({s}, {lit('^([' + chr(92) + 's' + chr(92) + 'S]*?)(?:' + pattern + ')')}, 1))"


# -- inputs -------------------------------------------------------------------

PLANTS = f"plant(i, s) AS (VALUES {values(W.PLANT)})"


def planted(key: str, text: str) -> str:
    return (
        f"CASE WHEN p.s IS NULL THEN {text} WHEN ({key} // {W.PLANT_EVERY}) % 2 = 0"
        f" THEN p.s || ' ' || {text} ELSE {text} || ' ' || p.s END"
    )


PROMPTS = f"""{PLANTS}, prompts AS (
    SELECT doc_id AS request_id, {W.BASE_SECOND} + doc_id AS sec,
           CASE WHEN doc_id % 17 = 0 THEN '' ELSE source END AS tenant,
           {planted('doc_id', 'text')} AS prompt
    FROM documents LEFT JOIN plant p ON doc_id % {W.PLANT_EVERY} = p.i)"""

OUTPUTS = f"""{PLANTS}, outputs AS (
    SELECT 'document' AS kind, doc_id AS id, {planted('doc_id', 'text')} AS output
    FROM documents LEFT JOIN plant p ON doc_id % {W.PLANT_EVERY} = p.i
    UNION ALL
    SELECT 'page', page_id, {planted('page_id', 'html')}
    FROM pages LEFT JOIN plant p ON page_id % {W.PLANT_EVERY} = p.i)"""

REQUESTS = f"""{PROMPTS}, bodies(i, b) AS (VALUES {values(W.BODIES)}), requests AS (
    SELECT request_id, sec, CASE WHEN request_id % 53 = 0 THEN 'GET' ELSE 'POST' END AS method, tenant,
           to_json({{'model': 'model-' || (request_id % 3)::VARCHAR, 'messages': [
               {{'role': 'system', 'content': 'Answer briefly.'}},
               {{'role': 'user', 'content': prompt}},
               {{'role': 'user', 'content': 'Thanks.'}}]}})::VARCHAR AS body
    FROM prompts
    UNION ALL
    SELECT -request_id - 1, sec, CASE WHEN request_id % 53 = 0 THEN 'GET' ELSE 'POST' END, tenant, b
    FROM prompts JOIN bodies ON request_id % {W.BODY_EVERY} = bodies.i)"""

CHATS = """requests AS (
    SELECT conv_id AS request_id, to_json({'model': 'chat', 'messages':
           list({'role': role, 'content': text} ORDER BY turn)})::VARCHAR AS body
    FROM conversations GROUP BY conv_id)"""

ASKS = """asks AS (
    SELECT event_type AS tenant, epoch_us(ts) AS us, event_id AS id, floor(value)::BIGINT AS ask,
           false AS is_reset
    FROM events)"""


# -- expressions --------------------------------------------------------------


def zero_width(s: str) -> str:
    return f"regexp_replace({s}, {lit('[' + P.ZERO_WIDTH + ']')}, '', 'g')"


def whitespace(s: str) -> str:
    spaced = replace_all(s, r"\s+", " ")
    return f"trim({spaced}, {lit(P.UNICODE_SPACE)})"


def entities(s: str) -> str:
    for entity, char in P.HTML_ENTITIES:
        for spelling in dict.fromkeys((entity, entity.upper())):
            s = f"replace({s}, {lit(spelling)}, {lit(char)})"
    return s


def control(s: str) -> str:
    spaced = replace_all(s, r"[\n\t\r]", " ")
    return replace_all(spaced, r"[\x00-\x1F\x7F-\x{9F}]", "")


def normalized(s: str) -> str:
    return control(entities(whitespace(zero_width(f"nfc_normalize({s})"))))


PII = (P.PII_EMAIL, P.PII_PHONE, P.PII_SSN, P.PII_CARD)


def redacted(s: str) -> str:
    for pattern, marker in PII:
        s = replace_all(s, pattern, marker)
    return s


def has_pii(s: str) -> str:
    return f"contains({redacted(s)}, {lit(P.PII_MARKER)})"


def masked(s: str) -> str:
    for pattern, replacement in P.SECRET_PATTERNS:
        s = replace_all(s, pattern, replacement)
    return s


def any_match(s: str, patterns) -> str:
    return "(" + " OR ".join(matches(s, p) for p in patterns) + ")"


def violation(when: str, rule: str, severity: str, message: str, position: str) -> str:
    return (
        f"CASE WHEN {when} THEN {{'Rule': {lit(rule)}, 'Severity': {lit(severity)},"
        f" 'Message': {lit(message)}, 'Position': ({position})::INTEGER}} END"
    )


def blocked(s: str) -> list[str]:
    out = []
    for text in W.POLICY.blocked_patterns:
        pattern = "(?i)" + P.quote_meta(text)
        out.append(violation(matches(s, pattern), "blocked_pattern", "critical",
                             P.MSG_BLOCKED + pattern, offset(s, pattern)))
    return out


def injection(s: str) -> list[str]:
    return [
        violation(matches(s, p), "prompt_injection", "critical", P.MSG_INJECTION, offset(s, p))
        for p in P.INJECTION_PATTERNS
    ]


def max_tokens(s: str) -> list[str]:
    return [violation(f"strlen({s}) // 4 > {W.POLICY.max_prompt_tokens}", "max_tokens", "warning",
                      P.MSG_MAX_TOKENS, "-1")]


def scanned(s: str) -> list[str]:
    out = [
        violation(has_pii(s), "output_pii", "critical", P.MSG_OUTPUT_PII, "0"),
        violation(any_match(s, P.LEAKAGE_PATTERNS), "prompt_leakage", "warning", P.MSG_LEAKAGE, "0"),
    ]
    for rule, pattern in P.DANGEROUS_PATTERNS:
        out.append(violation(matches(s, pattern), rule, "warning", P.MSG_DANGEROUS + rule, "0"))
    return out


def present(candidates: list[str]) -> str:
    return f"list_filter([{', '.join(candidates)}], lambda x: x IS NOT NULL)"


def exploded(source: str, key: str, found: str, position: bool = True) -> str:
    """One row per violation, numbered from 0 within its list."""
    fields = "v.Rule AS rule, v.Severity AS severity, v.Message AS message" + (
        ", v.Position AS position" if position else "")
    return f"""found AS (SELECT {key}, {found} AS vs FROM {source}),
        numbered AS (SELECT {key}, unnest(vs) AS v, unnest(range(len(vs))) AS ordinal FROM found)
        SELECT {key}, ordinal::INTEGER AS ordinal, {fields} FROM numbered"""


# -- stateful operators -------------------------------------------------------


def bucket(asks: str, rate: int, capacity: int) -> str:
    """CTEs ending in decided(tenant, us, id, allowed, remaining): one row at a time."""
    refill = "((o.us - b.fill) // 60000000)"
    fresh = "(b.fill IS NULL)"
    topped = (
        f"(CASE WHEN {fresh} THEN {capacity} WHEN {refill} > 0"
        f" THEN least({capacity}, b.remaining + {refill} * {rate}) ELSE b.remaining END)"
    )
    return f"""ordered AS (
        SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY us, id) AS rn FROM {asks}),
    walk AS (
        SELECT tenant, 0::BIGINT AS rn, NULL::BIGINT AS us, NULL::BIGINT AS id, NULL::BIGINT AS fill,
               {capacity}::BIGINT AS remaining, NULL::BOOLEAN AS allowed
        FROM (SELECT DISTINCT tenant FROM ordered)
        UNION ALL
        SELECT o.tenant, o.rn, o.us, o.id,
               CASE WHEN o.is_reset THEN NULL WHEN {fresh} OR {refill} > 0 THEN o.us ELSE b.fill END,
               CASE WHEN o.is_reset THEN {capacity} WHEN {topped} >= o.ask THEN {topped} - o.ask
                    ELSE {topped} END,
               CASE WHEN NOT o.is_reset THEN {topped} >= o.ask END
        FROM walk b JOIN ordered o ON o.tenant = b.tenant AND o.rn = b.rn + 1),
    decided AS (SELECT tenant, us, id, allowed, remaining FROM walk WHERE rn > 0)"""


EVENT_BUCKET = f"WITH RECURSIVE {ASKS}, {bucket('asks', W.EVENT_RATE, W.EVENT_CAPACITY)}"
RESET_BUCKET = f"""WITH RECURSIVE {ASKS.replace('false AS is_reset', 'event_id % 211 = 0 AS is_reset')},
    {bucket('asks', W.EVENT_RATE, W.EVENT_CAPACITY)}"""

ANOMALY = f"""WITH {PROMPTS}, sums AS (
    SELECT request_id, tenant, strlen(prompt) AS length,
           count(*) OVER w AS n, sum(strlen(prompt)) OVER w AS total,
           sum(strlen(prompt) * strlen(prompt)) OVER w AS squares
    FROM prompts WINDOW w AS (PARTITION BY tenant ORDER BY sec, request_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
moments AS (
    SELECT *, total::DOUBLE / n::DOUBLE AS mean,
           greatest(sqrt(abs(squares::DOUBLE / n::DOUBLE
                             - (total::DOUBLE / n::DOUBLE) * (total::DOUBLE / n::DOUBLE))), 1.0) AS dev
    FROM sums),
scored AS (SELECT *, abs(length::DOUBLE - mean) / dev AS z, n >= {W.MIN_SAMPLES} AS known FROM moments),
flagged AS (
    SELECT *, known AND z > {A.Z_LIMIT} AS outlier,
           n > {W.MIN_SAMPLES} AND length > mean * {A.SPIKE_FACTOR} AND length > {A.SPIKE_BYTES} AS spike
    FROM scored)
SELECT request_id, tenant, outlier OR spike AS is_anomaly,
       CASE WHEN known THEN round(z * 100) / 100 ELSE 0.0::DOUBLE END AS score,
       CASE WHEN spike THEN {lit(A.MSG_SPIKE)} WHEN outlier AND length > mean THEN {lit(A.MSG_LONGER)}
            WHEN outlier THEN {lit(A.MSG_SHORTER)} ELSE '' END AS reason,
       length::INTEGER AS prompt_length,
       CASE WHEN known THEN round(mean) ELSE 0.0::DOUBLE END AS mean_length,
       CASE WHEN known THEN round(dev * 10) / 10 ELSE 0.0::DOUBLE END AS std_dev
FROM flagged"""

_LIMITS = ", ".join(f"({i}, {lit(r.tenant)}, {r.tokens_per_minute}, {r.requests_per_minute})"
                    for i, r in enumerate(W.EVENT_LIMITS))
LIMITED = f"""limits(ordinal, tenant, tpm, rpm) AS (VALUES {_LIMITS}),
    limited AS (
        SELECT event_type AS tenant, epoch_us(ts) AS us, event_id AS id, floor(value)::BIGINT AS ask, false AS is_reset,
               coalesce(own, rest) AS l, epoch_us(ts) // 60000000 AS minute
        FROM events LEFT JOIN (SELECT tenant, arg_min({{'tpm': tpm, 'rpm': rpm}}, ordinal) AS own FROM limits GROUP BY tenant) o
             ON o.tenant = event_type,
             (SELECT arg_min({{'tpm': tpm, 'rpm': rpm}}, (tenant <> '', ordinal)) AS rest FROM limits) r),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant, minute ORDER BY us, id) AS number FROM limited)"""
OWN_BUCKET = bucket("limited", "o.l.tpm", f"(o.l.tpm * {W.EVENT_BURST})").replace(
    f"(o.l.tpm * {W.EVENT_BURST})::BIGINT AS remaining", "0::BIGINT AS remaining")

_MODEL = f"{list(W.MODELS)!r}[event_id % {len(W.MODELS)} + 1]"
SPENT = f"""usage AS (
        SELECT event_id AS request_id, epoch_us(ts) AS us, date_trunc('month', ts)::DATE AS month, {_MODEL} AS model,
               (CASE WHEN event_id % 3 = 0 THEN {W.HOT_TENANT} ELSE user_id END)::VARCHAR AS tenant,
               floor(value)::BIGINT AS tokens
        FROM events),
    prices AS (
        SELECT {list(W.MODELS[:-1])!r}[p_partkey % {len(W.MODELS) - 1} + 1] AS model,
               ({W.BASE_SECOND} + p_partkey * 3600) * 1000000 AS since, round(p_retailprice * 100)::BIGINT AS nanos
        FROM part),
    budgets AS (
        SELECT c_custkey::VARCHAR AS tenant, round(c_acctbal / 1000000 * 1000000000)::BIGINT AS limit_nanos,
               CASE WHEN c_custkey % 104 > 0 THEN (round(c_acctbal / 1000000 * 1000000000)::BIGINT * (c_custkey % 104) + 99)
                    // 100 END AS alert_nanos
        FROM customer WHERE c_acctbal > 0 AND c_custkey % 104 <= 100),
    costs AS (SELECT u.*, tokens * nanos AS cost_nanos
              FROM usage u ASOF LEFT JOIN prices p ON u.model = p.model AND u.us >= p.since),
    spent AS (
        SELECT *, (sum(coalesce(cost_nanos, 0)) OVER (PARTITION BY tenant, month ORDER BY us, request_id))::BIGINT AS spend_nanos
        FROM costs LEFT JOIN budgets USING (tenant))"""
_STATUS = """CASE WHEN limit_nanos IS NULL THEN 'no_budget' WHEN spend_nanos > limit_nanos THEN 'exceeded'
                  WHEN spend_nanos >= alert_nanos THEN 'alert' ELSE 'ok' END AS status"""
_READABLE = [(i, r) for i, r in enumerate(W.ROUTES) if "about" not in r.condition]
ROUTED = " ".join(
    f"WHEN {r.condition.replace('&&', 'AND').replace('==', '=').replace('prompt_tokens', 't') or 'true'} THEN {{'i': {i}, 'm': {lit(r.model)}}}"
    for i, r in _READABLE)

# -- requests and decisions ---------------------------------------------------

EMPTY = "[]::STRUCT(Rule VARCHAR, Severity VARCHAR, Message VARCHAR, Position INTEGER)[]"


def parsed(requests: str) -> str:
    """CTEs ending in parsed(..., valid, model, prompt)."""

    def text(value: str, path: str) -> str:
        return f"coalesce(json_type({value}, '{path}') IN ('VARCHAR', 'NULL'), true)"

    return f"""typed AS (
        SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM {requests}),
    parsed AS (
        SELECT * EXCLUDE (j), valid AS valid,
               CASE WHEN valid THEN coalesce(j->>'$.model', '') END AS model,
               CASE WHEN valid THEN coalesce(list_aggregate(list_transform(
                    list_filter(items, lambda m: m->>'$.role' = 'user'),
                    lambda m: coalesce(m->>'$.content', '') || chr(10)), 'string_agg', ''), '') END AS prompt
        FROM (SELECT *, coalesce(
                  json_type(j) IN ('OBJECT', 'NULL') AND {text('j', '$.model')}
                  AND coalesce(json_type(j, '$.messages') IN ('ARRAY', 'NULL'), true)
                  AND len(list_filter(coalesce(items, []), lambda m: NOT (json_type(m) IN ('OBJECT', 'NULL')
                      AND {text('m', '$.role')} AND {text('m', '$.content')}))) = 0, false) AS valid
              FROM (SELECT *, CASE WHEN json_type(j, '$.messages') = 'ARRAY'
                              THEN (j->'$.messages')::JSON[] ELSE []::JSON[] END AS items FROM typed)))"""


ALL_VERDICTS = """verdicts AS (
    SELECT doc_id AS request_id, doc_id % 3 <> 0 AS allowed,
           CASE doc_id % 5
               WHEN 0 THEN []::STRUCT("rule" VARCHAR, severity VARCHAR, message VARCHAR)[]
               WHEN 1 THEN [{'rule': 'role_play', 'severity': 'critical', 'message': 'plays a part'},
                            {'rule': 'weather_talk', 'severity': '', 'message': 'no weather here'}]
               WHEN 2 THEN [{'rule': 'weather_talk', 'severity': NULL::VARCHAR, 'message': NULL::VARCHAR}]
           END AS reasons
    FROM documents)"""
VERDICTS = ALL_VERDICTS.replace("FROM documents)", "FROM documents WHERE doc_id % 13 <> 0)")

RAILS = f"""CASE WHEN allowed THEN {EMPTY}
    WHEN coalesce(len(reasons), 0) > 0 THEN list_transform(reasons, lambda r: {{
        'Rule': {lit(V.RULE_PREFIX)} || r."rule",
        'Severity': coalesce(nullif(r.severity, ''), {lit(V.DEFAULT_SEVERITY)}),
        'Message': coalesce(nullif(r.message, ''), {lit(V.MSG_RAIL)} || r."rule"), 'Position': 0::INTEGER}})
    ELSE [{{'Rule': {lit(V.RULE_PREFIX + 'unspecified')}, 'Severity': {lit(V.DEFAULT_SEVERITY)},
            'Message': {lit(V.MSG_UNSPECIFIED)}, 'Position': 0::INTEGER}}] END"""

# Materialised, for the steps below read the texts several times.
GATE = f"""WITH RECURSIVE {REQUESTS},
{parsed('(SELECT * REPLACE (CASE WHEN method = ' + lit('POST') + ' THEN body END AS body) FROM requests)')},
scored AS MATERIALIZED (
    SELECT request_id, sec, tenant, model, coalesce(prompt, '') AS prompt,
           CASE WHEN method <> 'POST' THEN 'passed_method' WHEN NOT valid THEN 'passed_body' END AS passed
    FROM parsed),
asks AS (
    SELECT tenant, sec * 1000000 AS us, request_id AS id, strlen(prompt) // 4 AS ask, false AS is_reset
    FROM scored WHERE passed IS NULL AND tenant <> ''),
{bucket('asks', W.POLICY.bucket_rate, W.POLICY.bucket_capacity)},
norms AS MATERIALIZED (SELECT request_id, {normalized('prompt')} AS n FROM scored),
{VERDICTS},
rails AS (SELECT request_id, {RAILS} AS rail_violations FROM verdicts),
flags AS (
    SELECT s.*, coalesce(d.allowed, true) AS in_budget,
           {present(blocked('n') + injection('n') + max_tokens('n'))} AS checks,
           coalesce(rail_violations, {EMPTY}) AS rail_violations, {has_pii('prompt')} AS has_pii
    FROM scored s JOIN norms USING (request_id) LEFT JOIN decided d ON d.id = s.request_id
         LEFT JOIN rails USING (request_id)),
outcomes AS (
    SELECT *, CASE WHEN passed IS NOT NULL THEN passed
                   WHEN NOT in_budget THEN 'rate_limited'
                   WHEN len(checks) > 0 THEN 'policy_violation'
                   WHEN len(rail_violations) > 0 THEN 'rails_violation'
                   WHEN has_pii THEN 'pii_detected' ELSE 'allowed' END AS outcome
    FROM flags),
decisions AS MATERIALIZED (
    SELECT request_id, tenant, coalesce(model, '') AS model, outcome, violations,
           CASE WHEN outcome = 'allowed' THEN 'allowed' WHEN passed IS NULL THEN 'blocked' END AS action,
           CASE WHEN len(violations) > 0 THEN violations[1].Message
                WHEN outcome = 'rate_limited' THEN {lit(G.MSG_RATE)}
                WHEN outcome = 'pii_detected' THEN {lit(G.MSG_PII)} ELSE '' END AS reason
    FROM (SELECT *, CASE outcome WHEN 'policy_violation' THEN checks
                    WHEN 'rails_violation' THEN rail_violations ELSE {EMPTY} END AS violations
          FROM outcomes)),
events AS (SELECT * FROM decisions WHERE action IS NOT NULL),
classified AS (
    SELECT *, CASE WHEN action = 'allowed' THEN 'allowed' WHEN outcome = 'rate_limited' THEN 'rate_limited'
                   ELSE 'blocked' END AS class,
           CASE WHEN action = 'allowed' THEN NULL WHEN len(violations) > 0 THEN violations[1].Rule
                WHEN outcome = 'pii_detected' THEN 'pii_redaction'
                WHEN outcome = 'rate_limited' THEN 'rate_limited' ELSE 'unknown' END AS rule
    FROM events)"""

COUNTERS = """count(*) FILTER (class = 'allowed') AS allowed, count(*) FILTER (class = 'blocked') AS blocked,
    count(*) FILTER (class = 'rate_limited') AS rate_limited"""


_MILD = f"s.sec >= {W.BASE_SECOND + W.MILD_AFTER}"
_ALL = present(blocked('n') + injection('n') + max_tokens('n'))
_FEW = present([v for e, v in zip(W.POLICY.blocked_patterns, blocked('n'), strict=True) if e in W.MILD.blocked_patterns])
REPLAY = GATE.replace(_ALL, f"CASE WHEN {_MILD} THEN {_FEW} ELSE {_ALL} END").replace(
    f"{has_pii('prompt')} AS has_pii", f"NOT {_MILD} AND {has_pii('prompt')} AS has_pii")


def escaped(s: str) -> str:
    for char, escape in ESCAPED.items():
        s = f"replace({s}, {lit(char)}, {lit(escape)})"
    return s


AUDIT_JSON = escaped("""
    '{"model":' || to_json(model) || ',"tenant":' || to_json(tenant) || ',"action":' || to_json(action)
    || CASE WHEN reason <> '' THEN ',"reason":' || to_json(reason) ELSE '' END
    || CASE WHEN len(violations) > 0 THEN ',"violations":' || to_json(violations) ELSE '' END || '}'""")

ERRORS = ", ".join(
    f"({lit(o)}, {status}, {lit(message)}, {'NULL' if kind is None else lit(kind)}, "
    f"{'NULL' if code is None else lit(code)})"
    for o, (status, message, kind, code) in G.ERRORS.items()
)

BUDGET_ERROR = f"""CASE WHEN tenant = '' THEN {lit(R.MSG_NO_TENANT)}
    WHEN monthly_limit_usd <= 0 THEN {lit(R.MSG_LIMIT)} || '"' || tenant || '"'
    WHEN alert_at_percent NOT BETWEEN 0 AND 100 THEN {lit(R.MSG_ALERT)} || '"' || tenant || '"' END"""
RATE_ERROR = f"CASE WHEN tokens_per_minute <= 0 THEN {lit(R.MSG_RATE)} END"

POLICIES = """budgets AS (
    SELECT c_nationkey AS policy_id, c_custkey AS ordinal,
           CASE WHEN c_custkey % 41 = 0 THEN '' ELSE c_name END AS tenant,
           c_acctbal + 900 AS monthly_limit_usd, (c_custkey % 104)::INTEGER AS alert_at_percent
    FROM customer),
limits AS (
    SELECT s_nationkey AS policy_id, s_suppkey AS ordinal, s_name AS tenant,
           floor(s_acctbal)::INTEGER AS tokens_per_minute FROM supplier),
security AS (
    SELECT n_nationkey AS policy_id, CASE WHEN n_nationkey % 6 = 0 THEN -1 ELSE 2000 END AS max_prompt_tokens
    FROM nation)"""


def _output(column: str, name: str) -> str:
    return f"WITH {OUTPUTS} SELECT kind, id, {column} AS {name} FROM outputs"


def _prompt(column: str, name: str) -> str:
    return f"WITH {PROMPTS} SELECT request_id, {column} AS {name} FROM prompts"


def _checks(found: list[str]) -> str:
    return (
        f"WITH {PROMPTS}, norms AS MATERIALIZED (SELECT request_id, {normalized('prompt')} AS n FROM prompts), "
        + exploded("norms", "request_id", present(found))
    )


# What regexes give a meaning to, and how it is quoted.
META, QUOTED = r"([\\.+*?()|\[\]{}^$])", r"\\\1"


def _folded(s: str) -> str:
    return f"replace(lower({s}), '\u017f', 's')"


def oracles() -> dict[str, str]:
    s = W.POLICY
    everything = blocked("n") + injection("n") + max_tokens("n")
    script, handler = P.SCRIPT_BLOCK, P.EVENT_HANDLER
    first_limit = s.rate_limits[0]
    budgets = ", ".join(f"({i}, {lit(b.tenant)}, {b.monthly_limit_usd}, {b.alert_at_percent})"
                        for i, b in enumerate(s.budgets))
    out = {
        # Sources, projections
        "parse_requests": f"""WITH {REQUESTS}, {parsed('requests')}
            SELECT request_id, valid, model, prompt FROM parsed""",
        "extract_prompt": f"""WITH {CHATS}, {parsed('requests')}
            SELECT request_id, prompt FROM parsed""",
        "policy_tables": f"""WITH budgets(ordinal, tenant, monthly_limit_usd, alert_at_percent) AS (
                VALUES {budgets})
            SELECT source AS tenant, count(*) AS requests, any_value(monthly_limit_usd)::DOUBLE
                   AS monthly_limit_usd, any_value(alert_at_percent)::INTEGER AS alert_at_percent,
                   {first_limit.tokens_per_minute}::INTEGER AS tokens_per_minute
            FROM documents LEFT JOIN budgets ON tenant = source GROUP BY source""",
        "estimate_tokens": _prompt("(strlen(prompt) // 4)::INTEGER", "tokens"),
        "tenant_label": f"""WITH {PROMPTS} SELECT coalesce(nullif(tenant, ''), '_anonymous') AS tenant,
            count(*) AS requests FROM prompts GROUP BY 1""",
        "count_words": _prompt(
            "len(list_filter(regexp_split_to_array(prompt, '[ \\n\\t]+'), lambda w: w <> ''))::INTEGER", "words"),
        # Normalisation
        "norm_nfc": _prompt("nfc_normalize(prompt)", "normalized"),
        "norm_zero_width": _prompt(zero_width("prompt"), "normalized"),
        "norm_whitespace": _prompt(whitespace("prompt"), "normalized"),
        "norm_html_entities": _output(entities("output"), "normalized"),
        "norm_control": _prompt(control("prompt"), "normalized"),
        "normalize_input": _output(normalized("output"), "normalized"),
        # Checks
        "check_blocked": _checks(blocked("n")),
        "check_deny_list": f"""WITH {PROMPTS}, norms AS MATERIALIZED (
                SELECT request_id, {normalized('prompt')} AS n FROM prompts),
            low AS (SELECT *, {_folded('n')} AS l FROM norms),
            listed(entry, part, i) AS (
                VALUES {", ".join(f"({lit(e)}, 0, {i})" for i, e in enumerate(s.blocked_patterns))} UNION ALL
                SELECT translate(substr(text, 1, 30), '{ascii_lowercase}', '{ascii_uppercase}'), 1, item_id FROM benchmark WHERE text IS NOT NULL UNION ALL
                SELECT p_name, 2, p_partkey FROM part WHERE p_name IS NOT NULL),
            entries AS (SELECT entry, {_folded('entry')} AS e, row_number() OVER (ORDER BY part, i) AS o FROM listed),
            found AS (SELECT request_id, o, n, l, e, entry FROM low JOIN entries ON contains(l, e))
            SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY o) - 1)::INTEGER AS ordinal,
                   'blocked_pattern' AS rule, 'critical' AS severity,
                   {lit(P.MSG_BLOCKED)} || '(?i)' || regexp_replace(entry, {lit(META)}, {lit(QUOTED)}, 'g') AS message,
                   strlen(left(n, strpos(l, e) - 1))::INTEGER AS position
            FROM found""",
        "check_injection": _checks(injection("n")),
        "check_max_tokens": _checks(max_tokens("n")),
        "check_prompt": _checks(everything),
        "is_clean": f"""WITH {PROMPTS},
            norms AS MATERIALIZED (SELECT request_id, {normalized('prompt')} AS n FROM prompts)
            SELECT request_id, len({present(everything)}) = 0 AS is_clean FROM norms""",
        "violation_position": f"""WITH {PROMPTS}, norms AS MATERIALIZED (
                SELECT request_id, {normalized('prompt')} AS n FROM prompts),
            found AS (SELECT request_id, n, unnest({present(blocked('n') + injection('n'))}) AS v FROM norms)
            SELECT request_id, min(v.Position)::INTEGER AS first_position,
                   max(v.Position)::INTEGER AS last_position FROM found GROUP BY request_id""",
        # Personal data
        "redact_email": _output(replace_all("output", *P.PII_EMAIL), "redacted"),
        "redact_phone": _output(replace_all("output", *P.PII_PHONE), "redacted"),
        "redact_ssn": _output(replace_all("output", *P.PII_SSN), "redacted"),
        "redact_card": _output(replace_all("output", *P.PII_CARD), "redacted"),
        "redact_pii": _output(redacted("output"), "redacted"),
        "contains_pii": _output(has_pii("output"), "has_pii"),
        "redact_output": f"""WITH {OUTPUTS}, r AS (SELECT *, {redacted('output')} AS redacted FROM outputs)
            SELECT kind, id, redacted, redacted <> output AS changed FROM r""",
        # Responses and secrets
        "scan_output": f"WITH {OUTPUTS}, " + exploded("outputs", "kind, id", present(scanned("output")), False),
        "is_output_clean": _output(f"len({present(scanned('output'))}) = 0", "is_clean"),
        "sanitize_scripts": _output(replace_all("output", *script), "sanitized"),
        "sanitize_handlers": _output(replace_all("output", *handler), "sanitized"),
        "sanitize_output": _output(
            replace_all(replace_all(redacted("output"), *script), *handler), "sanitized"),
        "contains_secrets": _output(any_match("output", [p for p, _ in P.SECRET_PATTERNS]), "has_secrets"),
        "mask_secrets": _output(masked("output"), "masked"),
        # State per tenant
        "token_bucket": f"{EVENT_BUCKET} SELECT tenant, id AS request_id, allowed, remaining FROM decided",
        "bucket_reset": f"{RESET_BUCKET} SELECT tenant, id AS request_id, allowed, remaining FROM decided",
        "bucket_remaining": f"""{EVENT_BUCKET}, tenants AS (
                SELECT event_type AS tenant FROM events UNION SELECT source FROM documents),
            last AS (SELECT tenant, arg_max(remaining, (us, id)) AS remaining FROM decided GROUP BY tenant)
            SELECT tenant, coalesce(remaining, {W.EVENT_CAPACITY})::BIGINT AS remaining
            FROM tenants LEFT JOIN last USING (tenant)""",
        "rate_limit_gate": f"""WITH RECURSIVE {PROMPTS}, asks AS (
                SELECT tenant, sec * 1000000 AS us, request_id AS id, strlen(prompt) // 4 AS ask,
                       false AS is_reset FROM prompts WHERE tenant <> ''),
            {bucket('asks', s.bucket_rate, s.bucket_capacity)}
            SELECT request_id, p.tenant, coalesce(allowed, true) AS allowed, remaining
            FROM prompts p LEFT JOIN decided ON id = request_id""",
        "rpm_exceeded": f"""WITH {LIMITED} SELECT id AS request_id, tenant, minute, l.rpm::INTEGER AS requests_per_minute,
            number, l.rpm > 0 AND number > l.rpm AS rpm_exceeded FROM numbered""",
        "rpm_windows": f"""WITH {LIMITED} SELECT tenant, minute, count(*) AS requests, max(l.rpm)::INTEGER AS requests_per_minute,
                count(*) - max(l.rpm) AS over
            FROM numbered GROUP BY tenant, minute HAVING max(l.rpm) > 0 AND count(*) > max(l.rpm)""",
        "own_limit_gate": f"""WITH RECURSIVE {LIMITED}, {OWN_BUCKET}
            SELECT tenant, id AS request_id, allowed, remaining FROM decided""",
        "running_spend": f"""WITH {SPENT} SELECT request_id, tenant, cost_nanos, spend_nanos, {_STATUS} FROM spent""",
        "budget_status": f"""WITH {SPENT}, total AS (
                SELECT tenant, month::VARCHAR AS month, count(*) AS requests, count(*) FILTER (cost_nanos IS NULL) AS unpriced,
                       max(spend_nanos) AS spend_nanos, max(limit_nanos) AS limit_nanos, max(alert_nanos) AS alert_nanos,
                       arg_min(request_id, (us, request_id)) FILTER (spend_nanos >= alert_nanos) AS alert_request,
                       min(us) FILTER (spend_nanos >= alert_nanos) AS alert_ts,
                       arg_min(request_id, (us, request_id)) FILTER (spend_nanos > limit_nanos) AS exceeded_request,
                       min(us) FILTER (spend_nanos > limit_nanos) AS exceeded_ts
                FROM spent GROUP BY tenant, month)
            SELECT *, {_STATUS} FROM total""",
        "route_model": f"""WITH {PROMPTS}, sized AS (SELECT request_id, (strlen(prompt) // 4)::INTEGER AS t FROM prompts),
            routed AS (SELECT *, CASE {ROUTED} END AS r FROM sized)
            SELECT request_id, t AS prompt_tokens, r.i::INTEGER AS rule, r.m AS model FROM routed""",
        "prompt_anomaly": ANOMALY,
        "tenant_profile": f"""WITH {PROMPTS}, sums AS (
                SELECT tenant, count(*) AS n, sum(strlen(prompt)) AS total,
                       sum(strlen(prompt) * strlen(prompt)) AS squares FROM prompts GROUP BY tenant)
            SELECT tenant, n AS count, round(total::DOUBLE / n::DOUBLE) AS mean_length,
                   round(sqrt(abs(squares::DOUBLE / n::DOUBLE
                         - (total::DOUBLE / n::DOUBLE) * (total::DOUBLE / n::DOUBLE))) * 10) / 10 AS std_dev
            FROM sums""",
        # Verdicts, decisions, counts
        "verdict_join": f"""WITH {PROMPTS}, {VERDICTS}, rails AS (SELECT *, {RAILS} AS vs FROM verdicts)
            SELECT request_id, allowed IS NOT NULL AS reached, allowed AS rail_allowed,
                   len(vs)::INTEGER AS rail_violations
            FROM prompts LEFT JOIN rails USING (request_id)""",
        "verdicts_in_time": f"""WITH {VERDICTS}, given AS (
                SELECT request_id, request_id % 5 * 700 AS wait, allowed, reasons FROM verdicts UNION ALL
                SELECT request_id, request_id % 5 * 700 + CASE WHEN request_id % 7 = 0 THEN 100 ELSE 0 END, NOT allowed, reasons
                FROM verdicts WHERE request_id % 7 = 0 OR request_id % 11 = 0),
            rails AS (SELECT request_id, allowed, wait, {RAILS} AS vs FROM given),
            firsts AS (SELECT * FROM rails WHERE wait <= 2000 QUALIFY row_number() OVER (
                PARTITION BY request_id ORDER BY wait, allowed) = 1)
            SELECT doc_id AS request_id, allowed IS NOT NULL AS reached, allowed AS rail_allowed, len(vs)::INTEGER AS rail_violations
            FROM documents LEFT JOIN firsts ON doc_id = request_id""",
        "verdict_violations": f"WITH {ALL_VERDICTS}, " + exploded("verdicts", "request_id", RAILS),
        "verdict_outage": f"""WITH {PROMPTS}, {VERDICTS}
            SELECT request_id, tenant, 'blocked' AS action, {lit(V.MSG_UNREACHABLE)} AS reason
            FROM prompts ANTI JOIN verdicts USING (request_id)""",
        "gate_decision": f"""{GATE} SELECT request_id, tenant, model, outcome, action, reason,
            len(violations)::INTEGER AS violations FROM decisions""",
        "policy_replay": f"""{REPLAY} SELECT request_id, tenant, outcome, action, reason, len(violations)::INTEGER AS violations,
            (CASE WHEN sec >= {W.BASE_SECOND + W.MILD_AFTER} THEN 1 ELSE 0 END)::INTEGER AS policy_version
            FROM decisions JOIN (SELECT request_id, sec FROM requests) USING (request_id)""",
        "block_response": f"""{GATE}, errors(outcome, status, error_message, error_type, error_code) AS (
                VALUES {ERRORS})
            SELECT request_id, outcome, coalesce(status, 200)::INTEGER AS status, error_message, error_type,
                   CASE WHEN len(violations) > 0 THEN violations[1].Rule ELSE error_code END AS error_code
            FROM decisions LEFT JOIN errors USING (outcome)""",
        "audit_events": f"{GATE}, " + exploded(
            "(SELECT * FROM events WHERE len(violations) > 0)",
            "request_id, model, tenant, action, reason", "violations"),
        "audit_json": f"{GATE} SELECT request_id, {AUDIT_JSON} AS json FROM events",
        "audit_fanout": f"{GATE} SELECT request_id, {AUDIT_JSON} AS json, class, rule FROM classified",
        "audit_classify": f"{GATE} SELECT request_id, class, rule FROM classified",
        "stats_totals": f"""{GATE} SELECT count(*) AS total, {COUNTERS},
            (CASE WHEN count(*) > 0 THEN (count(*) FILTER (class = 'blocked'))::DOUBLE / count(*) * 100
             ELSE 0 END)::DOUBLE AS block_rate_percent FROM classified""",
        "stats_by_tenant": f"""{GATE} SELECT coalesce(nullif(tenant, ''), '_anonymous') AS tenant, {COUNTERS}
            FROM classified GROUP BY 1""",
        "violation_counts": f"""{GATE} SELECT rule, count(*) AS count FROM classified
            WHERE class <> 'allowed' GROUP BY rule""",
        # Policies
        "validate_budgets": f"""WITH {POLICIES} SELECT policy_id, ordinal, {BUDGET_ERROR} AS message
            FROM budgets""",
        "validate_rate_limits": f"""WITH {POLICIES} SELECT policy_id, ordinal, {RATE_ERROR} AS message
            FROM limits""",
        "validate_policy": f"""WITH {POLICIES}, errors AS (
                SELECT policy_id, 0 AS part, ordinal, {BUDGET_ERROR} AS message FROM budgets
                UNION ALL SELECT policy_id, 1, ordinal, {RATE_ERROR} FROM limits
                UNION ALL SELECT policy_id, 2, 0, CASE WHEN max_prompt_tokens < 0
                                                  THEN {lit(R.MSG_MAX_TOKENS)} END FROM security),
            firsts AS (SELECT policy_id, arg_min(message, (part, ordinal)) AS message
                       FROM errors WHERE message IS NOT NULL GROUP BY policy_id)
            SELECT policy_id, message IS NULL AS valid, message
            FROM security LEFT JOIN firsts USING (policy_id)""",
    }
    # A stream over the same rows must end with what the batch gives.
    out["stream_gate"] = out["audit_json"]
    out["stream_bucket"] = out["token_bucket"]
    out["stream_anomaly"] = out["prompt_anomaly"]
    out["stream_stats"] = out["stats_by_tenant"]
    out["stream_remaining"] = out["bucket_remaining"]
    out["stream_rpm"] = out["rpm_windows"]
    out["stream_verdicts"] = out["verdicts_in_time"]
    return out
