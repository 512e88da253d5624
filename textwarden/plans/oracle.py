"""The same results in plain SQL (DuckDB), for checking.

Written against the meaning of each operator, not its Spark form: RE2 patterns without the
gates, whole-text regular expressions for bulk rows, window functions instead of aggregates.
"""

from __future__ import annotations

from textwarden import fixed_values as fv
from textwarden.functions import entropy, linear, narrative
from textwarden.functions.policy import rule_rows
from textwarden.functions.regex import SPACE_CHARS, re2
from textwarden.plans.queries import BENIGN_FRAGMENTS, MANY_CONDITIONS, RULE_ACTIONS, RULE_CONDITIONS
from textwarden.sources.adapters import ACTIONS, EVENT_ACTIONS, FRAGMENTS, HOSTS, fragment_sql


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, position: str) -> str:
    return f"{names(values)}[1 + ({position}) % {len(values)}]"


def utf16(text: str) -> str:
    return f"(length({text}) + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def trim(text: str) -> str:
    return f"trim({text}, {q(SPACE_CHARS)})"


def ascii_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def half_up(value: str) -> str:
    return f"CAST(floor({value} + 0.5) AS INT)"


# --- detectors ---------------------------------------------------------------

LUHN = ("(list_sum([CASE WHEN (length(m) - i) % 2 = 0 THEN CAST(m[i] AS INT) "
        "WHEN CAST(m[i] AS INT) > 4 THEN CAST(m[i] AS INT) * 2 - 9 ELSE CAST(m[i] AS INT) * 2 END "
        "FOR i IN range(1, length(m) + 1)]) % 10 = 0)")


def extract(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_extract_all({text}, {q(re2(pattern, flags))})"


def cards(text: str) -> str:
    pattern = next(d[5] for d in fv.DETECTORS if d[0] == "CREDIT_CARD")
    return extract(text, pattern)


def count(detector, text: str = "text") -> str:
    name, _, _, _, _, pattern, flags = detector
    if name == "SSN":
        found = extract(text, r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b")
        keep = ("m[1:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000'")
        return f"len(list_filter({found}, lambda m: {keep}))"
    if name == "IBAN":
        return f"len({extract(text, r'\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}(?:[\s,;]|$)')})"
    if name == "CREDIT_CARD":
        found = cards(text)
        return f"CASE WHEN len(list_filter({found}, lambda m: {LUHN})) > 0 THEN len({found}) ELSE 0 END"
    if "1" in flags:
        return f"CAST(regexp_matches({text}, {q(re2(pattern, flags))}) AS INT)"
    found = f"len({extract(text, pattern, flags)})"
    return f"CASE WHEN {found} >= 2 THEN {found} ELSE 0 END" if name == "JS_CODE" else found


def findings(text: str = "text") -> str:
    rows = ", ".join(
        f"{{'detector': {q(d[0])}, 'label': {q(d[1])}, 'category': {q(d[2])}, 'sensitivity': {d[3]}, "
        f"'tags': {names(d[4])}, 'n': {count(d, text)}}}" for d in fv.DETECTORS)
    return f"list_filter([{rows}], lambda f: f.n > 0)"



def first_seen(array: str) -> str:
    """Distinct strings of an array, in first-seen order."""
    return f"list_filter({array}, lambda x, i: list_position({array}, x) = i)"


# --- common table expressions -------------------------------------------------

PLANTED = f"""planted AS (
  SELECT doc_id, lang, source, text || chr(10) || {fragment_sql()} AS text,
         {pick(HOSTS, 'doc_id')} AS host, {pick(ACTIONS, 'doc_id')} AS action_type FROM documents)"""

DET = f"det AS (SELECT *, {findings()} AS findings FROM planted WHERE {trim('text')} <> '')"


def density(token: str) -> str:
    return "least(100, " + " + ".join(
        f"CASE WHEN regexp_matches({token}, {q(p)}) THEN {n} ELSE 0 END" for p, n in entropy.DENSITY) + ")"


TOKENS = f"""tok AS (
  SELECT doc_id, t, i, {utf16('t')} AS size, list_entropy(string_split(t, '')) AS h, {density('t')} AS d FROM (
    SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (
      SELECT doc_id, regexp_split_to_array(text, {q(re2('[' + entropy.DELIMITERS + ']+'))}) AS ts FROM planted))
  WHERE {utf16('t')} >= 12)"""

SECRETS = f"""sec AS (
  SELECT doc_id, i, left(t, 6) || '***' AS token, round(h, 3) AS entropy, d AS density,
         CASE WHEN size >= 40 AND regexp_matches(t, {q(re2(entropy.HEX))}) THEN 'HIGH_ENTROPY_HEX_TOKEN'
              WHEN size >= 32 AND regexp_matches(t, {q(re2(entropy.BASE64))}) THEN 'BASE64_ENCODED_BLOB'
              WHEN h >= 4.2 AND d >= 40 THEN 'HIGH_ENTROPY (H=' || printf('%.2f', h) || ', Density=' || d || ')' END AS reason,
         size AS length FROM tok),
secrets AS (SELECT * FROM sec WHERE reason IS NOT NULL),
nsec AS (SELECT doc_id, count(*) AS secrets FROM secrets GROUP BY 1)"""


def _narrative_rows() -> str:
    return ", ".join(
        f"{{'id': {q(name)}, 'category': {q(category)}, 'weight': {weight}, 'tags': {names(tags)}, "
        f"'n': len({extract('text', pattern, 'i')})}}"
        for name, _, category, weight, tags, pattern in fv.INDICATORS)


NARRATIVE = f"""nar0 AS (
  SELECT *, CASE WHEN {utf16(trim('text'))} >= {narrative.MIN_TEXT}
    THEN list_filter([{_narrative_rows()}], lambda f: f.n > 0) ELSE [] END AS narr FROM det),
nar AS (SELECT *, coalesce(list_sum(list_transform(narr, lambda f: f.weight * least(f.n, 2))), 0) AS nweight FROM nar0),
narrated AS (SELECT *, len(narr) >= 2 OR nweight >= {narrative.DETECT_WEIGHT} AS ndetected FROM nar)"""

_FEATURES = ", ".join(
    f"{{'i': {r['i']}, 'f': {q(r['feature'])}, 'p': {q(r['needle'])}, 'w': {r['weight']}::DOUBLE, 'c': {r['factor']!r}::DOUBLE}}"
    for r in linear.feature_rows())

FEATURES = f"""feat AS (
  SELECT doc_id, i, f AS feature, w AS weight, n, c * ln(1 + n) AS contribution FROM (
    SELECT doc_id, u.i AS i, u.f AS f, u.w AS w, u.c AS c,
           CAST((strlen(low) - strlen(replace(low, u.p, ''))) / strlen(u.p) AS INT) AS n
    FROM (SELECT doc_id, lower(text) AS low, unnest([{_FEATURES}]) AS u FROM planted)) WHERE n > 0)"""

LINEAR = f"""lin0 AS (
  SELECT d.doc_id, {utf16('d.text')} AS text_length, {fv.LINEAR_BIAS} + coalesce(sum(contribution), 0) AS raw
  FROM planted d LEFT JOIN feat USING (doc_id) GROUP BY 1, 2),
lin1 AS (SELECT doc_id, text_length, 1 / (1 + exp(-(CASE WHEN text_length > {linear.LONG_TEXT}
  AND raw < {fv.LINEAR_BIAS + 1} THEN raw - {linear.LONG_PENALTY} ELSE raw END))) AS p FROM lin0),
lin AS (SELECT doc_id, text_length, round(p, 4) AS probability, p >= 0.5 AS sensitive,
  CASE WHEN p >= 0.8 THEN 'HIGH' WHEN p >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN p >= 0.5 THEN least(100, {half_up('40 + (p - 0.5) * 120')})
       WHEN p >= 0.3 THEN {half_up('(p - 0.3) * 200')} ELSE 0 END AS sensitivity_score FROM lin1),
topf AS (SELECT doc_id, string_agg(CASE WHEN length(feature) > 24 THEN left(feature, 24) || '…' ELSE feature END, '|'
  ORDER BY rk) AS features FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY contribution DESC, i) AS rk
  FROM feat WHERE weight > 0 AND contribution > 0.05) WHERE rk <= 5 GROUP BY 1)"""

SIGNALS = ",\n".join([PLANTED, DET, TOKENS, SECRETS, NARRATIVE, FEATURES, LINEAR, f"""sig AS (
  SELECT n.doc_id, l.text_length, left(sha256(n.text), 16) AS sha256_prefix, n.findings, n.narr, n.ndetected, n.nweight,
    coalesce(s.secrets, 0) AS secrets, l.probability, l.sensitive, l.confidence, l.sensitivity_score, t.features,
    list_concat({first_seen('list_transform(n.findings, lambda f: f.category)')},
                {first_seen('list_transform(n.narr, lambda f: f.category)')}) AS categories,
    list_concat(flatten(list_transform(n.findings, lambda f: f.tags)),
                flatten(list_transform(n.narr, lambda f: f.tags))) AS tags0,
    greatest(coalesce(list_max(list_transform(n.findings, lambda f: f.sensitivity)), 0),
      CASE WHEN n.ndetected THEN least(95, greatest(65, n.nweight)) ELSE 0 END,
      CASE WHEN coalesce(s.secrets, 0) > 0 THEN least(100, 70 + 10 * s.secrets) ELSE 0 END,
      CASE WHEN l.sensitive AND l.confidence <> 'LOW' THEN l.sensitivity_score ELSE 0 END) AS s
  FROM narrated n JOIN lin l USING (doc_id) LEFT JOIN nsec s USING (doc_id) LEFT JOIN topf t USING (doc_id)),
signals AS (SELECT *,
    CASE WHEN sensitive AND features IS NOT NULL THEN list_append(tags0, 'ML_SENSITIVE') ELSE tags0 END AS policy_tags,
    list_concat(list_concat(tags0, CASE WHEN secrets > 0 THEN ['HIGH_ENTROPY_SECRET'] ELSE [] END),
                CASE WHEN sensitive THEN ['ML_SENSITIVE'] ELSE [] END) AS all_tags FROM sig)"""])


def root_domain(host: str) -> str:
    bare = f"regexp_replace(lower({host}), '^www\\.', '')"
    parts = f"string_split({bare}, '.')"
    return f"CASE WHEN len({parts}) >= 2 THEN array_to_string({parts}[-2:], '.') ELSE lower({host}) END"


def tier(host: str, root: str, approved=(), restricted=()) -> str:
    def listed(domains) -> str:
        return f"({host} IN ({', '.join(q(d) for d in domains)}) OR {root} IN ({', '.join(q(d) for d in domains)}))"

    internal = "(?i)" + "|".join(fv.INTERNAL_HOSTS)
    managed = f"WHEN {listed(approved)} THEN 'APPROVED_AI'" if approved else ""
    return (f"CASE WHEN regexp_matches({host}, {q(internal)}) THEN 'INTERNAL' "
            f"WHEN {listed([*fv.SUSPICIOUS_DOMAINS, *restricted])} THEN 'SUSPICIOUS' {managed} "
            f"WHEN {listed(fv.EXTERNAL_AI_DOMAINS)} THEN 'EXTERNAL_AI' "
            f"WHEN {listed(fv.APPROVED_AI_DOMAINS)} THEN 'APPROVED_AI' "
            f"WHEN {listed(fv.APPROVED_SAAS_DOMAINS)} THEN 'APPROVED_SAAS' ELSE 'UNKNOWN_SAAS' END")


def by_tier(column: str, position: int) -> str:
    cases = " ".join(
        f"WHEN '{t}' THEN {q(v[position]) if isinstance(v[position], str) else v[position]}" for t, v in fv.TIERS.items())
    return f"CASE {column} {cases} END"


EXTERNAL = "tier IN ('EXTERNAL_AI', 'UNKNOWN_SAAS', 'SUSPICIOUS')"


def judged(source: str, keys: str) -> str:
    """CTEs from ``source`` (signals with host and action_type) to ``judged``."""
    actions = " ".join(f"WHEN '{a}' THEN {n}" for a, n in fv.ACTION_SCORES.items())
    steps = " ".join(f"WHEN text_length <= {a} THEN {b}" for a, b in fv.VOLUME_STEPS)
    business = names(["FINANCIAL", "FINANCIAL_PROJECTION", "STRATEGIC_BUSINESS", "CONFIDENTIAL_PROJECT"])
    w = fv.RISK_WEIGHTS
    full = " + ".join(f"{c} * {w[c.upper()]}::DOUBLE" for c in "sdvac")
    quiet = half_up("d * 0.04::DOUBLE + v * 0.05::DOUBLE")
    return f"""j1 AS (SELECT *, {tier('host', root_domain('host'))} AS tier FROM {source}),
j2 AS (SELECT *, {by_tier('tier', 0)} AS d, CASE {steps} ELSE {fv.VOLUME_TOP} END AS v,
  CASE action_type {actions} ELSE {fv.ACTION_OTHER} END AS a,
  CASE WHEN {EXTERNAL} AND list_contains(categories, 'CREDENTIAL') THEN 100
       WHEN {EXTERNAL} AND list_has_any(categories, {business}) THEN 90
       WHEN {EXTERNAL} AND list_contains(categories, 'PII') THEN 80
       WHEN tier = 'SUSPICIOUS' THEN 95 WHEN tier IN ('INTERNAL', 'APPROVED_AI') THEN 20 ELSE 30 END AS c FROM j1),
j3 AS (SELECT *, CASE WHEN s = 0 THEN least(10, {quiet}) ELSE least(100, {half_up(full)}) END AS risk_score FROM j2),
j4 AS (SELECT *, CASE WHEN risk_score <= 25 THEN 'ALLOW' WHEN risk_score <= 59 THEN 'WARN' ELSE 'BLOCK' END AS risk_decision,
  len(categories) = 0 AND len(policy_tags) = 0 AS clean FROM j3),
rules AS ({{rules}}),
hit AS (SELECT {keys}, r.* FROM j4 LEFT JOIN rules r ON NOT clean
    AND (len(r.categories) = 0 OR list_has_any(r.categories, j4.categories))
    AND (len(r.tags) = 0 OR list_has_any(r.tags, j4.policy_tags))
    AND (len(r.tiers) = 0 OR list_contains(r.tiers, j4.tier))
    AND (r.max_risk IS NULL OR j4.risk_score <= r.max_risk)
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY r.rank, r.source, r.ord) = 1),
judged AS (SELECT j4.*, coalesce(hit.action, CASE WHEN clean THEN 'ALLOW' ELSE risk_decision END) AS final_decision,
  hit.id AS policy_id, hit.name AS policy_name, coalesce(hit.action <> risk_decision, false) AS policy_override,
  CASE WHEN clean THEN {q(fv.CLEAN_REASON)} WHEN hit.id IS NOT NULL THEN hit.reason
       ELSE 'Risk score ' || risk_score || '/100 — no explicit policy rule matched.' END AS reason
  FROM j4 JOIN hit USING ({keys}))"""


def _rule_values() -> str:
    rows = []
    for r in rule_rows():
        rows.append(
            f"SELECT {r['rank']} AS rank, {r['source']} AS source, {r['ord']} AS ord, {q(r['id'])} AS id, {q(r['name'])} AS name, "
            f"{q(r['action'])} AS action, CAST({names(r['categories'])} AS VARCHAR[]) AS categories, "
            f"CAST({names(r['tags'])} AS VARCHAR[]) AS tags, CAST({names(r['tiers'])} AS VARCHAR[]) AS tiers, "
            f"CAST({'NULL' if r['max_risk'] is None else r['max_risk']} AS DOUBLE) AS max_risk, {q(r['reason'])} AS reason")
    return " UNION ALL ".join(rows)


BUILT_IN = _rule_values()
_STORE = "SELECT CAST({key} AS BIGINT) AS id, 'Rule ' || {name} AS name, {conditions} AS conditions, {action} AS action, CAST({key} % 2 AS INT) AS enabled FROM {table}"


def store(table: str, key: str, name: str) -> str:
    return _STORE.format(table=table, key=key, name=name, conditions=RULE_CONDITIONS.format(key=key),
                         action=RULE_ACTIONS.format(key=key))


def condition(field: str, kind: str = "VARCHAR[]") -> str:
    return f"TRY_CAST(json_extract(conditions, '$.{field}') AS {kind})"


#: the store's rules of wrong types state the risk as text
MALFORMED = "coalesce(json_type(conditions, '$.maxRiskScore') = 'VARCHAR', false)"
MAX_RISK = f"CASE WHEN NOT {MALFORMED} THEN {condition('maxRiskScore', 'DOUBLE')} END"


def stored_rules(rules: str) -> str:
    """The built-in rules and those of a store."""
    return f"""{BUILT_IN} UNION ALL
  SELECT CASE action WHEN 'BLOCK' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, 0, id, CAST(id AS VARCHAR), name, action,
    coalesce({condition('detectedCategories')}, []), coalesce({condition('detectedTags')}, []),
    coalesce({condition('destinationTiers')}, []), {MAX_RISK}, CAST(NULL AS VARCHAR)
  FROM ({rules}) WHERE action IN ('BLOCK', 'WARN', 'ALLOW') AND NOT {MALFORMED}"""


STORED_RULES = stored_rules(store("region", "r_regionkey", "r_name"))
MANY_RULES = stored_rules(_STORE.format(
    table="part", key="p_partkey", name="p_name", conditions=MANY_CONDITIONS.format(key="p_partkey"),
    action=RULE_ACTIONS.format(key="p_partkey")))

PLACED = "placed AS (SELECT s.*, p.host, p.action_type FROM signals s JOIN planted p USING (doc_id))"


def with_verdicts(rules: str = BUILT_IN) -> str:
    return f"{SIGNALS},\n{PLACED},\n{judged('placed', 'doc_id').format(rules=rules)}"


_MAPPED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_ACTIONS.items())
LOG = f"""log AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS employee_id, 'dev-' || (user_id % 40) AS device_id,
  event_id % (SELECT count(*) FROM documents) AS doc_id, {pick(HOSTS, 'event_id')} AS host,
  CASE event_type {_MAPPED} ELSE 'unknown' END AS action_type FROM events)"""

EVENTS = f"""{SIGNALS},
{LOG},
sent AS (SELECT s.*, l.event_id, l.ts, l.employee_id, l.device_id, l.host, l.action_type FROM log l JOIN signals s USING (doc_id)),
{judged('sent', 'event_id').format(rules=BUILT_IN)},
ev AS (SELECT 'evt_' || lower(to_base((epoch_us(ts) // 1000), 36)) || '_' || event_id AS event_id, (epoch_us(ts) // 1000) AS timestamp,
  tier AS destination_category, {first_seen('all_tags')} AS detected_tags, risk_score, final_decision AS action,
  text_length AS content_length, sha256_prefix AS payload_sha256_prefix, probability AS ml_probability,
  confidence AS ml_confidence, employee_id, device_id FROM judged)"""


def from_events(select: str) -> str:
    return f"WITH {EVENTS}\n{select}"


CONVERSATIONS = f"""planted AS (SELECT conv_id || '-' || turn AS doc_id, role, text, {pick(HOSTS, 'conv_id')} AS host,
  'keystroke_typing' AS action_type FROM conversations WHERE {trim('text')} <> '')"""
PAGES = f"""planted AS (SELECT page_id AS doc_id, html AS text, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
  'paste' AS action_type FROM pages)"""


def from_verdicts(select: str) -> str:
    return f"WITH {with_verdicts()}\n{select}"


def from_signals(select: str) -> str:
    return f"WITH {SIGNALS}\n{select}"


def from_findings(select: str) -> str:
    return (f"WITH {PLANTED}, {DET}, fnd AS (SELECT doc_id, lang, source, unnest(findings, recursive := true) FROM det)\n"
            f"{select}")


# --- redaction ----------------------------------------------------------------

def redaction() -> str:
    """One CTE per rule: split the text, number the gaps, join."""
    steps = [PLANTED, "r0 AS (SELECT doc_id, text AS t, CAST([] AS STRUCT(original VARCHAR, placeholder VARCHAR, rule VARCHAR)[]) AS log, 0 AS n0, 0 AS n1 FROM planted)"]
    for k, (rule, label, keywords, pattern, flags) in enumerate(fv.REDACTIONS):
        if keywords:
            between = re2(r"""\s*[:=]\s*["']?""")
            regex, group = f"(?i)((?:{keywords}){between})({pattern})", 2
            kept = f"regexp_extract_all(t, {q(regex)}, 1)"
        else:
            regex, group, kept = re2(pattern, flags), 0, None
        start = "n0 + " if label == "OPENAI_API_KEY" and rule != "OPENAI_KEY" else ""
        found = f"regexp_extract_all(t, {q(regex)}, {group})"
        pieces = f"regexp_split_to_array(t, {q(regex)})"
        before = "kept[i - 1] || " if kept else ""
        steps.append(f"m{k} AS (SELECT doc_id, t, log, n0, {found} AS found, {pieces} AS parts, {kept or '[]'} AS kept FROM r{k})")
        count_now = "len(found)" if rule == "OPENAI_KEY" else "n0"
        steps.append(
            f"r{k + 1} AS (SELECT doc_id, CASE WHEN len(found) = 0 THEN t ELSE array_to_string(list_transform(parts, lambda part, i: "
            f"CASE WHEN i = 1 THEN part ELSE {before}'[{label}_' || ({start}i - 1) || ']' || part END), '') END AS t, "
            f"list_concat(log, list_transform(found, lambda m, i: {{'original': left(m, 8) || '***', "
            f"'placeholder': '[{label}_' || ({start}i) || ']', 'rule': '{rule}'}})) AS log, {count_now} AS n0 FROM m{k})")
    steps.append(f"redacted AS (SELECT doc_id, t AS redacted, log AS replacements FROM r{len(fv.REDACTIONS)})")
    return ",\n".join(steps)


def from_redacted(select: str) -> str:
    return f"WITH {redaction()}\n{select}"


# --- evaluation ----------------------------------------------------------------

EXPECTED = f"doc_id % {len(FRAGMENTS)} NOT IN ({', '.join(map(str, BENIGN_FRAGMENTS))})"


def quick() -> str:
    tests = []
    for name, _, sensitivity, pattern, flags in fv.QUICK_PACK:
        if pattern is None:
            split = f"regexp_split_to_array(text, {q(re2(chr(92) + 's+'))})"
            test = (f"len(list_filter({split}, lambda t: {utf16('t')} >= 16 AND list_entropy(string_split(t, '')) >= 4.2)) > 0")
        else:
            test = f"regexp_matches(text, {q(re2(pattern, flags))})"
        tests.append(f"{{'name': {q(name)}, 'sensitivity': {sensitivity}, 'hit': {test}}}")
    return f"{PLANTED}, quick AS (SELECT doc_id, list_filter([{', '.join(tests)}], lambda c: c.hit) AS found FROM planted)"


def matrix(source: str, key: str = "") -> str:
    group, lead = (f"GROUP BY {key}", f"{key}, ") if key else ("", "")
    return f"""SELECT {lead}tp, fp, tn, fn, tp + fp + tn + fn AS total,
  round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 1 END, 4) AS f1, tp + tn AS passed FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM (
    SELECT {lead}count(*) FILTER (WHERE predicted AND expected) AS tp, count(*) FILTER (WHERE predicted AND NOT expected) AS fp,
      count(*) FILTER (WHERE NOT predicted AND NOT expected) AS tn, count(*) FILTER (WHERE NOT predicted AND expected) AS fn
    FROM ({source}) {group}))"""


#: the classifier's tables; the coefficients of ``coefficients`` are those of ``model`` 0 to 5 by position, 2000 at most
MODEL = """marks AS (SELECT doc_id, CAST(quality AS INT) AS label, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank,
    floor(count(*) OVER (PARTITION BY quality) * 0.2 + 0.5) AS test_rows FROM labels),
split AS (SELECT doc_id, label, CASE WHEN rank <= test_rows THEN 'test' ELSE 'train' END AS part,
    CASE WHEN rank > test_rows THEN CAST((rank - test_rows - 1) % 5 AS INT) END AS fold, text FROM marks JOIN documents USING (doc_id)),
wrd AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) || ' ' AS w FROM split),
cnt AS (SELECT doc_id, substr(w, i, n) AS term, count(*) AS tf FROM wrd, (SELECT unnest([1, 2, 3]) AS n),
    LATERAL (SELECT unnest(range(1, length(w) + 2 - n)) AS i) GROUP BY 1, 2),
top AS (SELECT term, sum(tf) AS occurrences, count(*) AS df FROM cnt WHERE doc_id IN (SELECT doc_id FROM split WHERE part = 'train')
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2000),
voc AS (SELECT term, CAST(occurrences AS BIGINT) AS occurrences, df, row_number() OVER (ORDER BY term) - 1 AS position,
    ln((1.0 + (SELECT count(*) FROM split WHERE part = 'train')) / (1.0 + df)) + 1 AS idf FROM top),
raw AS (SELECT doc_id, position, tf * idf AS value FROM cnt JOIN voc USING (term)),
fea AS (SELECT doc_id, position, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM raw),
mdl AS (SELECT unnest(range(6)) AS model),
own AS (SELECT model, doc_id, label, count(*) OVER (PARTITION BY model) / (2.0 * count(*) OVER (PARTITION BY model, label)) AS weight
    FROM split, mdl WHERE part = 'train' AND fold <> model)"""


def slopes(coefficients: str, intercept: str) -> str:
    """CTE ``slope`` (model, place, number) at given coefficients, and ``loss`` (model, number)."""
    return f"""mar AS (SELECT o.model, o.doc_id, label, weight, {intercept} + coalesce(m, 0) AS margin FROM own o
    LEFT JOIN (SELECT doc_id, sum(value * {coefficients}) AS m FROM fea GROUP BY 1) USING (doc_id)),
off AS (SELECT model, doc_id, weight * (1 / (1 + exp(-margin)) - label) AS off, weight * ln(1 + exp(CASE WHEN label = 1 THEN -margin ELSE margin END)) AS cost FROM mar),
inner_ AS (SELECT model, position AS at, sum(value * off) AS number FROM off JOIN fea USING (doc_id) GROUP BY 1, 2),
slope AS (SELECT m.model, v.position AS place, coalesce(number, 0) + {coefficients} / 5.0 AS number FROM mdl m CROSS JOIN voc v
    LEFT JOIN inner_ i ON i.model = m.model AND i.at = v.position
    UNION ALL SELECT model, (SELECT count(*) FROM voc), sum(off) FROM off GROUP BY 1)"""


STEP = f"""{MODEL}, {slopes('0', '0')},
jud AS (SELECT s.doc_id, part, fold, label, coalesce(sum(-f.value * g.number / 100), 0) - any_value(b.number) / 100 AS margin FROM split s
    JOIN slope b ON b.model = coalesce(s.fold, 5) AND b.place = (SELECT count(*) FROM voc)
    LEFT JOIN fea f ON f.doc_id = s.doc_id LEFT JOIN slope g ON g.model = coalesce(s.fold, 5) AND g.place = f.position GROUP BY 1, 2, 3, 4)"""


def scores(group: str = "") -> str:
    """Metrics of ``prd`` (predicted, expected); a ratio without cases is 0."""
    lead = f"{group}, " if group else ""
    return f"""cnf AS (SELECT {lead}count(*) FILTER (predicted AND expected) AS tp, count(*) FILTER (predicted AND NOT expected) AS fp,
    count(*) FILTER (NOT predicted AND NOT expected) AS tn, count(*) FILTER (NOT predicted AND expected) AS fn FROM prd {'GROUP BY ' + group if group else ''}),
sco AS (SELECT *, tp + fp + tn + fn AS total, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM cnf)"""


LABELLED = "lab AS (SELECT d.doc_id, d.text, d.lang AS category, CAST(l.quality AS INT) AS label FROM documents d JOIN labels l USING (doc_id))"


def threats() -> dict[str, str]:
    counts = {}
    for family, technique, parts in fv.THREATS:
        tests = " OR ".join(f"contains(upper(t), '{p}')" for p in parts)
        counts[family] = f"count(*) FILTER (WHERE len(list_filter(detected_tags, lambda t: {tests})) > 0)"
        if technique:
            counts[technique] = counts[family]
    counts["T1567"] = "count(*) FILTER (WHERE destination_category IN ('EXTERNAL_AI', 'UNKNOWN_SAAS'))"
    counts["T1052"] = "count(*) FILTER (WHERE content_length > 500)"
    counts["financial"] = counts["strategic"]
    return counts


def _threat_rows(pairs, column: str, extra: str = "") -> str:
    counts = threats()
    rows = " UNION ALL ".join(f"SELECT {q(label)} AS {column}, {counts[key]} AS events FROM ev" for label, key in pairs)
    return f"SELECT *{extra} FROM ({rows})"


RADAR = [("Credentials & Secrets", "credentials"), ("Infrastructure & DB", "infrastructure"), ("Bulk PII / Identity", "bulk_pii"),
         ("Strategic Narrative", "strategic"), ("Financial Data", "financial"), ("Source Code", "source_code")]
TECHNIQUES = ["T1552", "T1567", "T1020", "T1048", "T1005", "T1052"]


def all_sql() -> dict[str, str]:
    rollup = "count(*) AS payloads, sum(n) AS matches"
    def raw(key: str, text: str, source: str) -> str:
        return (f"SELECT detector, {rollup} FROM (SELECT unnest({findings()}, recursive := true) FROM "
                f"(SELECT {key}, {text} AS text FROM {source}) WHERE {trim('text')} <> '') GROUP BY 1")

    level = "floor(avg_risk + 0.5)"
    hosts = f"hosts AS (SELECT host, {root_domain('host')} AS root_domain FROM log)"
    recent = "ORDER BY timestamp DESC, event_id LIMIT"
    dest = "SELECT destination_category AS destination, count(*) AS events, round(avg(risk_score), 1) AS avg_risk FROM ev GROUP BY 1"
    who, dev = "coalesce(nullif(employee_id, ''), 'unknown')", "coalesce(nullif(device_id, ''), 'unknown')"
    trend = "count(*) AS events, count(*) FILTER (WHERE action = 'BLOCK') AS blocks, max(risk_score) AS max_risk, sum(risk_score) AS total_risk"
    hour = 3600_000
    restricted = ", ".join(q(e) for e in fv.RESTRICTED_EXTENSIONS)
    file_names = names(["notes.txt", "prod.env", "id.pem", "table.csv", "photo.png", "README", "vault.kdbx", "a.b.SQL"])
    gram = ("SELECT substr(w, i, n) AS gram FROM (SELECT ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) || ' ' AS w FROM lab), "
            "(SELECT unnest([1, 2, 3]) AS n), LATERAL (SELECT unnest(range(1, length(w) + 2 - n)) AS i)")
    return {
        "detector_rollup": from_findings(f"SELECT detector, category, sensitivity, {rollup} FROM fnd GROUP BY 1, 2, 3"),
        "findings_table": from_findings("SELECT doc_id, detector, label, category, sensitivity, n FROM fnd"),
        "findings_by_category": from_findings(
            "SELECT category, lang, count(*) AS findings, sum(n) AS matches FROM fnd GROUP BY ROLLUP (category, lang)"),
        "findings_by_source": from_findings(
            "SELECT source, category, count(DISTINCT doc_id) AS payloads, sum(n) AS matches FROM fnd GROUP BY 1, 2"),
        "detector_summary": f"""WITH {PLANTED}, {DET} SELECT doc_id, len(findings) > 0 AS detected,
            array_to_string({first_seen('list_transform(findings, lambda f: f.category)')}, ',') AS categories,
            coalesce(list_max(list_transform(findings, lambda f: f.sensitivity)), 0) AS max_sensitivity,
            array_to_string(list_transform(findings, lambda f: f.detector || ':' || f.n), ',') AS found FROM det""",
        "raw_documents_detectors": raw('doc_id', 'text', 'documents'),
        "pages_detectors": raw('page_id', 'html', 'pages'),
        "card_luhn": f"""WITH {PLANTED}, c AS (SELECT doc_id, {cards('text')} AS found FROM planted)
            SELECT doc_id, len(found) AS candidates, len(list_filter(found, lambda m: {LUHN})) AS valid FROM c WHERE len(found) > 0""",
        "pii_documents": from_findings(
            "SELECT doc_id, sum(n) AS matches, max(sensitivity) AS max_sensitivity FROM fnd WHERE list_contains(tags, 'PII') GROUP BY 1"),
        "bulk_csv_blocks": from_findings("SELECT doc_id, n FROM fnd WHERE detector = 'CSV_BULK_DATA'"),
        "entropy_tokens": f"WITH {PLANTED}, {TOKENS}, {SECRETS} SELECT doc_id, token, entropy, density, reason, length FROM secrets",
        "entropy_reasons": f"""WITH {PLANTED}, {TOKENS}, {SECRETS} SELECT CASE WHEN starts_with(reason, 'HIGH_ENTROPY (') THEN 'HIGH_ENTROPY'
            ELSE reason END AS reason, count(*) AS tokens, max(length) AS longest FROM secrets GROUP BY 1""",
        "entropy_by_document": f"""WITH {PLANTED}, {TOKENS} SELECT p.doc_id, coalesce(max(round(h, 3)), 0) AS max_entropy
            FROM planted p LEFT JOIN tok USING (doc_id) GROUP BY 1""",
        "text_entropy": f"WITH {PLANTED} SELECT doc_id, round(list_entropy(string_split(text, '')), 4) AS entropy FROM planted",
        "narrative_scores": f"""WITH {PLANTED}, {DET}, {NARRATIVE} SELECT doc_id, ndetected AS detected, least(100, nweight) AS score,
            CASE WHEN ndetected THEN least(95, greatest(65, nweight)) ELSE 0 END AS sensitivity,
            array_to_string({first_seen('list_transform(narr, lambda f: f.category)')}, ',') AS categories,
            array_to_string(list_sort(list_distinct(flatten(list_transform(narr, lambda f: f.tags)))), ',') AS tags
            FROM narrated WHERE nweight > 0""",
        "narrative_rollup": f"""WITH {PLANTED}, {DET}, {NARRATIVE}, u AS (SELECT unnest(narr, recursive := true) FROM narrated)
            SELECT id, category, {rollup} FROM u GROUP BY 1, 2""",
        "linear_scores": f"WITH {PLANTED}, {FEATURES}, {LINEAR} SELECT doc_id, probability, sensitive, confidence, sensitivity_score FROM lin",
        "top_features": f"WITH {PLANTED}, {FEATURES}, {LINEAR} SELECT doc_id, features FROM topf",
        "feature_contributions": f"""WITH {PLANTED}, {FEATURES} SELECT feature, count(*) AS payloads, sum(n) AS occurrences,
            round(sum(contribution), 2) AS contribution FROM feat GROUP BY 1""",
        "destination_tiers": f"""WITH {LOG}, {hosts}, t AS (SELECT host, root_domain, count(*) AS events, {tier('host', 'root_domain')} AS tier FROM hosts GROUP BY 1, 2)
            SELECT *, {by_tier('tier', 0)} AS score, {by_tier('tier', 1)} AS label FROM t""",
        "page_hosts": f"""WITH h AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
            r AS (SELECT host, {root_domain('host')} AS root_domain FROM h)
            SELECT host, root_domain, {tier('host', 'root_domain')} AS tier, count(*) AS pages FROM r GROUP BY 1, 2, 3""",
        "managed_destinations": f"""WITH {LOG}, {hosts} SELECT host, {tier('host', 'root_domain', ['claude.ai'], ['gist.github.com', 'notion.so'])} AS tier,
            count(*) AS events FROM hosts GROUP BY 1, 2""",
        "risk_scores": from_verdicts("""SELECT doc_id, text_length, tier, s, d, v, a, c, risk_score, risk_decision, CASE WHEN risk_score <= 25
            THEN 'Safe to Send' WHEN risk_score <= 59 THEN 'Proceed with Caution' ELSE 'Action Blocked' END AS label FROM judged"""),
        "risk_breakdown": from_verdicts("""SELECT doc_id, s || '/100 × 0.4' AS sensitivity, c || '/100 × 0.1' AS context,
            risk_score || '/100' AS final FROM judged"""),
        "decisions": from_verdicts(
            "SELECT doc_id, risk_score, risk_decision, final_decision, policy_id, policy_override, reason FROM judged"),
        "policy_hits": from_verdicts(
            "SELECT policy_id, policy_override, final_decision, count(*) AS payloads FROM judged GROUP BY 1, 2, 3"),
        "stored_policies": f"""SELECT id, name, action, enabled, array_to_string({condition('detectedCategories')}, ',') AS categories,
            array_to_string({condition('detectedTags')}, ',') AS tags, array_to_string({condition('destinationTiers')}, ',') AS tiers,
            {MAX_RISK} AS max_risk, {MALFORMED} AS malformed FROM ({store('supplier', 's_suppkey', 's_name')})""",
        "stored_rule_decisions": f"""WITH {with_verdicts(STORED_RULES)} SELECT doc_id, final_decision, policy_id, policy_name, policy_override FROM judged""",
        "rule_table_decisions": f"""WITH {with_verdicts(MANY_RULES)} SELECT doc_id, final_decision, policy_id, policy_name, policy_override FROM judged""",
        "watchlist_names": f"""WITH raw AS (SELECT p_name AS name FROM part UNION ALL
                SELECT unnest(list_transform(range(1, greatest(len(w), 2)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM (SELECT string_split(text, ' ') AS w FROM benchmark)),
            n AS (SELECT DISTINCT {ascii_lower('name')} AS name FROM raw WHERE {trim('name')} <> ''),
            d AS (SELECT doc_id, {ascii_lower('text')} AS low FROM documents)
            SELECT doc_id, name FROM d, n WHERE contains(low, name)
            AND regexp_matches(low, '(?:^|[^a-z0-9_-])' || regexp_escape(name) || '(?:$|[^a-z0-9_-])')""",
        "rules_as_of": f"""WITH e AS (SELECT c_nationkey AS id, c_name AS name, {RULE_ACTIONS.format(key='c_custkey')} AS action,
                CAST(c_custkey % 2 AS INT) AS enabled, c_custkey % 300 AS day, {RULE_CONDITIONS.format(key='c_custkey')} AS conditions FROM customer),
            m AS (SELECT unnest([3, 40, 150, 400]) AS day)
            SELECT m.day, id, name, action, enabled FROM e JOIN m ON e.day <= m.day
            QUALIFY row_number() OVER (PARTITION BY m.day, id ORDER BY e.day DESC, name DESC, conditions DESC, action DESC, enabled DESC) = 1""",
        "audit_only_decisions": from_verdicts("SELECT final_decision, false AS enforced, count(*) AS payloads FROM judged GROUP BY 1"),
        "watchlist_codenames": f"""WITH {PLANTED}, {DET}, {NARRATIVE}, w AS (SELECT doc_id, list_concat(
            {first_seen('list_transform(narr, lambda f: f.category)')},
            CASE WHEN regexp_matches(text, '(?i)(?:^|[^a-z0-9_-])(?:erlytion|apache license)(?:$|[^a-z0-9_-])') THEN ['CONFIDENTIAL_PROJECT'] ELSE [] END) AS cats FROM narrated)
            SELECT doc_id, array_to_string({first_seen('cats')}, ',') AS categories FROM w WHERE len(cats) > 0""",
        "typed_messages": f"""WITH {SIGNALS}, typed AS (SELECT s.*, p.host, 'keystroke_typing' AS action_type FROM signals s JOIN planted p USING (doc_id)
            WHERE {utf16(trim('p.text'))} >= 8), {judged('typed', 'doc_id').format(rules=BUILT_IN)}
            SELECT doc_id, tier, risk_score, final_decision FROM judged WHERE tier <> 'INTERNAL'
            AND (final_decision = 'BLOCK' OR (final_decision = 'WARN' AND risk_score >= 70))""",
        "file_extensions": f"""WITH f AS (SELECT lower({file_names}[1 + doc_id % 8]) AS name, {pick(HOSTS, 'doc_id')} AS host FROM documents),
            e AS (SELECT regexp_extract(name, '\\.[^.]*$') AS ext, {tier('host', root_domain('host'))} AS tier FROM f)
            SELECT ext, tier, ext IN ({restricted}) AND {EXTERNAL} AS quarantined, count(*) AS files FROM e GROUP BY 1, 2, 3""",
        "redacted_documents": from_redacted("SELECT doc_id, md5(redacted) AS redacted_md5, len(replacements) AS total_replacements FROM redacted"),
        "redaction_log": from_redacted("SELECT doc_id, unnest(replacements, recursive := true) FROM redacted"),
        "redaction_rules": from_redacted("""SELECT rule, count(*) AS replaced FROM (SELECT unnest(replacements, recursive := true) FROM redacted) GROUP BY 1"""),
        "redaction_lines": from_redacted(f"""SELECT doc_id, array_to_string(list_transform({first_seen('rules')},
            lambda n: len(list_filter(rules, lambda m: m = n)) || '× ' || replace(n, '_', ' ')), ', ') AS summary
            FROM (SELECT doc_id, list_transform(replacements, lambda r: r.rule) AS rules FROM redacted) WHERE len(rules) > 0"""),
        "event_table": from_events("SELECT * REPLACE (array_to_string(detected_tags, ',') AS detected_tags) FROM ev"),
        "risk_summary": from_events("""SELECT count(*) AS total, count(*) FILTER (WHERE action = 'ALLOW') AS allowed,
            count(*) FILTER (WHERE action = 'WARN') AS warned, count(*) FILTER (WHERE action = 'BLOCK') AS blocked,
            count(*) FILTER (WHERE risk_score >= 70) AS high_risk, count(*) FILTER (WHERE risk_score >= 90) AS critical FROM ev"""),
        "by_action": from_events("SELECT action, count(*) AS events FROM ev GROUP BY 1"),
        "by_destination": from_events(dest),
        "by_employee": from_events("""SELECT employee_id, count(*) AS total_events, sum(CASE WHEN action = 'BLOCK' THEN 1 ELSE 0 END) AS blocks,
            round(avg(risk_score), 1) AS avg_risk FROM ev WHERE employee_id <> '' GROUP BY 1"""),
        "threat_radar": from_events(_threat_rows(RADAR, "axis", ", greatest(events, 1) AS charted")),
        "technique_hits": from_events(_threat_rows([(t, t) for t in TECHNIQUES], "technique")),
        "recent_flow": from_events(f"""SELECT count(*) AS scanned, count(*) FILTER (WHERE action = 'BLOCK') AS blocked
            FROM (SELECT * FROM ev {recent} 200)"""),
        "destination_levels": from_events(f"""SELECT *, CASE WHEN {level} >= 70 THEN 'HIGH' WHEN {level} >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level
            FROM ({dest})"""),
        "score_bands": from_events("""SELECT CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS band,
            count(*) AS events FROM ev GROUP BY 1"""),
        "top_tags": from_events("""SELECT tag, count(*) AS events FROM (SELECT unnest(detected_tags) AS tag FROM ev) GROUP BY 1
            ORDER BY events DESC, tag LIMIT 8"""),
        "action_counts": from_events("""SELECT count(*) FILTER (WHERE action = 'ALLOW') AS allow, count(*) FILTER (WHERE action = 'WARN') AS warn,
            count(*) FILTER (WHERE action = 'BLOCK') AS block FROM ev"""),
        "recent_events": from_events(f"SELECT event_id, timestamp, risk_score, action FROM ev WHERE action = 'BLOCK' {recent} 50"),
        "event_preview": from_events(f"""SELECT event_id, action, risk_score, array_to_string(detected_tags[1:3], ',') AS tags
            FROM (SELECT * FROM ev {recent} 8)"""),
        "alert_rows": from_events(f"""SELECT event_id, '[DLP] ' || action || ' | Risk ' || risk_score || '/100 | ' || destination_category ||
            ' | Employee: ' || {who} || ' | Device: ' || {dev} AS text, destination_category AS destination, risk_score,
            {who} AS employee_id, {dev} AS device_id FROM ev WHERE action = 'BLOCK' OR risk_score >= 70"""),
        "last_100_per_device": from_events("""SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY timestamp DESC, event_id) AS position,
            event_id FROM ev QUALIFY position <= 100"""),
        "identity_enrichment": f"""WITH {LOG}, c AS (SELECT 'dev-' || (c_custkey - 1) AS key, c_custkey AS k, c_name FROM customer),
            i AS (SELECT coalesce(nullif(CASE WHEN k % 3 = 0 THEN '' ELSE c_name END, ''), nullif(CASE WHEN k % 6 = 0 THEN '' ELSE 'local-' || k END, '')) AS employee_id,
              coalesce(nullif(CASE WHEN k % 4 = 0 THEN '' ELSE 'm-' || k END, ''), 'l-' || k) AS device_id,
              left(repeat('UA' || k || ' ', 30), 80) AS browser_fingerprint FROM log LEFT JOIN c ON c.key = log.device_id)
            SELECT *, count(*) AS events FROM i GROUP BY ALL""",
        "ingest_validation": """SELECT CASE WHEN event_id % 11 = 0 THEN 'missing destination_category' WHEN event_id % 13 = 0 THEN 'missing action'
            WHEN floor(value) NOT BETWEEN 0 AND 100 THEN 'risk_score out of range' END AS reject_reason, count(*) AS events FROM events GROUP BY 1""",
        "ingested_events": """WITH w AS (SELECT CASE WHEN event_id % 17 > 0 THEN 'evt_' || event_id END AS id, epoch_us(ts) // 1000 AS timestamp,
            CAST(floor(value) AS INT) AS risk_score, CASE WHEN event_id % 7 > 0 THEN event_type || ',PII' END AS t,
            CASE WHEN event_id % 11 = 0 THEN 'missing destination_category'
            WHEN floor(value) NOT BETWEEN 0 AND 100 THEN 'risk_score out of range' END AS reject_reason FROM events)
            SELECT CASE WHEN reject_reason IS NULL THEN coalesce(id, 'filled') ELSE id END AS event_id, timestamp, risk_score,
            CASE WHEN reject_reason IS NULL THEN coalesce(t, '') ELSE t END AS tags, reject_reason FROM w""",
        "unique_event_ids": """SELECT 'evt_' || (event_id // 10) AS event_id, (epoch_us(ts) // 1000) AS timestamp, event_type AS action FROM events
            QUALIFY row_number() OVER (PARTITION BY event_id // 10 ORDER BY (epoch_us(ts) // 1000), event_type) = 1""",
        "unique_ids_over_batches": """SELECT * FROM (SELECT 'evt_' || (event_id // 10) AS event_id, (epoch_us(ts) // 1000) AS timestamp,
                event_type AS action, event_id * 7 % 10 // 4 AS batch FROM events)
            QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY batch, timestamp, action) = 1""",
        "sampled_events": from_events("""SELECT action, count(*) AS events FROM ev
            WHERE action <> 'ALLOW' OR CAST('0x' || left(md5(event_id), 8) AS BIGINT) % 100 < 25 GROUP BY 1"""),
        "payload_size_proof": from_events("SELECT count(*) AS events, sum(content_length) AS payload_chars, true AS bounded FROM ev"),
        "risk_trend": from_events(f"SELECT timestamp // {6 * hour} * {6 * hour} AS window_start, {trend} FROM ev GROUP BY 1"),
        "risk_trend_sliding": from_events(f"""SELECT (timestamp // {6 * hour} - k) * {6 * hour} AS window_start, {trend}
            FROM ev, (SELECT unnest([0, 1]) AS k) GROUP BY 1"""),
        "risk_trend_fine": from_events(f"""SELECT (timestamp // {hour // 2} - k) * {hour // 2} AS window_start,
            (timestamp // {hour // 2} - k) * {hour // 2} + {24 * hour} AS window_end, {trend} FROM ev, (SELECT unnest(range(48)) AS k) GROUP BY 1, 2"""),
        "device_floods_sliding": from_events(f"""SELECT device_id, (timestamp // {2 * hour} - k) * {2 * hour} AS window_start, count(*) AS events
            FROM ev, (SELECT unnest(range(5)) AS k) WHERE timestamp < (timestamp // {2 * hour} - k) * {2 * hour} + {9 * hour} GROUP BY 1, 2 HAVING count(*) > 5"""),
        "leak_sessions": from_events(f"""SELECT employee_id, min(timestamp) AS session_start, max(timestamp) AS session_end, count(*) AS events,
            max(risk_score) AS max_risk, coalesce(array_to_string(list_sort(list_distinct(flatten(list(detected_tags)))), ','), '') AS tags FROM (
              SELECT *, sum(fresh) OVER (PARTITION BY employee_id ORDER BY timestamp, event_id) AS session FROM (
                SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY employee_id ORDER BY timestamp, event_id) <= {4 * hour} THEN 0 ELSE 1 END AS fresh FROM ev))
            GROUP BY employee_id, session"""),
        "device_floods": from_events(f"""SELECT device_id, timestamp // {6 * hour} * {6 * hour} AS window_start, count(*) AS events FROM ev
            GROUP BY 1, 2 HAVING count(*) > 4"""),
        "quick_pack": f"WITH {quick()} SELECT c.name AS \"check\", count(*) AS payloads FROM (SELECT unnest(found) AS c FROM quick) GROUP BY 1",
        "evaluation_matrix": f"WITH {quick()} {matrix(f'SELECT len(found) > 0 AS predicted, {EXPECTED} AS expected FROM quick')}",
        "method_comparison": from_signals(matrix(" UNION ALL ".join(
            f"SELECT '{m}' AS method, {test} AS predicted, {EXPECTED} AS expected FROM signals" for m, test in [
                ("patterns", "len(findings) > 0"), ("entropy", "secrets > 0"), ("narrative", "ndetected"), ("classifier", "sensitive")]),
            "method")),
        "class_balance": f"WITH {LABELLED} SELECT label, count(*) AS rows, (SELECT count(*) FROM lab) / (2.0 * count(*)) AS weight FROM lab GROUP BY 1",
        "stratified_split": """WITH r AS (SELECT doc_id, CAST(quality AS INT) AS label,
              row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank,
              floor(count(*) OVER (PARTITION BY quality) * 0.2 + 0.5) AS test_rows FROM labels)
            SELECT doc_id, label, CASE WHEN rank <= test_rows THEN 'test' ELSE 'train' END AS part,
              CASE WHEN rank > test_rows THEN CAST((rank - test_rows - 1) % 5 AS INT) END AS fold FROM r""",
        "char_grams": f"WITH {LABELLED} SELECT gram, count(*) AS occurrences FROM ({gram}) GROUP BY 1",
        "model_vocabulary": f"WITH {MODEL} SELECT term, occurrences, df, position, round(idf, 8) AS idf FROM voc",
        "model_features": f"""WITH {MODEL} SELECT s.doc_id, label, part, fold, count(value) AS terms, coalesce(round(sum(value), 6), 0) AS total, round(max(value), 6) AS largest
            FROM split s LEFT JOIN fea USING (doc_id) GROUP BY 1, 2, 3, 4""",
        "model_gradient": f"""WITH {MODEL}, {slopes('((position % 7 - 3) / 10.0)', '0.1')}, pen AS (SELECT sum(((position % 7 - 3) / 10.0) ** 2) / 10.0 AS p FROM voc)
            SELECT model, place, round(number, 5) AS number FROM slope UNION ALL
            SELECT model, (SELECT count(*) + 1 FROM voc), round(sum(cost) + any_value(p), 5) FROM off, pen GROUP BY 1""",
        "model_step_predictions": f"WITH {STEP} SELECT doc_id, part, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS probability FROM jud",
        "model_step_metrics": f"""WITH {STEP}, prd AS (SELECT margin > 0 AS predicted, label = 1 AS expected FROM jud WHERE part = 'test'), {scores()}
            SELECT tp, fp, tn, fn, total, round((tp + tn) / total, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall,
            round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM sco""",
        "model_step_folds": f"""WITH {STEP}, prd AS (SELECT fold, margin > 0 AS predicted, label = 1 AS expected FROM jud WHERE part = 'train'), {scores('fold')}
            SELECT fold, total, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM sco""",
        "conversation_verdicts": f"""WITH {with_verdicts().replace(PLANTED, CONVERSATIONS)}
            SELECT role, tier, final_decision, count(*) AS turns, max(risk_score) AS max_risk
            FROM judged JOIN (SELECT doc_id, role FROM planted) USING (doc_id) GROUP BY 1, 2, 3""",
        "page_verdicts": f"""WITH {with_verdicts().replace(PLANTED, PAGES)}
            SELECT doc_id AS payload_id, tier, risk_score, final_decision FROM judged""",
        "label_by_language": f"""WITH planted AS (SELECT d.doc_id, d.text, d.lang, CAST(l.quality AS INT) AS label FROM documents d JOIN labels l USING (doc_id)
            WHERE {trim('d.text')} <> ''), {FEATURES}, {LINEAR} SELECT lang AS category, count(*) AS total,
            count(*) FILTER (WHERE CAST(sensitive AS INT) = label) AS correct, CASE WHEN max(label) = 1 THEN 'leak' ELSE 'benign' END AS type
            FROM planted JOIN lin USING (doc_id) GROUP BY 1""",
        "length_profile": f"""WITH {PLANTED}, l AS (SELECT {utf16('text')} AS n FROM planted) SELECT CASE {" ".join(f"WHEN n <= {a} THEN {b}" for a, b in fv.VOLUME_STEPS)}
            ELSE {fv.VOLUME_TOP} END AS volume, count(*) AS payloads, min(n) AS shortest, max(n) AS longest FROM l GROUP BY 1""",
    }
