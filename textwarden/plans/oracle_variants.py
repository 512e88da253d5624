"""SQL of the queries in ``variants`` and ``streams``."""

from __future__ import annotations

from textwarden import fixed_values as fv
from textwarden.plans import oracle as o
from textwarden.plans.variants import ATTACKS, NAMES


def catalogue() -> str:
    """The attacks as the payloads to scan."""
    rows = ", ".join(f"{{'attack': {o.q(n)}, 'payload': {o.q(p)}, 'expected': {str(e).lower()}}}" for n, _, p, e in ATTACKS)
    return f"""planted AS (SELECT doc_id, host, action_type, a.attack AS attack, a.expected AS expected, replace(a.payload, '{{n}}', CAST(doc_id AS VARCHAR)) AS text
  FROM (SELECT doc_id, {o.pick(o.HOSTS, 'doc_id')} AS host, {o.pick(o.ACTIONS, 'doc_id')} AS action_type, [{rows}][1 + doc_id % {len(ATTACKS)}] AS a FROM documents))"""


def whole_files() -> str:
    """Documents with their fragment, joined to sixteen texts."""
    return f"""parts AS (SELECT doc_id, text || chr(10) || {o.fragment_sql()} AS text FROM documents),
planted AS (SELECT doc_id % 16 AS doc_id, string_agg(text || chr(10) || chr(10), '' ORDER BY parts.doc_id) AS text FROM parts GROUP BY parts.doc_id % 16)"""


def all_sql() -> dict[str, str]:
    name = f"{o.names(NAMES)}[1 + doc_id % {len(NAMES)}]"
    text = f"regexp_extract(lower({name}), '\\.[^.]*$') IN ({', '.join(map(o.q, fv.TEXT_EXTENSIONS))})"
    restricted = f"regexp_extract(lower({name}), '\\.[^.]*$') IN ({', '.join(map(o.q, fv.RESTRICTED_EXTENSIONS))})"
    who, dev = "coalesce(nullif(employee_id, ''), 'unknown')", "coalesce(nullif(device_id, ''), 'unknown')"
    alert = ("'[DLP] ' || action || ' | Risk ' || risk_score || '/100 | ' || destination_category || "
             f"' | Employee: ' || {who} || ' | Device: ' || {dev}")
    hour = 3600_000
    return {
        "text_file_verdicts": f"""WITH {o.SIGNALS}, filed AS (SELECT s.*, p.host, 'file_upload' AS action_type FROM signals s JOIN planted p USING (doc_id)
            WHERE {text.replace('doc_id', 's.doc_id')} AND NOT {restricted.replace('doc_id', 's.doc_id')}), {o.judged('filed', 'doc_id').format(rules=o.BUILT_IN)}
            SELECT '/out/' || doc_id || '/' || {name} AS path, tier, risk_score, final_decision FROM judged WHERE {o.EXTERNAL} AND final_decision IN ('BLOCK', 'WARN')""",
        "large_file_signals": f"""WITH {o.SIGNALS.replace(o.PLANTED, whole_files())}
            SELECT CAST(doc_id AS INT) AS file, text_length, array_to_string(list_transform(findings, lambda f: f.detector || ':' || f.n), ',') AS found, secrets,
              least(100, nweight) AS narrative_score, probability, coalesce(features, '') AS features FROM signals""",
        "quarantine_off": f"""WITH f AS (SELECT regexp_extract(lower({name}), '\\.[^.]*$') AS ext, {o.pick(o.HOSTS, 'doc_id')} AS host FROM documents WHERE {text}),
            t AS (SELECT ext, {o.tier('host', o.root_domain('host'))} AS tier FROM f) SELECT ext, tier, count(*) AS files FROM t WHERE {o.EXTERNAL} GROUP BY 1, 2""",
        "one_event": o.from_events("SELECT event_id, timestamp, risk_score, action, content_length FROM ev WHERE event_id = (SELECT min(event_id) FROM ev)"),
        "decoded_event_tags": o.from_events("""SELECT event_id, CASE WHEN risk_score % 9 = 0 THEN 0 ELSE len(detected_tags) END AS tags,
            CASE WHEN risk_score % 9 = 0 THEN '' ELSE array_to_string(detected_tags, ',') END AS joined FROM ev"""),
        "appended_policies": f"SELECT id, name, action, enabled, {o.MAX_RISK} AS max_risk, {o.MALFORMED} AS malformed FROM ({o.store('supplier', 's_suppkey', 's_name')})",
        "service_switch": o.from_events("SELECT true AS enabled, count(*) AS events FROM ev UNION ALL SELECT false, 0"),
        "blank_payloads": f"WITH {o.PLANTED} SELECT doc_id, {o.utf16('text')} AS text_length FROM planted WHERE doc_id % 4 NOT IN (0, 1) AND {o.trim('text')} <> ''",
        "entropy_threshold": f"WITH {o.PLANTED}, {o.TOKENS}, {o.SECRETS.replace('h >= 4.2', 'h >= 4.6')} SELECT doc_id, secrets FROM nsec",
        "pending_hashes": o.from_events("SELECT action, action = 'ALLOW' AS pending, count(*) AS events FROM ev GROUP BY 1, 2"),
        "latest_report": """SELECT c_name AS version, c_acctbal AS accuracy, c_custkey AS sample_size,
            1704067200000 + (c_custkey * 7919 % 1000003) * 1000 AS trained_at FROM customer ORDER BY trained_at DESC LIMIT 1""",
        "risk_factors": o.from_verdicts("""SELECT doc_id, s || '/100 × 0.4' AS data_sensitivity, d || '/100 × 0.25' AS destination_risk, v || '/100 × 0.15' AS data_volume,
            a || '/100 × 0.1' AS action_vector, c || '/100 × 0.1' AS context_risk, risk_score || '/100' AS final_score FROM judged"""),
        "alert_documents": o.from_events(f"""SELECT {alert} AS text, event_id, risk_score, destination_category AS destination, array_to_string(detected_tags, ',') AS detected_tags,
            action, {who} AS employee_id, {dev} AS device_id, timestamp, '0 bytes plaintext transmitted or stored' AS zero_plaintext_proof
            FROM ev WHERE action = 'BLOCK' OR risk_score >= 70"""),
        "quick_pack_documents": f"""WITH {o.quick()} SELECT doc_id, array_to_string(list_transform(found, lambda c: c.name), ',') AS found,
            coalesce(list_max(list_transform(found, lambda c: c.sensitivity)), 0) AS max_sensitivity FROM quick""",
        "attack_catalogue": f"""WITH {o.with_verdicts().replace(o.PLANTED, catalogue())},
            m AS (SELECT j.doc_id, final_decision, attack, expected, array_to_string(list_filter([CASE WHEN len(j.findings) > 0 THEN 'patterns' END,
              CASE WHEN secrets > 0 THEN 'entropy' END, CASE WHEN ndetected THEN 'narrative' END], lambda x: x IS NOT NULL), '+') AS means
              FROM judged j JOIN (SELECT doc_id, attack, expected FROM planted) USING (doc_id))
            SELECT attack, expected, means, count(*) AS payloads, count(*) FILTER ((means <> '') = expected) AS as_expected,
              count(*) FILTER (final_decision = 'BLOCK') AS blocked FROM m GROUP BY 1, 2, 3""",
        "stream_ingested": """SELECT event_id, timestamp, risk_score, event_type AS tags FROM (
            SELECT 'evt_' || (event_id // 10) AS event_id, epoch_us(ts) // 1000 AS timestamp, CAST(floor(value) AS INT) AS risk_score, event_type, event_id % 3 AS part FROM events)
            WHERE risk_score BETWEEN 0 AND 100 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY part, timestamp, event_type, risk_score) = 1""",
        "stream_scanned": o.from_verdicts("""SELECT doc_id, sha256_prefix AS payload_sha256_prefix, risk_score, final_decision AS action, text_length AS content_length
            FROM judged"""),
        "stream_alerts": o.from_events(f"SELECT event_id, {alert} AS text, risk_score, action, timestamp FROM ev WHERE action = 'BLOCK' OR risk_score >= 70"),
        "stream_rollup": o.from_events("SELECT action, count(*) AS events FROM ev GROUP BY 1"),
        "stream_last_100": o.from_events("""SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY timestamp DESC, event_id) AS position,
            event_id FROM ev QUALIFY position <= 100"""),
        "stream_sessions": o.from_events(f"""SELECT employee_id, min(timestamp) AS session_start, max(timestamp) AS session_end, count(*) AS events,
            max(risk_score) AS max_risk, coalesce(array_to_string(list_sort(list_distinct(flatten(list(detected_tags)))), ','), '') AS tags FROM (
              SELECT *, sum(fresh) OVER (PARTITION BY employee_id ORDER BY timestamp, event_id) AS session FROM (
                SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY employee_id ORDER BY timestamp, event_id) <= {4 * hour} THEN 0 ELSE 1 END AS fresh FROM ev))
            GROUP BY employee_id, session"""),
        "late_events": """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) // 1000 AS t, event_id % 3 AS batch FROM events),
            b AS (SELECT batch, max(t) AS newest FROM e GROUP BY 1)
            SELECT event_id, batch, coalesce(t < (SELECT max(newest) FROM b WHERE b.batch < e.batch) - 172800000, false) AS late FROM e""",
    }
