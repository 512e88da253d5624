"""Named queries: every operator run over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from textwarden.functions import destination, entropy, linear, risk
from textwarden.functions.detectors import findings
from textwarden.functions.text import plain_blanks, utf16_length
from textwarden.operators import analytics, evaluate, events as ev, gradient, grams, keys, policies, redact, rule_table, sessions, training, watchlist
from textwarden.operators.files import quarantined, scan_typed, with_extension
from textwarden.operators.scan import detect, judge, scan, scannable, summarize_signals, with_classifier, with_gates, with_hits, with_narrative, with_secrets
from textwarden.operators.sealed import sealed
from textwarden.options import ScanOptions
from textwarden.sources import adapters
from textwarden.sources.tables import scratch, spread, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

#: planted fragments that hold nothing to detect
BENIGN_FRAGMENTS = (51, 52)


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def planted(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.payloads_planted(spark, sf).select("doc_id", "text", "lang", "source", "host", "action_type")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return detect(planted(spark, sf))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return scan(planted(spark, sf))


def egress(spark: SparkSession, sf: str, rules=None, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Judged payloads of the egress log: each document is scanned once, its result joined to its events."""
    found = summarize_signals(detect(
        adapters.payloads_planted(spark, sf).select("doc_id", "text"), options=options))
    return judge(adapters.egress_log(spark, sf).join(found, "doc_id"), rules, options)


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ev.build_events(egress(spark, sf), "event_id")


def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(spark, sf).withColumn("ts", F.timestamp_millis("timestamp"))


def joined(column: str) -> str:
    return f"array_join(array_sort({column}), ',')"


# --- detectors ---------------------------------------------------------------

def finding_rows(payloads: DataFrame) -> DataFrame:
    keep = [c for c in payloads.columns if c != "text"]
    found = with_hits(payloads).selectExpr(*keep, f"{findings('hits')} AS f")
    return found.select(*keep, F.inline("f"))


@query
def detector_rollup(spark, sf):
    return (finding_rows(planted(spark, sf)).groupBy("detector", "category", "sensitivity")
            .agg(F.count(F.lit(1)).alias("payloads"), F.sum("n").alias("matches")))


@query
def findings_table(spark, sf):
    return finding_rows(planted(spark, sf)).select("doc_id", "detector", "label", "category", "sensitivity", "n")


@query
def findings_by_category(spark, sf):
    return analytics.findings_rollup(
        finding_rows(planted(spark, sf)).select("category", "lang", "n"), "category", "lang")


@query
def findings_by_source(spark, sf):
    return (finding_rows(planted(spark, sf)).groupBy("source", "category")
            .agg(F.count_distinct("doc_id").alias("payloads"), F.sum("n").alias("matches")))


@query
def detector_summary(spark, sf):
    """Per payload: detected flag, categories, highest sensitivity."""
    found = with_hits(planted(spark, sf)).selectExpr("doc_id", f"{findings('hits')} AS f")
    return found.selectExpr(
        "doc_id", "size(f) > 0 AS detected", "array_join(array_distinct(transform(f, x -> x.category)), ',') AS categories",
        "coalesce(array_max(transform(f, x -> x.sensitivity)), 0) AS max_sensitivity",
        "array_join(transform(f, x -> concat(x.detector, ':', x.n)), ',') AS found")


@query
def raw_documents_detectors(spark, sf):
    """The documents as they are, without planted fragments."""
    docs = adapters.payloads_documents(spark, sf).select("doc_id", "text")
    return (finding_rows(docs).groupBy("detector")
            .agg(F.count(F.lit(1)).alias("payloads"), F.sum("n").alias("matches")))


@query
def pages_detectors(spark, sf):
    pages = adapters.payloads_pages(spark, sf).select("payload_id", "text")
    return (finding_rows(pages).groupBy("detector")
            .agg(F.count(F.lit(1)).alias("payloads"), F.sum("n").alias("matches")))


@query
def card_luhn(spark, sf):
    """Card-like numbers per payload and how many pass the checksum."""
    gated = with_gates(planted(spark, sf).select("doc_id", "text"))
    return sealed(gated, ["doc_id"], ["_cards"]).filter("size(_cards) > 0").selectExpr(
        "doc_id", "size(_cards) AS candidates", "size(filter(_cards, c -> luhn_check(c))) AS valid")


@query
def pii_documents(spark, sf):
    return (finding_rows(planted(spark, sf)).filter("array_contains(tags, 'PII')").groupBy("doc_id")
            .agg(F.sum("n").alias("matches"), F.max("sensitivity").alias("max_sensitivity")))


@query
def bulk_csv_blocks(spark, sf):
    return finding_rows(planted(spark, sf)).filter("detector = 'CSV_BULK_DATA'").select("doc_id", "n")


# --- entropy -----------------------------------------------------------------

@query
def entropy_tokens(spark, sf):
    found = with_secrets(planted(spark, sf).select("doc_id", "text")).select("doc_id", F.inline("secrets"))
    return found.selectExpr("doc_id", "token", "entropy", "density", "reason", "length")


@query
def entropy_reasons(spark, sf):
    found = with_secrets(planted(spark, sf).select("doc_id", "text")).select(F.inline("secrets"))
    return (found.groupBy(F.expr("CASE WHEN reason LIKE 'HIGH_ENTROPY (%' THEN 'HIGH_ENTROPY' ELSE reason END").alias("reason"))
            .agg(F.count(F.lit(1)).alias("tokens"), F.max("length").alias("longest")))


@query
def entropy_by_document(spark, sf):
    plain = scannable(planted(spark, sf)).selectExpr("doc_id", f"{plain_blanks('text')} AS _plain")
    return plain.selectExpr("doc_id", f"round({entropy.max_entropy('_plain')}, 3) AS max_entropy")


@query
def text_entropy(spark, sf):
    """Entropy of the whole text, over characters."""
    return planted(spark, sf).selectExpr("doc_id", f"round({entropy.shannon_entropy('text')}, 4) AS entropy")


# --- narrative and linear classifier ------------------------------------------

@query
def narrative_scores(spark, sf):
    return with_narrative(planted(spark, sf).select("doc_id", "text")).selectExpr(
        "doc_id", "narrative.detected AS detected", "narrative.score AS score", "narrative.sensitivity AS sensitivity",
        "array_join(narrative.categories, ',') AS categories", f"{joined('narrative.tags')} AS tags"
    ).filter("score > 0")


@query
def narrative_rollup(spark, sf):
    found = with_narrative(planted(spark, sf).select("doc_id", "text")).select(F.inline("narrative.findings"))
    return found.groupBy("id", "category").agg(F.count(F.lit(1)).alias("payloads"), F.sum("n").alias("matches"))


@query
def linear_scores(spark, sf):
    return with_classifier(planted(spark, sf).select("doc_id", "text")).selectExpr(
        "doc_id", "classifier.probability AS probability", "classifier.sensitive AS sensitive",
        "classifier.confidence AS confidence", "classifier.sensitivity_score AS sensitivity_score")


@query
def top_features(spark, sf):
    return with_classifier(planted(spark, sf).select("doc_id", "text")).selectExpr(
        "doc_id", "array_join(classifier.top_features, '|') AS features").filter("features <> ''")


@query
def feature_contributions(spark, sf):
    low = planted(spark, sf).selectExpr("lower(text) AS _low").select(F.expr(f"inline({linear.feature_hits()})"))
    return (low.groupBy("feature").agg(F.count(F.lit(1)).alias("payloads"), F.sum("n").alias("occurrences"),
                                       F.round(F.sum("contribution"), 2).alias("contribution")))


# --- destinations --------------------------------------------------------------

@query
def destination_tiers(spark, sf):
    hosts = adapters.egress_log(spark, sf).selectExpr("host", f"{destination.root_domain('host')} AS root_domain")
    tiers = hosts.groupBy("host", "root_domain").agg(F.count(F.lit(1)).alias("events")).selectExpr(
        "*", f"{destination.tier_of('host', 'root_domain')} AS tier")
    return tiers.selectExpr("*", f"{destination.tier_score('tier')} AS score", f"{destination.tier_label('tier')} AS label")


@query
def page_hosts(spark, sf):
    pages = table(spark, sf, "pages").selectExpr(f"{destination.host_of('url')} AS host")
    return (pages.selectExpr("host", f"{destination.root_domain('host')} AS root_domain")
            .selectExpr("*", f"{destination.tier_of('host', 'root_domain')} AS tier")
            .groupBy("host", "root_domain", "tier").agg(F.count(F.lit(1)).alias("pages")))


@query
def managed_destinations(spark, sf):
    """Tiers with domains approved and restricted by the administrator."""
    tier = destination.tier_of("host", "root_domain", ["claude.ai"], ["gist.github.com", "notion.so"])
    hosts = adapters.egress_log(spark, sf).selectExpr("host", f"{destination.root_domain('host')} AS root_domain")
    return hosts.selectExpr("host", f"{tier} AS tier").groupBy("host", "tier").agg(F.count(F.lit(1)).alias("events"))


# --- risk and policy -----------------------------------------------------------

@query
def risk_scores(spark, sf):
    return verdicts(spark, sf).selectExpr(
        "doc_id", "text_length", "tier", "factors.s AS s", "factors.d AS d", "factors.v AS v", "factors.a AS a",
        "factors.c AS c", "risk_score", "risk_decision", f"{risk.decision_label('risk_score')} AS label")


@query
def risk_breakdown(spark, sf):
    return verdicts(spark, sf).selectExpr(
        "doc_id", f"{risk.breakdown('factors', 'risk_score')} AS b").select(
        "doc_id", F.expr("b['Data Sensitivity']").alias("sensitivity"), F.expr("b['Context Risk']").alias("context"),
        F.expr("b['Final Score']").alias("final"))


@query
def decisions(spark, sf):
    return verdicts(spark, sf).select(
        "doc_id", "risk_score", "risk_decision", "final_decision", "policy_id", "policy_override", "reason")


@query
def policy_hits(spark, sf):
    return analytics.policy_hits(verdicts(spark, sf))


RULE_CONDITIONS = """CASE {key} % 5
    WHEN 0 THEN '{{"detectedTags": ["EMAIL"], "destinationTiers": ["APPROVED_SAAS"]}}'
    WHEN 1 THEN '{{"detectedCategories": ["SOURCE_CODE", "PII"]}}'
    WHEN 2 THEN '{{"maxRiskScore": 40.5}}'
    WHEN 3 THEN '{{"detectedTags": ["ML_SENSITIVE"], "destinationTiers": ["INTERNAL", "APPROVED_AI"]}}'
    ELSE '{{"maxRiskScore": "90"}}' END"""
RULE_ACTIONS = "CASE {key} % 5 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'WARN' WHEN 2 THEN 'ALLOW' ELSE 'BLOCK' END"

#: conditions from the rule's number: category and tag lists, some of them of names that no payload has, and risk limits
MANY_CONDITIONS = """concat('{{"detectedCategories": [', CASE {key} % 7 WHEN 0 THEN '"PII"' WHEN 1 THEN '"FINANCIAL", "SOURCE_CODE"'
        WHEN 2 THEN '"INFRASTRUCTURE"' WHEN 3 THEN '"UNHEARD_OF"' ELSE '' END,
    '], "detectedTags": [', CASE {key} % 11 WHEN 0 THEN '"EMAIL", "JWT"' WHEN 1 THEN '"CLOUD"' WHEN 2 THEN '"IBAN", "SSN"'
        WHEN 3 THEN '"TAG_' || ({key} % 100) || '"' ELSE '' END,
    '], "destinationTiers": [', CASE {key} % 5 WHEN 0 THEN '"EXTERNAL_AI"' WHEN 1 THEN '"APPROVED_SAAS", "INTERNAL"' ELSE '' END,
    ']', CASE {key} % 3 WHEN 0 THEN '' ELSE ', "maxRiskScore": ' || (5 + {key} % 40 / 4 + 0.5) END, '}}')"""


def rule_store(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A policy store with one stored rule per row of a given table."""
    return rows.selectExpr(
        f"cast({key} AS bigint) AS id", f"concat('Rule ', {name}) AS name",
        f"{RULE_CONDITIONS.format(key=key)} AS conditions", f"{RULE_ACTIONS.format(key=key)} AS action",
        f"CAST({key} % 2 AS INT) AS enabled", "'2024-01-01T00:00:00+00:00' AS created_at")


@query
def stored_policies(spark, sf):
    return policies.read_policies(rule_store(table(spark, sf, "supplier"), "s_suppkey", "s_name")).selectExpr(
        "id", "name", "action", "enabled", "array_join(conditions.detectedCategories, ',') AS categories",
        "array_join(conditions.detectedTags, ',') AS tags", "array_join(conditions.destinationTiers, ',') AS tiers",
        "conditions.maxRiskScore AS max_risk", "malformed")


@query
def stored_rule_decisions(spark, sf):
    """Verdicts under the stored rules followed by the built-in ones."""
    judged = scan(planted(spark, sf), rules=policies.rules_from(
        rule_store(table(spark, sf, "region"), "r_regionkey", "r_name")))
    return judged.select("doc_id", "final_decision", "policy_id", "policy_name", "policy_override")


def many_rules(rows: DataFrame, key: str, name: str) -> DataFrame:
    """A policy store with one rule per row of a given table, each with its own mix of conditions."""
    return rows.selectExpr(
        f"cast({key} AS bigint) AS id", f"concat('Rule ', {name}) AS name", f"{MANY_CONDITIONS.format(key=key)} AS conditions",
        f"{RULE_ACTIONS.format(key=key)} AS action", "1 AS enabled", "'2024-01-01T00:00:00+00:00' AS created_at")


@query
def rule_table_decisions(spark, sf):
    """Verdicts under a compiled table of one stored rule per part and the built-in ones."""
    rules = rule_table.compile_rules(many_rules(table(spark, sf, "part"), "p_partkey", "p_name"), scratch(spark, "rules"))
    return scan(planted(spark, sf), rules=rules).select("doc_id", "final_decision", "policy_id", "policy_name", "policy_override")


@query
def audit_only_decisions(spark, sf):
    judged = scan(planted(spark, sf), options=ScanOptions(audit_only=True))
    return judged.groupBy("final_decision", "enforced").agg(F.count(F.lit(1)).alias("payloads"))


@query
def watchlist_codenames(spark, sf):
    """Payloads that name a watched project."""
    watched = detect(planted(spark, sf).select("doc_id", "text"), options=ScanOptions(codenames=("erlytion", "Apache License")))
    return watched.selectExpr("doc_id", "array_join(narrative.categories, ',') AS categories").filter("categories <> ''")


def watched_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names to watch for: every part's name, and every two neighbouring words of the benchmark passages."""
    words = table(spark, sf, "benchmark").select(F.split("text", " ").alias("w"))
    pairs = words.select(F.explode(F.expr(
        "transform(sequence(1, greatest(size(w) - 1, 1)), i -> concat_ws(' ', get(w, i - 1), get(w, i)))")).alias("name"))
    return table(spark, sf, "part").select(F.col("p_name").alias("name")).unionByName(pairs)


@query
def watchlist_names(spark, sf):
    """Every watched name of a long list that a document holds."""
    docs = adapters.payloads_documents(spark, sf).select("doc_id", "text")
    return watchlist.find_names(docs, watched_names(spark, sf), "doc_id")


@query
def rules_as_of(spark, sf):
    """The stored rules in force at four moments: customers as edits of the rules of their nation, a day apart."""
    edits = table(spark, sf, "customer").selectExpr(
        "cast(c_nationkey AS bigint) AS id", "c_name AS name", f"{RULE_CONDITIONS.format(key='c_custkey')} AS conditions",
        f"{RULE_ACTIONS.format(key='c_custkey')} AS action", "CAST(c_custkey % 2 AS INT) AS enabled",
        "date_format(timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 300 AS int)), "
        "'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS+00:00') AS created_at")
    found = None
    for day in (3, 40, 150, 400):
        moment = F.expr(f"timestamp '2024-01-01 00:00:00' + make_dt_interval({day})")
        valid = policies.rules_as_of(edits, moment).select(F.lit(day).alias("day"), "id", "name", "action", "enabled")
        found = valid if found is None else found.unionByName(valid)
    return found


# --- payload gates ---------------------------------------------------------------

@query
def typed_messages(spark, sf):
    typed = scan_typed(planted(spark, sf).drop("action_type"))
    return typed.select("doc_id", "tier", "risk_score", "final_decision")


@query
def conversation_verdicts(spark, sf):
    turns = adapters.payloads_conversations(spark, sf)
    return (scan(turns).groupBy("role", "tier", "final_decision")
            .agg(F.count(F.lit(1)).alias("turns"), F.max("risk_score").alias("max_risk")))


@query
def page_verdicts(spark, sf):
    judged = scan(adapters.payloads_pages(spark, sf))
    return judged.select("payload_id", "tier", "risk_score", "final_decision")


@query
def file_extensions(spark, sf):
    """Documents sent as files: name and type from their number; verdict by type and tier."""
    names = "get(array('notes.txt', 'prod.env', 'id.pem', 'table.csv', 'photo.png', 'README', 'vault.kdbx', 'a.b.SQL'), cast(doc_id % 8 AS int))"
    files = adapters.payloads_documents(spark, sf).selectExpr(
        f"concat('/out/', doc_id, '/', {names}) AS path", "host", "octet_length(text) AS length")
    blocked = quarantined(files).select("path", F.lit(True).alias("quarantined"))
    return (with_extension(files).join(blocked, "path", "left")
            .groupBy("ext", "tier", F.coalesce("quarantined", F.lit(False)).alias("quarantined"))
            .agg(F.count(F.lit(1)).alias("files")))


# --- redaction -------------------------------------------------------------------

@query
def redacted_documents(spark, sf):
    return redact.redact(planted(spark, sf).select("doc_id", "text")).selectExpr(
        "doc_id", "md5(redacted) AS redacted_md5", "total_replacements")


@query
def redaction_log(spark, sf):
    rows = redact.redact(planted(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", F.inline("replacements"))


@query
def redaction_rules(spark, sf):
    return redact.redaction_summary(redact.redact(planted(spark, sf).select("doc_id", "text")))


@query
def redaction_lines(spark, sf):
    rows = redact.redact(planted(spark, sf).select("doc_id", "text")).filter("total_replacements > 0")
    return rows.selectExpr("doc_id", f"array_join({redact.summarize()}, ', ') AS summary")


# --- events and analytics ----------------------------------------------------------

@query
def event_table(spark, sf):
    return event_rows(spark, sf).drop("browser_fingerprint").withColumn(
        "detected_tags", F.array_join("detected_tags", ","))


@query
def risk_summary(spark, sf):
    return analytics.risk_summary(event_rows(spark, sf))


@query
def by_action(spark, sf):
    return analytics.by_action(event_rows(spark, sf))


@query
def by_destination(spark, sf):
    return analytics.by_destination(event_rows(spark, sf))


@query
def by_employee(spark, sf):
    return analytics.by_employee(event_rows(spark, sf))


@query
def threat_radar(spark, sf):
    return analytics.threat_radar(event_rows(spark, sf))


@query
def technique_hits(spark, sf):
    return analytics.technique_hits(event_rows(spark, sf))


@query
def recent_flow(spark, sf):
    return analytics.recent_flow(event_rows(spark, sf))


@query
def destination_levels(spark, sf):
    return analytics.destination_levels(event_rows(spark, sf))


@query
def score_bands(spark, sf):
    return analytics.score_bands(event_rows(spark, sf))


@query
def top_tags(spark, sf):
    return analytics.top_tags(event_rows(spark, sf))


@query
def action_counts(spark, sf):
    return analytics.action_counts(event_rows(spark, sf))


@query
def recent_events(spark, sf):
    return ev.list_events(event_rows(spark, sf), 50, "block").select("event_id", "timestamp", "risk_score", "action")


@query
def event_preview(spark, sf):
    return ev.recent_preview(event_rows(spark, sf)).selectExpr(
        "event_id", "action", "risk_score", "array_join(detected_tags, ',') AS tags")


@query
def alert_rows(spark, sf):
    return ev.alerts(event_rows(spark, sf)).select("event_id", "text", "destination", "risk_score", "employee_id", "device_id")


@query
def last_100_per_device(spark, sf):
    return ev.last_per_device(event_rows(spark, sf)).select("device_id", "position", "event_id")


@query
def identity_enrichment(spark, sf):
    """Identity per device from two stores derived from the customer table."""
    stores = table(spark, sf, "customer")
    key = "concat('dev-', c_custkey - 1) AS device_key"
    managed = stores.selectExpr(key, "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS employee_id",
                                "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('m-', c_custkey) END AS device_id")
    local = stores.selectExpr(key, "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('local-', c_custkey) END AS employee_id",
                              "concat('l-', c_custkey) AS device_id", "repeat(concat('UA', c_custkey, ' '), 30) AS user_agent")
    log = adapters.egress_log(spark, sf).selectExpr("event_id", "device_id AS device_key")
    return (ev.with_identity(log, managed, local)
            .groupBy("employee_id", "device_id", "browser_fingerprint").agg(F.count(F.lit(1)).alias("events")))


@query
def ingest_validation(spark, sf):
    """The events table taken as wire events: accepted and rejected rows by reason."""
    wire = table(spark, sf, "events").selectExpr(
        "concat('evt_', event_id) AS event_id", "unix_millis(cast(ts AS timestamp)) AS timestamp",
        "CASE WHEN event_id % 11 = 0 THEN null ELSE 'EXTERNAL_AI' END AS destination_category",
        "array(event_type) AS detected_tags", "CAST(floor(value) AS INT) AS risk_score",
        "CASE WHEN event_id % 13 = 0 THEN null ELSE 'WARN' END AS action")
    return ev.validated(wire).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("events"))


@query
def ingested_events(spark, sf):
    """Wire events as stored or refused: missing ids filled in, missing tags empty; all rows of the input."""
    wire = table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 17 > 0 THEN concat('evt_', event_id) END AS event_id",
        "unix_millis(cast(ts AS timestamp)) AS timestamp",
        "CASE WHEN event_id % 11 = 0 THEN null ELSE 'EXTERNAL_AI' END AS destination_category",
        "CASE WHEN event_id % 7 > 0 THEN array(event_type, 'PII') END AS detected_tags",
        "CAST(floor(value) AS INT) AS risk_score", "'WARN' AS action")
    shown = ["timestamp", "risk_score", "array_join(detected_tags, ',') AS tags"]
    stored = ev.accepted(wire).selectExpr("if(length(event_id) = 36, 'filled', event_id) AS event_id", *shown,
                                          "cast(null AS string) AS reject_reason")
    return stored.unionByName(ev.rejected(wire).selectExpr("event_id", *shown, "reject_reason"))


@query
def unique_event_ids(spark, sf):
    """Repeats of an id removed: ids are made to repeat by dropping their last digit."""
    log = table(spark, sf, "events").selectExpr(
        "concat('evt_', event_id DIV 10) AS event_id", "unix_millis(cast(ts AS timestamp)) AS timestamp", "event_type AS action")
    return ev.unique_events(log)


@query
def unique_ids_over_batches(spark, sf):
    """Events that arrive in three batches, each checked against the ids that all earlier ones stored."""
    log = table(spark, sf, "events").selectExpr(
        "concat('evt_', event_id DIV 10) AS event_id", "unix_millis(cast(ts AS timestamp)) AS timestamp", "event_type AS action",
        "event_id * 7 % 10 DIV 4 AS batch")
    folder = scratch(spark, "unique-ids")
    index = keys.KeyIndex(spark, f"{folder}/keys")
    for batch in range(3):
        rows = ev.unique_events(log.filter(f"batch = {batch}").drop("batch"))
        keys.first_seen(rows, index, batch).write.parquet(f"{folder}/rows/batch={batch}")
        index.commit(spark.read.parquet(f"{folder}/rows/batch={batch}").select(F.col("event_id").alias("key")), batch)
    return spark.read.parquet(f"{folder}/rows")


@query
def sampled_events(spark, sf):
    kept = ev.sample_benign(event_rows(spark, sf), ScanOptions(sample_rate=25))
    return kept.groupBy("action").agg(F.count(F.lit(1)).alias("events"))


@query
def payload_size_proof(spark, sf):
    """Bytes of event metadata against characters scanned."""
    proof = ev.size_proof(event_rows(spark, sf))
    return proof.agg(F.count(F.lit(1)).alias("events"), F.sum("content_length").alias("payload_chars"),
                     (F.max("event_bytes") < 2000).alias("bounded"))


# --- time ----------------------------------------------------------------------------

def epoch(column: str) -> str:
    return f"unix_millis({column})"


@query
def risk_trend(spark, sf):
    trend = sessions.risk_trend(timed_events(spark, sf), "6 hours")
    return trend.selectExpr(f"{epoch('window_start')} AS window_start", "events", "blocks", "max_risk", "total_risk")


@query
def risk_trend_sliding(spark, sf):
    trend = sessions.risk_trend(timed_events(spark, sf), "12 hours", "6 hours")
    return trend.selectExpr(f"{epoch('window_start')} AS window_start", "events", "blocks", "max_risk", "total_risk")


@query
def risk_trend_fine(spark, sf):
    """Windows of a day that overlap every half hour."""
    trend = sessions.risk_trend(timed_events(spark, sf), "1 day", "30 minutes")
    return trend.selectExpr(f"{epoch('window_start')} AS window_start", f"{epoch('window_end')} AS window_end",
                            "events", "blocks", "max_risk", "total_risk")


@query
def device_floods_sliding(spark, sf):
    found = sessions.floods(timed_events(spark, sf), 5, "9 hours", "2 hours")
    return found.selectExpr("device_id", f"{epoch('window_start')} AS window_start", "events")


@query
def leak_sessions(spark, sf):
    found = sessions.leak_sessions(timed_events(spark, sf), 4 * 3600)
    return found.selectExpr("employee_id", f"{epoch('session_start')} AS session_start",
                            f"{epoch('session_end')} AS session_end", "events", "max_risk", "array_join(tags, ',') AS tags")


@query
def device_floods(spark, sf):
    found = sessions.floods(timed_events(spark, sf), 4, "6 hours")
    return found.selectExpr("device_id", f"{epoch('window_start')} AS window_start", "events")


# --- evaluation and training -----------------------------------------------------------

def expected() -> str:
    benign = ", ".join(str(i) for i in BENIGN_FRAGMENTS)
    return f"doc_id % {len(adapters.FRAGMENTS)} NOT IN ({benign})"


@query
def quick_pack(spark, sf):
    found = evaluate.quick_detect(planted(spark, sf).select("doc_id", "text"))
    return found.select(F.explode("found").alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("payloads"))


@query
def evaluation_matrix(spark, sf):
    found = evaluate.quick_detect(planted(spark, sf).select("doc_id", "text"))
    return evaluate.evaluation_matrix(found, F.expr("size(found) > 0"), F.expr(expected()))


@query
def method_comparison(spark, sf):
    """Each detection method on its own against the planted truth."""
    calls = signals(spark, sf).selectExpr(
        f"{expected()} AS expected",
        "stack(4, 'patterns', size(findings) > 0, 'entropy', size(secrets) > 0, 'narrative', narrative.detected, "
        "'classifier', classifier.sensitive) AS (method, predicted)")
    return evaluate.evaluation_matrix(calls, F.col("predicted"), F.col("expected"), "method")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a quality label, the training stand-in; category is the language."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("category"))
    marks = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return spread(docs.join(marks, "doc_id"), docs)


@query
def class_balance(spark, sf):
    return evaluate.class_balance(labelled(spark, sf).select("doc_id", "label"))


@query
def stratified_split(spark, sf):
    marks = table(spark, sf, "labels").selectExpr("doc_id", "cast(quality AS int) AS label")
    return training.stratified_split(marks, "doc_id").select("doc_id", "label", "part", "fold")


@query
def char_grams(spark, sf):
    return grams.occurrences(labelled(spark, sf), occurrences=F.lit(True))


@query
def label_by_language(spark, sf):
    """Linear classifier against the quality label, per language."""
    scored = detect(labelled(spark, sf)).selectExpr("category", "label", "cast(classifier.sensitive AS int) AS prediction")
    return evaluate.category_accuracy(scored)


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents in parts and folds, written once for the many passes of a fit."""
    folder = scratch(spark, "split")
    training.stratified_split(labelled(spark, sf), "doc_id").write.parquet(folder)
    return spread(spark.read.parquet(folder))


@query
def model_report(spark, sf):
    """TF-IDF model trained on the labelled documents; hold-out metrics."""
    split = split_rows(spark, sf)
    model = training.fit(split.filter("part = 'train'"))
    return training.score(training.predict(model, split.filter("part = 'test'")))


@query
def model_cross_validation(spark, sf):
    return training.cross_validate(split_rows(spark, sf))


def model_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary with inverse frequencies of the training part, and the features of all labelled documents (stored)."""
    folder = scratch(spark, "model")
    split = training.stratified_split(table(spark, sf, "labels").selectExpr("doc_id", "cast(quality AS int) AS label"), "doc_id")
    docs = labelled(spark, sf).select("doc_id", "text").join(split, "doc_id")
    gradient.gram_counts(docs, "doc_id").write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    train = split.filter("part = 'train'").join(docs.select("doc_id"), "doc_id", "left_semi")
    terms = gradient.inverse_frequencies(gradient.vocabulary(counts.join(train.select("doc_id"), "doc_id", "left_semi")), train.count())
    terms.write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    gradient.features(docs.drop("text"), counts, terms, "doc_id").write.parquet(f"{folder}/rows")
    return terms, spark.read.parquet(f"{folder}/rows")


def trained_passes(terms: DataFrame, rows: DataFrame) -> gradient.Passes:
    return gradient.Passes(rows.filter("part = 'train'"), terms.count())


@query
def model_vocabulary(spark, sf):
    """The most frequent grams of the training part with their inverse document frequency."""
    terms, _ = model_rows(spark, sf)
    return terms.select("term", "occurrences", "df", "position", F.round("idf", 8).alias("idf"))


@query
def model_features(spark, sf):
    """Per labelled document: how many known grams it has, and the sum and the largest of their weights."""
    _, rows = model_rows(spark, sf)
    return rows.selectExpr("doc_id", "label", "part", "fold", "size(positions) AS terms", "round(aggregate(values, 0D, (a, v) -> a + v), 6) AS total",
                           "round(array_max(values), 6) AS largest")


@query
def model_gradient(spark, sf):
    """Loss and gradient of the models of all folds and of the whole, at the same made-up coefficients."""
    terms, rows = model_rows(spark, sf)
    passes = trained_passes(terms, rows)
    at = np.append((np.arange(passes.terms) % 7 - 3) / 10, 0.1)
    loss, slope = passes(np.tile(at, (passes.folds + 1, 1)))
    numbers = [(m, i, float(x)) for m in range(passes.folds + 1) for i, x in enumerate([*slope[m], loss[m]])]  # bounded by the vocabulary
    return spark.createDataFrame(numbers, "model int, place int, number double").withColumn("number", F.round("number", 5))


def one_step(spark: SparkSession, sf: str) -> DataFrame:
    """All labelled documents, judged by models one step of steepest descent away from zero."""
    terms, rows = model_rows(spark, sf)
    passes = trained_passes(terms, rows)
    _, slope = passes(np.zeros((passes.folds + 1, passes.terms + 1)))
    return gradient.predicted(rows, -slope / 100)


@query
def model_step_predictions(spark, sf):
    return one_step(spark, sf).selectExpr("doc_id", "part", "round(margin, 6) AS margin", "round(probability, 6) AS probability")


@query
def model_step_metrics(spark, sf):
    """Hold-out metrics of the model of the whole training part after one step."""
    return training.score(one_step(spark, sf).filter("part = 'test'"))


@query
def model_step_folds(spark, sf):
    """F1 of each fold, judged by the model that left it out, after one step."""
    held = one_step(spark, sf).filter("part = 'train'")
    return evaluate.metrics(evaluate.confusion(held, F.col("prediction") == 1, F.col("label") == 1, "fold")).select("fold", "total", "f1")


@query
def length_profile(spark, sf):
    """Payload lengths in UTF-16 units and their volume factor."""
    sized = planted(spark, sf).selectExpr(f"CAST({utf16_length('text')} AS INT) AS n")
    return (sized.selectExpr("n", f"{risk.volume_factor('n')} AS volume").groupBy("volume")
            .agg(F.count(F.lit(1)).alias("payloads"), F.min("n").alias("shortest"), F.max("n").alias("longest")))


# the other modules of queries register theirs here
from textwarden.plans import streams, variants  # noqa: E402, F401
