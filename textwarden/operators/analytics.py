"""Rollups over the event table. Each is one aggregation that combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textwarden.fixed_values import THREATS
from textwarden.operators.events import list_events

HIGH_RISK = 70
CRITICAL = 90
MEDIUM_RISK = 40


def one_decimal(column: str) -> Column:
    return F.round(F.avg(column), 1)


def risk_summary(events: DataFrame) -> DataFrame:
    def count(test: str) -> Column:
        return F.count_if(F.expr(test))

    return events.agg(
        F.count(F.lit(1)).alias("total"),
        count("action = 'ALLOW'").alias("allowed"),
        count("action = 'WARN'").alias("warned"),
        count("action = 'BLOCK'").alias("blocked"),
        count(f"risk_score >= {HIGH_RISK}").alias("high_risk"),
        count(f"risk_score >= {CRITICAL}").alias("critical"),
    )


def by_action(events: DataFrame) -> DataFrame:
    return events.groupBy("action").agg(F.count(F.lit(1)).alias("events"))


def by_destination(events: DataFrame) -> DataFrame:
    return (events.groupBy(F.col("destination_category").alias("destination"))
            .agg(F.count(F.lit(1)).alias("events"), one_decimal("risk_score").alias("avg_risk"))
            .orderBy(F.desc("avg_risk"), "destination"))


def by_employee(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Employees by blocked events, then by average risk; all of them unless a limit is given."""
    ranked = (events.filter("employee_id <> ''").groupBy("employee_id")
              .agg(F.count(F.lit(1)).alias("total_events"),
                   F.count_if(F.col("action") == "BLOCK").alias("blocks"),
                   one_decimal("risk_score").alias("avg_risk"))
              .orderBy(F.desc("blocks"), F.desc("avg_risk"), "employee_id"))
    return ranked if limit is None else ranked.limit(limit)


def has_tag_part(parts: list[str]) -> Column:
    """Any tag, in upper case, contains one of the parts."""
    tests = " OR ".join(f"contains(t, '{p}')" for p in parts)
    return F.expr(f"exists(detected_tags, x -> exists(array(upper(x)), t -> {tests}))")


def _external(category: str = "destination_category") -> Column:
    upper = F.upper(F.col(category))
    return upper.contains("EXTERNAL_AI") | upper.contains("UNKNOWN_SAAS")


def threat_counts(events: DataFrame) -> DataFrame:
    """Events per threat family and per technique, in one pass."""
    counts = {}
    for family, technique, parts in THREATS:
        flag = has_tag_part(parts)
        counts[family] = F.count_if(flag)
        if technique:
            counts[technique.lower()] = F.count_if(flag)
    counts["t1567"] = F.count_if(_external())
    counts["t1052"] = F.count_if(F.col("content_length") > 500)
    counts["financial"] = counts["strategic"]
    return events.agg(*[c.alias(name) for name, c in counts.items()])


def threat_radar(events: DataFrame) -> DataFrame:
    """One row per radar axis; the chart shows at least 1 on each."""
    axes = [("Credentials & Secrets", "credentials"), ("Infrastructure & DB", "infrastructure"),
            ("Bulk PII / Identity", "bulk_pii"), ("Strategic Narrative", "strategic"),
            ("Financial Data", "financial"), ("Source Code", "source_code")]
    pairs = ", ".join(f"'{label}', {column}" for label, column in axes)
    return (threat_counts(events).selectExpr(f"stack({len(axes)}, {pairs}) AS (axis, events)")
            .selectExpr("axis", "events", "greatest(events, 1) AS charted"))


def technique_hits(events: DataFrame) -> DataFrame:
    names = ["T1552", "T1567", "T1020", "T1048", "T1005", "T1052"]
    pairs = ", ".join(f"'{n}', {n.lower()}" for n in names)
    return threat_counts(events).selectExpr(f"stack({len(names)}, {pairs}) AS (technique, events)")


def recent_flow(events: DataFrame, last: int = 200) -> DataFrame:
    """Scanned and blocked counts over the most recent events."""
    return list_events(events, last).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("action") == "BLOCK").alias("blocked"))


def destination_levels(events: DataFrame) -> DataFrame:
    """Risk level of each destination by its rounded average."""
    rounded = F.floor(F.col("avg_risk") + F.lit(0.5))
    return by_destination(events).withColumn(
        "level", F.when(rounded >= HIGH_RISK, "HIGH").when(rounded >= MEDIUM_RISK, "MEDIUM").otherwise("LOW"))


def score_bands(events: DataFrame) -> DataFrame:
    band = (F.when(F.col("risk_score") >= HIGH_RISK, "high")
            .when(F.col("risk_score") >= MEDIUM_RISK, "medium").otherwise("low"))
    return events.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("events"))


def top_tags(events: DataFrame, limit: int = 8) -> DataFrame:
    return (events.select(F.explode("detected_tags").alias("tag")).groupBy("tag")
            .agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), "tag").limit(limit))


def action_counts(events: DataFrame) -> DataFrame:
    """The three known actions side by side; other values are not counted."""
    return events.agg(*[
        F.count_if(F.col("action") == a).alias(a.lower()) for a in ("ALLOW", "WARN", "BLOCK")])


def policy_hits(judged: DataFrame) -> DataFrame:
    return judged.groupBy("policy_id", "policy_override", "final_decision").agg(F.count(F.lit(1)).alias("payloads"))


def findings_rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Payloads and matches per detector and category, with subtotals over the given keys."""
    return findings.rollup(*keys).agg(F.count(F.lit(1)).alias("findings"), F.sum("n").alias("matches"))
