"""Policy evaluation against an ordered array of rules, one payload at a time."""

from __future__ import annotations

from collections.abc import Iterable

from textwarden.fixed_values import CLEAN_REASON, POLICIES
from textwarden.functions.text import literal_rows, quote

RULE_SCHEMA = (
    "rank:int,source:int,ord:bigint,id:string,name:string,action:string,categories:array<string>,"
    "tags:array<string>,tiers:array<string>,max_risk:double,reason:string"
)
KEYS = ("id", "name", "action", "categories", "tags", "tiers", "max_risk", "reason")
# blocking rules are tried first, then warnings, then allowances
ACTION_RANK = {"BLOCK": 0, "WARN": 1, "ALLOW": 2}


def rule_rows(extra: Iterable[tuple] = ()) -> list[dict]:
    """Extra rules and built-in rules in evaluation order; extra ones win within an action."""
    rows = []
    for source, rules in enumerate((extra, POLICIES)):
        for i, rule in enumerate(rules):
            row = dict(zip(KEYS, rule)) | {"source": source, "ord": i}
            if row["action"] in ACTION_RANK:
                rows.append(row | {"rank": ACTION_RANK[row["action"]]})
    return sorted(rows, key=lambda r: (r["rank"], r["source"], r["ord"]))


def rules_literal(extra: Iterable[tuple] = ()) -> str:
    """The rules as a constant array, in evaluation order."""
    return literal_rows(rule_rows(extra), RULE_SCHEMA)


def first_match(rules: str, categories: str, tags: str, tier: str, score: str) -> str:
    """First rule all of whose stated conditions hold, or null."""
    def unstated(field: str) -> str:
        return f"coalesce(size(r.{field}), 0) <= 0"

    return (f"get(filter({rules}, r -> "
            f"({unstated('categories')} OR arrays_overlap(r.categories, {categories})) "
            f"AND ({unstated('tags')} OR arrays_overlap(r.tags, {tags})) "
            f"AND ({unstated('tiers')} OR array_contains(r.tiers, {tier})) "
            f"AND (r.max_risk IS NULL OR {score} <= r.max_risk)), 0)")


def outcome(rule: str, clean: str, score: str, decision: str) -> str:
    """Struct of final decision, matched rule, override flag and reason."""
    matched = f"(NOT ({clean}) AND {rule} IS NOT NULL)"
    fallback = f"concat('Risk score ', {score}, '/100 — no explicit policy rule matched.')"
    return (f"named_struct('final_decision', CASE WHEN {clean} THEN 'ALLOW' WHEN {matched} THEN {rule}.action "
            f"ELSE {decision} END, "
            f"'policy_id', CASE WHEN {matched} THEN {rule}.id END, "
            f"'policy_name', CASE WHEN {matched} THEN {rule}.name END, "
            f"'policy_override', coalesce({matched} AND {rule}.action <> {decision}, false), "
            f"'reason', CASE WHEN {clean} THEN {quote(CLEAN_REASON)} WHEN {matched} THEN {rule}.reason "
            f"ELSE {fallback} END)")
