"""Risk scoring: five factors, one 0-100 score, three decision bands."""

from __future__ import annotations

from textwarden.fixed_values import (
    ACTION_OTHER,
    ACTION_SCORES,
    DECISION_BANDS,
    DECISION_TOP,
    RISK_WEIGHTS,
    VOLUME_STEPS,
    VOLUME_TOP,
)
from textwarden.functions.destination import is_external
from textwarden.functions.text import half_up, quote


def sensitivity_factor(det_max: str, narrative: str, secrets: str, classifier: str) -> str:
    """Strongest of the four signals; 0 when none fired."""
    return (f"greatest({det_max}, "
            f"CASE WHEN {narrative}.detected THEN {narrative}.sensitivity ELSE 0 END, "
            f"CASE WHEN {secrets} > 0 THEN least(100, 70 + {secrets} * 10) ELSE 0 END, "
            f"CASE WHEN {classifier}.sensitive AND {classifier}.confidence <> 'LOW' "
            f"THEN {classifier}.sensitivity_score ELSE 0 END)")


def volume_factor(text_length: str) -> str:
    steps = " ".join(f"WHEN {text_length} <= {limit} THEN {score}" for limit, score in VOLUME_STEPS)
    return f"CASE {steps} ELSE {VOLUME_TOP} END"


def action_factor(action_type: str) -> str:
    cases = " ".join(f"WHEN '{action}' THEN {score}" for action, score in ACTION_SCORES.items())
    return f"CASE {action_type} {cases} ELSE {ACTION_OTHER} END"


def context_factor(tier: str, categories: str) -> str:
    def has(*names: str) -> str:
        return f"arrays_overlap({categories}, array({', '.join(quote(n) for n in names)}))"

    external = is_external(tier)
    business = has("FINANCIAL", "FINANCIAL_PROJECTION", "STRATEGIC_BUSINESS", "CONFIDENTIAL_PROJECT")
    return (f"CASE WHEN {external} AND {has('CREDENTIAL')} THEN 100 WHEN {external} AND {business} THEN 90 "
            f"WHEN {external} AND {has('PII')} THEN 80 WHEN {tier} = 'SUSPICIOUS' THEN 95 "
            f"WHEN {tier} IN ('INTERNAL', 'APPROVED_AI') THEN 20 ELSE 30 END")


def risk_score(s: str, d: str, v: str, a: str, c: str) -> str:
    w = RISK_WEIGHTS
    full = f"{s} * {w['S']}D + {d} * {w['D']}D + {v} * {w['V']}D + {a} * {w['A']}D + {c} * {w['C']}D"
    quiet = f"least(10, {half_up(f'{d} * 0.04D + {v} * 0.05D')})"
    return f"CASE WHEN {s} = 0 THEN {quiet} ELSE least(100, {half_up(full)}) END"


def risk_decision(score: str) -> str:
    bands = " ".join(f"WHEN {score} <= {limit} THEN '{decision}'" for limit, decision, _ in DECISION_BANDS)
    return f"CASE {bands} ELSE '{DECISION_TOP[0]}' END"


def decision_label(score: str) -> str:
    bands = " ".join(f"WHEN {score} <= {limit} THEN '{label}'" for limit, _, label in DECISION_BANDS)
    return f"CASE {bands} ELSE '{DECISION_TOP[1]}' END"


def breakdown(factors: str, score: str) -> str:
    """The factor strings shown to a reviewer, as a map."""
    # --- fixed values: (key, factor)
    names = [("Data Sensitivity", "S"), ("Destination Risk", "D"), ("Data Volume", "V"),
             ("Action Vector", "A"), ("Context Risk", "C")]
    entries = [f"'{key}', concat({factors}.{f.lower()}, '/100 × {RISK_WEIGHTS[f]:g}')" for key, f in names]
    return f"map({', '.join(entries)}, 'Final Score', concat({score}, '/100'))"
