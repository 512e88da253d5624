"""Narrative indicators: business language that hints at non-public plans."""

from __future__ import annotations

from textwarden.fixed_values import INDICATORS
from textwarden.functions.delimiters import possessive
from textwarden.functions.regex import java_plain
from textwarden.functions.text import literal_rows, quote, trimmed, utf16_length

# --- fixed values -----------------------------------------------------------
MIN_TEXT = 15
DETECT_WEIGHT = 45
SCHEMA = "id:string,label:string,category:string,weight:int,tags:array<string>"
# a word every match contains, tested before the pattern; with ASSIGNED also ``=`` or ``:``
ASSIGNED = {"PROJECT_CODENAME", "EMBARGO_LAUNCH", "CONFIDENTIAL_PRICING"}
REQUIRED = {
    "PROJECT_CODENAME": ["codename"],
    "MA_STRATEGIC_TARGET": ["acquisition", "diligence", "takeover"],
    "EMBARGO_LAUNCH": ["date"],
    "REVENUE_PROJECTION": ["revenue", "forecasted", "target", "margin"],
    "CONFIDENTIAL_PRICING": ["pricing", "value", "acv", "tcv", "card"],
    "LEGAL_NDA_DISCLOSURE": ["confidential", "distribute", "agreement", "disclosure"],
}


def indicator_counts(text: str = "_plain", low: str = "_low") -> str:
    """One match count per indicator, in library order."""
    counts = []
    for name, *_, pattern in INDICATORS:
        gate = "(" + " OR ".join(f"contains({low}, '{word}')" for word in REQUIRED[name]) + ")"
        if name in ASSIGNED:
            gate = f"_assign AND {gate}"
        counts.append(f"CASE WHEN {gate} THEN regexp_count({text}, {quote(java_plain(possessive(pattern), 'i'))}) ELSE 0 END")
    none = ", ".join("0" for _ in INDICATORS)
    return (f"CASE WHEN ({utf16_length(trimmed(text))}) >= {MIN_TEXT} "
            f"THEN array({', '.join(counts)}) ELSE array({none}) END")


def found(counts: str) -> str:
    """The indicators that occur, in library order."""
    keys = ("id", "label", "category", "weight", "tags")
    specs = literal_rows([dict(zip(keys, i[:5])) for i in INDICATORS], SCHEMA)
    fields = ", ".join(f"'{k}', {specs}[i].{k}" for k in keys)
    return (f"transform(filter(sequence(0, {len(INDICATORS) - 1}), i -> {counts}[i] > 0), "
            f"i -> named_struct({fields}, 'n', {counts}[i]))")


def narrative(findings: str) -> str:
    """Struct of findings, categories, tags, score, detected and sensitivity.

    Categories and tags are reported even below the detection weight.
    """
    weight = f"aggregate({findings}, 0, (a, f) -> a + f.weight * least(f.n, 2))"
    detected = f"(size({findings}) >= 2 OR {weight} >= {DETECT_WEIGHT})"
    return (f"named_struct('findings', {findings}, "
            f"'categories', array_distinct(transform({findings}, f -> f.category)), "
            f"'tags', array_distinct(flatten(transform({findings}, f -> f.tags))), "
            f"'score', least(100, {weight}), 'detected', {detected}, "
            f"'sensitivity', CASE WHEN {detected} THEN least(95, greatest(65, {weight})) ELSE 0 END)")
