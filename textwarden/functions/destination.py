"""Destination classification: host name to trust tier."""

from __future__ import annotations

from collections.abc import Sequence

from textwarden.fixed_values import (
    APPROVED_AI_DOMAINS,
    APPROVED_SAAS_DOMAINS,
    EXTERNAL_AI_DOMAINS,
    EXTERNAL_TIERS,
    INTERNAL_HOSTS,
    SUSPICIOUS_DOMAINS,
    TIERS,
)
from textwarden.functions.regex import java
from textwarden.functions.text import quote


def host_of(url: str, label: str | None = None) -> str:
    """Lower-cased host in a label text if there is one, else that of the URL, else ''."""
    host = f"lower(try_parse_url({url}, 'HOST'))"
    if label is None:
        return f"coalesce({host}, '')"
    word = f"lower(regexp_extract({label}, {quote('(?i)([a-z0-9.-]+[.][a-z]{2,})')}, 1))"
    return f"coalesce(nullif({word}, ''), {host}, '')"


def root_domain(host: str) -> str:
    """Last two labels of the host, without a leading ``www.``."""
    low = f"lower(coalesce({host}, ''))"
    bare = f"regexp_replace({low}, '^www[.]', '')"
    return f"CASE WHEN contains({bare}, '.') THEN substring_index({bare}, '.', -2) ELSE {low} END"


def tier_of(host: str, root: str, approved: Sequence[str] = (), restricted: Sequence[str] = ()) -> str:
    """Trust tier; internal beats suspicious beats external AI beats the approved sets."""
    def listed(domains: Sequence[str]) -> str:
        names = ", ".join(quote(d) for d in domains)
        return f"({host} IN ({names}) OR {root} IN ({names}))"

    internal = quote("(?i)" + "|".join(java(p) for p in INTERNAL_HOSTS))
    managed = f"WHEN {listed(approved)} THEN 'APPROVED_AI' " if approved else ""
    return (f"CASE WHEN {host} RLIKE {internal} THEN 'INTERNAL' "
            f"WHEN {listed([*SUSPICIOUS_DOMAINS, *restricted])} THEN 'SUSPICIOUS' {managed}"
            f"WHEN {listed(EXTERNAL_AI_DOMAINS)} THEN 'EXTERNAL_AI' "
            f"WHEN {listed(APPROVED_AI_DOMAINS)} THEN 'APPROVED_AI' "
            f"WHEN {listed(APPROVED_SAAS_DOMAINS)} THEN 'APPROVED_SAAS' ELSE 'UNKNOWN_SAAS' END")


def _by_tier(tier: str, position: int) -> str:
    def literal(value) -> str:
        return quote(value) if isinstance(value, str) else str(value)

    cases = " ".join(f"WHEN '{name}' THEN {literal(row[position])}" for name, row in TIERS.items())
    return f"CASE {tier} {cases} END"


def tier_score(tier: str) -> str:
    return _by_tier(tier, 0)


def tier_label(tier: str) -> str:
    return _by_tier(tier, 1)


def is_external(tier: str) -> str:
    return f"{tier} IN ({', '.join(quote(t) for t in EXTERNAL_TIERS)})"
