"""Options of a scan job."""

from __future__ import annotations

from dataclasses import dataclass, field

from textwarden.functions.entropy import ENTROPY_THRESHOLD


@dataclass(frozen=True)
class ScanOptions:
    """Switches an administrator may set; the defaults reproduce the standard behaviour."""

    entropy_threshold: float = ENTROPY_THRESHOLD
    #: keep the decision but mark it as not enforced
    audit_only: bool = False
    #: domains added to the approved AI tier
    approved_ai_domains: tuple[str, ...] = ()
    #: domains added to the suspicious tier
    restricted_destinations: tuple[str, ...] = ()
    #: secret project names; a payload naming one gets category CONFIDENTIAL_PROJECT
    codenames: tuple[str, ...] = ()
    #: share of harmless (ALLOW) events kept, 0 to 100
    sample_rate: int = 100
    #: restricted file types are blocked outright
    quarantine_files: bool = True
    #: drop all events when the service is switched off
    enabled: bool = True
    #: hash silent ALLOW payloads too; when off they carry the word ``pending``
    hash_allowed: bool = True
    #: a stored rule switched off is skipped; when off the flag is ignored
    honour_rule_enabled: bool = False
    #: extra policy rules as (id, name, action, categories, tags, tiers, max_risk, reason)
    extra_rules: tuple = field(default_factory=tuple)


DEFAULTS = ScanOptions()
