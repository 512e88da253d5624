"""The payload scan: detect, classify the destination, score, and judge.

``detect`` looks only at the text and drops it; ``judge`` looks only at the narrow result,
the destination and the action. A text that leaves through many events is thus scanned
once, and the text never passes a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textwarden.functions import destination, detectors, entropy, linear, narrative, policy, risk
from textwarden.functions.text import is_blank, plain_blanks, utf16_length
from textwarden.operators.rule_table import RuleTable
from textwarden.operators.sealed import sealed
from textwarden.options import DEFAULTS, ScanOptions

SIGNALS = ["text_length", "sha256_prefix", "findings", "secrets", "narrative", "classifier"]


def scannable(df: DataFrame, text: str = "text") -> DataFrame:
    """Payloads with something to scan: null and blank texts are skipped."""
    return df.filter(f"NOT {is_blank(text)}")


def with_gates(df: DataFrame, text: str = "text", options: ScanOptions = DEFAULTS) -> DataFrame:
    """Add the text with plain blanks, its long tokens and the shared cheap tests.

    One pass for the long tokens serves the entropy analysis and the credential gates.
    """
    shortest = min(entropy.shortest_secret(options.entropy_threshold), detectors.LONG_TOKEN)
    return (df.selectExpr("*", f"{plain_blanks(text)} AS _plain")
            .selectExpr("*", *detectors.gate_columns(), f"{entropy.tokens('_plain', shortest)} AS _tokens")
            .selectExpr("*", *detectors.late_gate_columns()))


def with_hits(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the detector counts (``hits``), without the other signals."""
    gated = with_gates(scannable(df, text), text)
    keep = [c for c in df.columns if c != text]
    return sealed(gated.selectExpr(*keep, f"{detectors.hit_counts()} AS hits"), keep, ["hits"])


def detect(df: DataFrame, text: str = "text", options: ScanOptions = DEFAULTS) -> DataFrame:
    """Replace the text by what was found in it (see ``SIGNALS``)."""
    keep = [c for c in df.columns if c != text]
    watched = names_codename(options.codenames)
    signals = with_gates(scannable(df, text), text, options).selectExpr(
        *keep,
        f"CAST({utf16_length(text)} AS INT) AS text_length",
        f"substring(sha2({text}, 256), 1, 16) AS sha256_prefix",
        f"{detectors.hit_counts()} AS _hits",
        f"{entropy.secret_findings('_tokens', options.entropy_threshold)} AS secrets",
        f"{narrative.indicator_counts()} AS _counts",
        f"{linear.feature_hits()} AS _features",
        f"{watched} AS _watched",
    )
    scored = signals.selectExpr(
        *keep, "text_length", "sha256_prefix", "secrets", "_features", "_watched",
        f"{detectors.findings('_hits')} AS findings",
        f"{narrative.found('_counts')} AS _found",
        f"{linear.raw_score('_features', 'text_length')} AS _score",
    )
    named = narrative.narrative("_found")
    classified = scored.selectExpr(
        *keep, "text_length", "sha256_prefix", "secrets", "findings", "_watched",
        f"{named} AS narrative", f"{linear.classify('_score', '_features')} AS classifier")
    if options.codenames:
        classified = classified.withColumn("narrative", F.col("narrative").withField("categories", F.expr(
            "array_union(narrative.categories, CASE WHEN _watched THEN array('CONFIDENTIAL_PROJECT') "
            "ELSE cast(array() AS array<string>) END)")))
    return sealed(classified, keep, SIGNALS)


def _plain(df: DataFrame, text: str, *more: str) -> tuple[DataFrame, list[str]]:
    """Scannable payloads with the text with plain blanks, then the given columns; and the kept columns."""
    keep = [c for c in df.columns if c != text]
    plain = scannable(df, text).selectExpr(*keep, text, f"{plain_blanks(text)} AS _plain")
    return plain.selectExpr("*", *more), keep


def with_secrets(df: DataFrame, text: str = "text", options: ScanOptions = DEFAULTS) -> DataFrame:
    """Only the tokens that look like secrets (``secrets``), without the other signals."""
    plain, keep = _plain(df, text, f"{entropy.tokens('_plain', entropy.shortest_secret(options.entropy_threshold))} AS _tokens")
    found = plain.selectExpr(*keep, f"{entropy.secret_findings('_tokens', options.entropy_threshold)} AS secrets")
    return sealed(found, keep, ["secrets"])


def with_narrative(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the narrative indicators (``narrative``), without the other signals."""
    plain, keep = _plain(df, text, "lower(_plain) AS _low", "(contains(_plain, '=') OR contains(_plain, ':')) AS _assign")
    found = (plain.selectExpr(*keep, f"{narrative.indicator_counts()} AS _counts")
             .selectExpr(*keep, f"{narrative.found('_counts')} AS _found"))
    return sealed(found.selectExpr(*keep, f"{narrative.narrative('_found')} AS narrative"), keep, ["narrative"])


def with_classifier(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the linear classifier (``classifier``), without the other signals."""
    plain, keep = _plain(df, text, "lower(_plain) AS _low", f"CAST({utf16_length(text)} AS INT) AS text_length")
    scored = (plain.selectExpr(*keep, "text_length", f"{linear.feature_hits()} AS _features")
              .selectExpr(*keep, "_features", f"{linear.raw_score('_features', 'text_length')} AS _score"))
    return sealed(scored.selectExpr(*keep, f"{linear.classify('_score', '_features')} AS classifier"), keep, ["classifier"])


def names_codename(codenames: tuple[str, ...], text: str = "_plain") -> str:
    """True when the text holds one of the watched names as whole words, in any case."""
    if not codenames:
        return "false"
    words = "|".join("".join(c if c.isalnum() or c == "_" else "\\" + c for c in name) for name in codenames)
    pattern = rf"(?i)(?<![\w-])(?:{words})(?![\w-])"
    return f"{text} RLIKE '{pattern}'".replace("\\", "\\\\")


def event_tags() -> str:
    """Distinct tags of an event, in first-seen order."""
    return ("array_distinct(concat(flatten(transform(findings, f -> f.tags)), narrative.tags, "
            "filter(array('HIGH_ENTROPY_SECRET'), t -> size(secrets) > 0), "
            "filter(array('ML_SENSITIVE'), t -> classifier.sensitive)))")


def summarize_signals(df: DataFrame) -> DataFrame:
    """Reduce the signals to what scoring needs: a few numbers, categories and tags."""
    det_max = "coalesce(array_max(transform(findings, f -> f.sensitivity)), 0)"
    return df.selectExpr(
        *[c for c in df.columns if c not in ("findings", "narrative", "secrets", "classifier")],
        "concat(array_distinct(transform(findings, f -> f.category)), narrative.categories) AS categories",
        "concat(flatten(transform(findings, f -> f.tags)), narrative.tags, filter(array('ML_SENSITIVE'), "
        "t -> classifier.sensitive AND size(classifier.top_features) > 0)) AS policy_tags",
        f"{event_tags()} AS detected_tags",
        f"{risk.sensitivity_factor(det_max, 'narrative', 'size(secrets)', 'classifier')} AS s",
        "classifier.probability AS ml_probability",
        "classifier.confidence AS ml_confidence",
    )


def judge(df: DataFrame, rules: Column | RuleTable | None = None, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Score and decide payloads that carry summarised signals, ``host`` and ``action_type``.

    ``rules`` is an ordered array of rules or a compiled table; without it the built-in rules hold.
    """
    features = ("categories", "policy_tags", "tier", "risk_score")
    if isinstance(rules, RuleTable):
        read, first = rules.columns(), rules.first_match(*features)
    else:
        read = [(F.expr(policy.rules_literal(options.extra_rules)) if rules is None else rules).alias("_rules")]
        first = policy.first_match("_rules", *features)
    tier = destination.tier_of("host", "_root", options.approved_ai_domains, options.restricted_destinations)
    placed = (df.selectExpr("*", f"{destination.root_domain('host')} AS _root")
              .selectExpr("*", f"{tier} AS tier"))
    factored = placed.selectExpr(
        "*",
        f"{destination.tier_score('tier')} AS d",
        f"{risk.volume_factor('text_length')} AS v",
        f"{risk.action_factor('action_type')} AS a",
        f"{risk.context_factor('tier', 'categories')} AS c",
    )
    clean = "size(categories) = 0 AND size(policy_tags) = 0"
    judged = (
        factored.selectExpr("*", f"{risk.risk_score('s', 'd', 'v', 'a', 'c')} AS risk_score")
        .select("*", *read, F.expr(risk.risk_decision("risk_score")).alias("risk_decision"))
        .selectExpr("*", f"{first} AS _rule")
        .selectExpr("*", f"{policy.outcome('_rule', clean, 'risk_score', 'risk_decision')} AS _policy")
    )
    kept = [c for c in df.columns if c != "s"]
    verdict = ["tier", "factors", "risk_score", "risk_decision", "final_decision", "policy_id", "policy_name",
               "policy_override", "reason", "enforced"]
    final = judged.selectExpr(
        *kept, "tier", "named_struct('s', s, 'd', d, 'v', v, 'a', a, 'c', c) AS factors",
        "risk_score", "risk_decision", "_policy.*", f"{str(not options.audit_only).lower()} AS enforced",
    )
    return sealed(final, kept, verdict)


def scan(df: DataFrame, text: str = "text", rules: Column | RuleTable | None = None,
         options: ScanOptions = DEFAULTS) -> DataFrame:
    """The whole pipeline over payloads with ``text``, ``host`` and ``action_type``."""
    return judge(summarize_signals(detect(df, text, options)), rules, options)
