"""Linear text classifier: weighted counts of 107 fixed character features."""

from __future__ import annotations

from textwarden.fixed_values import LINEAR_BIAS, LINEAR_FEATURES
from textwarden.functions.text import half_up, literal_rows, quote

# --- fixed values -----------------------------------------------------------
LONG_TEXT = 300
LONG_PENALTY = 0.4
SCHEMA = "i:int,feature:string,needle:string,weight:double,factor:double"
# A feature holding one of these is looked for only in texts that hold it too.
MARKERS = ["_", "://", "begin ", "----", "k-", "xox", "=", ":", "eyj", "acquisition"]


def feature_rows() -> list[dict]:
    return [
        {"i": i, "feature": feature, "needle": feature.lower(), "weight": weight,
         "factor": weight * (1 + abs(weight) / 5.0)}
        for i, (feature, weight) in enumerate(LINEAR_FEATURES)
    ]


def feature_hits(low: str = "_low") -> str:
    """The features present in the lower-cased text, in library order, with contributions."""
    groups: dict[str, list[dict]] = {m: [] for m in ["", *MARKERS]}
    for row in feature_rows():
        groups[next((m for m in MARKERS if m in row["needle"]), "")].append(row)
    parts = [literal_rows(groups[""], SCHEMA)]
    for marker in MARKERS:
        parts.append(f"CASE WHEN contains({low}, {quote(marker)}) THEN {literal_rows(groups[marker], SCHEMA)} "
                     f"ELSE {literal_rows([], SCHEMA)} END")
    present = f"filter(concat({', '.join(parts)}), f -> contains({low}, f.needle))"
    count = f"CAST((octet_length({low}) - octet_length(replace({low}, f.needle, ''))) / octet_length(f.needle) AS INT)"
    counted = (f"transform({present}, f -> named_struct('i', f.i, 'feature', f.feature, 'weight', f.weight, "
               f"'factor', f.factor, 'n', {count}))")
    return (f"array_sort(transform({counted}, f -> named_struct('i', f.i, 'feature', f.feature, "
            f"'weight', f.weight, 'n', f.n, 'contribution', f.factor * ln(1 + f.n))))")


def raw_score(hits: str, text_length: str) -> str:
    """Bias plus contributions, with the penalty for long text without positive signals."""
    total = f"aggregate({hits}, CAST({LINEAR_BIAS} AS DOUBLE), (a, h) -> a + h.contribution)"
    return (f"transform(array({total}), s -> CASE WHEN {text_length} > {LONG_TEXT} AND s < {LINEAR_BIAS + 1.0}D "
            f"THEN s - {LONG_PENALTY}D ELSE s END)[0]")


def top_features(hits: str, k: int = 5) -> str:
    """Names of the strongest positive features, cut to 24 characters."""
    strong = f"filter({hits}, h -> h.weight > 0 AND h.contribution > 0.05D)"
    order = ("(a, b) -> CASE WHEN a.contribution > b.contribution THEN -1 "
             "WHEN a.contribution < b.contribution THEN 1 ELSE a.i - b.i END")
    name = "CASE WHEN length(h.feature) > 24 THEN concat(substring(h.feature, 1, 24), '…') ELSE h.feature END"
    return f"transform(slice(array_sort({strong}, {order}), 1, {k}), h -> {name})"


def classify(score: str, hits: str) -> str:
    """Struct of probability (4 places), sensitive, confidence, sensitivity_score, top_features."""
    curve = (f"CASE WHEN p >= 0.5D THEN {half_up('40D + (p - 0.5D) * 120D')} "
             f"WHEN p >= 0.3D THEN {half_up('(p - 0.3D) * 200D')} ELSE 0 END")
    return (f"transform(array(1D / (1D + exp(-{score}))), p -> named_struct("
            f"'probability', round(p, 4), 'sensitive', p >= 0.5D, "
            f"'confidence', CASE WHEN p >= 0.8D THEN 'HIGH' WHEN p >= 0.55D THEN 'MEDIUM' ELSE 'LOW' END, "
            f"'sensitivity_score', least(100, greatest(0, {curve})), "
            f"'top_features', {top_features(hits)}))[0]")
