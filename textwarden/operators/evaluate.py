"""Evaluation: how well detection or prediction agrees with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textwarden.fixed_values import QUICK_PACK
from textwarden.functions.entropy import measured
from textwarden.functions.regex import java_plain
from textwarden.functions.text import plain_blanks, quote, utf16_length
from textwarden.operators.sealed import sealed

QUICK_TOKEN = 16
QUICK_ENTROPY = 4.2
# The bulk check only asks whether a match exists, so the open-ended repeats are cut to their
# minimum; the result is the same and the time linear.
_EXISTS = {
    "Bulk": r"[^,\n],(?:[^,\n]+,){3}[^,\n]+\n(?:[^,\n]+,){4}",
    # from the first BEGIN of a line only
    "Private Key": r"(?<![^\n\r])(?>[^\n\r]*?BEGIN).+PRIVATE KEY",
    # only starts before the last ``@`` can match
    "DB Connection": r"postgres:\/\/[^:]++:[^@]++@",
}


def quick_detect(df: DataFrame, text: str = "text") -> DataFrame:
    """The lighter pack of 13 checks: names found and the highest sensitivity."""
    keep = [c for c in df.columns if c != text]
    tests = []
    for name, category, sensitivity, pattern, flags in QUICK_PACK:
        if pattern is None:
            long = f"regexp_extract_all(_plain, {quote(java_plain(chr(92) + 'S{10,}+'))}, 0)"
            scored = measured(f"filter({long}, t -> ({utf16_length('t')}) >= {QUICK_TOKEN})")
            test = f"exists({scored}, m -> m.h >= {QUICK_ENTROPY}D)"
        else:
            chosen = _EXISTS.get("Bulk" if category == "BULK_DATA" else name, pattern)
            read = "left(_plain, length(_plain) - length(substring_index(_plain, '@', -1)))" if name == "DB Connection" else "_plain"
            test = f"{read} RLIKE {quote(java_plain(chosen, flags))}"
        tests.append(f"named_struct('name', '{name}', 'sensitivity', {sensitivity}, 'hit', {test})")
    found = (df.selectExpr(*keep, f"{plain_blanks(text)} AS _plain")
             .selectExpr(*keep, f"filter(array({', '.join(tests)}), c -> c.hit) AS _found"))
    named = found.selectExpr(
        *keep, "transform(_found, c -> c.name) AS found",
        "coalesce(array_max(transform(_found, c -> c.sensitivity)), 0) AS max_sensitivity")
    return sealed(named, keep, ["found", "max_sensitivity"])


def confusion(df: DataFrame, predicted: Column, expected: Column, *keys: str) -> DataFrame:
    """True and false positives and negatives, in one pass."""
    p, e = predicted, expected
    counts = [F.count_if(p & e).alias("tp"), F.count_if(p & ~e).alias("fp"),
              F.count_if(~p & ~e).alias("tn"), F.count_if(~p & e).alias("fn")]
    return df.groupBy(*keys).agg(*counts) if keys else df.agg(*counts)


def _ratio(top: str, bottom: str, empty: float) -> str:
    return f"CASE WHEN {bottom} = 0 THEN {empty}D ELSE ({top}) / ({bottom}) END"


def metrics(confused: DataFrame, empty: float = 0.0) -> DataFrame:
    """Accuracy, precision, recall and F1, 4 places; ``empty`` where a denominator is zero."""
    scored = confused.selectExpr(
        "*", "tp + fp + tn + fn AS total",
        f"{_ratio('tp', 'tp + fp', empty)} AS _p", f"{_ratio('tp', 'tp + fn', empty)} AS _r")
    return scored.selectExpr(
        *confused.columns, "total",
        f"round({_ratio('tp + tn', 'total', empty)}, 4) AS accuracy",
        "round(_p, 4) AS precision", "round(_r, 4) AS recall",
        f"round(CASE WHEN _p + _r > 0 THEN 2 * _p * _r / (_p + _r) ELSE {empty}D END, 4) AS f1")


def evaluation_matrix(df: DataFrame, predicted: Column, expected: Column, *keys: str) -> DataFrame:
    """Detection against expectation; empty denominators count as perfect."""
    return metrics(confusion(df, predicted, expected, *keys), empty=1.0).withColumn("passed", F.expr("tp + tn"))


def category_accuracy(df: DataFrame, category: str = "category") -> DataFrame:
    """Correct predictions per category of a table with ``label`` and ``prediction``."""
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("prediction") == F.col("label")).alias("correct"),
        F.when(F.max("label") == 1, "leak").otherwise("benign").alias("type"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label with the balanced class weight n / (2 * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (F.lit(2.0) * F.col("rows")))
