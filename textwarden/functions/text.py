"""Small text and number helpers shared by every detector.

Builders take and return the SQL text of an expression: the scan is one wide projection of
several hundred terms, and one ``expr`` per column builds far faster than a call per term.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from textwarden.functions.regex import SPACE_CHARS

# rarer blanks and line ends; no pattern tells them apart from U+00A0 and CR respectively
_LINE_ENDS = "\u2028\u2029"
_RARE_BLANKS = "".join(c for c in SPACE_CHARS if c > "\u00a0" and c not in _LINE_ENDS)
_BEYOND = r"[\u1680-\uffff]"


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_ascii(text: str) -> str:
    return f"(octet_length({text}) = length({text}))"


def plain_blanks(text: str) -> str:
    """The text with rare blanks as U+00A0 and rare line ends as CR; length is unchanged."""
    source = _RARE_BLANKS + _LINE_ENDS
    target = "\u00a0" * len(_RARE_BLANKS) + "\r" * len(_LINE_ENDS)
    # one range test rules out most text; a class naming each blank would be slow in Java
    rare = " OR ".join(f"contains({text}, {quote(c)})" for c in source)
    return (f"CASE WHEN {is_ascii(text)} OR NOT {text} RLIKE {quote(_BEYOND)} THEN {text} WHEN {rare} "
            f"THEN translate({text}, {quote(source)}, {quote(target)}) ELSE {text} END")


def trimmed(text: str) -> str:
    return f"btrim({text}, {quote(SPACE_CHARS)})"


def is_blank(text: str) -> str:
    """No character other than white space; null counts as blank."""
    return f"coalesce({trimmed(text)} = '', true)"


def utf16_length(text: str) -> str:
    """Length in UTF-16 units: code points, plus one for each outside the basic plane."""
    return (f"CASE WHEN {is_ascii(text)} THEN length({text}) "
            f"ELSE octet_length(encode({text}, 'UTF-16BE')) DIV 2 END")


def has_astral(text: str) -> str:
    """Holds a character that takes two UTF-16 units."""
    return f"(NOT {is_ascii(text)} AND octet_length(encode({text}, 'UTF-16BE')) > 2 * length({text}))"


def half_up(value: str) -> str:
    """Whole number nearest to value, halves upwards."""
    return f"CAST(floor({value} + 0.5D) AS INT)"


def literal_rows(rows: list[dict], schema: str) -> str:
    """A constant array of structs; the optimizer folds it to one literal."""
    return f"from_json({quote(json.dumps(rows))}, 'array<struct<{schema}>>')"


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
