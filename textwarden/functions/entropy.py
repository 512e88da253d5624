"""Token entropy: find random-looking tokens (keys, hashes, encoded blobs) in a text."""

from __future__ import annotations

import math

from textwarden.functions.regex import java_plain
from textwarden.functions.text import has_astral, is_ascii, quote, utf16_length

# --- fixed values -----------------------------------------------------------
ENTROPY_THRESHOLD = 4.2
MIN_TOKEN = 12
MIN_DENSITY = 40
MIN_BASE64 = 32
MIN_HEX = 40
DELIMITERS = r"""\s=:"'`,;\[\]{}()"""
BASE64 = r"^[A-Za-z0-9+/]{20,}={0,2}$"
HEX = r"^[0-9a-fA-F]{24,}$"
# kinds of character and their points: lower, upper, digit, ASCII punctuation, Base64 extras
DENSITY = [("[a-z]", 20), ("[A-Z]", 20), ("[0-9]", 20), (r"""[!@#$%^&*()\-_+=\[\]{}|;:'",.<>?/\\`~]""", 25), ("[+/=]", 15)]


#: a text beyond ASCII of this length may hold many kinds of character
MANY = 2_000


def shannon_entropy(text: str) -> str:
    """Bits per character over the distinct characters; 0 for an empty text.

    With n characters of counts c in a length of L, this is (n log L - sum c log c) / L.
    """
    counts = (f"transform(array_distinct(split({text}, '')), c -> "
              f"(octet_length({text}) - octet_length(replace({text}, c, ''))) / octet_length(c))")
    few = f"aggregate({counts}, 0D, (a, n) -> a + n * log2(n))"
    # with many kinds of character, sort them once and fold the runs instead of one pass per kind
    many = (f"aggregate(array_sort(split({text}, '')), named_struct('c', '', 'n', 0D, 'a', 0D), "
            f"(s, c) -> named_struct('c', c, 'n', if(c = s.c, s.n + 1, 1D), "
            f"'a', if(c = s.c OR s.n = 0, s.a, s.a + s.n * log2(s.n))), s -> s.a + s.n * log2(s.n))")
    weighted = f"if({is_ascii(text)} OR length({text}) < {MANY}, {few}, {many})"
    size = f"({utf16_length(text)})"
    return (f"CASE WHEN {text} = '' THEN 0D ELSE "
            f"greatest(0D, (length({text}) * log2({size}) - {weighted}) / {size}) END")


def char_density(token: str) -> str:
    """How many kinds of character the token mixes, 0 to 100."""
    points = " + ".join(f"CASE WHEN {token} RLIKE {quote(java_plain(p))} THEN {n} ELSE 0 END" for p, n in DENSITY)
    return f"least(100, {points})"


def looks_base64(token: str) -> str:
    return f"{token} RLIKE {quote(java_plain(BASE64))}"


def looks_hex(token: str) -> str:
    return f"{token} RLIKE {quote(java_plain(HEX))}"


def tokens(text: str, min_length: int = MIN_TOKEN) -> str:
    """Tokens of at least ``min_length`` UTF-16 units, in text order."""
    run = java_plain("[^" + DELIMITERS + "]")

    def runs(n: int) -> str:
        return f"regexp_extract_all({text}, {quote(f'{run}{{{n},}}+')}, 0)"

    # characters outside the basic plane count twice, so half the code points may do
    return (f"CASE WHEN {has_astral(text)} "
            f"THEN filter({runs((min_length + 1) // 2)}, t -> ({utf16_length('t')}) >= {min_length}) "
            f"ELSE {runs(min_length)} END")


def shortest_secret(threshold: float) -> int:
    """No shorter token can be a secret: n characters hold at most log2(n) bits each."""
    by_entropy = math.ceil(2 ** threshold - 1e-9)
    return max(MIN_TOKEN, min(by_entropy, MIN_BASE64, MIN_HEX))


def measured(token_array: str) -> str:
    """Each token with its length, entropy and density."""
    return (f"transform({token_array}, t -> named_struct('t', t, 'size', CAST({utf16_length('t')} AS INT), "
            f"'h', {shannon_entropy('t')}, 'd', {char_density('t')}))")


def secret_findings(token_array: str, threshold: float = ENTROPY_THRESHOLD) -> str:
    """The tokens judged secret: masked token, entropy (3 places), density, reason, length.

    ``token_array`` needs no token shorter than ``shortest_secret(threshold)``.
    """
    is_hex = f"(m.size >= {MIN_HEX} AND {looks_hex('m.t')})"
    is_base64 = f"(m.size >= {MIN_BASE64} AND {looks_base64('m.t')})"
    is_high = f"(m.h >= {threshold}D AND m.d >= {MIN_DENSITY})"
    reason = (f"CASE WHEN {is_hex} THEN 'HIGH_ENTROPY_HEX_TOKEN' WHEN {is_base64} THEN 'BASE64_ENCODED_BLOB' "
              f"ELSE concat('HIGH_ENTROPY (H=', format_string('%.2f', m.h), ', Density=', m.d, ')') END")
    secret = f"filter({measured(token_array)}, m -> {is_hex} OR {is_base64} OR {is_high})"
    return (f"transform({secret}, m -> named_struct('token', concat(substring(m.t, 1, 6), '***'), "
            f"'entropy', round(m.h, 3), 'density', m.d, 'reason', {reason}, 'length', m.size))")


def max_entropy(text: str) -> str:
    """Highest token entropy in the text (all tokens of 12 or more), 3 places; 0 if none."""
    each = f"transform(array_distinct({tokens(text)}), t -> round({shannon_entropy('t')}, 3))"
    return f"coalesce(array_max({each}), 0D)"
