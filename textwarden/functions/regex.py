"""Pattern dialects.

The library's patterns are ECMAScript text. Java reads some tokens differently
(word boundaries and ``$``), and neither Java nor RE2 counts Unicode blanks as ``\\s``,
so those few tokens are spelled out; everything else passes through unchanged.
"""

from __future__ import annotations

# code points of ECMAScript white space and line ends
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

_JAVA = {
    "space": r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff",
    "line_end": r"\n\r\u2028\u2029",
    r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))",
    "word_start": r"(?<!\w)",
    "^m": r"(?<![^\n\r\u2028\u2029])",
    "$m": r"(?=[\n\r\u2028\u2029]|\z)",
    "$": r"\z",
}
# For text whose rarer blanks were mapped by ``text.plain_blanks``: all classes listed out.
_WORD = "[" + "".join(map(chr, [*range(48, 58), *range(65, 91), 95, *range(97, 123)])) + "]"
_JAVA_PLAIN = _JAVA | {
    "listed": "yes",
    r"\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    "word_start": f"(?<!{_WORD})",
    "space": r"\s\u00a0",
    "line_end": r"\n\r",
    "^m": r"(?<![^\n\r])",
    "$m": r"(?=[\n\r]|\z)",
}
_RE2 = {
    "space": r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}",
    "line_end": r"\n\r\x{2028}\x{2029}",
    r"\b": r"\b",
    "word_start": r"\b",
    "^m": r"(?:^|[\n\r\x{2028}\x{2029}])",
    "$m": r"(?:$|[\n\r\x{2028}\x{2029}])",
    "$": r"\z",
}


# --- fixed values: shorthand classes, as first and last characters
_SHORTHAND = {"d": ["09"], "w": ["AZ", "az", "09", "__"], "s": ["\t\r", "  ", "\xa0\xa0"]}
_CONTROL = {"n": "\n", "r": "\r", "t": "\t"}


def _members(body: str) -> str:
    """The body of a character class with ranges and shorthands listed out.

    Java tests a class of single Latin-1 characters with one table look-up, but every
    range in it with a chain of calls, which dominates a scan.
    """
    chars: list[str] = []
    i = 0

    def read() -> str:
        nonlocal i
        escaped = body[i] == "\\"
        char = body[i + 1] if escaped else body[i]
        i += 2 if escaped else 1
        return _CONTROL.get(char, char) if escaped else char

    while i < len(body):
        if body[i] == "\\" and body[i + 1] in _SHORTHAND:
            for first, last in _SHORTHAND[body[i + 1]]:
                chars += map(chr, range(ord(first), ord(last) + 1))
            i += 2
            continue
        first = read()
        last = first
        if body[i:i + 1] == "-" and i + 1 < len(body):
            i += 1
            last = read()
        chars += map(chr, range(ord(first), ord(last) + 1))
    return "".join(
        c if c.isalnum() or ord(c) > 255 else f"\\x{ord(c):02x}" for c in dict.fromkeys(chars))


def _class_end(pattern: str, start: int) -> int:
    i = start
    while pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i


def _translate(pattern: str, flags: str, dialect: dict[str, str]) -> str:
    out, i = [], 0
    multi, listed = "m" in flags, "listed" in dialect
    while i < len(pattern):
        char = pattern[i]
        token = pattern[i:i + 2] if char == "\\" else char
        i += len(token)
        if token == "[":
            end = _class_end(pattern, i)
            body, negated = pattern[i:end], pattern[i] == "^"
            i = end + 1
            if listed and r"\S" not in body:
                out.append("[" + "^" * negated + _members(body[negated:]) + "]")
            else:
                out.append("[" + body.replace(r"\s", dialect["space"]) + "]")
        elif token == r"\b":
            # a leading boundary before a word character only has to look back
            leads = not "".join(out) and not pattern.startswith(r"\b[a-zA-Z0-9._%")
            out.append(dialect["word_start"] if leads else dialect[r"\b"])
        elif token in (r"\s", r"\d", r"\w") and listed:
            out.append("[" + _members(token) + "]")
        elif token == r"\s":
            out.append("[" + dialect["space"] + "]")
        elif token == r"\S":
            out.append("[^" + (_members(r"\s") if listed else dialect["space"]) + "]")
        elif token == r"\/":
            out.append("/")
        elif token == ".":
            out.append("[^" + dialect["line_end"] + "]")
        elif token == "^":
            out.append(dialect["^m"] if multi else "^")
        elif token == "$":
            out.append(dialect["$m"] if multi else dialect["$"])
        else:
            out.append(token)
    return ("(?i)" if "i" in flags else "") + "".join(out)


def java(pattern: str, flags: str = "") -> str:
    """The pattern in the dialect of Spark's regular expression functions."""
    return _translate(pattern, flags, _JAVA)


def java_plain(pattern: str, flags: str = "") -> str:
    """Like ``java``, for text that went through ``text.plain_blanks``."""
    return _translate(pattern, flags, _JAVA_PLAIN)


def re2(pattern: str, flags: str = "") -> str:
    """The pattern in RE2 syntax, for the SQL checks (no look-around)."""
    return _translate(pattern, flags, _RE2)
