"""Patterns that look for a distant end, in linear time.

A connection string runs from its scheme to the next ``:``, from there to the next ``@``, and
counts only where something usable follows that ``@``. Tried from every scheme, a text without
such an end is read once per scheme. The builders here index the ends first: one pass cuts the
text at them and tests each, and schemes whose end is known to be bad get a mark that keeps the
pattern from trying them. A scheme holds a ``:`` itself, so the way to the next ``:`` is never
read twice; what is left is linear. Marks are noncharacters and touch no other match.
"""

from __future__ import annotations

from textwarden.functions.regex import java_plain
from textwarden.functions.text import quote

#: noncharacters: breaks a start, a bad ``;``, a possible password, an escape in text that is kept
BREAK, BAD, PASSWORD, ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
BLANK_RUN, LINE_ENDS = java_plain(r"\s") + "*+", r"\n\r"


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def broken_schemes(text: str, schemes: str, stops: str, need: int = 1, mark: str = BREAK) -> str:
    """The text with a mark behind each scheme name whose ``scheme://user:secret@`` has no usable end.

    ``stops`` is the body of the class of characters that may not follow the ``@`` within ``need`` places.
    """
    after = f"array_join(transform(slice(_p, _i + 2, {need + 1}), x -> left(x, {need})), '@')"
    usable = java_plain(f"^[^{stops}]{{{need}}}")
    # the colon that the secret follows lies before the bad end
    doomed = f"(?i)({java_plain(schemes)})(?=://[^:]*+:)"
    pieces = (f"transform(_p, (_s, _i) -> if({after} RLIKE {quote(usable)}, _s, "
              f"regexp_replace(_s, {quote(doomed)}, concat('$1', '{mark}'))))")
    return bound(f"split({text}, '@', -1)", "_p", f"array_join({pieces}, '@')")


def broken_servers(text: str) -> str:
    """The text with a mark in each ``Server=`` that no ``Password=`` can follow on the line its ``;`` leads to.

    A ``;`` leads to the rest of its line, or to the next line that is not blank if only blanks follow.
    Runs of blanks that hold a line end are one line end here; the pattern passes them alike.
    """
    clean = f"translate({text}, '{BAD}{PASSWORD}', '\ufffd\ufffd')"
    inner = java_plain("[ \t\x0b\x0c\xa0]")
    lined = f"regexp_replace({clean}, {quote(f'(?<!{inner}){inner}*+[{LINE_ENDS}]{BLANK_RUN}')}, '\\n')"
    named = f"regexp_replace({lined}, {quote(f'(?i)(?=Password{BLANK_RUN}=[^;])')}, '{PASSWORD}')"
    tail = f"substring_index(_l, '{PASSWORD}', -1)"
    marked = (f"if(contains(_l, '{PASSWORD}'), concat(left(_l, length(_l) - length({tail})), replace({tail}, ';', '{BAD};')), "
              f"replace(_l, ';', '{BAD};'))")
    leads_on = f"endswith(_l, ';') AND coalesce(contains(get(_ls, _k + 1), '{PASSWORD}'), false)"
    line = bound(marked, "_m", f"if({leads_on}, concat(left(_m, length(_m) - 2), ';'), _m)")
    lines = bound(f"split({named}, '\\n', -1)", "_ls", f"array_join(transform(_ls, (_l, _k) -> {line}), '\\n')")
    server = quote(f"(?i)(Serv)(?=er{BLANK_RUN}=)")
    pieces = (f"transform(_q, (_x, _i) -> if(_i = size(_q) - 1 OR endswith(_x, '{BAD}'), "
              f"regexp_replace(_x, {server}, concat('$1', '{BREAK}')), _x))")
    broken = bound(f"split({lines}, ';', -1)", "_q", f"array_join({pieces}, ';')")
    return f"translate({broken}, '{BAD}{PASSWORD}', '')"


def escaped(text: str) -> str:
    """Text whose own escape characters are told apart from marks; ``unescaped`` takes both back."""
    return f"replace({text}, '{ESCAPE}', '{ESCAPE}0')"


def unescaped(text: str) -> str:
    return f"replace(replace({text}, '{ESCAPE}1', ''), '{ESCAPE}0', '{ESCAPE}')"


def possessive(pattern: str) -> str:
    """The same matches without second tries of runs that nothing else could end."""
    for old, new in (
            ("[^:]+:[^@]+@", "[^:]++:[^@]++@"),
            (r"\s*[:=]?\s*[\$£€₹]?\s*\d", r"\s*+(?:[:=]\s*+)?(?:[\$£€₹]\s*+)?\d"),
            (r"\s*[:=]?\s*", r"\s*+(?:[:=]\s*+)?")):
        pattern = pattern.replace(old, new)
    return pattern
