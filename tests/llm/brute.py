"""Plain versions of two stages."""

import itertools
import re
from fractions import Fraction

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_dedup(rows):
    """(id, kept text, lines dropped)."""
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        yield i, "\n".join(kept), len(lines) - len(kept)


def near_copies(rows, size=3, similarity=Fraction(9, 10)):
    """The smallest id reachable by links of this Jaccard similarity of word shingles, by all pairs."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= similarity * max(len(x), len(y)):
            n = len(x & y)
            if n >= similarity * (len(x) + len(y) - n):
                a, b = root(a), root(b)
                low[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}
