"""Ranked search against a plain scan of all documents."""

import math
import random
import re

import pytest

from textwarden.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=20):
    """(item_id, rank, doc_id, score) by scoring every document."""
    words = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            m = 75 + (25 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * w.count(t)) // (1000 * w.count(t) + 12 * m))
                        for t in words(text) if t in df and t in w)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, parts=3, **options):
    documents = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, term string")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    rows = lexical.search(asked.repartition(2), lexical.index(documents.repartition(parts)), **options).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.fixture
def small(monkeypatch):
    """Shards, windows and blocks so small that all of them occur many times."""
    for name, value in {"HELD": 400, "WINDOW": 4, "BLOCK": 3, "TOGETHER": 2, "SHARDS": 2}.items():
        monkeypatch.setattr(lexical, name, value)


def zipf_rows(seed, n, long=60):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    return [(i, " ".join(rng.choices(pool, weights, k=rng.randint(0, long)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_scan(spark, small, seed):
    docs = zipf_rows(seed, 300)
    items = [(i, t) for i, t in zipf_rows(seed + 10, 12, 25)]
    assert found(spark, docs, items, top=5) == plain(docs, items, top=5)


def test_odd_rows(spark, small):
    docs = zipf_rows(5, 80) + [(3, "w1 w2 repeated"), (None, "w1 w1 lost"), (90, None), (91, " \t.;"), (92, "WÖRT wört 日本語 a1_b2"),
                               (93, "w1 " * 3000)] + [(100 + k, "same text of many w7") for k in range(40)]
    items = [(1, "w1 w2 w2 W1"), (1, "same text"), (2, None), (3, "..."), (None, "w3 WÖRT b2"), (4, "unknown"), (5, "日本語")]
    assert found(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert found(spark, docs, items) == []


def test_terms_beyond_the_broadcast_are_joined(spark, small, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 0)
    docs, items = zipf_rows(6, 120), zipf_rows(7, 8, 20)
    assert found(spark, docs, items) == plain(docs, items)


def test_windows_are_skipped(monkeypatch):
    """A shard whose best documents are known does not score the others."""
    import numpy as np

    rng = np.random.default_rng(0)
    n = 20_000
    spread = np.full(n, 100)
    common = np.flatnonzero(rng.random(n) < 0.5)
    rare = np.sort(rng.choice(n, 40, replace=False))

    def postings(docs):
        return lexical._List(np.diff(docs, prepend=0).astype(np.uint32).tobytes(), np.ones(len(docs), np.uint32).tobytes(), spread)

    lists = {b"common": postings(common), b"rare": postings(rare)}
    scored = []
    take = lexical._Best.take
    monkeypatch.setattr(lexical._Best, "take", lambda self, ids, scores: (scored.append(len(ids)), take(self, ids, scores)))
    best = lexical._Best([(b"common", 700), (b"rare", 6000)], 20)
    lexical.search_shard(best, np.arange(n), np.ones(n, bool), lists)
    both = np.intersect1d(common, rare)[:20]
    assert best.ids[:len(both)].tolist() == both.tolist() and sum(scored) < 200
