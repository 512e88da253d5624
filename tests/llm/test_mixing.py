import random

from pyspark.sql import functions as F

from textwarden.llm import mixing


def brute_targets(sizes):
    """The rule as it reads: reshare the excess until no target is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_} if total else {}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 2 * sizes[s]
            left -= fixed[s]


def test_targets_totals_and_limits(spark, docs):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["b", "a", "", "é", None, "z"] + ["hot"] * 6))
            for i in range(900)]
    rows += [(None, "one two", "a"), (3, "again same", "a"), (3, "again same", "a"), (4, None, "none")]
    df = docs(rows).withColumn("id", F.lit(0)).withColumn("target", F.lit("clash"))
    out = mixing.mix(df, block=64)
    got = out.collect()
    assert len(got) == len(rows) and "lang" in out.columns
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2 and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.copies * r.size
    for source in sizes:
        assert abs(taken[source] - want[source]) <= max(2, 0.02 * want[source]), source
    again = {(r.doc_id, r.text, r.copies) for r in mixing.mix(df, block=64).collect()}
    assert again == {(r.doc_id, r.text, r.copies) for r in got}
    drawn = mixing.drawn(out)
    assert drawn.count() == sum(r.copies for r in got)


def test_flight_keeps_both_totals():
    rng = random.Random(2)
    n, s = [1.0] * 400, [float(rng.randint(1, 900)) for _ in range(400)]
    p0 = [rng.random() for _ in n]
    p = list(p0)
    mixing.flight(p, n, s, rng)
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - sum(p0)) < 1e-6
    assert abs(sum(a * b for a, b in zip(p, s)) - sum(a * b for a, b in zip(p0, s))) < 1e-3
    # probabilities are kept on average
    first = [0.0] * 6
    for k in range(3000):
        q = [0.2, 0.4, 0.6, 0.8, 0.5, 0.5]
        mixing.flight(q, [1.0] * 6, [3.0, 1.0, 4.0, 1.0, 5.0, 9.0], random.Random(k))
        first = [a + b for a, b in zip(first, q)]
    assert all(abs(a / 3000 - b) < 0.04 for a, b in zip(first, [0.2, 0.4, 0.6, 0.8, 0.5, 0.5]))


def test_empty_tables(spark, docs):
    assert mixing.mix(docs([])).count() == 0
    assert [(r.copies, r.target) for r in mixing.mix(docs([(1, ""), (2, None)])).collect()] == [(0, 0.0)] * 2
