import random

import numpy as np
from pyspark.sql import functions as F

from textwarden.llm import bloom, line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    order = lambda i: (i is None, i or 0)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)], key=order) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()), key=str)


def test_against_brute_force(spark, docs):
    rng = random.Random(3)
    lines = ["Same LINE here", " same line here\t", "\x0bsame line here", "short", "", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "only  once %d"]
    rows = [(i, "\n".join(rng.choice(lines).replace("%d", str(i)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (5, "same line here\nagain and again"), (None, "again and again"), (62, "z" * 200_000),
             (63, "z" * 200_000 + "\nshort"), (None, "nobody else has this")]
    assert run(docs(rows)) == brute(rows)


def test_columns_pass_and_clash(spark, docs):
    df = docs([(1, "a line of text"), (2, "A line of text ")]).withColumn("_row", F.lit(7)).withColumn("n_lines", F.lit("x"))
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "n_lines", "n_dropped"]
    assert [(r.doc_id, r.text, r._row, r.n_lines) for r in out.orderBy("doc_id").collect()] == [
        (1, "a line of text", 7, 1), (2, "", 7, 1)]
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_filter_misses_no_repeat(spark):
    df = spark.range(3000).select((F.col("id") % 2000).alias("id"))
    hashes = lambda b: np.asarray(b.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seen = bloom.twice_seen(df, hashes)
    code = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert bloom.holds(seen, code(range(1000))).all()
    assert bloom.holds(seen, code(range(1000, 2000))).mean() < 0.05
