"""Every corpus query over the whole small tables: against its SQL, or against brute force."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textwarden.llm import queries
from textwarden.llm.common import stored


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, data, name):
    result = queries.REGISTRY[name](spark, data)
    cursor = duck.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, result.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_numbered_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in queries.REGISTRY) == list(range(1, 14))


def test_neighbours_recall(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    found = {}
    for r in queries.op4_nearest_neighbours(spark, data).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert set(found) == {int(ids[k]) for k in asked}
    hits = 0
    for k in asked:
        s = x @ x[k]
        s[k] = -np.inf
        hits += len(found[int(ids[k])] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(asked)


def test_stages_against_brute_force(spark, data):
    """Each stage on the rows of the one before it, up to the last."""
    from brute import line_dedup, near_copies

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in ("toxicity", "line_dedup", "jaccard_join", "source_mix"):
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stages[name](spark, docs, data), f"test-{name}")
        assert docs.columns == columns
        after = docs.collect()
        kept = {r.doc_id: r for r in after}
        if name == "toxicity":
            assert all(kept[i] == before[i] for i in kept) and 0.8 * len(before) < len(kept) <= len(before)
        elif name == "line_dedup":
            want = {i: t for i, t, dropped in line_dedup([(i, r.text) for i, r in before.items()])
                    if not dropped or t.strip(" \t\n\x0b\x0c\r")}
            assert {i: r.text for i, r in kept.items()} == want
        elif name == "jaccard_join":
            low = near_copies([(i, r.text) for i, r in before.items()], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_SIMILARITY)
            assert set(kept) == {i for i in before if low[i] == i}
        else:
            counts = {}
            for r in after:
                counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
            assert max(counts.values()) <= 2 and set(kept) <= set(before)
    assert stages["bpe"](spark, docs, data).filter(F.col("n_tokens") > 0).count() == docs.filter("text <> ''").count()
