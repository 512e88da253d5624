import hashlib
import random
import weakref

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textwarden.llm import bpe
from textwarden.sources import workers

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOURCE = open(PATH, encoding="utf-8").read()
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.Coder(SOURCE)


def wanted(texts):
    return [e.ids for e in THEIRS.encode_batch(texts, add_special_tokens=False)]


def test_random_text_equals_the_library():
    rng = random.Random(1)
    pool = "aaab  \t\n\r\x0b\x1c\x85\xa0​　﻿é́ßñ日本語한٣²Ⅷ½'stremdll's't're😀\x00<|endoftext|>ǅ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a" * 5000, " " * 300, "<|endoftext|>  x<|endoftext|>", "aaaa" * 7, "x" * 100_000]
    ids = OURS.encode(texts)
    assert ids == wanted(texts)
    assert [OURS.decode(x) for x in ids] == [THEIRS.decode(x, skip_special_tokens=False) for x in ids] == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    assert OURS.encode(texts) == wanted(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Coder(SOURCE)
    texts = ["one two three four five", "five six seven", "one two"]
    assert [coder.encode([t])[0] for t in texts] == wanted(texts)


def test_tables(spark, docs):
    rows = [(1, "The lines.\n  again"), (2, None), (3, ""), (3, ""), (None, "<|endoftext|>é"), (4, "word " * 30_000)]
    df = docs(rows).withColumn("_row", F.lit(1)).withColumn("n_tokens", F.lit("clash"))
    encoded = bpe.encode(df, SOURCE)
    found = {(r.doc_id, r.text): list(r.ids) for r in encoded.collect()}
    assert found == {r: x for r, x in zip(rows, wanted([t or "" for _, t in rows]))}
    decoded = {(r.doc_id, r.text): r.decoded for r in bpe.decode(encoded, SOURCE).collect()}
    assert decoded == {r: r[1] or "" for r in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, SOURCE).collect())
    assert got == sorted((i or 0, len(x), sha(",".join(map(str, x))), sha(t or ""))
                         for (i, t), x in zip(rows, wanted([t or "" for _, t in rows])))
    assert bpe.digests(docs([]), SOURCE).count() == 0


def test_vocabulary_with_two_ways_to_a_token_is_refused():
    import json

    model = json.loads(SOURCE)
    model["model"]["merges"] = model["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(model))


def test_a_worker_keeps_the_coder_only_between_tasks_that_encode():
    made = weakref.ref(bpe.coder_of(SOURCE))
    workers.give_back()
    assert bpe.coder_of(SOURCE) is made()
    workers.give_back()
    workers.give_back()  # a task of another operator
    assert made() is None
