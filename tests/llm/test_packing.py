"""Packing: ids against the tokenizers library, plans against best fit over single pieces."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textwarden.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def source():
    return open(PATH, encoding="utf-8").read()


def best_fit(lengths, capacity):
    """The number of sequences of best fit by falling length, piece by piece."""
    spaces = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in spaces if s >= n]
        if fits:
            s = min(fits)
            spaces.remove(s)
        else:
            s = capacity
        spaces.append(s - n)
    return len(spaces)


def filled(slots, counts, capacity):
    """The pieces (offset, length) of every sequence of a plan."""
    out = {}
    for n, steps in slots.items():
        starts = [s[0] for s in steps]
        for rank in range(counts[n]):
            first, sequence, each, offset = steps[np.searchsorted(starts, rank, side="right") - 1]
            out.setdefault(sequence + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
    return out


def check_gapless(pieces, capacity):
    at = 0
    for offset, n in sorted(pieces):
        assert offset == at
        at += n
    assert at <= capacity


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 7, 20, 64])
    counts = {n: rng.choice([1, 2, 3, 17, 50]) for n in range(1, capacity + 1) if rng.random() < 0.6}
    placed = filled(packing.plan(counts, capacity), counts, capacity)
    for pieces in placed.values():
        check_gapless(pieces, capacity)
    assert len(placed) == best_fit([n for n, c in counts.items() for _ in range(c)], capacity)
    assert sorted(placed) == list(range(len(placed)))


def test_plan_size_does_not_follow_counts():
    rng = random.Random(1)
    shape = {n: rng.randint(1, 1000) for n in range(1, 4097)}
    few = sum(map(len, packing.plan(shape).values()))
    many = sum(map(len, packing.plan({n: c * 1_000_003 for n, c in shape.items()}).values()))
    assert many < 200_000 and many < 3 * few


@pytest.mark.parametrize("bad", [0, 5])
def test_lengths_beyond_the_capacity_are_refused(bad):
    with pytest.raises(ValueError):
        packing.plan({bad: 1}, 4)


TEXTS = ["", "Hello, world!", "it's we'll THEY'D 'tis", "a\x1cb \x1f!? c", "x y　z w\x85v", "é École Å",
         "<|endoftext|> a<|startoftext|>b <|end", "ΟΔΟΣ İstanbul STRASSEẞ", "\U0001f600\U0001f600 12345 กิน", "ño  \n\t",
         "᠎a​b ﻿c", "x" * 5000, "ab " * 9000, "\x00\x01 !!!", "각 Ω"]


def test_ids_equal_the_library(source):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(TEXTS, add_special_tokens=False)]
    encoder = packing.Encoder(source)
    assert encoder.encode(TEXTS) == want
    assert encoder.encode(TEXTS[::-1]) == want[::-1]  # from memory


def test_pieces_sequences_and_odd_rows(spark, source):
    rows = [(1, "b " * 9000, "x"), (2, None, "y"), (2, None, "y"), (None, "some words", None), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    packed = packing.pack(docs, source).cache()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    found = packed.collect()
    long = sorted((r.piece, r.start, r.length) for r in found if r.doc_id == 1)
    assert long == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    assert sum(r.doc_id == 2 and r.length == 1 for r in found) == 2
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        check_gapless(pieces, 4096)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in found:
        assert whole[r.sequence_id].ids[4 * r.offset:4 * (r.offset + r.length)] == r.ids
    packed.unpersist()


def test_empty_table(spark, source):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), source).collect() == []


def test_hot_length_is_ranked_in_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 10)
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20 + 1).alias("length"))
    found = packing.place(rows, 30).collect()
    assert sorted(r.doc_id for r in found) == list(range(500))
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        check_gapless(pieces, 30)
    assert len(by_sequence) == best_fit([r.length for r in found], 30)


def test_query_against_brute_force(spark, data):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k:k + 4096], "<u4")
            want[r.doc_id, k // 4096] = (k, len(part), zlib.crc32(part.tobytes()))
    found = queries.op13_best_fit_packing(spark, data).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        check_gapless(pieces, 4096)
    assert len(by_sequence) == best_fit([r.length for r in found], 4096)


def test_ids_of_random_texts_equal_the_library(source):
    """All characters that the split into words or the case could touch, next to each other."""
    rng = random.Random(7)
    pool = ("aZ'sT9 \t\n.,-_!\x00\x1c\x85\xa0ñÑéßÅ×÷ªİıǅȺɏɐΣςσǰ̱̀̇̌́JHTWYİ2½²Ⅳ〇文😀​‍ 　ﬁKÅ"
            "ͅΆЙй́가각ᄀ᠎").replace("İ", "İ", 1)
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += [t.replace("9", "<|endoftext|>") for t in texts[:300]] + ["we'll we'LL it'S don't'd ''s 's's"] * 2
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    encoder = packing.Encoder(source)
    got = encoder.encode(texts[:2000]) + encoder.encode(texts[2000:])
    assert [i for i, (a, b) in enumerate(zip(got, want)) if a != b] == []
