"""Watched names in bulk against one pattern per name."""

import random
import re
import time

from pyspark.sql import functions as F

from textwarden.operators import watchlist
from textwarden.operators.scan import detect
from textwarden.operators.watchlist import find_names, with_watched
from textwarden.options import ScanOptions


def plain(name, text):
    return re.search(rf"(?<![\w-]){re.escape(name)}(?![\w-])", watchlist.plain_lower(text), re.ASCII) is not None


def test_names_equal_a_plain_search(spark):
    rng = random.Random(4)
    pieces = ["alpha", "Beta", "beta", "-", "_", " ", " ", "9", ".", "é", "É", "\n", "(x)", "ga", "gamma", "İ", "K"]
    names = list({"".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(250)})
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "id int, text string").repartition(4)
    listed = spark.createDataFrame([(n,) for n in names] + [(None,), (" ",), (names[0],)], "name string")
    got = {(r.id, r.name) for r in find_names(df, listed, "id").collect()}
    low = {watchlist.plain_lower(n) for n in names if n.strip()}
    want = {(i, n) for i, t in enumerate(texts) for n in low if plain(n, t)}
    assert got == want and len(want) > 1000


def test_names_in_blocks(spark, monkeypatch):
    names = spark.range(300).select(F.concat(F.lit("name "), "id").alias("name"))
    df = spark.range(400).select("id", F.concat(F.lit("a Name "), F.col("id"), F.lit(", b")).alias("text"))
    whole = sorted(map(tuple, find_names(df, names, "id").collect()))
    monkeypatch.setattr(watchlist, "BLOCK_CHARS", 500)
    assert sorted(map(tuple, find_names(df, names, "id").collect())) == whole and len(whole) == 300


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("Project "), F.md5(F.col("id").cast("string"))).alias("name"))
    texts = spark.range(2000).select("id", F.concat(F.repeat(F.lit("plain words and projects "), 100), F.lit("project "),
                                                    F.md5((F.col("id") * 100).cast("string")), F.lit(".")).alias("text"))
    start = time.monotonic()
    found = find_names(texts, names, "id").collect()
    assert len(found) == 1000 and time.monotonic() - start < 60


def test_category_equals_the_option(spark, texts):
    df = texts(["the Apache License", "apache-license", "the ERLYTION plan", "nothing here to see", "x erlytion-2"])
    names = spark.createDataFrame([("erlytion",), ("Apache License",)], "name string")
    joined = with_watched(detect(df), find_names(df, names, "id"), "id")
    option = detect(df, options=ScanOptions(codenames=("erlytion", "Apache License")))
    assert sorted((r.id, r.narrative.categories) for r in joined.collect()) == sorted((r.id, r.narrative.categories) for r in option.collect())


def test_empty_list(spark, texts):
    df = texts(["a", "b"])
    none = spark.createDataFrame([], "name string")
    assert find_names(df, none, "id").collect() == []
    assert with_watched(detect(df), find_names(df, none, "id"), "id").count() == 2
