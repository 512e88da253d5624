"""License scans by MinHash bands over overlapping windows, with exact verification.

Templates and texts are sets of five-word shingles. Templates fall into size classes by powers
of two; a class of up to ``s`` shingles looks at windows of ``2 * s`` shingles, ``s`` apart, so
every passage of a template's length lies whole in a window. A window meets a template if they
share a MinHash band of two rows. A class is less than twice a template, so a window has less than
four template lengths; even one that is full of other templates' shingles beside four fifths of a
template has a similarity of 0.8 / 4.2, which 160 bands find with a probability of 0.997. Every meeting is then verified: the share of the template's shingles that the window
holds must reach ``LEAST``. Shingles that no template has cannot make a band meet and are left
out of the windows first, which changes no match and only raises the similarity.

Everything is column expressions. Templates are a small table that the caller gives; their size
is checked. Defined results: words are runs of letters and digits in lower case; texts with
fewer than five words, null and empty ones hold nothing; null and repeated ids are scanned row
by row, each with results of its own under its id. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 160, 2
#: templates may hold this many shingles together; they travel with the plan
MOST_SHINGLES = 20_000

# Short notices and the notice paragraphs of common licences.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                 "and/or sell copies of the Software"),
    ("Apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                          "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                   "or (at your option) any later version."),
    ("BSD-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                   "provided that the following conditions are met"),
]


def _shingles(text: str) -> str:
    """The hashes of all runs of five words, in order; a one-element array binds the words' hashes once."""
    words = f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"
    step = ", ".join(f"codes[i + {k}]" for k in range(WORDS))
    return (f"transform(array(transform({words}, w -> xxhash64(w))), codes -> if(size(codes) < {WORDS}, "
            f"cast(array() AS array<bigint>), transform(sequence(0, size(codes) - {WORDS}), i -> xxhash64({step}))))[0]")


def _bands(shingles: str) -> str:
    """The band keys of a set of hashes."""
    least = f"transform(sequence(0, {BANDS * ROWS - 1}), i -> array_min(transform({shingles}, h -> xxhash64(h, i))))"
    keys = ", ".join(f"m[{ROWS} * b + {k}]" for k in range(ROWS))
    return f"transform(array({least}), m -> transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, {keys})))[0]"


def templates(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """(license, template, class) of each notice: its shingle set, its size class."""
    literals = F.array(*(F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in notices))
    return (spark.range(1).select(F.inline(literals))
            .select("license", F.expr(f"array_distinct({_shingles('text')})").alias("template"))
            .withColumn("class", F.expr("cast(pow(2, ceil(log2(size(template)))) AS int)")))


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         notices: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """(id, license, n_shared, n_shingles, first_word): the best window of every license found in a text.

    Shingles meet by document and window, so a common license spreads over as many tasks as
    documents hold it, and no group exceeds a window.
    """
    spark = documents.sparkSession
    known = templates(spark, NOTICES if notices is None else notices)
    rows = known.select("class", F.explode("template").alias("h")).distinct().limit(MOST_SHINGLES + 1).collect()
    if not rows or len(rows) > MOST_SHINGLES:
        raise ValueError(f"templates must hold 1 to {MOST_SHINGLES} shingles of {WORDS} words, found {len(rows)}")
    vocabulary = ", ".join(f"{h}L" if h > -(1 << 63) else "(-9223372036854775807L - 1L)" for h in {r.h for r in rows})
    classes = ", ".join(map(str, sorted({r["class"] for r in rows})))

    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = (f"filter(transform({_shingles('text')}, (h, i) -> named_struct('at', i, 'h', h)), "
             f"x -> x.h IN ({vocabulary}))")
    # an outer generator keeps the optimizer from repeating the scan in a filter below it
    held = texts.select("row", "id", F.expr(f"inline_outer({found})")).filter("h IS NOT NULL")
    # each shingle lies in the window that begins at the class step before it and in the one before that
    places = f"""inline(flatten(transform(array({classes}), c -> array(
        named_struct('class', c, 'window', at div c), named_struct('class', c, 'window', at div c - 1)))))"""
    windows = (held.select("row", "id", "at", "h", F.expr(places)).groupBy("row", "id", "class", "window")
               .agg(F.collect_set("h").alias("shingles"), F.min("at").alias("first_word")))
    met = (windows.select("row", "id", "class", "shingles", "first_word", F.explode(F.expr(_bands("shingles"))).alias("band"))
           .join(F.broadcast(known.select("class", "license", "template", F.explode(F.expr(_bands("template"))).alias("band"))),
                 ["class", "band"]))
    shared = F.size(F.array_intersect("shingles", "template"))
    verified = met.select("row", "id", "license", shared.cast("long").alias("n_shared"),
                          F.size("template").cast("long").alias("n_shingles"), F.col("first_word").cast("long").alias("at"))
    return (verified.filter(F.col("n_shared") >= F.col("n_shingles") * F.lit(least)).groupBy("row", "id", "license")
            .agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"),
                 F.min("at").alias("first_word")).drop("row").withColumnRenamed("id", id_col))
