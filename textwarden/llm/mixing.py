"""Mixing sources to target weights by the cube method.

A document's size is its number of words. Sources share ``share`` times all words by their
weights; a target stops at ``ceiling`` times its source's size and the excess is reshared among
the others by weight. The ratio of target to source size gives each document whole copies and a
fractional inclusion probability. The cube method settles the probabilities: in blocks of about
``BLOCK`` documents of one source the flight phase moves them through the null space of two
constraints, the token and the document totals, until at most two are left undecided; the rest
of many blocks meets in a block of the next level, and the last two of a source land on the
choice nearest to its token total, with single units of the last block flipped where that comes
nearer. Totals are kept exactly before that landing.

Defined results: sources count in code point order, a null source last and apart from an empty
one; a null or empty text has size 0. Rows that repeat id, source and text form one unit and
are taken alike; null ids are allowed. A source without words has target 0. Randomness comes
from the data alone, so reruns agree. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import itertools
import random
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from textwarden.llm.common import WORD, salted_join, ship, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
#: units of a flight block, and blocks whose rest meets in one block of the next level
BLOCK, FAN_IN = 4096, 512
ADDED = ["size", "source_size", "target", "copies"]
_SOURCE = ["no_source", "source"]
_UNIT = ["id", *_SOURCE, "key"]


def _near(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _direction(n: list[float], s: list[float]) -> list[float] | None:
    """A vector that both constraint rows (documents n, tokens s) map to zero; None if there is none."""
    if len(n) == 3:
        u = [n[1] * s[2] - n[2] * s[1], n[2] * s[0] - n[0] * s[2], n[0] * s[1] - n[1] * s[0]]
        if any(u):
            top = max(map(abs, u))
            return [x / top for x in u]
        return [n[1], -n[0], 0.0]
    if len(n) == 2 and n[0] * s[1] == n[1] * s[0]:
        return [n[1], -n[0]]
    return None


def flight(p: list[float], n: list[float], s: list[float], rng: random.Random) -> None:
    """Move the probabilities in place until at most two are neither 0 nor 1."""
    active: list[int] = []
    waiting = iter([i for i, x in enumerate(p) if 0 < x < 1])
    while True:
        active += itertools.islice(waiting, 3 - len(active))
        u = _direction([n[i] for i in active], [s[i] for i in active])
        if u is None:
            return
        up = min(((1 - p[i]) if x > 0 else p[i]) / abs(x) for i, x in zip(active, u) if x)
        down = min((p[i] if x > 0 else (1 - p[i])) / abs(x) for i, x in zip(active, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, u):
            p[i] = _near(p[i] + step * x)
        left = [i for i in active if 0 < p[i] < 1]
        if len(left) == len(active):  # rounding kept all inside: settle the one nearest to its end
            i = min(active, key=lambda i: min(p[i], 1 - p[i]))
            p[i] = float(round(p[i]))
            left.remove(i)
        active = left


def land(p: list[float], n: list[float], s: list[float], tokens: float) -> None:
    """Settle the last undecided units, then flip single units while that brings the sum nearer to ``tokens``."""
    rest = [i for i, x in enumerate(p) if 0 < x < 1]
    best = min(itertools.product((0.0, 1.0), repeat=len(rest)), key=lambda x: (
        abs(sum(s[i] * (v - p[i]) for i, v in zip(rest, x))), abs(sum(n[i] * (v - p[i]) for i, v in zip(rest, x))), x))
    for i, v in zip(rest, best):
        p[i] = v
    excess = sum(a * b for a, b in zip(p, s)) - tokens
    while p:
        i = min(range(len(p)), key=lambda i: abs(excess + s[i] * (1 - 2 * p[i])))
        after = excess + s[i] * (1 - 2 * p[i])
        if abs(after) >= abs(excess) - 1e-6:
            return
        excess, p[i] = after, 1 - p[i]


def _block(last: bool):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "key", "hash"], ascending=[False, True, True], kind="stable")
        p, n, s = rows["p"].tolist(), rows["rows"].astype(float).tolist(), (rows["size"] * rows["rows"]).astype(
            float).tolist()
        seed = f"{rows['source'].iloc[0]}|{rows['no_source'].iloc[0]}|{rows['block'].iloc[0]}|{len(rows)}"
        tokens = sum(a * b for a, b in zip(p, s))
        flight(p, n, s, random.Random(zlib.crc32(seed.encode("utf-8", "replace"))))
        if last:
            land(p, n, s, tokens)
        return rows.assign(p=p)

    return settle


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(no_source, source, source_size) plus target: the filling level is found by one scalar per step."""
    place = F.row_number().over(Window.orderBy(*_SOURCE)) - 1  # one row per source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    ranked = stored(sources.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(float(ceiling))}),
                    "source-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, closed = 0.0, -1
    while True:
        full = F.col("limit") < F.col("weight") * F.lit(level)
        row = ranked.agg(F.sum(F.when(full, F.col("limit"))).alias("limit"), F.count_if(full).alias("closed"),
                         F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if row.closed == closed or not row.weight:
            break
        level, closed = (share * total - (row.limit or 0.0)) / row.weight, row.closed
    return ranked.select(*_SOURCE, "source_size", F.least("limit", F.col("weight") * F.lit(level)).alias("target"))


def plan_mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, block: int = BLOCK) -> DataFrame:
    """One narrow row per unit: id, source, key, rows, size, source_size, target, copies."""
    spark = documents.sparkSession
    ship(spark)
    units = stored(_keyed(documents, id_col, source_col, text_col)
                   .groupBy(*_UNIT).agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("rows")), "mix-units")
    sources = units.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("ratio") + 1e-9)
    n_units = units.count()
    blocks = max(1, -(-n_units // block))
    shape = (salted_join(units, targets(sources, weights, share, ceiling), _SOURCE, F.col("key"))
             .withColumn("ratio", ratio)
             .withColumns({"base": whole, "hash": F.xxhash64("id", "key")})
             .withColumn("p", F.greatest(F.col("ratio") - whole, F.lit(0.0)))
             .withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks))))
    open_ = stored(shape, "mix-shape")
    settled = open_.filter("p = 0")
    open_ = open_.filter("p > 0")
    while True:
        done = stored(open_.groupBy(*_SOURCE, "block").applyInPandas(_block(blocks == 1), open_.schema), "mix-flight")
        settled = settled.unionByName(done.filter("p = 0 OR p = 1"))
        if blocks == 1:
            break
        blocks = -(-blocks // FAN_IN)
        open_ = done.filter("p > 0 AND p < 1").withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)))
    return settled.select(*_UNIT, "rows", "size", "source_size", "target", (F.col("base") + F.col("p")).cast("long")
                          .alias("copies"))


def _keyed(documents: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    return documents.select(
        F.col(id_col).alias("id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"),
        F.xxhash64(text).alias("key"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        **options) -> DataFrame:
    """Every document with size, source_size, target and its number of copies in the mix."""
    plan = plan_mix(documents, id_col, source_col, text_col, **options).select(*_UNIT, F.struct(*ADDED).alias("_plan"))
    keep = [c for c in documents.columns if c not in ADDED]
    source = F.col(source_col).cast("string")
    packed = documents.select(
        F.col(id_col).alias("id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"),
        F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.struct(*keep).alias("_row"))
    # null ids meet by a struct, which compares nulls as equal
    packed, plan = (x.withColumn("_unit", F.struct(*_UNIT)).drop(*_UNIT) for x in (packed, plan))
    return packed.join(plan, "_unit").select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), "_plan.*")


def drawn(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is taken, without the added columns."""
    return (mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .drop("_copy", *ADDED))
