"""Stored rules compiled to a decision table, so that judging a payload does not depend on their number.

Conditions are lists of names from a fixed vocabulary (the categories, tags and tiers a scan can
report) and a highest risk score. A rule is inverted to cells, one per combination of a category,
a tag and a tier it names, with a place for lists it does not state. Of all rules of a cell only
those can win that no earlier rule with an equal or higher limit precedes, so a cell keeps for each
score from 0 to 100 its first rule. The table has at most (categories + 1) * (tags + 1) * (tiers + 1)
cells, however many rules are stored: a few megabytes, which every task reads as a constant. A
payload looks up the cells of its own few names; the least place in the order of evaluation wins.

Names outside the vocabulary never occur in a payload; a list of only such names never holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textwarden.fixed_values import DETECTORS, INDICATORS, TIERS
from textwarden.functions.policy import RULE_SCHEMA, rules_literal
from textwarden.functions.text import quote
from textwarden.operators.policies import stored_rules
from textwarden.options import DEFAULTS, ScanOptions

CATEGORIES = sorted({d[2] for d in DETECTORS} | {i[2] for i in INDICATORS} | {"CONFIDENTIAL_PROJECT"})
TAGS = sorted({t for d in DETECTORS for t in d[4]} | {t for i in INDICATORS for t in i[4]} | {"ML_SENSITIVE"})
#: names of each kind of condition; place 0 of a kind stands for rules that do not state it
VOCABULARY = {"categories": CATEGORIES, "tags": TAGS, "tiers": sorted(TIERS)}
CELLS = (len(CATEGORIES) + 1) * (len(TAGS) + 1) * (len(TIERS) + 1)
TOP_SCORE = 100
RULE = ["rank", "source", "ord", "id", "name", "action", "reason"]


def _places(names: str, kind: str) -> str:
    """The places of those names that belong to the vocabulary."""
    known = "array(" + ", ".join(quote(n) for n in VOCABULARY[kind]) + ")"
    return f"filter(transform({names}, n -> cast(array_position({known}, n) AS int)), p -> p > 0)"


def _combined(categories: str, tags: str, tiers: str, value: str) -> str:
    """``value`` for the cell ``c`` of each combination of places."""
    n_tags, n_tiers = len(TAGS) + 1, len(TIERS) + 1
    cell = f"(x * {n_tags} + y) * {n_tiers} + z"
    return (f"flatten(transform({categories}, x -> flatten(transform({tags}, y -> "
            f"transform({tiers}, z -> {value.replace('{cell}', cell)})))))")


class RuleTable:
    """A compiled table below a folder, as two constants: cells by score, and the rules that can win."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def columns(self) -> list[Column]:
        """The columns that ``first_match`` reads."""
        def constant(name: str, kind: str) -> Column:
            return self.spark.read.schema(f"{name} {kind}").parquet(f"{self.folder}/{name}").scalar().alias(f"_{name}")

        return [constant("cells", "array<array<int>>"), constant("winners", f"array<struct<{RULE_SCHEMA}>>")]

    @staticmethod
    def first_match(categories: str, tags: str, tier: str, score: str) -> str:
        """First rule all of whose stated conditions hold, or null."""
        def places(names: str, kind: str) -> str:
            return f"concat(array(0), {_places(names, kind)})"

        found = _combined(places(categories, "categories"), places(tags, "tags"), places(f"array({tier})", "tiers"),
                          f"get(get(_cells, {{cell}}), {score})")
        return f"get(_winners, array_min({found}))"


def compile_rules(store: DataFrame, folder: str, options: ScanOptions = DEFAULTS) -> RuleTable:
    """Write the table of the stored rules followed by the built-in ones to a folder."""
    spark = store.sparkSession
    built_in = spark.range(1).selectExpr(f"inline({rules_literal(options.extra_rules)})")
    rules = stored_rules(store, options).unionByName(built_in)

    def slots(kind: str) -> str:
        return f"if(coalesce(size({kind}), 0) <= 0, array(0), array_distinct({_places(kind, kind)}))"

    cells = _combined(slots("categories"), slots("tags"), slots("tiers"), "{cell}")
    placed = rules.selectExpr(
        f"named_struct({', '.join(f'{quote(c)}, {c}' for c in RULE)}) AS rule",
        f"cast(least({TOP_SCORE}, floor(coalesce(max_risk, {TOP_SCORE}))) AS int) AS top",
        f"explode({cells}) AS cell").filter("top >= 0")
    # at most one row per cell and score from here on
    first = placed.groupBy("cell", "top").agg(F.min("rule").alias("rule"))
    falling = Window.partitionBy("cell").orderBy(F.desc("top"))
    first = first.withColumn("rule", F.min("rule").over(falling)).withColumn("key", F.to_json("rule"))
    first.write.mode("overwrite").parquet(f"{folder}/steps")
    first = spark.read.schema(first.schema).parquet(f"{folder}/steps")
    whole = ", ".join(
        f"'{n}', {'r.' + n if n in RULE else 'null'}" for n in (f.split(":")[0] for f in RULE_SCHEMA.split(",") if ":" in f))
    winners = first.agg(F.sort_array(F.collect_set("rule")).alias("w"))
    (winners.selectExpr(f"cast(transform(w, r -> named_struct({whole})) AS array<struct<{RULE_SCHEMA}>>) AS winners")
     .coalesce(1).write.mode("overwrite").parquet(f"{folder}/winners"))
    numbered = winners.select(F.posexplode("w").alias("place", "rule")).select("place", F.to_json("rule").alias("key"))
    steps = (first.join(numbered, "key").groupBy("cell")
             .agg(F.array_sort(F.collect_list(F.struct("top", "place"))).alias("s")).selectExpr(
                 "cell", "flatten(transform(s, (x, i) -> array_repeat(x.place, x.top - if(i = 0, -1, s[i - 1].top)))) AS by_score"))
    (spark.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(steps, "cell", "left")
     .agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "by_score"))), lambda c: c["by_score"]).alias("cells"))
     .coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells"))
    return RuleTable(spark, folder)
