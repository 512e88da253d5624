"""Connected components of links between integer ids, by contraction on Spark.

Each round hooks every root to its smallest neighbour, shortens the paths by pointer jumping and
replaces the links by links between roots. A component's label is its smallest id. Rows are
pairs of ids; a hot root's rows are split by adaptive execution, as no step needs them together,
and combine before each aggregation. Each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textwarden.llm.common import stored


def _follow(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``column`` replaced by its parent, where it has one."""
    step = parents.select(F.col("node").alias(column), F.col("parent").alias("_up"))
    return rows.join(step, column, "left").withColumn(column, F.coalesce("_up", column)).drop("_up")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b) that is not the smallest of its component."""
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, labels = stored(links, "links"), None
    while True:
        parents = stored(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "parents")
        if parents.isEmpty():
            return parents.select("node", F.col("parent").alias("component")) if labels is None else labels
        while True:
            # a parent that has no parent itself is a root; paths shorten fourfold until all point at roots
            twice = _follow(_follow(parents.withColumn("old", F.col("parent")), "parent", parents), "parent", parents)
            jumped = stored(twice, "parents")
            changed = not jumped.filter("parent <> old").isEmpty()
            parents = jumped.drop("old")
            if not changed:
                break
        now = parents.select("node", F.col("parent").alias("component"))
        labels = now if labels is None else stored(_follow(labels, "component", parents).unionByName(now), "labels")
        links = stored(_follow(_follow(links, "a", parents), "b", parents)
                       .filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "links")
