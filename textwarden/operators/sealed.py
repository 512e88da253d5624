"""Keep filters from repeating expensive columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sealed(df: DataFrame, keep: list[str], computed: list[str]) -> DataFrame:
    """The same rows and columns, with the computed columns passed through a generator.

    The optimizer pushes a filter below a projection by copying the column's expression
    into it. For a scan that would run every pattern twice, and for chained rewrites the
    copies multiply. A filter on generated columns stays where it is, while a filter on the
    kept columns (keys, dates) is still pushed down to the files.
    """
    fields = ", ".join(f"'{c}', {c}" for c in computed)
    return df.selectExpr(*keep, f"inline(array(named_struct({fields})))")
