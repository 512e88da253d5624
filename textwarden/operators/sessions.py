"""Time-based analytics over events with a ``ts`` column."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window, functions as F


#: measures of a window: name, its value over events, how values of parts combine
TREND = [("events", "count(1)", "sum"), ("blocks", "count_if(action = 'BLOCK')", "sum"),
         ("max_risk", "max(risk_score)", "max"), ("total_risk", "sum(risk_score)", "sum")]
_UNITS = {"millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000,
          "week": 604_800_000_000}


def micros(interval: str) -> int:
    """A length of time such as ``10 minutes``, in microseconds."""
    number, unit = interval.split()
    return int(number) * _UNITS[unit.rstrip("s")]


def sliding(events: DataFrame, width: str, slide: str, measures=TREND, keys: tuple[str, ...] = ()) -> DataFrame:
    """Measures of every window of ``width`` that begins at a multiple of ``slide`` and holds an event.

    Events are first combined into panes that no window cuts, so each is read once however many
    windows hold it. Panes are laid out in blocks as long as a window: a window is the end of one
    block and the beginning of the next, so two running totals per pane, forwards and backwards
    within its block, give all windows; the cost does not depend on how often they overlap.
    """
    size, step = micros(width), micros(slide)
    if step > size:
        raise ValueError("a slide must not be longer than its window")
    pane = gcd(size, step)
    n = size // pane
    at = F.expr(f"(unix_micros(ts) - pmod(unix_micros(ts), {pane})) div {pane}")
    panes = events.filter("ts IS NOT NULL").groupBy(*keys, at.alias("_pane")).agg(*[F.expr(value).alias(name) for name, value, _ in measures])
    block = F.floor(F.col("_pane") / n)
    # windows that begin in the block before also hold a block's panes
    slots = (panes.select(*keys, F.explode(F.array(block, block - 1)).alias("_block")).distinct()
             .select(*keys, F.explode(F.sequence(F.col("_block") * n, F.col("_block") * n + (n - 1))).alias("_pane")))
    names, running = [name for name, *_ in measures], {"sum": F.sum, "max": F.max}
    laid = (panes.unionByName(slots, allowMissingColumns=True).groupBy(*keys, "_pane")
            .agg(*[running[how](name).alias(name) for name, _, how in measures]).withColumn("_block", block))

    def totals(order, suffix: str) -> list:
        window = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return [running[how](name).over(window).alias(f"{name}{suffix}") for name, _, how in measures]

    tail = laid.select(*keys, F.col("_pane").alias("_begin"), *totals(F.desc("_pane"), "_tail")).filter(f"pmod(_begin, {step // pane}) = 0")
    head = laid.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("_pane") - (n - 1)).alias("_first"), *totals(F.asc("_pane"), "_head"))
    # a window that begins with its block is that block
    meets = " AND ".join(["_begin = _first", f"pmod(_begin, {n}) <> 0", *[f"{k} <=> _{k}" for k in keys]])
    both = tail.join(head, F.expr(meets), "left")
    merged = {"sum": "if({0}_tail IS NULL AND {0}_head IS NULL, null, coalesce({0}_tail, 0) + coalesce({0}_head, 0)) AS {0}",
              "max": "greatest({0}_tail, {0}_head) AS {0}"}
    combined = [merged[how].format(name) for name, _, how in measures]
    return both.selectExpr(*keys, f"timestamp_micros(_begin * {pane}) AS window_start",
                           f"timestamp_micros(_begin * {pane} + {size}) AS window_end", *combined).filter(F.col(names[0]) > 0)


def risk_trend(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event count, blocks and risk per window (sliding when a slide is given)."""
    if slide:
        return sliding(events, width, slide)
    return (events.groupBy(F.window("ts", width).alias("w")).agg(*[F.expr(value).alias(name) for name, value, _ in TREND])
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *[name for name, *_ in TREND]))


def floods(events: DataFrame, limit: int = 100, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Devices that sent more than ``limit`` events within one window, tumbling or sliding."""
    if slide:
        counted = sliding(events, width, slide, TREND[:1], ("device_id",)).drop("window_end")
    else:
        counted = (events.groupBy("device_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("events"))
                   .select("device_id", F.col("w.start").alias("window_start"), "events"))
    return counted.filter(F.col("events") > limit)


def leak_sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of one employee, split by pauses of more than the gap, with the tags they add up to.

    Events are first combined into cells as wide as the gap: two events of one cell are never
    further apart than the gap, so a cell lies within one session. That step combines before
    its shuffle, and afterwards an employee has at most one row per cell, however many events
    they caused. Only these few rows are ordered per employee.
    """
    cells = (
        events.withColumn("_cell", F.floor(F.unix_micros("ts") / F.lit(gap_seconds * 1_000_000)))
        .select("employee_id", "_cell", "ts", "risk_score", F.posexplode_outer("detected_tags").alias("_pos", "_tag"))
        .groupBy("employee_id", "_cell")
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"),
             F.count_if(F.coalesce("_pos", F.lit(0)) == 0).alias("n"),
             F.max("risk_score").alias("max_risk"), F.collect_set("_tag").alias("tags"))
    )
    order = Window.partitionBy("employee_id").orderBy("_cell")
    gap = F.unix_micros("first") - F.unix_micros(F.lag("last").over(order))
    starts = cells.withColumn("_new", F.when(gap <= gap_seconds * 1_000_000, 0).otherwise(1))
    numbered = starts.withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("employee_id", "_session")
        .agg(F.min("first").alias("session_start"), F.max("last").alias("session_end"), F.sum("n").alias("events"),
             F.max("max_risk").alias("max_risk"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
        .drop("_session")
    )


def lateness(events: DataFrame) -> DataFrame:
    """Seconds between an event's own time and its receipt."""
    return events.withColumn(
        "late_seconds", (F.unix_micros("received_at") - F.unix_micros("ts")) / F.lit(1_000_000))
