"""Security events: metadata about judged payloads. No event column ever holds text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textwarden.options import DEFAULTS, ScanOptions

#: columns of a stored event, with the wire types
EVENT_SCHEMA = (
    "event_id string, timestamp bigint, destination_category string, detected_tags array<string>, "
    "risk_score int, action string, content_length int, payload_sha256_prefix string, employee_id string, "
    "device_id string, browser_fingerprint string"
)
ACTIONS = ["ALLOW", "WARN", "BLOCK"]
ALERT_SCORE = 70
SALTS = 64


def event_id(millis: str, suffix: str) -> str:
    """``evt_`` and the time in base 36; the payload id keeps ids of one millisecond apart."""
    return f"concat('evt_', lower(conv({millis}, 10, 36)), '_', {suffix})"


def build_events(judged: DataFrame, suffix: str, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Event rows from judged payloads that carry ``ts`` and, if known, the identity columns."""
    have = set(judged.columns)
    identity = [c if c in have else f"cast(null AS string) AS {c}"
                for c in ("employee_id", "device_id", "browser_fingerprint")]
    shown = "sha256_prefix" if options.hash_allowed else (
        "CASE WHEN final_decision = 'ALLOW' THEN 'pending' ELSE sha256_prefix END")
    events = judged.selectExpr(
        f"{event_id('unix_millis(ts)', suffix)} AS event_id",
        "unix_millis(ts) AS timestamp", "tier AS destination_category", "detected_tags", "risk_score",
        "final_decision AS action", "text_length AS content_length", f"{shown} AS payload_sha256_prefix",
        "ml_probability", "ml_confidence", *identity,
    )
    return sample_benign(events, options)


def sample_benign(events: DataFrame, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Service switch and the sampling rate for harmless events (decided by the id's hash)."""
    if not options.enabled:
        return events.filter("false")
    if options.sample_rate >= 100:
        return events
    return events.filter(
        f"action <> 'ALLOW' OR conv(substring(md5(event_id), 1, 8), 16, 10) % 100 < {options.sample_rate}")


def validated(events: DataFrame) -> DataFrame:
    """Incoming events with ``reject_reason`` (null when the row is acceptable)."""
    missing = [f"WHEN {c} IS NULL THEN 'missing {c}'"
               for c in ("timestamp", "destination_category", "risk_score", "action")]
    return events.withColumn("reject_reason", F.expr(
        f"CASE {' '.join(missing)} WHEN risk_score NOT BETWEEN 0 AND 100 THEN 'risk_score out of range' END"))


def filled_ids(events: DataFrame, origin: str | None = None) -> DataFrame:
    """Events with a full-length id each.

    With the name of a column that says where a row came from (its file), a missing id is derived from that
    place, the row and its number among equal rows there, so reading the input again gives the same ids.
    Without one it is random, and the rows must be stored before their ids are used twice.
    """
    if origin is None:
        return events.withColumn("event_id", F.expr("coalesce(event_id, concat('evt_', replace(uuid(), '-', '')))"))
    columns = [c for c in events.columns if c != origin]
    content = F.sha2(F.to_json(F.struct(*columns)), 256)
    same = Window.partitionBy(origin, "_content").orderBy(F.lit(0))
    named = events.filter("event_id IS NOT NULL")
    nameless = (events.filter("event_id IS NULL").withColumn("_content", content)
                .withColumn("_number", F.row_number().over(same))
                .withColumn("event_id", F.concat(F.lit("evt_"), F.substring(
                    F.sha2(F.concat_ws("|", origin, "_content", "_number"), 256), 1, 32))))
    return named.unionByName(nameless.select(*events.columns))


def accepted(events: DataFrame, origin: str | None = None) -> DataFrame:
    """Valid events as stored: a full-length id filled in, time of receipt added, tags never null."""
    valid = validated(events).filter("reject_reason IS NULL").drop("reject_reason")
    filled = filled_ids(valid, origin)
    return (filled if origin is None else filled.drop(origin)).withColumns({
        "received_at": F.current_timestamp(),
        "detected_tags": F.expr("coalesce(detected_tags, cast(array() AS array<string>))")})


def rejected(events: DataFrame) -> DataFrame:
    return validated(events).filter("reject_reason IS NOT NULL")


def unique_events(events: DataFrame) -> DataFrame:
    """One row per event id: the earliest by time, then by content.

    Taken by a minimum, not a sort, so duplicates combine before the shuffle and an id
    repeated very often costs one row per task.
    """
    others = [c for c in events.columns if c != "event_id"]
    lead = [c for c in ("timestamp",) if c in others]
    row = F.struct(*lead, *[c for c in others if c not in lead])
    return (events.groupBy("event_id").agg(F.min(row).alias("row"))
            .select("event_id", *[F.col(f"row.{c}").alias(c) for c in others]))


def decoded_tags(events: DataFrame) -> DataFrame:
    """Tags that another writer stored as JSON text back to an array; null becomes an empty array.

    Tables of this library hold arrays already and pass unchanged, but for nulls.
    """
    if events.schema["detected_tags"].dataType.typeName() == "array":
        return events.withColumn("detected_tags", F.expr("coalesce(detected_tags, cast(array() AS array<string>))"))
    return events.withColumn("detected_tags", F.expr(
        "coalesce(from_json(detected_tags, 'array<string>'), cast(array() AS array<string>))"))


def list_events(events: DataFrame, limit: int = 50, action: str | None = None) -> DataFrame:
    """Most recent events, optionally of one action (any case)."""
    chosen = events if action is None else events.filter(F.col("action") == action.upper())
    return chosen.orderBy(F.desc("timestamp"), "event_id").limit(limit)


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


def recent_preview(events: DataFrame, limit: int = 8, tags: int = 3) -> DataFrame:
    return list_events(events, limit).withColumn("detected_tags", F.slice("detected_tags", 1, tags))


def alerts(events: DataFrame, product: str = "DLP") -> DataFrame:
    """One alert row per event that was blocked or scored high."""
    who = "coalesce(nullif(employee_id, ''), 'unknown')"
    device = "coalesce(nullif(device_id, ''), 'unknown')"
    return events.filter(f"action = 'BLOCK' OR risk_score >= {ALERT_SCORE}").selectExpr(
        f"concat('[{product}] ', action, ' | Risk ', risk_score, '/100 | ', destination_category, "
        f"' | Employee: ', {who}, ' | Device: ', {device}) AS text",
        "event_id", "risk_score", "destination_category AS destination", "detected_tags", "action",
        f"{who} AS employee_id", f"{device} AS device_id", "timestamp",
        "'0 bytes plaintext transmitted or stored' AS zero_plaintext_proof",
    )


def alert_payloads(events: DataFrame) -> DataFrame:
    """Alerts as JSON documents, ready for any transport."""
    rows = alerts(events)
    return rows.select("event_id", F.to_json(F.struct(*rows.columns)).alias("payload"))


def last_per_device(events: DataFrame, keep: int = 100) -> DataFrame:
    """The newest events of every device.

    First per device and salt, then per device: a device holding a large share of all
    events is ranked by many tasks, and the last step sees at most SALTS * keep of its rows.
    """
    newest = [F.desc("timestamp"), F.asc("event_id")]
    salted = events.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)))
    first = Window.partitionBy("device_id", "_salt").orderBy(*newest)
    final = Window.partitionBy("device_id").orderBy(*newest)
    few = salted.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= keep).drop("_rank", "_salt")
    return few.withColumn("position", F.row_number().over(final)).filter(F.col("position") <= keep)


def with_identity(events: DataFrame, managed: DataFrame, local: DataFrame) -> DataFrame:
    """Fill identity from the managed store, else from the local one, per device.

    Both stores hold (device_key, employee_id, device_id, user_agent), one row per device.
    Spark broadcasts a store when its size allows and splits hot devices otherwise.
    """
    m = managed.select("device_key", F.col("employee_id").alias("_m_emp"), F.col("device_id").alias("_m_dev"))
    n = local.select("device_key", F.col("employee_id").alias("_l_emp"), F.col("device_id").alias("_l_dev"),
                     F.col("user_agent").alias("_agent"))
    kept = [c for c in events.columns if c not in ("employee_id", "device_id", "browser_fingerprint")]
    return events.join(m, "device_key", "left").join(n, "device_key", "left").selectExpr(
        *kept,
        "coalesce(nullif(_m_emp, ''), nullif(_l_emp, '')) AS employee_id",
        "coalesce(nullif(_m_dev, ''), nullif(_l_dev, '')) AS device_id",
        "substring(_agent, 1, 80) AS browser_fingerprint")


def size_proof(events: DataFrame) -> DataFrame:
    """Bytes of each event against the characters of the payload it stands for."""
    return events.select(
        "event_id", "content_length", F.octet_length(F.to_json(F.struct(*events.columns))).alias("event_bytes"))
