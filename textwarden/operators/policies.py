"""The policy store: stored rules, and rules for the scan taken from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textwarden.functions.policy import ACTION_RANK, RULE_SCHEMA, rules_literal
from textwarden.options import DEFAULTS, ScanOptions

STORE_SCHEMA = "id bigint, name string, conditions string, action string, enabled int, created_at string"
CONDITIONS = ("struct<detectedCategories:array<string>,detectedTags:array<string>,"
              "destinationTiers:array<string>,maxRiskScore:double,_malformed:string>")


def read_policies(store: DataFrame) -> DataFrame:
    """All stored rules by id, with the conditions decoded.

    ``malformed`` marks rules whose conditions are not an object of the known types. Their
    conditions read as unstated, so such rules must not be evaluated.
    """
    parsed = F.from_json(F.coalesce("conditions", F.lit("{}")), CONDITIONS, {"columnNameOfCorruptRecord": "_malformed"})
    return (store.withColumn("conditions", parsed)
            .withColumn("malformed", F.col("conditions").isNull() | F.col("conditions._malformed").isNotNull())
            .withColumn("conditions", F.col("conditions").dropFields("_malformed")).orderBy("id"))


def rules_as_of(store: DataFrame, moment: Column) -> DataFrame:
    """The store as it stood at a moment: of each id the version appended last up to then.

    Rows are only ever appended, an edit being a new row of the same id. Rows whose time of
    creation cannot be read count as the oldest; of equally old rows the greatest by content stands.
    """
    columns = [c for c in store.columns if c != "id"]
    since = F.coalesce(F.try_to_timestamp("created_at"), F.timestamp_millis(F.lit(0)))
    version = F.struct(since.alias("_since"), *columns)
    return (store.withColumn("_version", version).filter(F.col("_version._since") <= moment)
            .groupBy("id").agg(F.max("_version").alias("_version"))
            .select("id", *[F.col(f"_version.{c}").alias(c) for c in columns]).select(*store.columns))


def malformed_policies(store: DataFrame) -> DataFrame:
    """Stored rules that are set aside, as stored."""
    bad = read_policies(store).filter("malformed").select("id")
    return store.join(bad, "id", "left_semi")


def policy_row(spark: SparkSession, rule_id: int, name: str, conditions: str, action: str) -> DataFrame:
    """A new rule as it is appended to the store."""
    return spark.range(1).select(
        F.lit(rule_id).cast("bigint").alias("id"), F.lit(name).alias("name"), F.lit(conditions).alias("conditions"),
        F.lit(action).alias("action"), F.lit(1).alias("enabled"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("created_at"))


def stored_rules(store: DataFrame, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Well-formed rules of a store, one row each, with their place in the order of evaluation."""
    rank = "CASE action " + " ".join(f"WHEN '{a}' THEN {r}" for a, r in ACTION_RANK.items()) + " END"
    stored = read_policies(store).filter("NOT malformed")
    if options.honour_rule_enabled:
        stored = stored.filter("enabled = 1")
    return stored.selectExpr(
        f"{rank} AS rank", "0 AS source", "id AS ord", "cast(id AS string) AS id", "name", "action",
        "conditions.detectedCategories AS categories", "conditions.detectedTags AS tags",
        "conditions.destinationTiers AS tiers", "conditions.maxRiskScore AS max_risk",
        "cast(null AS string) AS reason").filter("rank IS NOT NULL")


def rules_from(store: DataFrame, options: ScanOptions = DEFAULTS) -> Column:
    """Rules of a small store followed by the built-in rules, as one array in evaluation order.

    The array is a scalar subquery, sorted within it, so payloads are neither joined nor
    shuffled for it and see the finished array. Rules with malformed conditions are left out.
    Every payload walks the array; ``rule_table.compile_rules`` serves stores of any size.
    """
    rows = stored_rules(store, options)
    listed = F.collect_list(F.struct(*rows.columns)).cast(f"array<struct<{RULE_SCHEMA}>>")
    return rows.agg(F.sort_array(F.concat(listed, F.expr(rules_literal(options.extra_rules))))).scalar()
