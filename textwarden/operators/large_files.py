"""Signals of large text files, put together from their pieces.

Pieces are scanned like payloads, but keep raw counts; counts add up per file, and what depends on
them (thresholds, the checksum rule for cards, the classifier's sum) is decided once on the sums.
Connection strings, which may reach over any distance, are counted in the file's outline, the only
thing of a file that one task sees whole. The result is that of scanning the whole text in one row,
but for the hash, which is that of the file's label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textwarden.fixed_values import DETECTORS, INDICATORS
from textwarden.functions import detectors, entropy, linear, narrative
from textwarden.functions.text import plain_blanks, utf16_length
from textwarden.operators.files import text_like
from textwarden.operators.scan import SIGNALS, judge, scannable, summarize_signals, with_gates
from textwarden.operators.sealed import sealed
from textwarden.options import DEFAULTS, ScanOptions
from textwarden.sources.ranges import RANGE_BYTES, pieces, read_pieces, read_tasks
from textwarden.sources.tables import scratch

_CARD = next(i for i, d in enumerate(DETECTORS) if d[0] == "CREDIT_CARD")


def piece_counts(read: DataFrame, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Raw counts of each part of a piece (path, start, text, outline): numbers, features and secrets; and the outline, where it has one.

    Connection strings are not among them; they are counted in the outlines alone.
    """
    found = with_gates(scannable(read), "text", options).selectExpr(
        "path", "start", "outline", f"CAST({utf16_length('text')} AS BIGINT) AS text_length",
        f"concat({detectors.hit_counts(connections=False)}, {narrative.indicator_counts()}, "
        "array(size(_cards), if(exists(_cards, c -> luhn_check(c)), 1, 0))) AS numbers",
        f"{linear.feature_hits()} AS features", f"{entropy.secret_findings('_tokens', options.entropy_threshold)} AS secrets")
    return sealed(found, ["path", "start", "outline"], ["text_length", "numbers", "features", "secrets"])


def in_order(value: str) -> Column:
    """An array of a file's values by their starts; parts without a value are left out of it."""
    held = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("start", value)))
    return F.transform(F.sort_array(held), lambda p: p[value])


def connections(counted: DataFrame) -> DataFrame:
    """(path, connections): counts of the connection strings of each file, from the outlines of its pieces."""
    outlines = counted.groupBy("path").agg(F.array_join(in_order("outline"), "").alias("outline"))
    # few rows of much work each
    plain = outlines.repartition(counted.sparkSession.sparkContext.defaultParallelism * 4, "path").selectExpr("path", f"{plain_blanks('outline')} AS _plain")
    return plain.selectExpr("*", *detectors.gate_columns()).selectExpr("path", f"{detectors.connection_counts()} AS connections")


def detect_files(files: DataFrame, size: int = RANGE_BYTES, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Files (path, length and others) with the signals of ``scan.detect``; blank files are left out."""
    spark, tasks, folder = files.sparkSession, read_tasks(files), scratch(files.sparkSession, "pieces")
    # read and scanned once, for the three sums below
    piece_counts(read_pieces(pieces(files.select("path", "length"), size, tasks), tasks), options).write.parquet(folder)
    counted = spark.read.parquet(folder)
    numbers = F.array(*[F.sum(F.col("numbers")[i]).cast("int") for i in range(len(DETECTORS) + len(INDICATORS) + 2)])
    found = counted.withColumn("secrets", F.when(F.size("secrets") > 0, F.col("secrets")))
    whole = found.groupBy("path").agg(F.sum("text_length").cast("int").alias("text_length"), F.flatten(in_order("secrets")).alias("secrets"), numbers.alias("_n"))
    features = (counted.select("path", F.explode("features").alias("f")).groupBy("path", "f.i", "f.feature", "f.weight").agg(F.sum("f.n").cast("int").alias("n"))
                .withColumn("contribution", F.expr("weight * (1 + abs(weight) / 5.0D) * ln(1 + n)"))
                .groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "feature", "weight", "n", "contribution"))).alias("_features")))
    n = len(DETECTORS)
    single = ", ".join(str(i) for i, d in enumerate(DETECTORS) if "1" in d[6])
    cards = n + len(INDICATORS)
    reaching = [i for i, d in enumerate(DETECTORS) if d[0] in detectors.INDEXED]
    hits = (f"transform(slice(_n, 1, {n}), (c, i) -> CASE WHEN i = {_CARD} THEN if(_n[{cards + 1}] > 0, _n[{cards}], 0) "
            f"WHEN i IN ({', '.join(map(str, reaching))}) THEN connections[array_position(array({', '.join(map(str, reaching))}), i) - 1] "
            f"WHEN i IN ({single}) THEN least(c, 1) ELSE c END)")
    keep = files.columns
    none = "cast(array() AS array<struct<i:int,feature:string,weight:double,n:int,contribution:double>>)"
    joined = files.join(whole, "path").join(connections(counted), "path").join(features, "path", "left").selectExpr(
        *keep, "text_length", "secrets", "substring(sha2(concat('[File: ', element_at(split(path, '/'), -1), ']'), 256), 1, 16) AS sha256_prefix",
        f"{hits} AS _hits", f"slice(_n, {n + 1}, {len(INDICATORS)}) AS _counts", f"coalesce(_features, {none}) AS _features")
    scored = joined.selectExpr(*keep, "text_length", "secrets", "sha256_prefix", "_features", f"{detectors.findings('_hits')} AS findings",
                               f"{narrative.found('_counts')} AS _found", f"{linear.raw_score('_features', 'text_length')} AS _score")
    signals = scored.selectExpr(*keep, "text_length", "sha256_prefix", "findings", "secrets", f"{narrative.narrative('_found')} AS narrative",
                                f"{linear.classify('_score', '_features')} AS classifier")
    return sealed(signals, keep, SIGNALS)


def scan_large_files(files: DataFrame, size: int = RANGE_BYTES, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Verdicts on text-like files (path, length, host) on their way out, read in pieces; silent ones are left out."""
    wanted = text_like(files, options).select("path", "length", "host", F.lit("file_upload").alias("action_type"))
    return judge(summarize_signals(detect_files(wanted, size, options)), options=options).filter("final_decision IN ('BLOCK', 'WARN')")
