"""Parts of a stream arrive as many files, and each part is one batch."""

import os

from pyspark.sql import functions as F

from textwarden.operators import gradient
from textwarden.plans import streams
from textwarden.streaming import jobs


def test_a_part_of_many_files_is_one_batch(spark, tmp_path):
    folder, session = f"file://{tmp_path}", streams.streaming(spark)
    rows = spark.range(4000).selectExpr("id", "cast(id % 2 AS int) AS part").repartition(6)

    def start():
        source = streams.batches_of(session, f"{folder}/in", "id bigint")
        return jobs._start(source.writeStream.foreachBatch(
            lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{folder}/out")), session, f"arrival-{tmp_path.name}", True)

    streams.arrive([rows.filter(f"part = {k}").drop("part") for k in range(2)], f"{folder}/in", start)
    assert len([f for f in os.listdir(tmp_path / "in") if f.endswith(".json")]) == 12
    found = spark.read.parquet(f"{folder}/out").groupBy("batch").agg(F.count("id").alias("n"), F.max(F.col("id") % 2).alias("most"), F.min(F.col("id") % 2).alias("least"))
    assert sorted(map(tuple, found.collect())) == [(0, 2000, 0, 0), (1, 2000, 1, 1)]


def test_gram_counts_hold_a_row_per_document(spark):
    """Documents that repeat a key count as one; no row per gram is kept."""
    docs = spark.createDataFrame([(1, "ab ab c"), (1, "ab"), (2, "c"), (3, " "), (None, "d")], "id int, text string")
    counts = gradient.gram_counts(docs, "id")
    assert {r.id: sorted(zip(r.words, r.times)) for r in counts.collect()} == {1: [("ab", 3), ("c", 1)], 2: [("c", 1)], None: [("d", 1)]}
    terms = {r.term: (r.occurrences, r.df) for r in gradient.vocabulary(counts, 50).collect()}
    assert terms["ab"] == (3, 1) and terms["c"] == (2, 2) and terms["d "] == (1, 1) and terms[" "] == (12, 3)
