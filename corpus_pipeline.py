"""A training corpus from ``documents``: toxic texts out, lines and near copies once, sources mixed, tokens counted.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from textwarden.llm import bpe, line_dedup, mixing, partenum, toxicity
from textwarden.llm.common import stored
from textwarden.llm.queries import toxicity_model, vocabulary_path
from textwarden.sources.tables import table

#: words of a shingle and least Jaccard similarity of near copies
NEAR_WORDS, NEAR_SIMILARITY = 5, Fraction(4, 5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a significant toxic passage; labels of held-out rows are not used."""
    model = toxicity_model(spark, sf_dir, docs)
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only; documents that keep no word of theirs go."""
    cut = line_dedup.dedup_lines(docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars"))
                             .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 the one with the smallest id."""
    linked = partenum.similar(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)
    copies = linked.filter("component_id <> id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.drawn(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text of the mix encoded and decoded: token count and digests."""
    return bpe.digests(docs, bpe.read_text(spark, vocabulary_path()), keep=["doc_id", "lang", "source"])


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("jaccard_join", dedup_near),
          ("source_mix", mix_sources), ("bpe", encode)]

#: the model, the balanced draw and the merges have no SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
