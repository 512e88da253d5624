"""Training and evaluation of the TF-IDF text classifier with MLlib.

The top terms come from counts of words, and the counts of these terms per text are stored once: the
models of all folds read the same rows, each with its own inverse frequencies.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from textwarden.functions.entropy import shannon_entropy
from textwarden.operators import grams
from textwarden.operators.evaluate import class_balance, confusion, metrics
from textwarden.operators.grams import MAX_GRAM
from textwarden.sources.tables import scratch

# --- fixed values -----------------------------------------------------------
MAX_TERMS = 2000
C = 5.0
MAX_ITERATIONS = 500
FOLDS = 5
TEST_SHARE = 0.2
TOLERANCE = 1e-4
VERSION = "2.0.0"

#: feature rows per task while fitting
ROWS_PER_TASK = 5_000
#: up to so many rows, the models of all folds are fitted side by side, else one after the other with all memory
SMALL_ROWS = 50_000

#: rows are ranked within hash buckets, so no task ever holds a whole class
_BUCKET_DIGITS = 3


def char_grams(text: str = "text") -> str:
    """Character n-grams of 1 to 3 within words, each word padded by a blank on both sides."""
    padded = f"transform({grams.words(text)}, w -> concat(' ', w, ' '))"
    cut = f"transform(sequence(1, {MAX_GRAM}), n -> transform(sequence(1, length(p) + 1 - n), i -> substring(p, i, n)))"
    return f"flatten(transform({padded}, p -> flatten({cut})))"


def class_ranks(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Add ``rank`` (from 1) of each row within its label, by the key's hash, and ``class_rows``.

    Ranks come from bucket sizes plus the rank inside a bucket of equal leading hash digits:
    a class of any size is ranked by thousands of tasks.
    """
    hashed = df.withColumn("_hash", F.md5(F.col(key).cast("string"))).withColumn(
        "_bucket", F.substring("_hash", 1, _BUCKET_DIGITS))
    sizes = hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .withColumn("class_rows", F.sum("_n").over(Window.partitionBy(label))).drop("_n"))
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    # at most 16^3 rows per label, whatever the size of the data
    return (hashed.withColumn("_inside", F.row_number().over(inside))
            .join(F.broadcast(offsets), [label, "_bucket"])
            .withColumn("rank", F.col("_before") + F.col("_inside"))
            .drop("_hash", "_bucket", "_before", "_inside"))


def stratified_split(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Add ``part`` (test or train, a fifth of each class to test) and ``fold`` (train rows)."""
    test_rows = F.floor(F.col("class_rows") * TEST_SHARE + F.lit(0.5))
    return (class_ranks(df, key, label)
            .withColumn("part", F.when(F.col("rank") <= test_rows, "test").otherwise("train"))
            .withColumn("fold", F.when(F.col("part") == "train", ((F.col("rank") - test_rows - 1) % FOLDS).cast("int")))
            .drop("rank", "class_rows"))


def top_terms(totals: DataFrame, count) -> list[str]:
    """The ``MAX_TERMS`` grams of (gram, ...) with the largest count above 0, largest first, ties by code point."""
    found = totals.select("gram", count.alias("n")).filter("n > 0").orderBy(F.desc("n"), "gram").limit(MAX_TERMS)
    return [r.gram for r in found.collect()]


def stored_counts(rows: DataFrame, terms: list[str], text: str = "text") -> str:
    """A folder with the rows' other columns and ``counts``: how often each term occurs, as a vector."""
    keep = [c for c in rows.columns if c != text]
    found = grams.known_counts(rows.selectExpr(*keep, f"{grams.words(text)} AS words"), terms)
    folder = scratch(rows.sparkSession, "counts")
    # the form in which MLlib stores a sparse vector
    found.selectExpr(*keep, f"named_struct('type', 0Y, 'size', {len(terms)}, 'indices', positions, 'values', tfs) AS counts").write.parquet(folder)
    return folder


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.parquet(folder).schema
    vectors = StructType([f for f in stored if f.name != "counts"]).add("counts", VectorUDT())
    return spark.read.schema(vectors).parquet(folder)


def frequencies(spark: SparkSession, folder: str, size: int, key: str) -> tuple[dict, dict]:
    """Rows by the key's value, and rows that hold each term by the key's value."""
    stored = spark.read.parquet(folder)
    rows = {r[0]: r[1] for r in stored.groupBy(key).count().collect()}
    holding = {k: np.zeros(size) for k in rows}
    # a row per term and value of the key
    for k, place, n in stored.select(key, F.explode("counts.indices").alias("_place")).groupBy(key, "_place").count().collect():
        holding[k][place] = n
    return rows, holding


def fit_counts(counted: DataFrame, scaling: np.ndarray, rows: int, label: str) -> list[Transformer]:
    """Scaling, unit length and logistic regression of rows with ``counts`` and ``weight``, of ``rows`` in training."""
    # term frequency times (idf + 1), then unit length
    scaled = ElementwiseProduct(inputCol="counts", outputCol="tfidf", scalingVec=Vectors.dense(scaling))
    unit = Normalizer(inputCol="tfidf", outputCol="features", p=2.0)
    # every optimizer step is a pass over the features, which the optimizer keeps
    spread = counted.repartition(max(1, rows // ROWS_PER_TASK))
    model = LogisticRegression(
        labelCol=label, weightCol="weight", maxIter=MAX_ITERATIONS, regParam=1.0 / (C * rows),
        elasticNetParam=0.0, standardization=False, tol=TOLERANCE,
    ).fit(unit.transform(scaled.transform(spread)))
    return [scaled, unit, model]


def weighted(counted: DataFrame, train: DataFrame, label: str) -> DataFrame:
    return counted.join(F.broadcast(class_balance(train, label).select(label, "weight")), label)  # one row per class


def inverse(rows: int, holding: np.ndarray) -> np.ndarray:
    return np.log((rows + 1.0) / (holding + 1.0))


def fit(train: DataFrame, label: str = "label") -> PipelineModel:
    """Fit the text pipeline: n-grams, top terms, smoothed TF-IDF, balanced logistic regression."""
    spark = train.sparkSession
    base = train.filter(F.col(label).isNotNull()).select(label, "text")
    terms = top_terms(grams.occurrences(base, n=F.lit(True)), F.col("n"))
    folder = stored_counts(base, terms)
    rows, holding = frequencies(spark, folder, len(terms), label)
    counted = weighted(read_counts(spark, folder), train, label)
    scaled, unit, model = fit_counts(counted, inverse(sum(rows.values()), sum(holding.values())) + 1.0, train.count(), label)
    cut = SQLTransformer(statement=f"SELECT *, {char_grams()} AS grams FROM __THIS__")
    return PipelineModel([cut, CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="counts"), scaled, unit, model])


def predict(model: PipelineModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Add sensitive, confidence (probability, 4 places) and text entropy (4 places)."""
    scored = model.transform(df)
    return scored.select(
        *df.columns, F.col("prediction").cast("int").alias("prediction"),
        (F.col("prediction") == 1).alias("sensitive"),
        F.round(vector_to_array("probability")[1], 4).alias("confidence"),
        F.expr(f"round({shannon_entropy(text)}, 4)").alias("entropy"))


def score(predicted: DataFrame, label: str = "label") -> DataFrame:
    return metrics(confusion(predicted, F.col("prediction") == 1, F.col(label) == 1))


def cross_validate(split: DataFrame, label: str = "label") -> DataFrame:
    """F1 of each fold of the training part, the model fitted on the other folds.

    Words are counted once by fold. Each model has the top terms and the inverse frequencies of its own
    folds; the stored counts are of the terms of any model, and the scaling leaves out those of the others.
    """
    spark = split.sparkSession
    train = split.filter("part = 'train'")
    base = train.filter(F.col(label).isNotNull()).select(label, "fold", "text")
    found = scratch(spark, "grams")
    grams.occurrences(base, **{f"n{fold}": F.col("fold") == fold for fold in range(FOLDS)}).write.parquet(found)
    totals = spark.read.parquet(found)
    own = [top_terms(totals, sum((F.col(f"n{other}") for other in range(FOLDS) if other != fold), F.lit(0))) for fold in range(FOLDS)]
    terms = sorted(set().union(*own))
    folder = stored_counts(base, terms)
    rows, holding = frequencies(spark, folder, len(terms), "fold")
    counted = read_counts(spark, folder)

    def fold_score(fold: int) -> DataFrame:
        others = [k for k in rows if k != fold]
        mine = np.isin(terms, own[fold])
        idf = inverse(sum(rows[k] for k in others), sum((holding[k] for k in others), np.zeros(len(terms))))
        rest = train.filter(F.col("fold") != fold)
        stages = fit_counts(weighted(counted.filter(F.col("fold") != fold), rest, label), np.where(mine, idf + 1.0, 0.0), rest.count(), label)
        held = PipelineModel(stages).transform(counted.filter(F.col("fold") == fold))
        return score(held, label).select(F.lit(fold).alias("fold"), "f1")

    with ThreadPool(FOLDS if sum(rows.values()) <= SMALL_ROWS else 1) as pool:
        return reduce(DataFrame.unionByName, pool.map(fold_score, range(FOLDS)))


def report(split: DataFrame, label: str = "label") -> tuple[PipelineModel, DataFrame]:
    """Model fitted on the training part, and a one-row report with hold-out and fold metrics."""
    model = fit(split.filter("part = 'train'"), label)
    held = score(predict(model, split.filter("part = 'test'")), label)
    folds = cross_validate(split, label).agg(
        F.round(F.avg("f1"), 4).alias("cv_f1_mean"), F.round(F.stddev_pop("f1"), 4).alias("cv_f1_std"))
    sizes = split.agg(F.count(F.lit(1)).alias("sample_size"),
                      F.count_if(F.col("part") == "train").alias("train_size"),
                      F.count_if(F.col("part") == "test").alias("test_size"))
    # three one-row aggregates side by side
    one = held.withColumn("_k", F.lit(1)).join(folds.withColumn("_k", F.lit(1)), "_k").join(
        sizes.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return model, one.withColumns({"version": F.lit(VERSION), "trained_at": F.current_timestamp()})


def latest(reports: DataFrame) -> DataFrame:
    """The most recent report."""
    row = F.max_by(F.struct(*reports.columns), "trained_at").alias("r")
    return reports.agg(row).select("r.*")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_or_train(spark: SparkSession, path: str, train) -> PipelineModel:
    """The stored model; ``train()`` supplies the training rows when there is none yet."""
    try:
        return PipelineModel.load(path)
    except Exception as error:  # a missing path surfaces as different errors per file system
        if "does not exist" not in str(error):
            raise
        model = fit(train())
        save(model, path)
        return model
