import math
import random

import pytest
from pyspark.sql import Window, functions as F

from textwarden.operators import evaluate, grams, training
from textwarden.sources import sinks, tables


@pytest.fixture(scope="module")
def corpus(spark):
    """Synthetic labelled texts in the proportions of a small leak corpus: 67 leaks, 98 harmless."""
    rng = random.Random(42)
    key = lambda n: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789", k=n))
    leaks = {
        "CREDENTIAL": [lambda: f"AWS_ACCESS_KEY_ID=AKIA{key(16).upper()}", lambda: f"api_key = '{key(32)}'",
                       lambda: f"token: ghp_{key(36)}", lambda: f"password={key(14)}"],
        "INFRA": [lambda: f"postgres://admin:{key(10)}@10.0.{rng.randint(0, 255)}.7:5432/prod",
                  lambda: f"redis://:{key(12)}@cache.internal:6379/0"],
        "PII": [lambda: f"SSN: {rng.randint(100, 600)}-45-{rng.randint(1000, 9999)} card 4111 1111 1111 {rng.randint(1000, 9999)}"],
    }
    makers = [(category, make) for category, group in leaks.items() for make in group]
    rows = [(i, makers[i % len(makers)][1](), 1, makers[i % len(makers)][0]) for i in range(67)]
    topics = ["sorting lists", "cooking rice", "reading novels", "planning trips", "growing plants", "playing chess"]
    asks = ["How do I get better at {}?", "Could you explain {} to a beginner?", "What are good books about {}?",
            "Please write a short story on {} for children."]
    rows += [(67 + i, asks[i % 4].format(topics[i % 6]) + " " + rng.choice(["Thanks!", "Thank you.", "Cheers", ""]), 0, "BENIGN")
             for i in range(98)]
    return spark.createDataFrame(rows, "id int, text string, label int, category string")


def test_char_grams(spark):
    got = spark.sql(f"SELECT {training.char_grams(repr('Ab c'))} AS g").first().g
    assert sorted(got) == sorted([" ", "a", "b", " ", " a", "ab", "b ", " ab", "ab ", " ", "c", " ", " c", "c ", " c "])


def test_class_ranks_equal_a_plain_window(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id % 3 = 0 AS INT) AS label")
    plain = df.withColumn("rank", F.row_number().over(
        Window.partitionBy("label").orderBy(F.md5(F.col("id").cast("string")), "id")))
    ours = training.class_ranks(df, "id").select("id", "label", "rank")
    assert set(ours.collect()) == set(plain.collect())


def test_split_is_stratified(corpus):
    rows = training.stratified_split(corpus, "id").groupBy("label", "part").count().collect()
    assert {(r.label, r.part): r["count"] for r in rows} == {
        (1, "test"): 13, (1, "train"): 54, (0, "test"): 20, (0, "train"): 78}


def test_class_balance(corpus):
    rows = {r.label: (r.rows, r.weight) for r in evaluate.class_balance(corpus).collect()}
    assert rows == {1: (67, 165 / 134), 0: (98, 165 / 196)}
    assert 0.5 <= rows[1][0] / rows[0][0] <= 2.0


def test_train_report_and_reload(spark, corpus, tmp_path):
    split = training.stratified_split(corpus, "id").cache()
    model, report = training.report(split)
    sinks.append_report(report, str(tmp_path / "versions"))
    sinks.append_report(report.withColumn("f1", F.lit(0.0)).withColumn("trained_at", F.timestamp_millis(F.lit(0))),
                        str(tmp_path / "versions"))
    versions = spark.read.parquet(str(tmp_path / "versions"))
    assert versions.count() == 2
    row = training.latest(versions).first()
    assert (row.sample_size, row.train_size, row.test_size) == (165, 132, 33)
    assert row.cv_f1_mean >= 0.80 and row.f1 >= 0.85 and row.fp == 0
    path = str(tmp_path / "model")
    training.save(model, path)
    again = training.load_or_train(spark, path, lambda: pytest.fail("must not train"))
    texts = spark.createDataFrame([("api_key = 'Zk3Jd8sPq2Lm9XvB4nTc'",), ("How do I cook rice?",)], "text string")
    out = training.predict(again, texts).collect()
    assert [r.sensitive for r in out] == [True, False]
    assert out[1].entropy == pytest.approx(3.6163, abs=1) and 0 <= out[1].confidence <= 1
    by_category = evaluate.category_accuracy(training.predict(model, split.filter("part = 'test'")))
    assert {r.category: r.type for r in by_category.collect()}["BENIGN"] == "benign"


def test_tfidf_formula(spark):
    df = spark.createDataFrame([(0, "aa", 1), (1, "b", 0), (2, "a", 0)], "id int, text string, label int")
    model = training.fit(df)
    terms, scaled = model.stages[1].vocabulary, model.stages[2].getScalingVec()
    # "aa" occurs in one of three texts
    assert scaled[terms.index("aa")] == pytest.approx(math.log(4 / 2) + 1)
    vector = model.transform(df).filter("id = 0").first().features
    assert vector.norm(2) == pytest.approx(1.0)


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([(False, False)], "p boolean, e boolean")
    assert evaluate.evaluation_matrix(df, F.col("p"), F.col("e")).first().precision == 1.0
    assert evaluate.metrics(evaluate.confusion(df, F.col("p"), F.col("e"))).first().f1 == 0.0


def test_latest_report(spark):
    reports = spark.createDataFrame([(1, 0.5), (3, 0.9), (2, 0.7)], "trained_at int, f1 double")
    assert training.latest(reports).first().f1 == 0.9


def test_load_or_train_trains_when_missing(spark, corpus, tmp_path):
    path = str(tmp_path / "none")
    model = training.load_or_train(spark, path, lambda: corpus)
    assert len(model.stages) == 5 and (tmp_path / "none").exists()


def test_cross_validation_equals_a_fit_per_fold(corpus):
    split = training.stratified_split(corpus, "id").cache()
    train = split.filter("part = 'train'")
    got = {r.fold: r.f1 for r in training.cross_validate(split).collect()}
    for fold in range(2):
        model = training.fit(train.filter(F.col("fold") != fold))
        assert got[fold] == training.score(training.predict(model, train.filter(F.col("fold") == fold))).first().f1
    assert sorted(got) == [0, 1, 2, 3, 4]


def test_counts_of_known_grams(spark):
    """Texts counted word by word hold the same grams as texts cut whole."""
    rng = random.Random(1)
    values = [" ".join("".join(rng.choices("abÄ\U0001f600", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, " \n "]
    df = spark.createDataFrame(list(enumerate(values)), "id int, text string").repartition(5)
    plain = df.select("id", F.explode(F.expr(training.char_grams())).alias("gram"))
    totals = {r.gram: r.n for r in grams.occurrences(df, n=F.lit(True)).collect()}
    assert totals == {r.gram: r["count"] for r in plain.groupBy("gram").count().collect()}
    terms = sorted(totals)[::3]
    want = {(r.id, r.gram): r["count"] for r in plain.groupBy("id", "gram").count().collect() if r.gram in terms}
    found = grams.known_counts(df.selectExpr("id", f"{grams.words('text')} AS words"), terms).collect()
    assert len(found) == len(values)
    assert {(r.id, terms[p]): n for r in found for p, n in zip(r.positions, r.tfs)} == want


def test_tasks_of_a_scan_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """One large row group is no reason for one large task, however many bytes a core has to take."""
    spark.range(200_000).selectExpr("id", "md5(cast(id AS string)) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(tables, "TASK_BYTES", 20_000)
    monkeypatch.setattr(tables, "SMALL_BYTES_PER_CORE", 1_000, raising=False)
    counts = tables.spread(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) > 200 and max(r["count"] for r in counts) < 2_000


def test_tasks_of_a_scan_are_bounded_by_the_text_not_by_its_file(spark, tmp_path, monkeypatch):
    """Copies of a text shrink to almost nothing in a file, but each is scanned."""
    spark.range(4_000).selectExpr("id", "repeat('ab ', 500) AS text", "cast(null AS string) AS none").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.schema("id long, text string, none string").parquet(str(tmp_path / "t"))
    monkeypatch.setattr(tables, "TASK_BYTES", 40_000)
    counts = tables.spread(df).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == 4_000 and max(r["count"] for r in counts) < 50
    assert tables.text_bytes(df) == 4_000 * 1_500 and tables.text_bytes(df.select("id")) == 0 == tables.text_bytes(df.limit(0))
