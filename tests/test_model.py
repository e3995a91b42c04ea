import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.model import toy_model
from reviewmill import fixed
from reviewmill.operators import features, metrics, modelling
from reviewmill.plans import training


@pytest.fixture(scope="module")
def labelled(spark):
    """A third of the rows carry each label; the text gives the label away."""
    words = ["crypto discount code www", "weather friend heard", "great food nice staff"]
    rows = [(i, "Cafe", words[i % 3] + " x" * (i % 40), i % 5 + 1, "food", i % 3,
             "2025-01-01") for i in range(300)]
    return spark.createDataFrame(
        rows, "review_id bigint, company_name string, text string, stars int, category string, "
              "label int, review_date string").repartition(4, "review_id")


@pytest.mark.parametrize("few", [0, 2, 1000])
@pytest.mark.parametrize("cell_rows", [1, 30, 5000])
def test_stratified_split_is_exact(spark, cell_rows, few, monkeypatch):
    monkeypatch.setattr(modelling, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(modelling, "FEW_LABELS", few)
    rows = [(i, 0 if i % 10 else i % 3) for i in range(1003)] + [(5000, None), (6000, 7)]
    df = spark.createDataFrame(rows, "review_id bigint, label int")
    out = modelling.stratified_split(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        n, v = sizes.get(r.label, (0, 0))
        sizes[r.label] = (n + 1, v + (r.split == "validation"))
    assert all(0 <= v - n * 2 // 10 <= 1 for n, v in sizes.values()), sizes
    assert sum(v for _, v in sizes.values()) == math.ceil(len(rows) * 2 / 10)


def test_stratified_split_does_not_depend_on_partitions(labelled):
    a = {r.review_id: r.split for r in modelling.stratified_split(labelled).collect()}
    b = {r.review_id: r.split for r in modelling.stratified_split(labelled.coalesce(1)).collect()}
    assert a == b
    plan = modelling.stratified_split(labelled).select("review_id", "text", "split")
    text_id = [a for a in range(len(labelled.columns)) if labelled.columns[a] == "text"]
    assert text_id and "BroadcastHashJoin" in plan._jdf.queryExecution().toString()


def test_hash_split_share(spark):
    df = spark.range(20_000).withColumnRenamed("id", "review_id")
    share = modelling.hash_split(df).where("split = 'validation'").count() / 20_000
    assert abs(share - fixed.VALIDATION_SHARE) < 0.01


def test_class_encode(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "label string")
    got = {(r.label, r.label_id) for r in modelling.class_encode(df).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), (None, None)}


def test_many_classes_are_encoded(spark):
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS label")
    got = {r.label: r.label_id for r in modelling.class_encode(df).collect()}
    assert got == {name: i for i, name in enumerate(sorted(map(str, range(3000))))}


@pytest.mark.parametrize("few", [0, 1000])
def test_shares_add_up_by_largest_remainder(spark, few, monkeypatch):
    monkeypatch.setattr(modelling, "FEW_LABELS", few)
    rows = [(i, "abc"[min(i // 14, 2)]) for i in range(33)] + [(99, None)]
    df = spark.createDataFrame(rows, "review_id bigint, label string")
    split = modelling.stratified_split(df).where("split = 'validation'").collect()
    counts = {n: sum(r.label == n for r in split) for n in ("a", "b", "c", None)}
    assert counts == {"a": 3, "b": 3, "c": 1, None: 0}  # 2.8, 2.8, 1.0, 0.2 of 34: 7 rows
    assert modelling.stratified_split(df.limit(0)).count() == 0


def test_missing_labels_are_no_class(spark):
    pairs = [(0, 0), (1, 1), (2, 2), (None, 1), (2, None)]
    cm = metrics.confusion_matrix(spark.createDataFrame(pairs, "label int, prediction int"))
    got = metrics.macro_metrics(cm).first()
    assert tuple(got) == (1.0, 1.0, 1.0, 1.0)


def test_the_report_scores_the_reviews_once(spark):
    @F.pandas_udf("int")
    def scored(label: pd.Series) -> pd.Series:
        return label

    pairs = spark.createDataFrame([(0,), (1,), (1,), (None,)], "label_id int").withColumn("prediction", scored("label_id"))
    counts = metrics.confusion_matrix(pairs, "label_id")
    assert {tuple(r) for r in counts.collect()} == {(0, 0, 1), (1, 1, 2)}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    report = training.evaluate(pairs)
    assert "scored" not in report._jdf.queryExecution().toString()
    assert {r.row: r.support for r in report.collect()}["accuracy"] == 3


def test_names_come_from_training(labelled, tmp_path, spark):
    """Names in another order than the ids of the fixed list, and one class absent."""
    named = labelled.withColumn("label", F.element_at(F.lit(["spam", "irrelevant", "relevant"]), F.col("label") + 1))
    meta, _ = training.train(named, toy_model)
    assert meta.classes == ("irrelevant", "relevant", "spam")
    rows = training.infer(named, toy_model, meta).collect()
    assert sum(r.label_name == r.label for r in rows) > 0.9 * len(rows)
    some, _ = training.train(labelled.where("label <> 1"), toy_model)
    assert some.classes == ("0", "2")


def test_scores_see_batches_and_stay_in_place(labelled):
    pairs = features.model_pairs(labelled)
    scored = modelling.with_probabilities(modelling.with_logits(pairs, toy_model))
    for r in modelling.with_prediction(scored).collect():
        want = [len(r.text) / 1000.0, len(r.poi) / 20.0, r.text.count("e") / 100.0]
        assert r.logits == pytest.approx(want)
        assert sum(r.probs) == pytest.approx(1) and r.prediction == want.index(max(want))


def test_metrics_with_classes_seen_on_one_side_only(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(2, 0)] + [(1, 3)]
    cm = metrics.confusion_matrix(spark.createDataFrame(pairs, "label int, prediction int"))
    got = metrics.macro_metrics(cm).first()
    precision = [3 / 4, 2 / 3, 0, 0]
    recall = [3 / 4, 2 / 3, 0, 0]
    f1 = [6 / 8, 4 / 6, 0, 0]
    assert got.accuracy == pytest.approx(5 / 8)
    assert got.precision_macro == pytest.approx(sum(precision) / 4)
    assert got.recall_macro == pytest.approx(sum(recall) / 4)
    assert got.f1_macro == pytest.approx(sum(f1) / 4)
    report = {r.row: r for r in metrics.classification_report(cm).collect()}
    assert report["0"].support == 4 and report["3"].support == 0
    assert report["weighted avg"].recall == pytest.approx(round(5 / 8, 4))
    assert report["macro avg"].precision == pytest.approx(round(sum(precision) / 4, 4))


def test_label_names(spark):
    df = spark.createDataFrame([(0,), (2,), (9,)], "label int")
    got = {(r.label, r.label_name) for r in metrics.with_label_name(df).collect()}
    assert got == {(0, "spam"), (2, "relevant"), (9, None)}


def test_train_predict_save_load(spark, labelled, tmp_path):
    model, scored = training.train(labelled, toy_model, exact_split=True)
    report = {r.row: r for r in training.evaluate(scored).collect()}
    assert report["accuracy"].f1 == 1.0 and report["accuracy"].support == 60
    modelling.save_model(model, spark, str(tmp_path / "model"))
    again = modelling.load_model(spark, str(tmp_path / "model"))
    assert again.classes == model.classes == ("0", "1", "2")
    one = training.infer(labelled, toy_model, model).orderBy("review_id").collect()
    two = training.infer(labelled, toy_model, again).orderBy("review_id").collect()
    assert [r.label_name for r in one] == [r.label_name for r in two]
    assert all(r.prediction == r.label and r.label_name == str(r.label) for r in one)


def test_training_needs_its_columns(labelled):
    with pytest.raises(ValueError, match="category"):
        training.train(labelled.drop("category"), toy_model)


def test_stack_by_id(spark):
    left = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "review_id int, presence array<double>")
    right = spark.createDataFrame([(2, [0.2]), (1, [0.1])], "review_id int, probs array<double>")
    got = {r.review_id: r.features for r in modelling.stack_features(left, right).collect()}
    assert got == {1: [1.0, 0.1], 2: [2.0, 0.2]}
    with pytest.raises(Exception, match="no probabilities for row 2"):
        modelling.stack_features(left, right.where("review_id = 1")).collect()


def test_meta_model_reaches_the_penalised_optimum(spark):
    """Probabilities equal those of a plain numpy descent on the same objective."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    y = (x @ rng.normal(size=(4, 3)) + rng.normal(size=(90, 3))).argmax(axis=1)
    df = spark.createDataFrame(
        [(i, row.tolist(), int(c)) for i, (row, c) in enumerate(zip(x, y))],
        "review_id int, features array<double>, label_id int")
    model = modelling.train_meta(df, staged=False)

    weights, bias, target = np.zeros((4, 3)), np.zeros(3), np.eye(3)[y]
    for _ in range(20_000):
        z = x @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= 0.5 * (x.T @ (p - target) / 90 + weights / 90)
        bias -= 0.5 * (p - target).mean(axis=0)
    z = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    q = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.abs(q / q.sum(axis=1, keepdims=True) - p).max() < 1e-4
    got = {r.review_id: r.prediction for r in modelling.predict_meta(model, df).collect()}
    assert [got[i] for i in range(90)] == p.argmax(axis=1).tolist()
