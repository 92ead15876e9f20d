import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from answerloom.operators import confusion as cm, metrics as mt


def frame(spark, pairs, topics=None):
    rows = [(i, t, p, topics[i] if topics else "x") for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "row_id int, y_true int, y_pred int, topic string")


def expected(pairs):
    """Independent numpy version over the labels that occur."""
    true = np.array([t for t, _ in pairs])
    pred = np.array([-1 if p is None else p for _, p in pairs])
    labels = sorted(set(true) | (set(pred) - {-1}))
    precision, recall, f1, support = [], [], [], []
    for c in labels:
        hit = np.sum((true == c) & (pred == c))
        precision.append(hit / np.sum(pred == c) if np.any(pred == c) else 0)
        recall.append(hit / np.sum(true == c) if np.any(true == c) else 0)
        both = precision[-1] + recall[-1]
        f1.append(2 * precision[-1] * recall[-1] / both if both else 0)
        support.append(np.sum(true == c))
    scored = pred >= 0
    matrix = np.zeros((3, 3))
    np.add.at(matrix, (true[scored], pred[scored]), 1)
    distance = (np.arange(3)[:, None] - np.arange(3)[None, :]) ** 2
    chance = (distance * np.outer(matrix.sum(1), matrix.sum(0))).sum() / max(matrix.sum(), 1)
    kappa = 1 - (distance * matrix).sum() / chance if chance else None
    weights = np.array(support) / len(pairs)
    return {
        "accuracy": np.mean(true == pred),
        "quadratic_weighted_kappa": kappa,
        "macro_precision": np.mean(precision),
        "macro_recall": np.mean(recall),
        "macro_f1": np.mean(f1),
        "weighted_precision": np.dot(weights, precision),
        "weighted_recall": np.dot(weights, recall),
        "weighted_f1": np.dot(weights, f1),
    }


CLASS = st.integers(0, 2)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(CLASS, st.one_of(CLASS, CLASS, CLASS, st.none())), min_size=1, max_size=30))
def test_summary_against_numpy(spark, pairs):
    row = mt.summary(cm.cells(frame(spark, pairs))).first()
    for name, value in expected(pairs).items():
        if value is None:
            assert row[name] is None
        else:
            assert row[name] == pytest.approx(value, abs=1e-12), name


def test_perfect_predictions(spark):
    row = mt.summary(cm.cells(frame(spark, [(0, 0), (1, 1), (2, 2), (2, 2)]))).first()
    assert row.quadratic_weighted_kappa == row.accuracy == row.macro_f1 == 1.0


def test_macro_is_over_present_labels_only(spark):
    row = mt.summary(cm.cells(frame(spark, [(0, 0), (1, 1)]))).first()
    assert row.macro_f1 == 1.0
    absent = mt.per_class(cm.cells(frame(spark, [(0, 0), (1, 1)]))).filter("label = 2").first()
    assert (absent.f1, absent.support) == (0.0, 0)


def test_one_label_topic_has_no_kappa(spark):
    row = mt.per_topic(cm.cells(frame(spark, [(1, 1), (1, 1)]), ["topic"])).first()
    assert row.quadratic_weighted_kappa is None
    assert row.macro_f1 == 1.0


def test_kappa_with_a_gap_between_labels(spark):
    row = mt.summary(cm.cells(frame(spark, [(0, 0), (0, 2), (2, 2), (2, 2)]))).first()
    assert row.quadratic_weighted_kappa == pytest.approx(0.5)


def test_unscored_and_unknown_truth(spark):
    pairs = [(0, 0), (1, None), (2, -1), (2, 2), (None, 1), (7, 1)]
    row = mt.summary(cm.cells(frame(spark, pairs))).first()
    assert (row.support, row.unscored, row.no_truth) == (4, 2, 2)
    assert row.accuracy == 0.5
    assert row.quadratic_weighted_kappa == 1.0


def test_naive_ties_and_random_baseline(spark):
    df = frame(spark, [(0, 0), (0, 0), (1, 1), (1, 1)])
    assert mt.summary(cm.cells(df)).first().macro_f1_naive == pytest.approx(2 / 3 / 2)
    many = spark.range(20000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 10 < 6, 2).when(F.col("id") % 10 < 9, 1).otherwise(0).alias("y_true"),
    )
    drawn = mt.random_predictions(many, "row_id").groupBy("y_pred").count().collect()
    share = {r.y_pred: r["count"] / 20000 for r in drawn}
    assert share == {0: pytest.approx(0.1, abs=0.01), 1: pytest.approx(0.3, abs=0.015),
                     2: pytest.approx(0.6, abs=0.015)}


def test_cells_add_up_over_any_partitioning(spark):
    pairs = [(i % 3, (i * i) % 3) for i in range(200)]
    df = frame(spark, pairs, topics=[str(i % 7) for i in range(200)])
    whole = cm.cells(df).collect()
    assert cm.merge_cells(cm.cells(df, ["topic"])).collect() == whole
    halves = cm.cells(df.filter("row_id < 77")).unionByName(cm.cells(df.filter("row_id >= 77")))
    assert cm.merge_cells(halves).collect() == whole
    assert cm.cells(df.repartition(13)).collect() == whole


def test_long_report_without_topic(spark):
    report = mt.long_report(frame(spark, [(0, 0), (1, 2), (2, 2)]), None)
    assert {r.scope for r in report.collect()} == {"overall", "class"}
    with_topic = mt.long_report(frame(spark, [(0, 0), (1, 2), (2, 2)]))
    both = {(r.scope, r.key, r.metric): r.value for r in with_topic.collect()}
    for r in report.collect():
        assert both[(r.scope, r.key, r.metric)] == r.value
    assert both[("overall", "overall", "overall_topic_weighted_f1")] == pytest.approx(
        both[("overall", "overall", "weighted_f1")]
    )
