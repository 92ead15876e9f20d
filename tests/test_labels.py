import pytest
from pyspark.errors import PySparkException

from answerloom.functions import labels as lb


def test_strict_label(values):
    assert values(lb.strict_label, ["0", " 1 ", "2.0", "Incorrect", "\tPARTIAL\n", "\xa0correct "]) == [
        0, 1, 2, 0, 1, 2,
    ]


@pytest.mark.parametrize("bad", ["1.5", "3", "-1", "nan", "inf", "1d", "", "partially correct", None])
def test_strict_label_rejects(values, bad):
    with pytest.raises(PySparkException):
        values(lb.strict_label, [bad])


def test_try_strict_label_is_null_instead(values):
    assert values(lb.try_strict_label, ["1.5", None, "2"]) == [None, None, 2]


def test_lenient_label(values):
    given = [" Partially Correct", "CORRECT", "other", None, "1"]
    assert values(lb.lenient_label, given) == [1, 2, None, None, None]
    assert values(lambda x: lb.lenient_label(x, -1), given) == [1, 2, -1, -1, -1]
    assert values(lambda x: lb.lenient_label(x, 0), given) == [1, 2, 0, 0, 0]


def test_lenient_label_truncates_numbers(values):
    assert values(lambda x: lb.lenient_label(x, -1, numeric=True), [0.9, 2.0, None, -0.5], "double") == [
        0, 2, -1, 0,
    ]


def test_label_source_prefers_label_that_says_something(spark):
    df = spark.createDataFrame(
        [("1", "0"), ("", "2"), (None, "partial"), ("0", "1")], "label string, labels string"
    )
    assert [r[0] for r in df.select(lb.label_source(df)).collect()] == ["1", "2", "partial", "1"]
    assert df.drop("label").select(lb.label_source(df.drop("label"))).first()[0] == "0"


def test_points_and_topics(values):
    assert values(lb.points_label, ["0", "0.50", "1.0"]) == [0, 1, 2]
    assert values(lb.topic_of_task, ["sentences_a", "validity_and_soundness_h"]) == [
        "sentences", "validity",
    ]


@pytest.mark.parametrize(
    "function, bad",
    [(lb.points_label, "0.25"), (lb.points_label, None), (lb.topic_of_task, "arguments_a"),
     (lb.topic_of_task, None), (lb.collapse_five_way, "maybe")],
)
def test_unknown_values_raise(values, function, bad):
    with pytest.raises(PySparkException):
        values(function, [bad])


def test_argmax_takes_the_first(values):
    assert values(lb.argmax, [[0.1, 0.7, 0.7], [3.0, 1.0, 2.0]], "array<double>") == [1, 0]
    nested = values(lambda x: lb.argmax(x, nested=True), [[[0.1, 0.7], [9.0]], []], "array<array<double>>")
    assert nested == [1, None]
