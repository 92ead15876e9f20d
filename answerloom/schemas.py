"""Declared schemas of the tables this package reads and writes."""

from pyspark.sql import types as T

TEXT = T.StringType()


def _text_table(*names):
    return T.StructType([T.StructField(n, TEXT) for n in names])


ANSWERS = _text_table(
    "task_id", "question", "reference_answer", "topic", "student_answer", "labels"
)

TASKS = _text_table("question", "reference_answer", "topic")

TASK_JSON = T.StructType(
    [
        T.StructField("question", TEXT),
        T.StructField(
            "answer_options",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("answer", TEXT),
                        # Text, since marks may also be numbers or words.
                        T.StructField("is_correct", TEXT),
                    ]
                )
            ),
        ),
    ]
)

GRADES = T.MapType(TEXT, T.MapType(TEXT, T.DoubleType()))

QUIZ_LONG = T.StructType(
    [
        T.StructField("student", TEXT),
        T.StructField("task", TEXT),
        T.StructField("points", TEXT),
        T.StructField("student_answer", TEXT),
        T.StructField("question", TEXT),
        T.StructField("reference_answer", TEXT),
    ]
)

REMARKS = T.StructType(
    [
        T.StructField("username", TEXT),
        T.StructField("task_id", T.IntegerType()),
        T.StructField("remark_html", TEXT),
    ]
)

QUIZ_TASKS = _text_table("task", "question", "answer")

METRICS = T.StructType(
    [
        T.StructField("run_id", TEXT),
        T.StructField("scope", TEXT),
        T.StructField("key", TEXT),
        T.StructField("metric", TEXT),
        T.StructField("value", T.DoubleType()),
    ]
)
