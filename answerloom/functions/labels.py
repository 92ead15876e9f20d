"""Label normalisation."""

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import fixed_values as fv
from answerloom.functions.basics import case_map, fail, strip, to_double


def label_source(df: DataFrame) -> Column:
    """The raw label column: `label` where it says something, else `labels`."""
    if "label" not in df.columns:
        return F.col("labels")
    if "labels" not in df.columns:
        return F.col("label")
    label = F.col("label").cast("string")
    says_nothing = label.isNull() | (label == "") | F.coalesce(
        label.try_cast("double") == 0, F.lit(False)
    )
    return F.when(says_nothing, F.col("labels").cast("string")).otherwise(label)


def try_strict_label(raw: Column) -> Column:
    """Class code of a number or class name; NULL where it is neither."""
    text = raw.cast("string")
    number = to_double(text)
    name = F.lower(strip(text))
    names = {n: c for c, n in enumerate(fv.LABEL_NAMES)}
    return F.when(number.isin(0.0, 1.0, 2.0), number.cast("int")).otherwise(
        case_map(name, names)
    )


def strict_label(raw: Column) -> Column:
    """Class code of a number or class name; anything else is an error."""
    return F.coalesce(
        try_strict_label(raw), fail("no label class for value: ", raw).cast("int")
    )


def lenient_label(raw: Column, default: int | None = None, numeric: bool = False) -> Column:
    """Class code by name; numbers are truncated; unknown values get `default`.

    The two defaults in use are -1 (batch grading) and 0 (row grading); NULL
    keeps "unknown" visible and is the recommended choice.
    """
    code = raw.cast("int") if numeric else case_map(F.lower(strip(raw)), fv.LENIENT_LABELS)
    return code if default is None else F.coalesce(code, F.lit(default))


def collapse_five_way(raw: Column) -> Column:
    """Five-way corpus label to class code; an unknown name is an error."""
    return case_map(raw, fv.FIVE_WAY_LABELS, default=fail("unknown corpus label: ", raw).cast("int"))


def try_points_label(points: Column) -> Column:
    return case_map(points.cast("double"), fv.POINT_LABELS)


def points_label(points: Column) -> Column:
    """0, 0.5 or 1 point to class code; other point values are an error."""
    return F.coalesce(
        try_points_label(points), fail("unexpected points value: ", points).cast("int")
    )


def try_topic_of_task(task: Column) -> Column:
    chain = None
    for prefix, topic in fv.QUIZ_TOPICS.items():
        hit = task.startswith(prefix)
        chain = F.when(hit, topic) if chain is None else chain.when(hit, topic)
    return chain


def topic_of_task(task: Column) -> Column:
    """Topic from the task name's prefix; an unknown prefix is an error."""
    return F.coalesce(try_topic_of_task(task), fail("unknown task prefix: ", task))


def label_name(code: Column) -> Column:
    return case_map(code, dict(enumerate(fv.LABEL_NAMES)))


def argmax(values: Column, nested: bool = False) -> Column:
    """Zero-based position of the largest element; the first one wins.

    With `nested` the values are those of the first of several arrays.
    """
    if nested:
        values = F.try_element_at(values, F.lit(1))
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
