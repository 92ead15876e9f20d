"""Counts of answers, questions and classes over topics and splits.

Zero-filled reports aggregate into one column per class or split and unfold
those columns afterwards, so no dimension product is joined.
"""

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import fixed_values as fv
from answerloom.functions.basics import ratio_or_zero, total

CODES = fv.CLASS_CODES


def _class_counts(label: str) -> list[Column]:
    return [F.count_if(F.col(label) == c).alias(f"n_{c}") for c in CODES]


def _per_class(counts: DataFrame, keys) -> DataFrame:
    rows = [
        F.struct(
            F.lit(c).alias("label"),
            F.lit(fv.LABEL_NAMES[c]).alias("label_name"),
            F.coalesce(f"n_{c}", F.lit(0).cast("bigint")).alias("n"),
        )
        for c in CODES
    ]
    return counts.select(*keys, F.inline(F.array(*rows)))


def topic_counts(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.groupBy(topic).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, keys=(), label: str = "y_true") -> DataFrame:
    """Rows per class for each key, 0 for classes that do not occur."""
    return _per_class(df.groupBy(*keys).agg(*_class_counts(label)), keys)


def task_label_counts(df: DataFrame, task="task_id", topic="topic", label="y_true") -> DataFrame:
    """One row per task: its topic and the number of answers per class.

    A task's topic is the smallest one it occurs with; `topic_conflict` tells
    where that hides another. Answers are counted per (task, topic) first: the
    smallest text is then sought among a task's few topics, where sorting
    costs nothing, and not among all its answers.
    """
    pairs = df.groupBy(task, topic).agg(*_class_counts(label))
    return pairs.groupBy(task).agg(
        F.min(topic).alias(topic),
        (F.min(topic) != F.max(topic)).alias("topic_conflict"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in CODES],
    )


def split_label_distribution(df: DataFrame, label: str = "y_true") -> DataFrame:
    """Answers and percentage per class in each of the three splits.

    Splits without rows appear with 0 and 0 percent.
    """
    wide = df.agg(
        *[
            F.count_if((F.col("split") == s) & (F.col(label) == c)).alias(f"{s}_{c}")
            for s in fv.SPLITS
            for c in CODES
        ]
    )
    rows = []
    for s in fv.SPLITS:
        size = total([F.col(f"{s}_{c}") for c in CODES])
        rows += [
            F.struct(
                F.lit(s).alias("split"),
                F.lit(fv.LABEL_NAMES[c]).alias("label_name"),
                F.col(f"{s}_{c}").alias("n"),
                (ratio_or_zero(F.col(f"{s}_{c}"), size) * 100).alias("percent"),
                size.alias("split_total"),
            )
            for c in CODES
        ]
    return wide.select(F.inline(F.array(*rows)))


def topic_split_distribution(df: DataFrame, label: str = "y_true") -> DataFrame:
    """Answers per class for every topic and split that has any."""
    names = {f"n_{c}": fv.LABEL_NAMES[c] for c in CODES}
    return (
        df.groupBy("topic", "split")
        .agg(*_class_counts(label), F.count("*").alias("total"))
        .withColumnsRenamed(names)
    )


def task_counts(df: DataFrame, keys=("split", "topic"), task="task_id", label="y_true") -> DataFrame:
    """Answers and answers per class of each task: what the statistics run on.

    Anything that has to be joined to tasks is best joined to these rows:
    answers of a hot task are then already added up.
    """
    return df.groupBy(*keys, task).agg(F.count("*").alias("answers"), *_class_counts(label))


def _statistics(task: str) -> list[Column]:
    return [
        F.count_distinct(task).alias("questions"),
        F.sum("answers").alias("answers"),
        F.sum("n_2").alias("correct_answers"),
        F.sum("n_1").alias("partially_correct_answers"),
        F.sum("n_0").alias("incorrect_answers"),
    ]


def split_statistics(df: DataFrame, task="task_id", label="y_true") -> DataFrame:
    """Questions, answers and answers per class by split and topic."""
    by_task = task_counts(df, task=task, label=label)
    return by_task.groupBy("split", "topic").agg(*_statistics(task))


def full_statistics(df: DataFrame, task="task_id", label="y_true") -> DataFrame:
    """`split_statistics` with totals per split, per topic and overall."""
    return cube_statistics(task_counts(df, task=task, label=label), task)


def cube_statistics(by_task: DataFrame, task="task_id") -> DataFrame:
    """Statistics at all four levels, from `task_counts`.

    Questions are counted anew at each level: a task that occurs twice counts once in a total. The rows of a task, one
    per split and topic, meet once; there each is marked as the first of its task, of its task and split, and so on, and
    questions become sums like the answers. So tasks are shuffled once and not once per level, and partial sums are
    one row per level and input partition.
    """
    values = ("answers", "n_2", "n_1", "n_0")
    rows = F.col("_rows")
    met = by_task.groupBy(task).agg(F.sort_array(F.collect_list(F.struct("split", "topic", *values))).alias("_rows"))

    def first(i, *keys):
        """Whether no earlier row of the task has the same keys."""
        def same(other):
            hit = F.lit(True)
            for k in keys:
                hit = hit & other[k].eqNullSafe(F.get(rows, i)[k])
            return hit

        return (~F.exists(F.slice(rows, F.lit(1), i), same)).cast("long") * F.col(task).isNotNull().cast("long")

    no_split, no_topic = (F.lit(None).cast(by_task.schema[c].dataType) for c in ("split", "topic"))

    def at_levels(r, i):
        split, topic = r["split"], r["topic"]
        levels = (
            ("SPLIT TOPIC", split, topic, first(i, "split", "topic")), ("TOTAL", split, no_topic, first(i, "split")),
            ("TOPIC TOTAL", no_split, topic, first(i, "topic")), ("GRAND TOTAL", no_split, no_topic, first(i)),
        )
        return F.array(*[
            F.struct(
                F.lit(level).alias("level"), s.alias("split"), t.alias("topic"), q.alias("questions"),
                *[r[v].alias(v) for v in values],
            )
            for level, s, t, q in levels
        ])

    spread = met.select(F.inline(F.flatten(F.transform(rows, at_levels))))
    return spread.groupBy("split", "topic", "level").agg(
        F.sum("questions").alias("questions"), F.sum("answers").alias("answers"),
        F.sum("n_2").alias("correct_answers"), F.sum("n_1").alias("partially_correct_answers"),
        F.sum("n_0").alias("incorrect_answers"),
    ).select(
        "split", "topic", "questions", "answers", "correct_answers", "partially_correct_answers", "incorrect_answers", "level"
    )


def zero_filled(stats: DataFrame, values, key="topic", split="split") -> DataFrame:
    """`stats` with a row for all three splits of every key, 0 where absent."""
    wide = stats.groupBy(key).agg(
        *[
            F.max(F.when(F.col(split) == s, F.col(x))).alias(f"{s}_{x}")
            for s in fv.SPLITS
            for x in values
        ]
    )
    zero = F.lit(0).cast("bigint")
    rows = [
        F.struct(
            F.lit(s).alias(split),
            *[F.coalesce(F.col(f"{s}_{x}"), zero).alias(x) for x in values],
        )
        for s in fv.SPLITS
    ]
    return wide.select(key, F.inline(F.array(*rows)))


def sizes(df: DataFrame, label="y_true") -> DataFrame:
    """Rows per split and class, per split, and in total (NULL keys)."""
    counts = df.groupBy("split", label).agg(F.count("*").alias("n"))
    return counts.rollup("split", label).agg(F.sum("n").alias("n"))
