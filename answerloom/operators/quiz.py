"""Cleaning and reshaping of the quiz export."""

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import fixed_values as fv
from answerloom.functions.labels import try_points_label, try_topic_of_task
from answerloom.functions.text import (
    clean_html, clean_remark, decimal_comma, find_loose, find_subtask, letter_marks, lettered,
    tidy_loose, tidy_subtask, unify_breaks,
)
from answerloom.operators.ranking import allocate_ids
from answerloom.operators.reshape import lettered_tasks, lookup, overlay, pivot_wide, sum_mismatches
from answerloom.session import settle

SUBTASKS = [f"{section}_{x}" for section, letters in fv.QUIZ_LETTERS.items() for x in letters]


def keep_group(name: Column) -> Column:
    """False for the quiz groups to leave out; other names and NULL are kept."""
    number = F.regexp_extract(name, fv.GROUP_NUMBER, 1)
    digits = F.regexp_replace(number, "^0+(?=.)", "")
    # Numbers too long for the cast are above every bound.
    value = F.when(F.length(digits) > 9, F.lit(10**9)).otherwise(digits.try_cast("int"))
    kept = (value < fv.GROUP_KEEP_BELOW) | (
        (value >= fv.GROUP_KEEP_FROM) & (value <= fv.GROUP_KEEP_UNTIL)
    )
    in_group = name.startswith(fv.GROUP_PREFIX) & (number != "")
    return F.coalesce(F.when(in_group, kept), F.lit(True))


def drop_header_rows(df: DataFrame, column: str = "task") -> DataFrame:
    """Drop header lines that were read as data."""
    return df.filter(F.col(column).isNull() | (F.col(column) != column))


def merge_export(raw: DataFrame, points: DataFrame, remarks: DataFrame) -> DataFrame:
    """Texts, points and remarks of a quiz, one row per participant.

    Texts and points are matched by participant. Decimal commas, HTML and
    entities are cleaned; a missing remark stays NULL.
    """
    who = fv.QUIZ_PARTICIPANT
    texts = raw.drop(*fv.QUIZ_UNUSED_COLUMNS).select(
        F.col(who).alias("participant"),
        *[unify_breaks(F.col(f"`{c}`")).alias(n) for c, n in fv.QUIZ_COLUMNS.items()],
    )
    scores = points.select(
        F.col(who).alias("participant"),
        *[decimal_comma(F.col(f"`{c}`")).alias(f"{n}_points") for c, n in fv.QUIZ_COLUMNS.items()],
    )
    wide_remarks = pivot_wide(
        remarks, "username", "task_id", "remark_html",
        {k: f"{n}_remarks" for k, n in fv.REMARK_TASKS.items()},
    )
    merged = lookup(texts.join(scores, "participant"), wide_remarks, "participant", "username")
    return merged.withColumns(
        {f"{n}_remarks": clean_remark(F.col(f"{n}_remarks")) for n in fv.REMARK_TASKS.values()}
    )


def _marked(df: DataFrame, marks=letter_marks) -> DataFrame:
    """df with the pieces of each section's text, which its subtasks are cut from; one scan per text."""
    cut = df.withColumns({f"_{section}": lettered(F.col(section)) for section in fv.QUIZ_LETTERS})
    return cut.withColumns({f"_{section}": marks(F.col(f"_{section}")) for section in fv.QUIZ_LETTERS}) if marks else cut


def _spread(df: DataFrame, columns, parts: dict, tidy) -> DataFrame:
    """The columns and the given text columns, tidied.

    The parts go through one array, so the tidying is compiled once and not
    once per column.
    """
    found = df.withColumn("_found", F.transform(F.array(*parts.values()), tidy))
    return found.select(
        *columns, *[F.col("_found")[i].alias(name) for i, name in enumerate(parts)]
    )


def subtask_columns(merged: DataFrame) -> DataFrame:
    """Add one column per subtask, cut loosely from the section texts."""
    parts = {
        f"{section}_{x}": find_loose(F.col(f"_{section}"), x)
        for section, letters in fv.QUIZ_LETTERS.items()
        for x in letters
    }
    return _spread(_marked(merged, None), merged.columns, parts, tidy_loose)


def strict_subtask_columns(merged: DataFrame) -> DataFrame:
    """Add one column per subtask, cut at free-standing letters in sequence."""
    parts = {
        f"{section}_{x}": find_subtask(F.col(f"_{section}"), x, section)
        for section, letters in fv.QUIZ_LETTERS.items()
        for x in letters
    }
    return _spread(_marked(merged), merged.columns, parts, tidy_subtask)


def default_points(participants: DataFrame) -> DataFrame:
    """(participant, section, subtask) for all subtasks of every participant."""
    rows = [
        F.struct(F.lit(section).alias("section"), F.lit(f"{section}_{x}").alias("subtask"))
        for section, letters in fv.QUIZ_LETTERS.items()
        for x in letters
    ]
    return participants.select("participant", F.inline(F.array(*rows)))


def subtask_points(participants: DataFrame, grades: DataFrame) -> DataFrame:
    """Points per participant and subtask: the grade, else a full point."""
    return overlay(
        default_points(participants), grades, ["participant", "subtask"], "points", 1.0
    )


def point_mismatches(points: DataFrame, merged: DataFrame) -> DataFrame:
    """Sections whose subtask points miss the recorded total."""
    totals = merged.select(
        "participant",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("section"), F.col(f"{n}_points").alias("total"))
                    for n in fv.QUIZ_LETTERS
                ]
            )
        ),
    )
    return sum_mismatches(points, totals, ["participant", "section"])


def ungraded(participants: DataFrame, grades: DataFrame) -> DataFrame:
    """Participants that the grades do not mention, and who get defaults."""
    return participants.select("participant").join(
        grades.select("participant"), "participant", "left_anti"
    )


def long_answers(
    merged: DataFrame, points: DataFrame, tasks: DataFrame, order, strip_prefix_first: bool = False
) -> DataFrame:
    """One row per participant and subtask, with answer, points and question.

    With `strip_prefix_first` boilerplate is removed while its line breaks are
    still there. By default it is not: it would be looked for in the extracted
    answers, which have no line breaks left for it to match. Missing points
    stay NULL.
    """
    texts = {section: clean_html(F.col(section)) for section in fv.QUIZ_LETTERS}
    if strip_prefix_first:
        for section in texts:
            for pattern in fv.BOILERPLATE:
                texts[section] = F.regexp_replace(texts[section], "(?iU)" + pattern, "")
    kept = merged.filter(keep_group(F.col("participant"))).select(
        "participant", *[text.alias(section) for section, text in texts.items()]
    )
    # Texts are cut before the tasks are unfolded, and each row takes its own slice.
    found = None
    for section, letters in fv.QUIZ_LETTERS.items():
        for x in letters:
            here = F.col("task") == f"{section}_{x}"
            part = find_subtask(F.col(f"_{section}"), x, section)
            found = F.when(here, part) if found is None else found.when(here, part)
    answers = _marked(kept).drop(*fv.QUIZ_LETTERS).withColumn("task", F.explode(F.array(*[F.lit(t) for t in SUBTASKS]))).select(
        "participant", "task", tidy_subtask(found).alias("student_answer")
    )
    graded = answers.join(
        points.select("participant", F.col("subtask").alias("task"), "points"),
        ["participant", "task"], "left",
    )
    # At most one row per letter of each section.
    questions = lettered_tasks(tasks, "task", order, fv.QUIZ_LETTERS).select(
        F.concat_ws("_", "task", "letter").alias("task"),
        "question",
        F.col("answer").alias("reference_answer"),
    )
    return graded.join(F.broadcast(questions), "task", "left").select(
        F.col("participant").alias("student"), "task", "points", "student_answer", "question",
        "reference_answer",
    )


def to_answers(quiz: DataFrame, existing: DataFrame) -> DataFrame:
    """Long quiz rows as answers, with new task ids.

    Rows that cannot be labelled, or have no task, carry a reject_reason
    instead of ending the job. The tasks are few and are settled, so their size is known when
    the rows are joined.
    """
    rows = drop_header_rows(quiz)
    ids = settle(allocate_ids(existing, rows), "task-ids").withColumnRenamed("task", "_task")
    label = try_points_label(F.col("points"))
    topic = try_topic_of_task(F.col("task"))
    reason = F.when(label.isNull(), "points").when(topic.isNull(), "task")
    return rows.join(ids, F.col("task") == F.col("_task"), "left").select(
        F.col("task_id").cast("string").alias("task_id"),
        "question",
        "reference_answer",
        topic.alias("topic"),
        "student_answer",
        label.cast("string").alias("labels"),
        reason.alias("reject_reason"),
    )

