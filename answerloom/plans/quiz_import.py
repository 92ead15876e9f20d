"""From a quiz export and its grades to new rows of the answers table."""

from pyspark.sql import DataFrame, functions as F

from answerloom import fixed_values as fv
from answerloom.operators import quiz as qz, reshape as rs
from answerloom.session import settle
from answerloom.sources import writers


def import_quiz(
    raw: DataFrame, points: DataFrame, remarks: DataFrame, tasks: DataFrame, grades: DataFrame,
    order, strip_prefix_first: bool = False,
) -> dict:
    """All tables of the import, from texts to long answers, with its checks."""
    merged = qz.merge_export(raw, points, remarks)
    people = merged.select("participant")
    subtask_points = qz.subtask_points(people, grades)
    return {
        "merged": merged,
        "subtasks": qz.subtask_columns(merged),
        "points": subtask_points,
        "long": qz.long_answers(merged, subtask_points, tasks, order, strip_prefix_first),
        "key_mismatches": rs.key_mismatches(raw, points, fv.QUIZ_PARTICIPANT),
        "point_mismatches": qz.point_mismatches(subtask_points, merged),
        "ungraded": qz.ungraded(people, grades),
    }


def append_to_answers(
    long: DataFrame, existing: DataFrame, table_path: str, rejects_path: str, batch: str
) -> None:
    """Add labelled rows to the answers table, the others to the rejects, as one batch.

    Importing a batch again replaces it, under the same task ids if the other
    batches are as they were. `existing` are the answers so far.
    """
    if "batch" in existing.columns:
        existing = existing.filter(F.col("batch") != batch)
    rows = settle(qz.to_answers(long, existing), "quiz-answers")
    writers.batch(rows.filter(F.col("reject_reason").isNull()).drop("reject_reason"), batch, table_path)
    writers.batch(rows.filter(F.col("reject_reason").isNotNull()), batch, rejects_path)
