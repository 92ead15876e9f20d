"""Generate answers for tasks, validate their number, write them."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from answerloom.operators import generation as gn
from answerloom.sources import writers


def generate_answers(
    tasks: DataFrame, quotas: dict, make_generator: Callable, mode: str, path: str,
    fail_on_violation: bool = True, **options,
) -> dict:
    """Answers, rejects and count violations; the generator runs once.

    Generated rows are written first and everything else reads them back.
    """
    spark = tasks.sparkSession
    writers.to_parquet(gn.generate(tasks, quotas, make_generator, mode, **options), path, "overwrite")
    written = spark.read.parquet(path)
    answers = gn.accepted(written)
    violations = gn.count_violations(answers, tasks, quotas)
    if fail_on_violation:
        first = violations.limit(1).collect()
        if first:
            v = first[0]
            raise ValueError(
                f"task {v.task_id}: {v.actual} {v.label!r} answers instead of {v.expected}"
            )
    return {
        "answers": answers,
        "rejects": gn.rejected(written),
        "violations": violations,
        "totals": gn.label_totals(answers, tasks, quotas),
    }
