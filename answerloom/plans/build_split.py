"""Build leakage-free splits of an answers table and check them."""

from pyspark.sql import DataFrame, functions as F

from answerloom import fixed_values as fv
from answerloom.functions.labels import label_source, strict_label
from answerloom.operators import distribution as ds, split as xs
from answerloom.sources import writers


def split_answers(answers: DataFrame, path: str, seed: int = fv.SEED, balanced: bool = True) -> dict:
    """Write the answers partitioned by split; return the report tables.

    The reports read the written table, so the assignment is computed once.
    """
    labelled = answers.withColumn("y_true", strict_label(label_source(answers)))
    assigned = xs.with_split(labelled, xs.split_by_task(labelled, seed, balanced))
    writers.by_split(assigned, path, "overwrite")
    written = answers.sparkSession.read.parquet(path)
    return {
        "label_distribution": ds.split_label_distribution(written),
        "topic_distribution": ds.topic_split_distribution(written),
        "statistics": ds.full_statistics(written),
        "overlaps": xs.split_overlaps(written),
        "topic_conflicts": ds.task_label_counts(written).filter(F.col("topic_conflict")),
    }
