"""Bring answer files into one keyed, labelled table, once."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerloom import schemas
from answerloom.functions.labels import label_source, strict_label
from answerloom.operators import distribution as ds
from answerloom.sources import readers, writers


def ingest(df: DataFrame, path: str) -> DataFrame:
    """Write rows as Parquet with a row_id and read them back.

    The numbers follow the order of the rows in their files. They depend on how
    the files were read, so they are given once, here, and are part of the
    table from then on.
    """
    numbered = df.withColumn("row_id", F.monotonically_increasing_id())
    writers.to_parquet(numbered, path)
    return df.sparkSession.read.parquet(path)


def load_splits(
    spark: SparkSession, path: str, train: str, val: str, test: str | None = None,
    multi_line: bool = True,
) -> dict:
    """Pre-split semicolon files as one table at `path`, with its counts.

    Labels become class codes; a label that is none ends the job. The test
    file may be left out.
    """
    def read(file):
        return readers.semicolon_csv(spark, file, schemas.ANSWERS, multi_line)

    rows = readers.splits(read, {"train": train, "val": val, "test": test})
    labelled = rows.withColumn("y_true", strict_label(label_source(rows)))
    answers = ingest(labelled, path)
    return {
        "answers": answers,
        "topic_counts": ds.topic_counts(answers),
        "sizes": ds.sizes(answers),
        "class_counts": ds.split_label_distribution(answers),
    }
