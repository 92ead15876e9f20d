"""Writers. A rerun replaces its own output instead of adding to it."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def semicolon_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep=";", header=True, quote='"', escape='"')


def to_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def by_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per split, so that readers of one split skip the others."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table; the rows already there are neither read nor rewritten."""
    df.write.mode("append").parquet(path)


def metrics(df: DataFrame, path: str) -> None:
    """Long metric rows, partitioned by run.

    Only the partitions of the runs being written are replaced, so writing a
    run again leaves one copy of it and keeps all others.
    """
    df.select("run_id", "scope", "key", "metric", "value").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").parquet(path)


def batch(df: DataFrame, name: str, path: str) -> None:
    """Rows of one delivery, partitioned by batch: writing it again replaces it, others stay."""
    df.withColumn("batch", F.lit(name)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(path)


def by_run(df: DataFrame, run_id: str, path: str) -> None:
    """Rows of one run, partitioned by run: writing it again replaces it, others stay."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").parquet(path)


def params(spark: SparkSession, run_id: str, values: dict, path: str, leave_out) -> None:
    """Parameters of a run, as rows next to its metrics; dotted keys, text values.

    Keys that contain one of the texts of `leave_out` are left out.
    """
    flat = {}

    def walk(prefix, node):
        for name, value in node.items():
            key = f"{prefix}.{name}" if prefix else name
            if isinstance(value, dict):
                walk(key, value)
            elif not any(part in key for part in leave_out):
                flat[key] = str(value)

    walk("", values)
    rows = [(run_id, k, x) for k, x in sorted(flat.items())]
    df = spark.createDataFrame(rows, "run_id string, param string, value string")
    by_run(df.drop("run_id"), run_id, path)


def with_run(metrics_long: DataFrame, run_id: str) -> DataFrame:
    return metrics_long.withColumn("run_id", F.lit(run_id))
