"""Session helpers for local runs, and the shared scratch folder."""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "answerloom", shared: str | None = None) -> SparkSession:
    """A session for tests and the bench; clusters bring their own.

    `shared` is the folder for intermediate tables, spark.checkpoint.dir.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares, as named in spark.checkpoint.dir.

    Where none is named, a folder in the warehouse, which a cluster shares too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/answerloom_scratch"
    return folder.rstrip("/")


# Scratch folders of each session, by application id.
_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, known to `clear_scratch`."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this session put under scratch paths; call it once results are stored.

    Returns how many paths it deleted. DataFrames that read them fail afterwards.
    """
    jvm, gone = spark.sparkContext._jvm, 0
    for path in _written.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        gone += place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return gone


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """The same rows, computed once: written to the shared folder and read back.

    For tables that are small next to their input and are used several times.
    Their size is known from then on, so Spark broadcasts them in joins only
    if they are below its limit, and shuffles them otherwise.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
