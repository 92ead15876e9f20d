"""A table of a model's replies, keyed by what was asked: nothing is asked twice, across rows, runs and retries.

The key is a digest of the model's name and of everything it is shown. Equal inputs of one table are asked once; what
the table of replies has from earlier runs is not asked at all. The rest is dealt out to tasks of at most
`calls_per_task` calls, and every task's replies become part of the table when the task commits, not when the job
does (the file committer's second algorithm). If a job dies half way, what its finished tasks asked is there for the
next run, and a retried task asks at most its own `calls_per_task` inputs again. Spark lets one attempt of a task
commit, so a reply is stored once even if tasks run twice.

Replies are short next to what they cost. The table is read and joined by key; the inputs' texts do not move for that.
"""

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerloom.session import settle

KEY = "_reply_key"


@dataclass(frozen=True)
class ReplyStore:
    """Where replies of a model are kept. `model` names it with all that changes its replies (prompt, temperature, run).

    With `retry_errors`, inputs whose stored reply is an error are asked again.
    """

    path: str
    model: str
    calls_per_task: int = 64
    retry_errors: bool = True

    def of_run(self, run) -> "ReplyStore":
        """The same table for one of several runs, which all ask for themselves."""
        return replace(self, model=f"{self.model} run {run}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _stored(spark: SparkSession, store: ReplyStore, schema: str) -> DataFrame:
    """(key, the reply's columns, error), one row per key, replies before errors."""
    if not _exists(spark, store.path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(store.path)
    names = [c for c in rows.columns if c != KEY]
    best = F.min_by(F.struct(*names), F.struct(F.col("error").isNotNull(), F.xxhash64(*names)))
    return rows.groupBy(KEY).agg(best.alias("_reply")).select(KEY, "_reply.*")


def answered(
    df: DataFrame, store: ReplyStore, shown: dict[str, Column], call: Callable[[DataFrame], DataFrame],
    reply: dict[str, str], told_apart: tuple[str, ...] = (),
) -> DataFrame:
    """df with the columns `reply` (name to type) and error from the store, which is filled where it lacks them.

    `shown` are the model's arguments. `call(inputs)` adds the reply's columns and error to a table of arguments.
    Columns in `told_apart` are part of the key without being shown, where equal inputs are to get replies of their own.
    """
    spark = df.sparkSession
    schema = ", ".join([f"{KEY} string", *[f"{c} {t}" for c, t in reply.items()], "error string"])
    asked = F.struct(F.lit(store.model).alias("_model"), *[c.alias(n) for n, c in shown.items()], *told_apart)
    keyed = df.withColumn(KEY, F.sha2(F.to_json(asked, {"ignoreNullFields": "false"}), 256))
    distinct = keyed.groupBy(KEY).agg(F.first(F.struct(*[c.alias(n) for n, c in shown.items()])).alias("_shown"))
    known = _stored(spark, store, schema)
    if store.retry_errors:
        known = known.filter("error IS NULL")
    new = settle(distinct.join(known.select(KEY), KEY, "left_anti").select(KEY, "_shown.*"), "asked")
    calls = new.count()
    if calls:
        tasks = -(-calls // store.calls_per_task)
        replies = call(new.repartition(tasks, KEY)).select(KEY, *reply, "error")
        replies.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store.path)
    return keyed.join(_stored(spark, store, schema), KEY, "left").drop(KEY)
