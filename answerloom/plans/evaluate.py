"""Evaluate a grader: read answers, grade, measure, keep the metrics."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from answerloom import fixed_values as fv
from answerloom.functions.labels import label_source, lenient_label, strict_label
from answerloom.operators import metrics as mt
from answerloom.operators.confusion import cells, confusion_matrix
from answerloom.operators.leaderboard import group_stats
from answerloom.operators.replies import ReplyStore
from answerloom.operators.sampling import exact_sample
from answerloom.operators.scoring import score
from answerloom.session import scratch_path
from answerloom.sources import writers


def grade_and_measure(
    answers: DataFrame,
    make_predictor: Callable,
    run_id: str,
    metrics_path: str,
    mode: str = "single",
    pass_reference: bool = True,
    lenient: bool = True,
    sample_fraction: float = 1.0,
    sample_seed: int = fv.SEED,
    predictions_path: str | None = None,
    question_limit: int | None = None,
    params: dict | None = None,
    params_path: str | None = None,
    params_left_out=(),
    confusion_path: str | None = None,
    store: ReplyStore | None = None,
) -> DataFrame:
    """Grade answers, write predictions and metrics, return the metric rows.

    Predictions are written before they are measured, so the grader is called
    once per answer even though several tables are made from them. The mode
    per_question needs `question_limit`, the answers a call may see. The run's
    parameters and its confusion matrix are stored where paths are given for
    them. With a `store`, only inputs it has no reply for reach the grader.
    """
    spark = answers.sparkSession
    raw = label_source(answers)
    numeric = not _is_text(answers, raw)
    truth = lenient_label(raw, numeric=numeric) if lenient else strict_label(raw)
    sampled = exact_sample(answers.withColumn("y_true", truth), sample_fraction, "row_id", sample_seed)
    options = {"pass_reference": pass_reference, "store": store}
    if mode == "per_question":
        if question_limit is None:
            raise ValueError("the mode per_question needs question_limit")
        options |= {"carry": ("topic", "y_true"), "limit": question_limit}
        if "row_no" not in sampled.columns:
            sampled = sampled.withColumn("row_no", F.col("row_id"))
    predictions_path = predictions_path or scratch_path(spark, "predictions")
    writers.to_parquet(score(sampled, make_predictor, mode, **options), predictions_path, "overwrite")
    predictions = spark.read.parquet(predictions_path)
    report = mt.long_report(predictions).unionByName(
        mt.random_macro_f1(predictions, "row_id").select(
            F.lit("overall").alias("scope"), F.lit("overall").alias("key"),
            F.lit("macro_f1_random").alias("metric"), F.col("macro_f1_random").alias("value"),
        )
    )
    writers.metrics(writers.with_run(report, run_id), metrics_path)
    if params_path:
        writers.params(spark, run_id, params or {}, params_path, params_left_out)
    if confusion_path:
        writers.by_run(confusion_matrix(cells(predictions)), run_id, confusion_path)
    return spark.read.parquet(metrics_path).filter(F.col("run_id") == run_id)


def measure_models(predictions: DataFrame, key: str = "model") -> DataFrame:
    """Overall metrics of several models over the same answers, from one pass."""
    return mt.summary(cells(predictions, [key]), [key])


def grade_repeatedly(
    answers: DataFrame, make_predictor: Callable, runs: int, predictions_path: str,
    metric: str = "quadratic_weighted_kappa", mode: str = "single", store: ReplyStore | None = None,
    run_id: str = "run", metrics_path: str | None = None, confusion_path: str | None = None, **options,
) -> dict:
    """Grade every answer once per run, in either mode; mean and deviation of a metric over the runs.

    Returns `statistics` and `failed` (run, error). A run that fails is left out and
    reported; the others go on. `answers` must have y_true. All metrics and the confusion matrix of each run
    are stored as run `run_id`-1, -2, ... where paths are given for them. With a `store`, each run asks for itself, and
    a run taken up again asks only what it had not asked.
    """
    spark, done, failed = answers.sparkSession, [], []
    if mode == "per_question":
        options["carry"] = tuple({*options.get("carry", ()), "y_true"})
        if "row_no" not in answers.columns:
            answers = answers.withColumn("row_no", F.col("row_id"))
    for run in range(1, runs + 1):
        path = f"{predictions_path}/run={run}"
        try:
            own = options | {"store": store and store.of_run(run)}
            writers.to_parquet(score(answers, make_predictor, mode, **own), path, "overwrite")
            done.append(path)
        except Exception as error:
            failed.append((run, f"{type(error).__name__}: {error}"))
    report = spark.createDataFrame(failed, "run int, error string")
    if not done:
        raise RuntimeError(f"all {runs} runs failed; the first: {failed[0][1]}")
    written = spark.read.option("basePath", predictions_path).parquet(*done)
    for path in done:
        run, predictions = path.rsplit("=", 1)[1], spark.read.parquet(path)
        if metrics_path:
            writers.metrics(writers.with_run(mt.long_report(predictions), f"{run_id}-{run}"), metrics_path)
        if confusion_path:
            writers.by_run(confusion_matrix(cells(predictions)), f"{run_id}-{run}", confusion_path)
    return {"statistics": group_stats(mt.summary(cells(written, ["run"]), ["run"]), [], metric), "failed": report}


def _is_text(df: DataFrame, column: Column) -> bool:
    return df.select(column.alias("x")).schema["x"].dataType == StringType()
