"""Grid searches and their leaderboards, as whole jobs."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from answerloom.functions.text import dirty_number
from answerloom.operators import leaderboard as ld, training as tr
from answerloom.operators.sampling import exact_sample
from answerloom.session import settle
from answerloom.sources import readers, writers


def search(
    train_rows: DataFrame, val_rows: DataFrame, regularization, iterations, seeds, fraction: float,
    key: str, path: str, features: int = 1 << 14, metric: str = "macro_f1",
) -> dict:
    """Fit every combination for every seed, keep the rows, choose the best.

    Each seed trains on its own sample of `fraction` of the rows and is compared on the same
    validation rows. `path` gets one row per seed and combination, partitioned by
    seed, so a search can be taken up again. Returns `rows`, `best_per_seed` and `best`.
    """
    spark = train_rows.sparkSession
    base = tr.pipeline(features=features)
    grid = tr.param_grid(base, regularization, iterations)
    for seed in seeds:
        sample = exact_sample(train_rows, fraction, key, seed)
        results, _ = tr.grid_search(sample, val_rows, grid, base, metric)
        writers.to_parquet(
            results.select("combination_idx", "params", "metric_value", "support"), f"{path}/seed={seed}", "overwrite"
        )
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/seed={seed}" for seed in seeds])
    per_seed = ld.best_runs(rows, ["seed"], "metric_value", "combination_idx")
    return {
        "rows": rows,
        "best_per_seed": per_seed,
        "best": ld.best_runs(per_seed, [], "metric_value", "seed"),
    }


def leaderboard(spark: SparkSession, path, parameters, metric: str, run: str = "Run") -> DataFrame:
    """A comma CSV of runs, cleaned, complete, normalised, best first.

    Numbers may carry stray characters, as hand-kept tables do; rows without a number for the
    metric or a parameter are left out.
    """
    columns = [*parameters, metric]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (run, *columns)])
    rows = readers.comma_csv(spark, path, schema)
    numbers = rows.select(run, *[dirty_number(F.col(c)).alias(c) for c in columns])
    # Bounds, sort ranges and sort each read them: the text is parsed once.
    complete = settle(ld.drop_incomplete(numbers, columns), "grid-numbers")
    return ld.ranked(ld.normalize(complete, columns), metric, [run])
