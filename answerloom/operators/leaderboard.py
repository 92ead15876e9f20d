"""Run statistics, normalisation, rankings and experiment matrices."""

from pyspark.sql import Column, DataFrame, functions as F

from answerloom.functions.basics import ratio_or_zero
from answerloom.functions.naming import model_display, model_group, model_order


def group_stats(df: DataFrame, keys, value: str, name: str | None = None) -> DataFrame:
    """Mean and sample deviation per group; a single row deviates by 0."""
    name = name or value
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"mean_{name}"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"std_{name}"),
        F.count(value).alias(f"n_{name}"),
    )


def drop_incomplete(df: DataFrame, columns) -> DataFrame:
    """Drop rows where any of the columns is NULL or NaN."""
    return df.dropna(subset=list(columns))


def column_ranges(df: DataFrame, columns) -> DataFrame:
    """One row (column, min, max) per column, all from one pass."""
    bounds = df.agg(
        *[F.min(c).alias(f"min_{c}") for c in columns],
        *[F.max(c).alias(f"max_{c}") for c in columns],
    )
    return bounds.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"min_{c}").cast("double").alias("min"),
                        F.col(f"max_{c}").cast("double").alias("max"),
                    )
                    for c in columns
                ]
            )
        )
    )


def normalize(df: DataFrame, columns) -> DataFrame:
    """Add <column>_norm in [0, 1]; a constant column becomes 0.5.

    The bounds of all columns are one row of one aggregate, read as a scalar
    subquery: no join and no window over the whole table.
    """
    bounds = (
        df.agg(
            *[F.min(c).alias(f"lo_{c}") for c in columns],
            *[F.max(c).alias(f"hi_{c}") for c in columns],
        )
        .select(F.struct("*").alias("b"))
        .scalar()
    )
    scaled = {}
    for c in columns:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        scaled[f"{c}_norm"] = F.when(hi == lo, F.lit(0.5)).otherwise(
            (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))
        )
    return df.withColumns(scaled)


def ranked(df: DataFrame, metric: str, ties) -> DataFrame:
    """Best first; ties by the given columns."""
    return df.orderBy(F.desc_nulls_last(metric), *ties)


def model_leaderboard(runs: DataFrame, run: str, metric: str, name: str = "kappa") -> DataFrame:
    """Mean and deviation per model group, with display name and order.

    Names are derived after the aggregation, on one row per model group.
    """
    stats = group_stats(
        drop_incomplete(runs, [metric]).withColumn("model_group", model_group(F.col(run))),
        ["model_group"], metric, name,
    )
    group = F.col("model_group")
    return stats.select(
        group,
        f"mean_{name}",
        f"std_{name}",
        model_display(group).alias("model_display"),
        model_order(group).alias("display_order"),
    ).orderBy("display_order", "model_group")


def metric_or_fallback(metric: str, columns) -> Column:
    """eval_<metric>, else <metric>, else the detailed one, else eval_loss."""
    order = [f"eval_{metric}", metric, f"detailed_{metric}", "eval_loss"]
    return F.coalesce(*[F.col(c) for c in order if c in columns])


def best_runs(
    df: DataFrame, keys, metric: str, index: str, minimize: bool = False
) -> DataFrame:
    """The best row of each group; among equals the lowest index.

    An aggregate, not a window: partial maxima are taken before the shuffle,
    so a group of any size ends in one row per input partition. `minimize`
    is for metrics where less is better, such as a loss.
    """
    value = F.col(metric).cast("double")
    score = -value if minimize else value
    rest = [c for c in df.columns if c not in keys]
    best = F.max(
        F.struct(score.alias("score"), (-F.col(index)).alias("first"), F.struct(*rest).alias("row"))
    )
    scored = df.filter(value.isNotNull() & ~F.isnan(value))
    return scored.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.row.*")


def param_grid(models: DataFrame, grid: dict) -> DataFrame:
    """Every combination of the listed values for each input row.

    Combinations are exploded from constant arrays; `combination_idx` counts
    them from 1, the last parameter running fastest.
    """
    names = list(grid)
    out = models
    index = F.lit(0)
    for name in names:
        values = F.array(*[F.lit(x) for x in grid[name]])
        out = out.select("*", F.posexplode(values).alias(f"_{name}", name))
        index = index * len(grid[name]) + F.col(f"_{name}")
    return out.withColumn("combination_idx", index + 1).drop(*[f"_{n}" for n in names])


def run_matrix(models: DataFrame, seeds, overrides: DataFrame, defaults: dict) -> DataFrame:
    """Models x seeds, with each model's own parameters over the defaults."""
    runs = models.select(
        "*", F.posexplode(F.array(*[F.lit(s) for s in seeds])).alias("seed_idx", "seed")
    )
    own = [F.col(p).alias(f"_{p}") for p in defaults]
    joined = runs.join(overrides.select("model", *own), "model", "left")
    return joined.select(
        *runs.columns,
        *[F.coalesce(F.col(f"_{p}"), F.lit(x)).alias(p) for p, x in defaults.items()],
    )


def throughput(log: DataFrame, keys, examples: str, seconds: str) -> DataFrame:
    """Examples per minute and mean seconds per example, from a run log."""
    totals = log.groupBy(*keys).agg(
        F.sum(examples).alias("num_examples"), F.sum(seconds).alias("total_eval_time_seconds")
    )
    return totals.select(
        *keys,
        "num_examples",
        "total_eval_time_seconds",
        (ratio_or_zero(F.col("num_examples"), F.col("total_eval_time_seconds")) * 60).alias(
            "examples_per_minute"
        ),
        ratio_or_zero(F.col("total_eval_time_seconds"), F.col("num_examples")).alias(
            "avg_time_per_example_seconds"
        ),
    )
