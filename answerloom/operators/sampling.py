"""Exact-size reproducible sampling and seeded shuffling."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom import fixed_values as fv
from answerloom.functions.hashing import order_hash
from answerloom.session import settle


def _cut_row(histogram: DataFrame, wanted: Column) -> DataFrame:
    """One row (bucket, left): where the wanted-th row lies, and how many rows of that bucket are needed.

    `histogram` has one row (b, n) per bucket, at most 65,536 of them, so it
    fits one array. `wanted` may refer to `total`, the number of rows.
    """
    start = F.struct(F.col("wanted").alias("left"), F.lit(None).cast("string").alias("bucket"))

    def step(state, bucket):
        return (
            F.when(state["bucket"].isNotNull(), state)
            .when(
                bucket["n"] >= state["left"],
                F.struct(state["left"].alias("left"), bucket["b"].alias("bucket")),
            )
            .otherwise(
                F.struct(
                    (state["left"] - bucket["n"]).alias("left"),
                    F.lit(None).cast("string").alias("bucket"),
                )
            )
        )

    buckets = F.array_sort(F.collect_list(F.struct("b", "n")))
    return (
        histogram.agg(buckets.alias("buckets"), F.sum("n").alias("total"))
        .select("buckets", wanted.cast("bigint").alias("wanted"))
        .select(F.aggregate("buckets", start, step).alias("cut"))
        .select("cut.*")
    )


def exact_sample(df: DataFrame, fraction: float, key: str, seed: int = fv.SEED) -> DataFrame:
    """int(rows * fraction) rows, the same ones on any partitioning.

    Rows are ordered by the seeded hash of their key, and the smallest hashes
    are kept. Counts per leading four hex digits show in which of 65,536
    buckets the last row to keep lies; that bucket alone is written and
    ranked. So the key column is read twice, and the table itself is filtered
    in place, without a shuffle. A key that repeats at the cut would
    make the size wrong and is an error.
    """
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"fraction must be between 0 and 1, got {fraction}")
    if fraction == 1.0:
        return df
    hashed = df.select(F.col(key).alias("k"), order_hash(F.col(key), seed).alias("h"))
    head = F.substring("h", 1, 4)
    histogram = hashed.groupBy(head.alias("b")).agg(F.count("*").alias("n"))
    target = F.floor(F.col("total") * F.lit(float(fraction)))
    cut = _cut_row(histogram, target).first()
    if cut.bucket is None or cut.left < 1:
        raise ValueError(f"sample fraction {fraction} leaves 0 rows")
    bucket = settle(hashed.filter(head == cut.bucket), "sample-cut")
    order = Window.orderBy("h", "k")
    last = (
        bucket.select(
            "h", "k", F.row_number().over(order).alias("place"),
            (F.lag("k").over(order).eqNullSafe(F.col("k")) | F.lead("k").over(order).eqNullSafe(F.col("k"))).alias("again"),
        )
        .filter(F.col("place") == cut.left)
        .first()
    )
    if last.again:
        raise ValueError(f"the key {key} repeats: {last.k!r}")
    edge = F.struct(F.lit(last.h).alias("h"), F.lit(last.k).cast(df.schema[key].dataType).alias("k"))
    return df.filter(F.struct(order_hash(F.col(key), seed).alias("h"), F.col(key).alias("k")) <= edge)


def seeded_order(df: DataFrame, key: str, seed: int = fv.SEED) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.orderBy(order_hash(F.col(key), seed), key)
