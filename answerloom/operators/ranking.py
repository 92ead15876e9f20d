"""Exact ranks without putting a whole group, or the whole table, in one task."""

from pyspark.sql import DataFrame, Window, functions as F

from answerloom.session import settle

_PLACE_BITS = 33

#: So many bucket sizes one task may add up, short rows in one pass; more are added up in two levels. The sums are the same.
FEW_BUCKETS = 1_000_000


def _offsets(sizes: DataFrame, size: str | None) -> DataFrame:
    """(_group, _bucket, _offset, and the group's total as `size`) from _size of few buckets per group."""
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "_group", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_size").over(whole).alias(size)] if size else []),
    )


def prefix_sums(sizes: DataFrame, size: str | None) -> DataFrame:
    """`_offsets` for any number of buckets per group, in two levels.

    Bucket sizes are range-partitioned by group and bucket and written once. Each range is summed
    up, the sums of a group's ranges (one row per range) give each range its offset, and every range adds its
    own buckets to it. A group with millions of buckets passes through as many tasks as it has ranges.
    """
    ranged = settle(
        sizes.repartitionByRange("_group", "_bucket").withColumn("_range", F.spark_partition_id()), "bucket-ranges"
    )
    ranges = ranged.groupBy("_group", F.col("_range").alias("_bucket")).agg(F.sum("_size").alias("_size"))
    moved = _offsets(ranges, size).withColumnsRenamed({"_bucket": "_range", "_offset": "_before"})
    inside = Window.partitionBy("_group", "_range").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return own.join(moved, ["_group", "_range"]).select(
        "_group", "_bucket", (F.col("_before") + F.col("_inside")).alias("_offset"), *([size] if size else [])
    )


def _ranked_in_buckets(
    df: DataFrame, bucketed: DataFrame, order, name: str, size: str | None, many: bool = False
) -> DataFrame:
    """Ranks from rows with _group and _bucket: places inside buckets, moved by the sizes of those before.

    `many`: the number of buckets of a group grows with its rows.
    """
    sizes = bucketed.groupBy("_group", "_bucket").agg(F.count("*").alias("_size"))
    if many:
        sizes = settle(sizes, "bucket-sizes")
        many = sizes.count() > FEW_BUCKETS
    offsets = prefix_sums(sizes, size) if many else _offsets(sizes, size)
    inside = Window.partitionBy("_group", "_bucket").orderBy(*order)
    placed = bucketed.withColumn("_place", F.row_number().over(inside))
    return placed.join(offsets, ["_group", "_bucket"]).select(
        *df.columns, (F.col("_offset") + F.col("_place")).alias(name), *([size] if size else [])
    )


def hash_rank(
    df: DataFrame, keys, hashed: str, ties, name="rank", digits: int = 3, before=(), size: str | None = None
) -> DataFrame:
    """Rank from 1 within each key group in the order of the columns `before`, then of a hex hash column.

    The leading hex digits cut what is equal in `before` into 16**digits even
    buckets. Rows are ranked inside a bucket, and bucket sizes, added up in
    order, give each bucket its offset. A group that holds most of the table
    is therefore ranked by many tasks. Without `before` a group has 16**digits buckets
    at most, with it any number, and sizes are added up in two levels (`prefix_sums`). `size` names a column for the
    number of rows of the group, which comes from the same sums.
    """
    # One value per group, never NULL, so that groups with NULL keys join too.
    group = F.struct(*keys) if keys else F.lit(0)
    head = F.substring(hashed, 1, digits)
    bucketed = df.withColumns({"_group": group, "_bucket": F.struct(*before, head.alias("_head")) if before else head})
    return _ranked_in_buckets(df, bucketed, [*before, hashed, *ties], name, size, many=bool(before))


def grouped_rank(df: DataFrame, key: str, order, name="rank", size: str | None = None) -> DataFrame:
    """Rank from 1 within each key in sort order, for keys with any number of rows.

    The table is range-partitioned by key and order and written once. A key
    that fills several ranges is ranked in each, and the ranges before it are
    added.
    """
    ranged = settle(df.repartitionByRange(key, *order).withColumn("_bucket", F.spark_partition_id()), "ranged")
    return _ranked_in_buckets(df, ranged.withColumn("_group", F.struct(key)), list(order), name, size)


def sorted_rank(df: DataFrame, order, name="rank") -> DataFrame:
    """Rank from 1 over the whole table in sort order.

    The table is range-partitioned by the sort, its rows are numbered inside
    their partition and written once, so that they stay where they are, and
    every partition continues where the previous one ended. The counts are
    one row per partition.
    """
    placed = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    place = F.col("_at") - F.shiftleft(F.col("_part"), _PLACE_BITS)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_offset") + place + 1).alias(name))
    )


def allocate_ids(existing: DataFrame, new: DataFrame, task="task", id_column="task_id") -> DataFrame:
    """(task, id) for every distinct new task but NULL, sorted, after the largest id in use.

    Only distinct tasks are ranked; answers never move.
    """
    numeric = F.col(id_column).try_cast("bigint")
    largest = existing.agg(F.coalesce(F.max(numeric), F.lit(0)).alias("m")).scalar()
    tasks = sorted_rank(new.select(task).filter(F.col(task).isNotNull()).distinct(), [task], "_rank")
    return tasks.select(task, (largest + F.col("_rank")).alias(id_column))
