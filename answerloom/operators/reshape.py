"""Keyed joins and reshaping of quiz tables.

Rows are matched by key, never by position. Checks come as violation tables
that are empty when all is well.
"""

from pyspark.sql import DataFrame, Window, functions as F

from answerloom import fixed_values as fv


def key_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that are not exactly once in both tables, with their counts.

    Both sides are counted in one aggregate over their keys.
    """
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    return (
        sides.groupBy(key)
        .agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
        .filter("left_rows <> 1 OR right_rows <> 1")
    )


def unique(df: DataFrame, keys) -> DataFrame:
    """The rows of df; a key that is there twice is an error as soon as its row is used."""
    rest = [c for c in df.columns if c not in keys]
    named = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    row = F.when(
        F.count("*") > 1, F.raise_error(F.concat(F.lit(f"duplicate {', '.join(keys)}: "), named))
    ).otherwise(F.first(F.struct(*rest)))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def join_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two tables side by side, matched by a key; a key that one holds twice is an error.

    Both sides are grouped by the key first, which is the shuffle the join needs.
    """
    return unique(left, [key]).join(unique(right, [key]), key)


def lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on differently named keys, without the right key."""
    other = right.withColumnRenamed(right_key, "_lookup_key")
    return left.join(other, F.col(left_key) == F.col("_lookup_key"), "left").drop("_lookup_key")


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def pivot_wide(df: DataFrame, row: str, column: str, value: str, values: dict) -> DataFrame:
    """One row per `row`, one column per listed value of `column`.

    `values` maps each value to its output column; unlisted values are left
    out. Two entries for one cell are an error.
    """
    cells = []
    for given, name in values.items():
        here = F.col(column) == F.lit(given)
        cells.append(
            F.when(
                F.count_if(here) > 1,
                F.raise_error(F.concat(F.lit(f"duplicate {name} for "), F.col(row).cast("string"))),
            )
            .otherwise(F.max(F.when(here, F.col(value))))
            .alias(name)
        )
    return df.groupBy(row).agg(*cells)


def unpivot_long(df: DataFrame, keys, columns, name="task", value="value") -> DataFrame:
    """One row per key and listed column."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns]
    return df.select(*keys, F.inline(F.array(*pairs)))


def lettered_tasks(tasks: DataFrame, kind: str, order, letters: dict) -> DataFrame:
    """The n-th task of each kind paired with the n-th letter of the kind.

    Kinds are trimmed. At most as many rows per kind as it has letters come
    out, so the result is a small lookup table. Row numbers above that are
    cut off before the shuffle.
    """
    most = max(len(x) for x in letters.values())
    kinds = tasks.withColumn(kind, F.btrim(kind)).filter(F.col(kind).isin(*letters))
    numbered = kinds.withColumn(
        "_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    ).filter(F.col("_n") <= most)
    names = F.create_map(
        *[x for k, ls in letters.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in ls]))]
    )
    lettered = numbered.withColumn(
        "letter", F.try_element_at(F.element_at(names, F.col(kind)), F.col("_n"))
    )
    return lettered.filter(F.col("letter").isNotNull()).drop("_n")


def overlay(base: DataFrame, over: DataFrame, keys, value: str, default) -> DataFrame:
    """`base` with the value from `over` where there is one, else the default.

    Two values for one key are an error.
    """
    return base.join(unique(over.select(*keys, value), keys), keys, "left").withColumn(
        value, F.coalesce(value, F.lit(default))
    )


def sum_mismatches(
    points: DataFrame, totals: DataFrame, keys, tolerance: float = fv.POINTS_TOLERANCE
) -> DataFrame:
    """Keys whose points do not add up to the recorded total; missing points and totals are 0."""
    sums = points.groupBy(*keys).agg(F.sum(F.coalesce("points", F.lit(0.0))).alias("calculated"))
    recorded = F.coalesce("total", F.lit(0.0))
    return (
        sums.join(totals.select(*keys, "total"), keys, "left")
        .select(*keys, "calculated", recorded.alias("expected"))
        .filter(F.abs(F.col("calculated") - F.col("expected")) > tolerance)
    )
