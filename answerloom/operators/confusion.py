"""Confusion counts: the one aggregate that every metric is derived from.

`cells` reads the predictions once and leaves one short row per key. Partial
aggregation shrinks each input partition to that size before the shuffle, so
a key that holds most of the rows costs no more than any other.
"""

from pyspark.sql import DataFrame, functions as F

from answerloom import fixed_values as fv

CODES = fv.CLASS_CODES


def cell(t: int, p: int) -> str:
    return f"n_{t}{p}"


def unscored(t: int) -> str:
    return f"unscored_{t}"


CELL_COLUMNS = [cell(t, p) for t in CODES for p in CODES]
COUNT_COLUMNS = CELL_COLUMNS + [unscored(t) for t in CODES] + ["no_truth"]


def cells(df: DataFrame, keys=(), y_true="y_true", y_pred="y_pred") -> DataFrame:
    """One row per key: the 3x3 counts, unscored rows per true class, no_truth.

    A prediction that is NULL or no class code leaves its row unscored. A row
    without a valid true class is only counted in `no_truth`.
    """
    codes = ", ".join(map(str, CODES))
    scored = f"coalesce(`{y_pred}` IN ({codes}), false)"
    counts = {
        cell(t, p): f"`{y_true}` = {t} AND `{y_pred}` = {p}" for t in CODES for p in CODES
    }
    counts |= {unscored(t): f"`{y_true}` = {t} AND NOT {scored}" for t in CODES}
    counts["no_truth"] = f"NOT coalesce(`{y_true}` IN ({codes}), false)"
    return df.groupBy(*keys).agg(
        *[F.expr(f"count_if({condition}) AS {name}") for name, condition in counts.items()]
    )


def merge_cells(counts: DataFrame, keys=()) -> DataFrame:
    """Add up cell rows: to coarser keys, or over increments."""
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNT_COLUMNS])


def with_overall(counts: DataFrame, key: str, extra=()) -> DataFrame:
    """The given rows (scope = the key's name) and their sum (scope overall)."""
    columns = [*COUNT_COLUMNS, *extra]
    levels = counts.rollup(key).agg(
        F.grouping(key).alias("is_total"), *[F.sum(c).alias(c) for c in columns]
    )
    return levels.selectExpr(
        f"if(is_total = 1, 'overall', '{key}') AS scope",
        f"if(is_total = 1, 'overall', CAST(`{key}` AS STRING)) AS key",
        *columns,
    )


def with_marginals(counts: DataFrame) -> DataFrame:
    """Add per class `support_c` (true rows, scored or not), `predicted_c`,
    and the numbers of all rows and of scored rows."""
    sums = []
    for c in CODES:
        true = [cell(c, p) for p in CODES] + [unscored(c)]
        sums.append(f"{' + '.join(true)} AS support_{c}")
        sums.append(f"{' + '.join(cell(t, c) for t in CODES)} AS predicted_{c}")
    return counts.selectExpr("*", *sums).selectExpr(
        "*",
        f"{' + '.join(f'support_{c}' for c in CODES)} AS rows",
        f"{' + '.join(f'predicted_{c}' for c in CODES)} AS scored",
    )


def confusion_matrix(counts: DataFrame, keys=(), present_only: bool = False) -> DataFrame:
    """Long matrix: one row per key, true class and predicted class.

    With `present_only`, classes that occur neither as true nor as predicted
    class are left out.
    """
    def occurs(c):
        return f"support_{c} + predicted_{c} > 0"

    rows = [
        f"named_struct('y_true', {t}, 'y_pred', {p}, 'true_label', '{fv.DISPLAY_LABELS[t]}', "
        f"'predicted_label', '{fv.DISPLAY_LABELS[p]}', 'n', {cell(t, p)}, "
        f"'present', {occurs(t)} AND {occurs(p)})"
        for t in CODES
        for p in CODES
    ]
    matrix = with_marginals(counts).select(*keys, F.expr(f"inline(array({', '.join(rows)}))"))
    if present_only:
        matrix = matrix.filter("present")
    return matrix.drop("present")
