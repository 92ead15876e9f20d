"""Classification metrics as projections of confusion counts.

Nothing here reads predictions or joins: each metric is an expression over
the one row per key that `confusion.cells` leaves. `measured` computes the
per-class values once; the averages refer to them by column name.

Expressions are SQL texts, so that a report of many values is still built in
a few calls.
"""

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import fixed_values as fv
from answerloom.functions.hashing import hash_uniform
from answerloom.operators import confusion as cm

CODES = fv.CLASS_CODES


def _sum(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def _ratio(part: str, whole: str) -> str:
    """part / whole, 0 where the whole is 0."""
    return f"coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0D)"


def _macro(metric: str) -> str:
    return _ratio(_sum(f"{metric}_{c}" for c in CODES), "classes")


def _weighted(metric: str) -> str:
    return _ratio(_sum(f"support_{c} * {metric}_{c}" for c in CODES), "rows")


def _kappa() -> str:
    pairs = [(t, p, (t - p) ** 2) for t in CODES for p in CODES if t != p]
    observed = _sum(f"{d} * {cm.cell(t, p)}" for t, p, d in pairs)
    expected = _sum(
        f"{d} * CAST(support_{t} - {cm.unscored(t)} AS DOUBLE) * predicted_{p}"
        for t, p, d in pairs
    )
    return f"1 - {observed} * CAST(scored AS DOUBLE) / nullif({expected}, 0)"


def _naive() -> str:
    largest = f"greatest({', '.join(f'support_{c}' for c in CODES)})"
    classes = _sum(f"CAST(support_{c} > 0 AS INT)" for c in CODES)
    return _ratio(f"2 * {largest}", f"(({largest} + rows) * {classes})")


# Overall metrics by name, over the columns of `measured`.
OVERALL = {
    "accuracy": _ratio(_sum(cm.cell(c, c) for c in CODES), "rows"),
    "quadratic_weighted_kappa": _kappa(),
    "macro_precision": _macro("precision"),
    "macro_recall": _macro("recall"),
    "macro_f1": _macro("f1"),
    "macro_f1_naive": _naive(),
    "weighted_precision": _weighted("precision"),
    "weighted_recall": _weighted("recall"),
    "weighted_f1": _weighted("f1"),
    "support": "rows",
    "unscored": _sum(cm.unscored(c) for c in CODES),
}
SUMMARY = tuple(m for m in OVERALL if m not in ("support", "unscored"))
PER_TOPIC = ("quadratic_weighted_kappa", "macro_f1", "weighted_f1", "support")


def measured(counts: DataFrame) -> DataFrame:
    """Counts with marginals and precision_c, recall_c, f1_c of each class.

    A value whose denominator is 0 is 0. `classes` is the number of classes
    that occur as true or as predicted class.
    """
    values = [
        _sum(f"CAST(support_{c} + predicted_{c} > 0 AS INT)" for c in CODES) + " AS classes"
    ]
    for c in CODES:
        hits = cm.cell(c, c)
        values += [
            f"{_ratio(hits, f'predicted_{c}')} AS precision_{c}",
            f"{_ratio(hits, f'support_{c}')} AS recall_{c}",
            f"{_ratio(f'2 * {hits}', f'(support_{c} + predicted_{c})')} AS f1_{c}",
        ]
    return cm.with_marginals(counts).selectExpr("*", *values)


def metric(name: str) -> Column:
    """One of the overall metrics, as a column over `measured`.

    Macro averages are plain means over the classes that occur; weighted ones
    go by the number of rows of each true class. Kappa looks at scored rows
    only and is NULL where it is undefined; class codes are their own ranks,
    so its distances stay right when a class is absent. The naive F1 is that
    of always answering the most frequent true class.
    """
    return F.expr(OVERALL[name]).alias(name)


def summary(counts: DataFrame, keys=()) -> DataFrame:
    """One wide row per key with all overall metrics."""
    return measured(counts).select(*keys, *[metric(m) for m in OVERALL], "no_truth")


def training_metrics(counts: DataFrame, keys=()) -> DataFrame:
    """The short set watched during training."""
    short = ("accuracy", "macro_f1", "weighted_f1")
    return measured(counts).select(*keys, *[metric(m) for m in short])


def per_class(counts: DataFrame, keys=()) -> DataFrame:
    """One row per key and class, keyed by class code; absent classes are 0."""
    rows = [
        f"named_struct('label', {c}, 'label_name', '{fv.LABEL_NAMES[c]}', "
        f"'precision', precision_{c}, 'recall', recall_{c}, 'f1', f1_{c}, 'support', support_{c})"
        for c in CODES
    ]
    return measured(counts).select(*keys, F.expr(f"inline(array({', '.join(rows)}))"))


def classification_report(counts: DataFrame, keys=()) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg."""
    def line(name, precision, recall, f1, support):
        return (
            f"named_struct('line', '{name}', 'precision', {precision}, 'recall', {recall}, "
            f"'f1', {f1}, 'support', {support})"
        )

    nothing = "CAST(NULL AS DOUBLE)"
    lines = [
        line(fv.LABEL_NAMES[c], f"precision_{c}", f"recall_{c}", f"f1_{c}", f"support_{c}")
        for c in CODES
    ]
    lines.append(line("accuracy", nothing, nothing, OVERALL["accuracy"], "rows"))
    for kind in ("macro", "weighted"):
        values = [OVERALL[f"{kind}_{m}"] for m in ("precision", "recall", "f1")]
        lines.append(line(f"{kind} avg", *values, "rows"))
    return measured(counts).select(*keys, F.expr(f"inline(array({', '.join(lines)}))"))


def per_topic(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """Kappa, macro F1, weighted F1 and support of each topic."""
    return measured(counts).select(topic, *[metric(m) for m in PER_TOPIC])


def overall_topic_f1(counts: DataFrame) -> DataFrame:
    """Mean of the topics' weighted F1, weighted by topic size."""
    return measured(counts).agg(
        F.expr(f"sum({OVERALL['weighted_f1']} * rows) / nullif(sum(rows), 0)").alias(
            "overall_topic_weighted_f1"
        )
    )


def flagship(predictions: DataFrame, topic: str = "topic") -> DataFrame:
    """Overall and per-topic metrics from one pass over the predictions."""
    both = cm.with_overall(cm.cells(predictions, [topic]), topic)
    rounded = [
        f"round({OVERALL[m]}, 9) AS {m}"
        for m in ("macro_f1", "weighted_f1", "quadratic_weighted_kappa")
    ]
    return measured(both).selectExpr("scope", "key", *rounded, "rows AS support")


def random_predictions(df: DataFrame, row_id: str, y_true="y_true", seed=fv.SEED) -> DataFrame:
    """Predictions drawn in proportion to the true classes, by row hash.

    The class shares are one small row, read as a scalar subquery.
    """
    t = F.col(y_true)
    shares = (
        df.agg(*[F.count_if(t == c).cast("double").alias(f"s{c}") for c in CODES])
        .select(F.struct("s0", "s1", "s2").alias("s"))
        .scalar()
    )
    everyone = shares["s0"] + shares["s1"] + shares["s2"]
    u = hash_uniform(F.col(row_id), seed) * everyone
    drawn = (
        F.when(u < shares["s0"], 0).when(u < shares["s0"] + shares["s1"], 1).otherwise(2)
    )
    return df.select(*[c for c in df.columns if c != "y_pred"], drawn.alias("y_pred"))


def random_macro_f1(df: DataFrame, row_id: str, y_true="y_true", seed=fv.SEED) -> DataFrame:
    """Macro F1 of answering at random in proportion to the true classes."""
    drawn = random_predictions(df.select(row_id, y_true), row_id, y_true, seed)
    counts = cm.cells(drawn, y_true=y_true)
    return measured(counts).select(metric("macro_f1").alias("macro_f1_random"))


def _entry(scope: str, key: str, name: str, value: str) -> str:
    return (
        f"named_struct('scope', '{scope}', 'key', {key}, 'metric', '{name}', "
        f"'value', CAST({value} AS DOUBLE))"
    )


def _overall_entries() -> list[str]:
    entries = [_entry("overall", "'overall'", m, x) for m, x in OVERALL.items()]
    for c in CODES:
        entries += [
            _entry("class", f"'{fv.LABEL_NAMES[c]}'", m, f"{m}_{c}")
            for m in ("precision", "recall", "f1", "support")
        ]
    return entries


def long_report(predictions: DataFrame, topic: str | None = "topic") -> DataFrame:
    """All metrics of an evaluation as rows (scope, key, metric, value).

    Scopes: overall, class, topic. The predictions are read and shuffled once;
    the overall level is the sum of the topics' cells.
    """
    whole = _overall_entries()
    if topic is None:
        return measured(cm.cells(predictions)).selectExpr(f"inline(array({', '.join(whole)}))")
    counts = measured(cm.cells(predictions, [topic])).withColumn(
        "f1_mass", F.expr(f"{OVERALL['weighted_f1']} * rows")
    )
    levels = measured(cm.with_overall(counts, topic, ["f1_mass"]))
    whole.append(
        _entry("overall", "'overall'", "overall_topic_weighted_f1", _ratio("f1_mass", "rows"))
    )
    one = [_entry("topic", "key", m, OVERALL[m]) for m in PER_TOPIC]
    return levels.selectExpr(
        f"inline(if(scope = 'overall', array({', '.join(whole)}), array({', '.join(one)})))"
    )
