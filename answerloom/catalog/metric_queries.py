"""Aggregations and metrics."""

from pyspark.sql import functions as F

from answerloom.catalog import views as v
from answerloom.functions.labels import argmax
from answerloom.operators import confusion as cm, metrics as mt
from answerloom.operators.leaderboard import group_stats
from answerloom.operators.scoring import repeat_runs

# The cells of a 3x3 matrix and the metrics over them, in SQL.
_CELLS = ", ".join(
    [
        f"CAST(count(*) FILTER (y_true = {t} AND y_pred = {p}) AS DOUBLE) AS n{t}{p}"
        for t in range(3)
        for p in range(3)
    ]
    + [f"CAST(count(*) FILTER (y_true = {t}) AS DOUBLE) AS r{t}" for t in range(3)]
)


def _metric_columns():
    cols = []
    for c in range(3):
        col = "+".join(f"n{t}{c}" for t in range(3))
        cols.append(f"{col} AS p{c}")
    base = ", ".join(cols)
    per = ", ".join(
        f"coalesce(n{c}{c} / nullif(p{c}, 0), 0) AS prec{c}, "
        f"coalesce(n{c}{c} / nullif(r{c}, 0), 0) AS rec{c}, "
        f"coalesce(2 * n{c}{c} / nullif(r{c} + p{c}, 0), 0) AS f{c}, "
        f"CASE WHEN r{c} + p{c} > 0 THEN 1 ELSE 0 END AS here{c}"
        for c in range(3)
    )
    return base, per


_BASE, _PER = _metric_columns()


def _mean(name):
    return (
        "(" + "+".join(f"{name}{c}*here{c}" for c in range(3)) + ") / nullif(here0+here1+here2, 0)"
    )


def _weighted(name):
    return "(" + "+".join(f"{name}{c}*r{c}" for c in range(3)) + ") / nullif(r0+r1+r2, 0)"


_ACCURACY = "(n00+n11+n22) / nullif(r0+r1+r2, 0)"
_DIST = [(t, p) for t in range(3) for p in range(3) if t != p]
_QWK = (
    "1 - ("
    + "+".join(f"n{t}{p}*{(t - p) ** 2}" for t, p in _DIST)
    + ") * ("
    + "+".join(f"n{t}{p}" for t in range(3) for p in range(3))
    + ") / nullif("
    + "+".join(f"(n{t}0+n{t}1+n{t}2)*p{p}*{(t - p) ** 2}" for t, p in _DIST)
    + ", 0)"
)
_NAIVE_P = "(greatest(r0,r1,r2) / nullif(r0+r1+r2, 0))"
_NAIVE = (
    f"2*{_NAIVE_P}/(1+{_NAIVE_P}) / "
    "((CASE WHEN r0>0 THEN 1 ELSE 0 END)+(CASE WHEN r1>0 THEN 1 ELSE 0 END)"
    "+(CASE WHEN r2>0 THEN 1 ELSE 0 END))"
)


def measured(source: str, keys: str = "", relation: str = "answers", name: str = "m") -> str:
    """WITH chain that ends in a relation holding cells and per-class metrics."""
    group = f"GROUP BY {keys}" if keys else ""
    pick = f"{keys}, " if keys else ""
    return (
        f"{source}, {name}_c AS (SELECT {pick}{_CELLS} FROM {relation} {group}), "
        f"{name}_p AS (SELECT *, {_BASE} FROM {name}_c), "
        f"{name} AS (SELECT *, {_PER} FROM {name}_p)"
    )


def _r(expression, name):
    return f"round({expression}, 9) AS {name}"


def _rounded(df, *names):
    return df.select(
        *[F.round(c, 9).alias(c) if c in names else F.col(c) for c in df.columns]
    )


QUERIES = {}


def flagship(spark, folder):
    return mt.flagship(v.answers(spark, folder))


QUERIES["flagship_topic_metrics"] = (
    flagship,
    "WITH " + v.ANSWERS + """, levels AS (
      SELECT 'topic' AS scope, topic AS key, y_true, y_pred FROM answers
      UNION ALL SELECT 'overall', 'overall', y_true, y_pred FROM answers), """
    + measured("x AS (SELECT 1)", "scope, key", "levels").replace("x AS (SELECT 1), ", "")
    + f""" SELECT scope, key, {_r(_mean('f'), 'macro_f1')}, {_r(_weighted('f'), 'weighted_f1')},
      {_r(_QWK, 'quadratic_weighted_kappa')}, CAST(r0+r1+r2 AS BIGINT) AS support FROM m""",
)

QUERIES["A10_confusion_matrix"] = (
    lambda s, d: cm.confusion_matrix(cm.cells(v.answers(s, d), ["topic"]), ["topic"]),
    "WITH " + v.ANSWERS + """, n AS (
      SELECT topic, y_true, y_pred, count(*) AS n FROM answers GROUP BY ALL),
    classes(c, name) AS (VALUES (0, 'Incorrect'), (1, 'Partially Correct'), (2, 'Correct')),
    grid AS (SELECT topic, t.c AS y_true, p.c AS y_pred, t.name AS true_label,
               p.name AS predicted_label
             FROM (SELECT DISTINCT topic FROM answers), classes t, classes p)
    SELECT g.topic, g.y_true, g.y_pred, g.true_label, g.predicted_label,
           coalesce(n.n, 0) AS n
    FROM grid g LEFT JOIN n ON g.topic = n.topic AND g.y_true = n.y_true AND g.y_pred = n.y_pred""",
)

QUERIES["A10_confusion_matrix_labels_present"] = (
    lambda s, d: cm.confusion_matrix(
        cm.cells(v.answers(s, d), ["task_id"]), ["task_id"], present_only=True
    ),
    "WITH " + v.ANSWERS + """,
    seen AS (SELECT task_id, y_true AS c FROM answers UNION SELECT task_id, y_pred FROM answers),
    classes(c, name) AS (VALUES (0, 'Incorrect'), (1, 'Partially Correct'), (2, 'Correct')),
    n AS (SELECT task_id, y_true, y_pred, count(*) AS n FROM answers GROUP BY ALL)
    SELECT t.task_id, t.c AS y_true, p.c AS y_pred, tn.name AS true_label,
           pn.name AS predicted_label, coalesce(n.n, 0) AS n
    FROM seen t JOIN seen p ON t.task_id = p.task_id
    JOIN classes tn ON tn.c = t.c JOIN classes pn ON pn.c = p.c
    LEFT JOIN n ON n.task_id = t.task_id AND n.y_true = t.c AND n.y_pred = p.c""",
)

QUERIES["A11_accuracy"] = (
    lambda s, d: mt.measured(cm.cells(v.answers(s, d), ["topic"])).select(
        "topic", F.round(mt.metric("accuracy"), 9).alias("accuracy")
    ),
    "WITH " + v.ANSWERS + """
    SELECT topic, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy
    FROM answers GROUP BY topic""",
)

_PER_CLASS_SQL = """
    SELECT {keys}c AS label, CASE c WHEN 0 THEN 'incorrect' WHEN 1 THEN 'partial' ELSE 'correct' END
             AS label_name,
           round(CASE c WHEN 0 THEN prec0 WHEN 1 THEN prec1 ELSE prec2 END, 9) AS precision,
           round(CASE c WHEN 0 THEN rec0 WHEN 1 THEN rec1 ELSE rec2 END, 9) AS recall,
           round(CASE c WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END, 9) AS f1,
           CAST(CASE c WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS BIGINT) AS support
    FROM m, (VALUES (0), (1), (2)) AS classes(c)"""

QUERIES["A12_precision_recall_f1_per_class"] = (
    lambda s, d: _rounded(
        mt.per_class(cm.cells(v.answers(s, d), ["topic"]), ["topic"]), "precision", "recall", "f1"
    ),
    "WITH " + measured(v.ANSWERS, "topic") + _PER_CLASS_SQL.format(keys="topic, "),
)

QUERIES["A12_absent_classes_by_label_id"] = (
    lambda s, d: _rounded(
        mt.per_class(cm.cells(v.answers(s, d), ["task_id"]), ["task_id"]),
        "precision", "recall", "f1",
    ),
    "WITH " + measured(v.ANSWERS, "task_id") + _PER_CLASS_SQL.format(keys="task_id, "),
)

QUERIES["A13_macro_averages"] = (
    lambda s, d: mt.measured(cm.cells(v.answers(s, d), ["topic", "priority"])).select(
        "topic", "priority",
        F.round(mt.metric("macro_precision"), 9).alias("macro_precision"),
        F.round(mt.metric("macro_recall"), 9).alias("macro_recall"),
        F.round(mt.metric("macro_f1"), 9).alias("macro_f1"),
    ),
    "WITH " + measured(v.ANSWERS, "topic, priority") + f"""
    SELECT topic, priority, {_r(_mean('prec'), 'macro_precision')},
      {_r(_mean('rec'), 'macro_recall')}, {_r(_mean('f'), 'macro_f1')} FROM m""",
)

# One task has few answers, so classes are often absent: macro over present ones.
QUERIES["A13_macro_over_present_labels"] = (
    lambda s, d: mt.measured(cm.cells(v.answers(s, d), ["task_id"])).select(
        "task_id", F.round(mt.metric("macro_f1"), 9).alias("macro_f1")
    ),
    "WITH " + measured(v.ANSWERS, "task_id") + f"""
    SELECT task_id, {_r(_mean('f'), 'macro_f1')} FROM m""",
)

QUERIES["A14_weighted_averages"] = (
    lambda s, d: mt.measured(cm.cells(v.answers(s, d), ["topic", "priority"])).select(
        "topic", "priority",
        F.round(mt.metric("weighted_precision"), 9).alias("weighted_precision"),
        F.round(mt.metric("weighted_recall"), 9).alias("weighted_recall"),
        F.round(mt.metric("weighted_f1"), 9).alias("weighted_f1"),
    ),
    "WITH " + measured(v.ANSWERS, "topic, priority") + f"""
    SELECT topic, priority, {_r(_weighted('prec'), 'weighted_precision')},
      {_r(_weighted('rec'), 'weighted_recall')}, {_r(_weighted('f'), 'weighted_f1')} FROM m""",
)

QUERIES["A15_quadratic_weighted_kappa"] = (
    lambda s, d: mt.measured(cm.cells(v.answers(s, d), ["task_id"])).select(
        "task_id", F.round(mt.metric("quadratic_weighted_kappa"), 9).alias("quadratic_weighted_kappa")
    ),
    "WITH " + measured(v.ANSWERS, "task_id") + f"""
    SELECT task_id, {_r(_QWK, 'quadratic_weighted_kappa')} FROM m""",
)

QUERIES["A16_naive_majority_macro_f1"] = (
    lambda s, d: mt.measured(cm.cells(v.answers(s, d), ["task_id"])).select(
        "task_id", F.round(mt.metric("macro_f1_naive"), 9).alias("macro_f1_naive")
    ),
    "WITH " + v.ANSWERS + """, n AS (
      SELECT task_id, y_true, count(*) AS n FROM answers GROUP BY ALL),
    top AS (SELECT task_id, arg_min(y_true, (-n, y_true)) AS guess, count(*) AS k,
              max(n) AS hits, sum(n) AS total FROM n GROUP BY task_id)
    SELECT task_id, round(2.0 * hits / (total + hits) / k, 9) AS macro_f1_naive FROM top""",
)

QUERIES["A17_random_proportional_macro_f1"] = (
    lambda s, d: _rounded(mt.random_macro_f1(v.answers(s, d), "row_id", seed=42), "macro_f1_random"),
    "WITH " + v.ANSWERS + """, shares AS (
      SELECT count(*) FILTER (y_true = 0) AS s0, count(*) FILTER (y_true = 1) AS s1,
             count(*) AS n FROM answers),
    drawn AS (SELECT y_true, CASE WHEN u < s0 THEN 0 WHEN u < s0 + s1 THEN 1 ELSE 2 END AS y_pred
      FROM (SELECT y_true, s0, s1,
              ('0x' || substr(md5('42:' || row_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n AS u
            FROM answers, shares)), """
    + measured("", "", "drawn").lstrip(", ") + f" SELECT {_r(_mean('f'), 'macro_f1_random')} FROM m",
)

QUERIES["A18_per_topic_metrics"] = (
    lambda s, d: _rounded(
        mt.per_topic(cm.cells(v.answers(s, d), ["topic"])),
        "quadratic_weighted_kappa", "macro_f1", "weighted_f1",
    ),
    "WITH " + measured(v.ANSWERS, "topic") + f"""
    SELECT topic, {_r(_QWK, 'quadratic_weighted_kappa')}, {_r(_mean('f'), 'macro_f1')},
      {_r(_weighted('f'), 'weighted_f1')}, CAST(r0+r1+r2 AS BIGINT) AS support FROM m""",
)

QUERIES["A19_overall_topic_weighted_f1"] = (
    lambda s, d: _rounded(
        mt.overall_topic_f1(cm.cells(v.answers(s, d), ["topic"])), "overall_topic_weighted_f1"
    ),
    "WITH " + measured(v.ANSWERS, "topic") + f"""
    SELECT round(sum({_weighted('f')} * (r0+r1+r2)) / sum(r0+r1+r2), 9)
      AS overall_topic_weighted_f1 FROM m""",
)

QUERIES["A20_classification_report"] = (
    lambda s, d: _rounded(
        mt.classification_report(cm.cells(v.answers(s, d), ["topic"]), ["topic"]),
        "precision", "recall", "f1",
    ),
    "WITH " + measured(v.ANSWERS, "topic") + ", lines AS ("
    + " UNION ALL ".join(
        [
            f"SELECT topic, '{name}' AS line, prec{c} AS precision, rec{c} AS recall, f{c} AS f1, "
            f"r{c} AS support FROM m"
            for c, name in enumerate(("incorrect", "partial", "correct"))
        ]
        + [f"SELECT topic, 'accuracy', NULL, NULL, {_ACCURACY}, r0+r1+r2 FROM m"]
        + [
            f"SELECT topic, 'macro avg', {_mean('prec')}, {_mean('rec')}, {_mean('f')}, r0+r1+r2 FROM m",
            f"SELECT topic, 'weighted avg', {_weighted('prec')}, {_weighted('rec')}, "
            f"{_weighted('f')}, r0+r1+r2 FROM m",
        ]
    )
    + """) SELECT topic, line, round(precision, 9) AS precision, round(recall, 9) AS recall,
      round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM lines""",
)

QUERIES["A21_training_metrics"] = (
    lambda s, d: _rounded(
        mt.training_metrics(cm.cells(v.answers(s, d))), "accuracy", "macro_f1", "weighted_f1"
    ),
    "WITH " + measured(v.ANSWERS) + f"""
    SELECT {_r(_ACCURACY, 'accuracy')}, {_r(_mean('f'), 'macro_f1')},
      {_r(_weighted('f'), 'weighted_f1')} FROM m""",
)

# Rows without a prediction count as wrong, are reported, and leave kappa alone.
QUERIES["A11_A15_with_missing_predictions"] = (
    lambda s, d: _rounded(
        mt.summary(cm.cells(v.gapped(s, d), ["topic"]), ["topic"]), *mt.SUMMARY
    ),
    "WITH " + measured(
        v.GAPPED + """, extra AS (
          SELECT topic AS extra_topic, count(*) FILTER (y_pred IS NULL) AS unscored
          FROM gapped GROUP BY topic)""",
        "topic", "gapped",
    ) + f"""
    SELECT topic, {_r(_ACCURACY, 'accuracy')}, {_r(_QWK, 'quadratic_weighted_kappa')},
      {_r(_mean('prec'), 'macro_precision')}, {_r(_mean('rec'), 'macro_recall')},
      {_r(_mean('f'), 'macro_f1')}, {_r(_NAIVE, 'macro_f1_naive')},
      {_r(_weighted('prec'), 'weighted_precision')}, {_r(_weighted('rec'), 'weighted_recall')},
      {_r(_weighted('f'), 'weighted_f1')}, CAST(r0+r1+r2 AS BIGINT) AS support,
      unscored, CAST(0 AS BIGINT) AS no_truth
    FROM m JOIN extra ON extra_topic = topic""",
)

LONG_SQL = (
    " UNION ALL ".join(
        [
            f"SELECT 'overall' AS scope, 'overall' AS key, '{n}' AS metric, {e} AS value FROM w"
            for n, e in (
                ("accuracy", _ACCURACY), ("quadratic_weighted_kappa", _QWK),
                ("macro_precision", _mean("prec")), ("macro_recall", _mean("rec")),
                ("macro_f1", _mean("f")), ("macro_f1_naive", _NAIVE),
                ("weighted_precision", _weighted("prec")), ("weighted_recall", _weighted("rec")),
                ("weighted_f1", _weighted("f")), ("support", "r0+r1+r2"), ("unscored", "0.0"),
            )
        ]
        + [
            f"SELECT 'class', '{name}', '{n}', {e}{c} FROM w"
            for c, name in enumerate(("incorrect", "partial", "correct"))
            for n, e in (("precision", "prec"), ("recall", "rec"), ("f1", "f"), ("support", "r"))
        ]
        + [
            f"SELECT 'topic', topic, '{n}', {e} FROM m"
            for n, e in (
                ("quadratic_weighted_kappa", _QWK), ("macro_f1", _mean("f")),
                ("weighted_f1", _weighted("f")), ("support", "r0+r1+r2"),
            )
        ]
        + [
            f"SELECT 'overall', 'overall', 'overall_topic_weighted_f1', "
            f"sum({_weighted('f')} * (r0+r1+r2)) / sum(r0+r1+r2) FROM m"
        ]
    )
)

QUERIES["D9_metrics_long"] = (
    lambda s, d: _rounded(mt.long_report(v.answers(s, d)), "value"),
    "WITH " + measured(v.ANSWERS, "topic") + ", " + measured("", "", "answers", "w").lstrip(", ")
    + f", l AS ({LONG_SQL}) SELECT scope, key, metric, round(CAST(value AS DOUBLE), 9) AS value FROM l",
)

QUERIES["F5_valid_labels_matrix"] = (
    lambda s, d: v.gapped(s, d)
    .withColumn("y_pred", F.coalesce("y_pred", F.lit(-1)))
    .filter(F.col("y_true").isin(0, 1, 2) & F.col("y_pred").isin(0, 1, 2))
    .groupBy("y_true", "y_pred")
    .agg(F.count("*").alias("n")),
    "WITH " + v.GAPPED + """
    SELECT y_true, y_pred, count(*) AS n FROM gapped WHERE y_pred IS NOT NULL GROUP BY ALL""",
)

QUERIES["P18_argmax_of_logits"] = (
    lambda s, d: v.table(s, d, "embeddings").select(
        "vec_id", argmax(F.col("embedding")).alias("y_pred")
    ),
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS y_pred
       FROM embeddings""",
)

# Several runs of one evaluation: each run's draw differs by its seed.
QUERIES["M7_repeated_runs"] = (
    lambda s, d: _runs(s, d),
    "WITH " + measured(
        v.ANSWERS + """, repeated AS (
          SELECT run, y_true, CASE WHEN ('0x' || substr(md5(run || ':' || row_id), 1, 8))::BIGINT
                 / 4294967296.0::DOUBLE < 0.75 THEN y_pred ELSE (y_pred + 1) % 3 END AS y_pred
          FROM answers, (VALUES (1), (2), (3)) AS r(run))""",
        "run", "repeated",
    ) + f"""
    SELECT round(avg(qwk), 9) AS mean_kappa, round(coalesce(stddev_samp(qwk), 0), 9) AS std_kappa,
           count(*) AS runs
    FROM (SELECT {_QWK} AS qwk FROM m)""",
)


def _runs(spark, folder):
    repeated = repeat_runs(v.answers(spark, folder), 3)
    u = F.conv(
        F.substring(F.md5(F.concat_ws(":", F.col("run"), F.col("row_id"))), 1, 8), 16, 10
    ).cast("bigint") / F.lit(4294967296.0)
    noisy = repeated.withColumn(
        "y_pred", F.when(u < 0.75, F.col("y_pred")).otherwise((F.col("y_pred") + 1) % 3)
    )
    by_run = mt.summary(cm.cells(noisy, ["run"]), ["run"])
    stats = group_stats(by_run, [], "quadratic_weighted_kappa", "kappa")
    return _rounded(stats.withColumnRenamed("n_kappa", "runs"), "mean_kappa", "std_kappa")


QUERIES["M8_several_models"] = (
    lambda s, d: _rounded(
        mt.summary(
            cm.cells(
                v.answers(s, d).select(
                    "y_true",
                    F.inline(
                        F.array(
                            F.struct(F.lit("base").alias("model"), F.col("y_pred").alias("y_pred")),
                            F.struct(
                                F.lit("strict").alias("model"),
                                F.least("y_pred", F.lit(1)).alias("y_pred"),
                            ),
                        )
                    ),
                ),
                ["model"],
            ),
            ["model"],
        ).select("model", "accuracy", "macro_f1", "quadratic_weighted_kappa", "support"),
        "accuracy", "macro_f1", "quadratic_weighted_kappa",
    ),
    "WITH " + measured(
        v.ANSWERS + """, several AS (
          SELECT 'base' AS model, y_true, y_pred FROM answers
          UNION ALL SELECT 'strict', y_true, least(y_pred, 1) FROM answers)""",
        "model", "several",
    ) + f"""
    SELECT model, {_r(_ACCURACY, 'accuracy')}, {_r(_mean('f'), 'macro_f1')},
      {_r(_QWK, 'quadratic_weighted_kappa')}, CAST(r0+r1+r2 AS BIGINT) AS support FROM m""",
)
