"""The plans themselves, run end to end."""

from pyspark.sql import functions as F

from answerloom.catalog import reshape_queries as rq, scoring_queries as sq, split_queries as xq, stubs, views as v
from answerloom.catalog.metric_queries import LONG_SQL, measured
from answerloom.plans import build_split, evaluate, grid, load, quiz_import, synthesize
from answerloom.session import scratch_path
from answerloom.sources import writers

QUERIES = {}


def _graded(spark, folder):
    """The evaluation plan, per question; the metrics it stored."""
    answers = sq.order_answers(spark, folder).withColumn(
        "topic", F.split_part("question", F.lit(" "), F.lit(1))
    ).withColumn("labels", F.col("y_true"))
    stored = evaluate.grade_and_measure(
        answers, stubs.question_predictor, "run", scratch_path(spark, "metrics"), "per_question", question_limit=1000,
    )
    return stored.filter("metric <> 'macro_f1_random'").select(
        "scope", "key", "metric", F.round("value", 9).alias("value")
    )


QUERIES["L1_grade_and_measure"] = (
    _graded,
    "WITH " + v.ANSWERS + """, a AS (
      SELECT CASE WHEN priority <> '5-LOW' THEN task_id END AS task_id, row_id, y_true,
             split_part(topic, ' ', 1) AS topic, topic || ' ' || priority AS question,
             labels || ' ' || topic || ' ' || lower(priority) AS student_answer FROM answers),
    g AS (SELECT *, first_value(question) OVER w AS first_question, row_number() OVER w AS pos,
            count(*) OVER (PARTITION BY task_id) AS n
          FROM a WINDOW w AS (PARTITION BY task_id ORDER BY row_id)),
    scored AS (SELECT topic, y_true,
      CASE WHEN task_id IS NOT NULL AND (n <= 2 OR pos < n) THEN least(2, """
    + sq.OVERLAP_SQL.format(q="first_question", a="student_answer") + ") END AS y_pred FROM g), "
    + measured("", "topic", "scored").lstrip(", ") + ", "
    + measured("", "", "scored", "w").lstrip(", ")
    + ", missing AS (SELECT count(*) AS n FROM scored WHERE y_pred IS NULL)"
    + f""", l AS ({LONG_SQL})
    SELECT scope, key, metric, round(CAST(CASE WHEN metric = 'unscored'
      THEN (SELECT n FROM missing) ELSE value END AS DOUBLE), 9) AS value FROM l""",
)


def _split_statistics(spark, folder):
    """The split plan; the statistics of what it wrote."""
    return build_split.split_answers(v.answers(spark, folder).drop("y_true"), scratch_path(spark, "splits"))["statistics"]


QUERIES["L2_balanced_split_statistics"] = (
    _split_statistics,
    "WITH " + xq.ASSIGNED
    + f""", answered AS (SELECT a.*, assigned.split FROM answers a JOIN assigned USING (task_id))
    SELECT split, topic, {xq.STATISTICS},
           CASE grouping(split, topic) WHEN 3 THEN 'GRAND TOTAL' WHEN 1 THEN 'TOTAL'
             WHEN 2 THEN 'TOPIC TOTAL' ELSE 'SPLIT TOPIC' END AS level
    FROM answered GROUP BY CUBE (split, topic)""",
)


def _generated_totals(spark, folder):
    """The generation plan; what it counted."""
    return synthesize.generate_answers(
        sq.turn_tasks(spark, folder), sq.QUOTAS, stubs.question_generator, "per_question", scratch_path(spark, "generated"),
        fail_on_violation=False,
    )["totals"]


QUERIES["L4_generate_and_count"] = (
    _generated_totals,
    "WITH " + sq.TURN_TASKS + """, q(label, n) AS (
      VALUES ('correct', 2), ('partial', 1), ('incorrect', 3)),
    counts AS (SELECT label, sum(n) AS expected,
        sum(CASE WHEN len(string_split(question, chr(10))) >= n THEN n ELSE 0 END) AS actual
      FROM tasks, q GROUP BY label)
    SELECT label, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual FROM counts
    UNION ALL SELECT 'total', CAST(sum(expected) AS BIGINT), CAST(sum(actual) AS BIGINT) FROM counts""",
)


def _quiz_rows(spark, folder):
    """Quiz rows of which some have no task."""
    rows = rq._quiz_long(spark, folder)
    return rows.withColumn("task", F.when(F.col("task") != "sentences_c", F.col("task")))


def _imported(spark, folder):
    """A quiz added twice as the same batch: the second time replaces the first."""
    table, rejects = scratch_path(spark, "answers-table"), scratch_path(spark, "rejects")
    existing = v.answers(spark, folder).select("task_id", "labels")
    for _ in range(2):
        quiz_import.append_to_answers(_quiz_rows(spark, folder), existing, table, rejects, "quiz1")
    good = spark.read.parquet(table).withColumn("reject_reason", F.lit(None).cast("string"))
    return good.unionByName(spark.read.parquet(rejects))


QUERIES["L3_quiz_imported_twice"] = (
    _imported,
    "WITH " + v.ANSWERS + ", " + rq._quiz_sql() + """, holed AS (
      SELECT * REPLACE (CASE WHEN task <> 'sentences_c' THEN task END AS task) FROM quiz),
    ids AS (SELECT task, row_number() OVER (ORDER BY task)
        + (SELECT max(CAST(task_id AS BIGINT)) FROM answers) AS task_id
      FROM (SELECT DISTINCT task FROM holed WHERE task IS NOT NULL))
    SELECT CAST(task_id AS VARCHAR) AS task_id, question, reference_answer,
           CASE WHEN task LIKE 'sentences%' THEN 'sentences' WHEN task IS NOT NULL THEN 'validity' END AS topic,
           student_answer, CAST(CAST(points * 2 AS INTEGER) AS VARCHAR) AS labels,
           CASE WHEN points IS NULL THEN 'points' WHEN task IS NULL THEN 'task' END AS reject_reason, 'quiz1' AS batch
    FROM holed LEFT JOIN ids USING (task)""",
)


def _loaded(spark, folder):
    """Pre-split files, written as CSV and loaded by the plan; sizes per split and class."""
    base = scratch_path(spark, "split-files")
    rows = v.presplit(spark, folder)
    for name in ("train", "val", "test"):
        mine = rows.filter(F.col("split") == name).select(
            "task_id", F.lit("q").alias("question"), F.lit("r").alias("reference_answer"), "topic",
            F.lit("a").alias("student_answer"), "labels",
        )
        writers.semicolon_csv(mine, f"{base}/{name}")
    out = load.load_splits(
        spark, scratch_path(spark, "loaded"), *[f"{base}/{name}" for name in ("train", "val", "test")], multi_line=False
    )
    return out["sizes"]


QUERIES["L5_load_splits"] = (
    _loaded,
    "WITH " + v.PRESPLIT + " SELECT split, y_true, count(*) AS n FROM presplit GROUP BY ROLLUP (split, y_true)",
)


def _repeated(mode):
    def query(spark, folder):
        answers = sq.order_answers(spark, folder).filter("task_id IS NOT NULL")
        limit = {"limit": 1000} if mode == "per_question" else {"pass_reference": False}
        maker = stubs.question_predictor if mode == "per_question" else stubs.row_predictor
        out = evaluate.grade_repeatedly(answers, maker, 2, scratch_path(spark, "repeated"), "accuracy", mode, **limit)
        return out["statistics"].select(
            F.round("mean_accuracy", 9).alias("mean_accuracy"), F.round("std_accuracy", 9).alias("std_accuracy"),
            F.col("n_accuracy").alias("runs"),
        )

    return query


_TEXTS = """a AS (
      SELECT task_id, row_id, y_true, topic || ' ' || priority AS question,
             labels || ' ' || topic || ' ' || lower(priority) AS student_answer
      FROM answers WHERE priority <> '5-LOW')"""

QUERIES["M7_repeated_row_grading"] = (
    _repeated("single"),
    "WITH " + v.ANSWERS + ", " + _TEXTS + f""", g AS (
      SELECT y_true, least(2, {sq.OVERLAP_SQL.format(q="question", a="student_answer")}) AS y_pred FROM a)
    SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 9) AS mean_accuracy,
           0.0::DOUBLE AS std_accuracy, CAST(2 AS BIGINT) AS runs FROM g""",
)

QUERIES["M7_repeated_question_grading"] = (
    _repeated("per_question"),
    "WITH " + v.ANSWERS + ", " + _TEXTS + f""", p AS (
      SELECT *, first_value(question) OVER w AS first_question, row_number() OVER w AS pos,
             count(*) OVER (PARTITION BY task_id) AS n
      FROM a WINDOW w AS (PARTITION BY task_id ORDER BY row_id)), g AS (
      SELECT y_true, CASE WHEN n <= 2 OR pos < n
        THEN least(2, {sq.OVERLAP_SQL.format(q="first_question", a="student_answer")}) END AS y_pred FROM p)
    SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END), 9) AS mean_accuracy,
           0.0::DOUBLE AS std_accuracy, CAST(2 AS BIGINT) AS runs FROM g""",
)


def _leaderboard(spark, folder):
    path = scratch_path(spark, "grid-csv")
    rows = v.table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("Run"),
        F.when(F.col("l_linenumber") < 6, F.col("l_discount").cast("string")).alias("dropout"),
        F.col("l_tax").cast("string").alias("weight_decay"),
        F.when(F.col("l_quantity") > 10, F.concat(F.lit("'"), F.col("l_quantity").cast("string"))).alias("kappa"),
    )
    rows.write.csv(path, header=True, quote='"', escape='"')
    return grid.leaderboard(spark, path, ["dropout", "weight_decay"], "kappa").withColumns(
        {c: F.round(c, 9) for c in ("dropout_norm", "weight_decay_norm", "kappa_norm")}
    )


QUERIES["L6_grid_leaderboard"] = (
    _leaderboard,
    """WITH r AS (
      SELECT l_orderkey || '-' || l_linenumber AS "Run", l_discount::DOUBLE AS dropout, l_tax::DOUBLE AS weight_decay,
             l_quantity::DOUBLE AS kappa
      FROM lineitem WHERE l_linenumber < 6 AND l_quantity > 10)
    SELECT *, round((dropout - min(dropout) OVER ()) / (max(dropout) OVER () - min(dropout) OVER ()), 9) AS dropout_norm,
      round((weight_decay - min(weight_decay) OVER ()) / (max(weight_decay) OVER () - min(weight_decay) OVER ()), 9) AS weight_decay_norm,
      round((kappa - min(kappa) OVER ()) / (max(kappa) OVER () - min(kappa) OVER ()), 9) AS kappa_norm
    FROM r""",
)
