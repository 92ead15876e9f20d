"""Grading, generation and run statistics."""

from pyspark.sql import functions as F

from answerloom.catalog import stubs, views as v
from answerloom.operators import generation as gn, leaderboard as ld, scoring as sc

QUERIES = {}

# Words shared by question and answer.
OVERLAP_SQL = "len(list_intersect(list_distinct(string_split({q}, ' ')), list_distinct(string_split({a}, ' '))))"

QUERIES["M3_row_grader"] = (
    lambda s, d: sc.score_rows(v.pairs(s, d), stubs.row_predictor).select("row_id", "y_pred", "error"),
    "WITH " + v.PAIRS + f"""
    SELECT row_id, CASE WHEN length(question) <= 400 THEN
             CAST(least(2, {OVERLAP_SQL.format(q='question', a='student_answer')}) AS INTEGER) END AS y_pred,
           CASE WHEN length(question) > 400 THEN 'ValueError: question too long' END AS error
    FROM pairs""",
)

_GROUPED = (
    v.PAIRS + """, grouped AS (
      SELECT *, first_value(question) OVER w AS first_question,
             first_value(reference_answer) OVER w AS first_reference,
             row_number() OVER w AS pos, count(*) OVER (PARTITION BY task_id) AS n
      FROM pairs WINDOW w AS (PARTITION BY task_id ORDER BY row_no, row_id))"""
)

QUERIES["A27_answers_per_question"] = (
    lambda s, d: sc.answer_groups(v.pairs(s, d), limit=1000).select(
        "task_id", "question", "reference_answer",
        F.array_join(F.transform("members", lambda m: m["answer"]), "|").alias("answers"),
        F.size("members").alias("n"),
    ),
    "WITH " + _GROUPED + """
    SELECT task_id, first_question AS question, first_reference AS reference_answer,
           string_agg(student_answer, '|' ORDER BY row_no, row_id) AS answers,
           CAST(count(*) AS INTEGER) AS n
    FROM grouped GROUP BY ALL""",
)


# Topics as questions: thousands of answers each, cut in row order.
QUERIES["A27_answers_of_large_questions"] = (
    lambda s, d: sc.answer_groups(
        v.answers(s, d).select(
            "topic", "row_id", F.col("row_id").alias("row_no"), F.concat_ws(" ", "task_id", "priority").alias("question"),
            F.col("labels").alias("reference_answer"), F.concat_ws("/", "labels", "row_id").alias("student_answer"),
        ),
        limit=1000, key="topic",
    ).select(
        "topic", "part", "question", "reference_answer", F.size("members").alias("n"),
        F.md5(F.array_join(F.transform("members", lambda m: m["answer"]), "|")).alias("answers"),
    ),
    "WITH " + v.ANSWERS + """, placed AS (
      SELECT topic, labels || '/' || row_id AS answer, row_id, row_number() OVER w AS pos,
             first_value(task_id || ' ' || priority) OVER w AS question, first_value(labels) OVER w AS reference_answer
      FROM answers WINDOW w AS (PARTITION BY topic ORDER BY row_id))
    SELECT topic, (pos - 1) // 1000 AS part, question, reference_answer, CAST(count(*) AS INTEGER) AS n,
           md5(string_agg(answer, '|' ORDER BY row_id)) AS answers
    FROM placed GROUP BY ALL""",
)


def order_answers(spark, folder):
    """Order answers with a text: several answers per task, none for some segments' key."""
    return v.answers(spark, folder).select(
        F.when(F.col("priority") != "5-LOW", F.col("task_id")).alias("task_id"),
        "row_id", F.col("row_id").alias("row_no"), "y_true",
        F.concat_ws(" ", "topic", "priority").alias("question"),
        F.concat_ws(" ", "labels", "topic", F.lower("priority")).alias("student_answer"),
        F.col("labels").alias("reference_answer"),
    )


QUERIES["M4_J7_question_grader"] = (
    lambda s, d: sc.score_questions(
        order_answers(s, d), stubs.question_predictor, limit=1000, carry=("y_true",)
    ).select("row_id", "task_id", "y_true", "y_pred"),
    "WITH " + v.ANSWERS + """, a AS (
      SELECT CASE WHEN priority <> '5-LOW' THEN task_id END AS task_id, row_id, y_true,
             topic || ' ' || priority AS question,
             labels || ' ' || topic || ' ' || lower(priority) AS student_answer FROM answers),
    g AS (SELECT *, first_value(question) OVER w AS first_question, row_number() OVER w AS pos,
            count(*) OVER (PARTITION BY task_id) AS n
          FROM a WINDOW w AS (PARTITION BY task_id ORDER BY row_id))
    SELECT row_id, task_id, y_true,
           CASE WHEN task_id IS NOT NULL AND (n <= 2 OR pos < n) THEN CAST(least(2, """
    + OVERLAP_SQL.format(q="first_question", a="student_answer") + """) AS INTEGER) END AS y_pred
    FROM g""",
)


def turn_tasks(spark, folder):
    return v.pairs(spark, folder).select(
        F.col("row_id").alias("task_id"), "question", "reference_answer",
        F.col("task_id").alias("topic"),
    )


TURN_TASKS = v.PAIRS + """, tasks AS (
  SELECT row_id AS task_id, question, reference_answer, task_id AS topic FROM pairs)"""

QUOTAS = {"correct": 2, "partial": 1, "incorrect": 3}
_REQUESTS = """(VALUES ('correct', 1), ('correct', 2), ('partial', 1), ('incorrect', 1),
  ('incorrect', 2), ('incorrect', 3)) AS q(label, i)"""

QUERIES["M6_generate_single"] = (
    lambda s, d: gn.generate(turn_tasks(s, d), QUOTAS, stubs.single_generator, "single"),
    "WITH " + TURN_TASKS + f"""
    SELECT task_id, question, reference_answer, topic,
           CASE WHEN length(question) <= 400 THEN label || '/' ||
               CASE WHEN label = 'incorrect' OR reference_answer IS NULL THEN '-'
                 ELSE CAST(length(reference_answer) AS VARCHAR) END || '/' || question
             WHEN label = 'correct' THEN reference_answer
             WHEN label = 'partial' THEN 'Partial answer ' || i || ' for question ' || task_id
             ELSE 'Incorrect answer ' || i || ' for question ' || task_id END AS student_answer,
           label AS labels, CAST(NULL AS VARCHAR) AS reject_reason
    FROM tasks, {_REQUESTS}""",
)

QUERIES["M6_generate_per_question"] = (
    lambda s, d: gn.generate(turn_tasks(s, d), QUOTAS, stubs.question_generator, "per_question"),
    "WITH " + TURN_TASKS + """, asked AS (
      SELECT *, string_split(question, chr(10)) AS lines
      FROM tasks, (VALUES ('correct', 2), ('partial', 1), ('incorrect', 3)) AS q(label, n))
    SELECT task_id, question, reference_answer, topic, label || ': ' || line AS student_answer,
           label AS labels, CAST(NULL AS VARCHAR) AS reject_reason
    FROM (SELECT *, unnest(lines[1:n]) AS line FROM asked WHERE len(lines) >= n)
    UNION ALL
    SELECT task_id, question, reference_answer, topic, NULL, label,
           'expected ' || n || ' answers, got ' || len(lines)
    FROM asked WHERE len(lines) < n""",
)

QUERIES["M6_generate_all_batched"] = (
    lambda s, d: gn.generate(turn_tasks(s, d), QUOTAS, stubs.batch_generator, "all", tasks_per_call=50),
    "WITH " + TURN_TASKS + f"""
    SELECT task_id, question, reference_answer, topic, label || ' ' || (i - 1) || ' ' || question
             AS student_answer, label AS labels, CAST(NULL AS VARCHAR) AS reject_reason
    FROM tasks, {_REQUESTS}""",
)

QUERIES["M6_rejects_and_violations"] = (
    lambda s, d: gn.count_violations(
        gn.accepted(
            gn.generate(turn_tasks(s, d), QUOTAS, stubs.question_generator, "per_question")
        ),
        turn_tasks(s, d), QUOTAS,
    ),
    "WITH " + TURN_TASKS + """
    SELECT task_id, label, CAST(n AS BIGINT) AS expected, CAST(0 AS BIGINT) AS actual
    FROM tasks, (VALUES ('correct', 2), ('partial', 1), ('incorrect', 3)) AS q(label, n)
    WHERE len(string_split(question, chr(10))) < n""",
)

QUERIES["A24_mean_and_deviation"] = (
    lambda s, d: ld.group_stats(v.runs(s, d), ["run", "seed"], "metric").select(
        "run", "seed", F.round("mean_metric", 7).alias("mean_metric"),
        F.round("std_metric", 7).alias("std_metric"), "n_metric",
    ),
    "WITH " + v.RUNS + """
    SELECT run, seed, round(avg(metric), 7) AS mean_metric,
           round(coalesce(stddev_samp(metric), 0), 7) AS std_metric, count(metric) AS n_metric
    FROM runs GROUP BY run, seed""",
)

QUERIES["A25_column_ranges"] = (
    lambda s, d: ld.column_ranges(v.table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"]),
    """SELECT 'l_quantity' AS "column", min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
       UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount) FROM lineitem
       UNION ALL SELECT 'l_linenumber', CAST(min(l_linenumber) AS DOUBLE),
                        CAST(max(l_linenumber) AS DOUBLE) FROM lineitem""",
)

QUERIES["K2_sorted_by_metric"] = (
    lambda s, d: ld.ranked(v.runs(s, d), "metric", ["run_id"]).select("run_id", "metric"),
    "WITH " + v.RUNS + " SELECT run_id, metric FROM runs ORDER BY metric DESC, run_id",
)

QUERIES["K4_best_per_seed"] = (
    lambda s, d: ld.best_runs(v.runs(s, d), ["seed"], "metric", "run_id"),
    "WITH " + v.RUNS + """
    SELECT seed, run_id, run, metric FROM runs
    QUALIFY row_number() OVER (PARTITION BY seed ORDER BY metric DESC, run_id) = 1""",
)

QUERIES["K4_best_overall"] = (
    lambda s, d: ld.best_runs(v.runs(s, d), [], "metric", "run_id"),
    "WITH " + v.RUNS + """
    SELECT run_id, run, seed, metric FROM runs ORDER BY metric DESC, run_id LIMIT 1""",
)

QUERIES["K4_lowest_loss_per_run"] = (
    lambda s, d: ld.best_runs(v.runs(s, d), ["run"], "metric", "run_id", minimize=True),
    "WITH " + v.RUNS + """
    SELECT run_id, run, seed, metric FROM runs
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY metric, run_id) = 1""",
)

QUERIES["K4_metric_fallback"] = (
    lambda s, d: v.table(s, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", F.col("value")).alias("eval_macro_f1"),
        F.when(F.col("event_type") == "click", F.col("value") + 1).alias("macro_f1"),
        F.when(F.col("event_type") == "error", F.col("value") + 2).alias("detailed_macro_f1"),
        F.col("user_id").cast("double").alias("eval_loss"),
    ).select(
        "event_id",
        ld.metric_or_fallback(
            "macro_f1", ["eval_macro_f1", "macro_f1", "detailed_macro_f1", "eval_loss"]
        ).alias("metric_value"),
    ),
    """SELECT event_id, CASE event_type WHEN 'view' THEN value WHEN 'click' THEN value + 1
         WHEN 'error' THEN value + 2 ELSE CAST(user_id AS DOUBLE) END AS metric_value FROM events""",
)

QUERIES["J8_param_grid"] = (
    lambda s, d: ld.param_grid(
        v.runs(s, d).select("run").distinct(),
        {"learning_rate": [0.0001, 0.0002, 0.0005, 0.001], "lora_r": [8], "alpha_ratio": [2.0],
         "dropout": [0.2], "batch_size": [8, 16, 32]},
    ).withColumn("lora_alpha", (F.col("lora_r") * F.col("alpha_ratio")).cast("int")),
    "WITH " + v.RUNS + """
    SELECT run, lr AS learning_rate, CAST(8 AS INTEGER) AS lora_r, 2.0::DOUBLE AS alpha_ratio,
           0.2::DOUBLE AS dropout, bs AS batch_size, CAST(a * 3 + b + 1 AS INTEGER) AS combination_idx,
           CAST(16 AS INTEGER) AS lora_alpha
    FROM (SELECT DISTINCT run FROM runs),
      (VALUES (0, 0.0001::DOUBLE), (1, 0.0002), (2, 0.0005), (3, 0.001)) AS r(a, lr),
      (VALUES (0, 8), (1, 16), (2, 32)) AS s(b, bs)""",
)

QUERIES["J8_run_matrix_with_overrides"] = (
    lambda s, d: ld.run_matrix(
        v.table(s, d, "customer").select(F.col("c_name").alias("model")),
        [42, 43, 44],
        v.table(s, d, "customer").filter("c_acctbal > 0").select(
            F.col("c_name").alias("model"), F.col("c_nationkey").alias("batch_size"),
            F.when(F.col("c_nationkey") > 5, F.col("c_acctbal")).alias("learning_rate"),
        ),
        {"batch_size": 16, "learning_rate": 0.0002},
    ),
    """SELECT c_name AS model, CAST(i AS INTEGER) AS seed_idx, CAST(42 + i AS INTEGER) AS seed,
              CASE WHEN c_acctbal > 0 THEN c_nationkey ELSE 16 END AS batch_size,
              CASE WHEN c_acctbal > 0 AND c_nationkey > 5 THEN c_acctbal ELSE 0.0002 END AS learning_rate
       FROM customer, range(3) AS r(i)""",
)

QUERIES["A29_throughput"] = (
    lambda s, d: ld.throughput(
        v.table(s, d, "lineitem"), ["l_suppkey"], "l_linenumber", "l_quantity"
    ).select(
        "l_suppkey", "num_examples", "total_eval_time_seconds",
        F.round("examples_per_minute", 9).alias("examples_per_minute"),
        F.round("avg_time_per_example_seconds", 9).alias("avg_time_per_example_seconds"),
    ),
    """SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS num_examples,
              sum(l_quantity) AS total_eval_time_seconds,
              round(sum(l_linenumber) / sum(l_quantity) * 60, 9) AS examples_per_minute,
              round(sum(l_quantity) / sum(l_linenumber), 9) AS avg_time_per_example_seconds
       FROM lineitem GROUP BY l_suppkey""",
)
