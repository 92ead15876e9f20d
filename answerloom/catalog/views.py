"""The test tables read as answers, predictions, quiz data and runs.

Each view exists twice: as a DataFrame and as the SQL the checks are made of.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from answerloom.functions.basics import case_map


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


STATUS_CODES = {"F": 0, "P": 1, "O": 2}
STATUS_NAMES = {"F": "incorrect", "P": "partial", "O": "correct"}


def answers(spark, folder) -> DataFrame:
    """Orders as answers, their customers as tasks, segments as topics."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    truth = case_map(F.col("o_orderstatus"), STATUS_CODES)
    guess = F.when(F.col("o_orderkey") % 10 < 7, truth).otherwise((truth + 1) % 3)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").cast("string").alias("task_id"),
        F.col("c_mktsegment").alias("topic"),
        case_map(F.col("o_orderstatus"), STATUS_NAMES).alias("labels"),
        truth.alias("y_true"),
        guess.alias("y_pred"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
    )


ANSWERS = """answers AS (
  SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS task_id, c_mktsegment AS topic,
         CASE o_orderstatus WHEN 'F' THEN 'incorrect' WHEN 'P' THEN 'partial'
                            WHEN 'O' THEN 'correct' END AS labels,
         t AS y_true,
         CASE WHEN o_orderkey % 10 < 7 THEN t ELSE (t + 1) % 3 END AS y_pred,
         o_orderpriority AS priority, o_totalprice AS price
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 END AS t
        FROM orders)
  JOIN customer ON o_custkey = c_custkey)"""


def gapped(spark, folder) -> DataFrame:
    """`answers` where low-priority rows have no prediction."""
    return answers(spark, folder).withColumn(
        "y_pred", F.when(F.col("priority") != "5-LOW", F.col("y_pred"))
    )


GAPPED = (
    ANSWERS
    + """, gapped AS (
  SELECT * REPLACE (CASE WHEN priority <> '5-LOW' THEN y_pred END AS y_pred) FROM answers)"""
)


# Which split a task belongs to, from its number alone (stands for pre-split files).
def presplit(spark, folder) -> DataFrame:
    digit = F.col("task_id").cast("bigint") % 5
    split = F.when(digit == 3, "val").when(digit == 4, "test").otherwise("train")
    return answers(spark, folder).withColumn("split", split)


PRESPLIT = (
    ANSWERS
    + """, presplit AS (
  SELECT *, CASE CAST(task_id AS BIGINT) % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test'
                 ELSE 'train' END AS split FROM answers)"""
)


# The first eight letters, for numbering lines.
LETTERS = "abcdefgh"


def enumerated(spark, folder) -> DataFrame:
    """Conversation turns as quiz texts: line 1 becomes 'a. ..', line 2 'b. ..'."""
    letters = F.lit(LETTERS)
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(
            i < 8, F.concat(F.substr(letters, i + 1, F.lit(1)), F.lit(". "), line)
        ).otherwise(line),
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.array_join(lines, "<br />").alias("quiz_text")
    )


ENUMERATED = """enumerated AS (
  SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)),
           lambda line, i: CASE WHEN i <= 8
             THEN substr('abcdefgh', CAST(i AS BIGINT), 1) || '. ' || line ELSE line END),
         '<br />') AS quiz_text
  FROM conversations)"""


def styled_pages(spark, folder) -> DataFrame:
    """Pages whose paragraphs and bold runs open with styled spans."""
    text = F.col("html")
    for tag, span in STYLES:
        text = F.replace(text, F.lit(tag), F.lit(span))
    return table(spark, folder, "pages").select("page_id", text.alias("html"))


STYLES = (
    ("<p>", '<p><span style="font:x;background-color:rgb(12,3,255);color:#000">'),
    ("<b>", '<span style="color:rgb(0,0,0);">'),
    ("<h1>", '<h1><span style=background-color:transparent;color:#000000;>'),
    ("</b>", "</span>"),
    ("<br>", "<!--HTML--><br /><br /><br />"),
)

_styled = "html"
for _tag, _span in STYLES:
    _styled = f"replace({_styled}, '{_tag}', '{_span}')"
STYLED = f"styled AS (SELECT page_id, {_styled} AS html FROM pages)"


def pairs(spark, folder) -> DataFrame:
    """User turns with the assistant turn that follows, as question and answer."""
    turns = table(spark, folder, "conversations")
    user = turns.filter("role = 'user'").select(
        "conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("question")
    )
    reply = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("a_conv"),
        (F.col("turn") - 1).alias("a_turn"),
        F.col("text").alias("student_answer"),
    )
    joined = user.join(
        reply, (user.conv_id == reply.a_conv) & (user.q_turn == reply.a_turn)
    )
    # A reference is given for questions longer than 100 characters.
    return joined.select(
        F.concat_ws("-", "conv_id", "q_turn").alias("row_id"),
        F.col("conv_id").cast("string").alias("task_id"),
        F.col("q_turn").alias("row_no"),
        "question",
        "student_answer",
        F.when(
            F.length("question") > 100, F.concat(F.lit("Model: "), "student_answer", "question")
        ).alias("reference_answer"),
    )


PAIRS = """pairs AS (
  SELECT u.conv_id || '-' || u.turn AS row_id, CAST(u.conv_id AS VARCHAR) AS task_id,
         u.turn AS row_no, u.text AS question, a.text AS student_answer,
         CASE WHEN length(u.text) > 100 THEN 'Model: ' || a.text || u.text END AS reference_answer
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


# Line items of one task where they are grouped by order.
ITEMS_PER_TASK = 200_000


def subtask_points(spark, folder) -> DataFrame:
    """Line items as graded subtasks: one row per (participant, letter).

    Nearly every line is a group of its own, so a task's memory is that of its rows. They are dealt to as many
    tasks as they need, by the order alone: grouping by participant goes on without another shuffle.
    """
    lines = table(spark, folder, "lineitem")
    tasks = 1 + lines.count() // ITEMS_PER_TASK
    points = case_map(F.col("l_returnflag"), {"A": 0.0, "N": 0.5, "R": 1.0})
    letter = F.substr(F.lit(LETTERS), F.col("l_linenumber"), F.lit(1))
    return (
        lines.select("l_orderkey", "l_linenumber", "l_returnflag")
        .repartition(tasks, "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("participant"), letter.alias("letter"))
        .agg(F.max(points).alias("points"))
    )


SUBTASK_POINTS = """subtask_points AS (
  SELECT l_orderkey AS participant, substr('abcdefgh', l_linenumber, 1) AS letter,
         max(CASE l_returnflag WHEN 'A' THEN 0.0::DOUBLE WHEN 'N' THEN 0.5::DOUBLE
                               WHEN 'R' THEN 1.0::DOUBLE END) AS points
  FROM lineitem GROUP BY ALL)"""


def runs(spark, folder) -> DataFrame:
    """Events as evaluation runs: type = model, user = seed, value = metric."""
    names = {
        "view": "gpt-4o_single_run1",
        "click": "lora_gpt2-large",
        "purchase": "lora_flan-t5-large",
        "signup": "mistralai/mixed-7b",
        "error": "lora_Qwen3-0.6B",
    }
    return table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        case_map(F.col("event_type"), names).alias("run"),
        F.col("user_id").alias("seed"),
        F.col("value").alias("metric"),
    )


RUNS = """runs AS (
  SELECT event_id AS run_id,
         CASE event_type WHEN 'view' THEN 'gpt-4o_single_run1' WHEN 'click' THEN 'lora_gpt2-large'
           WHEN 'purchase' THEN 'lora_flan-t5-large' WHEN 'signup' THEN 'mistralai/mixed-7b'
           WHEN 'error' THEN 'lora_Qwen3-0.6B' END AS run,
         user_id AS seed, value AS metric
  FROM events)"""
