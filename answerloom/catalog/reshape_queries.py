"""Joins, filters, reshaping and the quiz."""

from pyspark.sql import functions as F

from answerloom import fixed_values as fv
from answerloom.catalog import views as v
from answerloom.catalog.text_queries import FLAT_SQL, SENTENCES, UNIFIED_SQL, VALIDITY, strict_sql
from answerloom.functions.text import dirty_number
from answerloom.operators import generation as gn, leaderboard as ld, quiz as qz, reshape as rs

QUERIES = {}


def _students(spark, folder):
    number = F.col("c_nationkey") + F.length("c_mktsegment") - 7
    return v.table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Quiz Group "), number.cast("string")))
        .when(F.col("c_acctbal") > -500, F.col("c_name"))
        .alias("student"),
    )


QUERIES["F1_keep_groups"] = (
    lambda s, d: _students(s, d).filter(qz.keep_group(F.col("student"))),
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'Quiz Group ' || n
              WHEN c_acctbal > -500 THEN c_name END AS student
       FROM (SELECT *, c_nationkey + length(c_mktsegment) - 7 AS n FROM customer)
       WHERE c_acctbal <= 0 OR n < 3 OR (n > 9 AND n < 28)""",
)

QUERIES["F2_drop_header_rows"] = (
    lambda s, d: qz.drop_header_rows(
        v.table(s, d, "part").select(
            "p_partkey", F.when(F.col("p_type") == "PROMO", "task").otherwise(F.col("p_type")).alias("task")
        )
    ),
    "SELECT p_partkey, p_type AS task FROM part WHERE p_type <> 'PROMO'",
)

QUERIES["F3_drop_missing_metrics"] = (
    lambda s, d: ld.drop_incomplete(
        v.table(s, d, "events").select(
            "event_id",
            dirty_number(
                F.when(F.col("event_type") == "error", "").when(
                    F.col("event_type") == "view", "nan"
                ).otherwise(F.col("value").cast("string"))
            ).alias("kappa"),
            F.nullif("user_id", F.lit(3)).alias("param"),
        ),
        ["kappa", "param"],
    ),
    """SELECT event_id, value AS kappa, user_id AS param FROM events
       WHERE event_type NOT IN ('error', 'view') AND user_id <> 3""",
)

QUERIES["F4_equality_on_trimmed_type"] = (
    lambda s, d: v.table(s, d, "part")
    .withColumn("task", F.concat(F.lit("  "), "p_type", F.lit(" ")))
    .filter(F.btrim("task") == "ECONOMY")
    .select("p_partkey", "task"),
    "SELECT p_partkey, '  ' || p_type || ' ' AS task FROM part WHERE trim('  ' || p_type || ' ') = 'ECONOMY'",
)

QUERIES["J1_keyed_side_by_side"] = (
    lambda s, d: rs.join_by_key(
        v.table(s, d, "orders").select(F.col("o_orderkey").alias("participant"), "o_totalprice"),
        v.subtask_points(s, d).groupBy("participant").agg(F.sum("points").alias("points")),
        "participant",
    ),
    "WITH " + v.SUBTASK_POINTS + """
    SELECT participant, o_totalprice, sum(points) AS points
    FROM subtask_points JOIN orders ON o_orderkey = participant GROUP BY ALL""",
)

QUERIES["J1_key_mismatches"] = (
    lambda s, d: rs.key_mismatches(
        v.table(s, d, "orders").select(F.col("o_orderkey").alias("participant")),
        v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("participant")),
        "participant",
    ),
    """SELECT participant, CAST(sum(l) AS BIGINT) AS left_rows, CAST(sum(r) AS BIGINT) AS right_rows
       FROM (SELECT o_orderkey AS participant, 1 AS l, 0 AS r FROM orders
             UNION ALL SELECT l_orderkey, 0, 1 FROM lineitem)
       GROUP BY participant HAVING sum(l) <> 1 OR sum(r) <> 1""",
)

QUERIES["J2_left_lookup"] = (
    lambda s, d: rs.lookup(
        v.table(s, d, "customer").select("c_custkey", "c_nationkey"),
        v.table(s, d, "nation").filter("n_regionkey > 0").select("n_nationkey", "n_name"),
        "c_nationkey", "n_nationkey",
    ),
    """SELECT c_custkey, c_nationkey, n_name FROM customer
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 0) ON n_nationkey = c_nationkey""",
)

_KINDS = {"ECONOMY": tuple("abcdef"), "PROMO": tuple("abcdefgh")}


def _lettered(spark, folder):
    tasks = v.table(spark, folder, "part").select(
        "p_partkey", F.concat("p_type", F.lit(" ")).alias("task"),
        F.col("p_name").alias("question"),
    )
    return rs.lettered_tasks(tasks, "task", ["p_partkey"], _KINDS)


_LETTERED = """lettered AS (
  SELECT p_partkey, task, question, substr('abcdefgh', CAST(n AS BIGINT), 1) AS letter FROM (
    SELECT p_partkey, p_type AS task, p_name AS question,
           row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n
    FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))
  WHERE n <= CASE task WHEN 'ECONOMY' THEN 6 ELSE 8 END)"""

QUERIES["J3_nth_task_with_nth_letter"] = (
    lambda s, d: v.subtask_points(s, d)
    .withColumn("task", F.when(F.col("points") > 0, "ECONOMY").otherwise("PROMO"))
    .join(F.broadcast(_lettered(s, d)), ["task", "letter"], "left")
    .select("participant", "task", "letter", "question", "p_partkey"),
    "WITH " + v.SUBTASK_POINTS + ", " + _LETTERED + """
    SELECT p.participant, p.task, p.letter, question, p_partkey
    FROM (SELECT *, CASE WHEN points > 0 THEN 'ECONOMY' ELSE 'PROMO' END AS task FROM subtask_points) p
    LEFT JOIN lettered l ON l.task = p.task AND l.letter = p.letter""",
)


def _orders_with_letters(spark, folder):
    letters = F.array(*[F.lit(x) for x in "abcdefg"])
    return v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("participant"), F.explode(letters).alias("letter")
    )


_BASE = """base AS (
  SELECT o_orderkey AS participant, letter
  FROM orders, (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f'), ('g')) AS l(letter))"""

QUERIES["J5_grades_over_default"] = (
    lambda s, d: rs.overlay(
        _orders_with_letters(s, d), v.subtask_points(s, d), ["participant", "letter"], "points", 1.0
    ),
    "WITH " + ", ".join([v.SUBTASK_POINTS, _BASE]) + """
    SELECT b.participant, b.letter, coalesce(points, 1.0::DOUBLE) AS points
    FROM base b LEFT JOIN subtask_points p USING (participant, letter)""",
)

QUERIES["A23_point_sum_mismatches"] = (
    lambda s, d: rs.sum_mismatches(
        rs.overlay(
            _orders_with_letters(s, d), v.subtask_points(s, d), ["participant", "letter"], "points", 1.0
        ).withColumn("section", F.when(F.col("letter") < "d", "sentences").otherwise("validity")),
        v.table(s, d, "orders").select(
            F.col("o_orderkey").alias("participant"),
            F.inline(
                F.array(
                    F.struct(F.lit("sentences").alias("section"), F.lit(2.0).alias("total")),
                    F.struct(
                        F.lit("validity").alias("section"),
                        F.when(F.col("o_orderstatus") != "F", 3.0).alias("total"),
                    ),
                )
            ),
        ),
        ["participant", "section"],
    ),
    "WITH " + ", ".join([v.SUBTASK_POINTS, _BASE]) + """, sums AS (
      SELECT participant, CASE WHEN letter < 'd' THEN 'sentences' ELSE 'validity' END AS section,
             sum(coalesce(points, 1.0::DOUBLE)) AS calculated
      FROM base LEFT JOIN subtask_points USING (participant, letter) GROUP BY ALL)
    SELECT participant, section, calculated,
           CASE WHEN section = 'sentences' THEN 2.0::DOUBLE WHEN o_orderstatus = 'F' THEN 0
             ELSE 3 END AS expected
    FROM sums JOIN orders ON o_orderkey = participant
    WHERE abs(calculated - CASE WHEN section = 'sentences' THEN 2.0 WHEN o_orderstatus = 'F' THEN 0
             ELSE 3 END) > 0.01""",
)

# Sections whose points are all missing count 0.
QUERIES["A23_missing_points"] = (
    lambda s, d: rs.sum_mismatches(
        v.subtask_points(s, d).select(
            "participant", F.lit("all").alias("section"), F.when(F.col("letter") > "b", F.col("points")).alias("points")
        ),
        v.table(s, d, "orders").select(
            F.col("o_orderkey").alias("participant"), F.lit("all").alias("section"), F.lit(1.0).alias("total")
        ),
        ["participant", "section"],
    ),
    "WITH " + v.SUBTASK_POINTS + """, sums AS (
      SELECT participant, sum(CASE WHEN letter > 'b' THEN points ELSE 0 END) AS calculated FROM subtask_points GROUP BY participant)
    SELECT participant, 'all' AS section, calculated, 1.0::DOUBLE AS expected FROM sums WHERE abs(calculated - 1) > 0.01""",
)

QUERIES["J6_task_requests"] = (
    lambda s, d: gn.requests(
        v.table(s, d, "documents").select(
            F.col("doc_id").alias("task_id"), F.col("source").alias("reference_answer")
        ),
        {"correct": 3, "partial": 2, "incorrect": 4},
    ).select("task_id", "label", "i", "reference_answer"),
    """SELECT doc_id AS task_id, label, CAST(i AS INTEGER) AS i,
              CASE WHEN label <> 'incorrect' THEN source END AS reference_answer
       FROM documents, (VALUES ('correct', 3), ('partial', 2), ('incorrect', 4)) AS q(label, n),
            range(1, 5) AS r(i) WHERE i <= n""",
)

QUERIES["R1_pivot_wide"] = (
    lambda s, d: rs.pivot_wide(
        v.subtask_points(s, d), "participant", "letter", "points",
        {"a": "sentences", "c": "validity_and_soundness"},
    ),
    "WITH " + v.SUBTASK_POINTS + """
    SELECT participant, max(points) FILTER (letter = 'a') AS sentences,
           max(points) FILTER (letter = 'c') AS validity_and_soundness
    FROM subtask_points GROUP BY participant""",
)

QUERIES["R1_duplicate_cells"] = (
    lambda s, d: rs.duplicate_keys(v.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)

QUERIES["R2_wide_to_long"] = (
    lambda s, d: rs.unpivot_long(
        rs.pivot_wide(
            v.subtask_points(s, d), "participant", "letter", "points", {x: x for x in "abcdefg"}
        ),
        ["participant"], list("abcdefg"), "letter", "points",
    ),
    "WITH " + v.SUBTASK_POINTS + """
    SELECT o.participant, l.letter, p.points
    FROM (SELECT DISTINCT participant FROM subtask_points) o
    CROSS JOIN (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f'), ('g')) AS l(letter)
    LEFT JOIN subtask_points p ON p.participant = o.participant AND p.letter = l.letter""",
)


def _quiz(spark, folder):
    """Enumerated turns as quiz rows: both sections hold the text of the turn."""
    return v.enumerated(spark, folder).select(
        F.concat_ws("-", "conv_id", "turn").alias("participant"),
        F.col("quiz_text").alias("sentences"),
        F.col("quiz_text").alias("validity_and_soundness"),
    )


def _quiz_points(spark, folder):
    """Points of every subtask by its letter; every third letter has none."""
    rows = qz.default_points(_quiz(spark, folder))
    place = F.ascii(F.right("subtask", F.lit(1))) % 3
    return rows.select(
        "participant", "subtask", F.when(place > 0, place / 2.0).alias("points")
    )


def _quiz_tasks(spark, folder):
    part = v.table(spark, folder, "part")
    section = F.when(F.col("p_type") == "ECONOMY", "sentences").when(
        F.col("p_type") == "PROMO", " validity_and_soundness "
    )
    return part.select(
        "p_partkey", section.alias("task"), F.col("p_name").alias("question"),
        F.col("p_brand").alias("answer"),
    )


def _quiz_long(spark, folder):
    return qz.long_answers(
        _quiz(spark, folder), _quiz_points(spark, folder), _quiz_tasks(spark, folder), ["p_partkey"]
    )


def _quiz_sql():
    parts = []
    for section, letters, kind in (
        ("sentences", SENTENCES, "ECONOMY"), ("validity_and_soundness", VALIDITY, "PROMO"),
    ):
        for n, x in enumerate(letters, 1):
            parts.append(
                f"SELECT participant AS student, '{section}_{x}' AS task, "
                f"{FLAT_SQL.format(strict_sql(x, letters))} AS student_answer, "
                f"CASE WHEN {ord(x) % 3} > 0 THEN {ord(x) % 3} / 2.0::DOUBLE END AS points, "
                f"'{kind}' AS kind, {n} AS nth FROM texts"
            )
    return (
        v.ENUMERATED + """, texts AS (SELECT conv_id || '-' || turn AS participant,
          replace(replace(quiz_text, '</p><p>', '<br />'), '<br /><br />', '<br />') AS quiz_text
          FROM enumerated),
        questions AS (SELECT p_type AS kind, p_name AS question, p_brand AS reference_answer,
          row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS nth FROM part),
        cut AS (""" + " UNION ALL ".join(parts) + """), quiz AS (
        SELECT student, task, points, student_answer, question, reference_answer
        FROM cut LEFT JOIN questions USING (kind, nth))"""
    )


QUERIES["R2_quiz_long_answers"] = (
    _quiz_long,
    "WITH " + _quiz_sql() + " SELECT * FROM quiz",
)

QUERIES["R5_quiz_to_answers"] = (
    lambda s, d: qz.to_answers(_quiz_long(s, d), v.answers(s, d)),
    "WITH " + v.ANSWERS + ", " + _quiz_sql() + """, ids AS (
      SELECT task, row_number() OVER (ORDER BY task)
        + (SELECT max(CAST(task_id AS BIGINT)) FROM answers) AS task_id
      FROM (SELECT DISTINCT task FROM quiz))
    SELECT CAST(task_id AS VARCHAR) AS task_id, question, reference_answer,
           CASE WHEN task LIKE 'sentences%' THEN 'sentences' ELSE 'validity' END AS topic,
           student_answer, CAST(CAST(points * 2 AS INTEGER) AS VARCHAR) AS labels,
           CASE WHEN points IS NULL THEN 'points' END AS reject_reason
    FROM quiz JOIN ids USING (task)""",
)

QUERIES["L3_quiz_export_merged"] = (
    lambda s, d: _export_merged(s, d),
    "WITH " + v.STYLED + f""", e AS (
      SELECT page_id, html, CASE WHEN page_id % 2 = 0 THEN '&amp;lt;' || page_id END AS remark FROM styled)
    SELECT CAST(page_id AS VARCHAR) AS participant,
           {UNIFIED_SQL} AS sentences, 'a. x<br />b. y' AS validity_and_soundness,
           page_id + 0.5::DOUBLE AS sentences_points, CAST(NULL AS DOUBLE) AS validity_and_soundness_points,
           CASE WHEN page_id % 2 = 0 THEN '<' || page_id END AS sentences_remarks,
           CAST(NULL AS VARCHAR) AS validity_and_soundness_remarks
    FROM e""",
)


def _export_merged(spark, folder):
    pages = v.styled_pages(spark, folder)
    raw = pages.select(
        F.col("page_id").cast("string").alias(fv.QUIZ_PARTICIPANT),
        F.col("html").alias("1. Sentences"),
        F.lit("").alias("2. Validity and Soundness (I)"),
        F.lit("a. x</p><p>b. y").alias("3. Validity and Soundness (II)"),
        F.lit("").alias("4. Arguments"),
    )
    points = pages.select(
        F.col("page_id").cast("string").alias(fv.QUIZ_PARTICIPANT),
        F.concat(F.col("page_id").cast("string"), F.lit(",5")).alias("1. Sentences"),
        F.lit("").alias("2. Validity and Soundness (I)"),
        F.lit("-").alias("3. Validity and Soundness (II)"),
        F.lit("").alias("4. Arguments"),
        F.lit("9").alias(fv.QUIZ_TOTAL),
    )
    remarks = pages.select(
        F.col("page_id").cast("string").alias("username"),
        # Even pages remark on the first task, odd ones on a task that is not used.
        (F.col("page_id") % 2).cast("int").alias("task_id"),
        F.concat(F.lit("&amp;lt;"), F.col("page_id").cast("string")).alias("remark_html"),
    )
    return qz.merge_export(raw, points, remarks)


# Two questions and two answers each per turn; short turns give a wrong length.
QUERIES["R3_flat_answers_per_question"] = (
    lambda s, d: gn.split_flat(
        v.table(s, d, "conversations").select(
            "conv_id", "turn", F.split("text", "\n").alias("flat"),
            F.array(F.lit("first"), F.lit("second")).alias("ids"),
        ),
        "ids", "flat", 2,
    ).select(
        "conv_id", "turn", "pos", "task_id", F.array_join("answers", "|").alias("answers"), "length_ok"
    ),
    """SELECT conv_id, turn, pos, CASE pos WHEN 0 THEN 'first' ELSE 'second' END AS task_id,
         array_to_string(flat[pos * 2 + 1 : pos * 2 + 2], '|') AS answers, len(flat) = 4 AS length_ok
       FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS flat FROM conversations),
            (VALUES (0), (1)) AS p(pos)""",
)

QUERIES["R4_cut_or_reject"] = (
    lambda s, d: v.table(s, d, "conversations").select(
        "conv_id", "turn",
        F.array_join(gn.fit_quota(F.split("text", "\n"), F.lit(3)), "|").alias("answers"),
    ),
    """SELECT conv_id, turn, CASE WHEN len(flat) >= 3 THEN array_to_string(flat[1:3], '|') END AS answers
       FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS flat FROM conversations)""",
)

QUERIES["A22_generated_count_violations"] = (
    lambda s, d: gn.count_violations(
        v.answers(s, d),
        v.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("task_id")),
        {"correct": 3, "partial": 3, "incorrect": 3},
    ),
    "WITH " + v.ANSWERS + """, n AS (SELECT task_id, labels, count(*) AS n FROM answers GROUP BY ALL)
    SELECT CAST(c_custkey AS VARCHAR) AS task_id, label, CAST(3 AS BIGINT) AS expected,
           coalesce(n, 0) AS actual
    FROM customer CROSS JOIN (VALUES ('correct'), ('partial'), ('incorrect')) AS q(label)
    LEFT JOIN n ON n.task_id = CAST(c_custkey AS VARCHAR) AND n.labels = label
    WHERE coalesce(n, 0) <> 3""",
)

QUERIES["A22_label_totals"] = (
    lambda s, d: gn.label_totals(
        v.answers(s, d), v.table(s, d, "customer"), {"correct": 3, "partial": 3, "incorrect": 3}
    ),
    "WITH " + v.ANSWERS + """
    SELECT labels AS label, (SELECT count(*) FROM customer) * 3 AS expected, count(*) AS actual
    FROM answers GROUP BY labels
    UNION ALL SELECT 'total', (SELECT count(*) FROM customer) * 9, count(*) FROM answers""",
)
