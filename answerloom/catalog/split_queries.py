"""Distributions, sampling and splits (A1 to A9, A26, A28, J4, J9, K1, K5, K6, U, X)."""

from pyspark.sql import functions as F

from answerloom.catalog import views as v
from answerloom.functions.hashing import hash_uniform, order_hash
from answerloom.operators import distribution as ds, ranking as rk, sampling as sp, split as xs

QUERIES = {}

QUERIES["A1_count_per_topic"] = (
    lambda s, d: ds.topic_counts(v.answers(s, d)),
    "WITH " + v.ANSWERS + " SELECT topic, count(*) AS n FROM answers GROUP BY topic",
)

QUERIES["A2_count_per_class_zero_filled"] = (
    lambda s, d: ds.class_counts(v.answers(s, d), ["task_id"]),
    "WITH " + v.ANSWERS + """
    SELECT t.task_id, c.label, c.label_name, count(a.row_id) AS n
    FROM (SELECT DISTINCT task_id FROM answers) t
    CROSS JOIN (VALUES (0, 'incorrect'), (1, 'partial'), (2, 'correct')) AS c(label, label_name)
    LEFT JOIN answers a ON a.task_id = t.task_id AND a.y_true = c.label
    GROUP BY ALL""",
)

TASKS = """tasks AS (
  SELECT task_id, min(topic) AS topic, min(topic) <> max(topic) AS topic_conflict,
         count(*) FILTER (y_true = 0) AS n_0, count(*) FILTER (y_true = 1) AS n_1,
         count(*) FILTER (y_true = 2) AS n_2
  FROM answers GROUP BY task_id)"""

QUERIES["A3_label_counts_per_task"] = (
    lambda s, d: ds.task_label_counts(v.answers(s, d)).select("task_id", "n_0", "n_1", "n_2"),
    "WITH " + v.ANSWERS + ", " + TASKS + " SELECT task_id, n_0, n_1, n_2 FROM tasks",
)

# Tasks that occur under several topics: status instead of segment as topic.
QUERIES["A4_first_topic_per_task"] = (
    lambda s, d: ds.task_label_counts(
        v.answers(s, d).withColumn("topic", F.col("priority"))
    ).select("task_id", "topic", "topic_conflict"),
    "WITH " + v.ANSWERS.replace("c_mktsegment AS topic", "o_orderpriority AS topic") + ", " + TASKS
    + " SELECT task_id, topic, topic_conflict FROM tasks",
)

TARGETS = """targets AS (
  SELECT *, n_0 - 2*val_0 AS train_0, n_1 - 2*val_1 AS train_1, n_2 - 2*val_2 AS train_2,
         val_0 AS test_0, val_1 AS test_1, val_2 AS test_2
  FROM (SELECT topic, count(*) AS n_tasks,
          CAST(sum(n_0) AS BIGINT) AS n_0, CAST(sum(n_1) AS BIGINT) AS n_1,
          CAST(sum(n_2) AS BIGINT) AS n_2,
          CAST(round_even(sum(n_0) * 0.2::DOUBLE, 0) AS BIGINT) AS val_0,
          CAST(round_even(sum(n_1) * 0.2::DOUBLE, 0) AS BIGINT) AS val_1,
          CAST(round_even(sum(n_2) * 0.2::DOUBLE, 0) AS BIGINT) AS val_2
        FROM tasks GROUP BY topic))"""

QUERIES["A5_topic_label_targets"] = (
    lambda s, d: xs.topic_targets(ds.task_label_counts(v.answers(s, d))),
    "WITH " + v.ANSWERS + ", " + TASKS + ", " + TARGETS + " SELECT * FROM targets",
)

QUERIES["A6_label_distribution_per_split"] = (
    lambda s, d: ds.split_label_distribution(v.presplit(s, d)).withColumn(
        "percent", F.round("percent", 9)
    ),
    "WITH " + v.PRESPLIT + """, n AS (
      SELECT split, labels AS label_name, count(*) AS n FROM presplit GROUP BY ALL)
    SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY split), 9) AS percent,
           CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS split_total FROM n""",
)

QUERIES["A7_label_distribution_per_topic_split"] = (
    lambda s, d: ds.topic_split_distribution(v.presplit(s, d)),
    "WITH " + v.PRESPLIT + """
    SELECT topic, split, count(*) FILTER (y_true = 0) AS incorrect,
           count(*) FILTER (y_true = 1) AS partial, count(*) FILTER (y_true = 2) AS correct,
           count(*) AS total FROM presplit GROUP BY topic, split""",
)

STATISTICS = """count(DISTINCT task_id) AS questions, count(*) AS answers,
           count(*) FILTER (y_true = 2) AS correct_answers,
           count(*) FILTER (y_true = 1) AS partially_correct_answers,
           count(*) FILTER (y_true = 0) AS incorrect_answers"""

QUERIES["A8_split_topic_statistics"] = (
    lambda s, d: ds.split_statistics(v.presplit(s, d)),
    "WITH " + v.PRESPLIT + f" SELECT split, topic, {STATISTICS} FROM presplit GROUP BY split, topic",
)

# Priorities as topics and rows as split members, so that tasks span both.
QUERIES["A9_statistics_with_totals"] = (
    lambda s, d: ds.full_statistics(
        v.presplit(s, d)
        .withColumn("topic", F.col("priority"))
        .withColumn("split", F.when(F.col("labels") == "partial", "val").otherwise("train"))
    ),
    "WITH " + v.PRESPLIT + f""", spanning AS (
      SELECT * REPLACE (priority AS topic,
        CASE WHEN labels = 'partial' THEN 'val' ELSE 'train' END AS split) FROM presplit)
    SELECT split, topic, {STATISTICS},
           CASE grouping(split, topic) WHEN 3 THEN 'GRAND TOTAL' WHEN 1 THEN 'TOTAL'
             WHEN 2 THEN 'TOPIC TOTAL' ELSE 'SPLIT TOPIC' END AS level
    FROM spanning GROUP BY CUBE (split, topic)""",
)

QUERIES["A26_next_task_ids"] = (
    lambda s, d: rk.allocate_ids(
        v.answers(s, d), v.table(s, d, "part").select(F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("task"))
    ),
    "WITH " + v.ANSWERS + """, t AS (
      SELECT DISTINCT p_brand || ' ' || p_name || ' ' || p_type AS task FROM part)
    SELECT task, row_number() OVER (ORDER BY task) + (SELECT max(CAST(task_id AS BIGINT)) FROM answers)
      AS task_id FROM t""",
)

QUERIES["A28_sizes"] = (
    lambda s, d: ds.sizes(v.presplit(s, d)),
    "WITH " + v.PRESPLIT + """
    SELECT split, y_true, count(*) AS n FROM presplit GROUP BY ROLLUP (split, y_true)""",
)

QUOTA = """sized AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || task_id), task_id) AS pos,
         count(*) OVER (PARTITION BY topic) AS n FROM tasks),
quotas AS (
  SELECT *, CASE WHEN n <= 2 THEN 0 WHEN n = 3 THEN 1
    ELSE greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)) END AS q FROM sized)"""

QUOTA_SPLIT = """SELECT task_id, topic, CASE WHEN pos <= n - 2*q THEN 'train'
             WHEN pos <= n - q THEN 'val' ELSE 'test' END AS split FROM quotas"""

QUERIES["X2b_quota_split"] = (
    lambda s, d: xs.split_by_task(v.answers(s, d), balanced=False),
    "WITH " + ", ".join([v.ANSWERS, TASKS, QUOTA]) + " " + QUOTA_SPLIT,
)

QUERIES["J4_answers_with_split"] = (
    lambda s, d: xs.with_split(
        v.answers(s, d), xs.split_by_task(v.answers(s, d), balanced=False)
    ).select("row_id", "task_id", "topic", "split"),
    "WITH " + ", ".join([v.ANSWERS, TASKS, QUOTA]) + f""", assigned AS ({QUOTA_SPLIT})
    SELECT row_id, task_id, answers.topic, split FROM answers JOIN assigned USING (task_id)""",
)

QUERIES["F6_membership_by_key_set"] = (
    lambda s, d: v.answers(s, d)
    .join(
        v.table(s, d, "customer").filter("c_acctbal > 0").select(
            F.col("c_custkey").cast("string").alias("task_id")
        ),
        "task_id", "left_semi",
    )
    .select("row_id", "task_id"),
    "WITH " + v.ANSWERS + """
    SELECT row_id, task_id FROM answers WHERE task_id IN
      (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)""",
)

# Tasks of a topic in order of their class counts, equal ones by hash; one of every n / (2 q) ranks is held out.
BALANCED = """held AS (
  SELECT *, r * 2 * q // n AS h, (r - 1) * 2 * q // n AS h_before
  FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n_0, n_1, n_2, md5('42:' || task_id), task_id) AS r
        FROM quotas)),
assigned AS (
  SELECT task_id, topic, n_0, n_1, n_2, CASE WHEN h = h_before THEN 'train' WHEN h % 2 = 1 THEN 'val' ELSE 'test' END AS split
  FROM held)"""

ASSIGNED = ", ".join([v.ANSWERS, TASKS, QUOTA, BALANCED])

QUERIES["X2a_balanced_split"] = (
    lambda s, d: xs.split_by_task(v.answers(s, d)),
    "WITH " + ASSIGNED + " SELECT task_id, topic, split FROM assigned",
)

# All tasks under one topic: the same rule for a topic of any size.
QUERIES["X2a_single_topic"] = (
    lambda s, d: xs.split_by_task(v.answers(s, d).withColumn("topic", F.lit("all"))),
    "WITH " + ASSIGNED.replace("c_mktsegment AS topic", "'all' AS topic") + " SELECT task_id, topic, split FROM assigned",
)


def _distances(spark, folder):
    tasks = ds.task_label_counts(v.answers(spark, folder))
    return xs.target_distances(tasks, xs.balanced_split(tasks))


_WANTED = " UNION ALL ".join(
    f"SELECT topic, '{s}' AS split, CAST({c} AS INTEGER) AS label, {s}_{c} AS target FROM targets"
    for s in ("train", "val", "test") for c in range(3)
)

QUERIES["X2a_distance_to_targets"] = (
    _distances,
    "WITH " + ASSIGNED + ", " + TARGETS + f""", wanted AS ({_WANTED}),
    given AS (SELECT topic, split, CAST(label AS INTEGER) AS label, CAST(sum(n) AS BIGINT) AS actual
              FROM (SELECT topic, split, unnest([0, 1, 2]) AS label, unnest([n_0, n_1, n_2]) AS n FROM assigned) GROUP BY ALL)
    SELECT topic, split, label, target, coalesce(actual, 0) AS actual FROM wanted LEFT JOIN given USING (topic, split, label)""",
)

QUERIES["U2_split_overlaps"] = (
    lambda s, d: xs.split_overlaps(
        v.answers(s, d).select(
            "task_id", F.when(F.col("labels") == "partial", "val").otherwise("train").alias("split")
        )
    ),
    "WITH " + v.ANSWERS + """, k AS (
      SELECT DISTINCT task_id, CASE WHEN labels = 'partial' THEN 'val' ELSE 'train' END AS split
      FROM answers)
    SELECT p.split_a, p.split_b, count(b.task_id) AS shared_tasks
    FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) AS p(split_a, split_b)
    LEFT JOIN k a ON a.split = p.split_a
    LEFT JOIN k b ON b.split = p.split_b AND b.task_id = a.task_id
    GROUP BY p.split_a, p.split_b""",
)

def _summary(spark, folder):
    answers = v.answers(spark, folder)
    counts = ds.task_counts(answers, ["topic"])
    rows = counts.withColumn("n", F.col("n_0") + F.col("n_1") + F.col("n_2"))
    return xs.split_summary(xs.with_split(rows, xs.split_by_task(answers)), "n")


QUERIES["X1_no_task_in_two_splits"] = (
    _summary,
    "WITH " + ASSIGNED + """, k AS (
      SELECT split, task_id, count(*) AS n FROM answers JOIN assigned USING (task_id) GROUP BY split, task_id),
    sizes AS (SELECT split, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS answers FROM k GROUP BY split)
    SELECT p.split_a, p.split_b,
           (SELECT count(*) FROM k x JOIN k y USING (task_id) WHERE x.split = p.split_a AND y.split = p.split_b) AS shared_tasks,
           a.tasks AS tasks_a, b.tasks AS tasks_b, a.answers AS answers_a, b.answers AS answers_b
    FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) AS p(split_a, split_b)
    JOIN sizes a ON a.split = p.split_a JOIN sizes b ON b.split = p.split_b""",
)

QUERIES["U1_union_of_splits"] = (
    lambda s, d: v.answers(s, d)
    .select("task_id", "topic", "labels")
    .unionByName(
        v.table(s, d, "orders").select(
            F.col("o_orderstatus").alias("labels"),
            F.col("o_custkey").cast("string").alias("task_id"),
            F.lit("quiz").alias("topic"),
        )
    ),
    "WITH " + v.ANSWERS + """ SELECT task_id, topic, labels FROM answers
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'quiz', o_orderstatus FROM orders""",
)

QUERIES["U3_topics_of_all_splits"] = (
    lambda s, d: v.presplit(s, d).select("topic").distinct(),
    "WITH " + v.PRESPLIT + " SELECT DISTINCT topic FROM presplit",
)

QUERIES["J9_zero_filled_topic_splits"] = (
    lambda s, d: ds.zero_filled(
        ds.split_statistics(v.presplit(s, d).withColumn("topic", F.col("task_id"))),
        ["questions", "answers", "correct_answers"],
    ),
    "WITH " + v.PRESPLIT + """
    SELECT t.topic, s.split, count(DISTINCT p.task_id) AS questions, count(p.row_id) AS answers,
           count(*) FILTER (p.y_true = 2) AS correct_answers
    FROM (SELECT DISTINCT task_id AS topic FROM presplit) t
    CROSS JOIN (VALUES ('train'), ('val'), ('test')) AS s(split)
    LEFT JOIN presplit p ON p.task_id = t.topic AND p.split = s.split
    GROUP BY ALL""",
)

QUERIES["K1_sorted_topics_and_tasks"] = (
    lambda s, d: v.answers(s, d).select("topic", "task_id").distinct().orderBy("topic", "task_id"),
    "WITH " + v.ANSWERS + " SELECT DISTINCT topic, task_id FROM answers ORDER BY topic, task_id",
)

QUERIES["K3_preview"] = (
    lambda s, d: v.answers(s, d).orderBy("row_id").limit(10).select("row_id", "task_id", "labels"),
    "WITH " + v.ANSWERS + " SELECT row_id, task_id, labels FROM answers ORDER BY row_id LIMIT 10",
)

QUERIES["K5_exact_sample"] = (
    lambda s, d: sp.exact_sample(v.answers(s, d), 0.1, "row_id", seed=24).select(
        "row_id", "task_id", "labels"
    ),
    "WITH " + v.ANSWERS + """
    SELECT row_id, task_id, labels FROM answers
    QUALIFY row_number() OVER (ORDER BY md5('24:' || row_id), row_id)
      <= floor(count(*) OVER () * 0.1::DOUBLE)""",
)

QUERIES["K5_exact_sample_of_documents"] = (
    lambda s, d: sp.exact_sample(v.table(s, d, "documents"), 0.37, "doc_id").select(
        "doc_id", F.length("text").alias("size")
    ),
    """SELECT doc_id, CAST(length(text) AS INTEGER) AS size FROM documents
    QUALIFY row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)
      <= floor(count(*) OVER () * 0.37::DOUBLE)""",
)

QUERIES["K6_seeded_shuffle"] = (
    lambda s, d: rk.hash_rank(
        v.answers(s, d).select("row_id", order_hash(F.col("row_id"), 42).alias("hashed")),
        [], "hashed", ["row_id"], name="place",
    ).select("row_id", "place"),
    "WITH " + v.ANSWERS + """
    SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS place FROM answers""",
)

QUERIES["K6_shuffle_inside_topic"] = (
    lambda s, d: rk.hash_rank(
        ds.task_label_counts(v.answers(s, d)).select(
            "task_id", "topic", order_hash(F.col("task_id"), 42).alias("hashed")
        ),
        ["topic"], "hashed", ["task_id"], name="place",
    ).select("task_id", "topic", "place"),
    "WITH " + ", ".join([v.ANSWERS, TASKS]) + """
    SELECT task_id, topic, row_number() OVER (PARTITION BY topic ORDER BY md5('42:' || task_id), task_id)
      AS place FROM tasks""",
)

QUERIES["K6_hash_uniform"] = (
    lambda s, d: v.answers(s, d).select("row_id", hash_uniform(F.col("row_id"), 7).alias("u")),
    "WITH " + v.ANSWERS + """
    SELECT row_id, ('0x' || substr(md5('7:' || row_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
    FROM answers""",
)
