"""Round trips through readers and writers (S1 to S10, X3) and training."""

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from answerloom import schemas
from answerloom.catalog import metric_queries, split_queries, text_queries, views as v
from answerloom.functions.labels import strict_label
from answerloom.operators import confusion as cm, metrics as mt, training as tr
from answerloom.operators.scoring import model_inputs
from answerloom.operators.split import split_by_task, with_split
from answerloom.plans import grid
from answerloom.session import scratch_path
from answerloom.sources import readers, writers

QUERIES = {}


def _texts(spark, folder):
    """Question and answer pairs as an answers table, with quotes and separators."""
    return v.pairs(spark, folder).select(
        F.col("row_id").alias("task_id"),
        F.concat(F.lit('He said "a;b";\n'), "question").alias("question"),
        "reference_answer",
        F.lit("quiz").alias("topic"),
        "student_answer",
        F.lit("partial").alias("labels"),
    )


_TEXTS = v.PAIRS + """, texts AS (
  SELECT row_id AS task_id, 'He said "a;b";' || chr(10) || question AS question, reference_answer,
         'quiz' AS topic, student_answer, 'partial' AS labels FROM pairs)"""


def _csv_round_trip(spark, folder):
    path = scratch_path(spark, "answers-csv")
    writers.semicolon_csv(_texts(spark, folder), path)
    return readers.semicolon_csv(spark, path, schemas.ANSWERS)


QUERIES["S1_S7_semicolon_csv"] = (_csv_round_trip, "WITH " + _TEXTS + " SELECT * FROM texts")


# Rows of the table a large file is made of. Larger tables give several such files, as a file is written by one task.
ROWS_PER_FILE = 1_000_000


def _files(rows):
    return 1 + rows.count() // ROWS_PER_FILE


def _split_csv(spark, folder):
    """The same table in large files, read in byte ranges."""
    path = scratch_path(spark, "answers-one-csv")
    files = _files(v.table(spark, folder, "conversations"))
    # Dealt out, not coalesced, which would join the whole table in the tasks that write.
    writers.semicolon_csv(_texts(spark, folder).repartition(files, "task_id"), path)
    return readers.split_csv(spark, path, schemas.ANSWERS)


QUERIES["S1_split_csv"] = (_split_csv, "WITH " + _TEXTS + " SELECT * FROM texts")

_EXPORT = T.StructType(
    [
        T.StructField("Run", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("quadratic_weighted_kappa", T.StringType()),
    ]
)


def _export_round_trip(spark, folder):
    path = scratch_path(spark, "runs-csv")
    rows = v.runs(spark, folder).select(
        F.col("run").alias("Run"), "seed",
        F.when(F.col("run").startswith("lora"), F.col("metric")).alias("quadratic_weighted_kappa"),
    )
    rows.write.csv(path, header=True, quote='"', escape='"')
    return readers.comma_csv(spark, path, _EXPORT).withColumn(
        "quadratic_weighted_kappa", F.col("quadratic_weighted_kappa").cast("double")
    )


QUERIES["S2_comma_csv_with_empties"] = (
    _export_round_trip,
    "WITH " + v.RUNS + """ SELECT run AS Run, seed, CASE WHEN run LIKE 'lora%' THEN metric END
      AS quadratic_weighted_kappa FROM runs""",
)


def _task_json(spark, folder):
    path = scratch_path(spark, "tasks-json")
    options = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            line.alias("answer"), F.contains(line, F.lit(",")).alias("is_correct")
        ),
    )
    rows = v.table(spark, folder, "conversations").select(
        "role", F.concat_ws("-", "conv_id", "turn").alias("question"), options.alias("answer_options")
    )
    rows.write.partitionBy("role").json(path)
    return readers.tasks_of_json(readers.task_json(spark, path, multi_line=False, topic="role"))


QUERIES["S3_task_json_folder"] = (
    _task_json,
    """SELECT conv_id || '-' || turn AS question,
         coalesce(list_filter(string_split(text, chr(10)), lambda l: contains(l, ','))[1],
                  string_split(text, chr(10))[1]) AS reference_answer, role AS topic
       FROM conversations""",
)


def _grades(spark, folder):
    path = scratch_path(spark, "grades-json")
    grades = F.create_map(F.concat(F.lit("sentences_"), "letter"), "points")
    lines = v.subtask_points(spark, folder).select(
        F.to_json(F.create_map(F.col("participant").cast("string"), grades)).alias("value")
    )
    lines.write.text(path)
    return readers.grades_json(spark, path, whole_file=False)


QUERIES["S4_grades_json"] = (
    _grades,
    "WITH " + v.SUBTASK_POINTS + """
    SELECT CAST(participant AS VARCHAR) AS participant, 'sentences_' || letter AS subtask, points
    FROM subtask_points""",
)


def _one_object(batches):
    """Members of a JSON object as its lines: braces around all of them, commas between."""
    opening = "{"
    for batch in batches:
        if batch.num_rows:
            first, *others = batch.column("member").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([opening + first, *["," + x for x in others]])], ["value"])
            opening = ","
    yield pa.RecordBatch.from_arrays([pa.array(["{}" if opening == "{" else "}"])], ["value"])


def _grades_in_one_object(spark, folder):
    """All participants of a large file in one JSON object, read in byte ranges."""
    path = scratch_path(spark, "grades-one-json")
    grades = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("sentences_"), "letter"), "points")))
    people = v.subtask_points(spark, folder).groupBy("participant").agg(grades.alias("g"))
    member = F.regexp_replace(F.to_json(F.create_map(F.col("participant").cast("string"), "g")), r"^\{|\}$", "")
    files = _files(v.table(spark, folder, "lineitem"))
    people.select(member.alias("member")).repartition(files, "member").mapInArrow(_one_object, "value string").write.text(path)
    return readers.split_grades_json(spark, path)


QUERIES["S4_split_grades_json"] = (_grades_in_one_object, QUERIES["S4_grades_json"][1])


def _presplit(spark, folder):
    path = scratch_path(spark, "presplit")
    rows = v.presplit(spark, folder).select(
        F.col("task_id").cast("bigint").alias("task_id"), "topic", "labels", "split"
    )
    rows.write.partitionBy("split").parquet(path)
    loaded = readers.splits(
        spark.read.parquet,
        {"train": f"{path}/split=train", "val": f"{path}/split=val", "test": f"{path}/split=test"},
    )
    return loaded.select("task_id", "topic", strict_label(F.col("labels")).alias("labels"), "split")


QUERIES["S5_X3_presplit_load"] = (
    _presplit,
    "WITH " + v.PRESPLIT + " SELECT task_id, topic, y_true AS labels, split FROM presplit",
)


def _without_test(spark, folder):
    path = scratch_path(spark, "presplit")
    writers.by_split(v.presplit(spark, folder).select("row_id", "task_id", "split"), path)
    return readers.splits(
        spark.read.parquet,
        {"train": f"{path}/split=train", "val": f"{path}/split=val", "test": None},
    )


QUERIES["S5_load_without_test_set"] = (
    _without_test,
    "WITH " + v.PRESPLIT + " SELECT row_id, task_id, split FROM presplit WHERE split <> 'test'",
)


def _corpus(spark, folder):
    path = scratch_path(spark, "corpus")
    rows = text_queries.raw_labels(spark, folder, text_queries.FIVE_WAY).select(
        F.col("row_id").alias("id"),
        F.lit("q").alias("question"),
        F.lit("r").alias("reference_answer"),
        F.concat(F.lit("a"), "row_id").alias("student_answer"),
        F.col("labels").alias("label"),
        F.when(F.col("labels") == "irrelevant", "test_ud").otherwise("train").alias("split"),
    )
    rows.write.partitionBy("split").parquet(path)
    return readers.corpus(
        spark.read.parquet, {x: f"{path}/split={x}" for x in ("train", "test_ud")}
    )


QUERIES["S6_corpus_import"] = (
    _corpus,
    """SELECT CAST(o_orderkey AS VARCHAR) AS task_id, 'q' AS question, 'r' AS reference_answer,
         'scientsbank' AS topic, 'a' || o_orderkey AS student_answer,
         CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END AS labels,
         CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'test_ud' ELSE 'train' END AS split
       FROM orders""",
)


def _split_dump(spark, folder):
    path = scratch_path(spark, "splits")
    writers.by_split(v.presplit(spark, folder).select("row_id", "labels", "split"), path)
    return spark.read.parquet(path).filter("split = 'val'").select("row_id", "labels")


QUERIES["S8_split_dump_read_one_split"] = (
    _split_dump,
    "WITH " + v.PRESPLIT + " SELECT row_id, labels FROM presplit WHERE split = 'val'",
)


def _appended(spark, folder):
    path = scratch_path(spark, "answers")
    rows = v.answers(spark, folder).select("row_id", "task_id", "labels")
    writers.to_parquet(rows, path)
    writers.append(rows.withColumn("row_id", -F.col("row_id") - 1), path)
    return spark.read.parquet(path)


QUERIES["S9_append_to_answers"] = (
    _appended,
    "WITH " + v.ANSWERS + """ SELECT row_id, task_id, labels FROM answers
    UNION ALL SELECT -row_id - 1, task_id, labels FROM answers""",
)


def _metric_sink(spark, folder):
    path = scratch_path(spark, "metrics")
    report = mt.long_report(v.answers(spark, folder)).withColumn("value", F.round("value", 9))
    for run in ("first", "second", "first"):
        writers.metrics(writers.with_run(report, run), path)
    stored = spark.read.schema(schemas.METRICS).parquet(path)
    return stored.groupBy("run_id", "scope", "metric").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")
    )


QUERIES["S10_metric_sink"] = (
    _metric_sink,
    "SELECT run_id, scope, metric, count(*) AS n, round(sum(value), 6) AS total FROM ("
    + metric_queries.QUERIES["D9_metrics_long"][1]
    + "), (VALUES ('first'), ('second')) AS r(run_id) GROUP BY run_id, scope, metric",
)


def _labelled_documents(spark, folder):
    """Labelled documents: good and clean is correct, one of both partial.

    Every document is its own task, its language the topic; splits are the
    balanced ones.
    """
    labels = v.table(spark, folder, "labels")
    label = (F.col("quality") + (1 - F.col("toxic"))).cast("int")
    tasks = labels.join(
        v.table(spark, folder, "documents").select("doc_id", "lang", "source", "text"), "doc_id"
    ).select(
        F.col("doc_id").cast("string").alias("task_id"),
        F.col("lang").alias("topic"),
        F.col("source").alias("question"),
        F.col("text").alias("student_answer"),
        label.alias("labels"),
        label.alias("y_true"),
    )
    assigned = with_split(tasks, split_by_task(tasks.select("task_id", "topic", "y_true")))
    path = scratch_path(spark, "labelled")
    writers.by_split(model_inputs(assigned, keep=("task_id", "labels", "topic", "split")), path)
    return spark.read.parquet(path)


# The same split in SQL: documents are tasks, languages topics.
_LABELLED = """answers AS (
  SELECT CAST(doc_id AS VARCHAR) AS task_id, lang AS topic, CAST(quality + 1 - toxic AS INTEGER) AS y_true
  FROM labels JOIN documents USING (doc_id))"""
_LABELLED_SPLIT = ", ".join([_LABELLED, split_queries.TASKS, split_queries.QUOTA, split_queries.BALANCED])


def _trained(spark, folder):
    """What is determined of a trained model's report: whom it was tested on, and that it learned something."""
    rows = _labelled_documents(spark, folder)
    model = tr.train(rows.filter("split = 'train'"), features=1 << 12, iterations=10)
    counts = cm.cells(tr.predict(model, rows.filter("split = 'test'")), ["topic"])
    scopes = cm.with_marginals(cm.with_overall(counts, "topic")).join(
        mt.summary(cm.with_overall(counts, "topic"), ["scope", "key"]).select("scope", "key", "accuracy"), ["scope", "key"]
    )
    most = F.greatest("support_0", "support_1", "support_2") / F.col("rows")
    # Overall it has to beat the most frequent class; small languages need not.
    return scopes.select(
        "scope", "key", F.col("rows").alias("support"), "scored",
        ((F.col("accuracy") >= most) | (F.col("scope") != "overall")).alias("beats_naive"),
    )


QUERIES["T1_train_and_evaluate"] = (
    _trained,
    "WITH " + _LABELLED_SPLIT + """, test AS (
      SELECT a.topic FROM answers a JOIN assigned USING (task_id) WHERE split = 'test')
    SELECT CASE WHEN grouping(topic) = 1 THEN 'overall' ELSE 'topic' END AS scope, coalesce(topic, 'overall') AS key,
           count(*) AS support, count(*) AS scored, true AS beats_naive
    FROM test GROUP BY ROLLUP (topic)""",
)


def _tuned(spark, folder):
    """The grid plan on the given splits; what is determined of its rows and choices."""
    rows = _labelled_documents(spark, folder)
    out = grid.search(
        rows.filter("split = 'train'"), rows.filter("split = 'val'"), regularization=[0.001, 0.1], iterations=[5, 10],
        seeds=[1, 2], fraction=0.9, key="task_id", path=scratch_path(spark, "grid"), features=1 << 12,
    )
    best = out["best_per_seed"].select("seed", F.col("combination_idx").alias("best"), F.col("metric_value").alias("top"))
    overall = out["best"].select(F.col("metric_value").alias("m")).first().m
    return out["rows"].join(best, "seed").select(
        F.col("seed").cast("int").alias("seed"), "combination_idx", "params", "support",
        (F.col("metric_value") <= F.col("top")).alias("not_above_best"), (F.col("top") <= overall).alias("seed_not_above_best"),
    )


QUERIES["T2_grid_on_validation_split"] = (
    _tuned,
    "WITH " + _LABELLED_SPLIT + """, val AS (
      SELECT count(*) AS n FROM answers JOIN assigned USING (task_id) WHERE split = 'val')
    SELECT CAST(seed AS INTEGER) AS seed, CAST(combination_idx AS INTEGER) AS combination_idx, params, n AS support,
           true AS not_above_best, true AS seed_not_above_best
    FROM val, (VALUES (1), (2)) AS s(seed), (VALUES (1, 'regParam=0.001, maxIter=5'), (2, 'regParam=0.001, maxIter=10'),
      (3, 'regParam=0.1, maxIter=5'), (4, 'regParam=0.1, maxIter=10')) AS g(combination_idx, params)""",
)


def _params(spark, folder):
    """Parameters of two runs, the first stored twice."""
    path = scratch_path(spark, "params")
    for run in ("first", "second", "first"):
        n = v.table(spark, folder, "nation").count()
        writers.params(
            spark, run, {"model": {"name": "m", "output_dir": "x", "layers": n}, "direction": "up"}, path, ("_dir",)
        )
    return spark.read.parquet(path)


QUERIES["S10_params_sink"] = (
    _params,
    """SELECT run_id, param, value FROM (VALUES ('first'), ('second')) AS r(run_id),
       (SELECT 'model.name' AS param, 'm' AS value UNION ALL SELECT 'direction', 'up'
        UNION ALL SELECT 'model.layers', CAST(count(*) AS VARCHAR) FROM nation)""",
)
