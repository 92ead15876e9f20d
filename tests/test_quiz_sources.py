import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from answerloom import fixed_values as fv, schemas
from answerloom.functions.text import decimal_comma
from answerloom.operators import leaderboard as ld, quiz as qz, reshape as rs
from answerloom.plans import build_split, evaluate, quiz_import, synthesize
from answerloom.sources import readers, writers

# Graders and generators below go to the workers as they are.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_keep_group(values):
    names = [None, "Ada", "Quiz Group 2", "Quiz Group 3", "Quiz Group 9", "Quiz Group 10",
             "Quiz Group 27", "Quiz Group 28", "Quiz Group 007", "Quiz Group x", "The Quiz Group 5",
             "Quiz Group 99999999999999999999"]
    kept = values(qz.keep_group, names)
    assert kept == [True, True, True, False, False, True, True, False, False, True, True, False]


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([("u", 0, "x"), ("u", 1, "s"), ("v", 2, "y")], "u string, t int, r string")
    wide = rs.pivot_wide(df, "u", "t", "r", {0: "a", 2: "c"})
    assert sorted(map(tuple, wide.collect())) == [("u", "x", None), ("v", None, "y")]
    with pytest.raises(Exception, match="duplicate a for u"):
        rs.pivot_wide(df.unionByName(df), "u", "t", "r", {0: "a"}).collect()


def quiz_tables(spark):
    raw = spark.createDataFrame(
        [
            ("Group A", 'a. True/False, because ...<br />no b. <span style="color:rgb(0,0,0);">x</span>', "-",
             "a. one</p><p>b. two e.g. that c. three", "-"),
            ("Quiz Group 5", "a. dropped", "-", "a. dropped", "-"),
            ("Group B", None, "-", "h. last a. not cut", "-"),
        ],
        f"{fv.QUIZ_PARTICIPANT} string, `1. Sentences` string, `2. Validity and Soundness (I)` string, "
        "`3. Validity and Soundness (II)` string, `4. Arguments` string",
    )
    points = spark.createDataFrame(
        [("Group B", "6", "", "8,0", "", "14"), ("Group A", "5,5", "", "7", "", "1"),
         ("Quiz Group 5", "6", "", "8", "", "14")],
        f"{fv.QUIZ_PARTICIPANT} string, `1. Sentences` string, `2. Validity and Soundness (I)` string, "
        "`3. Validity and Soundness (II)` string, `4. Arguments` string, Summe string",
    )
    remarks = spark.createDataFrame(
        [("Group A", 0, "&amp;lt;b&amp;gt;</p><p>ok"), ("Group A", 1, "unused"), ("Group A", 2, "fine")],
        schemas.REMARKS,
    )
    letters = [("sentences ", x) for x in "abcdef"] + [("validity_and_soundness", x) for x in "abcdefgh"]
    tasks = spark.createDataFrame(
        [(i, kind, f"{kind.strip()} {x}?", f"ref {x}") for i, (kind, x) in enumerate(letters)]
        + [(99, "other", "?", "-")],
        "n int, task string, question string, answer string",
    )
    grades = spark.createDataFrame(
        [("Group A", "sentences_a", 0.5), ("Group A", "validity_and_soundness_h", 0.0),
         ("Group A", "sentences_b", 0.25)],
        "participant string, subtask string, points double",
    )
    return raw, points, remarks, tasks, grades


def test_quiz_import(spark, tmp_path):
    raw, points, remarks, tasks, grades = quiz_tables(spark)
    out = quiz_import.import_quiz(raw, points, remarks, tasks, grades, ["n"])
    merged = {r.participant: r for r in out["merged"].collect()}
    assert merged["Group A"].sentences_points == 5.5
    assert merged["Group A"].sentences_remarks == "<b><br />ok"
    assert merged["Group B"].sentences_remarks is None
    assert out["key_mismatches"].count() == 0
    assert {r.participant for r in out["ungraded"].collect()} == {"Group B", "Quiz Group 5"}
    wrong = {(r.participant, r.section, r.calculated, r.expected) for r in out["point_mismatches"].collect()}
    assert wrong == {("Group A", "sentences", 4.75, 5.5)}
    subtasks = {r.participant: r for r in out["subtasks"].collect()}
    assert subtasks["Group A"].validity_and_soundness_a == "one"

    long = out["long"]
    rows = {(r.student, r.task): r for r in long.collect()}
    assert len(rows) == 2 * 14
    first = rows[("Group A", "sentences_a")]
    assert first.student_answer == "True/False, because ... no"
    assert (first.points, first.question, first.reference_answer) == (0.5, "sentences a?", "ref a")
    assert rows[("Group A", "sentences_b")].student_answer == "x"
    assert rows[("Group A", "validity_and_soundness_b")].student_answer == "two e.g. that"
    assert rows[("Group B", "validity_and_soundness_h")].student_answer == "last a. not cut"
    assert rows[("Group B", "sentences_a")].student_answer == ""
    early = quiz_import.import_quiz(raw, points, remarks, tasks, grades, ["n"], strip_prefix_first=True)
    assert early["long"].filter("student = 'Group A' AND task = 'sentences_a'").first().student_answer == "no"

    table, rejects = str(tmp_path / "answers"), str(tmp_path / "rejects")
    existing = spark.createDataFrame([("7", "q", "r", "t", "a", "1")], schemas.ANSWERS)
    writers.batch(existing, "start", table)
    for _ in range(2):  # the second import replaces the first
        quiz_import.append_to_answers(long, spark.read.parquet(table), table, rejects, "first")
    stored = spark.read.parquet(table)
    assert stored.count() == 1 + 27
    assert {r.task_id for r in stored.collect()} == {"7"} | {str(8 + i) for i in range(14)}
    bad = spark.read.parquet(rejects).collect()
    assert [(r.reject_reason, r.topic) for r in bad] == [("points", "sentences")]


def test_key_mismatches(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert {tuple(r) for r in rs.key_mismatches(left, right, "k").collect()} == {
        (2, 2, 1), (3, 0, 1), (None, 1, 0),
    }


def test_header_rows(spark):
    df = spark.createDataFrame([("task",), ("a",), (None,)], "task string")
    assert {r.task for r in qz.drop_header_rows(df).collect()} == {"a", None}


def test_semicolon_csv_keeps_quotes_breaks_and_nulls(spark, tmp_path):
    row = ("1", 'say "a;b"\nnext', None, "t", "", "correct")
    path = str(tmp_path / "csv")
    writers.semicolon_csv(spark.createDataFrame([row], schemas.ANSWERS), path)
    # Empty fields are NULL, quoted or not.
    expected = tuple(x or None for x in row)
    assert [tuple(r) for r in readers.semicolon_csv(spark, path, schemas.ANSWERS).collect()] == [expected]
    hand = tmp_path / "hand.csv"
    hand.write_text('task_id;question;reference_answer;topic;student_answer;labels\n3;"a;b";;t;"x ""y""";1.0\n')
    assert [tuple(r) for r in readers.semicolon_csv(spark, str(hand), schemas.ANSWERS).collect()] == [
        ("3", "a;b", None, "t", 'x "y"', "1.0")
    ]


def test_comma_csv(spark, tmp_path):
    path = tmp_path / "runs.csv"
    path.write_text('Run,quadratic_weighted_kappa\n"a,b",0.5\nc,\n')
    df = readers.comma_csv(spark, str(path), "Run string, quadratic_weighted_kappa string")
    rows = ld.drop_incomplete(
        df.withColumn("k", decimal_comma(F.col("quadratic_weighted_kappa"))), ["k"]
    ).collect()
    assert [(r.Run, r.k) for r in rows] == [("a,b", 0.5)]


def test_task_json(spark, tmp_path):
    (tmp_path / "logic.json").write_text(
        json.dumps(
            [
                {"question": "q1", "answer_options": [{"answer": "x"}, {"answer": "y", "is_correct": True}]},
                {"question": "q2", "answer_options": None},
                {"answer_options": [{"answer": "z", "is_correct": False}]},
                {"question": "q4", "answer_options": [{"answer": "x", "is_correct": 0},
                                                      {"answer": "y", "is_correct": 1}]},
            ],
            indent=1,
        )
    )
    (tmp_path / "a.b.json").write_text(json.dumps([{"question": "q3"}]))
    (tmp_path / "notes.txt").write_text("[]")
    rows = readers.tasks_of_json(readers.task_json(spark, str(tmp_path))).collect()
    assert {tuple(r) for r in rows} == {
        ("q1", "y", "logic"), ("q4", "y", "logic"), ("q2", "", "logic"), ("", "z", "logic"), ("q3", "", "a.b"),
    }


def test_grades_json(spark, tmp_path):
    path = tmp_path / "grades.json"
    path.write_text(json.dumps({"Group A": {"sentences_a": 0.5, "x": 1}, "B": {}}, indent=2))
    rows = {tuple(r) for r in readers.grades_json(spark, str(path)).collect()}
    assert rows == {("Group A", "sentences_a", 0.5), ("Group A", "x", 1.0)}


def test_splits_harmonise_ids(spark):
    tables = {
        "a": spark.createDataFrame([(1, "x")], "task_id int, topic string"),
        "b": spark.createDataFrame([("t2", "y")], "task_id string, topic string"),
    }
    rows = readers.splits(tables.get, {"train": "a", "val": "b", "test": None}).collect()
    assert {tuple(r) for r in rows} == {("1", "x", "train"), ("t2", "y", "val")}
    with pytest.raises(ValueError):
        readers.splits(tables.get, {"train": None})


def test_metric_sink_replaces_a_run(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for run, value in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        row = spark.createDataFrame([(run, "overall", "overall", "m", value)], schemas.METRICS)
        writers.metrics(row, path)
    stored = spark.read.schema(schemas.METRICS).parquet(path)
    assert {(r.run_id, r.value) for r in stored.collect()} == {("a", 3.0), ("b", 2.0)}
    params = str(tmp_path / "params")
    writers.params(spark, "a", {"lora": {"r": 8}, "output": {"dir": "x"}, "seed": 42}, params, ("dir",))
    assert {(r.param, r.value) for r in spark.read.parquet(params).collect()} == {("lora.r", "8"), ("seed", "42")}


def test_leaderboard_rules(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.5), (1, 2, 0.7), (1, 3, 0.7), (2, 1, None), (2, 2, float("nan")), (2, 3, 0.1)],
        "seed int, idx int, m double",
    )
    best = {r.seed: (r.idx, r.m) for r in ld.best_runs(df, ["seed"], "m", "idx").collect()}
    assert best == {1: (2, 0.7), 2: (3, 0.1)}
    low = {r.seed: r.idx for r in ld.best_runs(df, ["seed"], "m", "idx", minimize=True).collect()}
    assert low == {1: 1, 2: 3}
    stats = {r.idx: r.std_m for r in ld.group_stats(df.filter("seed = 1"), ["idx"], "m").collect()}
    assert stats == {1: 0.0, 2: 0.0, 3: 0.0}
    same = ld.normalize(spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double"), ["a", "b"])
    assert [(r.a_norm, r.b_norm) for r in same.collect()] == [(0.5, 0.0), (0.5, 1.0)]


def grader():
    return lambda questions, answers, references: [len(a) % 3 for a in answers]


def question_grader():
    return lambda question, answers, reference: [len(a) % 3 for a in answers]


@pytest.mark.parametrize("mode, make", [("single", grader), ("per_question", question_grader)])
def test_evaluation_plan(spark, tmp_path, mode, make):
    answers = spark.createDataFrame(
        [(i, str(i // 4), "q", "r", "t%d" % (i % 2), "x" * i, ["incorrect", "partial", "correct"][i % 3])
         for i in range(24)],
        "row_id int, task_id string, question string, reference_answer string, topic string, "
        "student_answer string, labels string",
    )
    path = str(tmp_path / "metrics")
    report = evaluate.grade_and_measure(
        answers, make, "run1", path, mode=mode, question_limit=100 if mode == "per_question" else None,
        params={"seed": 1}, params_path=str(tmp_path / "params"), confusion_path=str(tmp_path / "confusion"),
    )
    assert spark.read.parquet(str(tmp_path / "params")).count() == 1
    assert spark.read.parquet(str(tmp_path / "confusion")).count() == 9
    values = {(r.scope, r.key, r.metric): r.value for r in report.collect()}
    assert values[("overall", "overall", "accuracy")] == 1.0
    assert values[("overall", "overall", "support")] == 24
    assert values[("topic", "t1", "support")] == 12
    assert ("overall", "overall", "macro_f1_random") in values


def test_split_plan(spark, tmp_path):
    answers = spark.range(600).select(
        F.col("id").alias("row_id"), (F.col("id") % 50).cast("string").alias("task_id"),
        F.concat(F.lit("t"), F.col("id") % 2).alias("topic"),
        F.element_at(F.array(*[F.lit(x) for x in fv.LABEL_NAMES]), (F.col("id") % 3 + 1).cast("int")).alias("labels"),
    )
    reports = build_split.split_answers(answers, str(tmp_path / "splits"))
    assert {r.shared_tasks for r in reports["overlaps"].collect()} == {0}
    assert reports["topic_conflicts"].count() == 0
    total = reports["statistics"].filter("level = 'GRAND TOTAL'").first()
    assert (total.questions, total.answers) == (50, 600)


def maker():
    return lambda label, question, reference, count: [f"{label}{i}" for i in range(count)]


def failing():
    return lambda label, question, reference, count: []


def test_synthesis_plan(spark, tmp_path):
    tasks = spark.createDataFrame(
        [("1", "q", "r", "t"), ("2", "p", "s", "t")],
        "task_id string, question string, reference_answer string, topic string",
    )
    quotas = {"correct": 3, "partial": 3, "incorrect": 3}
    out = synthesize.generate_answers(tasks, quotas, maker, "per_question", str(tmp_path / "ok"))
    assert out["answers"].count() == 18 and out["violations"].count() == 0
    with pytest.raises(ValueError, match="0 'correct' answers instead of 3|instead of 3"):
        synthesize.generate_answers(tasks, quotas, failing, "per_question", str(tmp_path / "bad"))


def wavering():
    return lambda questions, answers, references: [len(a) % 2 for a in answers]


def test_repeated_runs(spark, tmp_path):
    answers = spark.createDataFrame(
        [(i, "q", "r", "x" * i, i % 2) for i in range(10)],
        "row_id int, question string, reference_answer string, student_answer string, y_true int",
    )
    out = evaluate.grade_repeatedly(answers, wavering, 3, str(tmp_path / "runs"))
    row = out["statistics"].first()
    assert out["failed"].count() == 0
    assert (row.mean_quadratic_weighted_kappa, row.std_quadratic_weighted_kappa) == (1.0, 0.0)
    assert row.n_quadratic_weighted_kappa == 3
    models = answers.select("y_true", F.lit("m").alias("model"), F.col("y_true").alias("y_pred"))
    assert evaluate.measure_models(models).first().accuracy == 1.0


def failing_once(path):
    """The first run's grader raises, later ones work."""
    def make():
        import os

        if not os.path.exists(path):
            open(path, "w").close()
            raise RuntimeError("no connection")
        return lambda questions, answers, references: [0] * len(answers)

    return make


def test_a_failed_run_is_reported(spark, tmp_path):
    answers = spark.createDataFrame(
        [(i, "q", "r", "x", 0) for i in range(5)],
        "row_id int, question string, reference_answer string, student_answer string, y_true int",
    ).coalesce(1)
    out = evaluate.grade_repeatedly(answers, failing_once(str(tmp_path / "up")), 3, str(tmp_path / "runs"), "accuracy")
    assert [r.run for r in out["failed"].collect()] == [1]
    assert out["statistics"].first().n_accuracy == 2


def test_repeated_keys_are_errors(spark):
    from answerloom.operators import reshape as rs

    twice = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "k int, points double")
    once = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    for left, right in ((twice, once), (once, twice)):
        with pytest.raises(Exception, match="duplicate k: 1"):
            rs.join_by_key(left, right, "k").collect()
    with pytest.raises(Exception, match="duplicate k: 1"):
        rs.overlay(once, twice, ["k"], "points", 0.0).collect()
    assert rs.join_by_key(once, twice.filter("points < 3"), "k").count() == 2
    missing = spark.createDataFrame([(1, None), (1, None)], "k int, points double")
    totals = spark.createDataFrame([(1, 3.0)], "k int, total double")
    assert rs.sum_mismatches(missing, totals, ["k"]).first().calculated == 0.0


def test_scratch_tables_can_be_removed(spark):
    import os

    from answerloom import session

    kept = session.settle(spark.range(3))
    path = next(p for p in reversed(session._written[spark.sparkContext.applicationId]))
    assert kept.count() == 3 and os.path.isdir(path)
    others = session._written[spark.sparkContext.applicationId][:-1]
    session._written[spark.sparkContext.applicationId] = [path]
    assert session.clear_scratch(spark) == 1 and not os.path.exists(path)
    session._written[spark.sparkContext.applicationId] = others
