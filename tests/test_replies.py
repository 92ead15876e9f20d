"""A table of replies: nothing is asked twice, across rows, runs and failures."""

import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from answerloom.operators import generation as gn, scoring as sc
from answerloom.operators.replies import ReplyStore
from answerloom.plans import evaluate

ANSWERS = "row_id long, row_no long, task_id string, topic string, question string, reference_answer string, student_answer string, y_true int"


def logged(folder, broken=()):
    """A row predictor that notes each answer it is asked about; class by length."""

    def make():
        path = os.path.join(folder, uuid.uuid4().hex)

        def predict(questions, answers, references):
            if any(a in broken for a in answers):
                raise ValueError("broken")
            with open(path, "a") as f:
                f.writelines(f"{q}|{a}|{r}\n" for q, a, r in zip(questions, answers, references))
            return [len(a) % 3 for a in answers]

        return predict

    return make


def asked(folder):
    return Counter(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)))


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return str(tmp_path / "log")


def answers(spark, n=300, distinct=40):
    # A third of all rows has the same answer.
    rows = [
        (k, k, f"t{k % 7}", "topic", "q", f"ref{k % 2}", "same" if k % 3 == 0 else f"answer {k % distinct}", k % 3)
        for k in range(n)
    ]
    return spark.createDataFrame(rows, ANSWERS).repartition(5)


def test_equal_inputs_are_asked_once_and_again_never(spark, tmp_path, log):
    store = ReplyStore(str(tmp_path / "store"), "m", calls_per_task=8)
    df = answers(spark)
    first = sc.score_rows(df, logged(log), store=store).collect()
    once = asked(log)
    assert set(once.values()) == {1} and len(once) < 100
    again = sc.score_rows(df, logged(log), store=store).collect()
    assert asked(log) == once and sorted(first) == sorted(again) and len(first) == 300
    plain = sc.score_rows(df, logged(str(tmp_path))).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, first))
    # Another model, or the same without references, asks for itself.
    sc.score_rows(df, logged(log), pass_reference=False, store=store).collect()
    assert sum(asked(log).values()) < 2 * sum(once.values()) and any("|None\n" in x for x in asked(log))
    sc.score_rows(df, logged(log), store=ReplyStore(store.path, "other")).collect()
    assert max(asked(log).values()) == 2


def test_a_job_that_dies_half_way_is_taken_up(spark, tmp_path, log):
    store = ReplyStore(str(tmp_path / "store"), "m", calls_per_task=4)
    df = answers(spark, 400, 200).coalesce(1)
    # Its task is none of the first.
    with pytest.raises(Exception, match="broken"):
        sc.score_rows(df, logged(log, broken=("answer 50",)), fail_on_error=True, store=store).collect()
    before = asked(log)
    kept = spark.read.parquet(store.path).count()
    assert 0 < kept
    got = sc.score_rows(df, logged(log), fail_on_error=True, store=store).collect()
    assert len(got) == 400 and all(r.y_pred is not None for r in got)
    # What committed tasks had asked is not asked again; what was under way may be.
    after = asked(log)
    repeated = sum(n - 1 for n in after.values())
    assert repeated <= sum(before.values()) - kept
    rows = spark.read.parquet(store.path)
    assert rows.count() == rows.select("_reply_key").distinct().count() == len(after)


def test_errors_are_kept_apart_and_asked_again(spark, tmp_path, log):
    store = ReplyStore(str(tmp_path / "store"), "m")
    df = answers(spark)
    got = sc.score_rows(df, logged(log, broken=("same",)), store=store).collect()
    assert {r.error is None for r in got if r.student_answer == "same"} == {False}
    assert {r.error is None for r in got if r.student_answer != "same"} == {True}
    mended = sc.score_rows(df, logged(log), store=store).collect()
    assert all(r.error is None and r.y_pred == len(r.student_answer) % 3 for r in mended)
    assert set(asked(log).values()) == {1}


def test_questions_through_a_store(spark, tmp_path):
    def predictor():
        return lambda question, given, reference: [len(a) % 3 for a in given][:-1]

    df = answers(spark)
    options = {"limit": 10, "carry": ("y_true",)}
    plain = sc.score_questions(df, predictor, **options).collect()
    store = ReplyStore(str(tmp_path / "store"), "m")
    stored = sc.score_questions(df, predictor, store=store, **options).collect()
    assert sorted(map(str, plain)) == sorted(map(str, stored))


def test_generated_answers_through_a_store(spark, tmp_path):
    def generator():
        draw = iter(range(10**6))
        return lambda label, question, reference: f"{label} {question} {next(draw)} {uuid.uuid4().hex}"

    tasks = spark.createDataFrame([(f"t{k}", f"q{k % 3}", "r", "x") for k in range(9)], "task_id string, question string, reference_answer string, topic string")
    store = ReplyStore(str(tmp_path / "store"), "m")
    runs = [sorted(map(str, gn.generate(tasks, {"correct": 2}, generator, "single", store=store).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 18
    texts = spark.read.parquet(store.path).selectExpr("reply[0] AS text").distinct().count()
    # Three questions, two draws each, which differ.
    assert texts == 6


def test_repeated_runs_ask_for_themselves_and_keep_all_metrics(spark, tmp_path, log):
    df = answers(spark)
    store = ReplyStore(str(tmp_path / "store"), "m")

    def run(folder):
        return evaluate.grade_repeatedly(
            df, logged(log), 2, str(tmp_path / folder), store=store, run_id="rep",
            metrics_path=str(tmp_path / "metrics"), confusion_path=str(tmp_path / "confusion"),
        )

    first = run("a")["statistics"].collect()
    assert set(asked(log).values()) == {2}
    assert run("b")["statistics"].collect() == first and set(asked(log).values()) == {2}
    metrics = spark.read.parquet(str(tmp_path / "metrics"))
    assert {r.run_id for r in metrics.select("run_id").distinct().collect()} == {"rep-1", "rep-2"}
    assert metrics.filter("run_id = 'rep-1' AND scope = 'topic'").count() > 0
    assert spark.read.parquet(str(tmp_path / "confusion")).select("run_id").distinct().count() == 2
