import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from answerloom.operators import generation as gn, scoring as sc

# Graders and generators below go to the workers as they are.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def answers(spark):
    """A hot question with 700 of 1,000 answers, small ones, and rows without a key."""
    n = F.col("id")
    return spark.range(1000).select(
        F.concat(F.lit("r"), n).alias("row_id"),
        n.alias("row_no"),
        F.when(n < 700, "hot").when(n < 990, F.concat(F.lit("t"), n % 60)).alias("task_id"),
        F.concat(F.lit("question "), n).alias("question"),
        F.concat(F.lit("reference "), n).alias("reference_answer"),
        F.concat(F.lit("answer "), n).alias("student_answer"),
    )


def test_groups_are_whole_and_bounded(answers):
    groups = sc.answer_groups(answers, limit=50).collect()
    assert max(len(g.members) for g in groups) <= 50
    seen = [m.row_id for g in groups for m in g.members]
    assert len(seen) == len(set(seen)) == 990
    for g in groups:
        numbers = [m.row_no for m in g.members]
        assert numbers == sorted(numbers)
        # Every group shows the question's first row.
        top = 0 if g.task_id == "hot" else numbers[0]
        assert g.question == f"question {top}" and g.reference_answer == f"reference {top}"
        if g.task_id == "hot":
            assert numbers == list(range(50 * g.part, 50 * g.part + 50))
    small = [g for g in groups if g.task_id != "hot"]
    assert len(small) == len({g.task_id for g in small}) == 60
    assert [len(g.members) for g in sc.answer_groups(answers, limit=1000).collect() if g.task_id == "hot"] == [700]


def echo():
    return lambda question, answers, reference: [int(a.split()[1]) % 3 for a in answers]


def test_question_scores_follow_their_rows(answers):
    for limit in (1000, 30):
        rows = sc.score_questions(answers, echo, limit=limit).collect()
        assert len(rows) == 1000
        for r in rows:
            expected = None if r.task_id is None else r.row_no % 3
            assert r.y_pred == expected


def short():
    return lambda question, answers, reference: [2] * 3


def test_short_and_long_label_lists(spark):
    df = spark.createDataFrame(
        [(i, i, "a" if i < 5 else "b", "q", "r", "x") for i in range(7)],
        "row_id int, row_no int, task_id string, question string, reference_answer string, student_answer string",
    )
    rows = {r.row_id: r.y_pred for r in sc.score_questions(df, short, limit=5).collect()}
    assert rows == {0: 2, 1: 2, 2: 2, 3: None, 4: None, 5: 2, 6: 2}


def fussy():
    def predict(questions, answers, references):
        if any(a.endswith("7") for a in answers):
            raise ValueError("seven")
        return [None if r is None else 1 for r in references]

    return predict


def test_row_errors_cost_only_their_rows(answers):
    rows = sc.score_rows(answers, fussy).collect()
    assert len(rows) == 1000
    for r in rows:
        bad = r.student_answer.endswith("7")
        assert (r.y_pred, r.error) == ((None, "ValueError: seven") if bad else (1, None))
    with pytest.raises(Exception, match="seven"):
        sc.score_rows(answers, fussy, fail_on_error=True).collect()
    hidden = sc.score_rows(answers, fussy, pass_reference=False)
    assert hidden.filter("y_pred IS NOT NULL").count() == 0


def counting(path):
    """Calls are counted in a file; one answer fails, another gets a label of a wrong type."""
    def make():
        def predict(questions, answers, references):
            with open(path, "a") as calls:
                calls.write("x")
            if "answer 77" in answers:
                raise ValueError("bad")
            return ["two" if a == "answer 500" else 1 for a in answers]

        return predict

    return make


def test_bad_rows_cost_few_calls(answers, tmp_path):
    path = str(tmp_path / "calls")
    rows = sc.score_rows(answers.coalesce(1), counting(path)).collect()
    assert {r.student_answer for r in rows if r.error} == {"answer 77", "answer 500"}
    assert sum(r.y_pred == 1 for r in rows) == 998
    assert len(open(path).read()) < 60


def broken():
    def predict(question, answers, reference):
        raise RuntimeError("down")

    return predict


def test_group_errors(answers):
    rows = sc.score(answers, broken, "per_question", limit=100).collect()
    assert len(rows) == 1000 and {r.y_pred for r in rows} == {None}
    assert {r.error for r in rows if r.task_id} == {"RuntimeError: down"}
    with pytest.raises(Exception, match="down"):
        sc.score(answers, broken, "per_question", limit=100, fail_on_error=True).collect()


def test_mode_is_checked(answers):
    with pytest.raises(ValueError):
        sc.score(answers, echo, "all")
    with pytest.raises(ValueError):
        gn.generate(answers, {}, echo, "none")


def test_model_inputs_without_columns(spark):
    df = spark.createDataFrame([("q", 1)], "question string, labels int")
    assert sc.model_inputs(df, include_reference=True).collect() == [(1, "Question: q\nAnswer: ")]


@pytest.fixture(scope="module")
def tasks(spark):
    return spark.range(7).select(
        F.col("id").alias("task_id"),
        F.concat(F.lit("q"), "id").alias("question"),
        F.concat(F.lit("ref"), "id").alias("reference_answer"),
        F.lit("topic").alias("topic"),
    )


QUOTAS = {"correct": 2, "partial": 1, "incorrect": 0}


def sees():
    def generate(label, question, reference):
        if question == "q3":
            raise ValueError("no")
        return f"{label}:{question}:{reference}"

    return generate


def test_single_mode_meets_quotas(tasks):
    out = gn.accepted(gn.generate(tasks, QUOTAS, sees, "single"))
    assert gn.count_violations(out, tasks, QUOTAS).count() == 0
    given = {(r.task_id, r.labels, r.student_answer) for r in out.collect()}
    assert (1, "correct", "correct:q1:ref1") in given
    assert (3, "correct", "ref3") in given
    assert (3, "partial", "Partial answer 1 for question 3") in given
    totals = {r.label: (r.expected, r.actual) for r in gn.label_totals(out, tasks, QUOTAS).collect()}
    assert totals == {"correct": (14, 14), "partial": (7, 7), "incorrect": (0, 0), "total": (21, 21)}


def test_reference_is_hidden_by_policy(tasks):
    out = gn.generate(tasks, {"incorrect": 1}, sees, "single").filter("task_id = 1").first()
    assert out.student_answer == "incorrect:q1:None" and out.reference_answer == "ref1"
    shown = gn.generate(tasks, {"incorrect": 1}, sees, "single", pass_reference={"incorrect": True})
    assert shown.filter("task_id = 1").first().student_answer == "incorrect:q1:ref1"


def uneven():
    def generate(label, question, reference, count):
        if question == "q0":
            raise ValueError("no")
        return [question] * (int(question[1:]))

    return generate


def test_per_question_mode_rejects_short_replies(tasks):
    out = gn.generate(tasks, {"correct": 3}, uneven, "per_question")
    reasons = {r.task_id: r.reject_reason for r in gn.rejected(out).collect()}
    assert reasons == {
        0: "ValueError: no", 1: "expected 3 answers, got 1", 2: "expected 3 answers, got 2",
    }
    kept = gn.accepted(out)
    assert kept.count() == 12
    violations = {(r.task_id, r.actual) for r in gn.count_violations(kept, tasks, {"correct": 3}).collect()}
    assert violations == {(0, 0), (1, 0), (2, 0)}


def listing():
    return lambda label, questions, references, count: [f"{q}/{i}" for q in questions for i in range(count)]


def missing():
    return lambda label, questions, references, count: [q for q in questions for _ in range(count)][:-1]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_batched_mode_cuts_question_by_question(tasks, size):
    out = gn.generate(tasks, {"correct": 2}, listing, "all", tasks_per_call=size)
    rows = sorted((r.task_id, r.student_answer) for r in gn.accepted(out).collect())
    assert rows == [(t, f"q{t}/{i}") for t in range(7) for i in range(2)]


def test_batched_mode_keeps_what_a_short_reply_holds(tasks):
    out = gn.generate(tasks, {"correct": 2}, missing, "all", tasks_per_call=50)
    assert {r.reject_reason for r in out.collect()} == {"expected 14 answers, got 13"}
    assert gn.accepted(out).count() == 13
    assert gn.count_violations(gn.accepted(out), tasks, {"correct": 2}).count() == 1


def test_split_flat(spark):
    df = spark.createDataFrame([(["a", "b"], ["1", "2", "3"])], "ids array<string>, flat array<string>")
    rows = [(r.task_id, r.answers, r.length_ok) for r in gn.split_flat(df, "ids", "flat", 2).collect()]
    assert rows == [("a", ["1", "2"], False), ("b", ["3"], False)]
    assert [r.answers for r in gn.split_flat(df, "ids", "flat", 0).collect()] == [[], []]
