"""Grading answers with a predictor supplied by the caller.

A predictor is made once per task by `make_predictor()`. Row predictors are
called as predict(questions, answers, references) on the lists of one Arrow
batch and return one label per row; question predictors are called as
predict(question, answers, reference) on one batch of answers to the same
question. References are None unless they are to be passed. A retried task
calls its predictor again: write the scores once and read them back, or keep
replies in a `ReplyStore`, from which equal inputs, later runs and retries are served.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from answerloom.functions.text import prompt
from answerloom.operators.ranking import grouped_rank
from answerloom.operators.replies import ReplyStore, answered
from answerloom.session import settle


def model_inputs(df: DataFrame, include_reference: bool = False, keep=("labels", "topic")) -> DataFrame:
    """Model input text with the kept columns only; absent columns read as ''."""
    def column(name):
        return F.col(name) if name in df.columns else F.lit("")

    reference = column("reference_answer") if include_reference else None
    text = prompt(column("question"), column("student_answer"), reference)
    return df.select(*[c for c in keep if c in df.columns], text.alias("text"))


def repeat_runs(df: DataFrame, runs: int) -> DataFrame:
    """Every row once per run, with the run's number from 1."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))


def _label(value):
    """A class code, or None for nothing and for NaN."""
    return None if value is None or value != value else int(value)


def _extended(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with further columns; the ones it has are passed on as they are."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], [*batch.schema.names, *columns]
    )


def _graded(predict: Callable, rows: list[tuple], fail_on_error: bool) -> list[tuple]:
    """(label, error) of each row; rows whose batch fails are tried again in halves."""
    if not rows:
        return []
    try:
        labels = pa.array([_label(x) for x in predict(*[list(x) for x in zip(*rows)])], pa.int32())
        if len(labels) != len(rows):
            raise ValueError(f"{len(labels)} labels for {len(rows)} answers")
        return [(x, None) for x in labels.to_pylist()]
    except Exception as error:
        if fail_on_error:
            raise
        if len(rows) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        half = len(rows) // 2
        return _graded(predict, rows[:half], False) + _graded(predict, rows[half:], False)


def score_rows(
    df: DataFrame,
    make_predictor: Callable,
    pass_reference: bool = True,
    fail_on_error: bool = False,
    store: ReplyStore | None = None,
) -> DataFrame:
    """Add y_pred and error by grading each answer on its own.

    A batch that fails is halved until the rows that fail stand alone, so a
    bad row costs itself and a few calls more: it gets a NULL y_pred and the
    error's text. With a store, equal inputs are graded once, ever.
    """
    inputs = df.drop("y_pred", "error")
    if store is not None:
        shown = {"question": F.col("question"), "student_answer": F.col("student_answer")}
        shown["reference_answer"] = F.col("reference_answer") if pass_reference else F.lit(None).cast("string")
        return answered(
            inputs, store, shown, lambda new: score_rows(new, make_predictor, pass_reference, fail_on_error), {"y_pred": "int"}
        )
    schema = T.StructType(
        [
            *inputs.schema.fields,
            T.StructField("y_pred", T.IntegerType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predictor()
        for batch in batches:
            questions = batch.column("question").to_pylist()
            answers = batch.column("student_answer").to_pylist()
            if pass_reference:
                references = batch.column("reference_answer").to_pylist()
            else:
                references = [None] * len(questions)
            graded = _graded(predict, list(zip(questions, answers, references)), fail_on_error)
            yield _extended(
                batch, y_pred=pa.array([x for x, _ in graded], pa.int32()),
                error=pa.array([x for _, x in graded], pa.string()),
            )

    return inputs.mapInArrow(grade, schema)


def answer_groups(
    df: DataFrame, limit: int, key: str = "task_id", row_id: str = "row_id", order: str = "row_no", carry=(),
) -> DataFrame:
    """Answers collected per question, in row order, `limit` to a group.

    The n-th answer of a question is in its group (n - 1) div limit, however
    many it has. All groups show the question and reference answer of the question's first
    row. Rows without a key are left out.

    Answers are counted per question first, from the key column alone. Questions of at most
    `limit` answers are one group each and need no ranks: one shuffle by key. Those of more, of which
    there are at most rows / limit, are ranked over range partitions, so that no task or array holds a whole hot
    question.
    """
    keyed = df.filter(F.col(key).isNotNull())
    many = keyed.groupBy(key).count().filter(F.col("count") > limit).select(F.col(key).alias("_key"))
    if many.isEmpty():
        return _groups(keyed.withColumn("part", F.lit(0).cast("long")), key, row_id, order, carry)
    hot = settle(many, "hot-questions")
    same = F.col(key) == F.col("_key")
    cold = _groups(keyed.join(hot, same, "left_anti").withColumn("part", F.lit(0).cast("long")), key, row_id, order, carry)
    ranked = grouped_rank(keyed.join(hot, same, "left_semi"), key, [order, row_id], "_rank").withColumn(
        "part", F.floor((F.col("_rank") - 1) / limit)
    )
    heads = ranked.filter("_rank = 1").select(
        F.col(key).alias("_key"), F.col("question").alias("_question"), F.col("reference_answer").alias("_reference")
    )
    parts = _groups(ranked, key, row_id, order, carry).drop("question", "reference_answer")
    shown = parts.join(heads, same).select(
        key, "part", F.col("_question").alias("question"), F.col("_reference").alias("reference_answer"), "members"
    )
    return cold.unionByName(shown)


def _groups(rows: DataFrame, key: str, row_id: str, order: str, carry) -> DataFrame:
    """Rows collected by key and part, with the question and reference answer of the first of them."""
    member = F.struct(
        F.col(order).alias("row_no"),
        F.col(row_id).alias("row_id"),
        F.col("student_answer").alias("answer"),
        *[F.col(c) for c in carry if c not in ("row_no", "row_id", "answer")],
    )
    own = F.min_by(F.struct("question", "reference_answer"), F.struct(order, row_id))
    groups = rows.groupBy(key, "part").agg(own.alias("_own"), F.array_sort(F.collect_list(member)).alias("members"))
    return groups.select(key, "part", "_own.question", "_own.reference_answer", "members")


def score_groups(
    groups: DataFrame, make_predictor: Callable, pass_reference: bool = True,
    fail_on_error: bool = False, key: str = "task_id", store: ReplyStore | None = None,
) -> DataFrame:
    """One row per answer of each group, with y_pred and error.

    Labels are matched to answers by place: with too few labels the last
    answers stay ungraded (NULL), surplus labels are ignored. A missing answer
    is shown to the predictor as an empty text. With a store, a question with the same
    answers in the same order is graded once, ever.
    """
    if store is None:
        scored = _label_groups(groups, make_predictor, pass_reference, fail_on_error)
    else:
        answers = F.transform("members", lambda m: F.struct(F.coalesce(m["answer"], F.lit("")).alias("answer")))
        reference = F.col("reference_answer") if pass_reference else F.lit(None).cast("string")
        scored = answered(
            groups, store, {"question": F.col("question"), "reference_answer": reference, "members": answers},
            lambda new: _label_groups(new, make_predictor, pass_reference, fail_on_error), {"labels": "array<int>"},
        )
    return scored.select(
        key, "labels", "error", F.posexplode("members").alias("pos", "member")
    ).select(
        key,
        "member.*",
        F.try_element_at("labels", F.col("pos") + 1).alias("y_pred"),
        "error",
    )


def _label_groups(groups: DataFrame, make_predictor: Callable, pass_reference: bool, fail_on_error: bool) -> DataFrame:
    """Add labels and error to each group of answers (question, reference_answer, members)."""
    schema = T.StructType(
        list(groups.schema.fields)
        + [
            T.StructField("labels", T.ArrayType(T.IntegerType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predictor()
        for batch in batches:
            questions = batch.column("question").to_pylist()
            references = batch.column("reference_answer").to_pylist()
            members = batch.column("members")
            ends = members.offsets.to_pylist()
            answers = [x or "" for x in members.values.field("answer").to_pylist()]
            labels, errors = [], []
            for row, (question, reference) in enumerate(zip(questions, references)):
                mine = answers[ends[row] : ends[row + 1]]
                try:
                    given = predict(question, mine, reference if pass_reference else None)
                    labels.append(pa.array([_label(x) for x in given], pa.int32()).to_pylist())
                    errors.append(None)
                except Exception as error:
                    if fail_on_error:
                        raise
                    labels.append([])
                    errors.append(f"{type(error).__name__}: {error}")
            yield _extended(
                batch,
                labels=pa.array(labels, pa.list_(pa.int32())),
                error=pa.array(errors, pa.string()),
            )

    return groups.mapInArrow(grade, schema)


def score_questions(
    df: DataFrame, make_predictor: Callable, limit: int, pass_reference: bool = True,
    key: str | None = None, row_id: str = "row_id", order: str = "row_no", carry=(),
    fail_on_error: bool = False, store: ReplyStore | None = None,
) -> DataFrame:
    """Grade the answers of a question together, at most `limit` in one call.

    Columns needed later travel with the answers (`carry`), so nothing is
    joined back. Rows without a question key come out ungraded.
    """
    key = key or ("task_id" if "task_id" in df.columns else "question")
    groups = answer_groups(df, limit, key, row_id, order, carry)
    scored = score_groups(groups, make_predictor, pass_reference, fail_on_error, key, store)
    names = scored.columns
    sources = {"row_no": order, "row_id": row_id, "answer": "student_answer"}
    left_out = df.filter(F.col(key).isNull()).select(
        *[
            F.lit(None).cast(scored.schema[c].dataType).alias(c)
            if c in ("y_pred", "error")
            else F.col(sources.get(c, c)).alias(c)
            for c in names
        ]
    )
    return scored.unionByName(left_out)


def score(df: DataFrame, make_predictor: Callable, mode: str = "single", **options) -> DataFrame:
    """`score_rows` for mode 'single', `score_questions` (which needs `limit`) for 'per_question'."""
    if mode == "single":
        return score_rows(df, make_predictor, **options)
    if mode == "per_question":
        return score_questions(df, make_predictor, **options)
    raise ValueError(f"mode must be 'single' or 'per_question', got {mode!r}")

