"""Synthetic answers: requests, generator calls, regrouping and validation.

A generator is made once per task by `make_generator()` and returns answers
for a label. It sees the reference answer only where the label's policy says
so. Failed and short replies go to a rejects table instead of ending the job.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from answerloom import fixed_values as fv
from answerloom.functions.hashing import order_hash
from answerloom.operators.ranking import hash_rank
from answerloom.operators.replies import ReplyStore, answered

TASK_COLUMNS = ("task_id", "question", "reference_answer", "topic")


def _quota_array(quotas: dict, pass_reference: dict | None) -> Column:
    policy = {**fv.PASS_REFERENCE, **(pass_reference or {})}
    wanted = [(x, quotas.get(x, 0)) for x in fv.GENERATION_ORDER if quotas.get(x, 0) > 0]
    return F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(count).alias("count"),
                F.lit(bool(policy[label])).alias("pass_reference"),
            )
            for label, count in wanted
        ]
    )


def label_requests(tasks: DataFrame, quotas: dict, pass_reference: dict | None = None) -> DataFrame:
    """One row per task and wanted label, with the number of answers to make.

    The quotas are a constant array that is exploded next to each task: no
    join. The reference answer is NULL where the label must not see it.
    """
    wanted = tasks.select("*", F.inline(_quota_array(quotas, pass_reference)))
    shown = F.when(F.col("pass_reference"), F.col("reference_answer"))
    return wanted.withColumn("full_reference", F.col("reference_answer")).withColumn(
        "reference_answer", shown
    )


def requests(tasks: DataFrame, quotas: dict, pass_reference: dict | None = None) -> DataFrame:
    """One row per answer to make, numbered from 1 per task and label."""
    return label_requests(tasks, quotas, pass_reference).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("i")
    )


def with_fallback(
    answer: Column, label: Column, reference: Column, i: Column, task: Column
) -> Column:
    """A stand-in where generation failed: the reference answer or a placeholder."""
    number, name = i.cast("string"), task.cast("string")
    stand_in = (
        F.when(label == "correct", reference)
        .when(label == "partial", F.concat(F.lit("Partial answer "), number, F.lit(" for question "), name))
        .otherwise(F.concat(F.lit("Incorrect answer "), number, F.lit(" for question "), name))
    )
    return F.coalesce(answer, stand_in)


def fit_quota(answers: Column, count: Column) -> Column:
    """The first `count` answers; NULL if there are fewer."""
    return F.when(F.size(answers) >= count, F.slice(answers, F.lit(1), count))


def split_flat(df: DataFrame, ids: str, flat: str, per_question: int) -> DataFrame:
    """Question-major flat answers, cut into one row per question.

    Adds pos, task_id and answers. A flat list of the wrong length is cut all
    the same, and `length_ok` is false for its rows.
    """
    if per_question <= 0:
        return df.select(
            "*", F.posexplode(ids).alias("pos", "task_id"),
            F.array().cast("array<string>").alias("answers"), F.lit(True).alias("length_ok"),
        )
    start = F.col("pos") * per_question + 1
    return (
        df.withColumn("length_ok", F.size(flat) == F.size(ids) * per_question)
        .select("*", F.posexplode(ids).alias("pos", "task_id"))
        .withColumn("answers", F.slice(flat, start, F.lit(per_question)))
    )


def _call(
    inputs: DataFrame, make_generator: Callable, arguments, reply: str, store: ReplyStore | None = None, told_apart=(),
) -> DataFrame:
    """Call the generator on each row; add its reply and the error, if any.

    With a store, equal arguments are passed once, ever; rows that differ in `told_apart` get replies of their own.
    """
    if store is not None:
        return answered(
            inputs, store, {a: F.col(a) for a in arguments}, lambda new: _call(new, make_generator, arguments, reply),
            {"reply": "array<string>"}, told_apart,
        )
    schema = T.StructType(
        list(inputs.schema.fields)
        + [
            T.StructField("reply", T.ArrayType(T.StringType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = make_generator()
        for batch in batches:
            replies, errors = [], []
            for values in zip(*[batch.column(a).to_pylist() for a in arguments]):
                try:
                    given = generate(*values)
                    texts = [given] if reply == "one" else list(given)
                    replies.append(pa.array(texts, pa.string()).to_pylist())
                    errors.append(None)
                except Exception as error:
                    replies.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(replies, pa.list_(pa.string())),
                    pa.array(errors, pa.string()),
                ],
                [*batch.schema.names, "reply", "error"],
            )

    return inputs.mapInArrow(run, schema)


def generate_single(tasks, quotas, make_generator, pass_reference=None, store=None) -> DataFrame:
    """One call per answer: generate(label, question, reference).

    Failures are replaced by stand-ins, so every quota is met.
    """
    asked = requests(tasks, quotas, pass_reference)
    called = _call(asked, make_generator, ("label", "question", "reference_answer"), "one", store, ("i",))
    stand_in = with_fallback(
        F.lit(None), F.col("label"), F.col("full_reference"), F.col("i"), F.col("task_id")
    )
    reply = F.try_element_at("reply", F.lit(1))
    given = F.when(F.col("error").isNull(), reply).otherwise(stand_in)
    return called.select(*_answer_columns(given), F.lit(None).cast("string").alias("reject_reason"))


def generate_per_question(tasks, quotas, make_generator, pass_reference=None, store=None) -> DataFrame:
    """One call per task and label: generate(label, question, reference, count).

    Longer replies are cut to the quota. Failed and short ones become one row
    with a reject_reason and no answer.
    """
    asked = label_requests(tasks, quotas, pass_reference)
    called = _call(
        asked, make_generator, ("label", "question", "reference_answer", "count"), "many", store
    )
    fitting = fit_quota(F.col("reply"), F.col("count"))
    reason = F.coalesce(
        F.col("error"),
        F.when(
            fitting.isNull(),
            F.format_string("expected %d answers, got %d", "count", F.size("reply")),
        ),
    )
    return (
        called.withColumn("reject_reason", reason)
        .withColumn("answer", F.explode_outer(F.when(reason.isNull(), fitting)))
        .select(*_answer_columns(F.col("answer")), "reject_reason")
    )


def generate_batched(
    tasks, quotas, make_generator, tasks_per_call: int, pass_reference=None, store=None
) -> DataFrame:
    """One call per label for a batch of tasks: generate(label, questions, references, count).

    Batches hold `tasks_per_call` tasks, chosen by hash rank, so they do not
    depend on partitioning and no call sees more than that many. The flat
    reply is cut question by question; a reply of the wrong length keeps what
    it has and marks its rows with a reject_reason.
    """
    ranked = hash_rank(
        tasks.select(*TASK_COLUMNS, order_hash(F.col("task_id"), fv.SEED).alias("_hash")),
        [], "_hash", ["task_id"], name="_rank",
    )
    member = F.struct("_rank", *TASK_COLUMNS)
    batches = ranked.groupBy(F.floor((F.col("_rank") - 1) / tasks_per_call).alias("batch")).agg(
        F.array_sort(F.collect_list(member)).alias("members")
    )
    shown = F.transform("members", lambda m: F.when(F.col("pass_reference"), m["reference_answer"]))
    asked = batches.select("*", F.inline(_quota_array(quotas, pass_reference))).select(
        "*",
        F.transform("members", lambda m: m["question"]).alias("questions"),
        shown.alias("references"),
    )
    called = _call(
        asked.drop("pass_reference"), make_generator,
        ("label", "questions", "references", "count"), "many", store,
    )
    reason = F.coalesce(
        F.col("error"),
        F.when(
            F.size("reply") != F.size("members") * F.col("count"),
            F.format_string(
                "expected %d answers, got %d", F.size("members") * F.col("count"), F.size("reply")
            ),
        ),
    )
    cut = (
        called.withColumn("reject_reason", reason)
        .select("label", "count", "reply", "reject_reason", F.posexplode("members").alias("pos", "m"))
        .withColumn(
            "answer",
            F.explode_outer(F.slice("reply", F.col("pos") * F.col("count") + 1, F.col("count"))),
        )
    )
    return cut.select(
        *[F.col(f"m.{c}").alias(c) for c in TASK_COLUMNS],
        F.col("answer").alias("student_answer"),
        F.col("label").alias("labels"),
        "reject_reason",
    )


def _answer_columns(answer: Column) -> list[Column]:
    return [
        F.col("task_id"),
        F.col("question"),
        F.col("full_reference").alias("reference_answer"),
        F.col("topic"),
        answer.alias("student_answer"),
        F.col("label").alias("labels"),
    ]


MODES = {
    "single": generate_single,
    "per_question": generate_per_question,
    "all": generate_batched,
}


def generate(tasks: DataFrame, quotas: dict, make_generator: Callable, mode: str, **options) -> DataFrame:
    """Answers and rejects in one table; reject_reason tells them apart.

    The mode "all" needs `tasks_per_call`, as that decides what a call sees. `store` keeps replies (`ReplyStore`).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}, got {mode!r}")
    return MODES[mode](tasks, quotas, make_generator, **options)


def accepted(generated: DataFrame) -> DataFrame:
    """Rows that hold an answer, without the reject_reason column."""
    given = F.col("reject_reason").isNull() | F.col("student_answer").isNotNull()
    return generated.filter(given).drop("reject_reason")


def rejected(generated: DataFrame) -> DataFrame:
    return generated.filter(F.col("reject_reason").isNotNull())


def count_violations(answers: DataFrame, tasks: DataFrame, quotas: dict) -> DataFrame:
    """Per task and label: answers where their number is not the quota.

    Each side is reduced to one row per task before they meet.
    """
    labels = list(fv.GENERATION_ORDER)
    made = answers.groupBy(F.col("task_id").alias("a_task")).agg(
        *[F.count_if(F.col("labels") == x).alias(f"made_{x}") for x in labels]
    )
    rows = [
        F.struct(
            F.lit(x).alias("label"),
            F.lit(quotas.get(x, 0)).cast("bigint").alias("expected"),
            F.coalesce(f"made_{x}", F.lit(0).cast("bigint")).alias("actual"),
        )
        for x in labels
    ]
    return (
        tasks.select("task_id")
        .join(made, F.col("task_id") == F.col("a_task"), "left")
        .select("task_id", F.inline(F.array(*rows)))
        .filter("actual <> expected")
    )


def label_totals(answers: DataFrame, tasks: DataFrame, quotas: dict) -> DataFrame:
    """Expected and actual number of answers per label, and in total."""
    labels = list(fv.GENERATION_ORDER)
    n_tasks = tasks.agg(F.count("*")).scalar()
    made = answers.agg(
        *[F.count_if(F.col("labels") == x).alias(x) for x in labels], F.count("*").alias("total")
    )
    wanted = {x: quotas.get(x, 0) for x in labels}
    wanted["total"] = sum(wanted.values())
    return made.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(x).alias("label"),
                        (n_tasks * F.lit(n)).alias("expected"),
                        F.col(x).alias("actual"),
                    )
                    for x, n in wanted.items()
                ]
            )
        )
    )

