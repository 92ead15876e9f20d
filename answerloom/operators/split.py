"""Splits without question leakage: every task lands in exactly one split."""

from pyspark.sql import Column, DataFrame, functions as F

from answerloom import fixed_values as fv
from answerloom.functions.hashing import order_hash
from answerloom.operators.distribution import task_label_counts
from answerloom.operators.ranking import hash_rank
from answerloom.session import settle

CODES = fv.CLASS_CODES


def topic_targets(tasks: DataFrame) -> DataFrame:
    """Per topic: tasks, class totals, and the wanted class counts per split.

    Targets are 60/20/20 percent, rounded half to even; what rounding leaves
    over goes to train.
    """
    counts = tasks.groupBy("topic").agg(
        F.count("*").alias("n_tasks"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in CODES]
    )
    held = {c: F.rint(F.col(f"n_{c}") * fv.HELD_OUT_SHARE).cast("bigint") for c in CODES}
    return counts.select(
        "*",
        *[(F.col(f"n_{c}") - 2 * held[c]).alias(f"train_{c}") for c in CODES],
        *[held[c].alias(f"val_{c}") for c in CODES],
        *[held[c].alias(f"test_{c}") for c in CODES],
    )


def held_out_quota(n: Column) -> Column:
    """Tasks of a topic with n tasks that go to val, and again to test."""
    share = F.greatest(F.lit(1), F.rint(n * fv.HELD_OUT_SHARE).cast("bigint"))
    return F.when(n <= 2, 0).when(n == 3, 1).otherwise(share).cast("bigint")


def balanced_split(tasks: DataFrame, seed: int = fv.SEED) -> DataFrame:
    """(task_id, topic, split) from per-task class counts, balanced by class.

    The n tasks of a topic are ranked by their class counts, equal ones by
    hash, and of every n / (2 quota) ranks one is held out, for val and test
    in turn. So both get exactly their quota, every profile of class
    counts is spread over the splits in proportion, and a topic of any size
    follows the same rule.
    """
    hashed = tasks.select(
        "task_id", "topic", *[f"n_{c}" for c in CODES], order_hash(F.col("task_id"), seed).alias("hashed")
    )
    ranked = hash_rank(
        hashed, ["topic"], "hashed", ["task_id"], before=[f"n_{c}" for c in CODES], size="n_topic"
    ).withColumn("quota", held_out_quota(F.col("n_topic")))
    reached = F.expr("rank * 2 * quota div n_topic")
    held = reached > F.expr("(rank - 1) * 2 * quota div n_topic")
    split = F.when(~held, "train").when(reached % 2 == 1, "val").otherwise("test")
    return ranked.select("task_id", "topic", split.alias("split"))


def target_distances(tasks: DataFrame, assignment: DataFrame) -> DataFrame:
    """(topic, split, label, target, actual): wanted and given class counts of each topic and split."""
    given = (
        tasks.select("task_id", "topic", *[f"n_{c}" for c in CODES])
        .join(assignment.select("task_id", "split"), "task_id")
        .groupBy("topic")
        .agg(*[
            F.coalesce(F.sum(F.when(F.col("split") == s, F.col(f"n_{c}"))), F.lit(0)).alias(f"got_{s}_{c}")
            for s in fv.SPLITS for c in CODES
        ])
        .withColumnRenamed("topic", "_topic")
    )
    rows = [
        F.struct(
            F.lit(s).alias("split"), F.lit(c).alias("label"), F.col(f"{s}_{c}").alias("target"),
            F.col(f"got_{s}_{c}").alias("actual"),
        )
        for s in fv.SPLITS for c in CODES
    ]
    return topic_targets(tasks).join(given, F.col("topic").eqNullSafe(F.col("_topic"))).select(
        "topic", F.inline(F.array(*rows))
    )


def quota_split(tasks: DataFrame, seed: int = fv.SEED) -> DataFrame:
    """(task_id, topic, split) by hash order alone: exact quotas, no balancing."""
    hashed = tasks.select("task_id", "topic", order_hash(F.col("task_id"), seed).alias("hashed"))
    ranked = hash_rank(hashed, ["topic"], "hashed", ["task_id"], size="n_topic")
    quota = held_out_quota(F.col("n_topic"))
    train = F.col("n_topic") - 2 * quota
    split = (
        F.when(F.col("rank") <= train, "train")
        .when(F.col("rank") <= train + quota, "val")
        .otherwise("test")
    )
    return ranked.select("task_id", "topic", split.alias("split"))


def split_by_task(answers: DataFrame, seed: int = fv.SEED, balanced: bool = True) -> DataFrame:
    """Task assignment for an answers table (columns task_id, topic, y_true).

    The per-task counts are needed several times and are written once, so
    that the answers are read once. The assignment is written as well: with
    its size known, a join of the answers with it needs no shuffle of the
    answers as long as it is small enough to broadcast.
    """
    tasks = settle(task_label_counts(answers), "task-counts")
    assigned = balanced_split(tasks, seed) if balanced else quota_split(tasks, seed)
    return settle(assigned, "split")


def with_split(answers: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows with the split of their task; rows of unassigned tasks drop out.

    Spark splits a hot task's partition of this join by itself (adaptive skew
    join) as long as what follows does not need the rows grouped by task. For
    counts by split give it `task_counts` instead of answers.
    """
    return answers.join(assignment.select("task_id", "split"), "task_id")


def split_overlaps(df: DataFrame) -> DataFrame:
    """Tasks shared by each pair of splits; all three pairs are always listed."""
    return split_summary(df).select("split_a", "split_b", "shared_tasks")


def split_summary(df: DataFrame, answers: str | None = None) -> DataFrame:
    """Each pair of splits with the tasks they share, and the tasks and answers of both.

    One aggregate per task says which splits it is in, so no table is joined
    with itself. `answers` names a column that counts the answers of a row.
    """
    rows = F.col(answers) if answers else F.lit(1)
    seen = df.groupBy("task_id").agg(
        *[F.bool_or(F.col("split") == s).alias(s) for s in fv.SPLITS],
        *[F.sum(F.when(F.col("split") == s, rows)).alias(f"n_{s}") for s in fv.SPLITS],
    )
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    counts = seen.agg(
        *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs],
        *[F.count_if(s).alias(f"tasks_{s}") for s in fv.SPLITS],
        *[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"answers_{s}") for s in fv.SPLITS],
    )
    rows = [
        F.struct(
            F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}_{b}").alias("shared_tasks"),
            F.col(f"tasks_{a}").alias("tasks_a"), F.col(f"tasks_{b}").alias("tasks_b"),
            F.col(f"answers_{a}").alias("answers_a"), F.col(f"answers_{b}").alias("answers_b"),
        )
        for a, b in pairs
    ]
    return counts.select(F.inline(F.array(*rows)))
