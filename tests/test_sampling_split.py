import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.functions.hashing import order_hash
from answerloom.operators import distribution as ds, ranking as rk, sampling as sp, split as xs


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


@pytest.mark.parametrize("fraction", [0.003, 0.1, 0.5, 0.999])
def test_sample_is_exact_and_independent_of_partitions(spark, fraction):
    df = spark.range(3000)
    first = ids(sp.exact_sample(df, fraction, "id"))
    assert len(first) == int(3000 * fraction)
    assert first == ids(sp.exact_sample(df.repartition(11), fraction, "id"))
    assert first != ids(sp.exact_sample(df, fraction, "id", seed=1))


def test_sample_equals_brute_force(spark):
    order = sorted(range(500), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert ids(sp.exact_sample(spark.range(500), 0.25, "id")) == sorted(order[:125])


def test_sample_bounds(spark):
    df = spark.range(10)
    assert sp.exact_sample(df, 1.0, "id") is df
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            sp.exact_sample(df, bad, "id")
    for nothing in (0.0, 0.05):
        with pytest.raises(Exception, match="leaves 0 rows"):
            sp.exact_sample(df, nothing, "id").collect()


def test_seeded_order_is_a_permutation(spark):
    rows = [r.id for r in sp.seeded_order(spark.range(100), "id").collect()]
    assert sorted(rows) == list(range(100)) and rows != list(range(100))
    assert rows == [r.id for r in sp.seeded_order(spark.range(100).repartition(7), "id").collect()]


def test_hash_rank_equals_row_number(spark):
    df = spark.range(4000).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"),
        order_hash(F.col("id"), 5).alias("h"),
    )
    ranked = rk.hash_rank(df, ["g"], "h", ["id"]).collect()
    for g in ("hot", "cold"):
        mine = sorted((r for r in ranked if r.g == g), key=lambda r: (r.h, r.id))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_sorted_rank_and_next_ids(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("task"))
    ranked = sorted((r.task, r["rank"]) for r in rk.sorted_rank(df, ["task"]).collect())
    assert [n for _, n in ranked] == list(range(1, 1001))
    existing = spark.createDataFrame([("3",), ("12",), ("x",)], "task_id string")
    new = spark.createDataFrame([("b",), ("a",), ("b",)], "task string")
    assert sorted(map(tuple, rk.allocate_ids(existing, new).collect())) == [("a", 13), ("b", 14)]


def make_tasks(spark, sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for topic, n in sizes.items():
        for i in range(n):
            a, b, c = (int(x) for x in rng.integers(0, 9, 3))
            rows.append((f"{topic}-{i}", topic, a, b, c))
    return spark.createDataFrame(rows, "task_id string, topic string, n_0 long, n_1 long, n_2 long")


def quotas(n):
    if n <= 2:
        return n, 0, 0
    if n == 3:
        return 1, 1, 1
    held = max(1, round(n * 0.2))
    return n - 2 * held, held, held


@pytest.mark.parametrize("balanced", [True, False])
def test_split_quotas_are_exact(spark, balanced):
    sizes = {"one": 1, "two": 2, "three": 3, "four": 4, "some": 57, "hot": 700}
    tasks = make_tasks(spark, sizes)
    split = xs.balanced_split(tasks) if balanced else xs.quota_split(tasks)
    rows = split.collect()
    assert sorted(r.task_id for r in rows) == sorted(r.task_id for r in tasks.collect())
    for topic, n in sizes.items():
        got = tuple(
            sum(r.topic == topic and r.split == s for r in rows) for s in ("train", "val", "test")
        )
        assert got == quotas(n), topic


def held_out(rows, held):
    """Brute force: one topic's tasks in order of their counts; where the running share of held ones rises, one goes out."""
    def order(r):
        return r.n_0, r.n_1, r.n_2, hashlib.md5(f"42:{r.task_id}".encode()).hexdigest(), r.task_id

    out, reached = {}, 0
    for place, r in enumerate(sorted(rows, key=order), 1):
        now = place * 2 * held // len(rows)
        out[r.task_id] = "train" if now == reached else "val" if now % 2 else "test"
        reached = now
    return out


@pytest.mark.parametrize("sizes", [{"a": 37, "b": 4, "c": 10}, {"hot": 20_000, "d": 10}])
def test_balanced_split_against_brute_force(spark, sizes):
    tasks = make_tasks(spark, sizes, seed=3)
    expected = {}
    for topic, n in sizes.items():
        expected |= held_out([r for r in tasks.collect() if r.topic == topic], quotas(n)[1])
    for parts in (3, 11):
        assert {r.task_id: r.split for r in xs.balanced_split(tasks.repartition(parts)).collect()} == expected


def test_class_counts_come_close_to_their_targets(spark):
    tasks = make_tasks(spark, {"a": 500, "b": 60})
    rows = xs.target_distances(tasks, xs.balanced_split(tasks)).collect()
    assert len(rows) == 2 * 3 * 3
    for r in rows:
        assert abs(r.target - r.actual) <= 0.2 * r.target + 8, r


def test_repeated_keys_cannot_be_sampled_exactly(spark):
    with pytest.raises(ValueError, match="repeats"):
        sp.exact_sample(spark.range(1000).selectExpr("id % 10 AS id"), 0.15, "id")


@pytest.mark.parametrize("parts", [1, 7])
def test_grouped_rank_equals_row_number(spark, parts):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id"
    ).repartition(parts)
    ranked = rk.grouped_rank(df, "g", ["id"], size="n").collect()
    groups = {}
    for r in sorted(ranked, key=lambda r: r.id):
        groups.setdefault(r.g, []).append(r)
    for rows in groups.values():
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and {r.n for r in rows} == {len(rows)}


def test_null_topic_is_a_topic(spark):
    tasks = spark.createDataFrame(
        [(str(i), None, 1, 0, 0) for i in range(10)],
        "task_id string, topic string, n_0 long, n_1 long, n_2 long",
    )
    assert xs.balanced_split(tasks).count() == 10
    assert xs.quota_split(tasks).count() == 10


def test_overlaps_and_zero_fill(spark):
    df = spark.createDataFrame(
        [("a", "train", "x", 0), ("a", "val", "x", 1), ("b", "val", "x", 2), ("b", "train", "y", 2)],
        "task_id string, split string, topic string, y_true int",
    )
    shared = {(r.split_a, r.split_b): r.shared_tasks for r in xs.split_overlaps(df).collect()}
    assert shared == {("train", "val"): 2, ("train", "test"): 0, ("val", "test"): 0}
    filled = ds.zero_filled(ds.split_statistics(df), ["questions", "answers"]).collect()
    assert len(filled) == 6
    assert {(r.topic, r.split): r.answers for r in filled}[("x", "test")] == 0
    totals = {(r.split, r.topic): r.questions for r in ds.full_statistics(df).collect()}
    assert totals[("val", None)] == 2 and totals[(None, None)] == 2 and totals[("val", "x")] == 2
    percent = ds.split_label_distribution(df).filter("split = 'test'").collect()
    assert [r.percent for r in percent] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("few", [0, 10**6])
def test_ranks_of_a_group_with_very_many_buckets(spark, monkeypatch, few):
    """A topic that holds nearly all tasks, with as many profiles as a third of them."""
    monkeypatch.setattr(rk, "FEW_BUCKETS", few)
    rows = [("big" if k % 50 else "small", k * 7919 % 1000, k % 3, f"{k * 2654435761 % 2**32:08x}", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, a long, b long, h string, id long").repartition(6)
    got = rk.hash_rank(df, ["g"], "h", ["id"], before=["a", "b"], size="n").collect()
    expected = {}
    for g in ("big", "small"):
        mine = sorted(((r[1], r[2], r[3], r[4]) for r in rows if r[0] == g))
        expected |= {r[3]: (n, len(mine)) for n, r in enumerate(mine, 1)}
    assert {r.id: (r.rank, r.n) for r in got} == expected


def test_many_buckets_are_summed_by_many_tasks(spark):
    """A million profiles in one topic: no range adds up more than its share of them."""
    sizes = spark.range(400_000).select(F.struct(F.lit("t")).alias("_group"), F.col("id").alias("_bucket"), (F.col("id") % 3 + 1).alias("_size"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        offsets = rk.prefix_sums(sizes, "total")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = spark.read.parquet(_latest(spark, "bucket-ranges"))
        assert max(r["count"] for r in ranges.groupBy("_range").count().collect()) <= 2 * 400_000 / n
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    row = offsets.filter("_bucket = 399999").first()
    assert (row._offset, row.total) == (sum(k % 3 + 1 for k in range(399_999)), sum(k % 3 + 1 for k in range(400_000)))


def _latest(spark, name):
    from answerloom import session

    return [p for p in session._written[spark.sparkContext.applicationId] if f"/{name}-" in p][-1]
