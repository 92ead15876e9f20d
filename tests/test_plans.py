"""What the physical plans look like: no nested-loop joins, no window over a
whole table, whole reads of a table once."""

import re

import pytest

from answerloom.catalog import registry, scoring_queries, views
from answerloom.operators import scoring

QUERIES = {name: query for name, (query, _) in registry.registered().items()}

# Queries that write and read back, or train, have no single plan to look at.
EAGER = ("S", "T", "A26", "R5")

# Windows without partition keys run over counts per bucket or per file part.
SMALL_WINDOWS = ("K6_seeded_shuffle", "M6_generate_all_batched")

# A window without keys is fed from one partition.
GLOBAL_WINDOW = r"Window .*\n.*Sort .*\n.*Exchange SinglePartition"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_cross_joins_and_no_global_windows(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if not name.startswith(SMALL_WINDOWS):
        assert not re.search(GLOBAL_WINDOW, text)


def test_global_windows_are_recognised(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    ranked = orders.selectExpr("row_number() OVER (ORDER BY o_orderkey) AS n")
    assert re.search(GLOBAL_WINDOW, plan(ranked))


def scans(text, column):
    return sum(column in line for line in text.splitlines() if "FileScan" in line)


def test_long_report_reads_predictions_once(spark, data):
    text = plan(QUERIES["D9_metrics_long"](spark, data))
    assert scans(text, "o_orderkey") == 1 and scans(text, "c_custkey") == 1


def test_columns_are_pruned(spark, data):
    text = plan(QUERIES["A1_count_per_topic"](spark, data))
    orders = next(x for x in text.splitlines() if "FileScan" in x and "o_custkey" in x)
    assert "ReadSchema: struct<o_custkey:bigint>" in orders


def test_filters_reach_the_scan(spark, data):
    text = plan(QUERIES["M3_row_grader"](spark, data))
    assert re.search(r"PushedFilters: \[.*EqualTo\(role,user\)", text)


def test_sample_does_not_shuffle_the_table(spark, data):
    text = plan(QUERIES["K5_exact_sample_of_documents"](spark, data))
    outer = text.split("Subquery")[0]
    assert "Exchange" not in outer
    final = [x for x in text.splitlines() if "FileScan" in x and "text" in x]
    assert len(final) == 1


@pytest.fixture
def shuffle_joins(spark):
    """Joins as with tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shares_of_a_question_are_spread_over_tasks(spark, data, shuffle_joins):
    text = plan(scoring.answer_groups(scoring_queries.order_answers(spark, data), limit=2))
    assert re.search(r"Window \[row_number.*\n.*Sort.*\n.*Exchange hashpartitioning\(_group#\d+, _bucket#", text)


def test_questions_of_one_call_need_no_ranks(spark, data, shuffle_joins):
    text = plan(QUERIES["A27_answers_per_question"](spark, data))
    assert "Window" not in text and text.count("Exchange hashpartitioning(task_id") == 1


def test_answers_are_added_up_before_they_meet_their_split(spark, data, shuffle_joins):
    text = plan(QUERIES["X1_no_task_in_two_splits"](spark, data))
    join = text.index("SortMergeJoin [task_id")
    below = text[join:]
    assert re.search(r"HashAggregate\(keys=\[topic#\d+, task_id#\d+\], functions=\[partial_count", below)


def test_metrics_use_hash_aggregation_with_map_side_counts(spark, data):
    text = plan(QUERIES["A18_per_topic_metrics"](spark, data))
    assert "SortAggregate" not in text and "partial_count" in text
    assert text.count("Exchange hashpartitioning(topic") == 1


def test_a_leaderboard_parses_its_text_once(spark, data):
    """Bounds and order are taken from stored numbers, not from the CSV again."""
    text = plan(QUERIES["L6_grid_leaderboard"](spark, data))
    assert "FileScan csv" not in text
    assert "FileScan parquet" in text


def test_line_items_are_dealt_to_tasks_by_their_number(spark, data, monkeypatch):
    """One shuffle by order, of as many partitions as the rows need, under all four aggregates."""
    monkeypatch.setattr(views, "ITEMS_PER_TASK", 500)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    text = plan(QUERIES["R2_wide_to_long"](spark, data))
    assert re.findall(r"Exchange (.*?)#\d+L, (\d+)\), (\w+)", text) == [
        ("hashpartitioning(l_orderkey", str(1 + lines // 500), "REPARTITION_BY_NUM")
    ]


def test_entities_are_decoded_few_texts_at_a_time(spark, data):
    text = plan(QUERIES["P10_decode_entities"](spark, data))
    assert "BatchEvalPython" in text and "ArrowEvalPython" not in text
