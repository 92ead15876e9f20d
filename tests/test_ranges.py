"""Large files read in byte ranges, against the readers that take a file whole."""

import json
import random

import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from answerloom.catalog import source_queries
from answerloom.session import scratch_path
from answerloom.sources import ranges, readers

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType()), T.StructField("b", T.StringType())])


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of 800 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "800b")
    spark.conf.set(names[1], "1b")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def key(row):
    return tuple(str(x) for x in row)


def csv_text(rng, rows, end):
    def field(x):
        return '"' + x.replace('"', '""') + '"' if rng.random() < 0.3 or any(c in x for c in ';"\r\n') else x

    lines = ["a;n;b"]
    for k in range(rows):
        a = "".join(rng.choices(['x', ';', '"', "\n", "é", " ", "\r\n", "word"], k=rng.randint(0, 12)))
        b = rng.choice(["", "plain", "two\nlines", 'say "hi";', "\n" * rng.randint(1, 300), "🙂" * rng.randint(1, 90)])
        lines.append(f"{field(a)};{k};{field(b)}")
    return end.join(lines) + rng.choice(["", end])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_csv_equals_the_whole_reader(spark, small_ranges, tmp_path, end):
    for seed in range(3):
        (tmp_path / f"{seed}.csv").write_bytes(csv_text(random.Random(seed), 120, end).encode())
    got = readers.split_csv(spark, str(tmp_path), SCHEMA)
    whole = readers.semicolon_csv(spark, str(tmp_path), SCHEMA)
    assert whole.count() == 360
    # Where lines end in \r\n, the whole reader also shortens those inside quotes.
    rows = [(r.a and r.a.replace(end, "\n"), r.n, r.b and r.b.replace(end, "\n")) for r in got.collect()]
    assert sorted(map(key, rows)) == sorted(map(key, whole.collect()))
    assert ranges._states(spark, str(tmp_path), ranges.CSV).count() > 12


def test_header_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿a;n;b\n\n;1;\n")
    (tmp_path / "b.csv").write_text("")
    assert readers.split_csv(spark, str(tmp_path), SCHEMA).collect() == [(None, 1, None)]
    (tmp_path / "c.csv").write_text("a;b;n\nx;y;1\n")
    with pytest.raises(Exception, match="header"):
        readers.split_csv(spark, str(tmp_path), SCHEMA).collect()


def grades(rng, people):
    def name():
        return "".join(rng.choices(['p', ',', '"', "\\", "{", "}", "é", ": ", "[", "\n"], k=rng.randint(1, 14)))

    return {f"{k} {name()}": {f"{name()}{i}": rng.choice([0, 0.5, 1.0, None]) for i in range(rng.randint(0, 14))} for k in range(people)}


def test_grades_of_one_file_in_ranges(spark, small_ranges, tmp_path):
    for seed, indent in ((1, None), (2, 2)):
        (tmp_path / f"{seed}.json").write_text(json.dumps(grades(random.Random(seed), 80), indent=indent, ensure_ascii=seed == 1))
    (tmp_path / "3.json").write_text(" {} \n")
    got = readers.split_grades_json(spark, str(tmp_path))
    whole = readers.grades_json(spark, str(tmp_path))
    assert whole.count() > 500
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))


def test_tasks_of_one_file_in_ranges(spark, small_ranges, tmp_path):
    rng = random.Random(5)
    for topic in ("plus + and %", "ä b"):
        tasks = [
            {
                "question": rng.choice(["a, b?", 'the "{" [', "", "x\ny"]) + str(k),
                "answer_options": [{"answer": f"o,{i}", "is_correct": rng.random() < 0.5} for i in range(rng.randint(0, 5))],
            }
            for k in range(60)
        ]
        (tmp_path / f"{topic}.json").write_text(json.dumps(tasks, indent=rng.choice([None, 1])))
    (tmp_path / "other.txt").write_text("[1, 2]")
    got = readers.split_task_json(spark, str(tmp_path))
    whole = readers.task_json(spark, str(tmp_path))
    assert {r.topic for r in whole.collect()} == {"plus + and %", "ä b"}
    assert whole.count() == 120
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """One file in ranges of 4 MB: as many tasks as ranges, and the same rows as from the table it was written from."""
    text = F.concat(F.lit('say "hi";'), F.repeat(F.lit("word\n"), 40), F.col("id").cast("string"))
    table = spark.range(100_000).select(text.alias("a"), F.col("id").alias("n"), F.lit(None).cast("string").alias("b"))
    path = str(tmp_path / "large")
    table.coalesce(1).write.csv(path, sep=";", header=True, quote='"', escape='"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        got = readers.split_csv(spark, path, SCHEMA)
        assert ranges._states(spark, path, ranges.CSV).count() >= 5
        digest = [F.count("*"), F.sum(F.xxhash64("a", "n", "b").cast("decimal(38,0)"))]
        assert got.agg(*digest).first() == table.agg(*digest).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name, file", [("S1_split_csv", "answers-one-csv"), ("S4_split_grades_json", "grades-one-json")])
def test_queries_of_large_files_write_no_table_in_one_task(spark, data, monkeypatch, name, file):
    """Beyond ROWS_PER_FILE rows there are several files, each with a header or an object of its own; the rows are the same."""
    paths = []
    monkeypatch.setattr(source_queries, "ROWS_PER_FILE", 20)
    monkeypatch.setattr(source_queries, "scratch_path", lambda s, n: paths.append(scratch_path(s, n)) or paths[-1])
    query, sql = source_queries.QUERIES[name]
    assert oracle.compare(query(spark, data), oracle.connect(data), sql) is None
    assert file in paths[0] and spark.read.text(paths[0]).select("_metadata.file_path").distinct().count() > 1


def test_one_object_of_any_batches():
    def text(*batches):
        parts = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["member"]) for x in batches]
        return "\n".join(x for b in source_queries._one_object(iter(parts)) for x in b.column("value").to_pylist())

    assert [json.loads(text(*x)) for x in ([], [[]], [['"a":1'], [], ['"b":2', '"c":3']])] == [{}, {}, {"a": 1, "b": 2, "c": 3}]
