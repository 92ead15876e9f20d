"""Readers. All of them take declared schemas; nothing is inferred."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from answerloom import fixed_values as fv, schemas
from answerloom.functions.labels import collapse_five_way
from answerloom.functions.text import reference_option
from answerloom.sources import ranges


def semicolon_csv(
    spark: SparkSession, path, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """Semicolon CSV with a header; quoted fields may hold ; " and line breaks.

    Empty fields are NULL, quoted or not.
    Files read with `multi_line` are not split over tasks. Turn off where
    fields hold no line breaks; large files are for `split_csv`.
    """
    return spark.read.schema(schema).csv(
        path, sep=";", header=True, quote='"', escape='"', multiLine=multi_line,
        enforceSchema=False,
    )


def split_csv(spark: SparkSession, path, schema: T.StructType, sep: str = ";") -> DataFrame:
    """`semicolon_csv` for large files, each read by as many tasks as it has byte ranges.

    Quotes stand around whole fields and are doubled inside them, as the writer here does; a lone quote inside an
    unquoted field is an error of the file that this reader does not notice. A header that names
    other columns is an error. Line breaks inside fields stay as they are.
    """
    found = ranges.records(spark, path, ranges.CSV)
    line = F.regexp_replace(ranges.without_bom(F.col("text"), F.col("opens")), "\r$", "")
    options = {"sep": sep, "quote": '"', "escape": '"'}
    names = F.from_csv("line", T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))]).toDDL(), options)
    as_named = F.array(*[names[f"c{i}"] for i in range(len(schema))]) == F.array(*[F.lit(n) for n in schema.fieldNames()])
    other = F.raise_error(F.concat(F.lit("the header is not the schema's: "), "line")).cast("boolean")
    is_row = F.when(F.col("opens"), F.when(as_named, False).otherwise(other)).otherwise(F.col("line") != "")
    rows = found.select(line.alias("line"), "opens").filter(is_row)
    return rows.select(F.from_csv("line", schema.toDDL(), options).alias("row")).select("row.*")


def _member(opening: str, closing: str) -> Column:
    """A member of a JSON object or array without the brackets around all of them."""
    text = F.when(F.col("opens"), F.regexp_replace("text", rf"^\s*\{opening}", "")).otherwise(F.col("text"))
    return F.when(F.col("closes"), F.regexp_replace(text, rf"\{closing}\s*$", "")).otherwise(text)


def comma_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Comma CSV of experiment exports; empty fields are NULL."""
    return spark.read.schema(schema).csv(
        path, header=True, quote='"', escape='"', enforceSchema=False
    )


def task_json(
    spark: SparkSession, folder: str, multi_line: bool = True, topic: str | None = None
) -> DataFrame:
    """Tasks of a folder of JSON files, one file per topic, other files ignored.

    Each file is an array of tasks (or, without `multi_line`, one task per
    line, which lets Spark split it). The topic is the file's stem unless a
    folder column already holds it.
    """
    reader = (
        spark.read.schema(schemas.TASK_JSON)
        .option("multiLine", multi_line)
        .option("pathGlobFilter", "*.json")
    )
    return _as_tasks(reader.json(folder), F.col(topic) if topic else _stem("_metadata.file_path"))


def split_task_json(spark: SparkSession, folder: str) -> DataFrame:
    """`task_json` for large files: an array is read by as many tasks as its file has byte ranges."""
    found = ranges.records(spark, f"{folder.rstrip('/')}/*.json", ranges.JSON_MEMBERS)
    rows = found.select(_member("[", "]").alias("member"), _stem("file").alias("topic")).filter(F.btrim("member", F.lit(" \t\r\n")) != "")
    return _as_tasks(rows.select(F.from_json("member", schemas.TASK_JSON).alias("task"), "topic").select("task.*", "topic"), F.col("topic"))


def _stem(path: str) -> Column:
    """The stem of a .json file from its path, which Spark gives percent-encoded."""
    return F.regexp_extract(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"([^/]*)\.json$", 1)


def _as_tasks(rows: DataFrame, topic: Column) -> DataFrame:
    options = F.transform(
        "answer_options",
        lambda o: F.struct(
            o["answer"].alias("answer"),
            # Present and neither false nor zero nor empty.
            F.coalesce(~o["is_correct"].isin("false", "0", "0.0", ""), F.lit(False)).alias(
                "is_correct"
            ),
        ),
    )
    return rows.select(
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce(options, F.array()).alias("answer_options"),
        topic.alias("topic"),
    )


def tasks_of_json(tasks: DataFrame) -> DataFrame:
    """Question, reference answer and topic, sorted by topic."""
    return tasks.select(
        "question", reference_option(F.col("answer_options")).alias("reference_answer"), "topic"
    ).orderBy("topic")


def grades_json(spark: SparkSession, path, whole_file: bool = True) -> DataFrame:
    """(participant, subtask, points) from {participant: {subtask: points}}.

    Without `whole_file`, every line is such an object, so that large exports
    can be split.
    """
    text = spark.read.text(path, wholetext=whole_file)
    people = text.select(
        F.explode(F.from_json("value", schemas.GRADES)).alias("participant", "grades")
    )
    return people.select("participant", F.explode("grades").alias("subtask", "points"))


def split_grades_json(spark: SparkSession, path) -> DataFrame:
    """`grades_json` of whole files of any size: participants' objects leave as they close, from all byte ranges at once."""
    found = ranges.records(spark, path, ranges.JSON_MEMBERS)
    person = F.from_json(F.concat(F.lit("{"), _member("{", "}"), F.lit("}")), schemas.GRADES)
    people = found.select(F.explode(person).alias("participant", "grades"))
    return people.select("participant", F.explode("grades").alias("subtask", "points"))


def splits(read, paths: dict) -> DataFrame:
    """Tables of several splits as one, with a split column.

    `read(path)` reads one table. A split whose path is None is skipped, as
    an unused test set is. Task ids become text, so that splits with numeric
    and with textual ids fit together.
    """
    table = None
    for split, path in paths.items():
        if path is None:
            continue
        part = read(path).withColumn("split", F.lit(split))
        if "task_id" in part.columns:
            part = part.withColumn("task_id", F.col("task_id").cast("string"))
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    if table is None:
        raise ValueError("no split has a path")
    return table


def corpus(read, paths: dict) -> DataFrame:
    """A five-way corpus as three-way answers, all splits in one table."""
    rows = splits(read, paths)
    return rows.withColumnsRenamed({"id": "task_id"}).select(
        F.col("task_id").cast("string").alias("task_id"),
        "question",
        "reference_answer",
        F.lit(fv.FIVE_WAY_TOPIC).alias("topic"),
        "student_answer",
        collapse_five_way(F.col("label")).alias("labels"),
        "split",
    )
