"""Shared column expressions: row keys and cleaned text columns."""

from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, all other characters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def text_key(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id with other text; NULL reads as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text) of all rows: only these columns, so names cannot clash.

    A row is known by doc_id and mark; equal rows share them. NULL texts are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("mark"), text.alias("text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Rows of equal (doc_id, mark); NULL ids are equal to each other."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["mark"] == right["mark"])


def without_rows(docs: DataFrame, gone: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """The rows and columns of docs, save those whose doc_id and mark are in `gone`.

    `extra` maps further columns of `gone` to what they must equal.
    """
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (text_key(docs["text"].cast("string")) == gone["mark"])
    for name, value in (extra or {}).items():
        same = same & (value == gone[name])
    return docs.join(gone, same, "left_anti")
