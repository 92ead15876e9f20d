"""Records of large text files, read in parallel where a record may hold its own separator.

A quoted CSV field may hold line breaks, and a comma between JSON members looks like any other comma; so a reader
that starts in the middle of a file does not know where the next record begins. Here Spark cuts a file into byte
ranges at separators, as it does for plain lines, and every range is first summed up as a step of a small automaton:
how many quotes it has, and by how much it changes the nesting depth if it is entered outside or inside a quoted part.
Steps combine by addition, so running sums over the ranges of a file, one short row per range, tell each range in
which state it begins. Then each task knows its record starts. Only what lies before a range's first start, and an
unfinished last record, is handed over to be joined with its other parts.

Files are read by as many tasks as they have ranges: once for the steps, once for the records, and once for the parts
at range borders. No task holds more than a batch and one record. All three readings must cut the files alike; if the
cluster has grown in between and Spark cuts anew, the job fails with a message and gives no wrong rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from answerloom.session import settle

_STEPS = "file string, block long, quotes long, outside long, inside long"
_PIECES = "file string, block long, kind string, text string, opens boolean, closes boolean"
HEAD, RECORD, TAIL = "head", "record", "tail"

#: The states of all ranges go to every task, about 100 bytes each.
MOST_RANGES = 400_000


@dataclass(frozen=True)
class Format:
    """What separates records, and how deep they are nested.

    `escape` is the pattern of quotes (and other characters) that are escaped inside quotes; a doubled quote needs
    none, as it leaves the count even. Records begin after separators outside quotes at a depth of `level` at most.
    """

    separator: str
    level: int = 0
    escape: str | None = None


CSV = Format("\n")
JSON_MEMBERS = Format(",", 1, r"\\.")


class _Scanner:
    """Quotes and depth of a file's pieces in order, from a given state."""

    def __init__(self, form: Format, quotes: int = 0, depth: int = 0):
        self.form, self.quotes, self.depth = form, quotes, depth

    def unescaped(self, values: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(values, self.form.escape, "") if self.form.escape else values

    def quote_counts(self, values: pa.Array) -> np.ndarray:
        return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)

    def depths(self, values: pa.Array, inside: np.ndarray) -> np.ndarray:
        """Change of depth by each piece, `inside` telling which begin inside quotes."""
        if not self.form.level:
            return np.zeros(len(values), np.int64)
        begun = pc.replace_substring_regex(values, r'^[^"]*("|$)', "")
        bare = pc.replace_substring_regex(pc.if_else(pa.array(inside), begun, values), r'"[^"]*("|$)', "")
        change = np.zeros(len(values), np.int64)
        for bracket, by in (("{", 1), ("[", 1), ("}", -1), ("]", -1)):
            change += by * pc.count_substring(bare, bracket).to_numpy(zero_copy_only=False).astype(np.int64)
        return change

    def scan(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(whether each piece starts a record, depth after it), moving the state past them."""
        plain = self.unescaped(values)
        counts = self.quote_counts(plain)
        after = self.quotes + np.cumsum(counts)
        inside = (after - counts) % 2 == 1
        change = self.depths(plain, inside)
        deep = self.depth + np.cumsum(change)
        starts = ~inside & (deep - change <= self.form.level)
        if len(values):
            self.quotes, self.depth = int(after[-1]) % 2, int(deep[-1])
        return starts, deep

    def at_start(self) -> bool:
        return not self.quotes and self.depth <= self.form.level


def _by_block(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The parts of a batch that lie in one range of one file."""
    if not batch.num_rows:
        return
    file, block = batch.column("file").to_pylist(), batch.column("block").to_numpy()
    at = 0
    while at < batch.num_rows:
        end = at + 1
        if file[-1] == file[at] and block[-1] == block[at]:
            end = batch.num_rows
        else:
            while end < batch.num_rows and file[end] == file[at] and block[end] == block[at]:
                end += 1
        yield file[at], int(block[at]), batch.slice(at, end - at)
        at = end


def _steps(form: Format):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per range: quotes, and change of depth if entered outside and inside quotes."""
        now, sums = None, None

        def row():
            values = [now[0], now[1], sums[0].quotes, sums[0].depth, sums[1].depth]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], ["file", "block", "quotes", "outside", "inside"])

        for batch in batches:
            for file, block, part in _by_block(batch):
                if (file, block) != now:
                    if now is not None:
                        yield row()
                    now, sums = (file, block), (_Scanner(form), _Scanner(form, 1))
                for scanner in sums if form.level else sums[:1]:
                    scanner.scan(part.column("value"))
        if now is not None:
            yield row()
    return run


def _records(form: Format, wanted: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records and border parts of kinds `wanted`, in order. `opens`: at the file's start, `closes`: nothing is left open."""
        now, scanner, parts, begun, opens = None, None, [], False, False

        def rows(kind, texts, first_opens, closes):
            n = len(texts)
            flags = np.zeros(n, bool)
            flags[0] = first_opens
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([now[0]] * n), pa.array([now[1]] * n, pa.int64()), pa.array([kind] * n),
                    texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), pa.array(flags), pa.array(closes),
                ],
                ["file", "block", "kind", "text", "opens", "closes"],
            )

        def rest():
            """What is left of a range at its end: its last record, or its part of one."""
            if parts:
                kind = HEAD if not begun else RECORD if scanner.at_start() else TAIL
                if kind in wanted:
                    yield rows(kind, [form.separator.join(parts)], opens, [scanner.depth == 0 and not scanner.quotes])

        for batch in batches:
            for file, block, part in _by_block(batch):
                if (file, block) != now:
                    yield from rest()
                    now, parts, begun = (file, block), [], False
                    scanner = _Scanner(form, part.column("quotes")[0].as_py(), part.column("depth")[0].as_py())
                    opens = part.column("opens")[0].as_py()
                values = part.column("value")
                starts, depth = scanner.scan(values)
                at = np.flatnonzero(starts)
                if not len(at):
                    parts.extend(values.to_pylist())
                    continue
                # What was open ends at the first start here.
                parts.extend(values.slice(0, int(at[0])).to_pylist())
                if parts:
                    kind = RECORD if begun else HEAD
                    if kind in wanted:
                        yield rows(kind, [form.separator.join(parts)], opens, [False])
                    opens = False
                begun = True
                last = int(at[-1])
                if len(at) > 1:
                    if RECORD in wanted:
                        whole = values.slice(int(at[0]), last - int(at[0]))
                        if len(whole) > len(at) - 1:
                            offsets = pa.array(at - at[0], pa.int32())
                            whole = pc.binary_join(pa.ListArray.from_arrays(offsets, whole), form.separator)
                        yield rows(RECORD, whole, opens, depth[at[1:] - 1] == 0)
                    opens = False
                parts = values.slice(last).to_pylist()
        yield from rest()
    return run


def _pieces(spark: SparkSession, path, form: Format) -> DataFrame:
    """(file, block, value): pieces between separators, in file order inside each range."""
    text = spark.read.text(path, lineSep=form.separator)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _states(spark: SparkSession, path, form: Format) -> DataFrame:
    """(file, block, quotes, depth, opens): the state in which each range begins. One row per range."""
    steps = settle(_pieces(spark, path, form).mapInArrow(_steps(form), _STEPS), "ranges")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    change = F.when(F.col("before") == 1, F.col("inside")).otherwise(F.col("outside"))
    known = steps.withColumn("before", quotes).withColumn("change", change)
    return settle(
        known.select(
            "file", "block", F.col("before").alias("quotes"), F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"),
            (F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1).alias("opens"),
        ),
        "range-states",
    )


def records(spark: SparkSession, path, form: Format) -> DataFrame:
    """(file, text, opens, closes) of every record of the files.

    `opens` marks a file's first record, `closes` one after which nothing is left open (as the end of a JSON text).
    """
    states = _states(spark, path, form)
    if (ranges := states.count()) > MOST_RANGES:
        raise ValueError(f"{ranges} ranges: read the files in several calls, or raise spark.sql.files.maxPartitionBytes")
    cut_anew = F.raise_error(F.lit("the ranges of the files changed while they were read; set spark.sql.files.minPartitionNum"))
    # One row per range, in the order of the larger side: rows stay in file order inside their range.
    pieces = (
        _pieces(spark, path, form).join(F.broadcast(states), ["file", "block"], "left")
        .withColumn("quotes", F.coalesce("quotes", cut_anew.cast("long")))
    )
    whole = pieces.mapInArrow(_records(form, (RECORD,)), _PIECES)
    borders = settle(pieces.mapInArrow(_records(form, (HEAD, TAIL)), _PIECES), "range-borders")
    # A tail opens a record; heads of later ranges go on with it.
    place = F.struct("block", (F.col("kind") == TAIL).alias("late"))
    order = Window.partitionBy("file").orderBy(place)
    joined = (
        borders.withColumn("number", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
        .groupBy("file", "number")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), "text"))), lambda x: x["text"]), form.separator)
            .alias("text"),
            F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes"),
        )
    )
    names = ("file", "text", "opens", "closes")
    return whole.select(*names).unionByName(joined.select(*names))


def without_bom(text: Column, first: Column) -> Column:
    """The text of a file's first record without a byte order mark."""
    return F.when(first, F.regexp_replace(text, "^﻿", "")).otherwise(text)
