"""Line deduplication over a whole corpus, with built-in functions only.

A line's key is the line stripped of `[\\x20\\x09-\\x0D]` at both ends, A-Z
lower-cased. Keys travel as 128 bits of hash, never as text. The hashes are
range-partitioned with their document, sorted by document and position, and
streamed once: the first line of each key and document is marked. A key that a
third of all documents hold thereby spans many partitions; its documents
are counted by partial sums. What comes back is one sparse bitmap per
document that loses lines.

Rows that repeat a doc_id count as one document; so do all rows without one. NULL
and empty texts are one empty line. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.llm.linking import small_side
from answerloom.llm.rows import SPACES, ascii_lower, keyed_texts, same_row, text_key
from answerloom.session import settle

MIN_DOCS = 10
MIN_CHARS = 1
LINE_BREAK = "\n"


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key_1, key_2, doc_id, mark, pos, is_first) of each line with a key of `min_chars` code points or more.

    is_first marks one line of each key and document.
    """
    lines = keyed_texts(docs).select("doc_id", "mark", F.posexplode(F.split("text", LINE_BREAK, -1)).alias("pos", "line"))
    key = F.btrim(ascii_lower(F.col("line")), F.lit(SPACES))
    hashed = (
        lines.select("doc_id", "mark", "pos", key.alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("key_1"), F.xxhash64(F.lit(1), "key").alias("key_2"), "doc_id", "mark", "pos"
        )
    )
    # The window needs no exchange of its own: the ranges already hold each key and document together.
    ranged = hashed.repartitionByRange("key_1", "key_2", "doc_id")
    order = Window.partitionBy("key_1", "key_2", "doc_id").orderBy("mark", "pos")
    return ranged.withColumn("is_first", F.row_number().over(order) == 1)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(doc_id, mark, dropped): which lines go, for documents that lose any.

    `dropped` maps a word's number to its 64 bits, bit k of word w standing for
    line 64 w + k; words without a dropped line are absent. Keys of
    `min_docs` documents or more lose all their lines, or, with `keep_first`, all but
    the first line of the smallest doc_id.
    """
    found = settle(occurrences(docs, min_chars), "line-keys")
    spot = F.struct("doc_id", "mark", "pos")
    firsts = found.filter("is_first")
    frequent = firsts.groupBy("key_1", "key_2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    frequent = settle(frequent.select("key_1", "key_2"), "frequent-lines")
    dropped = found.join(small_side(frequent), ["key_1", "key_2"])
    if keep_first:
        heads = dropped.groupBy("key_1", "key_2").agg(F.min(spot).alias("head"))
        dropped = dropped.join(heads, ["key_1", "key_2"]).filter(F.col("head") != spot)
    bit = F.expr("shiftleft(1L, cast(pos & 63 as int))")
    words = dropped.groupBy("doc_id", "mark", F.expr("pos >> 6").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "mark").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("dropped")
    )


# Line numbers of a bitmap's set bits.
POSITIONS = (
    "flatten(transform(map_entries(dropped), e -> transform("
    "filter(sequence(0, 63), k -> (shiftrightunsigned(e.value, k) & 1) = 1), k -> e.key * 64 + k)))"
)


def _line_columns(text: Column) -> dict[str, Column]:
    """Number of lines, of dropped ones, and the text left over, next to a bitmap."""
    lines = F.split(text, LINE_BREAK, -1)
    gone = F.expr(POSITIONS)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    left = F.array_join(F.transform(kept, lambda i: lines[i]), LINE_BREAK)
    rest = (
        F.when(F.col("dropped").isNull(), text)
        .when(F.size(gone) == F.size(lines), F.lit(""))
        .otherwise(left)
    )
    n_gone = F.when(F.col("dropped").isNull(), 0).otherwise(F.size(gone))
    return {"n_lines": F.size(lines).cast("long"), "n_dropped": n_gone.cast("long"), "rest": rest}


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of docs."""
    bitmaps = settle(keep_bitmaps(docs, min_docs, min_chars), "bitmaps")
    texts = keyed_texts(docs)
    columns = _line_columns(F.col("text"))
    return texts.join(bitmaps, same_row(texts, bitmaps), "left").select(
        texts["doc_id"], columns["n_lines"].alias("n_lines"), columns["n_dropped"].alias("n_dropped"),
        F.sha2(columns["rest"], 256).alias("kept_sha256"),
    )


def without_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows and columns of docs, texts without the dropped lines; a NULL text stays NULL.

    Where there is a column n_chars, it counts the code points of the text left over.
    """
    bitmaps = settle(keep_bitmaps(docs, min_docs, min_chars), "bitmaps")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    joined = whole.join(
        bitmaps, F.col("row.doc_id").cast("long").eqNullSafe(bitmaps["doc_id"]) & (text_key(text) == bitmaps["mark"]), "left"
    )
    left = joined.select("row", _line_columns(text)["rest"].alias("rest"))
    changed = {"text": F.col("rest")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("rest").cast(docs.schema["n_chars"].dataType)
    return left.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
