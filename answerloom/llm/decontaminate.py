"""Benchmark decontamination by SimHash windows, with built-in functions only.

Texts are lower-cased and cut into words at ASCII signs and spaces; a shingle is five
consecutive words, weighted by how often it occurs. A window has as many
shingles as the benchmark item it is held against (fewer at a text's end). An item is found in
a document if some window reaches a weighted Jaccard similarity of `percent` percent.

1. Positions whose shingle occurs in the benchmark. A window of similarity t to an
   item holds at least t times the item's size of its shingles, and moved to its
   first such shingle it loses none: only windows that start there and hold
   enough are kept. Nothing that could reach t is lost.
2. Windows get a 64-bit SimHash, each shingle counting once per occurrence.
   Equal fingerprints are looked up once, so a passage copied into very
   many documents costs one search.
3. Fingerprints are cut into RADIUS + 1 blocks. Two within the radius agree in at least one
   block, so joining by block finds all of them. At similarity 0.75 some 11 of 64 bits
   differ, with a deviation of 3; the radius lies more than four deviations above. Blocks are that short, so a window
   is looked up under the items alone that step 1 found in it: a fingerprint meets an item once per block at most.
4. Exact weighted-shingle similarity of window and item decides, from the window's own hits.

Items of fewer than five words have no shingle and are found nowhere. NULL texts are empty.
Rows that repeat a doc_id are reported once, with their best window.
"""

from pyspark.sql import Column, DataFrame, functions as F

from answerloom.llm.linking import small_side
from answerloom.llm.rows import keyed_texts, without_rows
from answerloom.session import settle

SHINGLE_WORDS = 5
PERCENT = 75
RADIUS = 25
BITS = 64

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_A_WORD, -1), "")


def _shingle(words: Column, at: Column) -> Column:
    return F.xxhash64(*[words[at + k] for k in range(SHINGLE_WORDS)])


def _shingles(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_shingles, pos, shingle): one row per position of a text of five words or more."""
    worded = table.select(*keys, text_words(F.col("text")).alias("words")).filter(F.size("words") >= SHINGLE_WORDS)
    n = F.size("words") - (SHINGLE_WORDS - 1)
    placed = worded.select(
        *keys, n.cast("long").alias("n_shingles"), "words", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos")
    )
    return placed.select(*keys, "n_shingles", F.col("pos").cast("long").alias("pos"), _shingle(F.col("words"), F.col("pos")).alias("shingle"))


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, print): SimHash of the shingles of each key, one row of `rows` per occurrence.

    Two bits' counters share a long, so 32 sums count 64 bits.
    """
    lanes = [
        F.sum(F.shiftrightunsigned("shingle", k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"lane_{k}")
        for k in range(BITS // 2)
    ]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("total"), *lanes)
    value = F.lit(0).cast("long")
    for k in range(BITS // 2):
        low = F.col(f"lane_{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"lane_{k}", 32)
        for count, bit in ((low, k), (high, k + BITS // 2)):
            one = F.shiftleft(F.lit(1).cast("long"), bit)
            value = value.bitwiseOR(F.when(count * 2 > F.col("total"), one).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, value.alias("print"))


def blocks(value: Column, radius: int = RADIUS) -> Column:
    """radius + 1 structs (block, part): the bits of each block of a fingerprint."""
    count = radius + 1
    out, at = [], 0
    for k in range(count):
        width = BITS // count + (k < BITS % count)
        part = F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1))
        out.append(F.struct(F.lit(k).alias("block"), part.alias("part")))
        at += width
    return F.array(*out)


def matches(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, mark, item_id, start, size, whole, common, union) of each window that reaches an item."""
    share = percent / 100
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    item_rows = settle(_shingles(items, ["item_id"]).withColumnRenamed("n_shingles", "size"), "item-shingles")
    weights = settle(item_rows.groupBy("item_id", "size", "shingle").agg(F.count("*").alias("weight")), "item-weights")
    texts = keyed_texts(docs)
    row = ["doc_id", "mark"]
    hits = settle(
        _shingles(texts, row).join(small_side(weights), "shingle")
        .groupBy(*row, "n_shingles", "item_id", "size")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "shingle", "weight"))).alias("hits")),
        "hits",
    )
    # The hit that makes the window full enough must lie within it.
    need = F.ceil(F.col("size") * share - 1e-6).cast("int")
    starts = F.filter(
        F.transform("hits", lambda h, i: F.struct(
            h["pos"].alias("pos"), F.get(F.col("hits"), i + need - 1)["pos"].alias("end"), i.alias("at"),
        )),
        lambda w: w["end"] - w["pos"] < F.col("size"),
    )
    # A place has one shingle, so `size` hits from the window's first one on are all that it can hold.
    own = F.filter(
        F.slice("hits", F.col("w.at") + 1, F.col("size").cast("int")), lambda h: h["pos"] < F.col("w.pos") + F.col("size")
    )
    windows = settle(
        hits.filter(F.size("hits") >= need).select(*row, "item_id", "n_shingles", "size", "hits", F.explode(starts).alias("w"))
        .select(*row, "item_id", "n_shingles", "size", F.col("w.pos").alias("start"), own.alias("hits")),
        "windows",
    )
    near = small_side(settle(windows.select(*row).distinct(), "window-rows"))
    again = texts.join(
        near.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")),
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left_semi",
    )
    words = text_words(F.col("text"))
    hashed = again.dropDuplicates(row).select(
        *row, words.alias("words")
    ).select(
        F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"),
        F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE_WORDS), lambda i: _shingle(F.col("words"), i)).alias("all"),
    )
    inside = windows.select(*row, "size", "start").distinct().join(
        hashed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    ).select(*row, "size", "start", F.explode(F.slice("all", F.col("start").cast("int") + 1, F.col("size").cast("int"))).alias("shingle"))
    printed = settle(fingerprints(inside, [*row, "size", "start"]), "window-prints")
    item_prints = settle(fingerprints(item_rows, ["item_id", "size"]), "item-prints")

    def by_block(table, *keys):
        return table.select(*keys, "size", "print", F.explode(blocks(F.col("print"), radius)).alias("b")).select(
            *keys, "size", "print", F.col("b.block").alias("block"), F.col("b.part").alias("part")
        )

    def same(left, right, *names):
        condition = F.lit(True)
        for name in names:
            condition = condition & left[name].eqNullSafe(right[name])
        return condition

    held = windows.join(printed, same(windows, printed, *row, "size", "start")).select(
        *[windows[c] for c in windows.columns], "print"
    )
    left = by_block(held.select("item_id", "size", "print").distinct(), "item_id")
    right = by_block(item_prints, "item_id").withColumnRenamed("print", "item_print")
    matched = settle(
        left.join(right, same(left, right, "item_id", "size", "block", "part"))
        .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select(left["item_id"], left["size"], "print").distinct(),
        "matched-prints",
    )
    candidates = held.join(small_side(matched, 24), same(held, matched, "item_id", "size", "print"), "left_semi")
    whole = F.least("size", F.col("n_shingles") - F.col("start"))
    window = [*row, "item_id", "start", "size", "whole"]
    common = (
        candidates.select(*row, "item_id", "start", "size", whole.alias("whole"), F.explode("hits").alias("h"))
        .groupBy(*window, "h.shingle").agg(F.least(F.count("*"), F.max("h.weight")).alias("least"))
        .groupBy(*window).agg(F.sum("least").alias("common"))
    )
    return common.withColumn("union", F.col("whole") + F.col("size") - F.col("common")).filter(
        F.col("common") * 100 >= F.col("union") * percent
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of each item found in a document.

    first_word and n_words tell the most similar window, the first of equals.
    """
    best = F.max(F.struct(
        (F.col("common") / F.col("union")).alias("similarity"), (-F.col("start")).alias("start"), "whole"
    )).alias("best")
    return matches(docs, benchmark, percent, radius).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("first_word"),
        (F.col("best.whole") + SHINGLE_WORDS - 1).alias("n_words"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of docs, without those in whose text an item is found."""
    found = settle(matches(docs, benchmark, percent).select("doc_id", "mark").distinct(), "found")
    return without_rows(docs, small_side(found))
