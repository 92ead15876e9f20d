"""Quality rules: plain text statistics, and robust outliers per language and source.

Words are runs outside `[\\x20\\x09-\\x0D]`. A document fails the base rules with fewer than
50 words, or if over half of its words lie in three-word windows that the text
holds twice or more. The others are judged by their vector of six transformed
statistics: within each language and source, a minimum-covariance-determinant
estimate (the mean and covariance of the densest 75 % of documents, found by
repeated concentration steps) gives Mahalanobis distances, and documents beyond
the cut-off are rejected.

The estimates are made by counting: vectors are whole thousandths and sums
are whole numbers, so results do not depend on partitions or their order. A step
aggregates sums per group and distance class; groups of any size take part whole,
and no group is gathered anywhere. A source's estimate is blended with its
language's, by the number of documents against PRIOR_WEIGHT, so a small source needs
no rule of its own. A floor is added to every covariance, as shares of
symbols or repeats are 0 in most documents.

NULL texts have no words. NULL languages and sources are a group like others. An empty table
gives an empty result; repeated rows are judged alike.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.llm import wordhash
from answerloom.llm.linking import small_side
from answerloom.llm.rows import text_key, without_rows
from answerloom.session import settle

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BREAKS = " \t\n\x0b\x0c\r"

#: Log of mean word length; roots of the shares of symbols, repeated words and
#: repeated lines; logs of words per line and of words.
STATISTICS = ("word_length", "symbols", "repeats", "lines", "line_length", "length")
#: Deviations below which a statistic's spread is not believed.
FLOORS = (0.03, 0.03, 0.12, 0.15, 0.2, 0.3)
CORE_SHARE = 0.75
STEPS = 6
PRIOR_WEIGHT = 100
#: Chance of rejecting a document of a normal population.
REJECT_CHANCE = 1e-9
UNIT = 1000
# Distance classes per doubling of the squared distance.
CLASSES = 16

N = len(STATISTICS)


def _chi2_share(x: float, freedom: int) -> float:
    """Share of a chi-square distribution up to x, for even degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(freedom // 2))


def _chi2_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_share(middle, freedom) < share else (low, middle)
    return low


#: Makes the core's covariance that of all, for normal vectors.
CONSISTENCY = CORE_SHARE / _chi2_share(_chi2_quantile(CORE_SHARE, N), N + 2)
CUT_OFF = _chi2_quantile(1 - REJECT_CHANCE, N)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines with a word."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    hashes, _, _ = wordhash.words(raw, wordhash.EXACT)
    n = len(hashes)
    chars = int(np.count_nonzero(~wordhash.SPACE[data] & ((data & 0xC0) != 0x80)))
    symbols = int(np.count_nonzero(_SYMBOL[data]))
    seen, repeated_lines, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            repeated_lines += line in seen
            seen.add(line)
    repeats = 0
    if n >= 3:
        _, place, count = np.unique(wordhash.shingles(hashes, 3), return_inverse=True, return_counts=True)
        often = count[place] > 1
        inside = np.zeros(n, dtype=bool)
        for k in range(3):
            inside[k : n - 2 + k] |= often
        repeats = int(np.count_nonzero(inside))
    return n, chars, symbols, repeated_lines, repeats, lines


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_counts(text.as_py()) for text in batch.column("text")]
        columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS)
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *columns], [*names, *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, mark, lang_key, group_key, the counts, base_failed, and the vector."""
    text = F.col("text").cast("string")
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("lang", "source"))
    mine = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("mark"),
        F.xxhash64(F.lit("lang"), lang).alias("lang_key"), F.xxhash64(F.lit("source"), lang, source).alias("group_key"),
        text.alias("text"),
    )
    counted = mine.mapInArrow(
        _count, "doc_id long, mark long, lang_key long, group_key long, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    values = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_repeat_words") / words), F.sqrt(F.col("n_dup_lines") / lines),
        F.log(words / lines), F.log(words),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.select(
        "*", failed.alias("base_failed"),
        *[F.round(v * UNIT).cast("long").alias(s) for s, v in zip(STATISTICS, values)],
    )


def _squared_distance() -> Column:
    """Mahalanobis distance of a row's vector, squared, next to its group's center and inverse."""
    away = [F.col(s) / UNIT - F.col("center")[k] for k, s in enumerate(STATISTICS)]
    total = F.lit(0.0)
    for i in range(N):
        row = F.lit(0.0)
        for j in range(N):
            row = row + F.col("inverse")[i * N + j] * away[j]
        total = total + row * away[i]
    return total


ESTIMATE = "key long, center array<double>, covariance array<double>, inverse array<double>"
PAIRS = [(i, j) for i in range(N) for j in range(i, N)]
#: Bytes of a row of estimates.
ESTIMATE_BYTES = 8 * (2 + N + 2 * N * N)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Center, covariance and inverse from a group's sums, blended with its parent's."""
    floor = np.diag(np.square(FLOORS))
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            n = row["n"]
            center = np.array(row["sums"]) / n / UNIT
            covariance = np.zeros((N, N))
            for (i, j), product in zip(PAIRS, row["products"]):
                covariance[i, j] = covariance[j, i] = product / n / UNIT**2 - center[i] * center[j]
            if row["parent_center"] is not None:
                above = np.array(row["parent_center"])
                share = n / (n + PRIOR_WEIGHT)
                apart = center - above
                covariance = (
                    share * covariance + (1 - share) * np.array(row["parent_covariance"]).reshape(N, N)
                    + share * (1 - share) * np.outer(apart, apart)
                )
                center = share * center + (1 - share) * above
            inverse = np.linalg.inv(CONSISTENCY * covariance + floor)
            out.append((row["key"], center.tolist(), covariance.ravel().tolist(), inverse.ravel().tolist()))
        keys, *arrays = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), *[pa.array(x, pa.list_(pa.float64())) for x in arrays]],
            ["key", "center", "covariance", "inverse"],
        )


def _first_estimates(vectors: DataFrame) -> DataFrame:
    """Medians, and deviations from the quartiles, of each key and statistic: a robust start."""
    cells = vectors.select(
        "key", F.posexplode(F.array(*STATISTICS)).alias("k", "value")
    ).groupBy("key", "k", "value").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("key", "k")
    upto = whole.orderBy("value")
    placed = cells.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))
    quarter = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("value"))) / UNIT for k in (1, 2, 3)]
    spread = placed.groupBy("key", "k").agg(
        quarter[1].alias("median"), F.pow((quarter[2] - quarter[0]) / 1.349, F.lit(2)).alias("variance")
    )
    lists = spread.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "median", "variance"))).alias("s"))
    floor = [f * f for f in FLOORS]
    zero = F.lit(0.0)
    cell = lambda i, j: F.col("s")[i]["variance"] if i == j else zero
    inverse = lambda i, j: 1 / (CONSISTENCY * cell(i, i) + floor[i]) if i == j else zero
    square = [(i, j) for i in range(N) for j in range(N)]
    return lists.select(
        "key", F.col("s.median").alias("center"), F.array(*[cell(i, j) for i, j in square]).alias("covariance"),
        F.array(*[inverse(i, j) for i, j in square]).alias("inverse"),
    )


def _concentrated(vectors: DataFrame, estimates: DataFrame, parents: DataFrame | None, steps: int) -> DataFrame:
    """Estimates after so many steps: each from the nearest CORE_SHARE of a key's vectors by the last one."""
    for _ in range(steps):
        near = vectors.join(small_side(estimates, ESTIMATE_BYTES), "key")
        level = F.floor(F.log2(F.greatest(_squared_distance(), F.lit(1e-6))) * CLASSES)
        columns = [F.sum(s).alias(f"s_{s}") for s in STATISTICS] + [
            F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p_{i}_{j}") for i, j in PAIRS
        ]
        cells = near.select("key", "parent", *STATISTICS, level.alias("level")).groupBy("key", "parent", "level").agg(
            F.count("*").alias("n"), *columns
        )
        whole = Window.partitionBy("key")
        before = F.coalesce(F.sum("n").over(whole.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        core = cells.withColumn("before", before).withColumn("total", F.sum("n").over(whole)).filter(
            F.col("before") < F.col("total") * CORE_SHARE
        )
        sums = core.groupBy("key", "parent").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(f"s_{s}") for s in STATISTICS]).alias("sums"),
            F.array(*[F.sum(f"p_{i}_{j}") for i, j in PAIRS]).alias("products"),
        )
        if parents is None:
            kind = "array<double>"
            above = sums.select(
                "*", F.lit(None).cast(kind).alias("parent_center"), F.lit(None).cast(kind).alias("parent_covariance")
            )
        else:
            above = sums.join(small_side(parents, ESTIMATE_BYTES).select(
                F.col("key").alias("parent"), F.col("center").alias("parent_center"),
                F.col("covariance").alias("parent_covariance"),
            ), "parent")
        estimates = settle(above.drop("parent").mapInArrow(_estimates, ESTIMATE), "estimates")
    return estimates


def judged(docs: DataFrame) -> DataFrame:
    """`statistics` of every row with `distance` (squared) and `kept`."""
    known = settle(statistics(docs), "statistics")
    able = known.filter("not base_failed")
    by_lang = able.select(F.col("lang_key").alias("key"), F.lit(0).cast("long").alias("parent"), *STATISTICS)
    by_group = able.select(F.col("group_key").alias("key"), F.col("lang_key").alias("parent"), *STATISTICS)
    langs = _concentrated(by_lang, settle(_first_estimates(by_lang), "estimates"), None, STEPS)
    start = settle(
        by_group.select("key", "parent").distinct().join(
            small_side(langs, ESTIMATE_BYTES).withColumnRenamed("key", "parent"), "parent"
        ).drop("parent"), "estimates",
    )
    groups = _concentrated(by_group, start, langs, STEPS)
    final = small_side(groups, ESTIMATE_BYTES).withColumnRenamed("key", "group_key")
    distance = F.when(~F.col("base_failed"), _squared_distance())
    return known.join(final, "group_key", "left").withColumn("distance", distance).withColumn(
        "kept", ~F.col("base_failed") & (F.col("distance") <= CUT_OFF)
    ).drop("center", "covariance", "inverse")


def quality_report(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, distance, kept) of every row of docs."""
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs that are kept."""
    rejected = settle(
        judged(docs).filter("not kept").select("doc_id", "mark", "group_key").distinct(), "rejected",
    )
    lang, source = (F.coalesce(docs[c].cast("string"), F.lit("\0")) for c in ("lang", "source"))
    return without_rows(docs, small_side(rejected, 24), {"group_key": F.xxhash64(F.lit("source"), lang, source)})
