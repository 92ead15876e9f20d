"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of a budget of words by its weight, but at most `most` times its own size; what it cannot
use is shared again by weight among the others, until none is above. A source is first taken whole as often as its
target holds it (complete epochs). The rest of its target is drawn without replacement: documents are sorted by
exponential keys, -ln(u) / w with u from the document's id and w its quality weight, and taken from the front for as
long as the middle of the next one lies within the rest. A mix therefore misses a target by half a document at most.

Keys are range-partitioned by source and key, so a source that holds most of the table is sorted by many tasks. Words
are summed per range first; only in the one range per source where the budget ends are they summed row by row. What
leaves that step is one row per source: its epochs and the first key left out. The decision for a document is then a
comparison next to its row, and the texts never move.

Words are runs outside `[\\x20\\x09-\\x0D]`; a NULL text has none. A NULL source is a source. Rows that repeat a doc_id in
one source are one document of all their words: drawn together or not at all; rows without doc_id likewise. Documents
without a label, or with labels that disagree evenly, weigh 1. A source without words, or without a weight, has a
target of 0. An empty table gives an empty mix. Reruns give the same mix, as nothing depends on the place of a row.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.functions.hashing import order_hash
from answerloom.operators.ranking import sorted_rank
from answerloom.session import settle

MOST = 3
SEED = 42
CYCLE = 3
GOOD, BAD = 2.0, 0.5
WORD = r"[^\x20\x09-\x0D]+"
_DIGITS, _STEPS = 13, float(16**13)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def exponential_key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight; the smallest keys of a set are a weighted sample without replacement."""
    digits = F.substring(order_hash(F.coalesce(doc_id.cast("string"), F.lit("")), seed), 1, _DIGITS)
    u = (F.conv(digits, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(_STEPS)
    return -F.log(u) / weight


def label_weights(labels: DataFrame, good: float = GOOD, bad: float = BAD) -> DataFrame:
    """(doc_id, weight): `good` or `bad` by the majority of a document's quality labels, 1 where they are even."""
    share = F.avg("quality")
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.when(share > 0.5, good).when(share < 0.5, bad).otherwise(1.0).alias("weight"))
    )


def sized(docs: DataFrame, quality: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, key) of every row of docs, written once: the only pass over the texts.

    `quality` is (doc_id, weight), one row per document, weights above 0.
    """
    short = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    if quality is None:
        weighted = short.withColumn("weight", F.lit(1.0))
    else:
        weighted = short.join(quality.select("doc_id", "weight"), "doc_id", "left").fillna({"weight": 1.0})
    key = exponential_key(F.col("doc_id"), F.col("weight"), seed)
    return settle(weighted.select("doc_id", "source", "size", key.alias("key")), "mixing-sized")


def cyclic_weights(rows: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(source, weight): sources by code point, NULL last, weigh 1 to `cycle`, repeating."""
    ranked = sorted_rank(rows.select("source").distinct(), [F.col("source").asc_nulls_last()], "place")
    return ranked.select("source", ((F.col("place") - 1) % cycle + 1).cast("double").alias("weight"))


def targets(rows: DataFrame, weights: DataFrame, budget: int | None = None, most: int = MOST) -> DataFrame:
    """(source, source_size, target): the budget shared by weight, no target above `most` times its source.

    `budget` is a number of words, all of the rows' where it is None. Each round shares what the full sources leave
    over among the others; only two sums come to the driver. Rounds end when no further source is full.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = settle(
        totals.join(weights.withColumnRenamed("source", "_source"), _same(F.col("source"), F.col("_source")), "left")
        .select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")),
        "mixing-sources",
    )
    cap, weight = F.col("source_size") * F.lit(float(most)), F.col("weight")
    first = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("open")).first()
    total = float((first.words or 0) if budget is None else budget)
    rest, open_ = total, first.open or 0.0
    while open_:
        full = cap * open_ < weight * rest
        now = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(weight)).alias("open")
        ).first()
        if (total - now.used, now.open) == (rest, open_):
            break
        rest, open_ = total - now.used, now.open
    share = weight * F.lit(rest) / F.lit(open_) if open_ else cap
    target = F.when(weight == 0, 0.0).otherwise(F.least(cap, share))
    return sources.select("source", "source_size", target.alias("target"))


def _cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut): the first (key, doc_id) of each source that its fractional epoch leaves out; no row if it leaves none."""
    units = rows.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("size"))
    ranged = settle(
        units.repartitionByRange(F.col("source"), F.col("key"), F.col("doc_id")).withColumn("part", F.spark_partition_id()),
        "mixing-ranges",
    )
    at = F.struct("key", "doc_id")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and range it lies in.
    sums = (
        ranged.groupBy("source", "part")
        .agg(F.sum("size").alias("words"), F.min(at).alias("lowest"))
        .withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    )
    rest = wanted.select(F.col("source").alias("_source"), "rest")
    parts = settle(sums.join(rest, _same(F.col("source"), F.col("_source"))).drop("_source"), "mixing-parts")
    left_out = F.col("before") >= F.col("rest")
    ends = parts.filter(~left_out & (F.col("before") + F.col("words") >= F.col("rest"))).select(
        F.col("source").alias("_source"), F.col("part").alias("_part"), "before", "rest"
    )
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        ranged.join(ends, _same(F.col("source"), F.col("_source")) & (F.col("part") == F.col("_part")))
        .withColumn("upto", F.col("before") + F.sum("size").over(inside))
        .filter(2 * F.col("upto") - F.col("size") >= 2 * F.col("rest"))
    )
    both = summed.select("source", at.alias("cut")).unionByName(
        parts.filter(left_out).select("source", F.col("lowest").alias("cut"))
    )
    return both.groupBy("source").agg(F.min("cut").alias("cut"))


def mixing_plan(rows: DataFrame, weights: DataFrame, budget: int | None = None, most: int = MOST) -> DataFrame:
    """One row per source: (source, source_size, target, epochs, cut), from rows of `sized`.

    A document is taken `epochs` times, and once more if its (key, doc_id) lies before `cut` or `cut` is NULL.
    """
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    wanted = settle(
        targets(rows, weights, budget, most)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * size),
        "mixing-targets",
    )
    cuts = _cuts(rows, wanted).withColumnRenamed("source", "_source")
    plan = wanted.join(cuts, _same(F.col("source"), F.col("_source")), "left").drop("_source", "rest")
    return settle(plan, "mixing-plan")


def mix(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of `sized`."""
    known = plan.withColumnRenamed("source", "_source")
    more = F.col("cut").isNull() | (F.struct("key", "doc_id") < F.col("cut"))
    return (
        rows.join(known, _same(F.col("source"), F.col("_source")))
        .withColumn("copies", F.col("epochs") + more.cast("long"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
        )
    )


def mixed_documents(
    docs: DataFrame, weights: DataFrame | None = None, quality: DataFrame | None = None, budget: int | None = None,
    most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """The rows and columns of docs, each as often as the mix takes it; `epoch`, from 1, numbers the times.

    Complete epochs come first: every document of a source has epoch 1 before any has epoch 2.
    """
    rows = sized(docs, quality, seed)
    plan = mixing_plan(rows, cyclic_weights(rows) if weights is None else weights, budget, most)
    # Rows of one doc_id and source have one key and one decision.
    taken = mix(rows, plan).filter("copies > 0").groupBy("doc_id", "source").agg(F.max("copies").alias("_copies"))
    taken = taken.withColumnsRenamed({"doc_id": "_doc_id", "source": "_source"})
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_doc_id")) & docs["source"].cast("string").eqNullSafe(F.col("_source"))
    kept = [docs[c] for c in docs.columns if c != "epoch"]
    return docs.join(taken, same).select(*kept, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("epoch"))


def mixing_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with the words the mix takes of it; cyclic weights, all words as budget."""
    rows = sized(docs, label_weights(labels))
    return mix(rows, mixing_plan(rows, cyclic_weights(rows))).drop("copies", "source")
