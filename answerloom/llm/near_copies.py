"""MinHash near-duplicate removal with b-bit signatures.

Words are runs outside `[\\x20\\x09-\\x0D]`, A-Z lower-cased; a document's set
holds its distinct five-word shingles, or the whole sequence if it has fewer
words. Documents that share `percent` percent of the union of their sets are
linked, and components of links are groups of near copies.

Minima under 168 hash functions are cut into 42 bands of 4: two documents
of similarity 0.75 share no band once in 8 million times. Of 128 minima the two low
bits are kept and packed; bit counts give a similarity corrected for chance
agreement, which drops candidates five deviations below the threshold. What
is left is confirmed on the full sets.

NULL and blank texts have an empty set and link with nothing. Rows without
doc_id get no component and are kept. Rows that repeat a doc_id are one
document, linked by any of its texts. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm import linking, wordhash
from answerloom.session import settle

SHINGLE_WORDS = 5
PERCENT = 75
BANDS, BAND_ROWS = 42, 4
SIGNATURE = 128
# Five deviations of the estimate below 0.75.
LEAST_ESTIMATE = 0.52


def text_items(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    hashes, _, _ = wordhash.words((text or "").encode())
    return np.unique(wordhash.shingles(hashes, SHINGLE_WORDS).view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    functions = wordhash.Minima(BANDS * BAND_ROWS)
    for batch in batches:
        sizes, heads, tails, bands, sigs = [], [], [], [], []
        for text in batch.column("text"):
            items = text_items(text.as_py())
            sizes.append(len(items))
            if not len(items):
                for column in (heads, tails, bands, sigs):
                    column.append(None)
                continue
            head, tail = wordhash.digest(items)
            minima = functions.of(items.view(np.uint64))
            heads.append(head)
            tails.append(tail)
            bands.append(wordhash.band_keys(minima, BANDS, BAND_ROWS))
            sigs.append(wordhash.low_bits(minima[:SIGNATURE]))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(heads, pa.int64()),
                pa.array(tails, pa.int64()), pa.array(bands, longs), pa.array(sigs, longs),
            ],
            ["doc_id", "n_shingles", "head", "tail", "bands", "sig"],
        )


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [text_items(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(items, pa.list_(pa.int64()))], ["node", "items"]
        )


def near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    component_id is the smallest doc_id reachable by links, kept tells whether
    it is the row's own. Equal sets are one node of the search, so copies
    are never paired with each other.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = settle(
        whole.mapInArrow(
            _sketch,
            "doc_id long, n_shingles long, head long, tail long, bands array<long>, sig array<long>",
        ),
        "sketches",
    )
    some = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = settle(some.groupBy("head", "tail").agg(F.min("doc_id").alias("node")), "classes")
    first = classes.select(F.col("node").alias("doc_id"), "head", "tail")
    nodes = settle(
        some.join(first, ["doc_id", "head", "tail"], "left_semi")
        .select(F.col("doc_id").alias("node"), "bands", "sig"),
        "nodes",
    )
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")

    def sets_of(needed):
        # The smallest copy alone: a class's other texts have the same set.
        mine = whole.select(F.col("doc_id").alias("node"), "text").join(needed, "node", "left_semi")
        return mine.mapInArrow(_items, "node long, items array<long>")

    found = settle(
        linking.links(buckets, sets_of, percent, nodes.select("node", "sig"), LEAST_ESTIMATE), "all-links"
    )
    groups = linking.components(found)
    labels = classes.join(groups, "node", "left").select(
        "head", "tail", F.coalesce("component", "node").alias("component")
    )
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return sketched.select("doc_id", "n_shingles", "head", "tail").join(labels, ["head", "tail"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of docs with one document of each group of near copies.

    The one with the smallest doc_id stays, all its rows included.
    """
    dropped = settle(near_copies(docs, percent).filter("not kept").select("doc_id").distinct(), "copies")
    return docs.join(linking.small_side(dropped, 8), docs["doc_id"].cast("long") == dropped["doc_id"], "left_anti")
