"""Conversation prefix trie: one row per distinct sequence of first turns, by fixed-length block hashing.

Turns are digested once, and only (conversation, turn, digest, code points) move from then on. Each conversation is
streamed in turn order: a running digest names every prefix, and after every BLOCK turns a block leaves, with the
digests before and after it. Conversations are grouped by these block digests, so copies and shared openings become
one block with a count, however many conversations hold it. Turn boundaries are refined only inside blocks where
siblings diverge: a block that is the only one after its prefix is a chain of turns with the same members and stays
one segment; the others are taken apart, and equal turns are merged again.

Totals over subtrees come from pointer doubling over the segments: after round j a segment holds the totals of all
segments less than 2**j below it and points 2**j up, so a trie of depth d takes log2(d) rounds, each a sum by pointer
and a join by unique id. Ids of the conversations that end at a node are ranged and joined into pieces of at most PIECE
ids, then digested in order, so no task or array holds the ids of a node with many.

Digests have 128 bits; two different prefixes are taken for one with a chance of 1e-15 at 1e11 prefixes.

Turns are ordered by `turn`, NULL first, then by digest, so repeated turns have a defined order. NULL role or text reads
as empty. Rows without conv_id belong to no conversation and are left out. A conversation may be as long as it likes:
it is streamed, and only its running digest and one block are held. An empty table gives the root alone.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from answerloom.session import settle

BLOCK = 4
PIECE = 4096
BASE, MOST_SHARED = 100, 6
_ROOT = b""
_NO_IDS = hashlib.sha256(b"").hexdigest()


# Turns


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text; the role's length keeps them apart."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def short_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars): what the trie needs of each turn, without its text."""
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("chars"),
    )


def rebuilt_turns(turns: DataFrame, base: int = BASE, most: int = MOST_SHARED) -> DataFrame:
    """Short turns where conversation c begins with the first h turns of c - c % base, followed by its own after its first h.

    h = crc32(c) % most. `turn` is the place; a conversation left without turns has one row with NULL digest.
    """
    head = F.col("conv_id") - F.col("conv_id") % base
    in_order = Window.partitionBy("head", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = (
        turns.withColumn("head", head).repartition("head").withColumn("place", F.row_number().over(in_order).cast("long"))
    )
    placed = settle(placed.withColumn("shared", F.crc32(F.col("conv_id").cast("string")) % most), "trie-turns")
    own = placed.filter("place > shared").select("conv_id", F.col("place").alias("turn"), "digest", "chars")
    first = placed.filter((F.col("conv_id") == F.col("head")) & (F.col("place") < most)).select("head", "place", "digest", "chars")
    # One row per conversation; a head is shared by `base` conversations at most.
    members = placed.filter("place = 1").select("head", "conv_id", "shared")
    given = members.join(first, "head").filter("place <= shared").select("conv_id", F.col("place").alias("turn"), "digest", "chars")
    nothing = members.select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")
    )
    return own.unionByName(given).unionByName(nothing)


# Blocks


_BLOCKS = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("start", pa.binary()), ("end", pa.binary()),
    ("nodes", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64())), ("last", pa.bool_()),
])
_BLOCKS_DDL = "conv_id long, depth long, start binary, end binary, nodes array<binary>, chars array<long>, last boolean"


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of turns sorted by conversation; a conversation without turns gives one empty block, its last."""
    out, conv, start, at, depth, nodes, chars = [], None, _ROOT, _ROOT, 0, [], []

    def leave(last):
        out.append((conv, depth, start, at, nodes, chars, last))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _BLOCKS)], schema=_BLOCKS)

    for rows in batches:
        for c, digest, n in zip(*(rows.column(name).to_pylist() for name in ("conv_id", "digest", "chars"))):
            if c != conv:
                if conv is not None:
                    leave(True)
                conv, start, at, depth, nodes, chars = c, _ROOT, _ROOT, 0, [], []
            if digest is None:
                continue
            if len(nodes) == BLOCK:
                leave(False)
                start, depth, nodes, chars = at, depth + BLOCK, [], []
            at = hashlib.blake2b(at + digest, digest_size=16).digest()
            nodes.append(at)
            chars.append(n)
        if out:
            yield batch()
            out = []
    if conv is not None:
        leave(True)
        yield batch()


def turn_blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, start, end, nodes, chars, last) per block: depth turns lie before it, nodes are its prefixes' digests.

    Each conversation's last block has `last`.
    """
    by_turn = [F.col("turn").asc_nulls_first(), F.col("digest").asc_nulls_first()]
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", *by_turn)
    return ordered.select("conv_id", "digest", "chars").mapInArrow(_block_rows, _BLOCKS_DDL)


# Segments


def segments(blocks: DataFrame) -> DataFrame:
    """(id, parent, depth, nodes, chars, n_convs, conv_id): the trie below the root in chains of turns with equal members.

    `id` is the digest at a segment's end, `parent` the one before it, `depth` the turns before it.
    """
    distinct = settle(
        blocks.filter(F.size("nodes") > 0).groupBy("start", "end", "depth", "nodes", "chars")
        .agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")),
        "trie-blocks",
    )
    # Blocks alone after their prefix, by their end, which is unique: no join on a prefix that many blocks follow.
    alone = (
        distinct.groupBy("start").agg(F.count("*").alias("n"), F.min("end").alias("end")).filter("n = 1").select("end")
    )
    whole = distinct.join(alone, "end", "left_semi")
    apart = distinct.join(alone, "end", "left_anti")
    chains = whole.select(F.col("end").alias("id"), F.col("start").alias("parent"), "depth", "nodes", "chars", "n_convs", "conv_id")
    places = F.transform(
        F.sequence(F.lit(1), F.size("nodes")),
        lambda i: F.struct(
            F.element_at("nodes", i).alias("id"),
            F.when(i == 1, F.col("start")).otherwise(F.try_element_at(F.col("nodes"), F.nullif(i - 1, F.lit(0)))).alias("parent"),
            (F.col("depth") + i - 1).alias("depth"), F.element_at("chars", i).alias("chars"),
        ),
    )
    turns = (
        apart.select(F.explode(places).alias("t"), "n_convs", "conv_id").select("t.*", "n_convs", "conv_id")
        .groupBy("id", "parent", "depth", "chars").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        .select("id", "parent", "depth", F.array("id").alias("nodes"), F.array("chars").alias("chars"), "n_convs", "conv_id")
    )
    return chains.unionByName(turns)


def subtree_totals(parts: DataFrame) -> DataFrame:
    """(id, n_children, n_leaves, saved) per segment, the latter two over its whole subtree, by pointer doubling."""
    total_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    children = parts.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    now = settle(
        parts.select("id", "parent", ((F.col("n_convs") - 1) * total_chars).alias("saved"))
        .join(children, "id", "left")
        .select(
            "id", F.when(F.length("parent") > 0, F.col("parent")).alias("up"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), "saved",
        ),
        "trie-totals",
    )
    while not now.filter("up IS NOT NULL").isEmpty():
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        # Those at the top stay as they are: they would all be one join key.
        jump = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        top = now.filter("up IS NULL").withColumn("next", F.lit(None).cast("binary"))
        pointed = now.filter("up IS NOT NULL").join(jump, "up").unionByName(top)
        now = settle(
            pointed.join(below, "id", "left").select(
                "id", F.col("next").alias("up"), "n_children",
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            "trie-totals",
        )
    return now.drop("up")


# Digests of ids


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (id, conv_id) joined into texts of at most PIECE ids."""
    node, ids = None, []

    def piece():
        return pa.RecordBatch.from_pydict({
            "id": pa.array([node], pa.binary()), "first": pa.array([ids[0]], pa.int64()),
            "ids": pa.array([",".join(map(str, ids))], pa.string()),
        })

    for rows in batches:
        for n, c in zip(rows.column("id").to_pylist(), rows.column("conv_id").to_pylist()):
            if ids and (n != node or len(ids) == PIECE):
                yield piece()
                ids = []
            node = n
            ids.append(c)
    if ids:
        yield piece()


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per id over its pieces in order, comma-joined; holds one running digest."""
    node, digest = None, None
    for rows in batches:
        done = []
        for n, text in zip(rows.column("id").to_pylist(), rows.column("ids").to_pylist()):
            if digest is not None and n == node:
                digest.update(b",")
            else:
                if digest is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256()
            digest.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["id", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["id", "ends_sha256"])


def ending_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the conversations (id, conv_id) that end at each node, in numeric order."""
    ranged = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "id binary, first long, ids string")
    in_order = pieces.repartition("id").sortWithinPartitions("id", "first")
    return in_order.select("id", "ids").mapInArrow(_joined_digests, "id binary, ends_sha256 string")


# The trie


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of short turns (`short_turns`, `rebuilt_turns`): see the contract of the columns below.

    conv_id (smallest member), depth, parent_conv_id (its parent's conv_id, NULL at the root), n_convs (members),
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, each node's members but one
    times the code points of its last text), ends_sha256 (of the ids of members that end here).
    """
    blocks = settle(turn_blocks(turns), "trie-conversations")
    parts = settle(segments(blocks), "trie-segments")
    totals = subtree_totals(parts)
    ends = settle(ending_digests(blocks.filter("last").select(F.col("end").alias("id"), "conv_id")), "trie-ends")
    above = parts.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    # The parent of a root's child is the root, whose smallest member is the smallest of all.
    first = blocks.agg(F.min("conv_id")).first()[0]
    deeper = parts.filter(F.length("parent") > 0).join(above, "parent")
    highest = parts.filter(F.length("parent") == 0).withColumn("above", F.lit(first).cast("long"))
    known = deeper.unionByName(highest).join(totals, "id").join(ends, "id", "left")
    here = F.sequence(F.lit(1), F.size("nodes"))
    end = F.col("i") == F.size("nodes")
    earlier = F.aggregate(F.slice("chars", F.lit(1), F.col("i") - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    nodes = known.select("*", F.explode(here).alias("i")).select(
        "conv_id", (F.col("depth") + F.col("i")).alias("depth"),
        F.when(F.col("i") == 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * earlier).alias("saved_tokens"),
        F.coalesce(F.when(end, F.col("ends_sha256")), F.lit(_NO_IDS)).alias("ends_sha256"),
    )
    return nodes.unionByName(_root(turns.sparkSession, blocks, parts, totals, ends))


def _root(spark, blocks: DataFrame, parts: DataFrame, totals: DataFrame, ends: DataFrame) -> DataFrame:
    """The textless root, from sums over its children."""
    members = blocks.filter("last").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    below = parts.filter(F.length("parent") == 0).select("id").join(totals, "id")
    sums = below.agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved")).first()
    own = ends.filter(F.length("id") == 0).first()
    row = (
        members.conv_id, 0, None, members.n_convs, sums.n, sums.leaves or 1, sums.saved or 0,
        own.ends_sha256 if own else _NO_IDS,
    )
    return spark.createDataFrame(
        [row], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string",
    )


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt_turns(short_turns(conversations)))
