"""Links between nearly equal sets, and the components they form.

Everything here works on tables: nodes, their sets of 64-bit hashes, and the
buckets in which nodes meet. No step emits all pairs of a bucket: nodes are
first compared with their bucket's smallest node, then only pairs of different
components whose sizes and private elements still allow the threshold.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from answerloom.session import settle

#: Tables up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20

#: Elements that fewer nodes hold are looked up one by one; buckets up to that size take any pivot.
RARE = 8

#: Sets that share a prefix element meet by it alone up to this number, and by two elements beyond.
CROWD = 32


def small_side(table: DataFrame, row_bytes: int = 16) -> DataFrame:
    """A settled table with rows of a fixed size, marked for broadcast if its counted size allows."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all ends of links (a, b); the component is its smallest node.

    Large-star and small-star steps in turn: each node's neighbours are tied
    to the smallest node known to them, until nothing changes. Minima are
    aggregated before the shuffle, so a node with very many neighbours costs
    its partitions no more than others. Every round is written to the shared
    folder. Rows with a NULL end and links of a node with itself are left out.
    """
    def stars(edges):
        """Larger neighbours of each node to the smallest of its neighbourhood."""
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        return (
            both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .filter("a <> b").distinct()
        )

    def trees(edges):
        """Smaller neighbours of each node, and itself, to the smallest of them."""
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = low.select("a", F.col("low").alias("b"))
        return moved.unionByName(own).filter("a <> b").distinct()

    edges = settle(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    state = None
    while True:
        edges = settle(trees(stars(edges)), "components")
        now = tuple(
            edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, common, union) of each pair of sorted sets without repeats."""
    for batch in batches:
        sides = []
        for name in ("set_a", "set_b"):
            column = batch.column(name)
            values = column.values.to_numpy(zero_copy_only=False)
            sides.append((values, column.offsets.to_numpy()))
        (left, at), (right, to) = sides
        common = np.zeros(batch.num_rows, dtype=np.int64)
        whole = np.zeros(batch.num_rows, dtype=np.int64)
        for row in range(batch.num_rows):
            x, y = left[at[row] : at[row + 1]], right[to[row] : to[row + 1]]
            if len(x) and len(y):
                spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common[row] = np.count_nonzero(y[spot] == x)
            whole[row] = len(x) + len(y) - common[row]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(common), pa.array(whole)],
            ["a", "b", "common", "whole"],
        )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share at least `percent` percent of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("set_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    counted = both.mapInArrow(_overlaps, "a long, b long, common long, whole long")
    return counted.filter(F.col("common") * 100 >= F.col("whole") * percent).select("a", "b").distinct()


def agreement(left: list[Column], right: list[Column]) -> Column:
    """Estimated similarity from two-bit minima, corrected for chance collisions.

    The lists hold k/64 longs of first bits, then as many of second bits. Two
    minima that differ agree in both bits once in four times.
    """
    half = len(left) // 2
    differ = F.lit(0)
    for k in range(half):
        planes = left[k].bitwiseXOR(right[k]).bitwiseOR(left[half + k].bitwiseXOR(right[half + k]))
        differ = differ + F.bit_count(planes)
    share = 1 - differ / F.lit(float(64 * half))
    return (share - 0.25) / 0.75


def prefix_pairs(known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may share `percent` percent of the union of their sets.

    `known` is (node, component, n, items). Elements are put into one order, rarest first. Of n elements a set may lack
    n - ceil(percent n), so two sets that reach the threshold have one of their first n - ceil(percent n) + 1 elements in
    common (prefix filtering). Sizes, and the elements left behind a common one, must allow the threshold as well.
    An element that is in the prefix of more than CROWD sets is not enough: if it is the first one a pair shares,
    the pair must share a second one before the end of both prefixes and one place more, so such sets meet by two elements. No
    pair that reaches the threshold is lost.
    """
    share = percent / 100
    held = known.select("node", F.explode("items").alias("item"))
    owners = held.groupBy("item").agg(F.count("*").alias("owners")).filter("owners > 1")
    placed = F.struct(F.coalesce("owners", F.lit(1)).alias("owners"), "item")
    lists = held.join(owners, "item", "left").groupBy("node").agg(F.sort_array(F.collect_list(placed)).alias("placed"))
    reach = (F.col("n") - F.ceil(F.col("n") * share - 1e-6) + 1).cast("int")
    ordered = settle(
        lists.join(known.select("node", "component", "n"), "node").select(
            "node", "component", "n", F.slice(F.transform("placed", lambda x: x["item"]), F.lit(1), reach + 1).alias("first")
        ), "ordered-sets",
    )
    index = settle(
        ordered.select("node", "component", "n", F.posexplode(F.slice("first", F.lit(1), reach)).alias("at", "item")), "prefixes"
    )
    crowds = settle(index.groupBy("item").agg(F.count("*").alias("crowd")).filter("crowd > 1"), "crowds")
    met = index.join(crowds, "item")
    few = met.filter(F.col("crowd") <= CROWD).drop("crowd").withColumn("second", F.lit(0).cast("long"))
    many = (
        met.filter(F.col("crowd") > CROWD).drop("crowd").join(ordered.select("node", "first"), "node")
        .select("node", "component", "n", "at", "item", F.explode(F.slice("first", F.col("at") + 2, F.size("first"))).alias("second"))
    )

    def pairs(rows):
        a, b = (rows.select(*[F.col(c).alias(f"{c}_{side}" if c not in ("item", "second") else c) for c in rows.columns]) for side in "ab")
        need = (F.col("n_a") + F.col("n_b")) * (share / (1 + share)) - 1e-6
        left = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
        return a.join(b, ["item", "second"]).filter(
            (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & (left >= need)
            & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * share - 1e-6)
        ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    return pairs(few).unionByName(pairs(many)).distinct()


def _pivots(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, pivot) of buckets of more than RARE nodes: the node whose elements most nodes hold, on average of logarithms.

    Among copies of one text, each changed in places of its own, that is the text they come from, or a copy close to it.
    """
    crowded = met.filter(F.col("size") > RARE).select("bucket", "node")
    among = small_side(settle(crowded.select("node").distinct(), "crowded"), 8)
    held = sets.join(among, "node", "left_semi").select("node", F.explode("items").alias("item"))
    owners = held.groupBy("item").agg(F.count("*").alias("owners"))
    score = held.join(owners, "item").groupBy("node").agg(F.avg(F.log("owners")).alias("score"))
    return crowded.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("pivot"))


def _pivot_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all nodes of nearly equal sets which share a bucket, from (bucket, node, center, size).

    Sets of s elements together may differ in s * (100 - percent) / (100 + percent) of them. Each node is compared with its
    bucket's pivot, and what it differs in is kept. Two nodes differ in just those elements that one of them, but not the other,
    differs in from the pivot. So if they reach the threshold without a common difference, the differences of each are
    few enough that both are linked with the pivot. All others meet by a common difference within the bucket, however
    many elements a crowd of changed copies has in common.

    Differences are put into one order by bucket, rarest first. Those that stand before the first common one are not
    shared, nor is the surplus of what stands behind it on one side; both must be within what the pair may differ in. No pair
    that reaches the threshold is lost.
    """
    met = settle(
        met.join(settle(_pivots(met, sets), "pivots"), "bucket", "left")
        .select("bucket", "node", "size", F.coalesce("pivot", "center").alias("pivot")), "pivoted",
    )
    pairs = met.filter("node <> pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(
        F.max("size").alias("size")
    )
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("set_b"))
    apart = F.concat(F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a"))
    stars = settle(
        pairs.join(left, "a").join(right, "b").withColumn("apart", apart).select(
            "a", "b", F.size("set_a").cast("long").alias("n"),
            (F.size("apart") * (100 + percent) <= (F.size("set_a") + F.size("set_b")) * (100 - percent)).alias("linked"),
            F.when(F.col("size") > 2, F.col("apart")).alias("apart"),
        ), "stars",
    )
    first = stars.filter("linked").select("a", "b")
    groups = components(first)
    placed = met.filter("size > 2").join(groups, "node", "left").select(
        "bucket", "node", "pivot", F.coalesce("component", "node").alias("component")
    )
    open_buckets = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high").select("bucket")
    known = stars.filter("apart is not null").select(F.col("a").alias("node"), F.col("b").alias("pivot"), "n", "apart")
    held = settle(
        placed.join(open_buckets, "bucket").join(known, ["node", "pivot"]).select(
            "bucket", "node", "component", "n", F.size("apart").cast("long").alias("d"), F.explode("apart").alias("item")
        ), "differences",
    )
    owners = held.groupBy("bucket", "item").agg(F.count("*").alias("owners")).filter("owners > 1")
    lists = held.join(owners, ["bucket", "item"]).groupBy("bucket", "node", "component", "n", "d").agg(
        F.sort_array(F.collect_list(F.struct("owners", "item"))).alias("common")
    )
    # Differences that no other node of the bucket has come before these.
    index = settle(
        lists.select("bucket", "node", "component", "n", "d", F.size("common").alias("kept"), F.posexplode("common").alias("k", "one"))
        .withColumn("at", F.col("d") - F.col("kept") + F.col("k")).filter(F.col("at") * percent <= F.col("n") * (100 - percent))
        .select("bucket", "node", "component", "n", "d", "at", F.col("one.item").alias("item")), "common-differences",
    )
    a, b = (
        index.select("bucket", "item", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "n", "d", "at")])
        for side in "ab"
    )
    differ = F.col("at_a") + F.col("at_b") + F.abs((F.col("d_a") - F.col("at_a")) - (F.col("d_b") - F.col("at_b")))
    near = a.join(b, ["bucket", "item"]).filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
        & (differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    ).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return first.unionByName(verified(near, sets, percent))


def links(
    buckets: DataFrame, sets_of, percent: int, sketches: DataFrame | None = None,
    least_estimate: float = 0.0, by_prefix: bool = False,
) -> DataFrame:
    """Links (a, b) that join all nodes of nearly equal sets, from buckets (bucket, node).

    Any two nodes that share a bucket and `percent` percent of their union end
    up in one component. `sets_of(nodes)` returns (node, items), items sorted and
    without repeats. `sketches` (node, sig) drops pairs whose estimate is below
    `least_estimate`.

    First round: each node against its bucket's smallest node. Second round: only buckets of
    three nodes or more that still hold several components. Their nodes' elements are
    rare, held by fewer than RARE of these nodes, or common. Pairs that share a rare
    element are found by it, at most RARE / 2 for each time one is held. Pairs that share
    none have no more in common than either's common elements: with x of size n and s of
    those, a partner must have between percent * n and (1 + 1/percent) * s - n
    elements. That rules out copies that were changed too much, however many there are. The
    pairs left over are met in the first bucket they share. With `by_prefix` both rounds are those of `_pivot_links`, without
    sketches; that suits small sets with few elements of their own, such as lines.
    """
    share = percent / 100
    ends = buckets.groupBy("bucket").agg(
        F.min("node").alias("center"), F.max("node").alias("last"), F.count("*").alias("size")
    ).filter("center < last")
    met = settle(buckets.join(ends.select("bucket", "center", "size"), "bucket"), "met")
    needed = settle(met.select("node").distinct(), "needed")
    sets = settle(sets_of(small_side(needed)), "sets")
    if by_prefix:
        return _pivot_links(met, sets, percent)

    def likely(pairs):
        if sketches is None:
            return pairs
        sig_a = sketches.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
        sig_b = sketches.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        width = len(sketches.select("sig").first().sig) if not sketches.isEmpty() else 2
        value = agreement(
            [F.col("sig_a")[k] for k in range(width)], [F.col("sig_b")[k] for k in range(width)]
        )
        return pairs.join(sig_a, "a").join(sig_b, "b").filter(value >= least_estimate).select("a", "b")

    stars = met.filter("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    first = settle(verified(likely(stars), sets, percent), "first-links")

    groups = components(first)
    placed = settle(
        met.filter("size > 2").join(groups, "node", "left").select(
            "bucket", "node", F.coalesce("component", "node").alias("component")
        ),
        "placed",
    )
    open_buckets = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high").select("bucket")
    open_rows = settle(placed.join(open_buckets, "bucket").distinct(), "open")
    open_nodes = open_rows.groupBy("node").agg(
        F.min("component").alias("component"), F.sort_array(F.collect_set("bucket")).alias("buckets")
    )
    known = settle(
        sets.dropDuplicates(["node"]).join(open_nodes, "node").withColumn("n", F.size("items").cast("long")), "open-nodes"
    )
    held = known.select("node", F.explode("items").alias("item"))
    owners = held.groupBy("item").agg(F.count("*").alias("owners")).filter(F.col("owners") < RARE)
    rare = settle(held.join(owners, "item"), "rare-elements")
    size = F.col("n")
    nodes = settle(
        known.select("node", "component", "n", "buckets")
        .join(rare.groupBy("node").agg(F.count("*").alias("rare")), "node", "left")
        .withColumn("s", size - F.coalesce("rare", F.lit(0)))
        .withColumn("least", F.ceil(size * share - 1e-6))
        .withColumn("widest", F.floor(size / share + 1e-6))
        .withColumn("most", F.floor(F.least(size / share, F.col("s") * (1 + 1 / share) - size) + 1e-6)),
        "reach",
    )

    def end(table, side):
        return table.select(
            *[F.col(c).alias(side if c == "node" else f"{c}_{side}" if c in ("component", "n", "least", "most", "widest", "buckets") else c)
              for c in table.columns]
        )

    apart = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))

    def fits(bound):
        return F.col("n_b").between(F.col("least_a"), F.col(f"{bound}_a")) & F.col("n_a").between(
            F.col("least_b"), F.col(f"{bound}_b")
        )

    index = rare.filter("owners > 1").join(nodes.drop("s", "rare", "buckets", "most"), "node").drop("owners")
    by_rare = end(index, "a").join(end(index, "b"), "item").filter(apart & fits("widest")).select("a", "b")

    # Sizes in classes a twentieth of a factor wide, so that only partners of
    # fitting size meet.
    def level(x):
        return F.floor(F.log(F.greatest(x, F.lit(1))) * 20)

    able = open_rows.select("bucket", "node").join(nodes.filter("least <= most").drop("s", "rare", "widest"), "node")
    seeking = end(able, "a").withColumn("level", F.explode(F.sequence(level(F.col("least_a")), level(F.col("most_a")))))
    offered = end(able, "b").withColumn("level", level(F.col("n_b")))
    first_met = F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket")
    by_bucket = seeking.join(offered, ["bucket", "level"]).filter(apart & fits("most") & first_met).select("a", "b")
    pairs = by_rare.unionByName(by_bucket).distinct()
    second = verified(likely(pairs), sets, percent)
    return first.unionByName(second)
