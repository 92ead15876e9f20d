"""Passages that repeat across documents, wherever they stand in the text.

The texts' own paragraphs, their lines of five words or more, are compared whole. Paragraphs of equal words are one
node. Of each node's five-word shingles BANDS * BAND_ROWS minima are taken and cut into bands; nodes that collide
in a band are candidates. Two paragraphs that share 75 % of the union of their shingles share no band once in 140 times
(0.578 ** 9). Candidates are confirmed by exact Jaccard similarity, and components of links are one passage. Minima are made once per node and task, however many documents hold the line. A changed copy goes whole, save for
ends of more than four words whose shingles no other paragraph of its passage has: those are text of its own beside a
pasted passage.

Passages are pasted into the middle of lines as often as between them, so besides paragraphs windows of WORDS words are
found by content: of each SPREAD consecutive places of a text the one with the smallest five-word hash starts a window. Any
passage of WORDS + SPREAD - 1 words (50) or more that two documents share thereby gives both the same window at least
once. Shared windows that touch make a chain, and only beyond the ends of chains runs of WORDS words are looked up one
by one, in every document that holds the end's window; so a passage is known from its first to its last word, and its inside costs no more than its windows.

Texts are hashed in one pass, which writes lines, bands and windows; later passes read only the texts that hold
something repeated.

What stands in the smallest doc_id stays, all other occurrences are removals; those next to or over each other are
one span.

Words are runs outside `[\\x20\\x09-\\x0D]`, A-Z lower-cased. Lines end at `\\n`. Texts without a line of five words and
without WORDS words have no paragraphs; what repeats within one document only is no repeat. Rows
without doc_id are left alone. Rows that repeat a doc_id are one document. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from answerloom.llm import linking, wordhash
from answerloom.llm.rows import keyed_texts, same_row, text_key
from answerloom.session import settle

WORDS, SPREAD = 25, 26
BANDS, BAND_ROWS = 9, 3
SHINGLE_WORDS = 5
PERCENT = 75

SHINGLES = WORDS - SHINGLE_WORDS + 1
# Bounds of a task's memory: shingles taken through all hash functions at once, lines remembered, characters of texts
# hashed in one step.
BLOCK_SHINGLES, MOST_SEEN, GROUP_BYTES = 1 << 16, 1 << 20, 1 << 19


def starts(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes of the places where windows start; `shingles` has those of each text's places, `counts` their numbers by text."""
    ends, taken = np.cumsum(counts), np.zeros(len(shingles), bool)
    if len(shingles) >= SPREAD:
        # A place is taken if it holds the minimum of some run of SPREAD places of its text around it.
        least = _over_runs(shingles, np.minimum)
        least[np.repeat(ends, counts)[: len(least)] < np.arange(len(least)) + SPREAD] = 0
        edge = np.zeros(SPREAD - 1, least.dtype)
        taken = _over_runs(np.concatenate((edge, least, edge)), np.maximum) == shingles
    # Of texts with fewer places than that, the first that holds their minimum.
    short = (counts > 0) & (counts <= SPREAD)
    if short.any():
        sizes = counts[short]
        at = np.flatnonzero(np.repeat(short, counts))
        least = np.minimum.reduceat(shingles[at], np.cumsum(sizes) - sizes)
        equal = np.flatnonzero(shingles[at] == np.repeat(least, sizes))
        _, first = np.unique(np.repeat(np.arange(len(sizes)), sizes)[equal], return_index=True)
        taken[at] = False
        taken[at[equal[first]]] = True
    return np.flatnonzero(taken)


def _over_runs(values: np.ndarray, choose) -> np.ndarray:
    """Minimum or maximum of each run of SPREAD values, in steps that double the run."""
    width = 1
    while 2 * width <= SPREAD:
        values = choose(values[:-width], values[width:])
        width *= 2
    return choose(values[: len(values) - (SPREAD - width)], values[SPREAD - width :]) if width < SPREAD else values


def _runs(hashes: np.ndarray) -> np.ndarray:
    """One number per run of WORDS words, the same for the same words."""
    if len(hashes) < WORDS:
        return np.empty(0, np.int64)
    return wordhash.shingles(hashes, WORDS).view(np.int64)


def _runs_at(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`_runs` of the given places only."""
    total = np.full(len(at), WORDS, np.uint64)
    for k, factor in enumerate(wordhash.seeds(WORDS, 13)):
        total += hashes[at + k] * factor
    return wordhash.mix(total).view(np.int64)


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of runs of texts of GROUP_BYTES or one text, so that many short texts are one step."""
    group, n_bytes, first = [], 0, 0
    for k, text in enumerate(texts):
        text = text.as_py()
        if group and n_bytes + len(text) > GROUP_BYTES:
            yield first, group
            group, n_bytes, first = [], 0, k
        group.append(text)
        n_bytes += len(text)
    if group:
        yield first, group


def _places(batch: pa.RecordBatch, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(doc_id, mark, start, node) from the starts and nodes of each row."""
    take = pa.array(np.repeat(np.arange(len(found)), [len(at) for at, _ in found]).astype(np.int64))
    columns = [np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(take), batch.column("mark").take(take), *[pa.array(x, pa.int64()) for x in columns]],
        ["doc_id", "mark", "start", "node"],
    )


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of WORDS words that start less than SPREAD words before or after windows, as each of `ends` asks."""
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch, found = whole.slice(k, 1000), []
            for text, ends in zip(batch.column("text"), batch.column("ends")):
                runs, ends = _runs(wordhash.words(text.as_py().encode())[0]), ends.values
                at = ends.field("start").to_numpy()
                before, after = (ends.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("before", "after"))
                edges = np.zeros(len(runs) + 1, np.int64)
                np.add.at(edges, np.maximum(at[before] - SPREAD + 1, 0), 1)
                np.add.at(edges, at[before], -1)
                np.add.at(edges, np.minimum(at[after] + 1, len(runs)), 1)
                np.add.at(edges, np.minimum(at[after] + SPREAD, len(runs)), -1)
                near = np.flatnonzero(np.cumsum(edges[:-1]))
                found.append((near, runs[near]))
            yield _places(batch, found)


PLACES = "doc_id long, mark long, start long, node long"


class Lines:
    """The lines of some texts that have a shingle: texts, first words in them, lengths, nodes, and their shingles in text order."""

    def __init__(self, texts: list[str]):
        parts = [text.encode() for text in texts]
        # No text has a line that goes on in the next one.
        raw = b"\n".join(parts)
        hashes, begin, _ = wordhash.words(raw)
        self.words = hashes
        lengths = np.array([len(x) + 1 for x in parts], np.int64)
        self.first_word = np.searchsorted(begin, np.cumsum(lengths) - lengths)
        self.counts = np.diff(self.first_word, append=len(hashes))
        breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        line = np.searchsorted(breaks, begin)
        first = np.flatnonzero(np.diff(line, prepend=-1))
        sizes = np.diff(first, append=len(line))
        able = sizes >= SHINGLE_WORDS
        self.text = np.searchsorted(self.first_word, first[able], side="right") - 1
        self.start, self.n_words = first[able] - self.first_word[self.text], sizes[able]
        self.node = np.empty(0, np.int64)
        self.shingles, self.owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        # Those that run into the next line or text are left out below.
        self.whole = wordhash.shingles(hashes, SHINGLE_WORDS)
        if not len(self.start):
            return
        place = np.arange(len(hashes)) - np.repeat(first, sizes)
        sums = np.add.reduceat(hashes * wordhash._powers(int(sizes.max()))[place], first)
        self.node = wordhash.mix(sums + sizes.astype(np.uint64))[able].view(np.int64)
        # Shingles that start at the last words of a line would run into the next.
        number = np.cumsum(able) - 1
        inside = np.repeat(able, sizes) & (place <= np.repeat(sizes, sizes) - SHINGLE_WORDS)
        at = np.flatnonzero(inside)
        self.shingles = self.whole[at]
        self.owner = np.repeat(number, sizes)[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, first words and runs of the windows found by content."""
        counts = np.maximum(self.counts - WORDS + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
        at = start + self.first_word[text]
        taken = starts(self.whole[at], counts)
        return text[taken], start[taken], _runs_at(self.words, at[taken])

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles by line, sorted as unsigned numbers, and the number of each line's."""
        order = np.lexsort((self.shingles, self.owner))
        values, owner = self.shingles[order], self.owner[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        return values[new], np.bincount(owner[new], minlength=len(self.start))

    def bands(self, functions: wordhash.Minima, chosen: np.ndarray) -> np.ndarray:
        """Band keys of the chosen lines, one row per line."""
        sizes = np.bincount(self.owner, minlength=len(self.start))
        ends = np.cumsum(sizes)
        minima, total, k = np.empty((len(chosen), BANDS * BAND_ROWS), np.uint32), np.cumsum(sizes[chosen]), 0
        while k < len(chosen):
            # Lines in one go, as many as fit into a block; a longer line goes by itself, in pieces.
            before = total[k] - sizes[chosen[k]]
            last = max(k + 1, int(np.searchsorted(total, before + BLOCK_SHINGLES, side="right")))
            some = chosen[k:last]
            if len(some) == 1:
                minima[k] = functions.of(self.shingles[ends[some[0]] - sizes[some[0]] : ends[some[0]]])
            else:
                first = total[k:last] - sizes[some] - before
                at = np.arange(total[last - 1] - before) + np.repeat(ends[some] - sizes[some] - first, sizes[some])
                narrow = (self.shingles[at] >> np.uint64(32)).astype(np.uint32)
                for j, (factor, offset) in enumerate(zip(functions.factors, functions.offsets)):
                    minima[k:last, j] = np.minimum.reduceat(narrow * factor + offset, first)
            k = last
        table = minima.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
        sums = (table * wordhash.seeds(BAND_ROWS, 19)).sum(axis=2, dtype=np.uint64)
        return wordhash.mix(sums + wordhash.seeds(BANDS, 20)).view(np.int64)


SCANNED = "doc_id long, mark long, start long, n_words long, node long, line boolean, bands array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's windows found by content and its lines; bands with a line's first occurrence in the task alone."""
    functions, seen = wordhash.Minima(BANDS * BAND_ROWS), set()
    for batch in batches:
        for number, texts in _groups(batch.column("text")):
            lines = Lines(texts)
            text, start, run = lines.windows()
            fresh = np.zeros(len(lines.node), bool)
            for i, node in enumerate(lines.node.tolist()):
                if node not in seen:
                    fresh[i] = True
                    seen.add(node)
            bands = lines.bands(functions, np.flatnonzero(fresh)).reshape(-1)
            if len(seen) > MOST_SEEN:
                seen.clear()
            take = pa.array(np.concatenate((text, lines.text)) + number)
            ends = np.cumsum(np.concatenate((np.zeros(len(text) + 1, np.int64), fresh * BANDS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take), batch.column("mark").take(take),
                    pa.array(np.concatenate((start, lines.start)), pa.int64()),
                    pa.array(np.concatenate((np.full(len(text), WORDS), lines.n_words)), pa.int64()),
                    pa.array(np.concatenate((run, lines.node)), pa.int64()),
                    pa.array(np.arange(len(take)) >= len(text)), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands)),
                ],
                ["doc_id", "mark", "start", "n_words", "node", "line", "bands"],
            )


def _line_items(ordered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, items) of the lines that are asked for: shingles in text order, or sorted sets."""
        for batch in batches:
            nodes, items = [], []
            for number, texts in _groups(batch.column("text")):
                lines = Lines(texts)
                ends = np.cumsum(np.bincount(lines.owner, minlength=len(lines.node)))
                wanted = batch.column("wanted").slice(number, len(texts)).flatten().to_numpy()
                distinct, first = np.unique(lines.node, return_index=True)
                for k in first[np.isin(distinct, wanted)]:
                    row = lines.shingles[ends[k - 1] if k else 0 : ends[k]].view(np.int64)
                    nodes.append(int(lines.node[k]))
                    items.append(row if ordered else np.unique(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["node", "items"]
            )
    return run


def _several(found: DataFrame, key: str) -> DataFrame:
    """(key, first_doc) of the keys that stand in two documents or more."""
    return found.groupBy(key).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).filter(
        "first_doc < last"
    ).drop("last")


def _of_rows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts joined with `wanted` (doc_id, mark, ...), settled; other texts are left out before any shuffle if they can be."""
    rows = linking.small_side(wanted.select("doc_id", "mark"))
    return texts.join(rows, ["doc_id", "mark"], "left_semi").join(wanted, ["doc_id", "mark"])


def repeated_runs(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, mark, start, n_words, passage): windows that two documents share, and what repeats beyond their chains' ends."""
    shared = settle(_several(windows, "node").select("node"), "shared-windows")
    hits = settle(
        windows.select("doc_id", "mark", "start", "node").join(linking.small_side(shared, 8), "node").distinct(), "window-hits"
    )
    order = Window.partitionBy("doc_id", "mark").orderBy("start")
    apart = lambda gap: F.coalesce(gap > WORDS, F.lit(True))
    ends = settle(
        hits.select(
            "node", apart(F.col("start") - F.lag("start").over(order)).alias("before"),
            apart(F.lead("start").over(order) - F.col("start")).alias("after"),
        ).groupBy("node").agg(F.bool_or("before").alias("before"), F.bool_or("after").alias("after")).filter("before or after"),
        "chain-ends",
    )
    asked = settle(
        hits.join(linking.small_side(ends), "node").groupBy("doc_id", "mark").agg(
            F.collect_list(F.struct("start", "before", "after")).alias("ends")
        ), "asked-ends",
    )
    beyond = _of_rows(texts, asked).select("doc_id", "mark", "text", "ends").mapInArrow(_beyond, PLACES)
    both = hits.select("doc_id", "mark", "start", "node").unionByName(beyond)
    return both.select("doc_id", "mark", "start", F.lit(WORDS).cast("long").alias("n_words"), F.col("node").alias("passage"))


def repeated_lines(texts: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(doc_id, mark, start, n_words, passage): lines that stand or have a near copy elsewhere, one passage per component."""
    banded = lines.filter(F.size("bands") > 0).select(F.explode("bands").alias("bucket"), "node")
    shared = settle(
        banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket"),
        "shared-bands",
    )
    buckets = settle(banded.join(linking.small_side(shared, 8), "bucket").distinct(), "line-bands")

    def items_of(needed, ordered=False):
        one = lines.join(needed, "node").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("row"))
        asked = settle(
            one.groupBy(F.col("row.doc_id").alias("doc_id"), F.col("row.mark").alias("mark")).agg(
                F.collect_list("node").alias("wanted")
            ), "wanted-lines",
        )
        known = _of_rows(texts, asked).select("text", "wanted")
        return known.mapInArrow(_line_items(ordered), "node long, items array<long>").dropDuplicates(["node"])

    groups = settle(
        linking.components(settle(linking.links(buckets, items_of, percent, by_prefix=True), "line-links")), "line-groups"
    )

    # Where the shingles that a changed copy has in common with its passage begin and end.
    held = settle(
        items_of(linking.small_side(groups.select("node"), 8), True).join(groups, "node")
        .select("component", "node", F.posexplode("items").alias("at", "item")), "line-shingles",
    )
    common = held.groupBy("component", "item").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter(
        "low < high"
    ).select("component", "item")
    reach = settle(
        held.join(common, ["component", "item"]).groupBy("node", "component").agg(
            F.min("at").cast("long").alias("low"), (F.max("at") + SHINGLE_WORDS).cast("long").alias("high")
        ), "line-reach",
    )
    # Lines that stand in two documents as they are go whole.
    equal = settle(_several(lines, "node").select("node", F.lit(True).alias("equal")), "equal-lines")
    known = settle(groups.select("node").unionByName(equal.select("node")).distinct(), "repeated-nodes")
    places = lines.select("doc_id", "mark", "start", "n_words", "node").join(linking.small_side(known, 8), "node").distinct()
    slack, own = SHINGLE_WORDS - 1, F.col("equal").isNull()
    low = F.when(own & (F.col("low") > slack), F.col("low")).otherwise(0)
    high = F.when(own & (F.col("high") < F.col("n_words") - slack), F.col("high")).otherwise(F.col("n_words"))
    return places.join(reach, "node", "left").join(equal, "node", "left").select(
        "doc_id", "mark", (F.col("start") + low).alias("start"), (high - low).alias("n_words"),
        F.coalesce("component", "node").alias("passage"),
    )


def repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, start, n_words, passage, first_doc, removed): what stands in two documents or more."""
    texts = keyed_texts(docs).filter("doc_id is not null")
    scanned = settle(texts.mapInArrow(_scan, SCANNED), "scanned")
    runs = repeated_runs(texts, scanned.filter("not line"))
    placed = settle(runs.unionByName(repeated_lines(texts, scanned.filter("line"), percent)), "placed")
    return placed.join(_several(placed, "passage"), "passage").select(
        "doc_id", "mark", "start", "n_words", "passage", "first_doc", (F.col("doc_id") != F.col("first_doc")).alias("removed")
    )


def passage_spans(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, first_word, n_words, passage, first_doc, removed): `repeats` with spans that touch joined.

    passage and first_doc are the smallest of a span's.
    """
    order = Window.partitionBy("doc_id", "mark", "removed").orderBy("start", "n_words")
    end = F.col("start") + F.col("n_words")
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.coalesce((F.col("start") > reached).cast("long"), F.lit(1))
    numbered = repeats(docs, percent).withColumn("opened", opened).withColumn("span", F.sum("opened").over(order))
    return numbered.groupBy("doc_id", "mark", "removed", "span").agg(
        F.min("start").alias("first_word"), (F.max(end) - F.min("start")).alias("n_words"),
        F.min("passage").alias("passage"), F.min("first_doc").alias("first_doc"),
    ).select("doc_id", "mark", "first_word", "n_words", "passage", "first_doc", "removed")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            raw = text.encode()
            _, begin, end = wordhash.words(raw)
            parts, at = [], 0
            for cut in sorted((c["first_word"], c["n_words"]) for c in cuts):
                parts.append(raw[at : begin[cut[0]]])
                at = int(end[cut[0] + cut[1] - 1])
            out.append((b"".join(parts) + raw[at:]).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(out, pa.string())], ["doc_id", "mark", "rest"]
        )


def without_repeats(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows and columns of docs, texts without the words of removals."""
    cuts = passage_spans(docs, percent).filter("removed").groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("first_word", "n_words")).alias("cuts")
    )
    texts = keyed_texts(docs).dropDuplicates(["doc_id", "mark"])
    changed = settle(
        texts.join(cuts, same_row(texts, cuts)).select(texts["doc_id"], texts["mark"], "text", "cuts")
        .mapInArrow(_cut, "doc_id long, mark long, rest string"), "cut-texts",
    )
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    joined = whole.join(
        changed, (F.col("row.doc_id").cast("long") == changed["doc_id"]) & (text_key(text) == changed["mark"]), "left"
    )
    return joined.select(*[
        (F.coalesce("rest", text) if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns
    ])
