"""Fill-in-middle transformation: prefix, middle and suffix cut at token bounds, found by chunk summaries.

A text is a row of tokens `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`: words with the space before them, and
what space is left at the end. Two cuts are drawn from a hash of the document's id, so reruns and any partitioning
give the same ones.

Texts are cut into chunks where a rolling hash of the last 16 characters says so (content-defined chunking), so texts
that share passages share chunks, whatever stands before them. A chunk's boundary summary (how many words end inside
it, and whether its last character belongs to a word) is computed once per task and kept under the chunk's content: a
chunk is taken for known only if all its characters are equal. The cache is bounded in bytes, oldest entries go first.
Summaries combine: a word also ends where a chunk that ends in a word meets one that begins with space. Running sums of
the combined counts give the number of tokens and the chunk in which a cut lies; only that chunk is read again.

Texts meet Python in Arrow batches and only cut places come back; output texts are composed beside their rows.
A NULL text is empty; an empty text, or one that holds a marker, stays plain. A NULL doc_id hashes like an empty one.
Repeated rows are transformed alike. Extra columns are not looked at. An empty table gives an empty result.
"""

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE, SPM_RATE = 50, 80
# Chunks hold 512 characters on average, between the bounds.
MASK = 0x1FF
SHORTEST, LONGEST = 64, 4096
CACHE_BYTES = 48_000_000
ENTRY_BYTES = 400

_SPACE = np.zeros(33, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def chunk_ends(codes: np.ndarray) -> list[int]:
    """Ends of content-defined chunks: where a hash of the last 16 characters has its low bits clear.

    A chunk has SHORTEST characters at least, unless the text ends, and LONGEST at most.
    """
    n = len(codes)
    if n <= SHORTEST:
        return [n] if n else []
    # Each character's own hash, then sums over windows of 2, 4, 8 and 16 with a factor per place.
    h = codes * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    step, factor = 1, 31
    while step < 16:
        longer = h.copy()
        longer[step:] += h[:-step] * np.uint32(factor)
        h, step, factor = longer, 2 * step, factor * factor & 0xFFFFFFFF
    h ^= h >> np.uint32(16)
    marks = np.flatnonzero(h & np.uint32(MASK) == 0) + 1
    ends, at = [], 0
    while n - at > SHORTEST:
        k = np.searchsorted(marks, at + SHORTEST)
        end = int(marks[k]) if k < len(marks) else n
        at = min(end, at + LONGEST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


class ChunkCache:
    """Boundary summaries of chunks by their content, bounded in bytes."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.known, self.bytes, self.limit = OrderedDict(), 0, limit
        self.hits = self.misses = 0

    def summary(self, chunk: str) -> tuple[int, bool, bool]:
        """(words that end inside, whether the first and the last character belong to a word)."""
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            self.known.move_to_end(chunk)
            return found
        self.misses += 1
        found = (len(_WORD_END.findall(chunk)), not _is_space(chunk[0]), not _is_space(chunk[-1]))
        self.known[chunk] = found
        self.bytes += 4 * len(chunk) + ENTRY_BYTES
        while self.bytes > self.limit and len(self.known) > 1:
            gone, _ = self.known.popitem(last=False)
            self.bytes -= 4 * len(gone) + ENTRY_BYTES
        return found


def _is_space(character: str) -> bool:
    code = ord(character)
    return code < 33 and bool(_SPACE[code])


class CutTable:
    """A text's tokens, counted from its chunks' summaries; finds the character where the k-th token ends."""

    def __init__(self, text: str, cache: ChunkCache):
        self.text = text
        self.ends = chunk_ends(_codes(text))
        self.starts = [0, *self.ends[:-1]]
        # ended[i]: words that end before chunk i or at its start.
        self.ended, total, open_word = [], 0, False
        for start, end in zip(self.starts, self.ends):
            inside, first, last = cache.summary(text[start:end])
            total += open_word and not first
            self.ended.append(total)
            total += inside
            open_word = last
        self.words = total + open_word
        self.tokens = self.words + bool(text and not open_word)

    def place(self, k: int) -> int:
        """Characters in the first k tokens."""
        if k <= 0:
            return 0
        if k >= self.tokens:
            return len(self.text)
        # The last chunk before whose start fewer than k words have ended holds the k-th end, or ends with it.
        lo, hi = 0, len(self.ended)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.ended[mid] < k else (lo, mid)
        i = lo - 1
        left = k - self.ended[i]
        for found in _WORD_END.finditer(self.text, self.starts[i], self.ends[i]):
            left -= 1
            if not left:
                return found.end()
        return self.ends[i]


def cuts(text: str, first: int, second: int, cache: ChunkCache) -> tuple[int, int, int]:
    """(tokens, end of prefix, end of middle) for two hashes."""
    table = CutTable(text, cache)
    a, b = sorted((first % (table.tokens + 1), second % (table.tokens + 1)))
    return table.tokens, table.place(a), table.place(b)


def _cut_places(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    cache = ChunkCache()
    for texts, first, second in batches:
        rows = [cuts(t, int(a), int(b), cache) for t, a, b in zip(texts, first, second)]
        yield pd.DataFrame(rows, columns=["n", "prefix_end", "middle_end"], dtype="int64")


def _draw(key: Column, group: int) -> Column:
    return F.conv(F.substring(key, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) of every row of docs.

    `rate` percent of the texts are transformed, `spm_rate` percent of those with the suffix first (spm), the others
    with the prefix first (psm). Plain rows have NULL parts and the text as output.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(marker)
    plain = (F.length("text") == 0) | marked | (_draw(F.col("key"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("key"), 3) % 100 < spm_rate, "spm").otherwise("psm")
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"))
    places = F.pandas_udf(_cut_places, "n long, prefix_end long, middle_end long")
    placed = drawn.withColumn("cut", places("text", _draw(F.col("key"), 0), _draw(F.col("key"), 1)))
    transformed = F.col("form") != "plain"

    def part(start, end=None):
        length = F.length("text") if end is None else end - start
        return F.when(transformed, F.substring(F.col("text"), (start + 1).cast("int"), length.cast("int")))

    return (
        placed.withColumn("form", form)
        .select(
            "doc_id", F.col("cut.n").alias("n"), "form", part(F.lit(0), F.col("cut.prefix_end")).alias("prefix"),
            part(F.col("cut.prefix_end"), F.col("cut.middle_end")).alias("middle"),
            part(F.col("cut.middle_end")).alias("suffix"), "text",
        )
        .withColumn(
            "output",
            F.when(F.col("form") == "plain", F.col("text"))
            .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
            .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")),
        )
        .drop("text")
    )


def restore(output: Column, form: Column) -> Column:
    """The exact text from an output and its form; transformed texts hold no marker of their own."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def middle_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of every row's transformation and of the text restored from it."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
