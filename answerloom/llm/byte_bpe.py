"""Byte-level BPE by one global table of distinct words.

Texts are cut into pre-tokens by the vocabulary's pattern. Tasks take documents in
blocks; a block keeps its distinct words once, and the documents as sequences of
places in that list, in order. The words of all blocks are shuffled by hash, so
each distinct word of the corpus is in one task and merged once; their ids go
back to the blocks, where the sequences turn into token ids. Positions never
travel with a word, so a word that is in every document costs one row part per block.

Decoding looks every id up in the table of token bytes, which is as large as the
vocabulary and goes to all tasks.

Blocks are named by the rows they hold and built twice, once for words and once for
sequences: `docs` has to give the same rows in the same order each time, as a
stored table does. If it doesn't, encoding stops with an error.

NULL texts are empty and have no tokens. Repeated rows are encoded each. An empty table gives
an empty result.
"""

import base64
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.rows import keyed_texts

#: Bytes of text after which a block ends.
BLOCK_BYTES = 16 << 20
# Rows of a batch of ids or decoded bytes.
BATCH_DOCS = 512
# Letters, numbers and white space up to U+024F, as classes of Python's own engine, which takes a third of the time.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_BEYOND_LATIN = re.compile("[^\x00-ɏ]").search
#: Patterns to those that give the same matches in texts without characters above U+024F.
LATIN_PATTERNS = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
        rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+""",
}
# Above every rank.
_NO_RANK = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: neighbours of the lowest rank, the first of equals, are joined until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return _merged_long(word, ranks)
    # Ranks of neighbours, kept from step to step: a join changes those of two pairs.
    rank = ranks.get
    cuts = list(range(len(word) + 1))
    pairs = [rank(word[k : k + 2], _NO_RANK) for k in range(len(word) - 1)]
    while pairs and (best := min(pairs)) != _NO_RANK:
        k = pairs.index(best)
        del cuts[k + 1], pairs[k]
        if k:
            pairs[k - 1] = rank(word[cuts[k - 1] : cuts[k + 1]], _NO_RANK)
        if k < len(pairs):
            pairs[k] = rank(word[cuts[k] : cuts[k + 2]], _NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of neighbours, for long words."""
    end = list(range(1, len(word) + 1))  # where the part that starts here ends; 0: no part starts here
    before = list(range(-1, len(word) - 1))

    def offer(start):
        if end[start] < len(word):
            stop = end[end[start]]
            rank = ranks.get(word[start:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, start, stop))

    heap: list = []
    for start in range(len(word) - 1):
        offer(start)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = end[start]
        if not middle or middle >= len(word) or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        if stop < len(word):
            before[stop] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


def splitter(pattern: str):
    """A function from a text to the pattern's matches."""
    import regex

    split = regex.compile(pattern).findall
    if pattern not in LATIN_PATTERNS:
        return split
    latin = re.compile(LATIN_PATTERNS[pattern]).findall
    return lambda text: split(text) if not text.isascii() and _BEYOND_LATIN(text) else latin(text)


class _Places(dict):
    """A block's words, numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str):
    """(name, rows, words, codes, counts) of each block; codes are places in words, the frequent ones small."""
    split = splitter(pattern)
    for batch in batches:
        texts = batch.column("text")
        sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in texts])
        at = 0
        while at < batch.num_rows:
            done = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + BLOCK_BYTES, "right")))
            rows = batch.slice(at, end - at)
            at = end
            places = _Places()
            counts, codes = [], []
            for text in rows.column("text"):
                found = split(text.as_py())
                counts.append(len(found))
                codes.append(np.fromiter(map(places.__getitem__, found), np.uint32, len(found)))
            codes = np.concatenate(codes) if codes else np.empty(0, np.uint32)
            order = np.argsort(-np.bincount(codes, minlength=len(places)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = list(places)
            name = hashlib.blake2b(digest_size=8)
            for column in ("doc_id", "mark"):
                name.update(repr(rows.column(column).to_pylist()).encode())
            yield (
                int.from_bytes(name.digest(), "little", signed=True), rows,
                [words[k] for k in order], rank[codes], np.array(counts, np.int64),
            )


def _word_rows(pattern: str, buckets: int):
    """Map function: (bucket, block, places, words), each block's words dealt out by hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, words, _, _ in _blocks(batches, pattern):
            bucket = np.array([zlib.crc32(x.encode()) % buckets for x in words], dtype=np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            column = pa.array(words, pa.string()).take(pa.array(order))
            offsets = pa.array(edges, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[order[edges[:-1]]], pa.int64()), pa.array([block] * (len(edges) - 1), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(order, pa.int32())),
                    pa.ListArray.from_arrays(offsets, column),
                ],
                ["bucket", "block", "places", "words"],
            )

    return rows


def _squeeze(values: np.ndarray) -> bytes:
    """Non-negative numbers below 2**32, byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 4)


def _spread(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _code_rows(pattern: str):
    """Map function: (block, doc_ids, marks, counts, codes), one row per block."""
    longs = pa.list_(pa.int64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, docs, _, codes, counts in _blocks(batches, pattern):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([docs.column("doc_id").to_pylist()], longs),
                    pa.array([docs.column("mark").to_pylist()], longs), pa.array([counts], longs),
                    pa.array([_squeeze(codes)], pa.binary()),
                ],
                ["block", "doc_ids", "marks", "counts", "codes"],
            )

    return rows


def _encoder(shared):
    """Map function: ids of each row's words; a word that comes again is not merged again."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = shared.value, {}
        for batch in batches:
            places, lengths, ids = [], [], []
            for mine, words in zip(batch.column("places"), batch.column("words").to_pylist()):
                flat: list[int] = []
                count = np.empty(len(words), np.uint32)
                for k, word in enumerate(words):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = merged(word.encode(), ranks)
                    count[k] = len(found)
                    flat += found
                places.append(_squeeze(mine.values.to_numpy(zero_copy_only=False)))
                lengths.append(_squeeze(count))
                ids.append(_squeeze(np.array(flat, np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), *[pa.array(x, pa.binary()) for x in (places, lengths, ids)]],
                ["block", "places", "lengths", "ids"],
            )

    return rows


def _assemble(sequences: pa.Table, words: pa.Table) -> pa.Table:
    """Token ids of all documents of one block."""
    names = ["doc_id", "mark", "n_tokens", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    if not sequences.num_rows:
        raise RuntimeError("the documents changed between two reads; store them first")
    places, lengths, ids = (
        [_spread(x) for x in words.column(c).to_pylist()] for c in ("places", "lengths", "ids")
    )
    size = 1 + max((int(x.max()) for x in places if len(x)), default=-1)
    length, start = np.zeros(size, np.int64), np.zeros(size, np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    at = 0
    for place, count, mine in zip(places, lengths, ids):
        length[place] = count
        start[place] = at + np.cumsum(count, dtype=np.int64) - count
        at += len(mine)
    if not length.all():
        raise RuntimeError("the documents changed between two reads; store them first")
    columns, batches = [[], [], [], []], []

    def close():
        batches.append(pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names))
        for column in columns:
            column.clear()

    for row in sequences.to_pylist():
        codes, done = _spread(row["codes"]), 0
        if len(codes) and int(codes.max()) >= size:
            raise RuntimeError("the documents changed between two reads; store them first")
        for doc_id, mark, count in zip(row["doc_ids"], row["marks"], row["counts"]):
            mine = codes[done : done + count]
            done += count
            many = length[mine]
            ends = np.cumsum(many)
            spots = np.arange(ends[-1] if count else 0) + np.repeat(start[mine] - ends + many, many)
            for column, value in zip(columns, (doc_id, mark, len(spots), flat[spots].astype("<u4").tobytes())):
                column.append(value)
            if len(columns[0]) == BATCH_DOCS:
                close()
    close()
    return pa.Table.from_batches(batches)


def encode(docs: DataFrame, ranks_path: str, pattern: str, buckets: int | None = None) -> DataFrame:
    """(doc_id, mark, n_tokens, ids) of every row; ids are little-endian unsigned 32-bit integers.

    `buckets` parts the words of all documents among tasks; as many as shuffle
    partitions, times four, if not given.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed_texts(docs)
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    words = texts.mapInArrow(_word_rows(pattern, buckets), "bucket long, block long, places array<int>, words array<string>")
    found = words.repartition("bucket").select("block", "places", "words").mapInArrow(
        _encoder(shared), "block long, places binary, lengths binary, ids binary"
    )
    sequences = texts.mapInArrow(
        _code_rows(pattern), "block long, doc_ids array<long>, marks array<long>, counts array<long>, codes binary"
    )
    return sequences.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        _assemble, "doc_id long, mark long, n_tokens long, ids binary"
    )


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows with `decoded`, the bytes of their ids, in place of ids and n_tokens; NULL ids give no bytes."""
    table = {rank: token for token, rank in read_ranks(ranks_path).items()}
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                decoded = [
                    b"".join(map(token, np.frombuffer(x.as_buffer() if x.is_valid else b"", "<u4").tolist()))
                    for x in part.column("ids")
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), part.column("ids"), pa.array(decoded, pa.binary())],
                    ["doc_id", "mark", "ids", "decoded"],
                )

    return encoded.select("doc_id", "mark", "ids").mapInArrow(rows, "doc_id long, mark long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, and decoded again."""
    return decode(encode(docs, ranks_path, pattern), ranks_path).select(
        "doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
