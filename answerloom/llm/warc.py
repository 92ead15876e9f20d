"""WARC archives: write, index, and read back by coalesced byte ranges.

Archives are gzip members, one per record, in files that a task closes at
`FILE_BYTES`. A file counts only once its name is in the table that `write_archives`
returns: a task that is tried again writes new files, and what a lost attempt left is never read.

The index is made first, from the archives alone: file, offset, length, kind, URL and
digest of each record. Selected records are then read sorted by file and
offset, neighbours in one request, and nothing between them is fetched that is
larger than GAP_BYTES.

A record's payload is the page's html in UTF-8; NULL is an empty payload. Records whose payload
another record has too are revisits of the one with the smallest page_id and carry its
headers only. A NULL page_id is never the one referred to if others are; pages that share page_id
and payload are alike. NULL URLs leave the URL header out. An empty table gives no archives and no rows.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from answerloom.llm.linking import small_side
from answerloom.session import scratch_path, settle

FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Compressed bytes a task reads, and most tasks of a step.
TASK_BYTES, MOST_TASKS = 32 << 20, 50_000
DATE = "2000-01-01T00:00:00Z"
RECORD_ID = "<urn:x-page:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): the page to refer to, for all but the first of equal payloads of `min_bytes` or more."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    mine = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")
    ).withColumn("digest", F.sha1("html"))
    again = settle(
        mine.filter(F.octet_length("html") >= min_bytes).select("page_id", "digest").groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
        .select("digest", "first"), "equal-payloads",
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return mine.join(small_side(again, 96), "digest", "left").select(
        "page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to")
    )


def _one_line(text: str) -> str:
    """A header value: control characters as percent codes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def _record(page_id, url, html: bytes, refers_to) -> bytes:
    digest = base64.b32encode(hashlib.sha1(html).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    headers = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {RECORD_ID.format(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        headers.append(f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is not None:
        headers += [f"WARC-Refers-To: {RECORD_ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(2, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open(uri: str):
    """File system and path of a URI; a plain path is local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _uri(path: str) -> str:
    """file:/x, as Hadoop prints it, in the form with two slashes more."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _qualified(spark, folder: str) -> str:
    """The folder as Spark resolves it: a path without a scheme lies in the cluster's default file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return _uri(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString())


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per page; (file, records, bytes) of each archive that counts."""
    folder = _qualified(pages.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _open(folder)
        system.create_dir(place, recursive=True)
        out, name, records, size = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(c) for c in ("page_id", "url", "html", "refers_to")]):
                if out is not None and size >= FILE_BYTES:
                    yield done()
                    out = None
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{place}/{name}", compression=None)
                body = _gzip(_record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers_to.as_py()))
                out.write(body)
                records, size = records + 1, size + len(body)
        if out is not None:
            yield done()

    return settle(with_revisits(pages, min_bytes).mapInArrow(write, "file string, records long, bytes long"), "archives")


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines) if name}


def _members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, text up to the end of the WARC headers) of each gzip member of a stream.

    Bodies are unpacked piece by piece and thrown away.
    """
    waiting, offset = b"", 0
    while True:
        unpacker, head, taken, ended = zlib.decompressobj(31), b"", 0, False
        while not unpacker.eof:
            if not waiting:
                waiting = stream.read(chunk)
                if not waiting:
                    ended = True
                    break
            before = len(waiting)
            text = unpacker.decompress(waiting)
            waiting = unpacker.unused_data
            taken += before - len(waiting)
            if b"\r\n\r\n" not in head:
                head += text
        if ended and not taken:
            return
        if ended:
            raise EOFError(f"archive cut off in the record at {offset}")
        yield offset, taken, head.partition(b"\r\n\r\n")[0]
        offset += taken


INDEX = "file string, offset long, length long, record_type string, record_id string, url string, digest string, refers_to string"


def index_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives named in the column file."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n in ("offset", "length") else pa.string()) for n in (
            "file", "offset", "length", "record_type", "record_id", "url", "digest", "refers_to")])
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, path = _open(file)
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for offset, length, head in _members(stream):
                        h = _headers(head)
                        rows.append(dict(zip(schema.names, (
                            file, offset, length, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"),
                            h.get("warc-payload-digest"), h.get("warc-refers-to"),
                        ))))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    # A task per archive: with a number given, Spark does not merge tasks by the size of the names.
    tasks = max(1, min(archives.count(), MOST_TASKS))
    return archives.select("file").repartition(tasks, "file").mapInArrow(scan, INDEX)


def ranges(rows: list[tuple[str, int, int]], most: int = READ_BYTES, gap: int = GAP_BYTES) -> list[list[int]]:
    """Numbers of sorted (file, offset, length) rows, grouped into requests: near each other, and `most` bytes unless one record is larger."""
    groups: list[list[int]] = []
    for k, (file, offset, length) in enumerate(rows):
        if groups:
            first, last = rows[groups[-1][0]], rows[groups[-1][-1]]
            if file == last[0] and 0 <= offset - last[1] - last[2] <= gap and offset + length - first[1] <= most:
                groups[-1].append(k)
                continue
        groups.append([k])
    return groups


def read_records(index: DataFrame) -> DataFrame:
    """(record_id, record_type, url, refers_to, digest, payload_bytes, payload) of the records in an index.

    payload is NULL for revisits; payload_bytes is the full payload's size for them too. A response whose payload
    does not have the digest it names is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
            ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")]))
            current, stream = None, None
            for group in ranges(rows):
                file, start, _ = rows[group[0]]
                if file != current:
                    if stream is not None:
                        stream.close()
                    system, path = _open(file)
                    current, stream = file, system.open_input_file(path)
                stop = rows[group[-1]][1] + rows[group[-1]][2]
                data = stream.read_at(stop - start, start)
                out = []
                for k in group:
                    _, offset, length = rows[k]
                    head, _, block = zlib.decompress(data[offset - start : offset - start + length], 31).partition(b"\r\n\r\n")
                    h = _headers(head)
                    block = block[: int(h["content-length"])]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    response = h["warc-type"] == "response"
                    digest = h["warc-payload-digest"]
                    if response and digest != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
                        raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                    size = len(payload) if response else int(_headers(http)["content-length"])
                    out.append((
                        h.get("warc-record-id"), h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"),
                        digest, size, payload if response else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)
            if stream is not None:
                stream.close()

    # As many ranges as the records' bytes ask for, and one per archive where there are cores for it.
    total = index.agg(F.sum("length").alias("bytes"), F.count_distinct("file").alias("files")).first()
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(MOST_TASKS, max(-(-(total.bytes or 0) // TASK_BYTES), min(total.files, cores))))
    chosen = index.select("file", "offset", "length")
    ranged = chosen.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ranged.mapInArrow(
        read, "record_id string, record_type string, url string, refers_to string, digest string, payload_bytes long, payload binary"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as its archive has them."""
    archives = write_archives(pages, scratch_path(pages.sparkSession, "warc"))
    index = settle(index_archives(archives), "warc-index")
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return read_records(index).select(
        as_id("record_id").alias("page_id"), "payload_bytes", F.substring_index("digest", ":", -1).alias("payload_digest"),
        "record_type", as_id("refers_to").alias("refers_to"),
    )
