"""Dictionary-compressed WARC archives: written and read by Spark tasks.

A Zstandard dictionary is trained on a bounded sample of the records. Every archive
begins with it in a skippable frame, and every record follows as a frame of its own, so
an archive is complete in itself and records can be read one by one. Pages with equal
payloads are stored once: the one with the smallest ``page_id`` is a response, the others
are revisit records that refer to it.

Pages never move to one place: digests are grouped (with partial sums in each task), and
each task writes its own rows into archives of ``ARCHIVE_BYTES``, streaming. A retried
task writes new files; only files that a finished task lists are read. Files go through
``pyarrow.fs``, so the folder may be any store that it knows, shared by all executors.

Defined cases: a null html is an empty payload; payloads shorter than ``least`` bytes are
all responses; rows that repeat a ``page_id`` and payload are each a response if it is the
smallest; rows without ``page_id`` refer to one that has it, and are responses if none
has; a null url is left out of the record; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normtext.llm.storage import small, written
from normtext.session import shared_path

ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 1_000  # about so many records train the dictionary,
SAMPLE_LONGEST = 32 << 10  # with so many characters of each at most,
SAMPLE_PARTS = 4  # which come from so many places of a longer one
LEVEL = 3

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    told = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(told) if told else None


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC 1.1 record: a response with the payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def _file_system(folder: str):
    from pyarrow import fs

    uri = "file://" + folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return fs.FileSystem.from_uri(uri)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples = []
    for batch in batches:
        for page_id, url, parts in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "parts"))):
            samples.append(record(page_id, url, parts[0].encode(), False, None))
            samples += [part.encode() for part in parts[1:]]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 20)
    try:
        found = zstandard.train_dictionary(size, samples).as_bytes() if size >= 256 else b""
    except zstandard.ZstdError:  # too few or too equal samples for a dictionary: the archives do without
        found = b""
    yield pa.record_batch({"dictionary": pa.array([found], pa.binary())})


def train_dictionary(pages: DataFrame, rows: int = SAMPLE_ROWS) -> bytes:
    """A dictionary from about ``rows`` records, chosen by a hash; empty if they are too few.

    Of a record of more than ``SAMPLE_LONGEST`` characters ``SAMPLE_PARTS`` parts, spread over the whole of it,
    train the dictionary, together as long as that.
    """
    share = min(1.0, rows / max(1, pages.count()))
    sample = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < int(share * 1_000_000))
    part = SAMPLE_LONGEST // SAMPLE_PARTS
    parts = F.expr(
        f"if(length(html) <= {SAMPLE_LONGEST}, array(html), transform(sequence(0, {SAMPLE_PARTS - 1}),"
        f" i -> substring(html, cast(i * (length(html) - {part}) DIV {SAMPLE_PARTS - 1} AS int) + 1, {part})))"
    )
    cut = sample.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select("page_id", "url", parts.alias("parts"))
    # The sample is bounded by its parameters, so one task holds it.
    return cut.repartition(1).mapInArrow(_trained, "dictionary binary").first()["dictionary"]


def _written(folder: str, dictionary: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = _file_system(folder)
    store.create_dir(root, recursive=True)
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
    name, out, size, count = "", None, 0, 0

    def done() -> pa.RecordBatch:
        out.close()
        return pa.record_batch({"file": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to")]
        for page_id, url, html, revisit, refers_to in zip(*columns):
            if out is None:
                name = f"pages-{uuid.uuid4().hex}.warc.zst"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                start = dictionary_frame(dictionary)
                out.write(start)
                size, count = len(start), 0
            frame = compressor.compress(record(page_id, url, (html or "").encode(), revisit, refers_to))
            out.write(frame)
            size, count = size + len(frame), count + 1
            if size >= ARCHIVE_BYTES:
                yield done()
                out = None
    if out is not None:
        yield done()


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html, revisit, refers_to``: which rows refer to another row with the same payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.when(F.octet_length(payload) >= least, F.unhex(F.sha2(payload, 256))).alias("sha"))
    first = keyed.where("sha IS NOT NULL").groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    shared = written(first.where("n > 1").select("sha", "first_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keyed.join(small(shared, shared.count()), "sha", "left").select(
        "page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes all rows of ``pages`` (``page_id, url, html``) as archives in ``folder``; ``file, records, bytes`` per archive."""
    dictionary = train_dictionary(pages)
    return written(
        with_revisits(pages, least).mapInArrow(
            lambda batches: _written(folder, dictionary, batches), "file string, records long, bytes long"
        )
    )


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an open archive."""
    start = stream.read(8)
    trained = None
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == SKIPPABLE_MAGIC:
        trained = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", start[4:])[0]))
    else:
        stream.seek(0)
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=trained).stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := reader.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := reader.readline()).strip():
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        block = reader.read(int(head["Content-Length"]))
        reader.read(4)
        yield head, block


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = _file_system(folder)
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for file in batch.column("file").to_pylist():
            rows: list[tuple] = []
            with store.open_input_file(f"{root}/{file}") as stream:
                for head, block in records_of(stream):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = head["WARC-Type"] == "revisit"
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    if not revisit and (payload_digest(payload) != told or len(payload) != length):
                        raise ValueError(f"{file}: payload of {head['WARC-Record-ID']} doesn't fit its digest")
                    refers_to = _page_id(head["WARC-Refers-To"]) if revisit else None
                    rows.append((_page_id(head["WARC-Record-ID"]), length, told, head["WARC-Type"], refers_to, head.get("WARC-Target-URI")))
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)


def read_archives(listing: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives; payloads are checked against their digests."""
    files = max(1, listing.count())
    return listing.select("file").repartition(files).mapInArrow(lambda batches: _read(folder, batches), PAGE_SCHEMA)


def archived(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` into a new shared folder and reads the archives back."""
    folder = shared_path(spark, "archives")
    return read_archives(write_archives(pages, folder, least), folder)
