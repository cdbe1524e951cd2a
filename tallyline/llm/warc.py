"""WARC records in seekable Zstandard bundles, written and read by Spark.

``write_bundles`` gives each page a record and each task its own bundles. A
bundle is one file: groups of records compressed as independent frames, then
a skippable frame that maps record identifiers to (frame, offset in the frame,
length), then the seek table of the public seekable format (sizes and a
checksum of every frame) as its last bytes. So a reader finds a record from
the end of the file and decompresses one frame only, while a plain Zstandard
reader sees the WARC text.

Of records with equal payloads the one with the smallest identifier is a
``response``, the others are ``revisit`` records without payload that refer to
it. Equal means equal SHA-256 and SHA-1, found by one grouping with partial
results; the least row of a group is a minimum, and only groups of two or more
are joined back, so a payload that a third of the pages share costs no task
more than its part of them. A task holds one frame and the compressed bytes of
one bundle, whatever the number of pages; a payload longer than a frame gets
a frame of its own.

A null payload counts as empty, and empty payloads are alike. Identifiers may
repeat or be null: each row gets its own record; nulls come last when the
smallest is sought, and rows equal in identifier and payload are told apart by
their place in the staged copy. A null URL leaves its header out; blanks and
control characters in a URL are percent-encoded. An empty table gives a folder
without bundles and reads as no records. Further columns are not looked at.
"""

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import broadcast_if_small, staged

#: Fixed values of the public formats: frame magic numbers, and the last bytes of a seekable file.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
LEVEL = 3
#: Bytes of rows handed back to Spark at a time.
BATCH_BYTES = 16 << 20
#: Files that a lookup names one by one; beyond that it reads the folder.
NAMED_FILES = 1000

RECORD = (
    "page_id long, record_id string, record_type string, url string, payload_digest string, payload_bytes long, "
    "refers_to long, refers_to_record string, file string, frame int, offset long, length long, payload binary"
)
INDEX = "record_id string, file string, frame int, offset long, length long"


# Records as text -----------------------------------------------------------------


def record_id(page_id: int | None, row: int, digest: str) -> str:
    """Identifier of a row's record, the same whenever it is asked for."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{row}|{digest}'.encode()).digest())}>"


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def encode_record(row: dict, date: str) -> tuple[str, bytes]:
    """(identifier, bytes) of a row of ``prepared`` pages."""
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    own = record_id(row["page_id"], row["row"], row["sha1"])
    payload, length = row["payload"], row["length"]
    first = row["first"]
    revisit = first is not None and first["row"] != row["row"]
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date)]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _uri(row["url"])))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", row["page_id"]))
    fields.append(("X-Payload-Length", length))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["page_id"], first["row"], row["sha1"]))]
        if first["page_id"] is not None:
            fields.append(("X-Refers-To-Page-ID", first["page_id"]))
        payload = b""
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + len(payload))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return own, b"".join((head.encode(), http, payload, b"\r\n\r\n"))


def decode_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(header fields, block, end) of the record that begins at a place."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    begin = end + 4
    stop = begin + int(fields["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has another length than it says")
    return fields, data[begin:stop], stop + 4


# Bundles -------------------------------------------------------------------------


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Frame(NamedTuple):
    start: int
    packed: int
    plain: int
    checksum: int


class Bundle:
    """One bundle in the making: compressed frames, and the records of the open one."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.parts, self.frames, self.records, self.size = [], [], [], 0
        self.open, self.open_size = [], 0

    def add(self, name: str, record: bytes) -> None:
        if self.open and self.open_size + len(record) > self.frame_bytes:
            self._close_frame()
        self.records.append((name, len(self.frames), self.open_size, len(record)))
        self.open.append(record)
        self.open_size += len(record)

    def _close_frame(self) -> None:
        plain = b"".join(self.open)
        self._append(self.compressor.compress(plain), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)
        self.open, self.open_size = [], 0

    def _append(self, packed: bytes, plain: int, checksum: int) -> None:
        self.parts.append(packed)
        self.frames.append((len(packed), plain, checksum))
        self.size += len(packed)

    def finish(self) -> bytes:
        if self.open:
            self._close_frame()
        index = self.compressor.compress(json.dumps(self.records).encode())
        self._append(_skippable(SKIPPABLE, index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        table = b"".join(struct.pack("<III", *frame) for frame in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        return b"".join((*self.parts, _skippable(SEEK_TABLE, table + footer)))


def seek_table(content) -> list[Frame]:
    """Frames of a bundle, from its last bytes."""
    count, descriptor, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("the file does not end with a seek table")
    entry = struct.Struct("<III" if descriptor & CHECKSUMS else "<II")
    begin = len(content) - 9 - count * entry.size
    if struct.unpack("<II", content[begin - 8 : begin]) != (SEEK_TABLE, count * entry.size + 9):
        raise ValueError("the seek table has another length than it says")
    frames, start = [], 0
    for sizes in entry.iter_unpack(content[begin:-9]):
        frames.append(Frame(start, sizes[0], sizes[1], sizes[2] if len(sizes) > 2 else -1))
        start += sizes[0]
    return frames


def read_frame(content, frame: Frame) -> bytes:
    packed = content[frame.start : frame.start + frame.packed]
    plain = zstandard.ZstdDecompressor().decompress(packed, max_output_size=frame.plain)
    if frame.checksum >= 0 and xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != frame.checksum:
        raise ValueError(f"the frame at {frame.start} is damaged")
    return plain


def read_index(content, frames: list[Frame]) -> list[list]:
    """[identifier, frame, offset in the frame, length] of each record, from the frame before the seek table."""
    last = frames[-1]
    packed = content[last.start + 8 : last.start + last.packed]
    return json.loads(zstandard.ZstdDecompressor().decompress(packed))


# Spark ---------------------------------------------------------------------------


def prepared(pages: DataFrame) -> DataFrame:
    """Staged pages (page_id, url, sha1, row, length, payload) with the first row of their payload's group as ``first``, null if alone.

    Rows that will be revisits leave their payload behind.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.select(
        "*", F.sha1("payload").alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("sha256"), F.monotonically_increasing_id().alias("row")
    )
    rows = staged(rows, "pages")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    groups = rows.groupBy("sha256", "sha1").agg(least.alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = staged(groups.select("sha256", "sha1", F.struct("first.page_id", "first.row").alias("first")), "payload-groups")
    found = rows.join(broadcast_if_small(groups), ["sha256", "sha1"], "left")
    own = F.when(F.col("first").isNull() | (F.col("first.row") == F.col("row")), F.col("payload")).otherwise(F.lit(b""))
    return found.select("page_id", "url", "sha1", "row", "first", F.octet_length("payload").alias("length"), own.alias("payload"))


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for values in zip(*columns):
            yield {name: value.as_py() for name, value in zip(batch.schema.names, values)}


def write_bundles(
    pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Write each page (page_id, url, html) as a record into bundles below ``path``.

    The files come from Spark's own text writer, so any store that Spark
    reaches will do: a row is a bundle without its last byte, and that byte is
    the line separator.
    """
    ending = struct.pack("<I", SEEKABLE)[-1:]

    def pack(batches):
        bundle = None
        for row in _rows(batches):
            bundle = bundle or Bundle(frame_bytes, level)
            bundle.add(*encode_record(row, date))
            if bundle.size >= bundle_bytes:
                yield pa.record_batch({"value": pa.array([bundle.finish()[:-1]], pa.binary())})
                bundle = None
        if bundle:
            yield pa.record_batch({"value": pa.array([bundle.finish()[:-1]], pa.binary())})

    files = prepared(pages).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    writer = files.write.option("lineSep", ending.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _files(spark: SparkSession, paths) -> DataFrame:
    try:
        return spark.read.format("binaryFile").load(paths).filter("length > 0").select("path", "content")
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], "path string, content binary")


def _contents(batches) -> Iterator[tuple]:
    """(values before, memoryview of the content) of each file; nothing is copied."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in names}
            yield {n: v.as_py() for n, v in row.items() if n != "content"}, memoryview(row["content"].as_buffer())


def _arrow_type(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _batched(rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded bytes."""
    held, size, kind = [], 0, _arrow_type(schema)
    for row in rows:
        held.append(row)
        size += 300 + len(row.get("payload") or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def _described(data: bytes, at: int, file: str, frame: int, payloads: bool) -> tuple[dict, int]:
    """A row of ``RECORD``; what a response says of its payload is checked against its bytes."""
    fields, block, end = decode_record(data, at)
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} in {file} is not the one that was written")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": int(page) if page is not None else None, "record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"],
        "url": fields.get("WARC-Target-URI"), "payload_digest": digest, "payload_bytes": length,
        "refers_to": int(refers) if refers is not None else None, "refers_to_record": fields.get("WARC-Refers-To"),
        "file": file, "frame": frame, "offset": at, "length": end - at, "payload": payload if payloads and response else None,
    }, end


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the bundles below ``path``, a row each; payloads of responses on request.

    Each frame's checksum, each record's length and each response's digest is
    checked; a difference ends the job with an error.
    """

    def records(batches):
        for about, content in _contents(batches):
            for number, frame in enumerate(seek_table(content)):
                data, at = read_frame(content, frame) if frame.plain else b"", 0
                while at < len(data):
                    row, at = _described(data, at, about["path"], number, payloads)
                    yield row

    return _files(spark, path).mapInArrow(lambda batches: _batched(records(batches), RECORD), RECORD)


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record lies: file, frame, offset in the frame, length. No frame of records is decompressed."""

    def places(batches):
        for about, content in _contents(batches):
            for name, frame, offset, length in read_index(content, seek_table(content)):
                yield {"record_id": name, "file": about["path"], "frame": frame, "offset": offset, "length": length}

    return _files(spark, path).mapInArrow(lambda batches: _batched(places(batches), INDEX), INDEX)


def lookup(spark: SparkSession, path: str, index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records (with payloads) of a frame of ``record_id``, each frame that holds one decompressed once.

    ``index`` is a kept ``record_index``. Files without a wanted record are
    not opened as long as at most ``NAMED_FILES`` have one.
    """
    wanted = index.join(broadcast_if_small(record_ids.select("record_id").distinct()), "record_id", "left_semi")
    # At most the records of a bundle come together here.
    wanted = staged(wanted.groupBy("file").agg(F.collect_list(F.struct("frame", "offset")).alias("places")), "wanted")
    names = [row.file for row in wanted.select("file").limit(NAMED_FILES + 1).collect()]
    if not names:
        return spark.createDataFrame([], RECORD)
    files = _files(spark, names if len(names) <= NAMED_FILES else path)
    # Spark may write the scheme of a path in two ways; both sides come from the same source.
    found = files.join(broadcast_if_small(wanted.withColumnRenamed("file", "path")), "path")

    def records(batches):
        for about, content in _contents(batches):
            frames, places = seek_table(content), {}
            for place in about["places"]:
                places.setdefault(place["frame"], []).append(place["offset"])
            for number, offsets in sorted(places.items()):
                data = read_frame(content, frames[number])
                for at in sorted(offsets):
                    yield _described(data, at, about["path"], number, True)[0]

    return found.mapInArrow(lambda batches: _batched(records(batches), RECORD), RECORD)
