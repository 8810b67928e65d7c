"""WARC records in ZIP-packaged archives: writing, and reading by ranges without extraction.

An archive is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``, in which
every record is a gzip member of its own, and ``indexes/index.cdxj``, one JSON line per record
with its offset and length. The reader needs the end of the file, the central directory, the
index, and then only the byte ranges of the records.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import join_by_key, stored, text_or_empty
from fleetlens.session import shared_dir

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20    # an archive is closed once it has so many bytes of records
RANGE_BYTES = 4 << 20       # neighbouring records are read together up to this size

# Fixed values of the ZIP format: signatures, and what marks a field as held in ZIP64 form.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL32, FULL16, ZIP64_EXTRA = 0xFFFFFFFF, 0xFFFF, 1
DATA_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdxj"


# ---- the ZIP container -------------------------------------------------------------------

class StoredZip:
    """Writes stored members one after the other; ZIP64 fields are used throughout."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, pieces: Iterator[bytes], size: int, crc: int) -> None:
        raw, start = name.encode(), self.at
        extra = struct.pack("<HHQQ", ZIP64_EXTRA, 16, size, size)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32,
                              len(raw), len(extra)) + raw + extra)
        for piece in pieces:
            self._put(piece)
        self.members.append((raw, start, size, crc))

    def close(self) -> None:
        start = self.at
        for raw, offset, size, crc in self.members:
            extra = struct.pack("<HHQQQ", ZIP64_EXTRA, 24, size, size, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc,
                                  FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32)
                      + raw + extra)
        size, n, end = self.at - start, len(self.members), self.at
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def read_range(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    data = f.read(size)
    if len(data) != size:
        raise ValueError(f"archive ends within bytes {offset} to {offset + size}")
    return data


def central_directory(f, file_size: int) -> dict[str, tuple[int, int]]:
    """Where each stored member's bytes lie: name -> (offset, size). Reads the end record (or
    its ZIP64 form), the directory, and the fixed part of each local header.

    Raises ValueError if there is no directory or a member is compressed: such a member
    cannot be read by ranges.
    """
    tail = read_range(f, max(0, file_size - 65557), min(file_size, 65557))
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    _, _, _, _, n, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    if FULL16 == n or FULL32 in (size, start):
        where = file_size - len(tail) + at - 20
        mark, _, end64, _ = struct.unpack("<IIQI", read_range(f, where, 20))
        if mark != LOCATOR64:
            raise ValueError("ZIP64 sizes without a ZIP64 locator")
        head = struct.unpack("<IQHHIIQQQQ", read_range(f, end64, 56))
        if head[0] != END64:
            raise ValueError("damaged ZIP64 end record")
        n, size, start = head[7:]
    directory, members, at = read_range(f, start, size), {}, 0
    for _ in range(n):
        (mark, _, _, _, method, _, _, _, packed, plain, name_len, extra_len, note_len, _, _, _,
         offset) = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if mark != CENTRAL:
            raise ValueError("damaged central directory")
        name = directory[at + 46:at + 46 + name_len].decode()
        extra = directory[at + 46 + name_len:at + 46 + name_len + extra_len]
        at += 46 + name_len + extra_len + note_len
        if method != 0:
            raise ValueError(f"member {name} is compressed, not stored")
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == ZIP64_EXTRA:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            extra = extra[4 + length:]
        local = struct.unpack("<IHHHHHIIIHH", read_range(f, offset, 30))
        if local[0] != LOCAL:
            raise ValueError(f"no local header for {name}")
        members[name] = (offset + 30 + local[9] + local[10], packed)
    return members


# ---- records -----------------------------------------------------------------------------

def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """A response, or with ``refers_to`` a revisit, which has the HTTP header but no payload."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if refers_to is not None else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Page-Id: {page_id}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[4:4] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case and the payload (what follows the HTTP header)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# ---- writing -----------------------------------------------------------------------------

ARCHIVES = "path string, bytes long, records long"


def _writer(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, number = TaskContext.get(), [], 0
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        pieces: list[bytes] = []
        index: list[bytes] = []
        size = crc = 0

        def close() -> None:
            nonlocal size, crc, number
            # one name per partition; an attempt writes aside and renames, so that repeated
            # and speculative attempts end with one whole file
            name = f"part-{task.partitionId():06d}-{number:04d}.wacz"
            aside = f"{base}/.{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(aside) as out:
                zipped = StoredZip(out)
                zipped.add(DATA_NAME, iter(pieces), size, crc)
                lines = b"".join(index)
                zipped.add(INDEX_NAME, iter([lines]), len(lines), zlib.crc32(lines))
                zipped.close()
            fs.move(aside, f"{base}/{name}")
            made.append((f"{folder}/{name}", zipped.at, len(index)))
            pieces.clear()
            index.clear()
            size, crc, number = 0, 0, number + 1

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                page_id, url, html, refers_to = row
                payload = (html or "").encode()
                raw = gzip.compress(make_record(page_id, url, payload, refers_to, date), 4, mtime=0)
                entry = {"page_id": page_id, "offset": size, "length": len(raw)}
                index.append((json.dumps(entry) + "\n").encode())
                pieces.append(raw)
                size, crc = size + len(raw), binascii.crc32(raw, crc)
                if size >= ARCHIVE_BYTES:
                    close()
        if pieces:
            close()
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x)) for x in zip(*made)], names=["path", "bytes", "records"])
    return write


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, refers_to: the largest id with an equal payload, null if it is the page's own
    or the payload is shorter than ``min_bytes``. Payloads are equal if length, SHA-1 and
    SHA-256 are."""
    html = text_or_empty("html")
    ids = stored(pages.select(
        "page_id", F.octet_length(html).cast("long").alias("_bytes"), F.sha1(html).alias("_sha1"),
        F.sha2(html, 256).alias("_sha2")), "warc-ids")
    long = ids.filter(F.col("_bytes") >= min_bytes)
    keys = ["_bytes", "_sha1", "_sha2"]
    groups = long.groupBy(*keys).agg(F.max("page_id").alias("_last"), F.count("*").alias("n"))
    repeated = stored(groups.filter("n > 1"), "warc-repeated")
    return join_by_key(long, repeated, keys, max(1, long.count())).filter(
        "page_id < _last").select("page_id", F.col("_last").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES,
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record per row of ``pages`` (page_id, url, html), as archives in ``folder``,
    which all executors must reach. Returns path, bytes, records per archive.

    Null html is an empty payload, a null url a ``urn:page:`` target. Rows without a page_id
    have no record id and are refused. Repeated rows each get a record. No rows, no archives.
    """
    whole = pages.select(
        F.coalesce("page_id", F.raise_error(F.lit("a page without page_id"))).cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    marked = whole.join(revisits(whole, min_bytes), "page_id", "left")
    return stored(marked.mapInArrow(_writer(folder, date), ARCHIVES), "warc-list")


# ---- reading -----------------------------------------------------------------------------

RANGES = "path string, start long, size long, offsets array<long>"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary")


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges of neighbouring records, from each archive's directory and index."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            out: list[tuple[str, int, int, list[int]]] = []
            with _open(path) as f:
                members = central_directory(f, f.size())
                start, _ = members[DATA_NAME]
                lines = read_range(f, *members[INDEX_NAME]).splitlines()
            for line in lines:
                entry = json.loads(line)
                at, size = start + entry["offset"], entry["length"]
                if out and out[-1][1] + out[-1][2] == at and out[-1][2] + size <= RANGE_BYTES:
                    path_, first, before, offsets = out[-1]
                    out[-1] = (path_, first, before + size, [*offsets, before])
                else:
                    out.append((path, at, size, [0]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x)) for x in zip(*out)], names=["path", "start", "size", "offsets"])


def _records(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as f:
                    data = read_range(f, row["start"], row["size"])
                cols: list[list] = [[] for _ in range(7)]
                for a, b in zip(row["offsets"], [*row["offsets"][1:], len(data)]):
                    fields, payload = parse_record(gzip.decompress(data[a:b]))
                    kind = fields["warc-type"]
                    sha1 = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                    if kind == "response" and hashlib.sha1(payload).digest() != sha1:
                        raise ValueError(f"payload of page {fields['x-page-id']} is damaged")
                    refers = fields.get("x-refers-to-page-id")
                    for col, value in zip(cols, (
                            int(fields["x-page-id"]), fields["warc-target-uri"], kind,
                            refers and int(refers), int(fields["x-payload-length"]), sha1.hex(),
                            payload if with_payload else None)):
                        col.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                         pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)],
                    names=["page_id", "url", "record_type", "refers_to", "payload_bytes",
                           "payload_digest", "payload"])
    return read


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in ``path``: RECORDS. Directories and indexes are
    parsed once per archive, then the ranges are dealt over all tasks. The payload of a
    revisit is empty; its length and digest are those of the full payload."""
    spark = archives.sparkSession
    ranges = archives.select("path").mapInArrow(_ranges, RANGES)
    parts = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return ranges.repartition(parts).mapInArrow(_records(with_payload), RECORDS)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    folder = shared_dir(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    return read_archives(write_archives(pages, folder), with_payload=False)
