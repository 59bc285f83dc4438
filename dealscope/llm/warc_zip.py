"""WARC records in ZIP packages, read by ranges.

Each task writes its records, one gzip member each, into packages of bounded size: a stored member with the records
and a stored member with their places. Reading needs no extraction: the end of the file gives the central
directory (ZIP64 where sizes or counts call for it), the directory gives the stored members, the index gives the
records, and each record is one range read. Places and records are separate steps, so a large package is read by
many tasks. Files are opened through pyarrow, which knows local and remote file systems by their URI.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from dealscope.llm.tables import identity, join_hot, partitions
from dealscope.session import scratch_path, stage

PACKAGE_BYTES = 64 << 20
RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.jsonl"

# Fixed values of the ZIP format: signatures and record sizes.
END, END_SIZE = b"PK\x05\x06", 22
END64_LOCATOR, END64_LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
DIRECTORY, DIRECTORY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
LONGEST_COMMENT = 0xFFFF
WIDE16, WIDE32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@dataclass
class Member:
    """A file of a package: its name, method, size as stored, and where its local header is."""

    name: str
    method: int
    size: int
    header: int


def members(source: pa.NativeFile) -> list[Member]:
    """The central directory of an open package."""
    size = source.size()
    tail_at = max(0, size - END_SIZE - LONGEST_COMMENT)
    tail = source.read_at(size - tail_at, tail_at)
    # The comment after the record reaches to the end of the file, and may hold the signature itself.
    at = tail.rfind(END, 0, len(tail) - END_SIZE + len(END))
    while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at + len(END) - 1)
    if at < 0:
        raise ValueError("not a ZIP file: no end record")
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    where = tail_at + at
    if WIDE16 == count or WIDE32 in (length, offset):
        locator = source.read_at(END64_LOCATOR_SIZE, max(0, where - END64_LOCATOR_SIZE))
        if locator[:4] == END64_LOCATOR:
            record = source.read_at(END64_SIZE, struct.unpack_from("<Q", locator, 8)[0])
            if record[:4] != END64:
                raise ValueError("damaged ZIP64 end record")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
    directory = source.read_at(length, offset)
    out, at = [], 0
    for _ in range(count):
        if directory[at:at + 4] != DIRECTORY:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + DIRECTORY_SIZE:at + DIRECTORY_SIZE + name_size]
        extra_at = at + DIRECTORY_SIZE + name_size
        extra = directory[extra_at:extra_at + extra_size]
        wide = 0
        while wide + 4 <= len(extra):
            kind, field_size = struct.unpack_from("<HH", extra, wide)
            if kind == EXTRA64:
                # Only the values that did not fit are there, in this order.
                values = iter(struct.unpack_from(f"<{field_size // 8}Q", extra, wide + 4))
                plain = next(values) if plain == WIDE32 else plain
                packed = next(values) if packed == WIDE32 else packed
                header = next(values) if header == WIDE32 else header
            wide += 4 + field_size
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, header))
        at = extra_at + extra_size + comment_size
    return out


def data_start(source: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    header = source.read_at(LOCAL_SIZE, member.header)
    if header[:4] != LOCAL:
        raise ValueError("damaged local header")
    name_size, extra_size = struct.unpack_from("<HH", header, 26)
    return member.header + LOCAL_SIZE + name_size + extra_size


def _gzip_places(source: pa.NativeFile, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members in a range, for packages without an index."""
    at, begin, rest = start, start, b""
    decoder = zlib.decompressobj(31)
    while at < start + size or rest:
        if not rest:
            rest = source.read_at(min(step, start + size - at), at)
            at += len(rest)
        decoder.decompress(rest)
        rest = decoder.unused_data
        if decoder.eof:
            end = at - len(rest)
            yield begin, end - begin
            begin, decoder = end, zlib.decompressobj(31)
        else:
            rest = b""


def places(packages: DataFrame) -> DataFrame:
    """(uri, offset, length) of every record of the packages in column ``uri``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = _opened(uri)
                with system.open_input_file(path) as source:
                    stored = {member.name: member for member in members(source)}
                    found: list[tuple[int, int]] = []
                    for name, member in stored.items():
                        if not name.endswith(".warc.gz"):
                            continue
                        start = data_start(source, member)
                        index = stored.get(INDEX) if name == RECORDS else None
                        if index is None:
                            found += _gzip_places(source, start, member.size)
                        else:
                            lines = source.read_at(index.size, data_start(source, index)).splitlines()
                            found += [(start + entry["offset"], entry["length"]) for entry in map(json.loads, lines)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(found), pa.string()), pa.array([x for x, _ in found], pa.int64()),
                     pa.array([x for _, x in found], pa.int64())], names=["uri", "offset", "length"])

    return packages.select("uri").mapInArrow(run, "uri string, offset long, length long")


def _head(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and what follows the empty line."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("utf-8").strip().lower()] = value.decode("utf-8").strip()
    return fields, rest


_READ = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def records(places: DataFrame) -> DataFrame:
    """The records at the given places, each fetched by one range read.

    payload is null in a revisit, whose payload_bytes and payload_digest describe the payload it stands for. A response
    whose payload does not have the digest it states is an error.
    """
    names = [field.split()[0] for field in _READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, source = None, None
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for next_uri, offset, length in zip(*(batch.column(n).to_pylist() for n in ("uri", "offset", "length"))):
                if next_uri != uri:
                    if source is not None:
                        source.close()
                    system, path = _opened(next_uri)
                    uri, source = next_uri, system.open_input_file(path)
                fields, block = _head(gzip.decompress(source.read_at(length, offset)))
                http, payload = _head(block[:int(fields["content-length"])])
                kind = fields["warc-type"]
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload digest of record {fields['warc-record-id']} differs")
                page, refers = (fields.get(name) for name in ("x-page-id", "x-refers-to-page-id"))
                out.append((int(page) if page else None, fields.get("warc-target-uri"), int(http["content-length"]), digest, kind,
                            int(refers) if refers else None, payload if kind == "response" else None))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if source is not None:
            source.close()

    return places.mapInArrow(run, _READ)


def _field(name: str, value: object) -> bytes:
    plain = str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in str(value) or "\n" in str(value) else str(value)
    return f"{name}: {plain}\r\n".encode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record as its own gzip member."""
    http = (b"HTTP/1.1 200 OK\r\n" + _field("Content-Type", "text/html; charset=utf-8") + _field("Content-Length", len(payload)) + b"\r\n")
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + _field("WARC-Type", "revisit" if revisit else "response")
    head += _field("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>") + _field("WARC-Date", "2024-01-01T00:00:00Z")
    head += _field("WARC-Payload-Digest", f"sha1:{digest}") + _field("Content-Type", "application/http; msgtype=response")
    if url is not None:
        head += _field("WARC-Target-URI", url)
    if page_id is not None:
        head += _field("X-Page-Id", page_id)
    if revisit:
        head += _field("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if first is not None:
            head += _field("X-Refers-To-Page-Id", first)
    head += _field("Content-Length", len(block)) + b"\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 1, mtime=0)


def write_packages(rows: DataFrame, folder: str, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, digest, first, revisit) to packages of about ``limit`` bytes; (uri, records) of each.

    Every attempt of a task writes files of its own and only those of the attempt that counts are in the result, so lost
    or repeated tasks do no harm.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        system.create_dir(root, recursive=True)
        names = ("page_id", "url", "payload", "digest", "first", "revisit")
        done: list[tuple[str, int]] = []

        def packages(rows: Iterator[tuple]) -> None:
            row = next(rows, None)
            while row is not None:
                name = f"{uuid.uuid4().hex}.zip"
                with system.open_output_stream(f"{root}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
                    index, at = [], 0
                    with package.open(RECORDS, "w", force_zip64=True) as member:
                        while row is not None and at < limit:
                            raw = record(*row)
                            member.write(raw)
                            index.append(json.dumps({"offset": at, "length": len(raw), "page_id": row[0]}))
                            at += len(raw)
                            row = next(rows, None)
                    package.writestr(INDEX, "\n".join(index))
                done.append((f"{folder}/{name}", len(index)))

        packages(row for batch in batches for row in zip(*(
            (value.as_py() for value in batch.column(name)) for name in names)))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                                         names=["uri", "records"])

    return rows.select("page_id", "url", "payload", "digest", "first", "revisit").mapInArrow(run, "uri string, records long")


def _base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.schema.get_field_index("digest")
        found = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column(column).to_pylist()]
        yield batch.set_column(column, "digest", pa.array(found, pa.string()))


def with_revisits(pages: DataFrame, revisit_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows for ``write_packages``: of equal payloads of at least ``revisit_bytes`` bytes, all but the one with the smallest
    key (null keys last, then any one) are revisits of it."""
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({**identity("page_id", F.sha1("payload"))}).withColumnRenamed("_content", "digest")
    names = ["_none", "_key", "digest"]
    keys = stage(rows.groupBy(*names).agg(F.count("*").alias("_same")), "payloads")
    groups = keys.groupBy("digest").agg(F.min(F.struct("_none", "_key")).alias("_first"), F.count("*").alias("_size"))
    decided = join_hot(keys.select(*names), groups, ["digest"], "_size", keys.count()).select(*names, "_first")
    same = Window.partitionBy(*names).orderBy(F.col("url").asc_nulls_first())
    placed = rows.join(decided, names).withColumn("_row", F.row_number().over(same))
    itself = (F.struct("_none", "_key") == F.col("_first")) & (F.col("_row") == 1)
    revisit = ~itself & (F.octet_length("payload") >= revisit_bytes)
    first = F.when(revisit & ~F.col("_first._none"), F.col("_first._key"))
    out = placed.select("page_id", "url", "payload", "digest", first.alias("first"), revisit.alias("revisit"))
    return out.mapInArrow(_base32, out.schema)


def round_trip(pages: DataFrame, revisit_bytes: int = 0, folder: str | None = None, limit: int = PACKAGE_BYTES,
               key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes every page as a WARC record into ZIP packages in ``folder`` and reads them back: one row per page.

    page_id, url, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to (null for responses), payload (null
    for revisits). A null html is an empty payload; rows with null or repeated keys are pages of their own; other columns
    are ignored; no rows give no rows. Without ``folder`` a new one in the session's shared folder is used.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "packages")
    if "://" not in folder:
        folder = folder.replace("file:/", "/", 1) if folder.startswith("file:/") else folder
    packages = stage(write_packages(with_revisits(pages, revisit_bytes, key, url, html), folder, limit), "manifest")
    found = places(packages.repartition(partitions(spark), "uri"))
    return records(found)
