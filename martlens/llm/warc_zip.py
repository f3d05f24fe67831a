"""WARC records in ZIP packages, read by range without extraction.

A package is a ZIP file with stored members: ``archive/data.warc.gz`` (a gzip member for each record) and
``indexes/index.cdxj`` (offset and length of each record). The reader finds the end-of-central-directory record, with ZIP64 its
locator and record, parses the central directory, locates the stored members behind their local headers, range-reads the index
and then, in tasks of a few megabytes, the records themselves.

Cases: a null html is an empty payload. Of pages with equal payloads of at least ``min_bytes`` bytes the largest page_id is the
response and the others are revisits of it; rows that repeat that page_id with that payload are responses too. Null page_ids
are revisits, or responses where all of their payload are null. An empty table gives no package and an empty result. Line breaks
in a url are escaped. Other columns of the input aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.common import file_system, join_heavy, map_texts, pinned, scratch_path, write_file
from martlens.llm.near_dedup import marks

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean"
_U16, _U32 = 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Chunks of a ZIP file with stored members, written from front to back; sizes follow each member."""

    def __init__(self, zip64: bool = True):
        self.zip64, self.at, self.members = zip64, 0, []

    def _out(self, chunk: bytes) -> bytes:
        self.at += len(chunk)
        return chunk

    def member(self, name: str, chunks: Iterator[bytes]) -> Iterator[bytes]:
        raw, start, crc, size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) if self.zip64 else b""
        unknown = _U32 if self.zip64 else 0
        yield self._out(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, unknown, unknown, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
            yield self._out(chunk)
        yield self._out(struct.pack("<IIQQ" if self.zip64 else "<IIII", 0x08074B50, crc, size, size))
        self.members.append((raw, start, crc, size))

    def close(self) -> bytes:
        start, n, tail = self.at, len(self.members), b""
        for raw, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if self.zip64 else b""
            size, at = (_U32, _U32) if self.zip64 else (size, at)
            tail += self._out(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra)
        size = self.at - start

        if self.zip64:
            tail += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", 0x07064B50, 0, self.at, 1)
            return tail + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, _U16, _U16, _U32, _U32, 0)
        return tail + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 0)


def central_directory(file, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, offset of the local header, stored size) of every member of an open file, by range reads of its end."""
    n = min(size, 22 + _U16 + 20)
    tail = file.read_at(n, size - n)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != n:  # the mark can stand in a comment too
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    if (entries == _U16 or length == _U32 or start == _U32) and at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (record,) = struct.unpack_from("<Q", tail, at - 12)
        wide = file.read_at(56, record)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory")
        entries, length, start = struct.unpack_from("<QQQ", wide, 32)
    raw, at, out = file.read_at(length, start), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        (method,) = struct.unpack_from("<H", raw, at + 10)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        (offset,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, k = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                p = k + 4
                values = []
                for value in (full, packed, offset):
                    if value == _U32:
                        (value,), p = struct.unpack_from("<Q", extra, p), p + 8
                    values.append(value)
                full, packed, offset = values
            k += 4 + n
        out.append((name, method, offset, packed))
        at += 46 + n_name + n_extra + n_comment
    return out


def member_start(file, offset: int) -> int:
    """Where a member's bytes begin, behind its local header."""
    header = file.read_at(30, offset)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return offset + 30 + n_name + n_extra


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {quote(url or '', safe=''';/?:@&=+$,-_.!~*'()#%[]''')}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = 128 << 20) -> DataFrame:
    """(path, records) of the packages that hold a record for each row of ``pages`` (page_id, url, html), a few for each task."""
    size = F.octet_length("html")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("name", F.sha2("html", 256))
    chosen = rows.filter(size >= min_bytes).groupBy("name").agg(F.max("page_id").alias("chosen"), F.count("*").alias("n")).filter("n > 1")
    chosen = pinned(chosen, "repeated")
    # Only pages whose payload may repeat, by a bitmap, are joined; a payload of very many pages is sent to the tasks, not its pages to one.
    marked = marks(rows.withColumn("doc_id", F.xxhash64("name")), chosen.select(F.xxhash64("name").alias("doc_id"))).drop("doc_id")
    total = chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = join_heavy(marked.filter("marked").drop("marked"), chosen, ["name"], "n", total, "left")
    other = marked.filter("NOT marked").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    rows = other.unionByName(again.select("page_id", "url", "html", F.when(F.coalesce(F.col("page_id") != F.col("chosen"), F.col("chosen").isNotNull()), F.col("chosen")).alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((p, u, (h or "").encode(), r) for b in batches for p, u, h, r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = next(every, None)
        while held is not None:
            index: list[bytes] = []

            def records(first=held, index=index):
                nonlocal held
                held, at = first, 0
                while held is not None and at < package_bytes:
                    page_id, url, payload, refers_to = held
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = pack.compress(_record(page_id, url, payload, refers_to, refers_to is not None)) + pack.flush()
                    index.append(json.dumps({"page": page_id, "offset": at, "length": len(raw), "filename": DATA}).encode() + b"\n")
                    at += len(raw)
                    yield raw
                    held = next(every, None)

            def package(records=records, index=index):
                zip_ = ZipWriter()
                yield from zip_.member(DATA, records())
                yield from zip_.member(INDEX, iter(index))
                yield zip_.close()

            path = write_file(folder, "package.zip", package())
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)]})

    return pinned(map_texts(rows, run, "path string, records long"), "packages")


def locate(packages: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """(path, start, lengths): ranges of records next to each other in the packages of ``packages`` (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            system, inner = file_system(path)
            with system.open_input_file(inner) as file:
                members = {n: (m, o, s) for n, m, o, s in central_directory(file, file.size())}
                for name in (DATA, INDEX):
                    if members[name][0] != 0:
                        raise ValueError(f"{name} of {path} isn't stored")
                data, at = member_start(file, members[DATA][1]), member_start(file, members[INDEX][1])
                end, rest, start, lengths = at + members[INDEX][2], b"", 0, []
                while at < end:  # the index too by parts
                    part = rest + file.read_at(min(1 << 20, end - at), at)
                    at += min(1 << 20, end - at)
                    lines = part.split(b"\n")
                    rest = lines.pop()
                    for x in map(json.loads, lines):
                        lengths.append(x["length"])
                        if sum(lengths) >= range_bytes or len(lengths) >= 5000:
                            yield pa.RecordBatch.from_pydict({"path": [path], "start": [data + start], "lengths": [lengths]})
                            start, lengths = start + sum(lengths), []
                if lengths:
                    yield pa.RecordBatch.from_pydict({"path": [path], "start": [data + start], "lengths": [lengths]})

    return packages.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


_PAGE = re.compile(r"<urn:page:(-?\d*)>")


def parse_record(raw: bytes) -> tuple:
    """RECORDS of an unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    kind, named = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page, to = _PAGE.match(fields["WARC-Record-ID"])[1], _PAGE.match(fields.get("WARC-Refers-To", "<urn:page:>"))[1]
    intact = kind == "revisit" and not payload or len(payload) == length and digest(payload) == named
    return int(page) if page else None, length, named, kind, int(to) if to else None, fields["WARC-Target-URI"], intact


def read_archives(packages: DataFrame) -> DataFrame:
    """RECORDS of every record of the packages of ``packages`` (path). intact: a response's payload has the length and digest stated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, lengths in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            system, inner = file_system(path)
            with system.open_input_file(inner) as file:
                raw = memoryview(file.read_at(sum(lengths), start))
            rows, at = [], 0
            for n in lengths:
                rows.append(parse_record(zlib.decompress(raw[at : at + n], 31)))
                at += n
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    spark = packages.sparkSession
    ranges = pinned(locate(packages.repartition("path")), "ranges")
    return ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes packages of ``pages`` in the shared folder and reads their records back. A revisit without a response of its digest and length is an error."""
    records = pinned(read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc"), min_bytes)), "records")
    named = lambda kind, page: records.filter(F.col("record_type") == kind).select(F.col(page).alias("page"), "payload_digest", "payload_bytes").distinct()
    if named("revisit", "refers_to").join(named("response", "page_id"), ["page", "payload_digest", "payload_bytes"], "left_anti").limit(1).count():
        raise ValueError("a revisit refers to no response of its digest and length")
    return records
