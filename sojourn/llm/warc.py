"""WARC records in ZIP packages, read back by byte ranges.

A package is a ZIP archive whose members are stored, not compressed: ``archive/data.warc.gz``, with
one gzip member per record, and ``indexes/index.cdxj``, one line per record with its place. Readers
find the central directory from the end of the file, through the ZIP64 records where there are any,
locate the two members, and read the index and single records by range; nothing is extracted.

Payloads that occur several times are stored once: of records with equal payloads of at least
``revisit_bytes`` bytes the one with the largest page id is the response, and the others are revisit
records that name it. A repeated page id is written once per row. Null html is an empty payload.
Rows without id have a record without the id's header and are null again when read.

Tasks write packages into a folder that all executors share, under names of their own attempt; only
the packages that a finished task has reported are read, so a repeated task leaves no doubles.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import common
from sojourn.operators.distribute import lookup_join
from sojourn.session import new_folder, stored

REVISIT_BYTES = 1000
# A package is closed at this size.
PACKAGE_BYTES = 1 << 26
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_BYTES = 1 << 20
CRLF = b"\r\n"


# ---- ZIP -----------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, one after the other; ZIP64 records always, so that size never matters."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # Sizes follow the data, as 64-bit numbers: flag 8, version 45, an empty ZIP64 field.
        head = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20)
        self._put(head + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        member = self.members[-1]
        member[2], member[3] = zlib.crc32(data, member[2]), member[3] + len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(
                struct.pack(
                    "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 0x21, crc, 0xFFFFFFFF,
                    0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF,
                ) + raw + extra
            )
        n, size, end = len(self.members), self.at - start, self.at
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class ZipReader:
    """The stored members of an archive of ``size`` bytes, through ``read(offset, length)``."""

    def __init__(self, read, size: int):
        self.read = read
        self.members = dict(self._directory(size))

    def _directory(self, size: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        tail_at = max(0, size - 65_557)  # the end record and the longest comment
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP archive")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            sign, _, where, _ = struct.unpack("<IIQI", self.read(tail_at + at - 20, 20))
            if sign != 0x07064B50:
                raise ValueError("no ZIP64 locator in front of the end record")
            record = self.read(where, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where the locator points")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        data, at = self.read(start, length), 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, _, _, _, packed, plain, n, m, k = struct.unpack_from("<HHHIIIHHH", data, at + 10)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode()
            plain, packed, offset = self._wide(
                data[at + 46 + n : at + 46 + n + m], plain, packed, offset
            )
            yield name, (method, offset, packed)
            at += 46 + n + m + k

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values of 0xFFFFFFFF replaced, in order, by those of the ZIP64 field."""
        out, at = list(values), 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                field, spot = extra[at + 4 : at + 4 + size], 0
                for i, value in enumerate(out):
                    if value == 0xFFFFFFFF:
                        out[i] = struct.unpack_from("<Q", field, spot)[0]
                        spot += 8
            at += 4 + size
        return out

    def place(self, name: str) -> tuple[int, int]:
        """Where the data of a stored member begins, and its length."""
        if name not in self.members:
            raise KeyError(f"no member {name}")
        method, offset, size = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; ranges need a stored member")
        head = self.read(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        n, m = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n + m, size


# ---- WARC ----------------------------------------------------------------------------------------


def record_bytes(fields: list[tuple[str, str]], content: bytes) -> bytes:
    """A WARC record as a gzip member of its own."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    head = f"WARC/1.1\r\n{head}Content-Length: {len(content)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + content + CRLF + CRLF) + packer.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, with lower-case names, and content of one gzipped record."""
    plain = zlib.decompress(data, 31)
    head, found, rest = plain.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut off")
    return fields, rest[:size]


def _uri(page: int | None) -> str:
    return "-" if page is None else f"urn:page:{page}"


def _page_record(page, url: str, payload: bytes, digest: bytes, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}|{digest.hex()}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        *([] if page is None else [("WARC-Page-ID", _uri(page))]),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields += [("WARC-Profile", profile), ("WARC-Refers-To-Page", _uri(refers_to))]
        return record_bytes(fields, head.encode())
    return record_bytes(fields, head.encode() + payload)


# ---- Spark jobs ----------------------------------------------------------------------------------


def with_originals(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, refers_to``: the page whose response a record revisits, or null."""
    rows = pages.selectExpr("page_id", "url", "coalesce(html, '') AS html")
    big = f"octet_length(html) >= {revisit_bytes}"
    keyed = rows.selectExpr("*", f"IF({big}, sha2(html, 256), NULL) AS content")
    groups = keyed.where("content IS NOT NULL").groupBy("content").agg(
        F.expr("max(page_id) AS original"), F.expr("count(*) AS n")
    )
    several = groups.where("n > 1").select("content", "original")
    joined = lookup_join(keyed, several, "content", "left", common.BROADCAST_ROWS)
    return joined.selectExpr(
        "page_id", "url", "html", "IF(original <=> page_id, NULL, original) AS refers_to"
    )


def _opened(folder: str) -> tuple[files.FileSystem, str]:
    """The store and path that a folder's URI or plain path names."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return files.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write all records under ``folder``; returns ``package, size, records`` as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        package = None
        for batch in batches:
            for page in batch.to_pylist():
                if package is None:
                    package = _Package(store, root)
                package.add(page)
                if package.zip.at >= package_bytes:
                    yield package.closed()
                    package = None
        if package is not None:
            yield package.closed()

    rows = with_originals(pages)
    return stored(rows.mapInArrow(common.tidied(run), "package string, size bigint, records bigint"))


class _Package:
    """One package on its way to the shared folder; the index is kept until it is closed."""

    def __init__(self, store: files.FileSystem, root: str):
        self.name = f"{uuid.uuid4().hex}.wacz"
        self.out = store.open_output_stream(f"{root}/{self.name}")
        self.zip, self.index = ZipWriter(self.out), []
        self.zip.begin(RECORDS)
        self.begun = self.zip.at

    def add(self, page: dict) -> None:
        payload = page["html"].encode()
        digest = hashlib.sha1(payload).digest()
        data = _page_record(page["page_id"], page["url"] or "", payload, digest, page["refers_to"])
        place = {"offset": self.zip.at - self.begun, "length": len(data)}
        self.index.append(f"{_uri(page['page_id'])} 19700101000000 {json.dumps(place)}\n")
        self.zip.write(data)

    def closed(self) -> pa.RecordBatch:
        self.zip.end()
        self.zip.begin(INDEX)
        self.zip.write("".join(sorted(self.index)).encode())
        self.zip.end()
        self.zip.close()
        self.out.close()
        columns = {"package": [self.name], "size": [self.zip.at], "records": [len(self.index)]}
        return pa.record_batch(columns)


def records(packages: DataFrame, folder: str) -> DataFrame:
    """``package, offset, length`` of every record, from the packages' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['package']}") as file:
                    archive = ZipReader(lambda at, n: file.read_at(n, at), row["size"])
                    start, _ = archive.place(RECORDS)
                    index = file.read_at(*reversed(archive.place(INDEX)))
                places = [json.loads(line.split(b" ", 2)[2]) for line in index.splitlines()]
                yield pa.record_batch(
                    {
                        "package": [row["package"]] * len(places),
                        "offset": pa.array([start + p["offset"] for p in places], pa.int64()),
                        "length": pa.array([p["length"] for p in places], pa.int64()),
                    }
                )

    return packages.mapInArrow(common.tidied(run), "package string, offset bigint, length bigint")


def read(places: DataFrame, folder: str) -> DataFrame:
    """Records by range: ``page_id, record_type, refers_to, payload, payload_bytes,
    payload_digest``; revisits have no payload of their own (null) but its length and digest."""
    made = "page_id bigint, record_type string, refers_to bigint, payload binary, "
    made += "payload_bytes bigint, payload_digest string"

    def page(uri: str | None) -> int | None:
        return int(uri.rsplit(":", 1)[1]) if uri else None

    def one(data: bytes) -> dict:
        fields, content = parsed(data)
        kind = fields["warc-type"]
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        payload, size = None, int(fields["warc-payload-length"])
        if kind == "response":
            payload = content.partition(CRLF + CRLF)[2]
            if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                raise ValueError(f"the payload of {fields['warc-record-id']} does not fit its digest")
        return {
            "page_id": page(fields.get("warc-page-id")),
            "record_type": kind,
            "refers_to": page(fields.get("warc-refers-to-page")),
            "payload": payload,
            "payload_bytes": size,
            "payload_digest": digest,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        schema = pa.schema(
            [
                ("page_id", pa.int64()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("payload", pa.binary()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
            ]
        )
        for batch in batches:
            rows, held = [], 0
            by_package: dict[str, list[tuple[int, int]]] = {}
            for row in batch.to_pylist():
                by_package.setdefault(row["package"], []).append((row["offset"], row["length"]))
            for name, spots in by_package.items():
                with store.open_input_file(f"{root}/{name}") as file:
                    for offset, length in sorted(spots):
                        rows.append(one(file.read_at(length, offset)))
                        held += rows[-1]["payload_bytes"]
                        if held >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return places.mapInArrow(common.tidied(run), made)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to packages in the shared folder and read all records back."""
    folder = new_folder(pages.sparkSession)
    found = records(write(pages, folder), folder)
    return read(found, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
