"""WARC archives packed in ZIP files, read in place.

A package is a ZIP with two stored members: `archive/data.warc.gz` (one gzip member per record)
and `index.cdxj` (one line per record: key, offset, length, digest). The reader looks at the end
of the file for the central directory, with ZIP64 records where sizes or offsets exceed 32 bits,
finds the stored members, reads the index, and fetches records by byte range. Nothing is unpacked.

Packages of other writers are read too: every stored member that ends in `.warc.gz` is an archive,
and the lines of stored `.cdxj`, `.cdx` and `.cdx.gz` members that hold JSON are their index (by
file name). An archive that no index names is read from end to end, one gzip member at a time.

Files are opened by `pyarrow.fs`, so any store it knows will do for the shared folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtide.llm.common import stored

DATA, INDEX = "archive/data.warc.gz", "index.cdxj"
PACKAGE_BYTES = 64 << 20  # a package is closed when its archive exceeds this
READ_BYTES = 4 << 20  # records are fetched in ranges of about this size
LEVEL = 4  # of gzip
DATE = "2000-01-01T00:00:00Z"  # records carry no time of their own here
MANIFEST = "path string, records long, bytes long"

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = (
    b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x07\x08")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# --- records -------------------------------------------------------------------------------

def record(record_id: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit, which names the record it repeats instead of a payload."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(uri)[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes

    def get(self, name: str) -> str | None:
        """A header; names differ in case between writers."""
        return self.headers.get(name, self.headers.get(name.lower()))

    @property
    def own(self) -> bool:
        return self.get("X-Payload-Length") is not None

    @property
    def kind(self) -> str | None:
        return self.get("WARC-Type")

    @property
    def id(self) -> int | None:
        return _page_of(self.get("WARC-Record-ID"))

    @property
    def uri(self) -> str:
        named = self.get("WARC-Target-URI") or ""
        return json.loads(f'"{named}"') if self.own else named.removeprefix("<").removesuffix(">")

    @property
    def digest(self) -> str | None:
        """Of the payload, as named; counted where a record of another writer names none."""
        named = self.get("WARC-Payload-Digest")
        if named is not None:
            return named.removeprefix("sha1:")
        return None if self.kind == "revisit" else payload_digest(self.payload)

    @property
    def refers_to(self) -> int | None:
        return _page_of(self.get("WARC-Refers-To"))

    @property
    def payload_bytes(self) -> int | None:
        """Of the full payload; null for a revisit that does not tell."""
        if self.own:
            return int(self.get("X-Payload-Length"))
        return None if self.kind == "revisit" else len(self.payload)


def _page_of(record_id: str | None) -> int | None:
    """The page of an id that this module gave, else null."""
    named = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(named) if named.removeprefix("-").isdecimal() else None


def parse_records(data: bytes):
    """All records of a gzip member, usually one.

    A record of this module is checked by its payload's digest, one of another writer by its
    block's, if that is a SHA-1 in base32.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name] = headers[name.lower()] = value[1:] if value.startswith(" ") else value
        length = int(headers["content-length"])
        block, at = data[end + 4:end + 4 + length], end + 8 + length
        if len(block) != length or data[at - 4:at] != b"\r\n\r\n":
            raise ValueError("the record's length is not what it says")
        http = headers.get("content-type", "").startswith("application/http")
        found = Record(headers, block.partition(b"\r\n\r\n")[2] if http else block)
        named = headers.get("warc-block-digest", "")
        if found.own and found.get("WARC-Refers-To") is None and payload_digest(found.payload) != found.digest:
            raise ValueError("the payload does not match its digest")
        if not found.own and named.startswith("sha1:") and len(named) == 37 and payload_digest(block) != named[5:].upper():
            raise ValueError("the block does not match its digest")
        yield found


def parse_record(data: bytes) -> Record:
    found, = parse_records(data)
    return found


# --- ZIP packages --------------------------------------------------------------------------

class PackageWriter:
    """Writes members one after the other, stored, with their sizes behind them (bit 3)."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.at, self.members, self.force = sink, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        self.name, self.begun, self.crc, self.size = name.encode(), self.at, 0, 0
        # ZIP64 sizes in the local header are announced by an empty extra, as they come later
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(self.name), len(extra)))
        self._put(self.name + extra)
        self.data_at = self.at

    def write(self, data: bytes) -> int:
        """Appends to the open member and returns the offset of data in it."""
        offset = self.size
        self._put(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        return offset

    def finish(self) -> None:
        self._put(struct.pack("<4sIQQ", DESCRIPTOR, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.begun))

    def close(self) -> None:
        begun = self.at
        for name, crc, size, at in self.members:
            big = self.force or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            small = FULL32 if big else size
            self._put(struct.pack(
                "<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8, 0, 0, 33, crc, small, small, len(name), len(extra),
                0, 0, 0, 0, FULL32 if big else at) + name + extra)
        size, count, end = self.at - begun, len(self.members), self.at
        big = self.force or begun >= FULL32 or size >= FULL32 or count >= FULL16
        if big:
            self._put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, begun))
            self._put(struct.pack("<4sIQI", LOCATOR64, 0, end, 1))
        self._put(struct.pack(
            "<4sHHHHIIH", END, 0, 0, FULL16 if big else count, FULL16 if big else count,
            FULL32 if big else size, FULL32 if big else begun, 0))


class PackageReader:
    """Members of a ZIP by name -> (offset of their bytes, size), found without reading them."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = dict(self._directory())

    def read(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(length)
        if len(data) != length:
            raise ValueError("the package is cut off")
        return data

    def _directory(self):
        tail_at = max(0, self.size - 22 - FULL16 - 20)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") != len(tail):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("not a ZIP package")
        count, size, begun = struct.unpack_from("<HII", tail, at + 10)
        locator = tail[at - 20:at] if at >= 20 else b""
        if locator[:4] == LOCATOR64:
            end64 = struct.unpack_from("<Q", locator, 8)[0]
            block = self.read(end64, 56)
            if block[:4] != END64:
                raise ValueError("the ZIP64 end record is missing")
            count, size, begun = struct.unpack_from("<QQQ", block, 32)
        data, at = self.read(begun, size), 0
        for _ in range(count):
            if data[at:at + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            method, = struct.unpack_from("<H", data, at + 10)
            packed, full, n, m, k = struct.unpack_from("<IIHHH", data, at + 20)
            local, = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46:at + 46 + n].decode("utf-8")
            full, packed, local = self._wide(data[at + 46 + n:at + 46 + n + m], full, packed, local)
            if method == 0:  # only stored members can be read in place
                if packed != full:
                    raise ValueError(f"{name}: a stored member of two sizes")
                yield name, (self._data_at(local), full)
            at += 46 + n + m + k

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values, those at their 32-bit limit from the ZIP64 extra field, in its order."""
        at = 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                numbers = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
                return [next(numbers) if v == FULL32 else v for v in values]
            at += 4 + length
        return list(values)

    def _data_at(self, local: int) -> int:
        head = self.read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError("a member has no local header")
        n, m = struct.unpack_from("<HH", head, 26)
        return local + 30 + n + m


def open_package(path: str):
    store, inner = open_store(path)
    source = store.open_input_file(inner)
    return PackageReader(source, source.size())


# --- Spark ---------------------------------------------------------------------------------

def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload_sha1 (hex) and original.

    original: the largest page_id with the same payload of at least least_bytes, null where no
    other row has it. Payloads are compared by digest; the light table of shared ones is made
    first and comes to the pages by page and digest, so a payload that a third of all rows share
    neither meets in one task nor moves twice.
    """
    payload = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("payload_sha1"))
    light = pages.select(
        "page_id", F.octet_length(payload).alias("n"), F.sha1(payload.cast("binary")).alias("payload_sha1")
    ).where(F.col("n") >= least_bytes)
    shared = light.groupBy("payload_sha1").agg(
        F.max("page_id").alias("original"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    again = stored(
        light.join(shared, "payload_sha1").where("page_id is not null")
        .select("page_id", "payload_sha1", "original").distinct(), "shared-payloads")
    return marked.join(again, ["page_id", "payload_sha1"], "left").select(
        "page_id", "url", "html", "payload_sha1", "original")


def write_archives(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES,
                   least_bytes: int = 0, zip64: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html) as packages below `folder`; the manifest (path, records, bytes).

    Of records with equal payloads of at least least_bytes the one with the largest page_id is a
    response, the others revisit it. Null html: empty payload; null url: empty. Rows without
    page_id are responses. Repeated rows are records of their own; further columns are ignored.
    No pages, no packages. Each task writes packages under new names and only those in the
    stored manifest count, so a task that is repeated leaves at most an unlisted file behind.
    """
    def each(batches):
        import pyarrow as pa

        store, inner = open_store(folder)
        store.create_dir(inner, recursive=True)
        writer = None

        def begin():
            nonlocal path, sink, writer, lines
            path = f"part-{uuid.uuid4().hex}.zip"
            sink = store.open_output_stream(f"{inner}/{path}")
            writer, lines = PackageWriter(sink, zip64), []
            writer.start(DATA)

        def end():
            nonlocal writer
            size = writer.size
            writer.finish()
            writer.start(INDEX)
            for line in lines:
                writer.write(line)
            writer.finish()
            writer.close()
            sink.close()
            writer = None
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{path}"]), pa.array([len(lines)], pa.int64()), pa.array([size], pa.int64())],
                ["path", "records", "bytes"])

        path = sink = lines = None
        for batch in batches:
            for page_id, url, html, sha1, original in zip(*(batch.column(i) for i in range(5))):
                if writer is None:
                    begin()
                page, first = page_id.as_py(), original.as_py()
                mark = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                data = gzip.compress(record(
                    page, url.as_py() or "", payload, mark, None if first == page else first), LEVEL, mtime=0)
                at = writer.write(data)
                lines.append(f"{page} {json.dumps({'offset': at, 'length': len(data), 'digest': mark})}\n".encode())
                if writer.size >= package_bytes:
                    yield end()
        if writer is not None:
            yield end()

    return stored(with_originals(pages, least_bytes).mapInArrow(each, MANIFEST), "manifest")


def read_index(reader: PackageReader) -> dict[str, list[tuple[int, int]] | None]:
    """Archive member -> (offset, length) of its records in order; None where no index names it."""
    archives = sorted(n for n in reader.members if n.endswith(".warc.gz"))
    by_file = {n.rsplit("/", 1)[-1]: n for n in archives}
    found = {n: [] for n in archives}
    for name, (at, size) in reader.members.items():
        if not name.endswith((".cdxj", ".cdx", ".cdx.gz", ".cdxj.gz")):
            continue
        data = reader.read(at, size)
        for line in io.BytesIO(gzip.decompress(data) if name.endswith(".gz") else data):
            start = line.find(b"{")
            if start < 0:
                continue
            entry = json.loads(line[start:])
            if "filename" in entry:
                archive = by_file.get(str(entry["filename"]).rsplit("/", 1)[-1])
            else:
                archive = archives[0] if len(archives) == 1 else None
            if archive is not None and "offset" in entry and "length" in entry:
                found[archive].append((int(entry["offset"]), int(entry["length"])))
    return {n: sorted(set(places)) or None for n, places in found.items()}


def records_in(reader: PackageReader, places: list[tuple[int, int]], most: int = READ_BYTES, archive: str = DATA):
    """Records at the places, neighbouring ones fetched in one range read."""
    base, size = reader.members[archive]
    k = 0
    while k < len(places):
        first, j = places[k][0], k + 1
        while j < len(places) and places[j][0] == sum(places[j - 1]) and sum(places[j]) - first <= most:
            j += 1
        last = sum(places[j - 1])
        if last > size:
            raise ValueError("the index points beyond the archive")
        data = reader.read(base + first, last - first)
        for offset, length in places[k:j]:
            yield from parse_records(gzip.decompress(data[offset - first:offset - first + length]))
        k = j


def all_records(reader: PackageReader, archive: str, most: int = READ_BYTES):
    """Records of an archive without an index; one gzip member is in memory at once."""
    base, size = reader.members[archive]
    at, rest, unpack, held = 0, b"", None, []
    while at < size or rest:
        if not rest:
            rest = reader.read(base + at, min(most, size - at))
            at += len(rest)
        unpack = unpack or zlib.decompressobj(31)
        held.append(unpack.decompress(rest))
        rest = b""
        if unpack.eof:
            rest = unpack.unused_data
            yield from parse_records(b"".join(held))
            unpack, held = None, []
    if unpack is not None:
        raise ValueError("the archive is cut off")


def read_archives(manifest: DataFrame, most_tasks: int = 20_000) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, record_id) of all records.

    payload: null for a revisit; bytes and digest are those of the full payload, so far as the
    record tells. Records of other writers, of any type, have the page_id and refers_to null, and
    their payload is what follows the HTTP head, or the block where there is none. Packages are
    dealt out one to a task up to most_tasks; their size is bounded by the writer.
    """
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "record_id"]

    def each(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = open_package(path)
                rows, held = [], 0
                for archive, places in read_index(reader).items():
                    found = all_records(reader, archive) if places is None else records_in(reader, places, archive=archive)
                    for r in found:
                        rows.append((r.id, r.uri, r.kind, None if r.kind == "revisit" else r.payload, r.payload_bytes,
                                     r.digest, r.refers_to, r.get("WARC-Record-ID")))
                        held += len(r.payload) + 200
                        if held > READ_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                reader.source.close()

    tasks = max(1, min(manifest.count(), most_tasks))
    return manifest.select("path").repartition(tasks).mapInArrow(
        each, "page_id long, url string, record_type string, payload binary, payload_bytes long, "
              "payload_digest string, refers_to long, record_id string")
