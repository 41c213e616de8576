"""WARC packages: round trips, ZIP64, other writers' packages, damage."""

import base64
import gzip
import hashlib
import io
import json
import os
import zipfile

import pytest

from fieldtide.llm import warc
from fieldtide.session import shared_folder

SCHEMA = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(1, "http://a/é", "<p>same</p>"), (2, None, "<p>same</p>"), (5, "u\r\nX: y\"\\", "<p>same</p>"), (3, "", None), (4, "u", ""),
        (6, "u", "x\r\n\r\nWARC/1.1\r\n\r\n"), (7, "v", "big é😀" * 100_000), (8, "v", "only")]


@pytest.mark.parametrize("zip64, least, package", [(False, 0, 1 << 26), (True, 0, 300), (False, 5, 300)])
def test_round_trip(spark, zip64, least, package):
    pages = spark.createDataFrame([(*r, "more") for r in ROWS], SCHEMA + ", original string").repartition(3)
    manifest = warc.write_archives(pages, shared_folder(spark, "t"), package, least, zip64)
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8] and sum(r.records for r in manifest.collect()) == 8
    for page_id, url, html in ROWS:
        r = got[page_id]
        same = [p for p, _, h in ROWS if (h or "") == (html or "")]
        first = max(same) if len((html or "").encode()) >= least else page_id
        assert (r.url, r.payload_digest, r.payload_bytes) == (url or "", sha(html), len((html or "").encode()))
        assert r.record_type == ("response" if first == page_id else "revisit")
        assert r.refers_to == (None if first == page_id else first)
        assert r.payload == ((html or "").encode() if first == page_id else None)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "b")]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), shared_folder(spark, "t"))
    got = warc.read_archives(manifest).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (1, "response"), (2, "response")]
    unnamed = spark.createDataFrame([(None, None, "a"), (1, "u", "a"), (None, "v", "a")], SCHEMA)
    got = warc.read_archives(warc.write_archives(unnamed, shared_folder(spark, "t"))).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "response")] * 2 + [(1, "response")]
    none = warc.write_archives(spark.createDataFrame([], SCHEMA), shared_folder(spark, "t"))
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def package(zip64=False):
    sink = io.BytesIO()
    writer = warc.PackageWriter(sink, zip64)
    for name, parts in (("a", [b"one", b"two"]), ("b/c", [b"three"])):
        writer.start(name)
        for p in parts:
            writer.write(p)
        writer.finish()
    writer.close()
    return sink.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_plain_zip_files(zip64):
    data = package(zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.read("a") == b"onetwo" and z.read("b/c") == b"three" and z.testzip() is None
    reader = warc.PackageReader(io.BytesIO(data), len(data))
    assert {n: reader.read(*p) for n, p in reader.members.items()} == {"a": b"onetwo", "b/c": b"three"}


def test_reads_packages_of_others():
    sink = io.BytesIO()
    sink.write(b"self-extracting stub")
    with zipfile.ZipFile(sink, "a") as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"x" * 5000)
        z.writestr("packed", "y" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("stored", "z")
        z.comment = b"a comment with PK\x05\x06 in it"
    data = sink.getvalue()
    reader = warc.PackageReader(io.BytesIO(data), len(data))
    assert set(reader.members) == {"big", "stored"} and reader.read(*reader.members["big"]) == b"x" * 5000


@pytest.mark.parametrize("harm", [lambda d: d[:-5], lambda d: d[:40], lambda d: b"", lambda d: d.replace(b"PK\x01\x02", b"PKxx")])
def test_damage_is_an_error(harm):
    data = harm(package())
    with pytest.raises(ValueError):
        warc.PackageReader(io.BytesIO(data), len(data))


def test_wrong_payload_is_an_error():
    data = warc.record(1, "u", b"payload", sha("payload"), None)
    assert warc.parse_record(data).payload == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"payload\r", b"pAyload\r"))
    with pytest.raises(ValueError):
        warc.parse_record(data[:-2])


def test_only_the_ranges_are_read(tmp_path):
    path = os.path.join(tmp_path, "p.zip")
    with open(path, "wb") as f:
        writer = warc.PackageWriter(f)
        writer.start(warc.DATA)
        places = []
        for i in range(50):
            data = gzip.compress(warc.record(i, "u", b"%d" % i * 50, sha("%d" % i * 50), None))
            places.append((writer.write(data), len(data)))
        writer.finish()
        writer.close()
    reader = warc.open_package(path)
    read = []
    plain = reader.read
    reader.read = lambda at, n: read.append(n) or plain(at, n)
    got = list(warc.records_in(reader, [places[3], places[4], places[40]]))
    assert [r.id for r in got] == [3, 4, 40] and read == [places[3][1] + places[4][1], places[40][1]]


def foreign(kind, block, more=(), http=True):
    head = ["WARC/1.0", f"warc-type: {kind}", "WARC-Record-ID: <urn:uuid:%s>" % hashlib.md5(block).hexdigest(),
            f"Content-Type: {'application/http; msgtype=response' if http else 'application/warc-fields'}",
            "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    records = [foreign("warcinfo", b"software: x\r\n", http=False)]
    records += [foreign("response", HTTP + b"page %d" % i, [f"WARC-Target-URI: http://x.net/{i}"]) for i in range(40)]
    records += [foreign("revisit", HTTP, ["WARC-Target-URI: <http://x.net/40>", "WARC-Payload-Digest: sha1:ABC"])]
    packed = [gzip.compress(r) for r in records]
    at = [sum(map(len, packed[:i])) for i in range(len(packed))]
    lines = [b'net,x)/%d 20200101000000 ' % i + json.dumps(
        {"offset": str(at[i]), "length": str(len(packed[i])), "filename": "b.warc.gz"}).encode() + b"\n" for i in range(1, 42)]
    paths = []
    for k, index in enumerate([None, ("indexes/index.cdxj", b"".join(lines)), ("indexes/index.cdx.gz", gzip.compress(b"".join(lines)))]):
        paths.append(os.path.join(tmp_path, f"{k}.wacz"))
        with zipfile.ZipFile(paths[-1], "w") as z:
            z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
            z.writestr("archive/b.warc.gz", b"".join(packed))
            z.writestr("archive/a.warc.gz", gzip.compress(b"".join(records[1:4])))  # several records in one member, no index
            if index:
                z.writestr(*index)
    for path, infos in zip(paths, (1, 0, 0)):
        got = warc.read_archives(spark.createDataFrame([(path, 0, 0)], warc.MANIFEST)).collect()
        kinds = [r.record_type for r in got]
        assert (kinds.count("warcinfo"), kinds.count("response"), kinds.count("revisit")) == (infos, 43, 1)
        pages = {r.url: r for r in got if r.record_type == "response"}
        for i in range(40):
            r = pages[f"http://x.net/{i}"]
            want = b"page %d" % i
            assert (r.page_id, bytes(r.payload), r.payload_bytes, r.payload_digest) == (None, want, len(want), sha(want.decode()))
        again, = (r for r in got if r.record_type == "revisit")
        assert (again.url, again.payload, again.payload_bytes, again.payload_digest) == ("http://x.net/40", None, None, "ABC")


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_archive_is_walked_in_ranges(most):
    records = [foreign("response", HTTP + b"page %d" % i) for i in range(9)]
    data = b"".join(map(gzip.compress, records))
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("x.warc.gz", data)
        z.writestr("cut.warc.gz", data[:-3])
        z.writestr("harmed.warc.gz", gzip.compress(records[0].replace(b"page", b"pAge")))
    reader = warc.PackageReader(sink, len(sink.getvalue()))
    assert warc.read_index(reader) == {"cut.warc.gz": None, "harmed.warc.gz": None, "x.warc.gz": None}
    assert [r.payload for r in warc.all_records(reader, "x.warc.gz", most)] == [b"page %d" % i for i in range(9)]
    for name in ("cut.warc.gz", "harmed.warc.gz"):
        with pytest.raises(ValueError):
            list(warc.all_records(reader, name, most))
