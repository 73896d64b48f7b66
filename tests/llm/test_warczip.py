"""ZIP-packaged WARC: exact round trip, the standard library's reader on our files, and ours on its files."""

import hashlib
import io
import zipfile
from collections import Counter

import pyarrow as pa
import pytest

from quantloom.llm import warczip as Z

SCHEMA = "page_id long, url string, html string, payload string, size int"


def rows():
    long = "<p>é" + "x" * 200
    return [(5, "http://a/1", long, "c", 1), (3, "http://a/2", long, "c", 1), (9, None, long, "c", 1), (
        None,
        "http://n",
        long,
        "c",
        1,
    ), (1, "u", None, "c", 1), (2, "u", "", "c", 1), (4, "u", "short", "c", 1), (6, "u", "short", "c", 1),
            (7, "u\r\nX: y", "z" * 100, "c", 1), (8, "u", "z" * 100, "c", 1), (10, "u", "z" * 99, "c", 1), (11, "u", "z" * 99, "c", 1), (
                12,
                "big",
                "WARC/1.1\r\n\r\n" * 90_000,
                "c",
                1,
            ), (3, "http://a/2", long, "c", 1)]


def brute(data):
    digest = lambda r: hashlib.sha256((r[2] or "").encode()).hexdigest()
    order = lambda i: Z.LAST if i is None else i
    one = {}
    for r in data:
        one[digest(r)] = min(one.get(digest(r), Z.LAST), order(r[0]))
    out = []
    for r in data:
        n = len((r[2] or "").encode())
        again = n >= 100 and one[digest(r)] < order(r[0])
        out.append((r[0], n, digest(r), "revisit" if again else "response", one[digest(r)] if again else None))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"archive_bytes": 1, "zip64": True}])
def test_round_trip(spark, options):
    got = Z.packaged(spark.createDataFrame(rows(), SCHEMA).repartition(3), **options).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows())
    texts = {r[0]: (r[2] or "").encode() for r in rows()}
    assert all(r.payload == (texts[r.page_id] if r.record_type == "response" else b"") for r in got)


@pytest.mark.parametrize("zip64", [None, True])
def test_zip_format(zip64):
    out = io.BytesIO()
    writer = Z.ZipWriter(out)
    content = {Z.DATA: b"abc" * 1000, Z.INDEX: b"", "third": b"PK\x05\x06"}
    for name, data in content.items():
        writer.add(name, [data[:5], data[5:]])
    writer.close(zip64)
    theirs = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert theirs.testzip() is None and {n: theirs.read(n) for n in theirs.namelist()} == content
    file = pa.BufferReader(out.getvalue())
    assert {n: Z._range(file, a, k) for n, (a, k, _) in Z.members(file).items()} == content


def test_reads_other_zips():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored", b"data" * 9)
        z.writestr(zipfile.ZipInfo("packed"), b"data" * 9, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment"
    file = pa.BufferReader(out.getvalue())
    found = Z.members(file)
    assert set(found) == {"stored"} and Z._range(file, *found["stored"][:2]) == b"data" * 9
    with pytest.raises(ValueError):
        Z.members(pa.BufferReader(b"no zip at all"))


def test_urls_are_one_line(spark):
    found = {r.page_id: r.url for r in Z.packaged(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert found[7] == "uX: y" and found[9] is None and found[5] == "http://a/1"


@pytest.mark.parametrize("harm", ["cut", "record", "index", "directory", "no zip", "other member"])
def test_damaged_archives_raise(spark, tmp_path, harm):
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 30, "c", 1) for k in range(20)], SCHEMA).coalesce(1)
    uri = Z.write_archives(pages, str(tmp_path)).first().uri
    data = bytearray(open(uri, "rb").read())
    with Z.opened(uri) as file:
        places = Z.members(file)
    if harm == "cut":
        data = data[: len(data) // 2]
    elif harm == "record":
        data[places[Z.DATA][0] + 40] ^= 0xFF
    elif harm == "index":
        data[places[Z.INDEX][0] + 8] ^= 0x01
    elif harm == "directory":
        data[-60] ^= 0xFF
    elif harm == "no zip":
        data = bytearray(b"not a zip")
    else:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("another", b"x")
        data = bytearray(out.getvalue())
    name = tmp_path / "harmed.wacz"
    name.write_bytes(bytes(data))
    with pytest.raises(Exception, match="harmed.wacz"):
        Z.read_archives(spark.createDataFrame([(str(name),)], "uri string")).collect()


def test_a_hot_payload(spark):
    data = [
        (k, f"http://h/{k}", "<p>" + "same" * 40, "c", 1) for k in range(3, 400)
    ] + [(1000 + k, "u", "<p>" + f"{k // 2} " * 80, "c", 1) for k in range(100)]
    got = Z.packaged(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(data)


def test_empty(spark):
    assert Z.packaged(spark.createDataFrame([], SCHEMA)).count() == 0
