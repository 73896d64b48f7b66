"""WARC records in ZIP-packaged archives: written by tasks, read back by byte ranges.

An archive is a ZIP file (ZIP64 where sizes or counts ask for it) whose members are stored, not
compressed: `archive/data.warc.gz`, one gzip member a record, and `indexes/index.cdxj`, a line a
record with offset and length. The reader takes the end of the file, follows the ZIP64 locator if
there is one, parses the central directory, checks that a member is stored, and reads single records
as ranges; nothing is extracted. Index lines are dealt out as blocks of ranges, so one large archive
is many tasks' work.

Files are reached through pyarrow.fs by URI, so the folder may be in any store that executors share.
A task writes under a name of its own, and only archives that a finished task reported are read: a
lost or repeated task leaves a file that nothing refers to.

Of records with equal payloads of `least` bytes or more, the one with the smallest page_id is the
response and the others are revisits, with no payload. A page_id that is null comes last. Repeated
rows with one page_id count as one page for this: of them the record that comes first in its digest group
cannot be told apart, so all keep their payload. Null html is an empty payload. Control characters of a url are left out
of its header, as a header is one line; a null url has no header. Other columns are ignored. An empty table gives no archive and an empty
result. A damaged archive (no directory, a cut file, an index or record of another digest or length) raises ValueError
and names the file: records are never left out silently.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LAST = 2**63 - 1
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Signatures and marks of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 0x0001
#: A digest with more than this part of all pages is hot; there are fewer such digests than its inverse.
HOT_PART = 1 / 4096


def opened(uri: str, write: bool = False):
    """A file in any store: a seekable one to read, or a stream to write."""
    store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
    if write:
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


class ZipWriter:
    """Stored members, written one after another to a stream; sizes stand in a local ZIP64 field that is known beforehand."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> None:
        size, crc = 0, 0
        for c in chunks:
            size, crc = size + len(c), zlib.crc32(c, crc)
        raw, start = name.encode(), self.at
        self._write(
            struct.pack(
                "<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(raw), 20,
            ) + raw + struct.pack("<HHQQ", ZIP64_FIELD, 16, size, size)
        )
        for c in chunks:
            self._write(c)
        self.members.append((raw, crc, size, start))

    def close(self, zip64: bool | None = None) -> None:
        """zip64 None: only as needed."""
        start = self.at
        for raw, crc, size, at in self.members:
            wide = [v for v in (size, size, at) if v >= FULL32 or zip64]
            extra = struct.pack(f"<HH{len(wide)}Q", ZIP64_FIELD, 8 * len(wide), *wide) if wide else b""
            small = lambda v: FULL32 if zip64 or v >= FULL32 else v
            self._write(
                struct.pack(
                    "<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, small(size), small(size), len(raw),
                    len(extra), 0, 0, 0, 0, small(at),
                ) + raw + extra
            )
        n, size, end = len(self.members), self.at - start, self.at
        if zip64 or n >= FULL16 or start >= FULL32 or size >= FULL32:
            self._write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", LOCATOR64, 0, end, 1))
            n, size, start = FULL16, FULL32, FULL32
        self._write(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


def members(file) -> dict[str, tuple[int, int, int]]:
    """Stored members of a ZIP file: name to (offset of the data, size, crc). Reads the end, the directory and local headers only."""
    size = file.size()
    tail_at = max(0, size - 65_557)
    tail = _range(file, tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END), 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == n or FULL32 in (length, start):
        signature, _, end64, _ = struct.unpack("<IIQI", _range(file, tail_at + at - 20, 20))
        if signature != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        signature, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", _range(file, end64, 56))
        if signature != END64:
            raise ValueError("no ZIP64 end of central directory")
    directory, at, found = _range(file, start, length), 0, {}
    for _ in range(n):
        head = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if head[0] != CENTRAL:
            raise ValueError("a bad central directory")
        method, crc, packed, plain, name_n, extra_n, comment_n, offset = head[4], head[7], head[8], head[9], head[10], head[11], head[12], head[16]
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        values = iter(_zip64(extra))
        plain, packed, offset = (next(values) if v == FULL32 else v for v in (plain, packed, offset))
        at += 46 + name_n + extra_n + comment_n
        if method == 0 and packed == plain:
            local = struct.unpack("<IHHHHHIIIHH", _range(file, offset, 30))
            if local[0] != LOCAL:
                raise ValueError(f"no local header of {name}")
            found[name] = (offset + 30 + local[9] + local[10], plain, crc)
    return found


def _zip64(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_FIELD:
            return list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
        at += 4 + n
    return []


def _range(file, offset: int, n: int) -> bytes:
    file.seek(offset)
    data = file.read(n)
    if len(data) != n:
        raise ValueError("the file ends early")
    return data


def record(kind: str, page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record; payload is empty for a revisit, size and digest are of the full one."""
    named = lambda i: f"<urn:page:{'null' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {named(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {named(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length")
    return fields, rest[:n]


def dealt(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to of each page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    place = F.coalesce("page_id", F.lit(LAST))
    # digests are counted from narrow rows; a hot one (there are fewer than 1 / HOT_PART) is broadcast, the others are joined by digest
    counted = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min(place).alias("one"), F.count("*").alias("n")).filter("n > 1")
    counted = common.written(counted)
    bound = max(16.0, HOT_PART * (counted.agg(F.sum("n")).first()[0] or 0))
    hot = counted.filter(F.col("n") > bound).select(F.col("digest").alias("hot_digest"), F.col("one").alias("hot_one"))
    few = counted.filter(F.col("n") <= bound).select(F.col("digest").alias("of"), "one")
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    # rows that are settled have a key of their own each, and meet nobody
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest").cast("string"))
    key = F.when(F.col("hot_one").isNotNull() | (F.col("size") < least), own).otherwise(F.col("digest"))
    rows = rows.withColumn("key", key).join(few, F.col("key") == F.col("of"), "left").withColumn("first", F.coalesce("hot_one", "one"))
    later = F.col("first") < place
    kind = F.when(later, "revisit").otherwise("response").alias("record_type")
    return rows.select("page_id", "url", "payload", "size", "digest", kind, F.when(later, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 100, archive_bytes: int = 128 << 20, zip64: bool | None = None) -> DataFrame:
    """Writes the archives; (uri, records, bytes) of each."""

    def run(batches):
        out, index, held, n = [], [], 0, 0

        def close():
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            with opened(uri, write=True) as file:
                writer = ZipWriter(file)
                writer.add(DATA, out)
                writer.add(INDEX, ["".join(index).encode()])
                writer.close(zip64)
            return pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([n], pa.int64()), "bytes": pa.array([writer.at], pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                payload = b"" if r["record_type"] == "revisit" else r["payload"]
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = packer.compress(
                    record(r["record_type"], r["page_id"], r["url"], payload, r["size"], r["digest"], r["refers_to"])
                ) + packer.flush()
                index.append(json.dumps({"id": r["page_id"], "offset": held, "length": len(data)}) + "\n")
                out.append(data)
                held, n = held + len(data), n + 1
                if held >= archive_bytes:
                    yield close()
                    out, index, held, n = [], [], 0, 0
        if n:
            yield close()

    return common.written(dealt(pages, least).mapInArrow(common.trimmed(run), "uri string, records long, bytes long"), pages.sparkSession)


def read_archives(archives: DataFrame, block: int = 2000) -> DataFrame:
    """Each record of the archives (column uri): its headers as columns, and its payload. Blocks of ranges are dealt to tasks."""

    def locate(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                with opened(uri) as file:
                    try:
                        found = members(file)
                    except (ValueError, struct.error, UnicodeDecodeError, StopIteration) as error:
                        raise ValueError(f"{uri}: a damaged archive: {error}") from error
                    if not {INDEX, DATA} <= found.keys():
                        raise ValueError(f"{uri}: no stored {INDEX} or {DATA}")
                    offset, size, crc = found[INDEX]
                    text = _range(file, offset, size)
                    if zlib.crc32(text) != crc:
                        raise ValueError(f"{uri}: a damaged index")
                    start = found[DATA][0]
                    ranges = [(start + x["offset"], x["length"]) for x in map(json.loads, text.splitlines())]
                blocks = [ranges[k : k + block] for k in range(0, len(ranges), block)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uri] * len(blocks)),
                        pa.array([[r[0] for r in b] for b in blocks], pa.list_(pa.int64())),
                        pa.array([[r[1] for r in b] for b in blocks], pa.list_(pa.int64())),
                    ],
                    ["uri", "offsets", "lengths"],
                )

    def fetch(batches):
        for batch in batches:
            for uri, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with opened(uri) as file:
                    for offset, n in zip(offsets, lengths, strict=True):
                        try:
                            fields, payload = parsed(zlib.decompress(_range(file, offset, n), 31))
                        except (zlib.error, ValueError) as error:
                            raise ValueError(f"{uri}: a damaged record at {offset}: {error}") from error
                        name = lambda k: None if (v := fields.get(k)) is None or v == "<urn:page:null>" else int(
                            v[len("<urn:page:") : -1]
                        )
                        full, kind = int(fields["x-payload-length"]), fields["warc-type"]
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != full):
                            raise ValueError(f"{uri}: a damaged record at {offset}")
                        rows.append((name("warc-record-id"), fields.get("warc-target-uri"), full, digest, kind, name("warc-refers-to"), payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    spark = archives.sparkSession
    n = spark.sparkContext.defaultParallelism
    located = archives.select("uri").mapInArrow(common.trimmed(locate), "uri string, offsets array<long>, lengths array<long>")
    return located.repartition(max(n, 4 * n)).mapInArrow(
        common.trimmed(fetch),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
    )


def packaged(pages: DataFrame, least: int = 100, **options) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads all records back."""
    archives = write_archives(pages, common.shared_dir(pages.sparkSession), least, **options)
    return read_archives(archives)


__all__ = ["ZipWriter", "dealt", "members", "packaged", "parsed", "read_archives", "record", "write_archives"]
