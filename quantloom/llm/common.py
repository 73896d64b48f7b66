"""What the corpus operators share: the shared folder, written stages, and texts as byte arrays.

Words are maximal runs of bytes other than space, \\t, \\n, \\v, \\f and \\r. In UTF-8 every
byte of a longer character is 0x80 or more, so splitting bytes splits code points too.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handled in slices of about so many bytes, which bounds the arrays a worker holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset on a local master (tests) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and outlives any executor."""
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table made by written() that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of stages whose results are written.

    Spark has no call for that: it deletes them as the driver's JVM collects garbage, by itself every half an hour only. On a
    cluster with dynamic allocation or a short cleaner interval this is a no-op; results do not depend on it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trimmed(run):
    """run, a function from batches to batches, which at its end gives freed memory back to the system.

    Workers outlive their tasks; what they hold idle would count against the executor in the next stage.
    """

    def inner(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return inner


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns, typed, so that further columns of docs cannot clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


ID_TEXT = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """The batch in row ranges of about `most` bytes of text; a longer text is a range of its own."""
    sizes = pc.binary_length(batch.column(column).fill_null("")).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(batch):
        yield batch.slice(start)


class Words:
    """The words of a column of texts, as positions in one byte array.

    buf: all bytes; start, end: of each word; first: index of each text's first word, one more at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("").cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        self.off = off - off[0]
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        self.buf = buf
        word = ~_SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[self.off] = True
        before = np.ones(len(buf), bool)
        before[1:] = ~word[:-1]
        self.start = np.flatnonzero(word & (before | edge[:-1]))
        after = np.ones(len(buf), bool)
        after[:-1] = ~word[1:]
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.buf, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of all bytes of each span, alike in every process: a polynomial of mixed bytes, from prefix sums."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = len(buf)
    if len(_POWERS[0]) < size + 1:
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
                steps = np.full(max(size, SLICE_BYTES) + 1, b, np.uint64)
                steps[0] = 1
                _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_MIX[buf] * _POWERS[0][:size], out=sums[1:])
    h = (sums[end] - sums[start]) * _POWERS[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every bit depends on all (the 64-bit finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive word hashes; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    factor = 1
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * np.uint64(factor)
        factor = factor * 0x9FB21C651E98DF25 % 2**64
    return mixed(out)


def covered(positions: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of the positions."""
    steps = np.zeros(n + k + 1, np.int32)
    np.add.at(steps, positions, 1)
    np.add.at(steps, positions + k, -1)
    return np.cumsum(steps)[:n] > 0
