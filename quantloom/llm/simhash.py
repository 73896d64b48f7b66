"""SimHash near-dedup with multi-index hashing.

A fingerprint has a bit where over half of the XXH64 hashes of the text's word shingles have it.
Fingerprints link if they differ in `distance` (2) bits at most, and linked ones are one component.

Multi-index hashing: a fingerprint is cut into `segments`, and each is a table from the segment's value to
the fingerprints that have it. Two fingerprints within the distance differ by distance // segments bits at most
in one of them, so a fingerprint probes each table with the ball of that radius about its own value, and
what it fetches is verified by the complete distance. (At radius 1 only flips from 0 to 1 are probed, as the other
fingerprint of such a pair flips the other way.)

A value of over `hot` fingerprints, as near copies have it, would be fetched by as many probes. Such values are split by
the remaining bits: whoever probes or holds one gets, for each bit, the key of the fingerprint with that bit
flipped, and its own. Two fingerprints within two bits always meet at such a key (one flips one of the differing bits, the
other the other), and a key never holds more than 65, however many near copies there are. Nothing is capped.

Components are found by alternating large-star and small-star steps over distinct fingerprints,
each step written to the shared folder.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other. A text of
fewer words than a shingle has one shingle, its whole word sequence. Repeated rows each get their
row. Rows without an id take part in links, but never name a component; where only such rows are
linked, component_id is null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SLICE_BYTES, slices

SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def _hashes(text: str | None, shingle: int) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [h(joined, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bits that over half of the hashes have; zero of none."""
    return int(_fingerprints(np.array(hashes, np.uint64), np.array([len(hashes)]))[0])


def _fingerprints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of n hashes each."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = np.concatenate([[0], np.cumsum(n)])[:-1][full]
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), at)
            out[full] |= (2 * ones.astype(np.int64) > n[full]).astype(np.uint64) << np.uint64(bit)
    return out


def _prints(batches, shingle: int):
    for batch in batches:
        for part in slices(batch, most=SLICE_BYTES // 2):
            h: list[int] = []
            n = []
            for text in part.column("text").to_pylist():
                own = _hashes(text, shingle)
                h += own
                n.append(len(own))
            print_ = _fingerprints(np.array(h, np.uint64), np.array(n, np.int64))
            # further columns, as a key of the text, go through as they are
            rest = [name for name in part.schema.names if name not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(print_.view(np.int64)), *map(part.column, rest)],
                ["doc_id", "fp", *rest],
            )


def _bits(masks) -> list[int]:
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _flipped(fp, masks):
    """The fingerprint, and itself with each of the masks' bits changed."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(m).cast("long")) for m in _bits(masks)])


def tables(prints: DataFrame, segments: int) -> DataFrame:
    """(segment, value, fp): a row for each segment; value has the segment's bits, the others are 0."""
    width = 64 // segments
    held = [
        F.struct(
            F.lit(s).alias("segment"),
            F.col("fp").bitwiseAND(F.lit(_bits([((1 << width) - 1) << (s * width)])[0]).cast("long")).alias("value"),
        ) for s in range(segments)
    ]
    return prints.select("fp", F.explode(F.array(*held)).alias("t")).select("t.segment", "t.value", "fp")


def probes(prints: DataFrame, segments: int, radius: int) -> DataFrame:
    """(segment, value, fp): the ball about each segment's value: itself and, at radius 1, each 0 bit set."""
    width = 64 // segments
    rows = tables(prints, segments)
    if not radius:
        return rows
    arrays = F.lit(None)
    for s in range(segments):
        masks = [F.lit(m).cast("long") for m in _bits([1 << (s * width + b) for b in range(width)])]
        flips = F.filter(F.array(*[F.when(F.col("value").bitwiseAND(m) == 0, F.col("value").bitwiseOR(m)) for m in masks]), lambda v: v.isNotNull())
        arrays = F.when(F.col("segment") == s, F.concat(F.array("value"), flips)).otherwise(arrays)
    return rows.select("segment", F.explode(arrays).alias("value"), "fp")


def links(prints: DataFrame, distance: int = 2, segments: int = 2, hot: int = 64) -> DataFrame:
    """Links (a, b), a < b, of all distinct fingerprints `fp` within the distance (at hot values, links that connect them)."""
    radius = distance // segments
    if distance not in (1, 2) or not 1 <= segments <= 8 or 64 % segments or radius > 1:
        raise ValueError("balls have radius 0 or 1, and hot values are split for distances up to 2")
    # few rows make many probes: they are dealt out first
    prints = common.written(prints.select("fp").repartition("fp"))
    held, asked = tables(prints, segments), probes(prints, segments, radius)
    many = common.written(held.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("segment", "value"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    on = ["segment", "value"]
    if not (split := not many.isEmpty()):
        few, all_ = held, asked
    else:
        few, all_ = held.join(many, on, "left_anti"), asked.join(many, on, "left_anti")
    met = all_.select(*on, F.col("fp").alias("a")).join(few.select(*on, F.col("fp").alias("b")), on).filter("a != b").filter(near("a", "b"))
    found = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if split:
        about = held.union(asked).join(many, on, "left_semi").select("fp").distinct()
        keyed = about.repartition("fp").select("fp", F.explode(_flipped(F.col("fp"), [1 << b for b in range(64)])).alias("key"))
        # a key has 65 fingerprints at most, so its list is bounded
        alike = keyed.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("all")).filter(F.size("all") > 1)
        if distance == 2:
            # all at a key are within two bits, so a star connects them
            pairs = alike.select(F.element_at("all", 1).alias("a"), F.explode(F.slice("all", 2, 65)).alias("b"))
        else:
            pairs = alike.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).filter("a < b")
        found = found.union(pairs.filter(near("a", "b")))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that node reaches; for nodes with an edge (a, b).

    Large-star and small-star in turn, until an alternation leaves the edges as they were.
    """
    edges = common.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # small star: each node's smaller neighbours (and itself) to the smallest of them
        large = common.written(large)
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(down, "b")
        small = joined.select(
            F.col("m").alias("a"),
            F.col("a").alias("b"),
        ).union(joined.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()
        previous, edges = edges, common.written(small)
        common.drop_written(large)
        common.drop_written(previous)
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def simhash_components(
    docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int = 2, hot: int = 64, id_col: str = "doc_id", text_col: str = "text", keep_key: bool = False
) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    With keep_key also root (one fingerprint of the component, which names it even where ids repeat) and h (a hash of the text).
    """
    texts = common.ids_and_texts(docs, id_col, text_col)
    kind, more = "doc_id long, fp long", []
    if keep_key:
        texts, kind, more = texts.withColumn("h", F.xxhash64("text")), kind + ", h long", ["root", "h"]
    prints = common.written(texts.mapInArrow(common.trimmed(lambda it: _prints(it, shingle)), kind))
    one = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = common.written(components(links(one, distance, segments, hot)))
    # a component's smallest doc_id
    named = one.join(found, one.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(linked, "root").select("fp", "component_id", *more[:1])
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *more)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None, **options) -> DataFrame:
    """Of each component, the row of smallest id (of such rows, that whose text has the smallest hash), once. Rows without an id stay.

    Rows that share an id but not a component are documents of their own. Components are those of simhash_components, or
    `found`: rows of doc_id, component_id, root and h.
    """
    found = common.written(simhash_components(docs, id_col=id_col, text_col=text_col, keep_key=True, **options) if found is None else found)
    kept = found.filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("row"), F.count("*").alias("n"))
    kept = common.written(kept.select(F.col("row.doc_id").alias("__id"), F.col("row.h").alias("__h"), "n"))
    # components whose representatives are alike in id and hash would be one text, so these keys are distinct
    own = F.col(id_col).cast("long")
    rows = docs.withColumn("__key", F.xxhash64(F.col(text_col).cast("string")))
    one = rows.join(kept.select("__id", "__h"), (own == F.col("__id")) & (F.col("__key") == F.col("__h")), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        one = one.dropDuplicates([id_col, "__key"])
    return one.union(rows.filter(own.isNull())).select(docs.columns)
