"""Media columns: chroma audio fingerprints, and alignment by offset histograms and bit errors.

A recording becomes frames of energy in the 12 pitch classes; an integral image over (frame, class)
gives the sum of any rectangle in four reads, so 16 rectangle-contrast filters are evaluated at
every frame; each is quantised to a two-bit Gray code, and 32 bits make one packed integer a frame.

Recordings with the same integers are one class, told by a digest and named by their smallest id.

Search. Keys are pairs of integers PROBE frames apart, where they differ from the frame before (held tones
would only repeat them). Classes that are asked for are dealt to blocks of about BLOCK keys, those of a group together. A class
that shares keys with a block goes there once a key, however many of the block have that key, and is met by all of them at one place:
its votes for each offset are counted there, and what leaves is a row for each pair and offset with `min_hits` votes or
more (or as many as a class has keys), not one for each vote. Such rows are verified: bit errors over the whole overlap of the
two sequences, and up to `max_ber` of them over `min_frames` or more is a match. Every match is listed, also among near copies,
which take as many rows as they have pairs with a class that is asked for.

Groups. All classes are grouped in rows that grow with their number, not with their pairs: a key (here of integers `span`
frames apart) that classes share elects one of them, its representative: the one whose digest has the smallest hash. Each
other class votes for its offset to that one, and what holds is a link. Where a class does not link to a key's representative,
the place goes on with keys of 2, then 4, then 8 in a row, so that what shares a key by chance parts and what is alike
meets again; nothing is capped. Those who reach one another through links are one group. A group says who
is alike through others; it is not what a query matches, and a match may lie outside of it.

Edge cases: null, empty and undecodable media, and files of no rate or an unknown sample width, have no frames and no integers; of
a file cut in mid-sample, whole samples count. Silence has frames without energy, whose integers are alike. Repeated rows
share a class. Rows that share an id but not the media are recordings of their own; a class without any id has a null
class_id. An empty table gives an empty result. Only id and media are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import components

FRAME, HOP, LONGEST = 512, 128, 16
#: (contrast, heights, widths): halves in pitch, halves in time, quarters crosswise, thirds in pitch, thirds in time.
SHAPES = (
    ("pitch2", (2, 4, 6, 12), (4, 8, 12, 16)),
    ("time2", (1, 2, 3, 4), (4, 8, 12, 16)),
    ("cross", (2, 4, 6, 8), (4, 8, 12, 16)),
    ("pitch3", (3, 6, 9, 12), (4, 8, 12, 16)),
    ("time3", (1, 2, 4, 6), (3, 6, 12, 15)),
)
LEVELS = (-0.7, 0.0, 0.7)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Frames between the two integers of a search key. Near copies at a bit error rate of 0.15 rarely agree over much longer stretches.
PROBE = 4
#: Keys of the classes that are asked for in a block of a search, parts in which other classes meet a block, votes counted at a time.
BLOCK, PARTS, VOTES = 1 << 19, 16, 1 << 20


def filters() -> list[tuple[str, int, int, int]]:
    """16 filters (contrast, lowest class, height, width), by rule."""
    out = []
    for k in range(16):
        kind, heights, widths = SHAPES[k % 5]
        h, w = heights[k // 5], widths[(k // 5 + k) % 4]
        out.append((kind, 5 * k % (12 - h + 1), h, w))
    return out


def decode_wav(data: bytes | None) -> tuple[int, np.ndarray]:
    """Rate and mono samples in -1..1 of a PCM WAV file of 8, 16, 24 or 32 bits; no samples if it is none."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, RuntimeError):
        return 1, np.zeros(0)
    if rate <= 0 or channels <= 0 or not 1 <= width <= 4:
        return 1, np.zeros(0)
    whole = np.frombuffer(raw, np.uint8)[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        x = (whole[:, 0].astype(float) - 128) / 128
    else:
        # little-endian samples in the high bytes of 32 bits
        wide = np.zeros((len(whole), 4), np.uint8)
        wide[:, 4 - width :] = whole
        x = wide.view("<i4")[:, 0] / 2.0**31
    return rate, x.reshape(-1, channels).mean(axis=1)


def encode_wav(rate: int, samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_FOLDS: dict[int, np.ndarray] = {}


def _fold(rate: int) -> np.ndarray:
    """Bins to pitch classes."""
    if rate not in _FOLDS:
        f = np.fft.rfftfreq(FRAME, 1 / rate)
        ok = (f >= 110) & (f <= 3520)
        fold = np.zeros((len(f), 12))
        fold[np.flatnonzero(ok), np.round(12 * np.log2(f[ok] / 440)).astype(int) % 12] = 1
        _FOLDS[rate] = fold
    return _FOLDS[rate]


def chroma(rate: int, samples: np.ndarray) -> np.ndarray:
    """Frames by pitch class, each of sum 1, or 0 without energy."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), 12))
    for a in range(0, len(frames), 4096):
        out[a : a + 4096] = (np.abs(np.fft.rfft(frames[a : a + 4096] * np.hanning(FRAME))) ** 2) @ _fold(rate)
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 0)


def packed(image: np.ndarray) -> np.ndarray:
    """A packed integer for each frame that has LONGEST frames from it on."""
    n = len(image) - LONGEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0, t1, y0, y1):
        return integral[t + t1, y1] - integral[t + t0, y1] - integral[t + t1, y0] + integral[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for k, (kind, y, h, w) in enumerate(filters()):
        whole = area(0, w, y, y + h)
        if kind == "pitch2":
            a = area(0, w, y, y + h // 2)
            b = whole - a
        elif kind == "time2":
            a = area(0, w // 2, y, y + h)
            b = whole - a
        elif kind == "cross":
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            b = whole - a
        elif kind == "pitch3":
            a = area(0, w, y + h // 3, y + 2 * h // 3)
            b = (whole - a) / 2
        else:
            a = area(w // 3, 2 * w // 3, y, y + h)
            b = (whole - a) / 2
        value = np.log((a + 0.01) / (b + 0.01))
        out |= GRAY[np.searchsorted(LEVELS, value)] << np.uint32(2 * k)
    return out


def fingerprints(media: DataFrame, id_col: str, media_col: str, decode: Callable = decode_wav) -> DataFrame:
    """Per row: id, digest of the integers, ints (array of 32-bit integers)."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                ints = [packed(chroma(*decode(x))).view(np.int32) for x in part.column("media").to_pylist()]
                digest = pa.array([hashlib.sha256(x.tobytes()).digest()[:16] for x in ints], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), digest, pa.array(ints, pa.list_(pa.int32()))], ["id", "digest", "ints"])

    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(common.trimmed(run), "id long, digest binary, ints array<int>")


def classes(prints: DataFrame) -> DataFrame:
    """One row per distinct sequence: digest, class_id (smallest id), ints."""
    return prints.groupBy("digest").agg(F.min("id").alias("class_id"), F.first("ints").alias("ints"))


def _keys(found: DataFrame, span: int) -> DataFrame:
    """(digest, k): for each class its keys in order, (key, pos), where a key differs from the one before."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                first = part.column("ints").offsets.to_numpy()
                x = part.column("ints").values.to_numpy()[first[0] : first[-1]].astype(np.int64)
                first = first - first[0]
                row = np.repeat(np.arange(len(part)), np.diff(first))
                at = np.arange(len(x))
                at = at[at + span < first[row + 1]]
                key, row = (x[at] << 32) ^ x[at + span], row[at]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                at, key, row = at[fresh], key[fresh], row[fresh]
                k = pa.StructArray.from_arrays([pa.array(key), pa.array(at - first[row], pa.int32())], ["key", "pos"])
                ends = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.ListArray.from_arrays(ends, k)], ["digest", "k"])

    rows = found.filter(F.size("ints") > span).select("digest", "ints")
    return rows.mapInArrow(common.trimmed(run), "digest binary, k array<struct<key:long,pos:int>>")


def _grams(keys: DataFrame, n: int) -> DataFrame:
    """(digest, key, pos): n keys in a row, at the place of the first."""
    starts = F.sequence(F.lit(0), F.size("k") - n)
    gram = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(F.col("k.key"), i + 1, n)).alias("key"), F.get("k", i)["pos"].alias("pos")))
    return keys.filter(F.size("k") >= n).select("digest", F.explode(gram).alias("g")).select("digest", "g.key", "g.pos")


def verified(votes: DataFrame, found: DataFrame, min_frames: int, max_ber: float) -> DataFrame:
    """Of votes (digest, rep, offset), those that hold over the whole overlap, the best of each pair: offset, frames, bit_errors, ber.

    offset: frames by which the class's start lies after the representative's.
    """
    a = found.select("digest", F.col("ints").alias("a"))
    b = found.select(F.col("digest").alias("rep"), F.col("ints").alias("b"))
    both = votes.join(a, "digest").join(b, "rep")
    early, late = F.least("offset", F.lit(0)), F.greatest("offset", F.lit(0))
    both = both.withColumn("frames", F.least(F.size("a") + early, F.size("b") - late)).filter(F.col("frames") >= min_frames)
    x, y = F.slice("a", 1 - early, F.col("frames")), F.slice("b", 1 + late, F.col("frames"))
    # bit_count widens a negative integer with 32 ones, so the low 32 bits are taken first
    differ = lambda u, v: F.bit_count(u.bitwiseXOR(v).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    errors = F.aggregate(F.zip_with(x, y, differ), F.lit(0), lambda s, n: s + n)
    scored = both.withColumn("bit_errors", errors).withColumn("ber", F.col("bit_errors") / (32.0 * F.col("frames"))).filter(F.col("ber") <= max_ber)
    return _best(scored)


def _best(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("digest", "rep").agg(F.min(F.struct("ber", F.negative("frames").alias("f"), "offset", "frames", "bit_errors")).alias("x"))
    return best.select("digest", "rep", "x.offset", "x.frames", "x.bit_errors", "x.ber")


def links(found: DataFrame, span: int = 16, min_hits: int = 2, min_frames: int = 32, max_ber: float = 0.15, grams=(1, 2, 4, 8)) -> DataFrame:
    """Links of classes (digest, ints) to representatives: digest, rep, offset, frames, bit_errors, ber."""
    keys, left, made = common.written(_keys(found, span)), None, []
    for n in grams:
        rows = _grams(keys, n)
        if left is not None:
            rows = rows.join(left, ["digest", "pos"], "left_semi")
        one = rows.groupBy("key").agg(
            F.min(F.struct(F.xxhash64("digest").alias("p"), "digest", "pos")).alias("one"),
            F.count("*").alias("n"),
        ).filter("n > 1")
        met = rows.join(one.select("key", F.col("one.digest").alias("rep"), F.col("one.pos").alias("at")), "key").filter("digest != rep")
        met = common.written(met.select("digest", "pos", "rep", (F.col("at") - F.col("pos")).alias("offset")))
        # n keys in a row are as many hits
        votes = met.groupBy("digest", "rep", "offset").agg((F.count("*") + (n - 1)).alias("hits")).filter(F.col("hits") >= min_hits)
        made.append(common.written(verified(votes, found, min_frames, max_ber)))
        left = common.written(met.join(made[-1].select("digest", "rep"), ["digest", "rep"], "left_anti").select("digest", "pos").distinct())
        common.drop_written(met)
        if left.isEmpty():
            break
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return _best(out)


def _flat(k: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and place of all keys of a column `k`."""
    row, x = np.repeat(np.arange(len(k)), np.diff(k.offsets.to_numpy())), k.flatten()
    return row, x.field("key").to_numpy(), x.field("pos").to_numpy().astype(np.int64)


def _joined(rows: list[pa.RecordBatch]) -> tuple:
    """Of rows (digest, need, k, asked): digests, the same as numpy names, need, asked, and the keys with their rows and places."""
    table = pa.Table.from_batches(rows).combine_chunks()
    digests = table.column("digest").chunk(0)
    need, asked = table.column("need").to_numpy(), table.column("asked").to_numpy()
    return digests, np.array(digests.to_pylist(), "S16"), need, asked, *_flat(table.column("k").chunk(0))


def _meetings(batches, votes: int):
    """Rows come in order of block and part, and there those asked for first, then the others' keys in order of digest."""
    place, own, index, held = None, [], None, []
    for batch in batches:
        block, part, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "query"))
        new = np.ones(len(batch), bool)
        new[1:] = (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])
        edges = [*np.flatnonzero(new), len(batch)]
        for a, b in zip(edges, edges[1:]):
            if place != (block[a], part[a]):
                yield from _votes(held, index, votes)
                place, own, index, held = (block[a], part[a]), [], None, []
            if query[a]:
                own.append(batch.slice(a, b - a))
                continue
            if index is None:
                index = _index(own)
            held.append(batch.slice(a, b - a))
            # the last class may go on in the next batch
            names = held[-1].column("digest")
            cut = len(names)
            while cut and names[cut - 1] == names[len(names) - 1]:
                cut -= 1
            if cut:
                yield from _votes([*held[:-1], held[-1].slice(0, cut)], index, votes)
                held = [held[-1].slice(cut)]
    yield from _votes(held, index, votes)


def _index(own: list[pa.RecordBatch]) -> tuple:
    digests, name, need, _, row, key, pos = _joined(own)
    order = np.argsort(key, kind="stable")
    return digests, name, need, row[order], key[order], pos[order]


def _counted(pair: np.ndarray, offset: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n for each pair and offset."""
    if not len(pair):
        return pair, offset, n
    order = np.lexsort((offset, pair))
    pair, offset, n = pair[order], offset[order], n[order]
    start = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (offset[1:] != offset[:-1])])
    return pair[start], offset[start], np.add.reduceat(n, start)


def _votes(rows: list[pa.RecordBatch], index: tuple | None, most: int):
    """All keys of some classes against a block: a row for each pair and offset that has the votes it needs."""
    if not rows or index is None:
        return
    digests, name, need, asked, row, key, pos = _joined(rows)
    their, their_name, their_need, their_row, their_key, their_pos = index
    # classes of the rows, which come in order
    number = np.cumsum(np.r_[False, name[1:] != name[:-1]])
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    low, high = np.searchsorted(their_key, key, "left"), np.searchsorted(their_key, key, "right")
    ends = np.cumsum(high - low)
    stops, a = [*first[1:], len(key)], 0
    while a < len(key):
        # classes of about `most` votes at a time, or one class in pieces of so many
        before = ends[a - 1] if a else 0
        stop = next((x for x in stops if x > a and (x == len(key) or ends[x - 1] - before >= most)), len(key))
        found = []
        while a < stop:
            before = ends[a - 1] if a else 0
            b = min(stop, max(a + 1, int(np.searchsorted(ends, before + most, "right"))))
            n = (high - low)[a:b]
            mine = np.repeat(np.arange(a, b), n)
            other = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
            q, c = their_row[other], row[mine]
            # two that are both asked for meet once
            keep = (their_name[q] != name[c]) & (~asked[c] | (name[c] < their_name[q]))
            pair, offset = (q * len(first) + number[c])[keep], (pos[mine] - their_pos[other])[keep]
            found.append(_counted(pair, offset, np.ones(len(pair), np.int64)))
            a = b
        pair, offset, hits = _counted(*(np.concatenate(x) for x in zip(*found)))
        q, c = pair // len(first), first[pair % len(first)]
        held = hits >= np.minimum(their_need[q], need[c])
        if held.any():
            columns = [their.take(pa.array(q[held])), digests.take(pa.array(c[held])), pa.array(offset[held], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "rep", "offset"])


def matches(found: DataFrame, asked: DataFrame, span: int = PROBE, min_hits: int = 2, min_frames: int = 32, max_ber: float = 0.15) -> DataFrame:
    """What each of the classes `asked` (digest, group_id) matches among all classes `found` (digest, ints): digest, rep, offset, frames, bit_errors, ber.

    rep is the class that is matched. Two that are both asked for make one row. Which rows there are does not depend on group_id,
    which only says whom to keep in one block.
    """
    keys = _keys(found, span).withColumn("need", F.least(F.size("k"), F.lit(min_hits)))
    own = common.written(_keys(found.join(asked, "digest", "left_semi"), span).join(asked, "digest"))
    own = own.withColumn("need", F.least(F.size("k"), F.lit(min_hits))).withColumn("group", F.xxhash64("group_id"))
    blocks = -(-(own.agg(F.sum(F.size("k"))).first()[0] or 1) // BLOCK)
    # a group of more keys than a block's has blocks of its own
    sizes = own.groupBy("group").agg(F.ceil(F.sum(F.size("k")) / BLOCK).alias("n"))
    block = F.when(F.col("n") > 1, F.xxhash64("group", F.pmod(F.xxhash64("digest"), "n"))).otherwise(F.pmod("group", F.lit(blocks)))
    own = own.join(sizes, "group").select("digest", "need", "k", block.alias("block"))
    wanted = own.select(F.explode("k.key").alias("key"), "block").distinct()
    marked = keys.join(asked.select("digest", F.lit(True).alias("asked")), "digest", "left")
    rows = marked.select("digest", "need", F.coalesce("asked", F.lit(False)).alias("asked"), F.explode("k").alias("x"))
    near = rows.withColumn("key", F.col("x.key")).join(wanted, "key").select(
        "block", F.pmod(F.xxhash64("digest"), F.lit(PARTS)).cast("int").alias("part"), F.lit(False).alias("query"),
        "digest", "need", "asked", F.array("x").alias("k"),
    )
    asking = own.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(True).alias("query"),
        "digest", "need", F.lit(True).alias("asked"), "k",
    )
    met = asking.union(near).repartition("block", "part").sortWithinPartitions("block", "part", F.desc("query"), "digest")
    most = VOTES
    votes = met.mapInArrow(common.trimmed(lambda batches: _meetings(batches, most)), "digest binary, rep binary, offset int")
    return verified(votes, found, min_frames, max_ber)


def search(
    media: DataFrame,
    id_col: str,
    media_col: str,
    decode: Callable = decode_wav,
    every: int = 20,
    span: int = 16,
    min_hits: int = 2,
    min_frames: int = 32,
    max_ber: float = 0.15,
) -> DataFrame:
    """Membership of all rows, and all matches of the rows whose id is divisible by `every`.

    Rows of kind `member`: id, the class_id of its class and the group_id of its group, its smallest class_id (both null if it has no
    integers). Rows of kind `match`: id is a class that has a row asked for, class_id one that it matches, and the alignment;
    group_id is that of id. A match of two classes that are both asked for is one row.
    """
    bounds = {"min_hits": min_hits, "min_frames": min_frames, "max_ber": max_ber}
    prints = common.written(fingerprints(media, id_col, media_col, decode))
    found = common.written(classes(prints.filter(F.size("ints") > 0)))
    edges = common.written(links(found.select("digest", "ints"), span=span, **bounds))
    roots = common.written(components(edges.select(F.col("digest").alias("a"), F.col("rep").alias("b"))))
    named = found.select("digest", "class_id").join(roots, F.col("digest") == F.col("node"), "left").select(
        "digest",
        "class_id",
        F.coalesce("root", "digest").alias("root"),
    )
    groups = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = common.written(named.join(groups, "root").select("digest", "class_id", "group_id"))
    null = lambda kind: F.lit(None).cast(kind)
    members = prints.select("id", "digest").join(named, "digest", "left")
    one = members.select(
        F.lit("member").alias("kind"), "id", "class_id", "group_id",
        null("int").alias("offset"), null("int").alias("frames"), null("int").alias("bit_errors"), null("double").alias("ber"),
    )
    asked = prints.filter(F.col("id") % every == 0).select("digest").distinct()
    asked = common.written(asked.join(named.select("digest", "group_id"), "digest"))
    theirs = named.select(F.col("digest").alias("rep"), F.col("class_id").alias("rep_id"))
    held = matches(found.select("digest", "ints"), asked, **bounds).join(named, "digest").join(theirs, "rep")
    return one.union(held.select(F.lit("match"), "class_id", "rep_id", "group_id", "offset", "frames", "bit_errors", "ber"))


RATE, NOTE = 2048, 512


def rendered(vector: list[float] | None) -> tuple[int, np.ndarray]:
    """A vector as a recording: two values in turn give a note of a quarter second, by their angle. Null values count as 0."""
    v = np.array([0.0 if x is None or not np.isfinite(x) else x for x in vector or ()], float)
    v = v[: len(v) // 2 * 2].reshape(-1, 2)
    if not len(v):
        return RATE, np.zeros(0)
    note = np.floor((np.arctan2(v[:, 1], v[:, 0]) / (2 * np.pi) + 0.5) * 12).astype(int) % 12
    return RATE, (_notes()[note]).ravel()


_NOTES: list[np.ndarray] = []


def _notes() -> np.ndarray:
    if not _NOTES:
        t = np.arange(NOTE) / RATE
        f = 220 * 2 ** (np.arange(12) / 12)
        _NOTES.append(0.6 * np.sin(2 * np.pi * f[:, None] * t) + 0.3 * np.sin(4 * np.pi * f[:, None] * t))
    return _NOTES[0]
