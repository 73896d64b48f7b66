"""Substring dedup: word sequences of a length or more that occur earlier are removed.

Method. Suffix automata of reference shards, with documents streamed against them for matching
statistics: a window of `min_words` words that ends where the statistic reaches `min_words` occurs in the
reference. One broadcast reference would have to grow with the corpus, and streaming every document past
every shard is quadratic, so shards are chosen by minimizer:

1. Minimizers. A window is represented by its smallest hash of `seed_words` consecutive words. Equal windows
   have equal minimizers, so only runs of windows whose minimizer occurs again can repeat. Runs of one
   minimizer in a slice of texts are one row of the shuffle that counts them, so a common line is no hot key.
2. Broadcast shards. For the `reference_passages` most frequent minimizers, the passage about the earliest
   occurrence, up to `passage_words` words of it. Windows in it contain that minimizer, so their earliest occurrence is there.
   `shard_words` words make a shard, one suffix automaton; a run streams through the shard of its own minimizer. The
   size is bounded by these parameters and does not grow with the corpus.
3. Dealt shards. The words of the other runs go by minimizer to a task, in order of documents. There the shard of a
   minimizer is the automaton of its runs so far: a run streams through it, loses the windows found, and is added if it has any
   others. A minimizer has fewer than `hot_count` runs here.
4. What the broadcast shards leave of frequent minimizers, as the varied surroundings of a common phrase, is dealt
   window by window, by the window's hash; equal ones of a slice are settled there. Its shard is that window.

Words are compared by 48 bits of their hashes, all `min_words` of a window, in every route.

Edge cases: null and empty texts have no words, and an empty table gives an empty result. Rows
without an id come last in the order. Rows with equal id and text are one document and get the same
answer; where an id has several texts, each is a document, and a hash of the text (`tie`, 0
elsewhere) orders and tells them apart. Exact copies of a text are settled by digest first: all words of the later
ones go, if there are `min_words` at least. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Words, covered, mixed, slices, windows

LAST = 2**63 - 1
#: Digests of copied texts are broadcast up to so many rows (of 24 bytes), and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


class SuffixAutomaton:
    """The suffix automaton of token sequences, each with a place; states know where they first ended.

    Sequences are separated by a fresh negative token, so that no match spans two of them.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.where = [-1], [0], [None]
        self.last, self.breaks = 0, 0

    def add(self, tokens, place, start: int) -> None:
        """Append a sequence found at word `start` of document `place`."""
        for i, token in enumerate(tokens):
            self._extend(token, (place, start + i + 1))
        self.breaks -= 1
        self._extend(self.breaks, None)

    def _state(self, following, link, length, where) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.where.append(where)
        return len(self.next) - 1

    def _extend(self, token: int, where) -> None:
        tip = self._state({}, 0, self.length[self.last] + 1, where)
        state = self.last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = tip
            state = self.link[state]
        if state >= 0:
            target = self.next[state][token]
            if self.length[target] == self.length[state] + 1:
                self.link[tip] = target
            else:
                split = self._state(dict(self.next[target]), self.link[target], self.length[state] + 1, self.where[target])
                while state >= 0 and self.next[state].get(token) == target:
                    self.next[state][token] = split
                    state = self.link[state]
                self.link[target] = self.link[tip] = split
        self.last = tip

    def matching(self, tokens, size: int):
        """For each token, the length (`size` at most) of the longest suffix up to it that occurs here, and where its first occurrence ends."""
        following, link, lengths, where = self.next, self.link, self.length, self.where
        state = held = 0
        for token in tokens:
            while state and token not in following[state]:
                state = link[state]
                held = lengths[state]
            target = following[state].get(token)
            if target is not None:
                state, held = target, held + 1
            while held > size and lengths[link[state]] >= size:
                state = link[state]
                held = lengths[state]
            held = min(held, size)
            yield held, where[state]

    def repeats(self, tokens, size: int):
        """For an empty automaton: the starts of the windows of a sequence that it has at an earlier start too."""
        state = held = 0
        for i, token in enumerate(tokens):
            self._extend(token, i)
            # the state of the last `size` tokens; a split may have moved them to a link
            state, held = self.next[state][token], min(held + 1, size)
            while self.length[self.link[state]] >= held:
                state = self.link[state]
            if held == size and self.where[state] < i:
                yield i - size + 1


def _minimizers(h: np.ndarray, seed: int, size: int):
    """Runs of windows with one minimizer: its hash, first window, number of windows, and whether it stands at several places of the run."""
    seeds = windows(h, seed)
    at = sliding_window_view(seeds, size - seed + 1).argmin(axis=1) + np.arange(len(h) - size + 1)
    best = seeds[at]
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    last = np.r_[first[1:], len(best)] - 1
    return best[first].view(np.int64), first, last - first + 1, at[first] != at[last]


def _runs(batches, seed: int, size: int):
    """A row for each minimizer of a slice: its first run, how many runs and whether any repeats in itself, and the other runs."""
    for batch in batches:
        for part in slices(batch):
            words, out = Words(part.column("text")), []
            h = words.hashes()
            docs, ties = part.column("doc_id").to_pylist(), part.column("tie").to_pylist()
            for doc, tie, a, b in zip(docs, ties, words.first[:-1], words.first[1:], strict=True):
                if b - a >= size:
                    key, first, n, again = _minimizers(h[a:b], seed, size)
                    out.append((np.full(len(key), doc, np.int64), np.full(len(key), tie, np.int64), key, first, n, again))
            if not out:
                continue
            doc, tie, key, first, n, again = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((first, tie, doc, key))
            doc, tie, key, first, n, again = doc[order], tie[order], key[order], first[order].astype(np.int32), n[order].astype(np.int32), again[order]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            times = np.diff(np.r_[start, len(key)])
            rest = np.ones(len(key), bool)
            rest[start] = False
            others = pa.StructArray.from_arrays([pa.array(x[rest]) for x in (doc, tie, first, n, again)], list(_RUN))
            ends = np.cumsum(times - 1)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), others, mask=pa.array(times == 1))
            inside = np.logical_or.reduceat(again, start)
            columns = [key, doc, tie, first, n, again]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[start]) for x in columns), pa.array(times), pa.array(inside), lists],
                ["key", *_RUN, "times", "inside", "others"],
            )


_RUN = ("doc_id", "tie", "first", "n", "again")
_RUN_TYPE = "doc_id long, tie long, first int, n int, again boolean"
#: How the windows of a run are settled: by the shard of its minimizer, dealt by window, or through a broadcast shard first.
RARE, COMMON, HOT = 0, 1, 2
TOKEN = 6


def _bytes(h: np.ndarray) -> np.ndarray:
    """The first TOKEN bytes of each hash, one row each."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :TOKEN]


def _tokens(raw: bytes) -> list[int]:
    some = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN)
    wide = np.zeros((len(some), 8), np.uint8)
    wide[:, :TOKEN] = some
    return wide.view(np.int64)[:, 0].tolist()


class _Dealt:
    """Rows for the dealt shards: (deal, doc_id, tie, first, again, words, gone)."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, deal, doc, tie, first, again, words, gone=()):
        self.rows.append((deal, doc, tie, first, again, words, gone))

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int32()))
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["deal", "doc_id", "tie", "first", "again", "words", "gone"],
        )


_DEALT = "deal long, doc_id long, tie long, first int, again boolean, words binary, gone array<int>"


def _dealt(batches, size: int, shared):
    """Candidate runs and windows for the dealt shards, and what the broadcast shards and the slice itself remove."""
    place, automata = shared.value if shared is not None else ({}, [])
    for batch in batches:
        for part in slices(batch):
            words, out = Words(part.column("text")), _Dealt()
            h = words.hashes()
            single: list[tuple] = []
            seen: set[tuple[int, int]] = set()
            for k, (doc, tie, a, b, runs) in enumerate(
                zip(
                    part.column("doc_id").to_pylist(),
                    part.column("tie").to_pylist(),
                    words.first[:-1],
                    words.first[1:],
                    part.column("runs").to_pylist(),
                    strict=True,
                )
            ):
                if (doc, tie) in seen:
                    # a repeated row of one document
                    continue
                seen.add((doc, tie))
                own, raw, gone, open_ = h[a:b], None, [], []
                for r in runs:
                    first, n = r["first"], r["n"]
                    if r["route"] == RARE:
                        raw = _bytes(own) if raw is None else raw
                        out.add(r["key"], doc, tie, first, r["again"], raw[first : first + n + size - 1].tobytes())
                        continue
                    left = range(first, first + n)
                    if r["route"] == HOT and r["key"] in place:
                        tokens, left = _tokens(_bytes(own[first : first + n + size - 1]).tobytes()), []
                        for i, (held, where) in enumerate(automata[place[r["key"]]].matching(tokens, size)):
                            at = first + i - size + 1
                            if at >= first:
                                if held < size:
                                    left.append(at)
                                elif where != ((doc, tie), at + size):
                                    gone.append(at)
                    open_ += left
                if open_:
                    single.append((k, doc, tie, own, np.array(open_)))
                if gone:
                    # what is settled meets nobody, so it is dealt by place
                    out.add(_spread(doc, tie), doc, tie, -1, False, b"", gone)
            _add_windows(single, size, out)
            if out.rows:
                yield out.batch()


def _spread(doc: int, tie: int) -> int:
    return int(mixed(np.array([(doc * 0x9E3779B97F4A7C15 + tie) % 2**64], np.uint64)).view(np.int64)[0])


def _add_windows(single, size: int, out: _Dealt) -> None:
    """Of equal windows of a slice, the earliest goes on; the others are gone."""
    if not single:
        return
    rows, content, hashes = [], [], []
    for k, (_, doc, tie, own, at) in enumerate(single):
        rows.append(np.column_stack([np.full(len(at), k), at]))
        content.append(sliding_window_view(_bytes(own), size, axis=0)[at].transpose(0, 2, 1).reshape(len(at), -1))
        hashes.append(windows(own, size)[at].view(np.int64))
    rows, hashes = np.concatenate(rows), np.concatenate(hashes)
    content = np.ascontiguousarray(np.concatenate(content)).view(f"V{size * TOKEN}")[:, 0]
    doc, tie = (np.array([x[i] for x in single])[rows[:, 0]] for i in (1, 2))
    order = np.lexsort((rows[:, 1], tie, doc))
    _, one, which = np.unique(content[order], return_index=True, return_inverse=True)
    earliest = np.zeros(len(order), bool)
    earliest[order[one]] = True
    lost: dict[int, list[int]] = {}
    for k in np.flatnonzero(~earliest).tolist():
        lost.setdefault(int(rows[k, 0]), []).append(int(rows[k, 1]))
    for k, starts in lost.items():
        out.add(_spread(single[k][1], single[k][2]), single[k][1], single[k][2], -1, False, b"", starts)
    for k in np.flatnonzero(earliest).tolist():
        out.add(int(hashes[k]), int(doc[k]), int(tie[k]), int(rows[k, 1]), False, content[k].tobytes())


def _judged(batches, size: int):
    """Rows in order of (deal, doc_id, tie, first); a deal may span batches. Emits the starts of windows that occur earlier."""
    deal, shard, waiting, last = None, None, None, None
    for batch in batches:
        out: list[tuple] = []
        for now, doc, tie, first, again, raw, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first < 0:
                out.append((doc, tie, gone))
                continue
            if now != deal:
                deal, shard, waiting = now, None, None
            elif (doc, tie, first) == last:
                # a repeated row of one document
                continue
            last = (doc, tie, first)
            tokens, found = _tokens(raw), set()
            if waiting is not None:
                shard = shard or SuffixAutomaton()
                shard.add(waiting, None, 0)
                waiting = None
            if shard is not None:
                found = {first + i - size + 1 for i, (held, _) in enumerate(shard.matching(tokens, size)) if held >= size}
            if again:
                found.update(first + i for i in SuffixAutomaton().repeats(tokens, size))
            # the last run of a deal is never added
            if len(found) < len(tokens) - size + 1 or (again and shard is None):
                waiting = tokens
            if found:
                out.append((doc, tie, list(found)))
        columns = zip(*out, strict=True) if out else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)],
            ["doc_id", "tie", "starts"],
        )


def _passages(batches, size: int):
    """The words about the hot runs that are asked for, as tokens."""
    for batch in batches:
        rows: list[tuple] = []
        words = Words(batch.column("text"))
        h = words.hashes()
        for doc, tie, a, b, runs in zip(
            batch.column("doc_id").to_pylist(),
            batch.column("tie").to_pylist(),
            words.first[:-1],
            words.first[1:],
            batch.column("runs").to_pylist(),
            strict=True,
        ):
            rows += [(doc, tie, r["first"], r["key"], _tokens(_bytes(h[a:b][r["first"] : r["first"] + r["n"] + size - 1]).tobytes())) for r in runs]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "tie", "first", "key", "words"])


def _kept(batches, size: int):
    for batch in batches:
        for part in slices(batch):
            words, rows = Words(part.column("text")), []
            for k, (doc, a, b, copy, starts) in enumerate(
                zip(
                    part.column("doc_id").to_pylist(),
                    words.first[:-1],
                    words.first[1:],
                    part.column("copy").to_pylist(),
                    part.column("starts"),
                    strict=True,
                )
            ):
                n = int(b - a)
                if copy:
                    gone = np.full(n, n >= size)
                else:
                    gone = covered(np.asarray(starts.values if starts.is_valid else [], np.int64), size, n)
                text = words.buf[words.off[k] : words.off[k + 1]].tobytes().split()
                kept = b" ".join(text if not gone.any() else [x for x, g in zip(text, gone.tolist(), strict=True) if not g])
                rows.append((doc, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            if rows:
                doc, n, gone, sha, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(text)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, tie and copy (a row with a smaller id has the same text)."""
    texts = common.ids_and_texts(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    texts = texts.withColumn("digest", F.unhex(F.md5("text")))
    # only ids that have several texts need more than the id to tell documents apart
    shared = texts.select("doc_id", F.xxhash64("text").alias("x")).groupBy("doc_id").agg((F.min("x") < F.max("x")).alias("many")).filter("many")
    texts = texts.join(common.written(shared), "doc_id", "left")
    texts = texts.select("doc_id", "text", "digest", F.when(F.col("many"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("tie"))
    copies = common.written(
        texts.groupBy("digest").agg(F.min("doc_id").alias("one"), F.count("*").alias("n")).filter("n > 1").select("digest", "one")
    )
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    copy = F.coalesce(F.col("one") < F.col("doc_id"), F.lit(False)).alias("copy")
    return texts.join(copies, "digest", "left").select("doc_id", "tie", "text", copy)


def _repeated_runs(single: DataFrame, seed: int, size: int) -> DataFrame:
    """Runs whose minimizer occurs again: key, times, whether the run is the earliest of its key, and the run."""
    rows = single.mapInArrow(
        common.trimmed(lambda it: _runs(it, seed, size)),
        f"key long, {_RUN_TYPE}, times long, inside boolean, others array<struct<{_RUN_TYPE}>>",
    )
    key = Window.partitionBy("key")
    place = F.struct("doc_id", "tie", "first")
    rows = rows.withColumns({"times": F.sum("times").over(key), "inside": F.max("inside").over(key), "earliest": place == F.min(place).over(key)})
    rows = rows.filter((F.col("times") > 1) | F.col("inside"))
    mine = F.array(F.struct(*_RUN, F.col("earliest")))
    rest = F.transform(
        F.coalesce("others", F.array().cast(f"array<struct<{_RUN_TYPE}>>")),
        lambda r: F.struct(*[r[c].alias(c) for c in _RUN], F.lit(False).alias("earliest")),
    )
    return rows.select("key", "times", F.explode(F.concat(mine, rest)).alias("r")).select("key", "times", "r.*")


def substring_dedup(
    docs: DataFrame, min_words: int = 20, seed_words: int = 7, reference_passages: int = 2048, hot_count: int = 64,
    passage_words: int = 256, shard_words: int = 50_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and kept_text (the words kept, joined by spaces)."""
    spark = docs.sparkSession
    size, seed = min_words, min(seed_words, min_words)
    marked = _identified(docs, id_col, text_col)
    single = marked.filter("not copy").select("doc_id", "tie", "text")
    runs = common.written(_repeated_runs(single, seed, size))
    common.release(spark)

    frequent = F.col("times") >= hot_count
    hottest = runs.filter(frequent & F.col("earliest")).dropDuplicates(["key"]).select("doc_id", "tie", "first", "n", "key", "times")
    hottest = common.written(hottest.orderBy(F.desc("times"), "key").limit(reference_passages))
    shared = None
    if not hottest.isEmpty():
        passage = F.struct("first", F.least("n", F.lit(max(1, passage_words - size + 1))).alias("n"), "key")
        wanted = hottest.groupBy("doc_id", "tie").agg(F.collect_list(passage).alias("runs"))
        found = single.join(F.broadcast(wanted), ["doc_id", "tie"])
        found = found.mapInArrow(common.trimmed(lambda it: _passages(it, size)), "doc_id long, tie long, first int, key long, words array<long>")
        # reference_passages rows of at most passage_words words
        shared = spark.sparkContext.broadcast(_automata(found.collect(), shard_words))
    hot = F.broadcast(hottest.select("key", F.lit(True).alias("hot")))
    route = F.when(F.col("hot"), HOT).when(frequent, COMMON).otherwise(RARE).alias("route")
    wanted = runs.join(hot, "key", "left").groupBy("doc_id", "tie").agg(F.collect_set(F.struct("first", "n", "again", "key", route)).alias("runs"))
    wanted = common.written(wanted)
    common.drop_written(runs)
    dealt = single.join(wanted, ["doc_id", "tie"]).mapInArrow(common.trimmed(lambda it: _dealt(it, size, shared)), _DEALT)
    dealt = dealt.repartition("deal").sortWithinPartitions("deal", "doc_id", "tie", "first")
    found = dealt.mapInArrow(common.trimmed(lambda it: _judged(it, size)), "doc_id long, tie long, starts array<int>")
    gone = common.written(found.groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    common.drop_written(wanted)
    common.release(spark)
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    out = marked.join(gone, ["doc_id", "tie"], "left").select("doc_id", "text", "copy", "starts").mapInArrow(
        common.trimmed(lambda it: _kept(it, size)),
        kinds,
    )
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def _automata(rows, shard_words: int) -> tuple[dict[int, int], list[SuffixAutomaton]]:
    """The shard of each minimizer, and the shards: automata of about shard_words words of passages."""
    place, made, held = {}, [SuffixAutomaton()], 0
    for doc, tie, first, key, words in sorted((r.doc_id, r.tie, r.first, r.key, tuple(r.words)) for r in rows):
        if key in place:
            continue
        if held and held + len(words) > shard_words:
            made.append(SuffixAutomaton())
            held = 0
        made[-1].add(words, (doc, tie), first)
        place[key] = len(made) - 1
        held += len(words)
    return place, made
