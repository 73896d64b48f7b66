"""Language of words and texts by a linear-chain conditional random field.

Words are labelled jointly: a word's scores come from its affixes (1 to 4 bytes from either end),
byte bigrams and trigrams, and a lexicon of frequent words of each language; transition weights between
neighbours are learned with them. Forward-backward gives each word's marginals. A text's language
is the label of the largest summed marginals over words with letters; the score is its share.

Learning. Training texts carry one label each, so sequences for training are spliced from stretches
of different texts, as in code-switched text; labels and transitions are then both observed. The
sample is bounded by `sample_rows` rows, of smallest hash and an equal part for each language (at least one row; with more languages
than rows, the most frequent ones have a row). Of a sampled row it takes a stretch of `sample_words` words from a hashed place.
Prediction is over whole texts, of any length, and uses nothing but the text.

Work per slice of texts: distinct words are scored once, and forward-backward steps through all
texts of the slice together, longest first, so its cost follows the words.

Edge cases: a null text or one without a letter is `und` with score 0. Without any training row all
texts are `und`. Ties go to the label that comes first by code point. Repeated rows each get their
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import Words, mixed, slices

#: Weights are a table of 2**BITS buckets a label, and of 2**TABLE_BITS numbers at most over all labels.
BITS, TABLE_BITS = 17, 24
AFFIXES = (1, 2, 3, 4)
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class _Features:
    """Buckets of the features of distinct words, given as spans of a byte array."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, lexicon: np.ndarray, bits: int = BITS):
        self.bits = bits
        # signs at the ends, however many, are no part of a word here: from its first letter to its last
        letters = np.flatnonzero(_LETTER[buf])
        first, last = np.searchsorted(letters, start), np.searchsorted(letters, end) - 1
        some = first <= last
        start = np.where(some, letters[np.minimum(first, len(letters) - 1)], start) if len(letters) else start
        end = np.where(some, letters[last] + 1, start) if len(letters) else start
        size = end - start
        self.lettered = size > 0
        at = _spread(start, size)
        raw = buf[at].astype(np.uint64)
        self.raw = raw
        ends = np.cumsum(size)
        starts = ends - size
        word = np.repeat(np.arange(len(size)), size)
        # n-grams with a boundary mark at either end
        left = np.full(len(raw), 257, np.uint64)
        left[1:] = raw[:-1]
        left[starts[size > 0]] = 257
        right = np.full(len(raw), 258, np.uint64)
        right[:-1] = raw[1:]
        right[ends[size > 0] - 1] = 258
        grams = [self._bucket(raw * np.uint64(512) + right, 1), self._bucket((left * np.uint64(512) + raw) * np.uint64(512) + right, 2)]
        self.word = np.concatenate([word, word])
        self.bucket = np.concatenate(grams)
        prefix, suffix = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        for k in AFFIXES:
            some = np.flatnonzero(size >= k)
            prefix[some] = prefix[some] * np.uint64(257) + raw[starts[some] + k - 1]
            suffix[some] = suffix[some] * np.uint64(257) + raw[ends[some] - k]
            self._add(some, self._bucket(prefix[some], 2 + k))
            self._add(some, self._bucket(suffix[some], 6 + k))
        self.whole = whole = common.span_hashes(buf, start, end)
        if len(lexicon):
            near = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
            known = np.flatnonzero((lexicon[near] == whole) & self.lettered)
            self._add(known, self._bucket(whole[known], 11))

    def _bucket(self, value: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(value ^ (np.uint64(kind) << np.uint64(56))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _add(self, word: np.ndarray, bucket: np.ndarray) -> None:
        self.word = np.concatenate([self.word, word])
        self.bucket = np.concatenate([self.bucket, bucket])

    def scores(self, weights: np.ndarray, n: int) -> np.ndarray:
        return np.column_stack([np.bincount(self.word, weights[:, k][self.bucket], n) for k in range(weights.shape[1])])


def _spread(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offset - (ends - length), length)


def forward_backward(emit: np.ndarray, first: np.ndarray, n: np.ndarray, step: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Marginals of all words; emit is exp(score) a word, step exp(transition weight), sequences run from first for n words.

    With pairs, also the summed marginals of neighbouring labels.
    """
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(longest), side="left")  # sequences longer than t
    alpha = np.empty_like(emit)
    held = None
    for t in range(longest):
        k = active[t]
        at = first[:k] + t
        held = (begin if t == 0 else held[:k] @ step) * emit[at]
        held /= held.sum(axis=1, keepdims=True)
        alpha[at] = held
    out, total = alpha, np.zeros_like(step)
    beta = np.ones((0, emit.shape[1]), emit.dtype)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        if len(beta) < k:
            beta = np.concatenate([beta, np.ones((k - len(beta), emit.shape[1]), emit.dtype)])
        at = first[:k] + t
        own = alpha[at] * beta
        if pairs and t:
            before = alpha[at - 1]
            joint = before[:, :, None] * step[None] * (emit[at] * beta)[:, None, :]
            total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta = (emit[at] * beta) @ step.T
        beta /= beta.sum(axis=1, keepdims=True)
        out[at] = own / own.sum(axis=1, keepdims=True)
    return (out, total) if pairs else out


class Crf:
    """Weights by bucket and label, transitions, and the lexicon's word hashes."""

    def __init__(self, labels: list[str], weights: np.ndarray, step: np.ndarray, begin: np.ndarray, lexicon: np.ndarray):
        self.labels, self.weights, self.step, self.begin, self.lexicon = labels, weights, step, begin, lexicon

    def marginals(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each word, and whether it has letters."""
        if not len(words.start):
            return np.zeros((0, len(self.labels)), np.float32), np.zeros(0, bool)
        _, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        found = _Features(words.buf, words.start[at], words.end[at], self.lexicon, (len(self.weights) - 1).bit_length())
        score = found.scores(self.weights, len(at))
        emit = np.exp(np.clip(score - score.max(axis=1, keepdims=True), -20, 0)).astype(np.float32)
        some = words.n > 0
        step, begin = np.exp(self.step).astype(np.float32), np.exp(self.begin).astype(np.float32)
        return forward_backward(emit[inverse], words.first[:-1][some], words.n[some], step, begin), found.lettered[inverse]


def train(
    texts: list[tuple[str, str]],
    length: int = 96,
    epochs: int = 4,
    batch: int = 48,
    rate: float = 0.3,
    lexicon_size: int = 300,
    seed: int = 0,
) -> Crf | None:
    """A field from (label, text) rows, by AdaGrad on the likelihood of spliced sequences."""
    labels = sorted({label for label, _ in texts})
    if not labels:
        return None
    r = np.random.default_rng(seed)
    words = Words(pa.array([t for _, t in texts]), lower=True)
    label = np.array([labels.index(x) for x, _ in texts])
    n_labels = len(labels)
    bits = max(8, min(BITS, TABLE_BITS - (n_labels - 1).bit_length()))
    buckets = 1 << bits
    bare = _Features(words.buf, words.start, words.end, np.zeros(0, np.uint64), bits)
    own = np.repeat(label, words.n)
    frequent = []
    for k in range(n_labels):
        value, count = np.unique(bare.whole[(own == k) & bare.lettered], return_counts=True)
        frequent.append(value[np.argsort(-count, kind="stable")[:lexicon_size]])
    lexicon = np.unique(np.concatenate(frequent))
    found = _Features(words.buf, words.start, words.end, lexicon, bits)
    order = np.argsort(found.word, kind="stable")
    bucket, count = found.bucket[order], np.bincount(found.word, minlength=len(own))
    offset = np.cumsum(count) - count
    weights, squares = np.zeros((buckets, n_labels)), np.full((buckets, n_labels), 1e-6)
    step, step_squares = np.zeros((n_labels, n_labels)), np.full((n_labels, n_labels), 1e-6)
    begin, begin_squares = np.zeros(n_labels), np.full(n_labels, 1e-6)
    by_label = [np.flatnonzero((label == k) & (words.n > 0)) for k in range(n_labels)]
    rows = max(1, int(len(own) / length))
    for _ in range(epochs):
        for _ in range(max(1, rows // batch)):
            sequences = [_spliced(r, by_label, words, length) for _ in range(batch)]
            at, y = np.concatenate([s[0] for s in sequences]), np.concatenate([s[1] for s in sequences])
            index, each = bucket[_spread(offset[at], count[at])], np.repeat(np.arange(len(at)), count[at])
            score = np.column_stack([np.bincount(each, weights[:, k][index], len(at)) for k in range(n_labels)])
            emit = np.exp(score - score.max(axis=1, keepdims=True))
            first = np.arange(batch) * length
            p, pair = forward_backward(emit, first, np.full(batch, length), np.exp(step), np.exp(begin), pairs=True)
            p[np.arange(len(y)), y] -= 1
            for k in range(n_labels):
                g = np.bincount(index, p[each, k], buckets) / batch
                some = np.flatnonzero(g)
                squares[some, k] += g[some] ** 2
                weights[some, k] -= rate * g[some] / np.sqrt(squares[some, k])
            seen = np.zeros_like(step)
            inner = np.ones(len(y), bool)
            inner[first] = False
            np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            for value, square, g in ((step, step_squares, (pair - seen) / batch), (begin, begin_squares, p[first].sum(axis=0) / batch)):
                square += g**2
                value -= rate * g / np.sqrt(square)
    return Crf(labels, weights.astype(np.float32), step, begin, lexicon)


def _spliced(r, by_label, words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices and labels of one sequence of stretches of texts."""
    at, y, held = [], [], 0
    while held < length:
        k = int(r.integers(len(by_label)))
        if not len(by_label[k]):
            k = next(j for j, x in enumerate(by_label) if len(x))
        doc = int(r.choice(by_label[k]))
        n = min(int(r.geometric(0.05)), length - held, int(words.n[doc]))
        start = words.first[doc] + int(r.integers(words.n[doc] - n + 1))
        at.append(np.arange(start, start + n))
        y.append(np.full(n, k))
        held += n
    return np.concatenate(at), np.concatenate(y)


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = 4000, sample_words: int = 100, seed: int = 0, **options) -> Crf | None:
    """Learns from text and lang of rows that are not held out."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    )
    rows = rows.filter("text is not null and lang is not null").filter(~held_out())
    # every language gets an equal part of the bound, so that a rare one is learned too
    names = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()
    if not names:
        return None
    each = max(1, sample_rows // len(names))

    def stretch(batches):
        for batch in batches:
            out = []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                start = h % max(1, len(words) - sample_words + 1)
                out.append(b" ".join(words[start : start + sample_words]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(out, pa.string())], ["lang", "h", "text"])

    # each row by the hash of its id and text, at a rate that expects twice a language's part, and five rows more
    scale = 1 << 40
    rate = F.create_map(*[x for r in names for x in (F.lit(r.lang), F.lit(min(scale, scale * (2 * each + 5) // r.n)))])
    hashed = rows.withColumn(
        "h",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(scale)),
    ).filter(F.col("h") < F.element_at(rate, F.col("lang")))
    got = hashed.select("lang", "h", "text").mapInArrow(common.trimmed(stretch), "lang string, h long, text string")
    # of each language the rows of smallest hash; the bound on all of them holds whatever the hashes are
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = got.withColumn("nth", nth).filter(F.col("nth") <= each).orderBy("nth", "lang").limit(sample_rows).collect()
    return train([(r.lang, r.text) for r in sorted(chosen, key=lambda r: (r.h, r.lang, r.text))], seed=seed, **options)


def predict(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=2 * common.SLICE_BYTES):
                names, score = [UNKNOWN] * len(part), np.zeros(len(part))
                field = shared.value
                if field is not None:
                    words = Words(part.column("text"), lower=True)
                    p, lettered = field.marginals(words)
                    p[~lettered] = 0
                    doc = np.repeat(np.arange(len(part)), words.n)
                    sums = np.column_stack([np.bincount(doc, p[:, k], len(part)) for k in range(len(field.labels))])
                    total = sums.sum(axis=1)
                    best = sums.argmax(axis=1)
                    texts = part.column("text")
                    for k in np.flatnonzero(total > 0).tolist():
                        raw = words.buf[words.off[k] : words.off[k + 1]]
                        if ((raw >= 97) & (raw <= 122)).any() or any(map(str.isalpha, texts[k].as_py())):
                            names[k], score[k] = field.labels[best[k]], min(1.0, sums[k, best[k]] / total[k])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"],
                )

    return common.ids_and_texts(docs, id_col, text_col).mapInArrow(common.trimmed(run), "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and the runs of words of one language: (lang, first word, number of words, mean marginal)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=2 * common.SLICE_BYTES):
                words = Words(part.column("text"), lower=True)
                p, _ = shared.value.marginals(words)
                best, top, out = p.argmax(axis=1), p.max(axis=1), []
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    cuts = np.flatnonzero(np.r_[True, best[a + 1 : b] != best[a : b - 1]]) if b > a else []
                    ends = [*cuts[1:], b - a] if b > a else []
                    out.append(
                        [
                            {
                                "lang": shared.value.labels[best[a + s]],
                                "first": int(s),
                                "n": int(e - s),
                                "p": float(top[a + s : a + e].mean()),
                            } for s, e in zip(cuts, ends, strict=True)
                        ]
                    )
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("n", pa.int32()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "runs"])

    return common.ids_and_texts(docs, id_col, text_col).mapInArrow(
        common.trimmed(run),
        "doc_id long, runs array<struct<lang: string, first: int, n: int, p: double>>",
    )


def identified(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    return predict(docs, fit(docs, **options)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
