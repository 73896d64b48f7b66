"""SentencePiece encoding and decoding with seeded merge-dropout, for BPE models.

As in SentencePiece, a text that is not empty gets a space in front, spaces become U+2581, and the agenda merges the
two neighbours whose union is the best-scored piece (the leftmost of equals) until none is left.
Here each candidate merge (its start, middle and end in its chunk) is skipped for good if its keyed
hash is below `dropout`. The key is of the seed, the document, its copy number and the chunk's place
in it, so every occurrence of a word draws anew, and reruns and other machines give the same ones. At dropout 0 the pieces are SentencePiece's own.

No piece of a model spans a change to a space or certain characters, as line feeds (checked when
the model is read), so texts are cut into chunks there, and at dropout 0 each distinct chunk of a
slice is merged once. All chunks take their merges in step, on flat arrays. The model is broadcast: its size is its
vocabulary's, not the corpus's.

Decoding is exact: characters without a piece become byte pieces, and so does U+2581 itself, which
SentencePiece would give back as a space.

Edge cases: null texts have null ids and decode to null (round_trip gives them an empty list); empty ones have none. Length is not limited,
ids go from whole texts. Repeated rows are encoded alike, unless `copy_col` numbers them; rows without an id have one key. An
empty table gives an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SLICE_BYTES, Words, mixed, slices

SPACE_MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = np.int64(2**30)
#: Every chunk of a slice is merged on its own, so slices are smaller here, and their arrays stay in the cache.
PART_BYTES = SLICE_BYTES // 16


class Model:
    """A BPE model's pieces: merges by pair, first symbols by code point, bytes by id."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        ids = {pieces[i]: i for i in normal}
        scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
        ranks = {s: k for k, s in enumerate(scores)}
        self.size = size
        self.symbol = np.full(0x110001, -1, np.int32)
        for text, i in ids.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        pairs = {
            ids[p[:k]] * size + ids[p[k:]]: (
                ranks[sp.get_score(i)],
                i,
            ) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids
        }
        self._table(pairs)
        for p in ids:
            if len(p) > 1 and ("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK)):
                raise ValueError(f"piece {p!r} spans chunks")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        raw = [p.replace(SPACE_MARK, " ").encode() if p in ids else b"" for p in pieces]
        for b, i in enumerate(self.byte.tolist()):
            raw[i] = bytes([b])
        self.length = np.array([len(x) for x in raw], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _table(self, pairs: dict) -> None:
        """A hash table with a row for each place in a bucket; most pairs stand in the first."""
        keys = np.array(sorted(pairs), np.uint64)
        bits = max(10, int(len(keys)).bit_length() + 3)
        self.factor, self.shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
        bucket = (keys * self.factor) >> self.shift
        order = np.argsort(bucket, kind="stable")
        ordered = bucket[order]
        nth = np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
        self.keys = np.full((int(nth.max(initial=0)) + 1, 1 << bits), -1, np.int64)
        self.value = np.zeros(self.keys.shape, np.int64)
        values = np.array([pairs[k][0] << 32 | pairs[k][1] for k in keys.tolist()], np.int64)
        self.keys[nth, ordered] = keys[order].view(np.int64)
        self.value[nth, ordered] = values[order]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the union of neighbours; rank NONE where it is no piece."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -2)
        bucket = (key.view(np.uint64) * self.factor) >> self.shift
        found = self.keys[0][bucket] == key
        value = np.where(found, self.value[0][bucket], NONE << 32)
        rest = np.flatnonzero(~found)
        for keys, values in zip(self.keys[1:], self.value[1:], strict=True):
            place = bucket[rest]
            rest, place = rest[keys[place] != -1], place[keys[place] != -1]
            same = keys[place] == key[rest]
            value[rest[same]] = values[place[same]]
        return value >> 32, value & 0xFFFFFFFF


class _Chunks(Words):
    """Chunks in place of words: cut before spaces that follow something else, and about line feeds; each text that is not empty has a space in front."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        front = np.diff(self.off) > 0
        buf = np.full(len(self.buf) + int(front.sum()), 0x20, np.uint8)
        shift = np.cumsum(front)
        index = np.arange(len(self.buf)) + np.repeat(shift, np.diff(self.off))
        buf[index] = self.buf
        self.buf = buf
        self.off = self.off + np.r_[0, shift]
        space, feed = buf == 0x20, buf == 0x0A
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        cut[self.off] = True
        edges = np.flatnonzero(cut)
        self.start, self.end = edges[:-1], edges[1:]
        self.first = np.searchsorted(edges, self.off)
        self.n = np.diff(self.first)


def _spread(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices offset[i] .. offset[i] + length[i] - 1, for each i in turn."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offset - (ends - length), length)


def _segment(model: Model, codes: np.ndarray, n: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of chunks (n code points each, one after another), and their number by chunk. Negative symbols are -1 - code point."""
    sym = np.where(model.symbol[codes] >= 0, model.symbol[codes], -1 - codes.astype(np.int64))
    starts = np.cumsum(n) - n
    chunk = np.repeat(np.arange(len(n), dtype=np.int32), n)
    begin = (np.arange(len(codes)) - np.repeat(starts, n)).astype(np.int32)
    limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))

    def pairs(at, sym, chunk, begin, end):
        """Rank and union at each place with its right neighbour; skipped candidates have none."""
        inside = np.flatnonzero(at + 1 < len(sym))
        rank, union = np.full(len(at), NONE), np.zeros(len(at), np.int64)
        a = at[inside]
        inside = inside[chunk[a] == chunk[a + 1]]
        a = at[inside]
        rank[inside], union[inside] = model.lookup(sym[a], sym[a + 1])
        if dropout > 0:
            some = inside[rank[inside] < NONE]
            a = at[some]
            place = begin[a].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + begin[a + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + end[a + 1].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
            rank[some[mixed(key[chunk[a]] ^ mixed(place)) < limit]] = NONE
        return rank, union

    end = begin + 1
    rank, union = pairs(np.arange(len(sym)), sym, chunk, begin, end)
    done_sym, done_chunk = [], []
    while len(sym):
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), first)
        ended = (best >> 32) >= NONE
        if ended.any():
            out = np.repeat(ended, np.diff(np.r_[first, len(sym)]))
            done_sym.append(sym[out])
            done_chunk.append(chunk[out])
            shift = np.cumsum(out)
            best = best[~ended]
            at = (best & 0xFFFFFFFF) - shift[best & 0xFFFFFFFF]
            sym, chunk, begin, end, rank, union = (x[~out] for x in (sym, chunk, begin, end, rank, union))
        else:
            at = best & 0xFFFFFFFF
        if not len(sym):
            break
        sym[at], end[at] = union[at], end[at + 1]
        left = np.ones(len(sym), bool)
        left[at + 1] = False
        at = at - np.arange(len(at))  # places after the removals to their left
        sym, chunk, begin, end, rank, union = (x[left] for x in (sym, chunk, begin, end, rank, union))
        near = np.zeros(len(sym), bool)
        near[at] = near[np.maximum(at - 1, 0)] = True
        changed = np.flatnonzero(near)
        rank[changed], union[changed] = pairs(changed, sym, chunk, begin, end)
    all_chunk = np.concatenate(done_chunk) if done_chunk else np.zeros(0, np.int64)
    all_sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
    order = np.argsort(all_chunk, kind="stable")
    return all_sym[order], np.bincount(all_chunk, minlength=len(n))


def _to_ids(model: Model, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols: those without a piece become their bytes."""
    missing = np.flatnonzero(sym < 0)
    if not len(missing):
        return sym.astype(np.int32), count
    raw = {c: model.byte[list(chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in np.unique(sym[missing]).tolist()}
    width = np.ones(len(sym), np.int64)
    width[missing] = [len(raw[c]) for c in sym[missing].tolist()]
    ids = np.repeat(sym, width)
    at = np.cumsum(width) - width
    ids[_spread(at[missing], width[missing])] = np.concatenate([raw[c] for c in sym[missing].tolist()])
    total = np.concatenate([[0], np.cumsum(width)])
    ends = np.cumsum(count)
    return ids.astype(np.int32), total[ends] - total[ends - count]


def encode_arrow(model: Model, texts: pa.Array, variant: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and their number by text. Each chunk draws by its text's variant and by its place in it."""
    chunks = _Chunks(texts)
    if not len(chunks.start):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    h = chunks.hashes()
    if dropout <= 0:
        key = h
    else:
        own = mixed(variant.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))
        nth = (np.arange(len(h)) - np.repeat(chunks.first[:-1], chunks.n)).astype(np.uint64)
        key = mixed(h ^ mixed(np.repeat(own, chunks.n) + nth * np.uint64(0xC2B2AE3D27D4EB4F)))
    distinct, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    length = chunks.end[at] - chunks.start[at]
    raw = chunks.buf[_spread(chunks.start[at], length)]
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    ends = np.cumsum(length)
    mark = ord(SPACE_MARK)
    # a space is the model's mark; the mark itself has no symbol, so that it goes through its bytes
    codes = np.where(codes == 0x20, mark, np.where(codes == mark, -1, codes))
    sym, count = _segment_marked(model, codes, heads[ends] - heads[ends - length], distinct, dropout)
    ids, count = _to_ids(model, sym, count)
    offset = np.cumsum(count) - count
    each = count[inverse]
    out = ids[_spread(offset[inverse], each)]
    upto = np.concatenate([[0], np.cumsum(each)])
    return out, upto[chunks.first[1:]] - upto[chunks.first[:-1]]


def _segment_marked(model, codes, n, key, dropout):
    """_segment, where code -1 is the mark as a character of the text."""
    own = codes == -1
    sym, count = _segment(model, np.where(own, 0x110000, codes), n, key, dropout)
    return np.where(sym == -1 - 0x110000, -1 - ord(SPACE_MARK), sym) if own.any() else sym, count


def decode_ids(model: Model, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts one after another, and their number by text; the space in front is dropped."""
    width = model.length[ids]
    raw = model.bytes[_spread(model.offset[ids], width)]
    upto = np.concatenate([[0], np.cumsum(width)])
    ends = np.cumsum(n)
    first = upto[ends - n]
    size = upto[ends] - first
    front = (size > 0) & (raw[np.minimum(first, max(len(raw) - 1, 0))] == 0x20 if len(raw) else False)
    left = np.ones(len(raw), bool)
    left[first[front]] = False
    return raw[left], size - front


def _variants(part: pa.RecordBatch) -> np.ndarray:
    """A key for each row, of its id and copy number."""
    ids = np.array(part.column("doc_id").fill_null(0).to_pylist(), np.int64).view(np.uint64)
    key = np.where(np.array(part.column("doc_id").is_null().to_pylist(), bool), np.uint64(0), mixed(ids ^ np.uint64(0x9E3779B97F4A7C15)))
    return mixed(key + np.array(part.column("copy").to_pylist(), np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _numbered(docs: DataFrame, id_col: str, text_col: str, copy_col: str | None) -> DataFrame:
    """Ids, texts and copy numbers: those of copy_col, or 0."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        (F.col(copy_col).cast("int") if copy_col else F.lit(0)).alias("copy"),
    )


def _lists(ids: np.ndarray, n: np.ndarray, null: pa.Array) -> pa.Array:
    ends = np.cumsum(n)
    offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[np.array(null.to_pylist(), bool), False])
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def encode(
    docs: DataFrame,
    model_path: str = MODEL,
    dropout: float = 0.1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    copy_col: str | None = None,
) -> DataFrame:
    """Per row: doc_id, ids (null for a null text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model_path))

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                ids, n = encode_arrow(shared.value, part.column("text"), _variants(part), dropout, seed)
                null = part.column("text").is_null()
                n = np.where(np.array(null.to_pylist(), bool), 0, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids, n, null)], ["doc_id", "ids"])

    # a null text has no ids of its own: it is cut out as empty
    return _numbered(docs, id_col, text_col, copy_col).mapInArrow(common.trimmed(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Model(model_path))

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            n = np.array(lists.value_lengths().fill_null(0).to_pylist(), np.int64)
            raw, size = decode_ids(shared.value, np.array(lists.flatten().to_numpy(zero_copy_only=False), np.int64), n)
            ends, data = np.cumsum(size), raw.tobytes()
            texts = [data[e - s : e].decode("utf-8", "surrogatepass") for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string(), mask=np.array(lists.is_null().to_pylist(), bool))],
                ["doc_id", "text"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(common.trimmed(run), "doc_id long, text string")


def round_trip(
    docs: DataFrame,
    model_path: str = MODEL,
    dropout: float = 0.1,
    seed: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    copy_col: str | None = None,
) -> DataFrame:
    """Per row: doc_id, variant (the copy number), n_pieces, n_byte_pieces, ids_sha256 (of little-endian 32-bit ids), lossless, and ids if asked for.

    Encodes and decodes in one pass, and compares with the text byte by byte.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(model_path))

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                model, texts = shared.value, part.column("text")
                ids, n = encode_arrow(model, texts, _variants(part), dropout, seed)
                raw, size = decode_ids(model, ids, n)
                plain = Words(texts)
                same = size == np.diff(plain.off)
                if same.all():
                    wrong = np.concatenate([[0], np.cumsum(raw != plain.buf)])
                    same = wrong[plain.off[1:]] == wrong[plain.off[:-1]]
                isbyte = np.concatenate([[0], np.cumsum(np.isin(ids, model.byte))])
                ends = np.cumsum(n)
                data = ids.astype("<i4").tobytes()
                sha = [hashlib.sha256(data[4 * (e - k) : 4 * e]).hexdigest() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [
                    part.column("doc_id"),
                    part.column("copy"),
                    pa.array(n),
                    pa.array(isbyte[ends] - isbyte[ends - n]),
                    pa.array(sha),
                    pa.array(same),
                ]
                names = ["doc_id", "variant", "n_pieces", "n_byte_pieces", "ids_sha256", "lossless"]
                if with_ids:
                    columns, names = [*columns, _lists(ids, n, pa.array([False] * len(n)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, variant int, n_pieces long, n_byte_pieces long, ids_sha256 string, lossless boolean" + (
        ", ids array<int>" if with_ids else ""
    )
    return _numbered(docs, id_col, text_col, copy_col).mapInArrow(common.trimmed(run), schema)
