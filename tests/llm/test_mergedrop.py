"""Merge-dropout against the library at dropout 0, against a plain agenda, and as an exact round trip."""

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, documents

from quantloom.llm import mergedrop as M
from quantloom.llm.common import mixed

TEXTS = [
    "",
    "  a  b   c\n\n d",
    "x▁y ▁",
    "日本語 テスト 😀\tß",
    "    ",
    " lead",
    "trail ",
    None,
    "a" * 60,
    "\n",
    "\U0010ffff end",
    "The quick brown fox jumps over it.",
]


@pytest.fixture(scope="module")
def model():
    return M.Model()


def ids_of(model, texts, dropout, seed=0, variant=0):
    ids, n = M.encode_arrow(model, pa.array(texts, pa.string()), np.full(len(texts), variant), dropout, seed)
    ends = np.cumsum(n)
    return [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]


def test_no_dropout_is_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=M.MODEL)
    texts = [r[1] for r in documents()] + TEXTS
    for text, got in zip(texts, ids_of(model, texts, 0.0), strict=True):
        if "▁" not in (text or ""):
            assert got == sp.encode(text or "")


def agenda(model, chunk, key, dropout):
    """One chunk by a plain priority queue."""
    codes = [ord(c) for c in chunk]
    sym = {i: int(model.symbol[ord(M.SPACE_MARK) if c == 32 else c]) if c != ord(M.SPACE_MARK) else -1 for i, c in enumerate(codes)}
    end = {i: i + 1 for i in sym}
    queue = []

    def push(a):
        b = end[a]
        if b in sym and sym[a] >= 0 and sym[b] >= 0:
            rank, union = (int(x[0]) for x in model.lookup(np.array([sym[a]]), np.array([sym[b]])))
            if rank < M.NONE:
                place = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + end[b] * 0x165667B19E3779F9) % 2**64
                h = int(mixed(np.array([key], np.uint64) ^ mixed(np.array([place], np.uint64)))[0])
                if h >= int(dropout * 2**64):
                    heapq.heappush(queue, (rank, a, b, end[b], union))

    for a in list(sym):
        push(a)
    while queue:
        _, a, b, e, union = heapq.heappop(queue)
        if end.get(a) == b and end.get(b) == e:
            sym[a], end[a] = union, e
            del sym[b], end[b]
            push(a)
            before = next((x for x in sym if end[x] == a), None)
            if before is not None:
                push(before)
    return [sym[a] for a in sorted(sym)]


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_dropout_is_the_agenda(model, dropout):
    chunks = [" introduction", " aaaaaaaa", "    word", " Überraschung", "internationalization"]
    key = mixed(np.arange(len(chunks), dtype=np.uint64) + np.uint64(9))
    codes = np.concatenate([[ord(c) if c != " " else ord(M.SPACE_MARK) for c in x] for x in chunks])
    sym, n = M._segment(model, codes, np.array([len(x) for x in chunks]), key, dropout)
    ends = np.cumsum(n)
    for k, chunk in enumerate(chunks):
        assert sym[ends[k] - n[k] : ends[k]].tolist() == agenda(model, chunk, int(key[k]), dropout)


def test_segmentations_vary_and_decode(model):
    text = "International cooperation on measurement standards " * 3
    seen = {tuple(ids_of(model, [text], 0.3, seed)[0]) for seed in range(8)}
    assert len(seen) == 8
    assert ids_of(model, [text], 0.3, 1, 0) != ids_of(model, [text], 0.3, 1, 1)
    for ids in seen:
        raw, _ = M.decode_ids(model, np.array(ids), np.array([len(ids)]))
        assert raw.tobytes().decode() == text


def test_operators(spark, model):
    rows = documents() + [(500 + i, t, None, None, None, 1, "x", 2) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA)
    encoded = M.encode(docs, dropout=0.2, seed=3)
    back = M.decode(encoded)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, back.collect()), key=key) == sorted(((r[0], r[1]) for r in rows), key=key)
    digests = M.round_trip(docs, dropout=0.2, seed=3, with_ids=True).collect()
    assert len(digests) == len(rows) and all(r.lossless for r in digests)
    for r in digests:
        assert r.n_pieces == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()
    assert M.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_occurrence_document_and_copy_draws_anew(spark, model):
    ids = ids_of(model, [" ".join(["International"] * 400)], 0.1)[0]
    pieces = [model.bytes[model.offset[i] : model.offset[i] + model.length[i]].tobytes() for i in ids]
    seen, word = set(), []
    for p in [*pieces, b" "]:
        if p.startswith(b" ") and word:
            seen.add(tuple(word))
            word = []
        word.append(p)
    assert len(seen) > 4
    docs = spark.createDataFrame(
        [(i, "International cooperation on standards", c) for i in range(40) for c in (0, 1)],
        "doc_id long, text string, nth int",
    )
    got = M.round_trip(docs, dropout=0.3, copy_col="nth").collect()
    digests = {(r.doc_id, r.variant): r.ids_sha256 for r in got}
    assert len(set(digests.values())) > 8 and any(digests[i, 0] != digests[i, 1] for i in range(40)) and all(r.lossless for r in got)
