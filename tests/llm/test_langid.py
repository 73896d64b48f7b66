"""Language ID: forward-backward against enumeration, held-out accuracy, code-switched text, awkward rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, documents

from quantloom.llm import common, langid as L
from quantloom.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(table(spark, SF, "documents"), sample_rows=1200)


def test_forward_backward_is_enumeration():
    r = np.random.default_rng(0)
    n, first = np.array([3, 1, 4]), np.array([0, 3, 4])
    emit, step, begin = r.random((8, 3)) + 0.1, r.random((3, 3)) + 0.1, r.random(3) + 0.1
    p, pairs = L.forward_backward(emit.copy(), first, n, step, begin, pairs=True)
    total = np.zeros((3, 3))
    for a, k in zip(first, n, strict=True):
        node, pair, z = np.zeros((k, 3)), np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(k)):
            w = begin[path[0]] * np.prod([emit[a + t, y] for t, y in enumerate(path)]) * np.prod([step[x, y] for x, y in itertools.pairwise(path)])
            z += w
            for t, y in enumerate(path):
                node[t, y] += w
            for x, y in itertools.pairwise(path):
                pair[x, y] += w
        assert np.allclose(p[a : a + k], node / z)
        total += pair / z
    assert np.allclose(pairs, total)


def test_held_out_accuracy(spark, model):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    rows = docs.select("doc_id", "lang", L.held_out().alias("out")).collect()
    own = [r for r in rows if r.out and r.lang is not None]
    assert len(got) == len(rows) and np.mean([got[r.doc_id].lang_pred == r.lang for r in own]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switching(spark, model):
    text = "the and of with for that this from die und der nicht mit auf schein des"
    runs = L.label_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().runs
    assert [r.lang for r in runs] == ["en", "de"] and sum(r.n for r in runs) == 16 and abs(runs[1]["first"] - 8) <= 1


def test_awkward_rows(spark, model):
    rows = [
        *documents(),
        (700, "123 ... ###", "en", "s", 1, 1, "x", 2),
        (701, "ª", "en", "s", 1, 1, "x", 2),
        (702, "the " * 30_000, "en", "s", 1, 1, "x", 2),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1, 2, 3, 700)) and by[702].lang_pred == "en" and by[701].lang_pred != "und"
    full = L.identified(docs).collect()
    assert len(full) == len(rows) and L.identified(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identified(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_words_are_hashed_whole_and_freed_of_all_signs():
    long = "x" * 30
    words = common.Words(pa.array([f"{long}a {long}b {'(' * 20}word{')' * 20} word ###### 12 1a2"]))
    found = L._Features(words.buf, words.start, words.end, np.zeros(0, np.uint64))
    assert found.lettered.tolist() == [True, True, True, True, False, False, True]
    assert found.whole[0] != found.whole[1] and found.whole[2] == found.whole[3]
    own = [sorted(found.bucket[found.word == k].tolist()) for k in range(7)]
    assert own[2] == own[3] and own[4] == own[5] == []


def test_rare_languages_are_learned_and_reruns_agree(spark):
    r, rows = random.Random(1), []
    for k in range(260):
        own = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("ka", "lo", "mi", "nu", "re")]
        rows += [(1000 * k + j, " ".join(r.choice(own) for _ in range(30)), f"l{k:03d}") for j in range(3 if k else 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    model = L.fit(docs, sample_rows=300, epochs=2)
    assert len(model.labels) > 250 and model.weights.size <= 1 << L.TABLE_BITS
    again = L.fit(docs.repartition(3), sample_rows=300, epochs=2)
    assert model.labels == again.labels and np.array_equal(model.weights, again.weights)
    assert len(L.fit(docs, sample_rows=10, epochs=1).labels) <= 10
