"""Toxicity: held-out accuracy on the labels, clean documents left alone, and awkward rows."""

import math
import re

import numpy as np
from fixtures import SCHEMA, documents
from pyspark.sql import functions as F

from quantloom.llm import toxicity as X
from quantloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    train = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 0)
    test = {r.doc_id: r.toxic for r in labels.subtract(train).collect()}
    marked = {"idiot", "moron", "scum", "trash", "loser", "stupid", "pathetic", "worthless", "disgusting", "clown"}
    got = X.scored(docs, X.fit(docs, train)).select("doc_id", "text", "lang", "toxicity.toxic").filter("text is not null").collect()
    hit = {r.doc_id: len(marked & set(X._WORD.findall(r.text.lower()))) for r in got}
    own = [r for r in got if r.doc_id in test]
    assert not [r.doc_id for r in own if not test[r.doc_id] and r.toxic]
    plain = [r for r in own if hit[r.doc_id] >= 2]
    assert plain and np.mean([r.toxic for r in plain]) > 0.9


def test_chain_uses_earlier_probabilities_out_of_fold():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = np.column_stack([x[:, 0] > 0, x[:, 0] + x[:, 1] > 0.7]).astype(float)
    fold = np.arange(400) % 5
    weights, oof = X.fit_chain(x, y, fold)
    assert [len(w) for w in weights] == [6, 7] and weights[1][6] > 0
    again = X._fit_one(X._inputs(x[fold != 2], np.zeros((320, 0))), y[fold != 2, 0], 1.0)
    assert np.allclose(oof[fold == 2, 0], X._sigmoid(X._inputs(x[fold == 2], np.zeros((80, 0))) @ again))
    chain = X.Chain(["a"] * 5, ["p", "q"], np.ones(5), weights)
    p = chain.predict(x)
    assert ((p[:, 1] > 0.5) == (y[:, 1] > 0)).mean() > 0.9


def test_awkward_rows(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    labels = "doc_id long, quality int, toxic int, word string"
    for rows in ([], [(4, 1, 0, "x")], [(4, None, 1, "x"), (5, 1, 0, "x"), (5, 1, None, "x"), (None, 1, 1, "x"), (6, 0, 0, None)]):
        marks = spark.createDataFrame(rows, labels)
        got = X.toxicity(docs, marks)
        assert got.count() == len(documents())
        assert X.clean(docs, marks).columns == docs.columns
        assert X.toxicity(docs.limit(0), marks).count() == 0


def plain_scores(text, chain):
    """The chain's probabilities, word by word and model by model."""
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    x = [math.log1p(sum(w == a if not a.endswith("~") else w.startswith(a[:-1]) and len(w) > len(a) - 1 for w in words)) for a in chain.names]
    raw = (text or "").encode()
    n = max(1, len(raw))
    x += [sum(33 <= b < 127 and not chr(b).isalnum() for b in raw) / n, sum(65 <= b <= 90 for b in raw) / n] if text else [0.0, 0.0]
    x = [v / s for v, s in zip(x, chain.scale, strict=True)]
    out = []
    for w in chain.weights:
        fed = [math.log(q / (1 - q)) / 4 for p in out if (q := min(max(p, 1e-4), 1 - 1e-4))]
        z = w[0] + sum(a * b for a, b in zip(w[1:], [*x, *fed], strict=True))
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return out


def test_scores_are_the_chain_by_hand(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain = X.fit(docs, labels)
    assert len(chain.weights) == 3 and [len(w) - len(chain.weights[0]) for w in chain.weights] == [0, 1, 2]
    got = X.scored(docs, chain).select("text", "toxicity.*").collect()
    assert len(got) == docs.count()
    for r in got:
        want = plain_scores(r.text, chain)
        assert np.allclose([r.p_toxic_junk, r.p_toxic_fluent, r.p_toxic], want, atol=1e-9) and r.toxic == (want[-1] >= 0.5)
    assert 0 < sum(r.toxic for r in got) < len(got) / 2


def test_the_sample_is_bounded_by_rows_where_ids_repeat(spark, monkeypatch):
    rows = [(k % 40, f"{'bad moronic idiot' if k % 2 else 'kind calm words'} number {k // 40}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    fit_chain = X.fit_chain
    monkeypatch.setattr(X, "fit_chain", lambda x, y, fold: seen.append(len(x)) or fit_chain(x, y, fold))
    got = X.toxicity(docs, labels, sample_rows=30).collect()
    assert seen == [30] and len(got) == 4000 and all(r.toxic == bool(r.doc_id % 2) for r in got)
