"""Toxicity by classifier chains: linear models in a row, each fed the probabilities of those before.

Categories come from the labels: toxic junk, toxic fluent text, and toxic at all, in this order; the
last one decides. A text's features are how many of its distinct words have each selected affix or
are a selected word (log1p), and how much of it is no letter or a capital. Selection counts words and
word starts over a sample of labelled documents on the executors and keeps the `features` with the
strongest association. In the chain, the models for later categories are trained with out-of-fold
probabilities of earlier ones, so that they see inputs as good as at prediction, not better.

The sample is the `sample_rows` labelled documents of smallest hash, of each one row (of rows that share an id, the
text that is first by code point); everything else is over all rows. Model size is bounded by `features`.

Edge cases: null and empty texts have no features and get the score of such a text; of repeated
labels of a document the largest counts; without any labelled document, or any toxic one, all scores
are 0. Repeated rows each get their row; an empty table gives an empty result. Only id and text (and
the labels' doc_id, quality, toxic) are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Category, and where it holds in terms of the labels. The last decides.
CATEGORIES = (("toxic_junk", "toxic = 1 and quality = 0"), ("toxic_fluent", "toxic = 1 and quality = 1"), ("toxic", "toxic = 1"))
_WORD = re.compile(r"[^\W\d_]+")
_STARTS = range(4, 10)
_CACHE = 100_000
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_CAPITALS = bytes(range(65, 91))


def _affixes(word: str):
    return [word, *(word[:k] + "~" for k in _STARTS if k < len(word))]


def _dense(text: str) -> list[float]:
    """Shares of bytes that are neither letters nor blanks, and of capitals, in ASCII."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    return [(n - len(raw.translate(None, _SIGNS))) / n, (n - len(raw.translate(None, _CAPITALS))) / n]


class Reader:
    """Sparse features of texts, by a dictionary of the selected affixes; words seen before are remembered."""

    def __init__(self, names: list[str]):
        self.index = {name: k for k, name in enumerate(names)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str) -> Counter:
        found: Counter = Counter()
        for word in set(_WORD.findall(text.lower())):
            hits = self.seen.get(word)
            if hits is None:
                if len(self.seen) >= _CACHE:
                    self.seen.clear()
                self.seen[word] = hits = tuple(self.index[a] for a in _affixes(word) if a in self.index)
            if hits:
                found.update(hits)
        return found


class Chain:
    """Weights of each category's model: intercept, features, and the logits of earlier categories."""

    def __init__(self, names: list[str], categories: list[str], scale: np.ndarray, weights: list[np.ndarray]):
        self.names, self.categories, self.scale, self.weights = names, categories, scale, weights

    def reader(self) -> Reader:
        """One for all batches of a worker."""
        if "_reader" not in self.__dict__:
            self._reader = Reader(self.names)
        return self._reader

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a column a category."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, _sigmoid(_inputs(x / self.scale, out) @ w)])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _inputs(x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    p = np.clip(earlier, 1e-4, 1 - 1e-4)
    return np.column_stack([np.ones(len(x)), x, np.log(p / (1 - p)) / 4])


def _fit_one(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression with a ridge penalty, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(25):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, ridge: float = 1.0) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of each category in turn, and the out-of-fold probabilities that later ones were trained with."""
    weights, oof = [], np.zeros((len(x), 0))
    for k in range(y.shape[1]):
        inputs = _inputs(x, oof)
        weights.append(_fit_one(inputs, y[:, k], ridge))
        own = np.zeros(len(x))
        for f in np.unique(fold):
            own[fold == f] = _sigmoid(inputs[fold == f] @ _fit_one(inputs[fold != f], y[fold != f, k], ridge))
        oof = np.column_stack([oof, own])
    return weights, oof


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 8192,
    features: int = 256,
    folds: int = 5,
    categories=CATEGORIES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Chain | None:
    """A chain for the categories; None if the sample has no toxic or no other document."""
    names = [n for n, _ in categories]
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = sample.select("doc_id", *[F.coalesce(F.expr(e), F.lit(False)).cast("int").alias(f"y{k}") for k, (_, e) in enumerate(categories)])
    last = f"y{len(names) - 1}"
    texts = common.ids_and_texts(docs, id_col, text_col).filter("text is not null")
    # a row an id, however often the table repeats it, so that sample_rows bounds what the driver collects
    marked = [F.first(f"y{k}").alias(f"y{k}") for k in range(len(names))]
    rows = common.written(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *marked))

    def count(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column(last).to_pylist(), strict=True):
                for a in {a for w in set(_WORD.findall(text.lower())) for a in _affixes(w)}:
                    found.setdefault(a, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.keys(), pa.string()),
                    pa.array([c[0] for c in found.values()], pa.int64()),
                    pa.array([c[1] for c in found.values()], pa.int64()),
                ],
                ["a", "clean", "toxic"],
            )

    totals = rows.agg(F.count("*"), F.sum(last)).first()
    n, t = totals[0], totals[1] or 0
    if not t or t == n:
        return None
    counted = rows.select("text", last).mapInArrow(
        common.trimmed(count),
        "a string, clean long, toxic long",
    ).groupBy("a").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    rate = F.col("t") / t / ((F.col("c") + F.lit(0.5)) / (n - t))
    # expected log-likelihood gain of knowing the affix, for those that speak for toxicity
    chosen = counted.filter((F.col("t") >= 4) & (rate > 3)).select(
        "a",
        (F.col("t") * F.log(rate)).alias("gain"),
    ).orderBy(F.desc("gain"), "a").limit(features).collect()
    affixes = [r.a for r in chosen]

    def read(batches):
        reader = Reader(affixes)
        for batch in batches:
            found = [(reader.counts(t), _dense(t)) for t in batch.column("text").to_pylist()]
            at, n = (pa.array([list(f(c)) for c, _ in found], pa.list_(pa.int32())) for f in (Counter.keys, Counter.values))
            marks_ = [f"y{k}" for k in range(len(names))]
            columns = [batch.column("doc_id"), *map(batch.column, marks_), at, n, pa.array([d for _, d in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *marks_, "at", "n", "dense"])

    # bounded: sample_rows rows of at most `features` counts
    kinds = "doc_id long, " + "".join(f"y{k} int, " for k in range(len(names))) + "at array<int>, n array<int>, dense array<double>"
    got = rows.mapInArrow(common.trimmed(read), kinds).collect()
    x = np.array([_row(dict(zip(r.at, r.n, strict=True)), r.dense, len(affixes)) for r in got])
    y = np.array([[r[f"y{k}"] for k in range(len(names))] for r in got], float)
    order = np.argsort([r.doc_id for r in got], kind="stable")
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    fold = np.arange(len(x)) % folds
    weights, _ = fit_chain(x[order] / scale, y[order], fold)
    return Chain(affixes, names, scale, weights)


def _row(counts: dict, dense: list[float], n: int) -> np.ndarray:
    out = np.zeros(n + len(dense))
    for k, v in counts.items():
        out[k] = np.log1p(v)
    out[n:] = dense
    return out


def scored(docs: DataFrame, chain: Chain | None, threshold: float = 0.5, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a struct column `into`: p_<category> of each, and toxic (the last reaches the threshold)."""
    names = chain.categories if chain else [n for n, _ in CATEGORIES]
    kind = "struct<" + ", ".join(f"p_{n}: double" for n in names) + ", toxic: boolean>"
    if chain is None:
        return docs.withColumn(into, F.struct(*[F.lit(0.0).alias(f"p_{n}") for n in names], F.lit(False).alias("toxic")))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        model = shared.value
        reader, n = model.reader(), len(model.names)
        for texts in batches:
            x = np.zeros((len(texts), n + 2))
            for k, text in enumerate(texts):
                if text:
                    for at, c in reader.counts(text).items():
                        x[k, at] = np.log1p(c)
                    x[k, n:] = _dense(text)
            p = model.predict(x)
            yield pd.DataFrame(p, columns=[f"p_{c}" for c in model.categories]).assign(toxic=p[:, -1] >= threshold)

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from common.trimmed(run)(batches)

    return docs.withColumn(into, score(F.col(text_col).cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, p_<category> of each category, toxic."""
    chain = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    return scored(common.ids_and_texts(docs, id_col, text_col), chain, threshold).select("doc_id", "toxicity.*")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose text is not toxic, with their columns as they are."""
    chain = fit(docs, labels, text_col=text_col, **options)
    return scored(docs, chain, threshold, text_col, "__toxicity").filter(~F.col("__toxicity.toxic")).drop("__toxicity")
