"""The pipeline's stages against their operators' brute-force answers, on a small table with clashing names and nulls."""

import random
from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, documents

import corpus_pipeline as P
from quantloom.llm import mixing, nearcopies, secrets, toxicity
from quantloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents() + [(900, 'say token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "en", "s1", 9, 1, "x", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def _shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {b" ".join(w)} if w else set()


def brute_groups(rows):
    """The smallest id that each row reaches over pairs of a similarity of 0.8 or more of their 5-word shingles."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(rows))]


def brute_kept(rows):
    """Ids that stay: of each group the smallest."""
    return {i for i in brute_groups(rows) if i is not None}


def test_stages_keep_columns_and_take_effect(spark, docs):
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "simhash", "secrets", "mixing", "sentencepiece"]
    first = stages["toxicity"](spark, docs, SF)
    assert first.columns == docs.columns and first.count() <= docs.count()
    kept = stages["simhash"](spark, docs, SF)
    assert kept.columns == docs.columns
    want = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(want)
    assert sum(r.doc_id is None for r in kept.collect()) == 2
    clean = {r.doc_id: r for r in stages["secrets"](spark, docs, SF).collect()}
    assert clean[900].text == 'say [assign]" here' and clean[900].n_chars == len(clean[900].text) and clean[1].text is None
    mix = stages["mixing"](spark, docs, SF)
    copies = Counter()
    for r in mixing.expected_mix(docs).collect():
        copies[r.doc_id] += r.copies
    assert mix.columns == docs.columns and Counter(r.doc_id for r in mix.collect()) == +copies
    ids = stages["sentencepiece"](spark, docs, SF)
    assert ids.count() == docs.count() and all(r.lossless for r in ids.collect())


def test_run(spark):
    out = P.run(spark, SF).collect()
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("toxic").collect()}
    assert out and bad and not bad & {r.doc_id for r in out} and all(r.lossless for r in out)
    assert max(Counter(r.doc_id for r in out).values()) <= 2
    assert secrets.spans(None, secrets.Novelty()) == []
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_repeated_ids_are_judged_by_their_texts(spark):
    one, two = ("alpha beta gamma delta epsilon zeta eta theta", "kappa lambda mu nu xi omicron pi rho sigma")
    rows = [
        (5, one),
        (5, two),
        (7, one),
        (3, two),
        (9, "quite another text of its own stands here"),
        (9, "quite another text of its own stands here"),
        (9, None),
        (9, ""),
    ]
    got = P.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    # (5, two) is a copy of (3, two); the null and the empty text are one document
    assert Counter(r.doc_id for r in got) == {5: 1, 3: 1, 9: 2}
    assert {r.text for r in got if r.doc_id != 9} == {one, two}


@pytest.mark.parametrize("block", [4096, 4])
def test_components_are_those_of_all_pairs(spark, block):
    """Planted copies of similarity about 0.6 to 1, in groups large and small, against all pairs."""
    r, rows = random.Random(11), []
    for g in range(12):
        base = [f"t{r.randrange(5000)}" for _ in range(200)]
        for _ in range(60 if g < 2 else 6):
            own = list(base)
            for _ in range(r.randrange(11)):
                own[r.randrange(200)] = f"e{r.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(900 + k, t) for k, t in enumerate(["", " ", "one two", "One  two", "one two three"])] + [(None, rows[0][1]), (None, None)]
    want = Counter((i, g) for (i, _), g in zip(rows, brute_groups(rows), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nearcopies.jaccard_components(docs, block=block).select("doc_id", "component_id").collect()
    assert Counter(map(tuple, got)) == want
    kept = Counter(x.doc_id for x in P.drop_near_copies(spark, docs, SF).collect())
    assert kept == Counter({i: 1 for i in brute_kept(rows)}) + Counter({None: 2}) and 20 < len(kept) < 150


def test_copies_of_similarity_0_8_are_found():
    """Band keys meet for sets that share 8 of 9 of their members each, as similarity 0.8 has it."""
    r, missed = np.random.default_rng(3), 0
    for _ in range(2000):
        x = r.integers(0, 2**63, 110, dtype=np.uint64)
        missed += not np.intersect1d(nearcopies.band_keys(x[:99]), nearcopies.band_keys(x[11:])).size
    assert missed == 0
