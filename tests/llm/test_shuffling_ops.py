"""Mixing, quality rules, substring dedup and SimHash against brute force."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from fixtures import SCHEMA, documents, split

from quantloom.llm import mixing, quality, simhash, substring

LAST = 2**63 - 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_substring(rows, size=20):
    seen, out = {}, []
    order = sorted((LAST if i is None else i, t or "") for i, t in rows)
    for i, t in order:
        w = split(t)
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k : k + size]), (i, k))
            seen[tuple(w[k : k + size])] = min(seen[tuple(w[k : k + size])], (i, k))
    for i, t in order:
        w = split(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] < (i, k):
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if i == LAST else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_matches_brute_force(docs):
    got = substring.substring_dedup(docs, hot_count=3).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == brute_substring([(r[0], r[1]) for r in documents()])


@pytest.mark.parametrize("hot", [2, 1000])
def test_substring_random(spark, hot):
    r = random.Random(hot)
    base = [[f"v{r.randrange(30)}" for _ in range(200)] for _ in range(4)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(r.randrange(1, 5)):
            b = r.choice(base)
            k = r.randrange(150)
            text += b[k : k + r.randrange(5, 50)] + [f"v{r.randrange(30)}" for _ in range(r.randrange(4))]
        rows.append((i, " ".join(text)))
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot_count=hot, shard_words=200)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_substring(rows)


@pytest.mark.parametrize("hot", [2, 1000])
def test_substring_texts_that_share_an_id_are_documents_of_their_own(spark, hot):
    r = random.Random(8)
    passage, own = [f"p{k}" for k in range(20)], [f"u{k}" for k in range(100)]
    twin = [f"q{r.randrange(900)}" for _ in range(30)]
    rows = [
        (1, " ".join(passage)),
        (None, " ".join(own + passage)),
        (None, "short text"),
        (None, " ".join([*twin, "x"])),
        (None, " ".join(["y", *twin])),
        (None, " ".join(["y", *twin])),
        (7, " ".join(own[:30])),
        (7, "brief"),
        (7, " ".join(["z"] * 5 + passage)),
    ]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot_count=hot).collect()
    gone = Counter((x.doc_id, x.n_words, x.n_removed) for x in got)
    # of the unlike twins, the one whose text has the larger hash loses the passage, in every row
    twins = {k: v for k, v in gone.items() if k[1] == 31}
    assert twins in ({(None, 31, 0): 2, (None, 31, 30): 1}, {(None, 31, 0): 1, (None, 31, 30): 2})
    assert gone - Counter(twins) == Counter({(1, 20, 0): 1, (None, 120, 50): 1, (None, 2, 0): 1, (7, 30, 0): 1, (7, 1, 0): 1, (7, 25, 20): 1})
    assert "short text" in {x.kept_text for x in got} and " ".join(own[30:]) in {x.kept_text for x in got}


@pytest.mark.parametrize(
    "options",
    [{}, {"hot_count": 2}, {"hot_count": 2, "reference_passages": 3, "passage_words": 24}, {"hot_count": 3, "reference_passages": 0}],
)
def test_substring_periodic_and_common_texts(spark, options):
    """Periods of one word and more, a common phrase in varied surroundings, repeated and null ids with unlike texts."""
    r = random.Random(4)
    period = [["aa"] * 400, ["aa", "bb"] * 150, [f"c{k % 7}" for k in range(500)], [f"c{k % 7}" for k in range(3, 90)], ["aa"] * 19, ["aa"] * 20]
    phrase = [f"ph{k}" for k in range(12)]
    rows = [(10 * k, " ".join(x)) for k, x in enumerate(period)]
    around = [[f"z{r.randrange(6)}" for _ in range(9)] for _ in range(5)]
    for k in range(60):
        rows.append((100 + k, " ".join([f"y{k}", *r.choice(around), *phrase, *r.choice(around), f"x{k}", *r.choice(period)[: r.randrange(60)]])))
    rows += [
        (700, " ".join(["q", *phrase, *around[0]])),
        (700, " ".join(["q2", *phrase, *around[1], *["aa"] * 25])),
        (None, " ".join(around[2] * 4)),
        (None, "short"),
    ]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **options)
    own = [(i, t) for i, t in rows if i is not None and i != 700]
    # of rows that share an id, the order is by a hash of the text; the others are as in brute force
    found = Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert sum(found.values()) == len(rows)
    want = brute_substring(own)
    assert not want - found


def test_repeats_of_a_sequence_in_itself():
    r = random.Random(6)
    for size in (1, 3, 6):
        for _ in range(60):
            tokens = [r.randrange(3) for _ in range(r.randrange(40))] + [1, 2] * r.randrange(8) + [0] * r.randrange(12)
            want = [k for k in range(len(tokens) - size + 1) if any(tokens[j : j + size] == tokens[k : k + size] for j in range(k))]
            assert list(substring.SuffixAutomaton().repeats(tokens, size)) == want


def test_automata_decide_every_removal(spark, monkeypatch):
    """Where no automaton finds anything, only copies lose words."""
    rows = [(r[0], r[1]) for r in documents() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lost = lambda **o: sum(r.n_removed for r in substring.substring_dedup(docs, **o).collect())
    full = lost()
    monkeypatch.setattr(substring, "_judged", lambda batches, size: iter(()))
    copies = lost(hot_count=10**6)
    assert 0 < copies < full


def test_automaton_matches_naive():
    r = random.Random(5)
    passages = [[r.randrange(4) for _ in range(40)] for _ in range(5)]
    automaton = substring.SuffixAutomaton()
    for k, p in enumerate(passages):
        automaton.add(p, k, 0)
    tokens = [r.randrange(4) for _ in range(60)] + passages[3][5:30]
    size = 6
    for i, (held, where) in enumerate(automaton.matching(tokens, size)):
        best, first = 0, None
        for n in range(1, size + 1):
            own = tokens[i - n + 1 : i + 1] if i - n + 1 >= 0 else None
            found = own and next(((k, e) for k, p in enumerate(passages) for e in range(n, len(p) + 1) if p[e - n : e] == own), None)
            if not found:
                break
            best, first = n, found
        assert held == best
        if held == size:
            assert where == first


def brute_print(text):
    w = (text or "").encode().lower().split()
    w = [x.decode() for x in w]
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(rows, distance=2):
    prints = [(i, brute_print(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(least.get(find(p), LAST), i)
    return Counter((i, f"{p:016x}", least.get(find(p))) for i, p in prints)


def test_simhash_matches_brute_force(docs):
    got = simhash.simhash_components(docs)
    assert Counter(map(tuple, got.collect())) == brute_components([(r[0], r[1]) for r in documents()])


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"segments": 4}, {"segments": 1, "distance": 1}, {"segments": 4, "distance": 1, "hot": 2}])
def test_simhash_near_copies(spark, options):
    r = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"t{r.randrange(5000)}" for _ in range(400)]
        for _ in range(25):
            own = list(base)
            for _ in range(r.randrange(3)):
                own[r.randrange(400)] = f"e{r.randrange(9)}"
            rows.append((len(rows), " ".join(own)))
        rows.append((len(rows), " ".join(f"u{g}{r.randrange(900)}" for _ in range(50))))
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    want = brute_components(rows, options.get("distance", 2))
    assert Counter(map(tuple, got.collect())) == want
    assert len({c for _, _, c in want}) < 130


@pytest.mark.parametrize("hot", [1, 8, 1000])
def test_links_of_crowded_segments(spark, hot):
    """Fingerprints that share segments: links are all within two bits, and connect what all pairs connect."""
    r = random.Random(hot)
    base = [r.getrandbits(64) for _ in range(3)] + [0, 2**64 - 1]
    prints = {
        b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.randrange(3) == 0) * (1 << r.randrange(32)) for b in base for _ in range(120)
    } | set(base)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), hot=hot).collect()
    assert all((x.a % 2**64 ^ x.b % 2**64).bit_count() <= 2 and x.a < x.b for x in found)

    def roots(pairs):
        top = {p: p for p in prints}

        def find(p):
            while top[p] != p:
                p = top[p]
            return p

        for a, b in pairs:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
        return {p: find(p) for p in prints}

    pairs = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    assert roots((x.a % 2**64, x.b % 2**64) for x in found) == roots(pairs)
    if hot == 1000:
        assert {(min(x.a % 2**64, x.b % 2**64), max(x.a % 2**64, x.b % 2**64)) for x in found} == set(pairs)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 50), (7, 200), (300, 301), (301, 300)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in [*range(41), 200]}, 50: 50, 99: 50, 100: 50, 300: 300, 301: 300}


def water(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mixing(docs):
    rows = documents()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    want = water(sizes)
    got = mixing.expected_mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.expected_mix(docs).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"rows": 2}, {"seed": 9, "share": 0.7}])
def test_taken_is_the_prefix_sum_and_its_crossings(spark, docs, options):
    """Expected copies are summed by source in the order (part, h, id), from an offset in 0..1; a row is taken once for each integer crossed."""
    one = 1 << 24
    got = mixing.expected_mix(docs, keep_key=True, **options).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    want = water(sizes, share=options.get("share", 1.5))
    buckets = max(16, -(-len(got) // options.get("rows", 1 << 17)))
    for source in sizes:
        rows = sorted((r for r in got if r.source == source), key=lambda r: (r.part, r.h, LAST if r.doc_id is None else r.doc_id))
        each = round(want[source] / sizes[source] * one) if sizes[source] else 0
        ends = [each * (k + 1) for k in range(len(rows))]
        for r, end in zip(rows, ends, strict=True):
            assert r.part % buckets == r.h % buckets and (r["size"] == 0) == (r.part < 0)
            assert r.copies in (each // one, each // one + 1) and r.taken == r.copies * r["size"]
        # the offset is one number for the whole source: the running total of copies tells it within an interval
        total, low, high = 0, 0, one - 1
        for r, end in zip(rows, ends, strict=True):
            total += r.copies
            low, high = max(low, total * one - end), min(high, (total + 1) * one - end - 1)
        assert low <= high, (source, low, high)
    classes = {r.part // buckets: {x["size"] for x in got if x.part // buckets == r.part // buckets} for r in got}
    assert all(max(v) <= min(v) * 2 ** (1 / 8) + 1 for v in classes.values())


def test_mixing_is_near_its_targets_and_emits_rows(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(1, 200), "hot" if r.random() < 0.6 else f"s{i % 4}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target, copies = Counter(), {}, {}
    for x in mixing.expected_mix(docs).collect():
        taken[x.source] += x.taken
        target[x.source] = x.target
        copies[x.doc_id] = x.copies
        assert x.copies <= 2
    assert all(abs(taken[s] / target[s] - 1) < 0.02 for s in target)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(x.doc_id for x in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_mixed_repeated_rows(docs):
    want = Counter()
    for x in mixing.expected_mix(docs).collect():
        want[x.doc_id] += x.copies
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(x.doc_id for x in out.collect()) == +want


def brute_quality(text):
    text = text or ""
    w = split(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = Counter(windows)
    cover = {k + j for k, x in enumerate(windows) if count[x] > 1 for j in range(5)}
    n = len(cover)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, n, len(w) < 10 or 100 * n > 20 * len(w)


def test_quality_matches_brute_force(docs):
    got = quality.ledger(docs)
    rows = got.collect()
    want = Counter((r[0], *brute_quality(r[1])) for r in documents())
    assert Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, bool(r.fail_bits & quality.BASE)) for r in rows
    ) == want
    for p in quality.ablations(got).collect():
        policy = next(x for x in quality.POLICIES if x.version == p.policy)
        bit = next(r.bit for r in quality.RULES if r.name == p.rule)
        bits = [r.fail_bits & policy.mask() for r in rows]
        assert p.documents == len(rows) and p.kept == sum(b == 0 for b in bits)
        assert p.failed == sum(b >> bit & 1 for b in bits) and p.failed_alone == sum(b == 1 << bit for b in bits)
        assert p.kept_without == sum(b & ~(1 << bit) == 0 for b in bits)


def test_empty_tables(empty):
    for f in (substring.substring_dedup, simhash.simhash_components, mixing.expected_mix, mixing.mixed, quality.ledger):
        assert f(empty).count() == 0
