"""Chroma fingerprints: filters against plain sums, recall of search against brute force, awkward media."""

import struct

import numpy as np

from quantloom.llm import chroma as C


def test_packed_integers_are_plain_sums():
    image = np.random.default_rng(1).random((40, 12))
    got = C.packed(image)
    assert len(got) == 25 and len(C.filters()) == 16
    for t in (0, 7, 24):
        want = 0
        for k, (kind, y, h, w) in enumerate(C.filters()):
            box = image[t : t + w, y : y + h]
            assert box.shape == (w, h)
            if kind == "pitch2":
                a, b = box[:, : h // 2].sum(), box[:, h // 2 :].sum()
            elif kind == "time2":
                a, b = box[: w // 2].sum(), box[w // 2 :].sum()
            elif kind == "cross":
                a = box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum()
                b = box.sum() - a
            elif kind == "pitch3":
                a = box[:, h // 3 : 2 * h // 3].sum()
                b = (box.sum() - a) / 2
            else:
                a = box[w // 3 : 2 * w // 3].sum()
                b = (box.sum() - a) / 2
            level = sum(np.log((a + 0.01) / (b + 0.01)) > x for x in C.LEVELS)
            want |= [0, 1, 3, 2][level] << (2 * k)
        assert got[t] == want


def recordings():
    r = np.random.default_rng(7)
    tunes = [r.normal(size=64) for _ in range(12)]
    rows = {}
    for i in range(120):
        tune = tunes[i % 12] if i % 3 else r.normal(size=64)
        rate, x = C.rendered(tune.tolist())
        if i % 4 == 1:
            x = x[int(r.integers(40)) * C.HOP :]
        if i % 4 == 2:
            x = x + r.normal(size=len(x)) * 0.02
        rows[i] = C.encode_wav(rate, x * 0.9)
    rows[200] = rows[3]
    return rows


def brute(ints, max_ber=0.15, least=32):
    """All pairs at all offsets."""
    out = {}
    bits = {k: np.unpackbits(v.view(np.uint8)).reshape(-1, 32) for k, v in ints.items()}
    for q, a in bits.items():
        for m, b in bits.items():
            if q == m:
                continue
            best = None
            for offset in range(least - len(a), len(b) - least + 1):
                x, y = a[max(0, -offset) :], b[max(0, offset) :]
                n = min(len(x), len(y))
                if n >= least:
                    e = int((x[:n] != y[:n]).sum())
                    if e / (32 * n) <= max_ber:
                        best = min(best or (9,), (e / (32 * n), -n, offset))
            if best:
                out[q, m] = best
    return out


def answers(found):
    """Pairs of classes that search() says are alike: those of one group; and alignments through representatives that a pair shares."""
    groups, through = {}, {}
    for r in found:
        if r.kind == "member" and r.class_id is not None:
            groups.setdefault(r.group_id, {r.group_id}).add(r.class_id)
            through.setdefault(r.class_id, {})[r.class_id] = 0
    for r in found:
        if r.kind == "match":
            through[r.id][r.class_id] = r.offset
    alike = {(a, b) for g in groups.values() for a in g for b in g if a != b}
    return alike, {(a, b): {through[a][c] - through[b][c] for c in through[a].keys() & through[b].keys()} for a, b in alike}


def test_search_recall(spark):
    rows = recordings()
    media = spark.createDataFrame([(k, bytearray(v), "x") for k, v in rows.items()], "rec long, wav binary, ints string")
    found = C.search(media, "rec", "wav", every=5).collect()
    members = {r.id: r.class_id for r in found if r.kind == "member"}
    assert len(members) == len(rows) and members[200] == members[3] == 3
    asked = {members[k] for k in rows if k % 5 == 0}
    ints = {k: C.packed(C.chroma(*C.decode_wav(rows[k]))) for k in set(members.values())}
    every = brute(ints)
    want = {k: v for k, v in every.items() if k[0] in asked}
    assert len(want) > 50
    alike, offsets = answers(found)
    hits = [k for k in want if k in alike]
    assert len(hits) / len(want) >= 0.9
    root = {k: k for k in ints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in every:
        root[top(a)] = top(b)
    # groups join nothing that all pairs at all offsets would keep apart, and links are what the pair really has
    assert all(top(a) == top(b) for a, b in alike)
    assert np.mean([want[k][2] in offsets[k] for k in hits if offsets[k]]) >= 0.9
    assert np.mean([bool(offsets[k]) for k in hits]) >= 0.8
    for r in found:
        if r.kind == "match":
            assert every[r.id, r.class_id][0] <= r.ber <= 0.15 and top(r.id) in {top(a) for a in asked}


def planted(n, seed=3):
    """Near copies of one recording, each with noise of its own, and as many other recordings."""
    r = np.random.default_rng(seed)
    base = r.normal(size=64)
    return [(base + r.normal(size=64) * 0.1).tolist() for _ in range(n)] + [r.normal(size=64).tolist() for _ in range(n)]


def test_votes_of_near_copies_grow_with_their_number(spark, monkeypatch):
    made, written = {}, C.common.written
    for n in (100, 400):
        rows = planted(n)
        media = spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")
        counts = []

        def counted(df, *a, counts=counts, **k):
            out = written(df, *a, **k)
            counts.append(out.count())
            return out

        monkeypatch.setattr(C.common, "written", counted)
        found = C.search(media, "id", "v", C.rendered, every=1).collect()
        made[n] = max(counts)
        group = [r.group_id for r in found if r.kind == "member" and r.id < n]
        assert max(group.count(g) for g in set(group)) >= 0.95 * n
        # no recording of its own is in a group with any other
        assert all(r.group_id == r.id for r in found if r.kind == "member" and r.id >= n)
    assert made[400] < 6 * made[100]


def test_every_match_of_a_query_is_listed(spark):
    """Pairs of near copies that no third recording connects, a family of near copies, and held tones, against all pairs at all offsets."""
    r, rows = np.random.default_rng(17), planted(30, seed=5)[:30]
    for _ in range(40):
        base = r.normal(size=64)
        rows += [base.tolist(), (base + r.normal(size=64) * r.uniform(0.05, 0.15)).tolist()]
    rows += [[1.0, 0.0] * 32, [1.0, 0.0] * 25, [0.0, 1.0] * 32]
    media = spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")
    found = C.search(media, "id", "v", C.rendered, every=2).collect()
    member = {x.id: x.class_id for x in found if x.kind == "member"}
    every = brute({k: C.packed(C.chroma(*C.rendered(rows[k]))) for k in set(member.values())})
    asked = {member[k] for k in range(0, len(rows), 2)}
    want = {frozenset(k) for k in every if k[0] in asked}
    got = [frozenset((x.id, x.class_id)) for x in found if x.kind == "match"]
    assert len(got) == len(set(got)) and set(got) <= want
    lone = {k for k in want if min(k) >= 30}
    assert len(lone) > 30 and len(want - lone) > 150
    assert len(lone & set(got)) >= 0.95 * len(lone) and len(want & set(got)) >= 0.95 * len(want)
    assert frozenset((110, 111)) in got
    exact = [every[x.id, x.class_id][0] == x.ber for x in found if x.kind == "match" and x.id in asked]
    assert len(exact) == len(got) and np.mean(exact) >= 0.95


def test_votes_of_a_query_are_counted_where_they_meet(spark, monkeypatch):
    """What a search makes on the way grows with its matches and its rows, not with the keys that near copies share."""
    n = 120
    media = spark.createDataFrame(list(enumerate(planted(n))), "id long, v array<double>")
    plain, made = type(media).mapInArrow, []

    def counted(df, f, schema, *a, **k):
        rows = spark.sparkContext.accumulator(0)
        made.append(rows)

        def run(batches):
            for batch in f(batches):
                rows.add(len(batch))
                yield batch

        return plain(df, run, schema, *a, **k)

    monkeypatch.setattr(type(media), "mapInArrow", counted)
    found = [r for r in C.search(media, "id", "v", C.rendered, every=2).collect() if r.kind == "match"]
    assert len(found) > 4000
    assert max(x.value for x in made) < 3 * (len(found) + 2 * n)


def test_blocks_and_pieces_change_no_match(spark, monkeypatch):
    r, rows = np.random.default_rng(23), planted(30)
    rows += [r.normal(size=64).tolist() * 6, [1.0, 0.0] * 32, [1.0, 0.0] * 25, [0.0, 1.0, 1.0, 0.0] * 40]
    rows += [rows[60][:300], (np.array(rows[63]) + 0.01).tolist()]
    media = spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")

    def listed():
        return sorted(tuple(r) for r in C.search(media, "id", "v", C.rendered, every=3).collect() if r.kind == "match")

    want = listed()
    assert len(want) > 100
    # fewer keys than a recording has, so that its group is split; a vote at a time, and few
    for block, parts, votes in ((50, 3, 1), (700, 1, 37)):
        monkeypatch.setattr(C, "BLOCK", block)
        monkeypatch.setattr(C, "PARTS", parts)
        monkeypatch.setattr(C, "VOTES", votes)
        assert listed() == want


def test_keys_are_plain_pairs(spark):
    r = np.random.default_rng(29)
    rows = [r.integers(-2, 2, size=n).tolist() if n % 2 else [-(2**31), 2**31 - 1, -1, 0] * n for n in (0, 3, 4, 5, 6, 41, 60)] + [[7] * 30]
    found = spark.createDataFrame([(bytearray([i]), x) for i, x in enumerate(rows)], "digest binary, ints array<int>")
    got = {bytes(r.digest)[0]: [tuple(x) for x in r.k] for r in C._keys(found.coalesce(1), 4).collect()}
    for i, x in enumerate(rows):
        keys = [(((x[j] << 32) ^ x[j + 4]) + 2**63) % 2**64 - 2**63 for j in range(len(x) - 4)]
        want = [(k, j) for j, k in enumerate(keys) if j == 0 or k != keys[j - 1]]
        assert got.get(i, []) == want and (i in got) == (len(x) > 4)


def test_long_recording_is_found_by_its_part(spark):
    r = np.random.default_rng(9)
    rate, x = C.rendered(r.normal(size=4000).tolist())
    rows = [
        (1, bytearray(C.encode_wav(rate, x * 0.9))),
        (2, bytearray(C.encode_wav(rate, x[300 * C.HOP : 500 * C.HOP] * 0.9))),
        (3, bytearray(C.encode_wav(rate, x[::-1].copy()))),
    ]
    found = C.search(spark.createDataFrame(rows, "id long, wav binary"), "id", "wav", every=1).collect()
    assert {(r.id, r.group_id) for r in found if r.kind == "member"} == {(1, 1), (2, 1), (3, 3)}
    assert [abs(r.offset) for r in found if r.kind == "match"] == [300]


def header(width=2, channels=1, rate=2048, n=4000):
    size = n * width * channels
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack(
        "<IHHIIHH",
        16,
        1,
        channels,
        rate,
        rate * width * channels,
        width * channels,
        8 * width,
    ) + b"data" + struct.pack("<I", size)


def test_damaged_and_unusual_files():
    rate, x = C.rendered([1.0, 0.0] * 32)
    whole = C.encode_wav(rate, x)
    for cut in range(len(whole) - 5, len(whole)):
        assert len(C.decode_wav(whole[:cut])[1]) <= len(x)
    for cut in (0, 3, 11, 20, 30, 43, 44, 45):
        assert len(C.decode_wav(whole[:cut])[1]) == 0
    assert len(C.decode_wav(header(rate=0) + b"ab" * 4000)[1]) == 0
    assert len(C.decode_wav(header(channels=3) + b"abcd" * 100)[1]) <= 67
    for width in (1, 2, 3, 4):
        top = 2 ** (8 * width - 1)
        samples = np.round(x * 0.9 * (top - 1)).astype(np.int64) + (128 if width == 1 else 0)
        raw = samples.astype("<i8").tobytes()
        data = b"".join(raw[8 * k : 8 * k + width] for k in range(len(samples)))
        got = C.decode_wav(header(width, 1, rate, len(samples)) + data)
        assert got[0] == rate and np.abs(got[1] - x * 0.9).max() < 0.02, width


def test_awkward_media(spark):
    rate, tone = C.rendered([1.0, 0.0] * 32)
    wav = lambda x: bytearray(C.encode_wav(rate, x))
    rows = [
        (1, None), (2, bytearray()), (3, bytearray(b"no wav")), (4, bytearray(C.encode_wav(2048, np.zeros(20_000)))), (5, wav(tone)), (5, wav(tone)),
        (None, wav(tone)), (6, wav(tone[:300])), (
            7,
            bytearray(header(rate=0) + b"ab" * 4000),
        ), (None, wav(tone[::-2].copy())), (5, wav(np.zeros(9000))), (9, wav(tone)[:-3]),
    ]
    media = spark.createDataFrame(rows, "id long, media binary")
    found = [r for r in C.search(media, "id", "media", every=1).collect() if r.kind == "member"]
    named = sorted((str(r.id), r.class_id) for r in found if r.class_id)
    # 5 has two recordings, a tone and silence; the cut file ends a sample early, and its integers are the tone's or near them
    assert [x for x in named if x[0] != "9"] == [("4", 4), ("5", 5), ("5", 5), ("5", 5), ("None", 5)] and len(found) == len(rows)
    assert {r.class_id for r in found if r.id in (1, 2, 3, 6, 7)} == {None}
    assert C.search(media.limit(0), "id", "media").count() == 0
    assert C.rendered(None)[1].size == 0 and C.rendered([float("nan"), None, 1.0])[1].size == C.NOTE
