"""Search of recordings: the same matches as one by one, in much less time, and even tasks whatever the input's parts."""

import time

import numpy as np

from cuboid.llm import audio


def recordings(rng, count):
    """Codes with many chance votes: pieces of a few tunes with bit errors, constant, short and empty ones."""
    tunes, out = rng.integers(0, 2**32, (6, 200), dtype=np.uint32) & np.uint32(0x3F3F3F3F), []
    for k in range(count):
        x = tunes[rng.integers(6), rng.integers(90) :][: rng.integers(30, 120)].copy()
        flips = rng.integers(0, 32, len(x)).astype(np.uint32)
        x ^= np.where(rng.random(len(x)) < 0.6, np.uint32(1) << flips, np.uint32(0))
        out.append([x, x, x, np.full(60, 7, np.uint32), x[:2], x[:0]][k % 6])
    return out


def one_by_one(queries, key, r, c):
    """(query, offset, errors) by plain counting: frames vote where a sub-key that both hold comes first."""
    out, places = [], audio_first(r, c)
    for q, codes in queries.items():
        mine = audio_first(codes, c) if q != key else {}
        votes = {}
        for sub in mine.keys() & places.keys():
            votes.setdefault(mine[sub] - places[sub], set()).add(mine[sub])
        best = []
        for o in (o for o, at in votes.items() if len(at) >= c.votes):
            a, b = max(o, 0), max(-o, 0)
            n = min(len(codes) - a, len(r) - b)
            if n >= c.overlap:
                best.append((int(np.bitwise_count(codes[a : a + n] ^ r[b : b + n]).sum()) / (32 * n), o))
        if best and min(best)[0] <= c.errors:
            out.append((q, key, min(best)[1], min(best)[0]))
    return out


def audio_first(codes, c):
    out = {}
    for part, mask in enumerate(audio.MASKS):
        x = (codes & mask).tolist()
        for k in range(len(x) - c.run + 1):
            out.setdefault((part, *x[k : k + c.run]), k)
    return out


def flat(codes):
    return np.concatenate(codes), np.array([len(x) for x in codes])


def test_matches_are_those_of_plain_counting():
    rng = np.random.default_rng(8)
    for c in (audio.Chroma(), audio.Chroma(run=2), audio.Chroma(run=3, votes=2), audio.Chroma(votes=1, overlap=1, errors=0.3)):
        codes = recordings(rng, 60)
        queries = {k: x for k, x in enumerate(codes) if k % 4 != 1}
        index = audio.Asked(np.array(list(queries)), *flat(list(queries.values())), c)
        want = sorted(m for k, x in enumerate(codes) for m in one_by_one(queries, k, x, c))
        assert len(want) > 50
        for hits in (1, 300, 1 << 17):
            found = index.matches(np.arange(len(codes)), *flat(codes), hits)
            assert sorted(m for part in found for m in zip(*(x.tolist() for x in part), strict=True)) == want


def test_search_takes_much_less_than_one_recording_at_a_time():
    """Before, a recording's votes were sorted and its offsets verified one by one, as here."""
    rng, c = np.random.default_rng(9), audio.Chroma()
    codes = list(rng.integers(0, 2**32, (2000, 111), dtype=np.uint32) & np.uint32(0x07070707))
    codes[1000:1050] = [np.append(x[k % 30 :], x[: k % 30]) for k, x in enumerate(codes[:50])]
    keys, (all_codes, size) = np.arange(2000), flat(codes)
    index = audio.Asked(keys, all_codes, size, c)

    def before(key, r):
        sub, at = audio.sub_keys(r, np.zeros(1, np.int64), c)
        sub, first = np.unique(sub, return_index=True)
        where = np.minimum(np.searchsorted(index.sub, sub), len(index.sub) - 1)
        have = index.sub[where] == sub
        lo, hi, at = index.start[where[have]], index.start[where[have] + 1], at[first][have]
        q = index.at[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])].astype(np.int64)
        owner, offset = index.owner[q], q - index.first[index.owner[q]] - np.repeat(at, hi - lo)
        votes = np.unique(((owner * np.int64(222) + offset + 111) << 20) + q)
        ids, n = np.unique(votes >> 20, return_counts=True)
        found = set()
        for v in ids[n >= c.votes].tolist():
            k, o = v // 222, v % 222 - 111
            x, a, b = codes[k], max(o, 0), max(-o, 0)
            n = min(len(x) - a, len(r) - b)
            if k != key and n >= c.overlap and int(np.bitwise_count(x[a : a + n] ^ r[b : b + n]).sum()) / (32 * n) <= c.errors:
                found.add((k, key))
        return found

    begun = time.process_time()
    want = set().union(*(before(k, codes[k]) for k in range(150)))
    plain, begun = time.process_time() - begun, time.process_time()
    got = {m for part in index.matches(keys[:150], all_codes[: size[:150].sum()], size[:150]) for m in zip(part[0].tolist(), part[1].tolist(), strict=True)}
    assert got == want and len(got) > 10
    assert time.process_time() - begun < plain / 2


def test_vectors_of_one_part_are_dealt_out(spark):
    vectors = spark.createDataFrame([(k, [0.01 * (k * j % 50) - 0.25 for j in range(64)]) for k in range(64)], "vec_id long, embedding array<float>").coalesce(1)
    sizes = audio.melodies(vectors).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 64 and max(sizes) <= 16


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [0.1] * 64), (1, None), (2, []), (3, [None, nan, 0.2] * 20), (None, [9.0, -9.0] * 32), (4, [float("inf")] * 64)]
    got = {r.vec_id: audio.read_wav(r.wav) for r in audio.melodies(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert {k: len(x) // 512 for k, x in got.items()} == {0: 64, 1: 0, 2: 0, 3: 57, None: 64, 4: 64}
    assert not got[3][:1024].any() and got[3][1024:1536].any()  # null and NaN are rests
    assert np.array_equal(got[None][:512], got[4][:512])
