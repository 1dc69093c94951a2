"""What travels: keys in slices, fingerprints before sets, and only the texts that may change."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuboid.llm import linking, paragraphs, setjoin, tables


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def random_sets(count: int, size: int, seed: int = 5) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.sort(rng.integers(0, 2**63, size, dtype=np.uint64)) for _ in range(count)]


def test_chance_pairs_of_large_sets_are_not_compared_by_members(spark, monkeypatch):
    sets = random_sets(12, 3000)
    near = sets[3].copy()
    near[:200] = random_sets(1, 200, 6)[0]  # 2800 in common: 0.875
    sets.append(np.sort(near))
    members = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "cls long, members binary")
    keys = [(7, i, 3000, 1, linking.HEAVY) for i in range(len(sets))]
    shared = spark.createDataFrame(keys, "key long, cls long, n int, at int, kind byte")
    shared, members, compared, old = tables.saved(shared), tables.saved(members), [], linking.verified
    monkeypatch.setattr(linking, "verified", lambda pairs, *a: (compared.append(pairs.count()), old(pairs, *a))[1])
    roots = {r.node: r.root for r in linking.link(shared, members, 85).collect()}
    assert roots == {3: 3, 12: 3}
    assert compared[-1] <= 1  # 66 and more before


@pytest.mark.parametrize("percent", [60, 85])
def test_fingerprints_lose_no_similar_pair(spark, percent):
    rng, rows = np.random.default_rng(8), []
    for g, size in enumerate((3, 30, 250, 1000, 5000)):
        base = random_sets(1, size, g)[0]
        for k in range(4):
            change = rng.random(size) < 0.12 * k
            more = random_sets(1, int(change.sum()) + rng.integers(0, 1 + size // 10), 100 * g + k)[0]
            rows.append((len(rows), np.unique(np.concatenate((base[~change], more)))))
    members = tables.saved(spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in rows], "cls long, members binary"))
    pairs = tables.saved(spark.createDataFrame([(i, j) for i, _ in rows for j, _ in rows if i < j], "u long, v long"))
    want = {(i, j) for i, x in rows for j, y in rows if i < j and 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))}
    some = linking.likely(pairs, members, percent)
    assert want <= {(r.u, r.v) for r in some.collect()}
    assert want and {(r.u, r.v) for r in linking.verified(some, members, percent).collect()} == want
    # in parts that move little each
    values = members.select("cls", F.floor(F.length("members") / 8).alias("n"), F.col("members").alias("value"))
    all_of_them = linking._meeting(pairs, tables.saved(values), 1, lambda x, y, n, m: len(x) == 8 * n and len(y) == 8 * m)
    assert sorted((r.u, r.v) for r in all_of_them.collect()) == sorted((r.u, r.v) for r in pairs.collect())


def test_keys_in_slices(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randint(-40, 40), rng.randint(0, 30), 50, 1, rng.choice([linking.ALL, linking.LISTED])) for _ in range(400)]
    keys = spark.createDataFrame(rows, "key long, cls long, n int, at int, kind byte")
    whole = {tuple(r) for r in linking.shared_keys(keys, 85).select(*keys.columns).collect()}
    monkeypatch.setattr(linking, "SLICED", 0)
    got = [tuple(r) for r in linking.shared_keys(keys, 85).select(*keys.columns).collect()]
    assert whole and set(got) == whole and len(got) == len(whole)


def test_texts_without_a_copy_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 60)) for i in range(60)]
    rows += [(100, rows[0][1]), (None, rows[1][1]), (101, None)]
    docs, moved, old = spark.createDataFrame(rows, "doc_id long, text string"), [], linking.unmarked

    def spy(*a):
        stay, doubtful = old(*a)
        moved.append(doubtful.count())
        return stay, doubtful

    for module in (setjoin, paragraphs):
        monkeypatch.setattr(module, "unmarked", spy)
    one = setjoin.one_of_each(docs).select("doc_id").collect()
    cut = paragraphs.substring_dedup(docs).select("doc_id", "n_removed").collect()
    assert sorted(str(r.doc_id) for r in one) == sorted(str(i) for i, _ in rows if i != 100)
    assert {r.doc_id: r.n_removed for r in cut} == {i: 60 * (i == 100) for i, _ in rows}
    assert len(moved) == 3 and max(moved) <= 3  # all 63 before
