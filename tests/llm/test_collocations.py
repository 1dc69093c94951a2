"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cuboid.llm.collocations import Mining, Phrases, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, need):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, need.longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= need.support}
    inside = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out, by = [], {}
    for (lang, w), a in cand.items():
        if inside[lang, w] >= a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    for lang, found in by.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[: need.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, rows, need, parts=5):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    return sorted(map(tuple, collocations(df, need).collect()))


def some_rows(seed, n=400):
    r = random.Random(seed)
    words = ["A", "a", "bb", "cé", "d-d", "中", "e e", "F1", "g", "x" * 40]
    out = []
    for _ in range(n):
        text = "".join(r.choice(words[: r.choice([3, 10])]) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for _ in range(r.randrange(40)))
        out.append((r.choice(["en", "en", "de", None, "und", ""]), r.choice([text, text, text, None])))
    return out


@pytest.mark.parametrize("need", [Mining(support=20, shards=3), Mining(support=7, longest=3, top=5, shards=7), Mining(support=30, shards=5, entries=4, bits=8, block=64)])
def test_against_plain_counts(spark, need):
    """Also with so few entries that candidates come in several ranges and runs are sought by bits."""
    rows = some_rows(need.support)
    want = plain(rows, need)
    assert len(want) > 5 and mined(spark, rows, need) == want


def test_skew_and_repeats(spark):
    """All occurrences of a phrase in one partition, and one text in a third of the rows."""
    rows = [("en", "Far out at sea, far out")] * 40 + [("en", f"word{i} far") for i in range(80)] + [("en", "only here once " * 30)]
    need = Mining(support=25, shards=4)
    assert mined(spark, rows, need, 1) == plain(rows, need) == mined(spark, rows, need, 6)


def test_long_text(spark):
    rows = [("en", "one two three four five six. " * 40_000), ("en", None), (None, "")]
    need = Mining(support=100)
    assert mined(spark, rows, need) == plain(rows, need)


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations(none).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0
    df = spark.createDataFrame([("en", "so so", 1, "x")] * 3, "lang string, text string, n int, phrase string")
    assert [tuple(r) for r in collocations(df, Mining(support=3, shards=2)).collect()] == [("en", 1, "so so", 3, 6, 6, 6, 500)]


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 'en' AS lang, cast(X'61FF2062' AS string) AS text FROM range(4)")
    assert [r.phrase for r in collocations(df, Mining(support=4, shards=2)).collect()] == ["a� b"]


def test_lowered_support():
    for support in range(1, 300):
        for shards in range(1, 40):
            low = Mining(support=support, shards=shards).local
            assert low >= 1 and shards * (low - 1) < support


def test_words_and_pieces():
    texts = ["a b.c", "", ". .", "d", "É e;f g h\t i"]
    p = Phrases(pa.array(texts), pa.array(["x", None, "x", "y", "x"]))
    assert [p.text(i, 1).decode() for i in range(len(p.start))] == ["a", "b", "c", "d", "É", "e", "f", "g", "h", "i"]
    assert p.left.tolist() == [2, 1, 1, 1, 2, 1, 4, 3, 2, 1] and p.doc.tolist() == [0, 0, 0, 3] + [4] * 6
    assert len(np.unique(p.word)) == 10
