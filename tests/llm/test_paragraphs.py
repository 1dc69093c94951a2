"""Substring dedup: keys made with the lines, keys that stand once stay where they are, batches are cut as texts alone."""

import random

import numpy as np
from pyspark.sql import functions as F

from cuboid.llm import linking, paragraphs, tables, textops


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_least_is_the_first_smallest():
    values = np.random.default_rng(1).integers(0, 6, 300).astype(np.uint64)
    for n in (1, 2, 3, 8, 13, 16):
        low, place = textops.least(values, n)
        assert place.tolist() == [k + int(values[k : k + n].argmin()) for k in range(len(values) - n + 1)]
        assert (low == values[place]).all()


def test_keys_that_stand_once_are_not_moved(spark, monkeypatch):
    rng, p = random.Random(7), paragraphs.Bands()
    texts = [sentence(rng, 60) for _ in range(60)]
    texts += [f"{texts[0]}\n{texts[1]} more", texts[2], "short", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lines, moved, old = tables.saved(paragraphs._lines(docs, p, "id", "text")), [], paragraphs._near
    monkeypatch.setattr(paragraphs, "_near", lambda *a: (moved.append(old(*a).count()), old(*a))[1])
    names = ["key", "cls", "n", "at", "kind"]
    keys = lines.select(F.explode(F.array(*[f"k{b}" for b in range(p.bands)])).alias("key"), "cls", "n", F.lit(1).alias("at"), F.lit(linking.ALL).cast("byte").alias("kind")).filter("key is not null")
    want = sorted(map(tuple, linking.shared_keys(keys, p.percent).select(*names).collect()))
    assert want and sorted(map(tuple, paragraphs._shared(lines, p).select(*names).collect())) == want
    assert moved[0] < 200  # about 60 * 16 before
    monkeypatch.setattr(paragraphs, "SLICED", 0)
    assert sorted(map(tuple, paragraphs._shared(lines, p).select(*names).collect())) == want
    assert len(moved) == 1 + linking.SLICES


def test_rows_of_a_batch_are_cut_as_if_alone(spark):
    rng = random.Random(9)
    passage, line = sentence(rng, 40), sentence(rng, 30)
    own = [sentence(rng, 25) for _ in range(5)]
    rows = [(1, f"{own[0]} é {passage}\n{line}"), (2, f"{own[1]}\n{line}\n{passage} end"), (2, own[2]), (3, "ü"), (4, ""), (5, f"{own[3]} ß {passage} {own[4]}")]
    got = {(r.doc_id, r.n_removed): r for r in paragraphs.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[1, 0].text == rows[0][1] and got[2, 0].text == own[2] and got[3, 0].text == "ü" and got[4, 0].text == ""
    assert got[2, 70].text == f"{own[1]}\nend" and got[2, 70].removed_lines == [1] and got[2, 70].kept_in == [1]
    assert got[5, 40].text == f"{own[3]} ß {own[4]}" and got[5, 40].kept_in == [1] and got[5, 40].removed_lines == []
