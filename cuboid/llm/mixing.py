"""Mixing sources to target weights by pivotal dependent rounding.

Every document's number of copies is floor(r) or floor(r) + 1, r being its source's target over its size. The
fractional parts are rounded dependently: two open documents of a source at a time exchange mass, in words, until one
of them is integral, so a source's words stay exact until a single document is left open. Every exchange keeps the
expectation of both. A document so large that one partner cannot take its mass is paired with the pool of all smaller
open ones, which share what moves so that each keeps its expectation. Tasks do this for buckets of a source; the
documents they leave open, one a bucket, meet in the next level of a reduction tree, with fresh coins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuboid.llm.tables import drop, fresh, saved
from cuboid.llm.textops import mix


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code-point order (null last), repeating. repeats: a target stops at so many times
    its source's size, and a document at so many copies. bucket_rows: documents of a first-level bucket, about.
    fan_in: buckets that meet in the next level."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    repeats: int = 3
    bucket_rows: int = 5_000
    fan_in: int = 64
    seed: int = 17


def targets(sizes: DataFrame, m: Mix, source: str) -> DataFrame:
    """(source, source_size, docs, target), a row a source: water filling. Sources fill up in the order of
    their limit over their weight; a prefix of that order is full, the others share the rest by weight."""
    weights = F.array(*[F.lit(float(w)) for w in m.weights])
    one = Window.orderBy(F.col(source).asc_nulls_last())
    t = sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    t = t.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(one) - 1, F.lit(len(m.weights)))))
    t = t.withColumn("cap", F.lit(m.repeats) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / share)
    # the first source that is not full sets the level of all after it
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return t.select(F.col(source), "source_size", "docs", target.alias("target"))


def _round(size: np.ndarray, share: np.ndarray, key: np.ndarray, seed: int, level: int, last: bool) -> np.ndarray:
    """Rounds the open fractions of one bucket: a single one stays open at most, and none if last."""
    # large documents first, so that a small one stays open at the end
    order = np.lexsort((share, key, -size))
    size, share, key = size[order], share[order].copy(), key[order]
    coin = mix(mix(key.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) + np.uint64(level + 1)) / 2.0**64

    def settle(k) -> None:
        share[k] = np.where(share[k] < 1e-9, 0.0, np.where(share[k] > 1 - 1e-9, 1.0, share[k]))

    start, total = 0, size.sum()
    while start < len(share) - 1 and 200 * size[start] >= total:
        p, a, pool = share[start], size[start], share[start + 1 :]
        room = (size[start + 1 :] * pool * (1 - pool)).sum()
        if 0 < p < 1 and room > 0:
            # the pool loses (1 - p) a words with probability p and gains p a words otherwise
            part = (1 - p) * a / room
            if (part * (1 - pool) <= 1).all() and (part * p / (1 - p) * pool <= 1).all():
                takes = coin[start] < p
                pool += pool * (1 - pool) * part * (-1.0 if takes else p / (1 - p))
                share[start] = float(takes)
                settle(slice(start + 1, None))
        start += 1
    i = -1  # the open document
    for j in range(len(share)):
        if not 0 < share[j] < 1:
            continue
        if i < 0:
            i = j
            continue
        a, b = size[i], size[j]  # words; mass d moves as share + d / size
        up = min((1 - share[i]) * a, share[j] * b)
        down = min(share[i] * a, (1 - share[j]) * b)
        d = up if coin[j] * (up + down) < down else -down  # keeps the expectation of both
        share[i], share[j] = share[i] + d / a, share[j] - d / b
        settle([i, j])
        i = j if 0 < share[j] < 1 else i if 0 < share[i] < 1 else -1
    if last and i >= 0:
        # the coin of a pairing has been used
        share[i] = float(mix(np.array([key[i]]).view(np.uint64) + np.uint64(seed))[0] / 2.0**64 < share[i])
    out = np.empty_like(share)
    out[order] = share
    return out


def _rounding(names: dict[str, str], seed: int, level: int, last: bool):
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        size, share, key = (frame[names[x]].to_numpy() for x in ("size", "share", "key"))
        return frame.assign(**{names["share"]: _round(size, share, key, seed, level, last)})

    return work


def mix_sources(docs: DataFrame, size: str, m: Mix = Mix(), doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with source_size, target (of its source) and copies, the number of times the mix takes each row.

    size names a column of words per document (null or negative: 0). A source without words has target 0. Documents
    without words get no copies. A null source is a source of its own. Coins depend on doc_id, the size and the seed
    only, so reruns agree; rows that are equal in these and the source may swap their verdicts. New columns replace
    input columns of the same name; others cannot clash. An empty table gives an empty result."""
    spark = docs.sparkSession
    docs = docs.drop("source_size", "target", "copies")
    c = {k: fresh([*docs.columns, "source_size", "target", "copies"], f"_{k}") for k in ("source", "docs", "size", "ratio", "base", "share", "key", "bucket")}
    own = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    goals = saved(targets(docs.select(F.col(source).alias("source"), own.alias("size")), m, "source"))
    goal = goals.select(F.col("source").alias(c["source"]), "source_size", F.col("docs").alias(c["docs"]), "target")
    rows = docs.withColumn(c["size"], own).join(goal, F.col(source).eqNullSafe(F.col(c["source"])), "left").drop(c["source"])
    ratio = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)), F.lit(float(m.repeats)))
    rows = rows.withColumn(c["ratio"], F.when(F.col(c["size"]) > 0, ratio).otherwise(0.0))
    key = F.xxhash64(F.lit(m.seed), F.col(doc_id), F.col(c["size"]))
    rows = rows.withColumns({c["base"]: F.floor(c["ratio"]), c["share"]: F.col(c["ratio"]) - F.floor(c["ratio"]), c["key"]: key})
    buckets = F.greatest(F.ceil(F.col(c["docs"]) / m.bucket_rows), F.lit(1))
    rows = rows.withColumn(c["bucket"], F.pmod(F.xxhash64(F.col(c["key"])), buckets)).drop(c["docs"], c["ratio"])

    widest = goals.agg(F.max("docs").alias("n")).first()["n"] or 0
    count, level = max(1, math.ceil(widest / m.bucket_rows)), 0
    done = []
    while True:
        last = count == 1
        now = saved(rows.groupBy(source, c["bucket"]).applyInPandas(_rounding(c, m.seed, level, last), rows.schema))
        is_open = (F.col(c["share"]) > 0) & (F.col(c["share"]) < 1)
        done.append(now.filter(~is_open))
        if last:
            break
        rows = now.filter(is_open).withColumn(c["bucket"], F.floor(F.col(c["bucket"]) / m.fan_in))
        count, level = math.ceil(count / m.fan_in), level + 1
    drop(goals)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("copies", (F.col(c["base"]) + F.col(c["share"])).cast("int")).drop(*(c[k] for k in ("size", "base", "share", "key", "bucket")))


def word_count(text: str):
    """The number of words of a text column (null: 0), as a Spark expression."""
    # words begin where a character that is not white space follows white space or the start
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, m: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed documents: docs with every row repeated as often as the mix takes it (rows taken 0 times go).

    A null text has no words, and documents without words are taken 0 times. A null source is a source of its own. Rows
    equal in doc_id, source and words share what they got together, in the order of their texts. Other columns stay
    as they are, whatever their names. Very long texts are counted whole. An empty table gives an empty result."""
    names = docs.columns
    words, i, s, n, k, x = (fresh(names, f"_{c}") for c in ("words", "id", "source", "size", "copies", "copy"))
    sized = docs.withColumn(words, word_count(text))
    light = sized.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(words).alias("size"))
    taken = mix_sources(light, "size", m).groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(n))
    taken = saved(taken.agg(F.sum("copies").alias(k), F.count("*").alias(x)).filter(F.col(k) > 0))
    same = F.col(doc_id).eqNullSafe(F.col(i)) & F.col(source).eqNullSafe(F.col(s)) & (F.col(words) == F.col(n))
    # both sides grow with the input: texts are shuffled once, at every size
    out = sized.hint("merge").join(taken.filter(F.col(x) == 1).drop(x), same).select(*names, k)
    if taken.filter(F.col(x) > 1).take(1):  # only rows that share an id, a source and a size are ordered
        some = sized.join(taken.filter(F.col(x) > 1), same)
        at = F.row_number().over(Window.partitionBy(i, s, n).orderBy(text))
        part = lambda a: F.floor(a * F.col(k) / F.col(x))
        out = out.unionByName(some.withColumn(k, part(at) - part(at - 1)).select(*names, k).filter(F.col(k) > 0))
    return out.withColumn(x, F.explode(F.sequence(F.lit(1), F.col(k).cast("int")))).select(*names)
