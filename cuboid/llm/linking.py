"""From shared join keys to connected classes of similar sets, without forming all pairs of a group."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuboid.llm.components import components
from cuboid.llm.tables import drop, saved, small

#: Kinds of key rows: the set pairs with all others of its key, only with heavy ones, or is heavy itself.
ALL, LISTED, HEAVY = 0, 1, 2
WORDS = 16  # of a bitmap
SLICES = 4  # of the keys that are counted and placed at a time, if there are more than SLICED of them
SLICED = 1 << 20
PRINT = 4  # bits a member of a fingerprint, at least


def bitmap_bits(count: int) -> int:
    """Bits (as a power of two) of a bitmap that lets pass about one in 64 other keys; 2**27 at most, beyond which a
    bitmap lets more pass and the join behind it does the rest."""
    return min(27, max(16, (64 * max(count, 1)).bit_length()))


def marks(classes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits that has the low bits of every class key (cls): of fixed size at any input."""
    rows = (
        classes.select((F.pmod("cls", F.lit(1 << bits)) + 1).alias("b"))
        .groupBy(F.expr("bitmap_bucket_number(b)").alias("k"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
        .collect()
    )
    out = np.zeros((1 << bits) // 8 + 4096, dtype=np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def marked(bitmap: np.ndarray, cls: np.ndarray, bits: int) -> np.ndarray:
    b = cls & ((1 << bits) - 1)
    return ((bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def unmarked(rows: DataFrame, key: str, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key is surely not in the saved table classes (cls), or is null, and the others: all that are in it and
    about one in 64 of the rest, so that a join needs to move only these."""
    bits = bitmap_bits(classes.count())
    bitmap = rows.sparkSession.sparkContext.broadcast(marks(classes, bits))

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(marked(bitmap.value, keys.to_numpy(np.int64), bits))

    maybe = hit(F.coalesce(F.col(key).cast("long"), F.lit(0)))
    there = F.col(key).isNotNull()
    return rows.filter(~(there & maybe)), rows.filter(there & maybe)


def prints(sets: DataFrame) -> DataFrame:
    """(cls, n, bits): a bitmap of at least PRINT bits a member of each set, a power of two of them, and the set's size."""

    def run(batches):
        for batch in batches:
            found, sizes = [], []
            for m in batch.column("members"):
                x = np.frombuffer(m.as_buffer(), np.uint64)
                bits = np.zeros(1 << max(10, (PRINT * len(x) - 1).bit_length()), bool)
                bits[(x & np.uint64(len(bits) - 1)).astype(np.int64)] = True
                found.append(np.packbits(bits).tobytes())
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=["cls", "n", "bits"])

    return sets.select("cls", "members").mapInArrow(run, "cls long, n long, bits binary")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two fingerprints (bytes) differ, the longer one folded to the shorter one's length; two sets differ
    in at least as many members."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _meeting(pairs: DataFrame, values: DataFrame, room: int, fits: Callable[[np.ndarray, np.ndarray, int, int], bool]) -> DataFrame:
    """The pairs (u, v) of classes whose values fit, as a saved table. pairs and values (cls, n, value) are saved ones.

    A value travels with every pair, so pairs are taken in parts that move about room bytes each."""

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(m.as_buffer(), np.uint8) for m in batch.column(c)] for c in ("x", "y"))
            keep = [fits(*z) for z in zip(x, y, batch.column("n_u").to_pylist(), batch.column("n_v").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a = values.select(F.col("cls").alias("u"), F.col("n").alias("n_u"), F.col("value").alias("x"))
    b = values.select(F.col("cls").alias("v"), F.col("n").alias("n_v"), F.col("value").alias("y"))
    lengths = values.select(F.col("cls").alias("u"), F.length("value").alias("k"))
    moved = pairs.join(lengths, "u").agg(F.sum("k")).first()[0] or 0
    parts, out = max(1, math.ceil(moved / max(room, 1 << 20))), []
    for k in range(parts):
        some = small(pairs) if parts == 1 else pairs.filter(F.pmod(F.xxhash64("u", "v"), F.lit(parts)) == k)
        out.append(saved(a.join(some, "u").join(b, "v").mapInArrow(run, "u long, v long")))
    return out[0] if parts == 1 else saved(reduce(DataFrame.unionByName, out), *out)


def _bytes(sets: DataFrame) -> int:
    return sets.agg(F.sum(F.length("members"))).first()[0] or 0


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A saved table of the pairs that their fingerprints do not rule out: all similar ones, and a few that are less so. A
    fingerprint is 8 to 16 times smaller than its set, but for sets under 256 members."""

    def fits(x, y, n, m) -> bool:
        return apart(x, y) * (100 + percent) <= (100 - percent) * (n + m)

    values = saved(prints(sets).withColumnRenamed("bits", "value"))
    out = _meeting(pairs, values, _bytes(sets), fits)
    drop(values)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A saved table of the pairs (u, v) of classes with 100 * intersection >= percent * union. sets: (cls, members), sorted
    distinct 64-bit integers as bytes. pairs is a saved table."""

    def fits(a, b, n, m) -> bool:
        x, y = a.view(np.uint64), b.view(np.uint64)
        both = int((x[np.minimum(np.searchsorted(x, y), n - 1)] == y).sum())
        return 100 * both >= percent * (n + m - both)

    values = sets.select("cls", F.floor(F.length("members") / 8).alias("n"), F.col("members").alias("value"))
    return _meeting(pairs, values, 2 * _bytes(sets), fits)


def joining(keys: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A saved table of the distinct rows (key, cls, n, at, kind) whose key joins two classes. keys: (key) of all rows. near
    gives the rows of the keys in a saved table heads (key), and maybe others.

    Keys are counted with partial sums and joined back, so that a key with very many rows meets in no one task. Tables
    of keys grow with the input, so these joins shuffle at every size."""
    heads = saved(keys.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"))
    some = saved(near(heads).hint("merge").join(heads, "key", "left_semi").distinct(), heads, batch=20_000)
    heads = some.groupBy("key").agg(F.count("*").alias("k"), F.min("kind").alias("low"), F.max("kind").alias("top"))
    # a key without heavy sets joins nothing if all its sets are merely listed
    heads = saved(heads.filter(f"k > 1 and not (low = {LISTED} and top = {LISTED})").select("key"))
    return saved(some.hint("merge").join(heads, "key", "left_semi"), some, heads)


def of_able(found: list[DataFrame], percent: int, least: Callable[[Column], Column] = lambda n: F.lit(1)) -> DataFrame:
    """A saved table of all rows of found, tables of joining(), without the classes that have fewer such keys than a
    similar pair has in common at least (least, of the smaller set's size)."""
    every = reduce(DataFrame.unionByName, found)
    able = every.groupBy("cls", "n").agg(F.count("*").alias("k"), F.min("kind").alias("kind"))
    able = saved(able.filter((F.col("kind") == ALL) | (F.col("k") >= least(F.floor(F.col("n") * percent / 100)))).select("cls"))
    return saved(every.join(small(able), "cls", "left_semi"), *found, able)


def shared_keys(keys: DataFrame, percent: int, least: Callable[[Column], Column] = lambda n: F.lit(1)) -> DataFrame:
    """Of rows (key, cls, n, at, kind) the distinct ones whose key joins two classes, as a saved table; see joining() and
    of_able(). Keys are taken a slice at a time: most keys join nothing, and the files of one slice's shuffles go before
    the next one's come."""
    keys = saved(keys)
    slices = SLICES if keys.count() > SLICED else 1
    parts = [keys.filter(F.pmod("key", F.lit(slices)) == k) if slices > 1 else keys for k in range(slices)]
    found = [joining(mine.select("key"), lambda heads, mine=mine: mine) for mine in parts]
    drop(keys)
    return of_able(found, percent, least)


def _fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def bitmaps(sets: DataFrame) -> DataFrame:
    """(cls, b0, b1, ...): WORDS longs, a bit of which is set if a member falls on it. Where two sets' bits differ,
    the sets do."""

    def run(batches):
        for batch in batches:
            members = [np.frombuffer(m.as_buffer(), np.uint64) for m in batch.column("members")]
            bits = np.zeros((len(members), WORDS), dtype=np.uint64)
            for k, m in enumerate(members):
                np.bitwise_or.at(bits[k], (m >> np.uint64(60)).astype(np.int64) % WORDS, np.uint64(1) << ((m >> np.uint64(54)) & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), *[pa.array(bits[:, i].copy().view(np.int64)) for i in range(WORDS)]], names=["cls", *[f"b{i}" for i in range(WORDS)]])

    return sets.select("cls", "members").mapInArrow(run, "cls long, " + ", ".join(f"b{i} long" for i in range(WORDS)))


def link(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A saved table (node, root) of the classes that similar pairs connect; shared comes from shared_keys.

    Every class is first compared with one class of its keys: the one whose keys hold most rows, which is in the midst
    of its group (the common origin of changed copies, say). That connects most of a large group with a link per
    class. Then all pairs of classes that share a key and are still in different components are compared, but for
    those that the sizes, the rank of a common member, the bitmaps or the fingerprints rule out. So no similar pair is
    lost."""
    heads = saved(shared.groupBy("key").agg(F.count("*").alias("m")))
    weight = saved(shared.hint("merge").join(heads, "key").groupBy("cls").agg(F.sum("m").alias("m")), heads)
    ranked = saved(shared.select("key", "cls", "n").join(small(weight), "cls"), weight)
    tops = saved(ranked.groupBy("key").agg(F.max(F.struct("m", "cls", "n")).alias("top")).select("key", F.col("top.cls").alias("v"), F.col("top.n").alias("n_v")))
    stars = ranked.hint("merge").join(tops, "key").filter((F.col("cls") != F.col("v")) & _fits(F.col("n"), F.col("n_v"), percent))
    stars = saved(stars.groupBy("cls", "v").agg(F.count("*").alias("k")), ranked, tops)
    stars = saved(stars.groupBy("cls").agg(F.max_by("v", F.struct("k", "v")).alias("v")).select(F.col("cls").alias("u"), "v"), stars)
    links = verified(stars, sets, percent)
    drop(stars)
    roots = components(links)
    named = shared.join(small(roots), F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
    rows = saved(named)
    mixed = saved(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key"))
    rest = saved(rows.hint("merge").join(mixed, "key", "left_semi"), rows, mixed)
    bits = saved(bitmaps(sets))
    both = saved(rest.join(bits, "cls"), rest, bits)
    a, b = (both.select("key", *[F.col(c).alias(f"{c}_{x}") for c in both.columns if c != "key"]) for x in "ab")
    total = F.col("n_a") + F.col("n_b")
    # the first common member bounds the intersection by what comes after it in either set
    most = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    differ = reduce(add, (F.bit_count(F.col(f"b{i}_a").bitwiseXOR(F.col(f"b{i}_b"))) for i in range(WORDS)))
    pairs = a.join(b, "key").filter((F.col("cls_a") < F.col("cls_b")) & (F.col("root_a") != F.col("root_b")))
    pairs = pairs.filter((most * (100 + percent) >= percent * total) & (differ * (100 + percent) <= (100 - percent) * total))
    pairs = saved(pairs.select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v")).distinct(), both)
    # these bitmaps are full for large sets, so chance pairs of them, which grow faster than the input, are still here
    close = likely(pairs, sets, percent)
    more = verified(close, sets, percent)
    drop(pairs, close)
    out = components(links.unionByName(more)) if more.take(1) else None
    drop(links, more)
    if out is None:
        return roots
    drop(roots)
    return out
