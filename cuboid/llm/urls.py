"""URL filters: exact membership in a listed set by a cascade of Bloom filters.

A url asks for every (host suffix, path prefix) that a rule could have. The universe is every such key of the corpus.
Level 1 encodes the listed keys; level 2 the other keys of the universe that level 1 takes for listed; level 3 the
listed keys that level 2 takes for those, and so on until a level makes no mistake. A key of the universe is listed if
the first level that rejects it is an even one (counted from 1), or if none rejects it and their number is odd.
Judging urls then needs the filters' bits only, no join. Lists whose filters would take too much memory are dealt
over shards by the keys' hash; shards are judged one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.llm.tables import add_columns, drop, fresh, saved, small
from cuboid.llm.textops import mix


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # uint8
    size: int  # bits
    hashes: int
    seed: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for k in range(self.hashes):
            at = _slot(keys, self.seed, k, self.size)
            out &= ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return out


def _slot(keys: np.ndarray, seed: int, k: int, size: int) -> np.ndarray:
    salt = np.uint64((seed * 131 + k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(keys.view(np.uint64) ^ salt) % np.uint64(size)).astype(np.int64)


class Cascade:
    """Levels of one listed set. Bits per listed key: about 1.44 log2 of the universe's size over the list's, and
    about 3 for the further levels."""

    def __init__(self, levels: Sequence[Level]):
        self.levels = list(levels)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key of the universe (64-bit hashes) is listed."""
        out = np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        for n, level in enumerate(self.levels, 1):
            hit = level.has(keys[left])
            out[left[~hit]] = n % 2 == 0
            left = left[hit]
        out[left] = len(self.levels) % 2 == 1
        return out


def _rate(n_yes: int, n_no: int) -> float:
    """Of the first level, which then leaves about as many mistakes as there are listed keys."""
    return min(0.5, max(1e-9, n_yes / max(n_no, 1) / math.sqrt(2)))


def shards(n_yes: int, n_no: int, max_bytes: int) -> int:
    """How many shards keep a cascade within max_bytes, about."""
    bits = n_yes * (1.44 * math.log2(1 / _rate(n_yes, n_no)) + 3)
    return max(1, math.ceil(bits / 8 / max_bytes))


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A Bloom filter over keys (key), its bits set by Spark in blocks of 32768."""
    size = max(64, math.ceil(count * math.log(1 / rate) / math.log(2) ** 2))
    hashes = max(1, round(math.log2(1 / rate)))

    def slots(batches):
        for batch in batches:
            key = np.ascontiguousarray(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_slot(key, seed, k, size) for k in range(hashes)]))], names=["at"])

    rows = (
        keys.select("key").mapInArrow(slots, "at long")
        .groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bits"))
        .collect()
    )
    bits = np.zeros(-(-size // 32768) * 4096, dtype=np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        bits[at : at + 4096] |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return Level(bits, size, hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of listed among universe (both: key, distinct 64-bit hashes). Listed keys that the universe lacks
    take no room. The two sets shrink from level to level, so the number of levels is logarithmic."""
    spark = universe.sparkSession
    yes = saved(listed.join(universe, "key", "left_semi"))
    no = saved(universe.join(small(yes), "key", "left_anti"))
    n_yes, n_no = yes.count(), no.count()
    levels: list[Level] = []
    while n_yes:
        level = _level(yes, n_yes, 0.5 if levels else _rate(n_yes, n_no), len(levels))
        levels.append(level)
        test = spark.sparkContext.broadcast(level)

        def wrong(batches, test=test):
            for batch in batches:
                yield batch.filter(pa.array(test.value.has(np.ascontiguousarray(batch.column(0).to_numpy()))))

        caught = saved(no.mapInArrow(wrong, "key long"), no)
        test.unpersist()
        yes, no = caught, yes  # next: encode the mistakes, test the listed
        n_yes, n_no = caught.count(), n_yes
    drop(yes, no)
    return Cascade(levels)


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path) of a url column: the host after the first :// up to /, ? or # with A-Z lower-cased, the path from
    there up to ? or #. Without :// or for null both are empty."""
    u = F.col(url) if isinstance(url, str) else url
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def _candidates(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """All rules that could fit, longest first: by characters, then the longer host."""
    if not host:
        return []
    labels = host.split(".")
    suffixes = [".".join(labels[k:]) for k in range(len(labels))]
    found = {(s, path[:n]) for s in suffixes for n in lengths if n <= len(path)}
    return [s + p for s, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0]), x))]


def _hash(keys: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 7) for k in keys], dtype=np.uint64).view(np.int64)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", keep: list[str] | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    rules: (host and path, verdict); a rule fits its host and all subdomains if the path starts with the rule's, and
    the longest one wins (a rule that is listed with both verdicts allows). A url that no rule fits has a null rule and
    is allowed, as its keys are not listed; so are null urls and urls without ://. Rows are judged one by one, urls of
    any length whole; repeated rows get equal verdicts. Cascades that would take more than max_bytes are cut into
    shards, each broadcast and judged in a pass of its own. New columns replace input columns of the same name. An
    empty table gives an empty result."""
    spark = pages.sparkSession
    for text, verdict in rules:
        if verdict not in ("allow", "block") or "/" not in text:
            raise ValueError(f"not a rule: {text!r}, {verdict!r}")
    lengths = sorted({len(text) - text.index("/") for text, _ in rules})
    host, path = split_url(url)
    names = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict")]
    source = fresh([*names, "host", "path", "rule", "verdict"], "_url")
    parts = pages.select(*names, F.col(url).alias(source), host.alias("host"), path.alias("path"))
    # keys need the path's first characters only; the same few repeat over the corpus
    short = parts.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct()

    def keys(batches):
        for batch in batches:
            made = [k for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in _candidates(h, p, lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(_hash(sorted(set(made))), pa.int64())], names=["key"])

    universe = saved(short.mapInArrow(keys, "key long").distinct())
    listed = {v: saved(spark.createDataFrame([(int(k),) for k in _hash(sorted({t for t, w in rules if w == v}))], "key long")) for v in ("allow", "block")}
    size = universe.count()
    count = max(shards(x.count(), size, max_bytes) for x in listed.values())
    out = parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    for shard in range(count):
        mine = F.pmod(F.xxhash64("key"), F.lit(count)) == shard
        cascades = {v: build_cascade(x.filter(mine), universe.filter(mine)) for v, x in listed.items()}
        filters = spark.sparkContext.broadcast(cascades)

        def work(batch: pa.RecordBatch, filters=filters) -> dict[str, pa.Array]:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            asked = [_candidates(h, p, lengths) for h, p in zip(hosts, paths, strict=True)]
            keys = _hash([k for a in asked for k in a]) if any(asked) else np.zeros(0, np.int64)
            found = {v: c.has(keys) for v, c in filters.value.items()}
            rule, verdict, at = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist(), 0
            for row, a in enumerate(asked):
                best = a.index(rule[row]) if rule[row] is not None else len(a)  # of earlier shards
                for k, text in enumerate(a[:best]):
                    if found["block"][at + k] or found["allow"][at + k]:
                        rule[row], verdict[row] = text, "allow" if found["allow"][at + k] else "block"
                        break
                at += len(a)
            return {"host": batch.column("host"), "path": batch.column("path"), "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())}

        last = shard == count - 1
        made = add_columns(out, "host string, path string, rule string, verdict string", work, source, names if last else [*names, source])
        if last:
            drop(universe, *listed.values())
            return made
        out = saved(made, *([out] if shard else []))
        filters.unpersist()
