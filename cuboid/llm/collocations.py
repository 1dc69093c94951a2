"""Phrases whose words stand together more often than their parts would by chance, mined in shards (SON partitioning).

A phrase that occurs at least f times in the whole corpus occurs at least f / S times in one of S shards. So every shard is
mined completely at that lowered support, the phrases frequent in some shard are united, and only those are counted over
the whole corpus, exactly and by their words. Shards are a fixed number of groups of partitions, however large the
corpus is, so that the lowered support stays far above 1; tasks count pieces of a shard and Spark adds them up.

Mining counts 64-bit hashes (equal hashes of different phrases can only add candidates): first words, then pairs of
frequent words, then runs of three and more words all of whose pairs are frequent. The last count goes by the words
themselves; only within a batch of about 4 MB of text are phrases told apart by their hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuboid.llm.tables import drop, saved
from cuboid.llm.textops import HELD, Words, let_go, mix, slices


@dataclass(frozen=True)
class Mining:
    """support: occurrences of a candidate; longest: its words; top: phrases reported per language; shards: of the mining;
    block: word positions that a task counts at once; entries: hashes of candidates that a task holds at once (more take
    more passes over the texts); bits: 2**bits are the map by which runs are sought where pairs are more than entries."""

    support: int = 100
    longest: int = 5
    top: int = 2000
    shards: int = 12
    block: int = 1 << 21
    entries: int = 1 << 24
    bits: int = 30

    @property
    def local(self) -> int:
        """The lowered support: a phrase below it in every shard stays below support in all of them together."""
        return -(-self.support // self.shards)


_BLANK, _BREAK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Phrases(Words):
    """The words of a column of texts between blanks and breaks, A-Z lower-cased, with the language of each and how many
    words its piece still has from it on."""

    def __init__(self, column: pa.Array, langs: pa.Array):
        self.rows = len(column)
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + self.rows + 1]
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[base : base + size]
        self.data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.offsets = offsets - base
        broken = _BREAK[self.data]
        inside = ~(broken | _BLANK[self.data])
        cut = np.zeros(size + 1, dtype=bool)
        cut[self.offsets] = True
        self.start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | cut[:-1]))
        self.end = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | cut[1:])) + 1
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        piece = np.cumsum(broken)[self.start] if size else np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (self.doc[1:] != self.doc[:-1]), [True]))) if len(piece) else np.zeros(1, np.int64)
        self.left = np.repeat(new[1:], np.diff(new)) - np.arange(len(self.start))
        self.langs, code = _coded(langs)
        self.lang = code[self.doc]
        self.word = mix(self.hashes() + mix(np.array([_number(x) for x in self.langs], np.uint64))[self.lang]) if len(self.start) else np.zeros(0, np.uint64)

    def hashed(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the n words from each position of at, which must lie in one piece."""
        out = np.full(len(at), np.uint64(n))
        for k in range(n):
            out = out * _STEP + self.word[at + k]
        return mix(out)

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(at, at + n))


def _coded(langs: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = pc.fill_null(langs, "und").dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices)


def _number(text: str) -> int:
    """The language's part of a word's hash."""
    return int.from_bytes(text.encode()[:8], "little") ^ (len(text) << 40)


def _own() -> None:
    """Frees what other operators have left in this task's process."""
    if any(not str(k).startswith("phrases ") for k in HELD):
        let_go()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Phrases]:
    for batch in slices(batches, "text", 1 << 22, holds=True):
        column = batch.column("text").cast(pa.binary())
        try:
            column.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8 count as U+FFFD
            column = pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()]).cast(pa.binary())
        yield Phrases(column, batch.column("lang"))


def _summed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _named(texts: DataFrame, chosen: Callable[[Phrases], Iterator[tuple[np.ndarray, int]]]) -> DataFrame:
    """(lang, phrase, length, n): occurrences of the phrases at chosen positions, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own()
        held: dict[tuple[str, bytes, int], int] = {}

        def out() -> pa.RecordBatch:
            langs, phrases, lengths = zip(*held, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(lengths, pa.int32()), pa.array(held.values(), pa.int64())], names=["lang", "phrase", "length", "n"])
            held.clear()
            return made

        for p in _batches(batches):
            for at, n in chosen(p):
                _, first, count = np.unique(p.hashed(n, at), return_index=True, return_counts=True)
                for i, c in zip(at[first].tolist(), count.tolist(), strict=True):
                    key = (p.langs[p.lang[i]], p.text(i, n), n)
                    held[key] = held.get(key, 0) + c
                    if len(held) >= 1 << 18:
                        yield out()
        if held:
            yield out()

    counted = texts.mapInArrow(run, "lang string, phrase string, length int, n long")
    return counted.groupBy("lang", "phrase", "length").agg(F.sum("n").alias("n"))


def _mined(texts: DataFrame, need: Mining, chosen: Callable[[Phrases], Iterator[np.ndarray]]) -> DataFrame:
    """(hash): phrases that reach the lowered support in some shard. A partition belongs to one shard; the tasks of a shard
    add up blocks of hashes, and Spark the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own()
        shard, held, size = TaskContext.get().partitionId() % need.shards, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = _summed(held)
            held.clear()
            for k in range(0, len(keys), 1 << 17):
                part = keys[k : k + (1 << 17)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard, np.int32)), pa.array(part), pa.array(n[k : k + (1 << 17)])], names=["shard", "hash", "n"])

        for p in _batches(batches):
            for keys in chosen(p):
                held.append(keys)
                size += len(keys)
            if size >= need.block:
                yield from out()
                size = 0
        yield from out()

    counted = texts.mapInArrow(run, "shard int, hash long, n long")
    return counted.groupBy("shard", "hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= need.local).select("hash").distinct()


class Known:
    """A saved table of hashes as a sorted array that tasks load from the shared folder: range number part of parts."""

    def __init__(self, table: DataFrame, part: int = 0, parts: int = 1):
        self.path, self.part, self.parts, self.name = table.saved_at, part, parts, f"phrases {table.saved_at} {part}"

    def files(self) -> Iterator[np.ndarray]:
        from pyarrow import dataset, fs

        where, path = fs.FileSystem.from_uri(self.path)
        for batch in dataset.dataset(path, filesystem=where, format="parquet").to_batches(columns=["hash"]):
            yield batch.column(0).to_numpy().view(np.uint64)

    def load(self) -> np.ndarray:
        mine = lambda h: h[(h >> np.uint64(32)) % np.uint64(self.parts) == self.part] if self.parts > 1 else h
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *map(mine, self.files())]))

    def held(self) -> np.ndarray:
        if self.name not in HELD:
            let_go()
            HELD[self.name] = self.load()
        return HELD[self.name]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Whether each hash is one of the range's."""
        have = self.held()
        if not len(have):
            return np.zeros(len(keys), dtype=bool)
        return have[np.minimum(np.searchsorted(have, keys), len(have) - 1)] == keys


class Sieve(Known):
    """A table of any size as a map of bits, of which hashes that are not in the table may be found set."""

    def __init__(self, table: DataFrame, bits: int):
        super().__init__(table)
        self.name, self.bits = f"phrases {table.saved_at} bits", bits

    def load(self) -> np.ndarray:
        out = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        for h in self.files():
            at = h >> np.uint64(64 - self.bits)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.held()[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _ranges(table: DataFrame, need: Mining) -> list[Known]:
    """The table in as many ranges of hashes as keep each within need.entries; a pass over the texts is made for each."""
    parts = max(1, -(-table.count() // need.entries))
    return [Known(table, k, parts) for k in range(parts)]


def frequent_phrases(docs: DataFrame, need: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """Saved tables of all words (lang, phrase, n) and of the phrases of two words or more that reach the support (lang,
    phrase, length, a), with exact counts."""
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    words = saved(_named(texts, lambda p: iter([(np.arange(len(p.start)), 1)])).select("lang", "phrase", "n"))

    common = saved(_word_hashes(words.filter(F.col("n") >= need.support)))
    frequent = _ranges(common, need)
    pairs = None
    for known in frequent:  # the first word's range decides which pass counts a pair; its second word may be in any
        found = _mined(texts, need, _pairs(known, frequent))
        pairs = found if pairs is None else pairs.unionByName(found)
    pairs = saved(pairs.distinct())
    parts = _ranges(pairs, need)
    runs = saved(_mined(texts, need, _runs(parts[0] if len(parts) == 1 else Sieve(pairs, need.bits), need.longest)))
    candidates = saved(pairs.unionByName(runs).distinct(), pairs, runs, common)

    found = None
    for known in _ranges(candidates, need):
        counted = _named(texts, _members(known, need.longest)).filter(F.col("n") >= need.support)
        found = counted if found is None else found.unionByName(counted)
    return words, saved(found.withColumnRenamed("n", "a"), candidates)


def _word_hashes(words: DataFrame) -> DataFrame:
    """The hashes that Phrases gives to single words of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = Phrases(batch.column("phrase").cast(pa.binary()), batch.column("lang"))
                yield pa.RecordBatch.from_arrays([pa.array(p.word.view(np.int64))], names=["hash"])

    return words.select("lang", "phrase").mapInArrow(run, "hash long")


def _pairs(known: Known, frequent: list[Known]) -> Callable[[Phrases], Iterator[np.ndarray]]:
    def chosen(p: Phrases) -> Iterator[np.ndarray]:
        good = known(p.word)
        anywhere = good if len(frequent) == 1 else np.ones(len(p.word), dtype=bool)
        yield p.hashed(2, np.flatnonzero((p.left >= 2) & good & np.append(anywhere[1:], False)))

    return chosen


def _runs(pairs: Known, longest: int) -> Callable[[Phrases], Iterator[np.ndarray]]:
    def chosen(p: Phrases) -> Iterator[np.ndarray]:
        good = np.zeros(len(p.word) + longest, dtype=bool)
        at = np.flatnonzero(p.left >= 2)
        good[at] = pairs(p.hashed(2, at))
        every = good[: len(p.word)]
        for n in range(3, longest + 1):
            every = every & good[n - 2 : len(p.word) + n - 2] & (p.left >= n)
            yield p.hashed(n, np.flatnonzero(every))

    return chosen


def _members(known: Known, longest: int) -> Callable[[Phrases], Iterator[tuple[np.ndarray, int]]]:
    def chosen(p: Phrases) -> Iterator[tuple[np.ndarray, int]]:
        for n in range(2, longest + 1):
            at = np.flatnonzero(p.left >= n)
            yield at[known(p.hashed(n, at))], n

    return chosen


def collocations(docs: DataFrame, need: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to need.longest words that occur at least
    need.support times, by the score of their weakest cut, without those that only occur inside a longer one.

    docs: text and lang; other columns are ignored. A-Z are lower-cased; pieces end at any of ``.,;:!?`` and line ends,
    words at blanks and tabs; phrases lie within a piece. A null lang is `und`, a null text is empty. Repeated rows count
    as often as they stand; bytes that are no UTF-8 count as U+FFFD. Scores are floors of exact quotients; ties go to more occurrences, then to the smaller phrase
    in byte order. Texts without words, and no rows, give no rows. A text of any length is taken whole."""
    words, phrases = frequent_phrases(docs, need)
    parts = words.filter(F.col("n") >= need.support).unionByName(phrases.select("lang", "phrase", F.col("a").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))  # a row per language
    w = F.split("phrase", " ")
    join = lambda a: F.array_join(a, " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", "length", "a", "k", join(F.slice(w, F.lit(1), F.col("k"))).alias("first"), join(F.slice(w, F.col("k") + 1, F.col("length") - F.col("k"))).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(cast(a AS decimal(19,0)) * cast(n AS decimal(18,0)) AS decimal(38,0)) * 1000BD) div (cast(l AS decimal(19,0)) * cast(r AS decimal(18,0)))")
    scored = cuts.join(totals, "lang").withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("_c")).select("lang", "phrase", "_c.*")

    inner = phrases.filter(F.col("length") > 2).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("length") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1)))
    inner = inner.select("lang", join(F.slice(w, F.col("i"), F.col("m"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a")
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", best).filter(F.col("rank") <= need.top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
