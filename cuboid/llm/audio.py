"""Media columns: chroma fingerprints of audio, and a search that aligns recordings.

A recording's spectrogram is folded into 12 pitch classes a frame. Rectangle filters over an integral image of these
frames give two bits each, 16 filters a 32-bit integer per frame. Frames whose integers agree outside one of four groups of filters vote for
an offset; every offset with enough votes is verified by the share of bits that differ where the two overlap.
Recordings with equal fingerprints are one class, and classes are compared, not copies.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuboid.llm.tables import add_columns, saved
from cuboid.llm.textops import HELD, give_back, let_go, mix, signed


@dataclass(frozen=True)
class Chroma:
    """rate: samples a second that recordings are expected to have. frame, hop: samples. low, high: Hz that count.
    run: integers in a row that make a vote, of which a quarter of the bits can differ. votes: least frames that vote for
    an offset. errors: largest share of bits that differ. overlap: least frames that two recordings share at an offset."""

    rate: int = 4000
    frame: int = 2048
    hop: int = 256
    low: float = 100.0
    high: float = 1800.0
    run: int = 1
    votes: int = 4
    errors: float = 0.15
    overlap: int = 32


WIDTH = 8  # frames under a filter


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the 16 filters, by rule."""
    first = [(7 * k) % 11 for k in range(16)]
    return [(k % 4, y, min(2 + (5 * k) % 6, 12 - y) if k % 2 else 12 - y, 2 + 2 * (k // 4)) for k, y in enumerate(first)]


@cache
def _folding(c: Chroma) -> tuple[np.ndarray, slice, np.ndarray]:
    """The window, the frequencies that count and the pitch class of each."""
    hz = np.fft.rfftfreq(c.frame, 1 / c.rate)
    at = np.flatnonzero((hz >= c.low) & (hz <= min(c.high, c.rate / 2)))
    pitch = np.round(12 * np.log2(hz[at] / 440.0)).astype(int) % 12
    fold = np.zeros((len(at), 12))
    fold[np.arange(len(at)), pitch] = 1
    return np.hanning(c.frame).astype(np.float32), slice(at[0], at[-1] + 1) if len(at) else slice(0), fold


def chroma(samples: np.ndarray, c: Chroma) -> np.ndarray:
    """Frames by 12 pitch classes, each frame scaled to length 1 (silent frames: zeros)."""
    if len(samples) < c.frame:
        return np.zeros((0, 12))
    window, at, fold = _folding(c)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), c.frame)[:: c.hop]
    power = np.empty((len(frames), len(fold)))
    for k in range(0, len(frames), 16):  # a few frames stay in the processor's cache
        waves = np.fft.rfft((frames[k : k + 16] * window).astype(np.float64), axis=1)
        power[k : k + 16] = np.abs(waves[:, at].astype(np.complex64)) ** 2
    out = power @ fold
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-6, out / np.maximum(size, 1e-12), 0.0)


def fingerprint(samples: np.ndarray, c: Chroma) -> np.ndarray:
    """A 32-bit integer per position of the filters: 16 Gray-coded values of two bits."""
    image = chroma(samples, c)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    sums = np.zeros((13, len(image) + 1))  # a row a pitch class: filters read runs of frames
    sums[1:, 1:] = image.cumsum(0).cumsum(1).T

    def area(t0, t1, y0, y1):
        return sums[y1, t1 : t1 + n] - sums[y1, t0 : t0 + n] - sums[y0, t1 : t1 + n] + sums[y0, t0 : t0 + n]

    pairs = np.empty((2, 16, n))
    for k, (kind, y, h, w) in enumerate(_filters()):
        y2, half, mid = y + h, w // 2, y + (h + 1) // 2
        if kind == 0:  # low classes against high ones
            a, b = area(0, w, y, mid), area(0, w, mid, y2)
        elif kind == 1:  # before against after
            a, b = area(0, half, y, y2), area(half, w, y, y2)
        elif kind == 2:  # diagonals
            a, b = area(0, half, y, mid) + area(half, w, mid, y2), area(0, half, mid, y2) + area(half, w, y, mid)
        else:  # a band against all classes
            a, b = area(0, w, y, y2), area(0, w, 0, 12) * (y2 - y) / 12
        pairs[:, k] = a, b
    value = np.log((1e-2 + pairs[0]) / (1e-2 + pairs[1]))
    level = (value > -0.7).astype(np.uint32) + (value > 0) + (value > 0.7)
    out = np.zeros(n, dtype=np.uint32)
    for gray in level ^ (level >> np.uint32(1)):
        out = (out << np.uint32(2)) | gray.astype(np.uint32)
    return out


def read_wav(data: bytes | None) -> np.ndarray:
    """The first channel of 16-bit PCM as numbers within 1; none for null, empty or other data."""
    if not data:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0)
            return np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")[:: w.getnchannels()] / 32768.0
    except (wave.Error, EOFError):
        return np.zeros(0)


def pcm(samples: np.ndarray) -> np.ndarray:
    """Numbers within 1 as 16-bit PCM."""
    return (np.clip(samples, -1, 1) * 32767).astype("<i2")


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """Numbers within 1, or 16-bit PCM, as a recording."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((samples if samples.dtype == "<i2" else pcm(samples)).tobytes())
    return out.getvalue()


def add_fingerprints(media: DataFrame, wav: str = "wav", c: Chroma = Chroma(), keep: list[str] | None = None) -> DataFrame:
    """media with codes (array of int) and class_key (a hash of codes; null without codes).

    Null, empty, broken and too short recordings have no codes. Rows are worked on one by one, whole; new columns
    replace input columns of the same name. An empty table gives an empty result."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codes = [fingerprint(read_wav(x), c) for x in batch.column(wav).to_pylist()]
        keys = [_key(x) if len(x) else None for x in codes]
        return {"codes": pa.array([x.view(np.int32) for x in codes], pa.list_(pa.int32())), "class_key": pa.array(keys, pa.int64())}

    return add_columns(media, "codes array<int>, class_key long", work, wav, keep)


def _key(codes: np.ndarray) -> int:
    at = np.arange(1, len(codes) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(signed(mix(mix(codes.astype(np.uint64) + at).sum(dtype=np.uint64, keepdims=True)))[0])


#: Four sub-keys of 24 bits: each leaves out another quarter of the filters, so that some bit errors keep one intact.
MASKS = [np.uint32(sum(3 << 2 * k for k in range(16) if k % 4 != part)) for part in range(4)]


def sub_keys(codes: np.ndarray, starts: np.ndarray, c: Chroma) -> tuple[np.ndarray, np.ndarray]:
    """All sub-keys of recordings that begin at starts of codes, and the position of each, ascending within a mask."""
    n = len(codes) - c.run + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.ones(n, dtype=bool)  # integers in a row are of one recording
    for k in range(1, c.run):
        over = starts[1:] - k
        whole[over[(over >= 0) & (over < n)]] = False
    at, out = np.flatnonzero(whole), []
    for part, mask in enumerate(MASKS):
        x = (codes & mask).astype(np.uint64)
        h = np.full(len(at), np.uint64(part + 1))
        for k in range(c.run):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[at + k])
        out.append(h)
    return np.concatenate(out), np.tile(at, len(MASKS))


def ragged(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 ... counts[0] of them, then those of first[1] and so on."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Asked:
    """Recordings to be found, given by their keys, codes one after the other and sizes, and where in them every sub-key is."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, size: np.ndarray, c: Chroma):
        self.keys, self.codes, self.size, self.c = keys, codes, size, c
        self.first = np.cumsum(size) - size
        self.owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        sub, at = sub_keys(self.codes, self.first, c)
        order = np.argsort(sub, kind="stable")
        sub, at = sub[order], at[order].astype(np.int32)
        new = np.ones(len(sub), dtype=bool)
        new[1:] = sub[1:] != sub[:-1]
        own = self.owner[at]
        keep = new.copy()  # of a recording's equal sub-keys the first frame counts
        keep[1:] |= own[1:] != own[:-1]
        self.sub, self.at = sub[new], at[keep]
        self.start = np.append(np.flatnonzero(new[keep]), len(self.at))

    def matches(self, keys: np.ndarray, codes: np.ndarray, size: np.ndarray, hits: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
        """(query_key, class_key, offset, errors) of the queries that align with recordings, given by their keys, codes
        one after the other and sizes: of all offsets with enough votes the one with the fewest errors (ties: the smaller).

        Recordings with about so many hits (one at least) are worked on at a time."""
        first = np.cumsum(size) - size
        sub, at = sub_keys(codes, first, self.c)
        if not len(sub) or not len(self.sub):
            return
        order = np.argsort(sub)  # neighbours are looked up one after the other
        where = np.searchsorted(self.sub, sub[order])
        found = self.sub[np.minimum(where, len(self.sub) - 1)] == sub[order]
        where, at = where[found], at[order[found]]
        # by recording and sub-key, the first frame
        owner = np.repeat(np.arange(len(size)), size)
        ids = np.sort((owner[at] * len(self.sub) + where) * len(codes) + at)
        group, at = ids // len(codes), ids % len(codes)
        new = np.ones(len(ids), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        where, at = group[new] % len(self.sub), at[new]
        lo, n = self.start[where], self.start[where + 1] - self.start[where]
        ends = np.searchsorted(owner[at], np.arange(len(size)), side="right")
        total = np.concatenate(([0], np.cumsum(n)))[ends]
        k = 0
        while k < len(size):
            done, begin = (total[k - 1], ends[k - 1]) if k else (0, 0)
            k = max(k + 1, int(np.searchsorted(total, done + hits, side="right")))
            part = slice(begin, ends[k - 1])
            if total[k - 1] - done:
                yield from self._aligned(keys, codes, size, first, owner, at[part], lo[part], n[part])

    def _aligned(self, keys, codes, size, first, owner, at, lo, n) -> Iterator[tuple[np.ndarray, ...]]:
        """matches() of the hits of a few recordings: a sub-key at position at of codes has n places from lo on."""
        # hits are counted by a hash of recording, query and offset; only where enough meet are votes told apart
        q = self.at[ragged(n, lo)]
        mine = owner[at]
        buckets = 1 << max(10, int(2 * len(q)).bit_length())
        spot = q - np.repeat(at - first[mine] - mine * 0x9E3779B1, n)
        spot &= buckets - 1
        often = np.flatnonzero((np.bincount(spot, minlength=buckets) >= self.c.votes)[spot])
        q, at = q[often].astype(np.int64), np.repeat(at, n)[often]
        # a frame votes once, however many sub-keys agree
        votes = np.sort(q * len(codes) + at)
        votes = votes[np.append(votes[:1] >= 0, votes[1:] != votes[:-1])]
        q, at = votes // len(codes), votes % len(codes)
        asked, mine = self.owner[q].astype(np.int64), owner[at]
        low, step = int(size.max()), int(size.max() + self.size.max())
        ids, n = np.unique((mine * len(self.size) + asked) * step + (q - self.first[asked]) - (at - first[mine]) + low, return_counts=True)
        ids = ids[n >= self.c.votes]
        pair, offset = ids // step, ids % step - low
        mine, asked = pair // len(self.size), pair % len(self.size)
        a, b = np.maximum(offset, 0), np.maximum(-offset, 0)
        n = np.minimum(self.size[asked] - a, size[mine] - b)
        good = np.flatnonzero((n >= self.c.overlap) & (self.keys[asked] != keys[mine]))
        errors = np.zeros(len(ids), dtype=np.int64)
        a, b = a + self.first[asked], b + first[mine]
        # half of the frames rules out most
        for begin, end in ((np.zeros_like(n), n // 2), (n // 2, n)):
            for part in np.array_split(good, 1 + int(n[good].sum()) // (1 << 20)):
                if len(part):
                    m = (end - begin)[part]
                    differ = np.bitwise_count(self.codes[ragged(m, (a + begin)[part])] ^ codes[ragged(m, (b + begin)[part])])
                    errors[part] += np.diff(np.append(0, np.cumsum(differ, dtype=np.int64))[np.append(0, np.cumsum(m))])
            good = good[errors[good] / (32 * n[good]) <= self.c.errors]
        share = errors[good] / (32 * n[good])
        good, share = (x[np.lexsort((offset[good], share, pair[good]))] for x in (good, share))
        best = np.ones(len(good), dtype=bool)
        best[1:] = pair[good[1:]] != pair[good[:-1]]
        good, share = good[best], share[best]
        if len(good):
            yield self.keys[asked[good]], keys[mine[good]], offset[good], share


def columns(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, codes one after the other and sizes of rows (class_key, codes)."""
    codes = batch.column("codes")
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    size = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column("class_key").to_numpy(), codes.flatten().to_numpy().view(np.uint32), size


def align(prints: DataFrame, queries: DataFrame, c: Chroma = Chroma(), limit: int = 1_000_000) -> DataFrame:
    """(query_key, class_key, offset, errors): the classes that align with a query class, each pair at its best
    offset (frames that the match starts later in the query), a class with itself left out.

    prints: (class_key, codes), one row a class; queries: some of its class_keys. Queries are broadcast in passes of
    about limit integers, and votes are counted where a class is read, so that no vote is shuffled. Votes grow with the
    product of classes and queries."""
    spark, prints = prints.sparkSession, prints.filter("class_key is not null")
    asked = saved(prints.select("class_key", "codes").join(queries.select("class_key"), "class_key", "left_semi"))
    total = asked.agg(F.sum(F.size("codes"))).first()[0] or 0
    passes = -(-total // limit)
    schema = "query_key long, class_key long, offset int, errors double"
    out = spark.createDataFrame([], schema)
    for k in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("class_key"), F.lit(passes)) == k).toArrow()
        if not part.num_rows:
            continue
        sent, name = spark.sparkContext.broadcast(columns(part)), f"recordings {uuid.uuid4().hex}"

        def run(batches, sent=sent, name=name):
            for batch in batches:
                if name not in HELD:
                    let_go()
                    HELD[name] = Asked(*sent.value, c)
                for found in HELD[name].matches(*columns(batch)):
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types, strict=True)], names=["query_key", "class_key", "offset", "errors"])
            give_back()

        out = out.unionByName(saved(prints.select("class_key", "codes").mapInArrow(run, schema), split=8 << 20))
        sent.unpersist()
    return out


def melodies(vectors: DataFrame, note: int = 512, rate: int = 4000, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_column, wav): recordings that Spark derives from vectors, a note per value (its pitch rises with the value,
    three octaves over -0.55 to 0.55). The first id % 4 notes are left out, so that copies of a vector begin at
    different times. A null or empty vector gives an empty recording, a null value a rest. A recording is much longer
    than its vector, so the vectors are dealt out evenly first, however few parts their file can be read in."""
    parts = 4 * vectors.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        t = np.arange(note) / rate
        edge = np.minimum(1, np.minimum(np.arange(note), np.arange(note)[::-1]) / 40)
        tones = np.array([pcm(0.5 * edge * np.sin(2 * np.pi * 130.81 * 2 ** (s / 12) * t)) for s in range(37)] + [pcm(np.zeros(note))])
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                wavs = []
                for i, v in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False) if v.is_valid else [], dtype=np.float64)
                    steps = np.where(np.isnan(x), 37, np.clip(np.rint((x + 0.55) / 1.1 * 36), 0, 36)).astype(int)[(i or 0) % 4 :]
                    wavs.append(write_wav(tones[steps].ravel(), rate))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(wavs, pa.binary())], names=[id_column, "wav"])

    return vectors.select(F.col(id_column).cast("long").alias(id_column), vector).repartition(parts).mapInArrow(run, f"{id_column} long, wav binary")


def search_recordings(media: DataFrame, every: int = 20, id_column: str = "id", wav: str = "wav", c: Chroma = Chroma()) -> DataFrame:
    """(id_column, class_id, n_codes, is_query, matches) for every row of media.

    class_id: the smallest id with the same fingerprint (the row's own without one). Queries are the rows whose id is
    divisible by every; matches of a query are (class_id, offset, errors) of all other classes that align with its
    class, ascending. Copies share a class and are not listed. A null id is no query. Rows with equal ids and
    recordings stay separate rows. An empty table gives an empty result."""
    prints = saved(add_fingerprints(media.select(id_column, wav), wav, c, keep=[id_column]))
    is_query = F.coalesce(F.pmod(F.col(id_column), F.lit(every)) == 0, F.lit(False))
    # any row of a class holds its codes, so they need no shuffle of all copies
    classes = prints.filter("class_key is not null").groupBy("class_key").agg(F.min(id_column).alias("class_id"), F.max(is_query.cast("int")).alias("asked"))
    classes = saved(classes)
    parts = 4 * media.sparkSession.sparkContext.defaultParallelism  # files of about equal size, so that tasks are, too
    codes = prints.filter("class_key is not null").select("class_key", "codes").repartition(parts, "class_key")
    codes = saved(codes.dropDuplicates(["class_key"]))
    found = align(codes, classes.filter("asked = 1"), c)
    names = classes.select("class_key", "class_id")
    found = found.join(names, "class_key").groupBy(F.col("query_key").alias("class_key"))
    found = found.agg(F.sort_array(F.collect_list(F.struct("class_id", "offset", F.round("errors", 6).alias("errors")))).alias("matches"))
    classes = saved(names.join(found, "class_key", "left"))
    own = prints.select(id_column, "class_key", F.size("codes").alias("n_codes"), is_query.alias("is_query"))
    none = F.expr("cast(array() AS array<struct<class_id: bigint, offset: int, errors: double>>)")
    out = own.filter("class_key is not null").join(classes, "class_key")
    out = out.unionByName(own.filter("class_key is null").withColumns({"class_id": F.col(id_column), "matches": none}))
    matches = F.when(F.col("is_query"), F.coalesce("matches", none)).otherwise(none)
    return out.select(id_column, "class_id", "n_codes", "is_query", matches.alias("matches"))
