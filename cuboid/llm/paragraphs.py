"""Substring dedup: near-equal paragraphs by MinHash banding, verified by exact Jaccard similarity.

A paragraph is a line. Its set holds its distinct shingles (5 words); MinHash signatures are cut into bands; paragraphs
that share a band's key are candidates. Paragraphs with equal sets are one class, each band key links its classes to
the smallest one (a star, never all pairs), and every candidate link is verified on the exact sets. Components of
verified links are groups of copies; the first paragraph of a group stays, the others are removed.

What then stays is searched for spans: runs of as many words as a paragraph has at least, at any place in a line or
across lines, that stand in an earlier place word for word. Each window of so many words has one anchor (the smallest
hash of its 8-word grams), so windows are only compared where their anchor occurs twice. Repeated windows are cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm.linking import ALL, SLICED, SLICES, bitmap_bits, joining, link, marked, marks, of_able, unmarked
from cuboid.llm.tables import add_columns, drop, fresh, saved, small
from cuboid.llm.textops import Words, distinct_sets, least, mix, shingles, signed, slices, windows


@dataclass(frozen=True)
class Bands:
    """shingle: words per shingle. percent: least Jaccard similarity, in hundredths. min_words: shorter paragraphs are left
    alone. bands times rows hash functions: a pair of similarity 0.8 shares a band with probability
    1 - (1 - 0.8**4)**16 = 0.9998."""

    shingle: int = 5
    percent: int = 80
    min_words: int = 20
    bands: int = 16
    rows: int = 4
    gram: int = 8  # words of an anchor, min_words at most

    @property
    def recall(self) -> float:
        """Probability that a pair at exactly the least similarity becomes a candidate."""
        return 1 - (1 - (self.percent / 100) ** self.rows) ** self.bands


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of all texts, each one's row and its number within the text. A null text has none."""
    lines = pc.split_pattern(column.cast(pa.large_string()), "\n")
    row = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(column)))))[:-1] if len(column) else np.zeros(0, np.int64)
    return pc.list_flatten(lines), row, np.arange(len(row)) - first[row]


def paragraph_sets(lines: pa.Array, p: Bands, words: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of the lines of at least min_words words (others have empty ones), and a key of each set. words: those
    of the lines, if they are at hand."""
    words = Words(lines) if words is None else words
    hashes, counts = words.hashes(), words.counts
    long = counts >= p.min_words
    keep = np.repeat(long, counts)
    first = np.concatenate(([0], np.cumsum(np.where(long, counts, 0))))
    values, begin = distinct_sets(*shingles(hashes[keep], first, p.shingle), len(lines))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)))
    sizes = np.diff(begin)
    return values, begin, signed(mix(sums[begin[1:]] - sums[begin[:-1]] + sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def signatures(values: np.ndarray, begin: np.ndarray, p: Bands) -> np.ndarray:
    """One key per set (non-empty sets only) and band."""
    out = []
    for band in range(p.bands):
        key = np.full(len(begin) - 1, np.uint64(band + 1), dtype=np.uint64)
        for r in range(p.rows):
            turn = np.uint64((band * p.rows + r + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)  # the values are well mixed
            low = np.minimum.reduceat(values * turn, begin[:-1])
            key = mix(key * np.uint64(0xD1342543DE82EF95) + low)
        out.append(key)
    return np.stack(out, axis=1)


def _lines(docs: DataFrame, p: Bands, doc_id: str, text: str) -> DataFrame:
    """(id, line, cls, n, k0, k1, ...): the paragraphs of at least min_words words, and the band keys of every class, once
    per partition (null in its other lines)."""
    keys = [f"k{b}" for b in range(p.bands)]

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches, text):
            lines, row, number = split(batch.column(text))
            values, begin, cls = paragraph_sets(lines, p)
            sizes = np.diff(begin)
            at = np.flatnonzero(sizes)
            if not len(at):
                continue
            new = np.isin(at, _unseen(at, cls, seen))
            found = np.zeros((p.bands, len(at)), np.int64)
            if new.any():
                mine = values[np.repeat(new, sizes[at])]
                found[:, new] = signed(signatures(mine, np.concatenate(([0], np.cumsum(sizes[at[new]]))), p)).T
            ids = batch.column(doc_id).cast(pa.int64()).take(pa.array(row[at]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number[at].astype(np.int32)), pa.array(cls[at]), pa.array(sizes[at].astype(np.int32)), *[pa.array(k, mask=~new) for k in found]], names=["id", "line", "cls", "n", *keys])

    return docs.select(doc_id, text).mapInArrow(run, "id long, line int, cls long, n int, " + ", ".join(f"{k} long" for k in keys))


def _shared(lines: DataFrame, p: Bands) -> DataFrame:
    """shared_keys() of the saved table lines. Keys of different bands never meet, so a slice is a few bands. Most keys
    stand once: those that a bitmap of the others rules out are not sorted and shuffled."""

    def band_slice(keys: list[str]) -> DataFrame:
        mine = lines.filter(F.col(keys[0]).isNotNull())
        return joining(mine.select(F.explode(F.array(*keys)).alias("key")), lambda heads: _near(mine, keys, heads))

    count = SLICES if lines.count() * p.bands > SLICED else 1
    parts = [[f"k{b}" for b in part] for part in np.array_split(np.arange(p.bands), count)]
    return of_able([band_slice(keys) for keys in parts if keys], p.percent)


def _near(lines: DataFrame, keys: list[str], heads: DataFrame) -> DataFrame:
    """(key, cls, n, at, kind): the rows of lines with a key in the saved table heads (key), and a few others."""
    bits = bitmap_bits(heads.count())
    bitmap = lines.sparkSession.sparkContext.broadcast(marks(heads.select(F.col("key").alias("cls")), bits))

    def run(batches):
        for batch in batches:
            found = np.concatenate([batch.column(k).to_numpy() for k in keys])
            hit = np.flatnonzero(marked(bitmap.value, found, bits))
            at = pa.array(hit % batch.num_rows)
            n = len(hit)
            yield pa.RecordBatch.from_arrays([pa.array(found[hit]), batch.column("cls").take(at), batch.column("n").take(at), pa.array(np.ones(n, np.int32)), pa.array(np.full(n, ALL, np.int8))], names=["key", "cls", "n", "at", "kind"])

    return lines.select("cls", "n", *keys).mapInArrow(run, "key long, cls long, n int, at int, kind byte")


def _members(docs: DataFrame, classes: DataFrame, p: Bands, text: str) -> DataFrame:
    """(cls, members): the set of every class in the saved table classes (cls)."""
    bits = bitmap_bits(classes.count())
    bitmap = docs.sparkSession.sparkContext.broadcast(marks(classes, bits))

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches, text):
            values, begin, cls = paragraph_sets(split(batch.column(text))[0], p)
            rows = _unseen(np.flatnonzero((np.diff(begin) > 0) & marked(bitmap.value, cls, bits)), cls, seen)
            yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), pa.array([values[begin[r] : begin[r + 1]].tobytes() for r in rows], pa.binary())], names=["cls", "members"])

    found = docs.select(text).mapInArrow(run, "cls long, members binary")
    return found.join(small(classes), "cls", "left_semi").dropDuplicates(["cls"])


def _unseen(rows: np.ndarray, cls: np.ndarray, seen: set[int]) -> np.ndarray:
    out = []
    for row in rows.tolist():
        if int(cls[row]) not in seen:
            seen.add(int(cls[row]))
            out.append(row)
    return np.array(out, dtype=np.int64)


def repeated_lines(docs: DataFrame, p: Bands = Bands(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A saved table (id, line, cls, kept_id, kept_line): every paragraph to remove, and the copy that stays.

    Of a group of similar paragraphs the one with the smallest (doc_id, line) stays. Rows without a doc_id take no
    part. Repeated rows with one doc_id and text count as one paragraph each."""
    docs = docs.filter(F.col(doc_id).isNotNull())
    lines = saved(_lines(docs, p, doc_id, text))
    shared = _shared(lines, p)
    names = saved(shared.select("cls").distinct())
    sets = saved(_members(docs, names, p, text), names)
    roots = link(shared, sets, p.percent)
    drop(shared, sets)
    classes = lines.groupBy("cls").agg(F.min(F.struct("id", "line")).alias("lo"), F.max(F.struct("id", "line")).alias("hi"))
    classes = classes.join(small(roots), F.col("cls") == F.col("node"), "left").select("cls", "lo", "hi", F.coalesce("root", "cls").alias("root"))
    classes = saved(classes, roots)
    groups = saved(classes.groupBy("root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("root", "lo"))
    classes = saved(classes.select("cls", "root").join(small(groups), "root").select("cls", "lo"), classes, groups)
    out = lines.join(small(classes), "cls").filter((F.col("id") != F.col("lo.id")) | (F.col("line") != F.col("lo.line")))
    return saved(out.select("id", "line", "cls", F.col("lo.id").alias("kept_id"), F.col("lo.line").alias("kept_line")), classes, lines)


def _windows(column: pa.Array, p: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of min_words words within a text: row, first word in the text, hash, anchor and the anchor's place."""
    words = Words(column)
    hashes, gram = words.hashes(), min(p.gram, p.min_words)
    spans, at = windows(hashes, words.first, p.min_words)
    grams, where = windows(hashes, words.first, gram)
    dense = np.zeros(len(hashes), np.uint64)
    dense[where] = grams
    anchor, place = least(dense, p.min_words - gram + 1)
    row = words.doc[at]
    return row, at - words.first[row], signed(spans), signed(anchor[at]), place[at]


def _anchors(docs: DataFrame, p: Bands, text: str) -> DataFrame:
    """(cls): the anchors of all windows, once for every place where they stand."""

    def run(batches):
        for batch in slices(batches, text):
            _, _, _, anchor, place = _windows(batch.column(text), p)
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[np.concatenate(([True], place[1:] != place[:-1]))])], names=["cls"])

    return docs.select(text).mapInArrow(run, "cls long")


def _spans(docs: DataFrame, shared: DataFrame, p: Bands, doc_id: str, text: str) -> DataFrame:
    """(span, id, at): the windows whose anchor is in the saved table shared (cls), and a few others."""
    bits = bitmap_bits(shared.count())
    bitmap = docs.sparkSession.sparkContext.broadcast(marks(shared, bits))

    def run(batches):
        for batch in slices(batches, text):
            row, at, span, anchor, _ = _windows(batch.column(text), p)
            here = np.flatnonzero(marked(bitmap.value, anchor, bits))
            ids = batch.column(doc_id).cast(pa.int64()).take(pa.array(row[here]))
            yield pa.RecordBatch.from_arrays([pa.array(span[here]), ids, pa.array(at[here].astype(np.int32))], names=["span", "id", "at"])

    return docs.select(doc_id, text).mapInArrow(run, "span long, id long, at int")


def repeated_spans(docs: DataFrame, p: Bands = Bands(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A saved table (id, at, span, kept_id, kept_at): every window of min_words words (at: its first word) that stands at a smaller
    (doc_id, word) too, and the smallest such place. Rows without a doc_id take no part."""
    docs = docs.filter(F.col(doc_id).isNotNull())
    shared = saved(_anchors(docs, p, text).groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").select("cls"))
    rows = saved(_spans(docs, shared, p, doc_id, text), shared)
    # counts first: a place is only looked up for windows that stand twice
    twice = saved(rows.groupBy("span").agg(F.count("*").alias("n")).filter("n > 1").select("span"))
    rows = saved(rows.hint("merge").join(twice, "span", "left_semi"), rows, twice)
    places = saved(rows.groupBy("span").agg(F.min(F.struct("id", "at")).alias("lo")))
    out = rows.hint("merge").join(places, "span").filter((F.col("id") != F.col("lo.id")) | (F.col("at") != F.col("lo.at")))
    return saved(out.select("id", "at", "span", F.col("lo.id").alias("kept_id"), F.col("lo.at").alias("kept_at")), rows, places)


def cut_words(text: str, cut: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """text without the words flagged in cut; start and end: the words' bytes. Of the white space around a gap one side stays, with a line end if there
    was one on either side or within; none at the ends of the text."""
    data = text.encode()
    edges = np.flatnonzero(np.diff(np.concatenate(([False], cut, [False])).astype(np.int8)))
    out, done = [], 0
    for i, j in edges.reshape(-1, 2).tolist():
        lo, hi = (int(end[i - 1]) if i else 0), (int(start[j]) if j < len(cut) else len(data))
        left, right = data[lo : start[i]], data[end[j - 1] : hi]
        out.append(data[done:lo])
        if i == 0:
            out.append(left if j < len(cut) else b"")
        elif j == len(cut):
            out.append(right)
        else:
            inner = b"\n" if b"\n" in data[start[i] : end[j - 1]] else left
            out.append(left if b"\n" in left else right if b"\n" in right else inner)
        done = hi
    return b"".join([*out, data[done:]]).decode()


def substring_dedup(docs: DataFrame, p: Bands = Bands(), doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with repeated paragraphs and spans cut out of text, and n_removed (words removed), removed_lines (numbers
    from 0, ascending; the lines that went whole as near copies) and kept_in (ascending doc_ids that keep a copy of what was
    removed here).

    Near copies are found among lines of at least min_words words. Spans are verbatim: an embedded copy with some words
    changed loses its runs of min_words or more unchanged words. Of equal texts that with the smallest doc_id stays.
    Null and empty texts stay as they are, rows without a doc_id are left alone, and of repeated rows with one doc_id
    every row is treated alike (what repeats an earlier place goes). Very long texts are worked on whole. Words that stay keep
    their bytes and order, lines that stay whole are joined by a newline. keep names the input columns to return (all
    by default); new columns replace input columns of the same name, other names cannot clash. An empty table gives an
    empty result."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in (text, "n_removed", "removed_lines", "kept_in")]
    taken = [*docs.columns, text, "n_removed", "removed_lines", "kept_in"]
    gone_id, gone_in, kept_to, spans_in, row_id = (fresh(taken, f"_{x}") for x in ("gone_id", "gone", "kept_to", "spans", "row_id"))
    lines = repeated_lines(docs, p, doc_id, text)
    gone = saved(lines.groupBy(F.col("id").alias(gone_id)).agg(F.sort_array(F.collect_set(F.struct("line", "cls"))).alias(gone_in), F.sort_array(F.collect_set("kept_id")).alias(kept_to)), lines)
    # only what is returned travels, and only where a cut may be due; the id under a name of its own
    all_rows = docs.select(*names, F.col(text).cast("string").alias(text), F.col(doc_id).cast("long").alias(row_id))
    whole, part = unmarked(all_rows, row_id, gone.select(F.col(gone_id).alias("cls")))
    both = part.hint("merge").join(gone, F.col(row_id) == F.col(gone_id), "left").drop(gone_id)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n, texts = batch.num_rows, batch.column(text).to_pylist()
        counts, removed, kept_in = np.zeros(n, np.int64), [[]] * n, [[]] * n
        some = batch.filter(pc.and_(pc.is_valid(batch.column(gone_in)), pc.is_valid(batch.column(text))))
        if some.num_rows:
            here = np.flatnonzero(pc.and_(pc.is_valid(batch.column(gone_in)), pc.is_valid(batch.column(text))))
            lines, row, _ = split(some.column(text))
            words = Words(lines)
            cls = paragraph_sets(lines, p, words)[2]  # rows with one doc_id can differ
            first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(here)))))
            gone, mine = pa.RecordBatch.from_struct_array(pc.list_flatten(some.column(gone_in))), np.asarray(pc.list_parent_indices(some.column(gone_in)))
            line, want = gone.column("line").to_numpy(), gone.column("cls").to_numpy()
            at = first[mine] + line
            at = at[(at < first[mine + 1]) & (cls[np.minimum(at, len(cls) - 1)] == want)]
            off = np.zeros(len(row), bool)
            off[at] = True
            counts[here] = np.bincount(row, weights=np.where(off, words.counts, 0), minlength=len(here)).astype(np.int64)
            strings, kept = lines.to_pylist(), some.column(kept_to).to_pylist()
            for k in np.unique(row[off]).tolist():
                lo, flags = first[k], off[first[k] : first[k + 1]]
                texts[here[k]] = "\n".join(strings[i] for i in (lo + np.flatnonzero(~flags)).tolist())
                removed[here[k]], kept_in[here[k]] = np.flatnonzero(flags).tolist(), kept[k] or []
        return {text: pa.array(texts, pa.string()), "n_removed": pa.array(counts), "removed_lines": pa.array(removed, pa.list_(pa.int32())), kept_to: pa.array(kept_in, pa.list_(pa.int64()))}

    made = f"`{text}` string, n_removed long, removed_lines array<int>, "
    rest = saved(add_columns(both, made + f"`{kept_to}` array<long>", work, text, [*names, row_id]), gone)
    whole = whole.withColumns({"n_removed": F.lit(0).cast("long"), "removed_lines": F.array().cast("array<int>"), kept_to: F.array().cast("array<long>")})
    rest = rest.unionByName(whole)
    found = repeated_spans(rest, p, row_id, text)
    ids = saved(found.select(F.col("id").alias("cls")).distinct())
    whole, part = unmarked(rest, row_id, ids)
    drop(ids)
    spans = found.groupBy(F.col("id").alias(gone_id)).agg(F.collect_list(F.struct("at", "span", "kept_id", "kept_at")).alias(spans_in))
    again = part.hint("merge").join(spans, F.col(row_id) == F.col(gone_id), "left")

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, kept_in, counts = batch.column(text).to_pylist(), batch.column(kept_to).to_pylist(), np.array(batch.column("n_removed"))
        there = pc.and_(pc.is_valid(batch.column(spans_in)), pc.is_valid(batch.column(text)))
        some, here = batch.filter(there), np.flatnonzero(there)
        if len(here):
            found, row = pa.RecordBatch.from_struct_array(pc.list_flatten(some.column(spans_in))), np.asarray(pc.list_parent_indices(some.column(spans_in)))
            at, span, kept_id, kept_at = (found.column(c).to_numpy() for c in ("at", "span", "kept_id", "kept_at"))
            words = Words(some.column(text))
            own, place = windows(words.hashes(), words.first, p.min_words)
            has = np.zeros(len(words.start) + 1, bool)
            dense = np.zeros(len(words.start) + 1, np.int64)
            has[place], dense[place] = True, signed(own)
            base = words.first[row]
            same = at < words.counts[row]  # rows with one doc_id can differ
            same[same] = has[(base + at)[same]] & (dense[(base + at)[same]] == span[same])
            # a copy that overlaps its first one leaves that one whole
            mine = kept_id == some.column(row_id).to_numpy()[row]
            lo = np.where(mine, np.maximum(at, kept_at + p.min_words), at)
            size = len(words.start) + 1
            steps = np.bincount((base + lo)[same], minlength=size) - np.bincount((base + at + p.min_words)[same], minlength=size)
            off = steps.cumsum()[:-1] > 0
            for k in np.unique(row[same]).tolist():
                w, i = slice(words.first[k], words.first[k + 1]), here[k]
                counts[i] += int(off[w].sum())
                texts[i] = cut_words(texts[i], off[w], words.start[w] - words.offsets[k], words.end[w] - words.offsets[k])
            pairs = np.unique(np.stack((row[same], kept_id[same])), axis=1) if same.any() else np.zeros((2, 0), np.int64)
            for k, new in zip(*(x.tolist() for x in pairs), strict=True):
                kept_in[here[k]].append(new)
            for i in here.tolist():
                kept_in[i] = sorted(set(kept_in[i]))
        return {text: pa.array(texts, pa.string()), "n_removed": pa.array(counts), "removed_lines": batch.column("removed_lines"), "kept_in": pa.array(kept_in, pa.list_(pa.int64()))}

    out = add_columns(again, made + "kept_in array<long>", cut, text, names)
    return out.unionByName(whole.withColumnRenamed(kept_to, "kept_in").select(*out.columns))
