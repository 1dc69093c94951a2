"""N-gram Jaccard join: a size-aware heavy-light set-similarity join, exact, with connected components.

A set with n shingles overlaps any partner in at least ceil(t n) of them, so under one global order of the shingles
(rare ones first) the first n - ceil(t n) + l shingles of both partners have l in common. Small sets enumerate all
subsets of SUBSET shingles of that prefix (l = SUBSET) as join keys; large sets scan the inverted lists of the single
shingles of theirs (l = 1 + n // 12; sets with fewer shared ones are no candidates). The boundary is the size up to which subsets cost less than the expected lists. Sets just
below the boundary also stand in the lists, where large sets find them.

Equal sets are one class; linking.py joins the classes of a key without all pairs of a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm.linking import ALL, HEAVY, LISTED, bitmap_bits, link, marked, marks, shared_keys, unmarked
from cuboid.llm.tables import add_columns, drop, fresh, saved, small
from cuboid.llm.textops import Words, distinct_sets, mix, shingles, signed, slices

SUBSET = 2  # the fixed size of enumerated subsets


@dataclass(frozen=True)
class Join:
    """shingle: words per shingle. percent: least Jaccard similarity, in hundredths. lower: whether A-Z count as a-z.
    cells: the sketch that orders shingles has about so many cells a document, 2**24 at most."""

    shingle: int = 4
    percent: int = 85
    lower: bool = True
    cells: int = 4

    def prefix(self, n: int, subset: int) -> int:
        return n + (-self.percent * n) // 100 + subset  # n - ceil(t n) + subset

    @staticmethod
    def least(n):
        """Shingles that the listed prefixes of a pair have in common, n being the smaller one's size."""
        return 1 + n // 12 if isinstance(n, int) else 1 + F.floor(n / 12)


def _sets(column: pa.Array, p: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, where each text's begin, and a key of each set (0: empty)."""
    words = Words(column)
    values, first = distinct_sets(*shingles(words.hashes(p.lower), words.first, p.shingle), words.rows)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(0x51ED270B9F2C6A35)), dtype=np.uint64)))
    sizes = np.diff(first)
    key = mix(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    key[sizes == 0] = 0
    return values, first, signed(key)


def _survey(docs: DataFrame, p: Join, bits: int, doc_id: str, text: str) -> DataFrame:
    """Rows (id, n, cls) of documents, and rows (cell, df) of the sketch: those cells of a partition that hold at
    least a share of 2**(6 - bits) of its shingles. Cells that are heavy in no partition count as empty."""

    def run(batches):
        cells, total = np.zeros(1 << bits, dtype=np.int32), 0
        for batch in slices(batches, text):
            values, first, key = _sets(batch.column(text), p)
            np.add.at(cells, (values >> np.uint64(64 - bits)).astype(np.int64), 1)
            total += len(values)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id).cast(pa.int64()), pa.array(np.diff(first)), pa.array(key), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=["id", "n", "cls", "cell", "df"])
        at = np.flatnonzero(cells >= max(8, total >> (bits - 6)))
        n = len(at)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(at.astype(np.int32)), pa.array(cells[at].astype(np.int64))], names=["id", "n", "cls", "cell", "df"])

    return docs.select(doc_id, text).mapInArrow(run, "id long, n long, cls long, cell int, df long")


def boundary(sketch: np.ndarray, total: int, p: Join, largest: int = 4096) -> int:
    """The largest set size whose subsets cost less than its inverted lists: rows written against rows written plus
    expected list entries. total: shingles of all sets. A prefix holds the rarest share of 1 - t; what the sketch's
    empty cells hold is met once, the rest as often as the rarest cells say."""
    if not total:
        return 0
    cells = np.sort(sketch[sketch > 0]).astype(np.float64)
    need = max(0.0, total * (100 - p.percent) / 100 - max(0.0, total - cells.sum()))
    rare = cells[: int(np.searchsorted(np.cumsum(cells), need)) + 1] if need else cells[:0]
    entries = float((rare * rare).sum() / (total * (100 - p.percent) / 100))
    best = 0
    for n in range(2, largest):
        k = p.prefix(n, SUBSET)
        if k * (k - 1) / 2 > p.prefix(n, p.least(n)) * (1 + entries):
            if n - best > 20:
                break
            continue
        best = n
    return best


def _keys(docs: DataFrame, sketch, bits: int, limit: int, p: Join, text: str) -> DataFrame:
    """Rows (key, cls, n, at, kind): the join keys of every set. at: the rank of a list's shingle in the set."""

    def run(batches):
        seen: set[int] = set()  # classes of this partition
        freq = sketch.value
        for batch in slices(batches, text):
            values, first, cls = _sets(batch.column(text), p)
            sizes = np.diff(first)
            often = freq[(values >> np.uint64(64 - bits)).astype(np.int64)]
            out_key, out_row, out_at, out_kind = [], [], [], []
            for row in range(batch.num_rows):
                n, c = int(sizes[row]), int(cls[row])
                # partners have at least n + 1 shingles or are found from the smaller one
                if not n or c in seen or n * p.percent // 100 == n or (100 * n) // p.percent == n and p.prefix(n, 1) == 1:
                    continue
                seen.add(c)
                here = slice(first[row], first[row + 1])
                v = values[here][np.argsort(often[here], kind="stable")]  # values ascend, so ties go by value
                if n <= limit:
                    some = v[: p.prefix(n, SUBSET)]
                    a, b = np.triu_indices(len(some), 1)
                    lo, hi = np.minimum(some[a], some[b]), np.maximum(some[a], some[b])
                    out_key.append(mix(lo * np.uint64(0x9E3779B97F4A7C15) + mix(hi)))
                    out_row.append(np.full(len(a), row))
                    out_at.append(np.ones(len(a), np.int64))
                    out_kind.append(np.full(len(a), ALL))
                if n > limit or 100 * n >= p.percent * (limit + 1):
                    v = v[: p.prefix(n, p.least(n))]
                    out_key.append(v)
                    out_row.append(np.full(len(v), row))
                    out_at.append(np.arange(1, len(v) + 1))
                    out_kind.append(np.full(len(v), HEAVY if n > limit else LISTED))
            if out_key:
                row = np.concatenate(out_row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(out_key))), pa.array(cls[row]), pa.array(sizes[row].astype(np.int32)), pa.array(np.concatenate(out_at).astype(np.int32)), pa.array(np.concatenate(out_kind).astype(np.int8))],
                    names=["key", "cls", "n", "at", "kind"])

    return docs.select(text).mapInArrow(run, "key long, cls long, n int, at int, kind byte")


def _marked_sets(docs: DataFrame, classes: DataFrame, p: Join, text: str) -> DataFrame:
    """(cls, members): the shingles of every class in the saved table classes (cls). A bitmap drops most others inside
    the scan; the join drops the rest."""
    bits = bitmap_bits(classes.count())
    bitmap = docs.sparkSession.sparkContext.broadcast(marks(classes, bits))

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches, text):
            values, first, cls = _sets(batch.column(text), p)
            hit = np.flatnonzero(marked(bitmap.value, cls, bits))
            rows = []
            for row in hit.tolist():
                if int(cls[row]) not in seen:
                    seen.add(int(cls[row]))
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), pa.array([values[first[r] : first[r + 1]].tobytes() for r in rows], pa.binary())], names=["cls", "members"])

    found = docs.select(text).mapInArrow(run, "cls long, members binary")
    return found.join(small(classes), "cls", "left_semi").dropDuplicates(["cls"])


def jaccard_components(docs: DataFrame, p: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_key, component_id) for every row of docs; two rows are connected if a chain of
    pairs with 100 * intersection >= percent * union leads from one to the other.

    Null, empty and blank texts have no shingles and are connected with nothing. Rows with equal texts, and repeated
    rows, have similarity 1. Ties cannot change a result: component_id is the smallest non-null doc_id of the component
    (null if it has none). doc_id is an integer. Very long texts are sets like others. Other columns are ignored,
    whatever their names. An empty table gives an empty result. class_key is a 64-bit hash of the set, so two
    different sets are taken for equal with probability 2**-64 a pair."""
    spark = docs.sparkSession
    bits = min(24, max(16, (p.cells * docs.count()).bit_length()))
    survey = saved(_survey(docs, p, bits, doc_id, text))
    rows = survey.filter("cls is not null").select("id", "n", "cls")
    sketch = np.zeros(1 << bits, dtype=np.int32)
    counts = survey.filter("cell is not null").groupBy("cell").agg(F.sum("df").alias("df")).toArrow()  # 2**bits rows at most
    sketch[counts["cell"].to_numpy()] = np.minimum(counts["df"].to_numpy(), 2**31 - 1)
    limit = boundary(sketch, rows.agg(F.sum("n")).first()[0] or 0, p)
    shared = shared_keys(_keys(docs, spark.sparkContext.broadcast(sketch), bits, limit, p, text), p.percent, p.least)
    names = saved(shared.select("cls").distinct())
    sets = saved(_marked_sets(docs, names, p, text), names)
    roots = link(shared, sets, p.percent)
    drop(shared, sets)
    ids = rows.filter("n > 0").groupBy("cls").agg(F.min("id").alias("least")).join(small(roots), F.col("cls") == F.col("node"), "left")
    ids = saved(ids.select("cls", "least", F.coalesce("root", "cls").alias("root")), roots)
    smallest = saved(ids.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = saved(ids.join(smallest, "root").select("cls", "component_id"), ids, smallest)
    full = rows.filter("n > 0").join(ids, "cls").select("id", "n", "cls", "component_id")
    none = rows.filter("n = 0").select("id", "n", "cls", F.col("id").alias("component_id"))
    return full.unionByName(none).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("cls").alias("class_key"), "component_id")


def one_of_each(docs: DataFrame, p: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the smallest doc_id of every component, their columns as they are.

    Rows without a doc_id stay. Rows with a null or blank text stay, as they are connected with nothing; of repeated rows
    (equal in doc_id and set) one stays. Rows that share a doc_id are judged by their own texts. An empty table gives
    an empty result."""
    groups = saved(jaccard_components(docs, p, doc_id, text).select(F.col(doc_id).alias("_id"), "class_key", "component_id").filter("_id is not null"))
    often = saved(groups.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").select("_id"))
    first = saved(groups.filter("_id = component_id").select("_id", "class_key").distinct())
    # an id that stands once needs no look at its text
    once = first.join(small(often), "_id", "left_anti").select("_id")
    off = saved(groups.select(F.col("_id").alias("cls")).distinct().join(once.withColumnRenamed("_id", "cls"), "cls", "left_anti"), groups)
    # most texts stay where they are: only those that may have to go meet the list of those that do
    stay, doubtful = unmarked(docs, doc_id, off)
    gone = fresh(docs.columns, "_gone")
    out = stay.unionByName(doubtful.hint("merge").join(off.withColumnRenamed("cls", gone), F.col(doc_id) == F.col(gone), "left_anti"))
    if not often.take(1):
        return out

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"_class_key": pa.array(_sets(batch.column(text), p)[2])}

    some = add_columns(docs.join(small(often), F.col(doc_id) == F.col("_id"), "left_semi"), "_class_key long", work, text)
    some = some.join(small(first), (F.col(doc_id) == F.col("_id")) & (F.col("_class_key") == F.col("class_key")), "left_semi")
    return out.unionByName(some.dropDuplicates([doc_id, "_class_key"]).select(*docs.columns))
