"""Hard negatives by a multiway hyperplane tree over all rows, exact.

Inner products become distances: every row gets one more component that brings it to the length of the longest row, an
anchor as a query gets 0 there. A larger product is then a smaller distance, and a window of products an annulus about
the anchor.

The tree: split points of the top level come from a bounded sample of rows; every row goes to its nearest one (the
bisecting hyperplanes bound the subtrees), and one aggregation over all rows stores, for every split point, the range
of its distances to the rows of each sibling subtree. A subtree is cut into pieces of bounded size by hashes of the row's
id; a task holds one piece, splits it in the same way down to small leaves, and lets the anchors of that piece come
by in batches. An anchor is sent only to subtrees whose ranges meet its annulus, in the plan and again inside a piece;
in the leaves all products are exact integers. Bounds start from the sample, so they are tight before any row is met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuboid.llm.tables import drop, saved

#: A squared length beyond this has products that are no 64-bit integers.
_LIMIT = float(1 << 62)
_EXACT = float(1 << 53)


@dataclass(frozen=True)
class Mining:
    """How negatives are mined: positives of an anchor, negatives of each, the window in percent of the positive's
    score, the scale of components; and the tree: split points of the top level, rows of the sample that they and the
    first bounds come from, rows of a piece that a task holds, split points and leaf size within a piece."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    branches: int = 16
    sample: int = 2048
    piece: int = 1 << 16
    fan: int = 8
    leaf: int = 512


def quantised(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x) as doubles (exact), shorter vectors padded with zeros."""
    flat, offsets = np.asarray(vectors.flatten(), dtype=np.float64), np.concatenate(([0], np.cumsum(np.asarray(vectors.value_lengths()))))
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dim).all():
        return np.floor(flat.reshape(-1, dim) * scale)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - offsets[rows]] = np.floor(flat * scale)
    return out


def products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Inner products of all rows of a and b as exact 64-bit integers; longest bounds the squared lengths."""
    if longest < _EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest integer n with low * s <= 100 * n <= high * s, without products beyond 64 bits."""
    q, r = score // 100, score % 100
    return q * low + -((-r * low) // 100), q * high + (r * high) // 100


class Space:
    """Distances of rows and anchors in the space with one more component."""

    def __init__(self, longest: float):
        self.longest = longest

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The extra component of rows."""
        return np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0.0))

    def rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between all rows of a and b."""
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T) + (self.lift(a)[:, None] - self.lift(b)[None]) ** 2
        return np.sqrt(np.maximum(square, 0.0))

    def anchors(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of anchors, as queries, to all rows of b."""
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.longest - 2 * (q @ b.T), 0.0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which rows have a score with an anchor. Scores are integers, so half a unit of slack makes up for
        rounding; an infinite score has distance 0 or infinity."""
        square = (q * q).sum(1) + self.longest - 2 * score
        return np.sqrt(np.maximum(square, 0.0))


def farthest(space: Space, x: np.ndarray, k: int) -> np.ndarray:
    """Positions of up to k rows that lie far from each other; fewer where rows are equal."""
    chosen, nearest = [0], space.rows(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)):
        at = int(nearest.argmax())
        if nearest[at] <= 1e-6 * (1 + np.sqrt(space.longest)):
            break
        chosen.append(at)
        nearest = np.minimum(nearest, space.rows(x, x[at : at + 1])[:, 0])
    return np.array(chosen)


def met(space: Space, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Whether subtrees can hold rows within the anchors' annuli: d are distances of anchors to split points, lo and hi the
    ranges from split point (row) to subtree (column). Result: anchors by subtrees. The slack is more than distances, as
    roots of differences of squared lengths, can be off."""
    slack = 1e-6 * (1 + np.sqrt(space.longest))
    out = np.ones((len(d), lo.shape[1]), dtype=bool)
    for i in range(d.shape[1]):
        here = d[:, i : i + 1]
        near = np.maximum(np.maximum(lo[i][None] - here, here - hi[i][None]), 0.0)
        out &= (near <= outer[:, None] + slack) & (here + hi[i][None] >= inner[:, None] - slack)
    return out


class Tree:
    """The subtrees of one piece. visit() walks leaves, each with the anchors that cannot do without it."""

    def __init__(self, space: Space, x: np.ndarray, at: np.ndarray, fan: int, leaf: int):
        self.space, self.at, self.children = space, at, []
        if len(at) <= leaf:
            return
        seeds = at[:: max(1, len(at) // (fan * 32))]
        points = x[seeds[farthest(space, x[seeds], fan)]]
        d = space.rows(x[at], points)
        own = d.argmin(1)
        parts = [np.flatnonzero(own == j) for j in range(len(points))]
        if max(map(len, parts)) == len(at):  # equal rows: no hyperplane parts them
            parts = [np.arange(k, min(k + leaf, len(at))) for k in range(0, len(at), leaf)]
            fan = 0
        parts = [p for p in parts if len(p)]
        self.points = points
        self.lo = np.array([[d[p, i].min() for p in parts] for i in range(len(points))])
        self.hi = np.array([[d[p, i].max() for p in parts] for i in range(len(points))])
        self.children = [Tree(space, x, at[p], fan, leaf) if fan else Leaf(at[p]) for p in parts]

    def visit(self, anchors: np.ndarray, alive: np.ndarray, annulus, leaf) -> None:
        """Calls leaf(rows, alive anchors) for every leaf that is met; annulus(alive) gives inner and outer distances as they
        stand, which shrink on the way. Nearer subtrees come first."""
        if not self.children:
            leaf(self.at, alive)
            return
        d = self.space.anchors(anchors[alive], self.points)
        near = np.maximum(np.maximum(self.lo[None] - d[:, :, None], d[:, :, None] - self.hi[None]), 0.0).max(1)
        for j in np.argsort(near.sum(0)).tolist():
            inner, outer = annulus(alive)
            go = met(self.space, d, self.lo[:, j : j + 1], self.hi[:, j : j + 1], inner, outer)[:, 0]
            if go.any():
                self.children[j].visit(anchors, alive[go], annulus, leaf)


class Leaf:
    def __init__(self, at: np.ndarray):
        self.at = at

    def visit(self, anchors, alive, annulus, leaf) -> None:
        leaf(self.at, alive)


class Best:
    """The best k (score, id) of every slot, scores descending, ties by id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(slots, np.iinfo(np.int64).min)  # the k-th score of a slot, once it has k

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        held = np.arange(len(slot)) - first < self.k
        self.slot, self.score, self.id = slot[held], score[held], ids[held]
        last = np.flatnonzero(np.arange(len(slot)) - first == self.k - 1)
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])


def search(x, ids, labels, space: Space, anchors, anchor_ids, anchor_labels, need: Mining, walk, floors, low=None, high=None) -> Best:
    """The best rows of the piece x for each anchor: of its own label without low and high, of other labels within
    each of its windows low[j] to high[j] with them (slot: anchor * windows + window). floors: scores below which a slot
    needs nothing, from rows elsewhere; walk(anchors, alive, annulus, leaf) meets the leaves."""
    n, windows = len(anchors), 1 if low is None else low.shape[1]
    best = Best(n * windows, need.positives if low is None else need.negatives)
    best.least = np.maximum(best.least, floors.reshape(-1))
    top = np.full((n, 1), np.iinfo(np.int64).max) if high is None else high
    bottom = np.full((n, 1), np.iinfo(np.int64).min) if low is None else low
    used = top >= bottom

    def annulus(alive):
        least = np.maximum(best.least.reshape(n, windows)[alive], bottom[alive]).astype(float)
        least = np.where(used[alive], least, np.inf).min(1)
        most = np.where(used[alive], top[alive].astype(float), -np.inf).max(1)
        lowest, highest = -2 * space.longest, 2 * space.longest
        outer = space.reach(anchors[alive], np.clip(least, lowest, highest) - 0.5)
        inner = space.reach(anchors[alive], np.clip(most, lowest, highest) + 0.5)
        return inner, np.where(np.isinf(least) & (least > 0), -np.inf, outer)

    def leaf(at, alive):
        for k in range(0, len(at), need.leaf):
            part = at[k : k + need.leaf]
            s = products(anchors[alive], x[part], space.longest)
            same = anchor_labels[alive][:, None] == labels[part][None]
            fit = same & (anchor_ids[alive][:, None] != ids[part][None]) if low is None else ~same
            for j in range(windows):
                floor = np.maximum(best.least.reshape(n, windows)[alive, j], bottom[alive, j])
                r, c = np.nonzero(fit & (s >= floor[:, None]) & (s <= top[alive, j][:, None]))
                if len(r):
                    best.add(alive[r] * windows + j, s[r, c], ids[part][c])

    todo = np.flatnonzero(used.any(1))
    if len(todo):
        walk(anchors, todo, annulus, leaf)
    return best


def everywhere(n: int):
    """A walk without a tree: one leaf with all n rows."""
    return lambda anchors, alive, annulus, leaf: leaf(np.arange(n), alive)


@dataclass
class Root:
    """What tasks know of the tree's top: the sample, the split points, and later their ranges. All of bounded size."""

    dim: int
    longest: float
    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    pieces: np.ndarray | None = None
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None


def taking_part(rows: DataFrame, vector: str = "embedding", label: str = "label", row_id: str = "vec_id") -> DataFrame:
    """vec_id, label, embedding of the rows that take part: without a null id, label, vector or component and with
    finite components only. Of rows that share an id the one with the smallest label and vector stays."""
    short = rows.schema[vector].dataType.simpleString() == "array<float>"
    v = F.col(vector) if short else F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(row_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("embedding"), fine.alias("_fine"))
    rows = rows.filter("_fine AND vec_id IS NOT NULL AND label IS NOT NULL")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("_r")).select("vec_id", "_r.label", "_r.embedding")


def _rows_of(batch: pa.RecordBatch, root: Root, need: Mining) -> np.ndarray:
    return quantised(batch.column("embedding"), root.dim, need.scale)


def hard_negatives(rows: DataFrame, anchor: str = "vec_id % 50 = 0", need: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor its nearest rows of the
    same label are positives, and for each of them the best rows of other labels whose score lies in the window.

    rows: vec_id, label, embedding (see taking_part for those that take part); anchor: SQL over vec_id that is true for
    anchors. Scores are inner products of floor(scale * x), exact. Vectors of different lengths count as padded with
    zeros; rows whose squared length passes 2**62 take no part, as their products are no 64-bit integers. Ties go to the
    smaller vec_id. Anchors without positives, and windows without rows, give no rows; no rows give no rows. Other columns
    are ignored."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * need.scale).cast("double"))
    square = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x)
    rows = saved(taking_part(rows).filter(square <= _LIMIT))
    facts = rows.agg(F.max(F.size("embedding")).alias("dim"), F.max(square).alias("longest"), F.count("*").alias("n")).first()
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts.n:
        drop(rows)
        return rows.sparkSession.createDataFrame([], names)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(need.sample).toArrow()  # bounded by need.sample
    root = Root(max(facts.dim, 1), facts.longest, np.zeros(0), some["vec_id"].to_numpy(), some["label"].to_numpy(), np.zeros(0))
    root.x = quantised(some["embedding"].combine_chunks(), root.dim, need.scale)
    root.points = root.x[farthest(Space(root.longest), root.x, need.branches)]

    dealt = saved(_dealt(rows, root, need), rows)
    _ranges(dealt, root, need)
    spread = F.pmod(F.xxhash64("vec_id"), F.array(*[F.lit(int(p)) for p in root.pieces])[F.col("node")])
    dealt = dealt.withColumn("piece", spread.cast("int")).drop("d")
    anchors = dealt.filter(anchor)

    found = _passed(dealt, _routed(anchors.select("vec_id", "label", "embedding"), root, need), root, need)
    mine = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = found.select("anchor", F.explode(F.arrays_zip("score", "id")).alias("_p")).select("anchor", "_p.score", "_p.id").withColumn("_k", F.row_number().over(mine)).filter(F.col("_k") <= need.positives)
    pairs = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("_k", "id", "score"))).alias("_p"))  # need.positives a row
    pairs = saved(pairs.select(F.col("anchor").alias("vec_id"), F.col("_p.id").alias("positives"), F.col("_p.score").alias("scores")))

    second = _passed(dealt, _routed(anchors.select("vec_id", "label", "embedding").join(pairs.drop("positives"), "vec_id"), root, need), root, need)
    hits = second.select(F.col("anchor").alias("vec_id"), F.explode(F.arrays_zip("slot", "score", "id")).alias("_n")).select("vec_id", "_n.slot", "_n.score", "_n.id")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id", "slot").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= need.negatives)
    out = ranked.join(pairs, "vec_id")
    at = lambda c: F.col(c)[F.col("slot").cast("int")]
    return out.select(F.col("vec_id").alias("anchor_id"), at("positives").alias("positive_id"), "rank", F.col("id").alias("negative_id"), at("scores").alias("positive_score"), F.col("score").alias("negative_score"))


def _type(rows: DataFrame) -> str:
    return rows.schema["embedding"].dataType.simpleString()


def _dealt(rows: DataFrame, root: Root, need: Mining) -> DataFrame:
    """rows with node, the nearest split point of the top, and d, the distances to all of them."""
    schema = f"vec_id long, label long, embedding {_type(rows)}, node int, d array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(root.longest)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                d = space.rows(_rows_of(part, root, need), root.points)
                lists = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), d.reshape(-1))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("embedding"), pa.array(d.argmin(1).astype(np.int32)), lists], names=["vec_id", "label", "embedding", "node", "d"])

    return rows.mapInArrow(run, schema)


def _ranges(dealt: DataFrame, root: Root, need: Mining) -> None:
    """Gives root the ranges of distances from every split point to every subtree's rows, and the subtrees' pieces."""
    k = len(root.points)
    table = dealt.groupBy("node").agg(F.count("*").alias("n"), *[f(F.col("d")[i]).alias(f"{s}{i}") for i in range(k) for s, f in (("lo", F.min), ("hi", F.max))])
    root.pieces, root.lo, root.hi = np.zeros(k, np.int64), np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for r in table.collect():  # need.branches rows
        root.pieces[r.node] = -(-r.n // need.piece)
        root.lo[:, r.node], root.hi[:, r.node] = [r[f"lo{i}"] for i in range(k)], [r[f"hi{i}"] for i in range(k)]


def _floors(root: Root, need: Mining, q, ids, labels, low, high) -> np.ndarray:
    """For every slot a score that enough rows of the sample reach, so that nothing below it is needed."""
    best = search(root.x, root.ids, root.labels, Space(root.longest), q, ids, labels, need, everywhere(len(root.x)), np.full((len(q), 1 if low is None else low.shape[1]), np.iinfo(np.int64).min), low, high)
    return best.least.reshape(len(q), -1)


def _windows(batch: pa.RecordBatch, need: Mining) -> tuple[np.ndarray, np.ndarray] | tuple[None, None]:
    """The windows of the anchors' positives, padded with empty ones."""
    if "scores" not in batch.schema.names:
        return None, None
    lists = batch.column("scores")
    sizes, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten(), dtype=np.int64)
    low, high = np.ones((len(sizes), need.positives), np.int64), np.zeros((len(sizes), need.positives), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    low[rows, at], high[rows, at] = window(flat, need.low, need.high)
    return low, high


def _routed(anchors: DataFrame, root: Root, need: Mining) -> DataFrame:
    """A row per anchor and piece that it is sent to, with the floors that the sample gives it."""
    schema = f"vec_id long, label long, embedding {_type(anchors)}, scores array<bigint>, floors array<bigint>, node int, piece int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(root.longest)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                q, ids, labels = _rows_of(batch, root, need), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
                low, high = _windows(batch, need)
                floors = _floors(root, need, q, ids, labels, low, high)
                if low is None:
                    inner, least = np.zeros(len(q)), floors[:, 0].astype(float)
                else:
                    used = high >= low
                    least = np.where(used, np.maximum(floors, low).astype(float), np.inf).min(1)
                    inner = space.reach(q, np.clip(np.where(used, high.astype(float), -np.inf).max(1), -2 * root.longest, 2 * root.longest) + 0.5)
                outer = np.where(np.isposinf(least), -np.inf, space.reach(q, np.clip(least, -2 * root.longest, 2 * root.longest) - 0.5))
                row, node = np.nonzero(met(space, space.anchors(q, root.points), root.lo, root.hi, inner, outer) & (root.pieces > 0)[None])
                copies = root.pieces[node]
                row, node = np.repeat(row, copies), np.repeat(node, copies)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                sent = batch.take(pa.array(row))
                scores = sent.column("scores") if low is not None else pa.nulls(len(row), pa.list_(pa.int64()))
                lists = pa.ListArray.from_arrays(np.arange(0, floors[row].size + 1, floors.shape[1], dtype=np.int32), floors[row].reshape(-1))
                yield pa.RecordBatch.from_arrays([sent.column("vec_id"), sent.column("label"), sent.column("embedding"), scores, lists, pa.array(node.astype(np.int32)), pa.array(piece.astype(np.int32))], names=["vec_id", "label", "embedding", "scores", "floors", "node", "piece"])

    return anchors.mapInArrow(run, schema)


def _passed(dealt: DataFrame, routed: DataFrame, root: Root, need: Mining) -> DataFrame:
    """(anchor, slot, score, id): what the pieces give the anchors sent to them, a row per anchor and piece.

    Rows of a piece and anchors sent to it meet in one task, rows first. A task builds the piece's tree from at most
    about need.piece rows and then lets anchors pass in batches, so the number of anchors does not matter."""
    every = dealt.select("node", "piece", F.lit(0).alias("kind"), "vec_id", "label", "embedding", F.lit(None).cast("array<bigint>").alias("scores"), F.lit(None).cast("array<bigint>").alias("floors"))
    every = every.unionByName(routed.withColumn("kind", F.lit(1)))
    pieces = int(root.pieces.sum())
    met_ = every.repartition(max(pieces, 1), "node", "piece").sortWithinPartitions("node", "piece", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, piece, parts, tree = Space(root.longest), None, [], None
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                table = whole.slice(start, 1024)
                key = np.column_stack([table.column(c).to_numpy() for c in ("node", "piece", "kind")])
                cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                    if a == b:
                        continue
                    batch, here = table.slice(a, b - a), tuple(key[a, :2].tolist())
                    x, ids, labels = _rows_of(batch, root, need), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
                    if here != piece:
                        piece, parts, tree = here, [], None
                    if key[a, 2] == 0:
                        parts.append((x, ids, labels))
                    elif parts:
                        if tree is None:
                            held = [np.concatenate(c) for c in zip(*parts, strict=True)]
                            order = np.argsort(held[1], kind="stable")
                            held = [c[order] for c in held]
                            tree = Tree(space, held[0], np.arange(len(held[0])), need.fan, need.leaf)
                        low, high = _windows(batch, need) if batch.column("scores").null_count == 0 else (None, None)
                        floors = np.asarray(batch.column("floors").flatten(), dtype=np.int64).reshape(len(ids), -1)
                        best = search(*held, space, x, ids, labels, need, tree.visit, floors, low, high)
                        yield _emitted(best, ids, 1 if low is None else low.shape[1])

    return met_.mapInArrow(run, "anchor long, slot array<bigint>, score array<bigint>, id array<bigint>")


def _emitted(best: Best, anchors: np.ndarray, windows: int) -> pa.RecordBatch:
    owner = best.slot // windows
    have, first = np.unique(owner, return_index=True)
    offsets = np.concatenate((first, [len(owner)])).astype(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, c) for c in (best.slot % windows, best.score, best.id)]
    return pa.RecordBatch.from_arrays([pa.array(anchors[have]), *lists], names=["anchor", "slot", "score", "id"])
