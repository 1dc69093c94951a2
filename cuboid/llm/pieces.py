"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model is compiled into three transducers. The normaliser rewrites characters by the model's own map (longest match)
and marks blanks. The pieces are a trie from characters to ids; characters that are no piece go to an unknown id or,
with byte fallback, to the ids of their bytes. Composing these with an input gives a lattice whose arcs are pieces, and
the encoding is the lattice's shortest path in the tropical semiring. A unigram model's arcs weigh minus their score.
In a BPE model the order of merges decides, which no sum of weights expresses; there the transducer's states remember
the last piece, and an arc weighs 0 if the merges of both pieces' text end in these two and infinity if not. Then one
path of finite weight is left.

Where no piece joins what stands before a blank mark, or a line break, with what comes after, a text's lattice falls
into units (about words). The units that a batch of texts does not share with earlier ones are composed all at once, as
arrays of arcs, and their ids are kept in a cache of bounded size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuboid.llm.tables import add_columns

MARK = "▁"
LONG = 32  # characters of a unit beyond which it is composed alone
AT_ONCE = 1 << 16  # characters of the units that are composed at once; their arcs take about 250 bytes a character
UNIT = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


@dataclass
class Transducer:
    """A compiled model. kind: 1 unigram, 2 BPE. pieces: id and score of every normal piece; fallback: the ids of
    the 256 bytes or none; out: the bytes that each id stands for; rules: the normaliser's map; frozen: user-defined
    pieces, which a BPE model takes whole before all others."""

    kind: int
    pieces: dict[str, tuple[int, float]]
    fallback: list[int]
    unknown: int
    out: list[bytes]
    rules: dict[str, str] = field(default_factory=dict)
    frozen: dict[str, int] = field(default_factory=dict)
    prefix: bool = True
    squeeze: bool = False
    cached: int = 40_000
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        joins = any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in self.pieces)
        self.unit = re.compile("(?s).+") if joins else UNIT  # pieces that join words leave the text whole
        worst = min((s for _, s in self.pieces.values()), default=0.0)
        self.penalty = 10.0 - worst  # of an unknown character in a unigram model
        self._sorted = sorted(self.pieces)
        starts = "".join({re.escape(k[0]) for k in self.rules})
        self._rewrite = re.compile(f"[{starts}]") if starts else None
        self._widest = max(map(len, self.rules), default=0)
        self._whole = re.compile("|".join(map(re.escape, sorted(self.frozen, key=len, reverse=True)))) if self.frozen else None
        self._pairs: dict[tuple[str, str], bool] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._arcs = _Arcs(self)

    # normaliser

    def _mapped(self, text: str) -> str:
        out, done = [], 0
        for m in self._rewrite.finditer(text):
            k = m.start()
            if k < done:
                continue
            for n in range(min(self._widest, len(text) - k), 0, -1):
                to = self.rules.get(text[k : k + n])
                if to is not None:
                    out += [text[done:k], to]
                    done = k + n
                    break
        return "".join([*out, text[done:]])

    def normalise(self, text: str) -> str:
        if self._rewrite:
            text = self._mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK)

    # shortest path

    def merged(self, text: str) -> list[str]:
        """The result of a BPE model's merges on a short text: always the best, then leftmost, pair."""
        parts, pieces = list(text), self.pieces
        found = [pieces.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while found:
            best, at = None, -1
            for k, x in enumerate(found):
                if x is not None and (best is None or x[1] > best):
                    best, at = x[1], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = pieces.get(parts[at - 1] + parts[at])
            if at < len(found):
                found[at] = pieces.get(parts[at] + parts[at + 1])
        return parts

    def allowed(self, a: str, b: str) -> bool:
        """Whether a BPE model's piece b can follow a (or begin a unit, a being empty)."""
        return self.merged(a + b) == ([a, b] if a else [b])

    def begins(self, text: str) -> bool:
        """Whether a piece begins with text."""
        at = bisect_left(self._sorted, text)
        return at < len(self._sorted) and self._sorted[at].startswith(text)

    def path(self, unit: str) -> list[str]:
        """The pieces (or unknown single characters) on the shortest path through one unit's lattice, arc by arc."""
        n, pieces = len(unit), self.pieces
        last: list[str | None] = [""] + [None] * n
        cost = [0.0] + [float("inf")] * n
        for k in range(n):
            before = last[k]
            if before is None:
                continue
            i = k + 1
            while i <= n and self.begins(piece := unit[k:i]):
                found = pieces.get(piece)
                if found and self.kind == 2:
                    pair = before, piece
                    if last[i] is None and pair not in self._pairs:
                        self._pairs = self._pairs if len(self._pairs) < self.cached else {}
                        self._pairs[pair] = self.allowed(before, piece)
                    if last[i] is None and self._pairs[pair]:
                        last[i] = piece
                elif found and cost[k] - found[1] < cost[i]:
                    cost[i], last[i] = cost[k] - found[1], piece
                i += 1
            # an unknown character stands alone
            if unit[k] not in pieces and (last[k + 1] is None if self.kind == 2 else cost[k] + self.penalty < cost[k + 1]):
                cost[k + 1], last[k + 1] = cost[k] + self.penalty, unit[k]
        out, i = [], n
        while i > 0:
            piece = last[i]
            if piece is None:
                raise ValueError(f"no path through {unit!r}")
            out.append(piece)
            i -= len(piece)
        return out[::-1]

    def ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for piece in self.path(unit):
            if piece in self.pieces:
                out.append(self.pieces[piece][0])
            elif self.fallback:
                out += [self.fallback[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _segments(self, text: str) -> list[str]:
        """The units of a text; frozen pieces stand alone."""
        text = self.normalise(text)
        if not self._whole:
            return self.unit.findall(text)
        out, done = [], 0
        for m in self._whole.finditer(text):
            out += [*self.unit.findall(text[done : m.start()]), m[0]]
            done = m.end()
        return out + self.unit.findall(text[done:])

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text (none for null)."""
        units = [self._segments(t) if t else [] for t in texts]
        if len(self._young) > self.cached:  # what was not asked for since the last turn goes
            self._old, self._young = self._young, {}
        have, old, new = self._young, self._old, []
        for unit in dict.fromkeys(u for row in units for u in row):
            if unit not in have:
                if unit in old:
                    have[unit] = old[unit]
                elif unit in self.frozen:
                    have[unit] = np.int32(self.frozen[unit]).tobytes()
                else:
                    new.append(unit)
        short = [u for u in new if len(u) <= LONG] if self.fallback else []
        turn = np.cumsum([len(u) for u in short], dtype=np.int64) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(short)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            have.update(zip(short[lo:hi], self._arcs.encode(short[lo:hi]), strict=True))
        once = {u: np.array(self.ids(u), dtype=np.int32).tobytes() for u in new if not self.fallback or len(u) > LONG}
        get = (lambda u: have[u] if u in have else once[u]) if once else have.__getitem__
        return [np.frombuffer(b"".join(map(get, row)), dtype=np.int32) for row in units]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Arcs:
    """The pieces' trie as arrays, and shortest paths through the lattices of many units at once."""

    SLOTS = 1 << 20  # of the table of pairs that were tested

    def __init__(self, model: Transducer):
        self.model = model
        letters = sorted({c for p in model.pieces for c in p})
        self.letter = {c: k + 1 for k, c in enumerate(letters)}
        self.width = len(letters) + 1
        nodes, kids, ends = 1, {}, {}
        for p in model.pieces:
            at = 0
            for c in p:
                key = at * self.width + self.letter[c]
                if key not in kids:
                    kids[key] = nodes
                    nodes += 1
                at = kids[key]
            ends[at] = p
        self.keys = np.array(sorted(kids), dtype=np.int64)
        self.child = np.array([kids[k] for k in self.keys.tolist()], dtype=np.int64)
        self.names = list(model.pieces)  # by an index of their own, unknown characters after the pieces
        index = {p: k for k, p in enumerate(self.names)}
        self.odd: dict[str, int] = {}  # the unknown characters' indices
        self.end = np.full(nodes, -1, dtype=np.int64)
        self.end[list(ends)] = [index[p] for p in ends.values()]
        self.weight = np.array([-model.pieces[p][1] for p in self.names])
        self.codes = np.zeros(0x110000, dtype=np.uint16 if len(letters) < 1 << 16 else np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.tested = np.full(self.SLOTS, -1, dtype=np.int64)
        self.ids = np.array([model.pieces[p][0] for p in self.names], dtype=np.int32)
        self.lengths = np.array([len(p) for p in self.names], dtype=np.int64)

    def _unknown(self, char: str) -> int:
        if char not in self.odd:
            self.odd[char] = len(self.names)
            self.names.append(char)
        return self.odd[char]

    def _out(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has: unknown characters have their bytes'."""
        wide = np.ones(len(piece), dtype=np.int64)
        strange = np.flatnonzero(piece >= len(self.ids))
        if not len(strange):
            return self.ids[piece], wide
        found = [[self.model.fallback[b] for b in self.names[k].encode("utf-8", "surrogatepass")] for k in piece[strange].tolist()]
        wide[strange] = [len(x) for x in found]
        flat = np.empty(int(wide.sum()), dtype=np.int32)
        one = np.repeat(piece < len(self.ids), wide)
        flat[one] = self.ids[piece[piece < len(self.ids)]]
        flat[~one] = np.concatenate(found)
        return flat, wide

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """allowed for pairs of indices (a: -1 at the beginning), by a table that forgets."""
        key = (a.astype(np.int64) + 1) * (1 << 30) + b
        slot = (key * 0x9E3779B97F4A7C1 >> 24) & (self.SLOTS - 1)
        have = self.tested[slot]
        new = (have >> 1) != key
        out = (have & 1).astype(bool)
        if new.any():
            keys, back = np.unique(key[new], return_inverse=True)
            names, test = self.names, self.model.allowed
            good = np.array([test(names[(k >> 30) - 1] if k >> 30 else "", names[k & (1 << 30) - 1]) for k in keys.tolist()], dtype=bool)
            out[new] = good[back]
            self.tested[slot[new]] = 2 * key[new] + out[new]
        return out

    def encode(self, units: list[str]) -> list[bytes]:
        """The ids of short units as bytes."""
        if not units:
            return []
        raw = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = self.codes[raw]
        size = np.array([len(u) for u in units], dtype=np.int64)
        first = np.cumsum(size) - size
        stop = np.repeat(first + size, size)
        arcs = []  # (start, length, index), as 32-bit integers
        live, node = np.arange(len(raw)), np.zeros(len(raw), dtype=np.int64)
        known = np.zeros(len(raw), dtype=bool)
        for n in range(1, self.model.longest + 1):
            key = node * self.width + code[live + n - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, node = live[hit], self.child[at[hit]]
            piece = self.end[node]
            there = piece >= 0
            arcs.append((live[there].astype(np.int32), np.full(int(there.sum()), n, np.int32), piece[there].astype(np.int32)))
            if n == 1:
                known[live[there]] = True
            more = live + n < stop[live]
            live, node = live[more], node[more]
            if not len(live):
                break
        odd = np.flatnonzero(~known)
        if len(odd):
            chars, back = np.unique(raw[odd], return_inverse=True)
            arcs.append((odd.astype(np.int32), np.ones(len(odd), np.int32), np.array([self._unknown(chr(c)) for c in chars.tolist()], dtype=np.int32)[back]))
        begin, length, piece = (np.concatenate(x) for x in zip(*arcs, strict=True))
        # arcs by where they end within their unit; of a BPE model short ones first, as the first allowed one decides
        bpe, longest = self.model.kind == 2, self.model.longest + 1
        until = begin + length - np.repeat(first.astype(np.int32), size)[begin]
        group = until * np.int32(longest) + (length if bpe else longest - 1 - length)
        order = np.argsort(group, kind="stable")
        begin, length, piece, group = begin[order], length[order], piece[order], group[order]
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        last = np.full(len(raw), -1, dtype=np.int64)  # the piece that ends after each character
        cost = np.full(len(raw), np.inf)
        opens = np.zeros(len(raw), dtype=bool)
        opens[first] = True
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            k, i, x = begin[lo:hi], begin[lo:hi] + length[lo:hi] - 1, piece[lo:hi]
            if bpe:
                free = last[i] < 0
                k, i, x = k[free], i[free], x[free]
                yes = self._allowed(np.where(opens[k], -1, last[k - 1]), x)
                last[i[yes]] = x[yes]
            else:
                weight = np.where(x < len(self.weight), self.weight[np.minimum(x, len(self.weight) - 1)], self.model.penalty)
                now = np.where(opens[k], 0.0, cost[k - 1]) + weight
                yes = now < cost[i]
                last[i[yes]], cost[i[yes]] = x[yes], now[yes]
        # back from the ends of all units, a piece a step
        steps, at, unit = [], first + size - 1, np.arange(len(units))
        while len(at):
            x = last[at]
            steps.append((unit, x))
            at = at - np.where(x < len(self.lengths), self.lengths[np.minimum(x, len(self.lengths) - 1)], 1)
            more = at >= first[unit]
            at, unit = at[more], unit[more]
        owner, x = (np.concatenate(y) for y in zip(*steps, strict=True))
        order = np.lexsort((-np.arange(len(owner)), owner))
        owner, x = owner[order], x[order]
        flat, wide = self._out(x)
        ends = np.cumsum(np.bincount(owner, weights=wide, minlength=len(units)).astype(np.int64)).tolist()
        data = flat.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def compile_model(path: str) -> Transducer:
    """Reads a SentencePiece model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return from_proto(model)


def character_map(blob: bytes) -> dict[str, str]:
    """The normaliser's rules in a model's precompiled map: four bytes of size, a double-array trie of 32-bit units over
    UTF-8 bytes, and the targets, each ended by a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    trie, targets = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist(), blob[4 + size :]

    def kids(node: int) -> int:
        unit = trie[node]
        return node ^ ((unit >> 10) << ((unit & 1 << 9) >> 6))

    out, todo = {}, [(0, b"")]
    while todo:
        node, word = todo.pop()
        below = kids(node)
        if trie[node] >> 8 & 1 and word:  # the node ends a source; its target's place is at the empty label
            place = trie[below] & 0x7FFFFFFF
            out[word.decode("utf-8", "replace")] = targets[place : targets.index(b"\0", place)].decode()
        for byte in range(1, 256):
            at = below ^ byte
            if at < len(trie) and trie[at] & 0x800000FF == byte:
                todo.append((at, word + bytes([byte])))
    return out


def from_proto(model) -> Transducer:
    """A unigram or BPE model; user-defined pieces are supported in the latter only."""
    kind = model.trainer_spec.model_type
    if kind not in (1, 2):
        raise ValueError(f"model type {kind} is not supported")
    pieces, fallback, unknown, out, frozen = {}, [0] * 256, 0, [], {}
    for i, p in enumerate(model.pieces):
        out.append(b"")
        if p.type == p.NORMAL:
            pieces[p.piece] = (i, p.score)
            out[i] = p.piece.encode()
        elif p.type == p.BYTE:
            fallback[int(p.piece[3:5], 16)] = i
            out[i] = bytes([int(p.piece[3:5], 16)])
        elif p.type == p.UNKNOWN:
            unknown = i
            out[i] = model.trainer_spec.unk_surface.encode()
        elif p.type == p.USER_DEFINED:
            if kind == 1:
                raise ValueError("user-defined pieces are not supported in a unigram model")
            frozen[p.piece] = i
            out[i] = p.piece.encode()
    spec = model.normalizer_spec
    bytes_too = fallback if model.trainer_spec.byte_fallback else []
    return Transducer(kind, pieces, bytes_too, unknown, out, character_map(spec.precompiled_charsmap), frozen, spec.add_dummy_prefix, spec.remove_extra_whitespaces)


def encode_pieces(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with ids (array of int), n_tokens and round_trip (whether decoding gives the text back).

    A null text has null ids and 0 tokens, an empty one no ids; both count as round trips. Texts with characters
    that the normaliser changes, or with the blank mark itself, do not come back as they were. Rows are encoded one by
    one, whole, however long; equal texts get equal ids. New columns replace input columns of the same name. An empty
    table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(compile_model(path))

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m, texts = model.value, batch.column(text).to_pylist()
        made = m.encode_all(texts)
        same = [t is None or m.decode(x) == t for t, x in zip(texts, made, strict=True)]
        sizes = np.array([len(x) for x in made], dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        flat = pa.array(np.concatenate(made) if made else np.zeros(0, np.int32))
        ids = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([t is None for t in texts], pa.bool_()))
        return {"ids": ids, "n_tokens": pa.array(sizes), "round_trip": pa.array(same, pa.bool_())}

    return add_columns(docs, "ids array<int>, n_tokens long, round_trip boolean", work, text, keep)


def decode_pieces(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """tokens with the text that ids stand for; null ids give a null text, no ids an empty one. Ids outside the model
    raise an error. Rows are decoded one by one; a column of the text's name is replaced. An empty table gives an empty
    result."""
    from pyspark.sql import functions as F

    model = tokens.sparkSession.sparkContext.broadcast(compile_model(path))

    @F.pandas_udf("string")
    def decode(column):
        import pandas as pd

        return pd.Series([None if x is None else model.value.decode(np.asarray(x)) for x in column])

    return tokens.withColumn(text, decode(ids))
