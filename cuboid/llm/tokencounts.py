"""Token counts of whole texts under a byte-level pair merging vocabulary, mostly without merging anything.

Offline, before any text is read, every string of the vocabulary is proved: its own merges are run, and it is *whole* if
they end in one token. A part of a text that equals a whole string is one token. Only other parts are merged, with a
queue of pairs, so that a part of n bytes costs n log n; a task remembers the counts of the short ones it has met.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from cuboid.llm.tables import add_columns
from cuboid.llm.textops import HELD, let_go

#: How texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points under this one are assigned in every version of the character tables.
_OLD = 0x557
#: Lengths (in code points) of the parts whose counts a task remembers, and how many of them.
_SHORT, _REMEMBERED = 64, 1 << 18
#: Texts longer than this are cut lazily, so that no list of all their parts exists.
_LONG = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the others for
    the code points from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A vocabulary's merges over token ids, as read from its file.

    Raises ValueError for files whose settings change what is counted here: normalisers, other ways of cutting,
    unknown tokens, dropout, vocabulary look-ups before merging, and added tokens with own rules of matching."""

    def __init__(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
        if not plain or spec.get("normalizer") or any(odd):
            raise ValueError("counts need plain byte-level merges")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that match by rules are not supported")
        vocab, letters = model["vocab"], byte_letters()
        self.byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda kv: kv[1])]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.strings = [bytes(letters[c] for c in s) for s in vocab if s not in set(self.added) and all(c in letters for c in s)]

    def count(self, data: bytes) -> int:
        """The tokens that the merges leave of data: the pair of the lowest rank first, the leftmost of equal ones."""
        ids = [self.byte[b] for b in data]
        n = len(ids)
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        queue = [(p[0], i, p[1], ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        left = n
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], left = made, -1, left - 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get((made, ids[k])):
                    heapq.heappush(queue, (p[0], i, p[1], made, ids[k]))
            if (h := before[i]) >= 0 and (p := pairs.get((ids[h], made))):
                heapq.heappush(queue, (p[0], h, p[1], ids[h], made))
        return left


def whole_strings(merges: Merges) -> list[str]:
    """The vocabulary's strings that are proved to encode alone as one token. Strings that are no UTF-8 are left out: no
    part of a text equals them."""
    out = []
    for s in merges.strings:
        try:
            text = s.decode()
        except UnicodeDecodeError:
            continue
        if merges.count(s) == 1:
            out.append(text)
    return out


def newer_letters() -> str:
    """A character class of the letters and numbers that the pattern's engine knows and the library's older tables do
    not: the library, asked once about every code point that this Python's tables lack, cuts them as symbols."""
    odd = "".join(chr(c) for c in range(_OLD + 1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", odd) if len(cut(f"a{c}")) == len(cut(f"1{c}"))]
    gaps = [i for i in range(1, len(found)) if found[i] != found[i - 1] + 1]
    return "".join(f"{chr(found[i])}-{chr(found[j - 1])}" for i, j in zip([0, *gaps], [*gaps, len(found)], strict=True) if found)


class Counter(dict):
    """Token counts by part. Whole strings are there from the start; others are merged when they are first met."""

    def __init__(self, whole: Iterable[str], merges: Merges, newer: str):
        super().__init__(dict.fromkeys(whole, 1))
        self.merges, self.room = merges, _REMEMBERED
        self.added = regex.compile("|".join(regex.escape(t) for t in sorted(merges.added, key=len, reverse=True))) if merges.added else None
        self.cut = regex.compile(PATTERN)
        self.beyond = regex.compile(f"[^\x00-{chr(_OLD)}]")
        self.newer = regex.compile(f"[{newer}]") if newer else None
        self.cut_newer = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{newer}])").replace(r"\p{L}+", f"(?:(?![{newer}])\\p{{L}})+").replace(r"\p{N}+", f"(?:(?![{newer}])\\p{{N}})+")) if newer else None

    def __missing__(self, part: str) -> int:
        n = self.merges.count(part.encode())
        if len(part) <= _SHORT and self.room > 0:
            self.room -= 1
            self[part] = n
        return n

    def tokens(self, text: str) -> int:
        """The tokens of a text. Strings of added tokens are a token each, and nothing merges across them."""
        if self.added is None:
            return self._plain(text)
        found, at, n = self.added.finditer(text), 0, 0
        for m in found:
            n, at = n + self._plain(text[at : m.start()]) + 1, m.end()
        return n + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        cut = self.cut
        if self.newer and self.beyond.search(text) and self.newer.search(text):
            cut = self.cut_newer
        if len(text) <= _LONG:
            return sum(map(self.__getitem__, cut.findall(text)))
        parts, n = (m.group() for m in cut.finditer(text)), 0
        while some := list(islice(parts, 1 << 16)):
            n += sum(map(self.__getitem__, some))
        return n


def texts(column: pa.Array) -> Iterator[str]:
    """The column's texts; a null is empty, and bytes that are no UTF-8 count as U+FFFD."""
    for x in column.cast(pa.binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns of keep) with n_bytes, n_tokens and over_limit (more than limit tokens) of every whole text.

    vocabulary: a .json file of the tokenizers library, read by the driver; its size, some 50,000 strings, bounds what
    tasks get. Counts equal the library's without begin, end or added special tokens; strings of its added tokens inside
    texts are one token each, which is the library's default. Null and empty texts have 0 tokens; rows are counted one by
    one, so that repeated rows and ties are no case, and no rows give no rows. Columns of the new names are replaced;
    others stay as they are. A text of any length is counted whole; only the texts of one batch are in memory."""
    with open(vocabulary, encoding="utf-8") as f:
        merges = Merges(json.load(f))
    held = docs.sparkSession.sparkContext.broadcast((merges, whole_strings(merges), newer_letters()))
    name = f"token counts {vocabulary}"

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if name not in HELD:
            let_go()
            own, whole, newer = held.value
            HELD[name] = Counter(whole, own, newer)
        counter, column = HELD[name], batch.column(text)
        n = np.fromiter((counter.tokens(t) for t in texts(column)), np.int64, len(column))
        size = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).cast(pa.int64())
        return {"n_bytes": size, "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

    return add_columns(docs, "n_bytes long, n_tokens long, over_limit boolean", work, text, keep, holds=True)
