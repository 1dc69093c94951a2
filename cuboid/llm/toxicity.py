"""Toxicity: a learned, weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, maps homoglyphs and digits or signs that stand for letters to plain letters, and turns all that
is no letter into blanks. Patterns begin at a word's start. Spark counts patterns in a bounded sample of labelled
documents; those that tell toxic from other documents enter the lexicon with their log-odds as weight. An exception
phrase takes back the weight of the patterns it contains.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuboid.llm.tables import add_columns, saved
from cuboid.llm.textops import slices

# Letters that look like others (Cyrillic, Greek, full width, accents set aside), and stand-ins.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s", "ɑ": "a", "ɡ": "g",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "scum layer", "class clown")


@dataclass(frozen=True)
class Lexicon:
    """sample: labelled documents of each class that are used at most, the first by a hash of doc_id (the bound of
    what is learned from). shortest, longest: letters of a pattern. least_docs: toxic documents that hold it.
    least_odds: log-odds of a lexicon pattern. size: patterns at most, the strongest ones."""

    sample: int = 6000
    shortest: int = 4
    longest: int = 9
    least_docs: int = 5
    least_odds: float = 2.5
    size: int = 5000


_FOLD: dict[int, str | None] = {}


class _Table(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = c if c.isalpha() else " "
        if 0xFF21 <= code <= 0xFF5A:
            out = chr(code - 0xFEE0).lower() if chr(code - 0xFEE0).isalpha() else " "
        self[code] = out
        return out


def _tables() -> tuple[_Table, _Table]:
    plain = _Table({ord(k): v for k, v in HOMOGLYPHS.items()})
    for code in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF):  # invisible
        plain[code] = ""
    spelt = _Table(plain | {ord(k): v for k, v in STAND_INS.items()})
    return plain, spelt


def fold(text: str, tables: tuple[_Table, _Table]) -> str:
    """The folded text with a blank before every word. Stand-ins become letters only between letters or before one."""
    import re

    low = text.lower()
    if re.search(r"[0134578@$!|]", low):
        low = re.sub(r"(?<![^\W\d_])[0134578@$!|](?=[^\W\d_])|(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])", lambda m: m[0].translate(tables[1]), low)
    return " " + low.translate(tables[0])


def _patterns(text: str, p: Lexicon) -> set[str]:
    out = set()
    for word in set(text.split()):
        for n in range(p.shortest, min(p.longest, len(word)) + 1):
            out.add(word[:n])
        if len(word) < p.shortest:
            out.add(word + " ")
    return out


def learn_lexicon(sample: DataFrame, p: Lexicon, text: str = "text") -> dict[str, float]:
    """Weights of the patterns (a blank ends a whole word). sample: text and toxic (0 or 1), of bounded size."""

    def run(batches):
        tables = _tables()
        for batch in slices(batches, text, 1 << 20):
            counts = {0: Counter(), 1: Counter()}
            for t, y in zip(batch.column(text).to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[y].update(_patterns(fold(t or "", tables), p))
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["pattern", "bad", "good"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    rows = sample.select(text, "toxic").mapInArrow(run, "pattern string, bad long, good long").groupBy("pattern").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    rows = rows.withColumn("odds", odds).filter((F.col("bad") >= p.least_docs) & (F.col("odds") >= p.least_odds))
    found = {r["pattern"]: (r["odds"], r["bad"]) for r in rows.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "pattern").limit(p.size).collect()}
    out: dict[str, float] = {}
    for pattern in sorted(found, key=lambda x: (len(x), x)):
        shorter = [pattern[:n] for n in range(p.shortest, len(pattern)) if pattern[:n] in out]
        # a longer pattern adds nothing where a shorter one is about as telling
        if not shorter or found[pattern][0] > max(found[s][0] for s in shorter) + 1:
            out[pattern] = found[pattern][0] - sum(out[s] for s in shorter)
    return out


class Matcher:
    """Sums of weights, by one automaton over patterns and exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str]):
        import ahocorasick

        self.tables = _tables()
        weights = {" " + k: v for k, v in lexicon.items()}
        for phrase in exceptions:
            inner = fold(phrase, self.tables) + " "
            back = sum(v for k, v in weights.items() if k in inner)
            if back:
                weights[inner] = weights.get(inner, 0.0) - back
        self.automaton = ahocorasick.Automaton()
        for k, v in weights.items():
            self.automaton.add_word(k, v)
        if weights:
            self.automaton.make_automaton()
        self.empty = not weights

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the weight found, and the weight per 100 words."""
        folded = fold(text or "", self.tables) + " "
        total = 0.0 if self.empty else sum(v for _, v in self.automaton.iter(folded))
        words = folded.count(" ") or 1
        return float(np.log1p(max(total, 0.0))), max(total, 0.0) * 100 / max(words, 20)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (constant last) by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - q) - ridge * b)
    return b


def held_out(doc_id: str):
    """Whether a row may not be learned from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, p: Lexicon = Lexicon(), doc_id: str = "doc_id", text: str = "text", exceptions: Sequence[str] = EXCEPTIONS, keep: list[str] | None = None) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    labels has doc_id and toxic (0, 1 or null). Lexicon and coefficients are learned from at most p.sample labelled
    documents a class that are not held out. Null and empty texts get the score of a text without matches; without
    labels of both classes every score is 0. Repeated rows get equal scores. New columns replace input columns of the
    same name. An empty table gives an empty result."""
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).alias("_id"), "toxic").filter(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull()).filter(~held_out("_id"))
    picks = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(p.sample) for y in (0, 1)]
    picked = saved(picks[0].unionByName(picks[1]))
    sample = saved(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id").select("text", "toxic"))
    # half of the sample finds the patterns and the other half sets their scale, so that chance finds weigh little
    part = F.pmod(F.xxhash64("text"), F.lit(2))
    lexicon = learn_lexicon(sample, p)
    half = learn_lexicon(sample.filter(part == 0), p)
    trial = spark.sparkContext.broadcast((half, tuple(exceptions)))

    def measure(batches):
        matcher = Matcher(*trial.value)
        for batch in batches:
            found = [matcher.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["toxic", "a", "b"])

    fit = sample.filter(part == 1).mapInArrow(measure, "toxic int, a double, b double").toPandas()
    b = _logistic(fit[["a", "b"]].to_numpy(), fit["toxic"].to_numpy(float)) if fit["toxic"].nunique() == 2 else None
    model = spark.sparkContext.broadcast((lexicon, tuple(exceptions), b))
    matchers: list[Matcher] = []

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lexicon, phrases, b = model.value
        if not matchers:
            matchers.append(Matcher(lexicon, phrases))
        found = np.array([matchers[0].features(t) for t in batch.column(text).to_pylist()]).reshape(-1, 2)
        scores = np.zeros(len(found)) if b is None else 1 / (1 + np.exp(-np.clip(found @ b[:2] + b[2], -30, 30)))
        return {"held_out": batch.column("held_out"), "score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32))}

    names = docs.columns if keep is None else keep
    rows = docs.withColumn("held_out", held_out(doc_id))
    return add_columns(rows, "held_out boolean, score double, predicted int", work, text, [c for c in names if c != "held_out"])
