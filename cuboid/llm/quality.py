"""Quality rules: base counts, and language-specific perplexity bands of a modified Kneser-Ney n-gram model.

The model's units are characters, of 12 bits each, so that an n-gram of order 5 is a 60-bit integer. Spark counts the
n-grams of all documents that pass the base rule and hold few symbols, and derives continuation counts, discounts,
probabilities and back-off weights by aggregations and joins. The model grows with the corpus. It is kept as sorted
arrays of 64-bit hashes in files of the shared folder, which tasks load; nothing of it passes through the driver.

No text is judged by what it taught: a language has two models, each counted over the half of its texts that a hash of
the whole text gives, and each text is scored by the other half's. Equal texts are in one half, so that a group of copies
does not vouch for itself either. The bands come from these held-out scores too.

A model of more than max_entries is cut into shards by the two characters before the one that is scored: all n-grams
and contexts that a character's probability needs have these in common, but for the few of the lowest orders, which every
shard gets. Each shard is scored in a pass over the texts, and the passes' sums are added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuboid.llm.tables import add_columns, drop, fresh, saved
from cuboid.llm.textops import HELD, Words, let_go, mix, signed, slices, windows

BITS = 12  # of a character: code points under 3072 are themselves, the rest fall on 1024 classes
CLASSES = 1 << BITS
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@dataclass(frozen=True)
class Rules:
    """Parameters. min_words and repeat_percent: the base rule. seed_symbols: a document trains the model if it
    passes the base rule and has at most one symbol per seed_symbols words. width: how many deviations wide a band
    is to either side. floor: the spread of the mean log-probability that even very long documents have. max_entries:
    n-grams and contexts that a task holds at once, of 12 bytes each. held_rows: counts that a task adds up before it
    hands them on, of 16 bytes each. order is 5 at most."""

    order: int = 5
    min_words: int = 20
    repeat_percent: int = 30
    repeat_window: int = 8
    seed_symbols: int = 10
    width: float = 8.0
    floor: float = 0.02
    max_entries: int = 1 << 26
    held_rows: int = 1 << 20


def _grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of each text, and the number of them per text."""
    pad = " " * (order - 1)
    joined = pad + pad.join(texts)  # each text begins after white space
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes = np.where(codes < 3072, codes, 3072 + codes % 1024)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    m = len(codes) - order + 1
    gram = np.zeros(max(m, 0), dtype=np.int64)
    for k in range(order):
        gram <<= BITS
        gram |= codes[k : k + m]
    keep = np.ones(len(gram), dtype=bool)
    ends = np.cumsum(sizes + order - 1)[:-1]  # windows whose last character is padding
    for k in range(order - 1):
        keep[ends[ends + k < len(gram)] + k - (order - 1)] = False
    return gram[keep], sizes


def base_counts(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each text."""
    words = Words(column)
    n = words.rows
    found, at = windows(words.hashes(), words.first, rules.repeat_window)
    doc = words.doc[at] if len(at) else np.zeros(0, np.int64)
    repeated = np.zeros(n, dtype=np.int64)
    order = np.lexsort((found, doc)) if len(found) else np.zeros(0, np.int64)
    f, d = found[order], doc[order]
    same = (f[1:] == f[:-1]) & (d[1:] == d[:-1]) if len(f) else np.zeros(0, bool)
    twice = np.zeros(len(f), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order][twice]
    if len(starts):
        step = np.zeros(len(words.start) + 1, dtype=np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + rules.repeat_window, -1)
        covered = np.cumsum(step)[:-1] > 0
        repeated = np.bincount(words.doc[covered], minlength=n).astype(np.int64)
    data, offsets = words.data.tobytes(), words.offsets.tolist()
    dup = np.zeros(n, dtype=np.int64)
    for k in range(n):
        lines = data[offsets[k] : offsets[k + 1]].split(b"\n")
        if len(lines) > len(set(lines)):
            lines = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            dup[k] = len(lines) - len(set(lines))
    failed = (words.counts < rules.min_words) | (100 * repeated > rules.repeat_percent * words.counts)
    return {
        "n_words": words.counts, "word_chars": words.code_points(), "n_symbols": words.per_text(_SYMBOLS[words.data]),
        "n_dup_lines": dup, "n_repeat_words": repeated, "base_failed": failed,
    }


def halves(texts: list[str | None]) -> np.ndarray:
    """The half (0 or 1) that each text belongs to, by all its bytes."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), 5) & 1 for t in texts], dtype=np.int64)


def _models(langs: pa.Array, half: np.ndarray) -> np.ndarray:
    """The name of the model of each language and half."""
    return np.array([f"{h}{x or ''}" for x, h in zip(langs.to_pylist(), half.tolist(), strict=True)], dtype=object)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the sums of their counts."""
    values, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))[: len(values)])
    return values[new], np.add.reduceat(counts, new) if len(new) else counts


def count_ngrams(docs: DataFrame, rules: Rules, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): counts of the highest order's n-grams over every document that trains a model; lang names it.

    A task adds up the counts of its batches as far as they are at most rules.held_rows, then hands them on."""

    def rows(held):
        for one, parts in sorted(held.items()):
            values, counts = _summed(parts)
            for k in range(0, len(values), 1 << 17):
                v, n = values[k : k + (1 << 17)], counts[k : k + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.repeat(one, len(v)), pa.array(v), pa.array(n)], names=["lang", "gram", "n"])

    def run(batches):
        held, size = {}, 0
        for batch in slices(batches, text):
            base = base_counts(batch.column(text), rules)
            seed = ~base["base_failed"] & (rules.seed_symbols * base["n_symbols"] <= base["n_words"])
            texts = batch.column(text).to_pylist()
            models = _models(batch.column(lang), halves(texts))
            for one in sorted(set(models[seed])):
                gram, _ = _grams([texts[k] for k in np.flatnonzero(seed & (models == one))], rules.order)
                values, counts = np.unique(gram, return_counts=True)
                held.setdefault(one, []).append((values, counts.astype(np.int64)))
                size += len(values)
            if size > rules.held_rows:
                held = {one: [_summed(parts)] for one, parts in held.items()}
                size = sum(len(v) for parts in held.values() for v, _ in parts)
            if 2 * size > rules.held_rows:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)

    frame = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    text, lang = "text", "lang"
    return frame.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(lang, k, gram, logp, backoff): natural logarithms. logp: of the seen n-grams of orders 1 to order;
    backoff: the weight of the lower order after the context gram, null for the highest order."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = saved(tables[k + 1].select("lang", (F.col("gram") % CLASSES**k).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")))
    out, lower = [], None
    for k in range(1, order + 1):
        t = tables[k].withColumn("ctx", F.expr(f"gram div {CLASSES}"))
        r = [F.sum((F.col("n") == i).cast("double")).alias(f"r{i}") for i in range(1, 5)]
        y = F.col("r1") / F.greatest(F.col("r1") + 2 * F.col("r2"), F.lit(1e-9))
        held = lambda i: F.least(F.greatest(i - (i + 1) * y * F.col(f"r{i + 1}") / F.greatest(F.col(f"r{i}"), F.lit(1.0)), F.lit(0.1)), F.lit(float(i) - 0.1))
        d = t.groupBy("lang").agg(*r).select("lang", *[held(i).alias(f"d{i}") for i in range(1, 4)])
        t = t.join(F.broadcast(d), "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        c = t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
        t = t.join(c, ["lang", "ctx"])
        if lower is None:
            t = t.withColumn("low", F.lit(1.0 / CLASSES))
        else:
            t = t.withColumn("below", F.col("gram") % CLASSES ** (k - 1)).join(lower, ["lang", "below"])
        t = t.withColumn("p", (F.col("n") - F.col("d") + F.col("mass") * F.col("low")) / F.col("total"))
        lower = saved(t.select("lang", F.col("gram").alias("below"), F.col("p").alias("low")))
        out.append(lower.select("lang", F.lit(k).alias("k"), F.col("below").alias("gram"), F.log("low").alias("logp"), F.lit(None).cast("double").alias("backoff")))
        out.append(c.select("lang", F.lit(k - 1).alias("k"), F.col("ctx").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log(F.col("mass") / F.col("total")).alias("backoff")))
    model = out[0]
    for x in out[1:]:
        model = model.unionByName(x)
    return model.groupBy("lang", "k", "gram").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"))


def _hash(langs: np.ndarray, k: int, gram: np.ndarray) -> np.ndarray:
    """Keys of n-grams (k > 0) or contexts (k <= 0) of languages, given by their own hashes."""
    return signed(mix(mix(gram.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * abs(k) + (k <= 0) + 1) % 2**64)) ^ langs))


def _lang_hash(name: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest((name or "").encode("utf-8", "surrogatepass"), 11))


def _two_before(k: int, gram: np.ndarray) -> np.ndarray:
    """The two characters before the scored one: of an n-gram of k characters, or of a context of -k."""
    return (gram >> BITS if k > 0 else gram) & (CLASSES**2 - 1)


def _spread(chars: np.ndarray, shards: int) -> np.ndarray:
    return (mix(chars.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def write_model(model: DataFrame, rules: Rules) -> tuple[str, int]:
    """Writes the model's sorted hash arrays (h, value) as files of the shared folder, a folder a shard (-1: for all),
    and returns their place and the number of shards."""
    shards = max(1, -(-2 * model.count() // rules.max_entries))

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names = np.array([_lang_hash(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)[langs.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.uint64)
            k, gram = batch.column("k").to_numpy(), batch.column("gram").to_numpy()
            for value, sign in ((batch.column("logp"), 1), (batch.column("backoff"), -1)):
                value = value.to_numpy(zero_copy_only=False).astype(float)
                for i in range(rules.order + 1):
                    at = np.flatnonzero((k == i) & ~np.isnan(value))
                    low = i < 3 if sign > 0 else i < 2
                    shard = np.full(len(at), -1, np.int32) if low else _spread(_two_before(sign * i, gram[at]), shards)
                    yield pa.RecordBatch.from_arrays([pa.array(_hash(names[at], sign * i, gram[at])), pa.array(value[at].astype(np.float32)), pa.array(shard)], names=["h", "value", "shard"])

    rows = model.mapInArrow(run, "h long, value float, shard int")
    # ranges of hashes are even, so no file of the sorted array is large
    return saved(rows.repartitionByRange("shard", "h").sortWithinPartitions("shard", "h"), by="shard").saved_at, shards


def _load(place: str, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """One shard's arrays with those for all; a task's process holds one at a time."""
    if (place, shard) not in HELD:
        let_go()
        system, root = fs.FileSystem.from_uri(place)
        found = []
        for one in (shard, -1):
            at = f"{root}/shard={one}"
            if system.get_file_info(at).type == fs.FileType.Directory:
                found += [i.path for i in system.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".parquet")]
        sizes = []
        for path in found:
            with system.open_input_file(path) as f:
                sizes.append(pq.ParquetFile(f).metadata.num_rows)
        keys, values, done = np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.float32), 0
        for path, size in zip(found, sizes, strict=True):  # one file at a time, so that little is held twice
            with system.open_input_file(path) as f:
                part = pq.read_table(f, columns=["h", "value"])
            keys[done : done + size], values[done : done + size] = part["h"].to_numpy(), part["value"].to_numpy()
            done += size
            del part
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        values = values[order]
        HELD[place, shard] = keys, values
        del order
        pa.default_memory_pool().release_unused()
    return HELD[place, shard]


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    have, values = table
    if not len(have):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    order, at = np.argsort(keys), np.empty(len(keys), np.int64)
    at[order] = np.minimum(np.searchsorted(have, keys[order]), len(have) - 1)  # ascending keys find their place sooner
    hit = have[at] == keys
    return hit, np.where(hit, values[at], np.float32(0)).astype(np.float64)


def log_probability(table: tuple[np.ndarray, np.ndarray], lang: np.uint64, gram: np.ndarray, order: int) -> np.ndarray:
    """Natural log-probability of each n-gram's last character after those before it."""
    distinct, back = np.unique(gram, return_inverse=True)
    out, left = np.zeros(len(distinct)), np.arange(len(distinct))
    for k in range(order, 0, -1):
        key = distinct[left] & ((1 << BITS * k) - 1)
        hit, value = _find(table, _hash(lang, k, key))
        out[left[hit]] += value[hit]
        left, key = left[~hit], key[~hit]
        out[left] += _find(table, _hash(lang, 1 - k, key >> BITS))[1]
    out[left] -= np.log(CLASSES)
    return out[back]


def score(docs: DataFrame, model: tuple[str, int], rules: Rules, text: str, lang: str, keep: list[str], nll: str, units: str) -> DataFrame:
    """docs with base counts, and columns nll (mean negative log-probability per character by the model of the other half;
    null without characters or where there is no such model) and units (how many). model comes from write_model."""
    place, shards = model
    out, counts = docs, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    total = fresh([*docs.columns, *BASE, nll, units], "_sum")
    names = list(dict.fromkeys([*keep, text, lang]))
    for shard in range(shards):
        last, head = shard == shards - 1, shard == 0

        def work(batch: pa.RecordBatch, shard=shard, last=last, head=head) -> dict[str, pa.Array]:
            table = _load(place, shard)
            made = base_counts(batch.column(text), rules) if head else {}
            texts = batch.column(text).to_pylist()
            models = _models(batch.column(lang), 1 - halves(texts))
            sums = np.zeros(batch.num_rows) if head else batch.column(total).to_numpy().copy()
            size = np.array([len(t or "") for t in texts], dtype=np.int64)
            known = np.zeros(batch.num_rows, bool)
            for one in set(models):
                code = _lang_hash(one)
                if not _find(table, _hash(code, 0, np.zeros(1, np.int64)))[0][0]:  # every model has the empty context
                    continue
                at = np.flatnonzero((models == one) & (size > 0))
                known[at] = True
                for part in np.array_split(at, max(1, int(size[at].sum()) >> 19)) if len(at) else ():
                    gram, n = _grams([texts[k] for k in part], rules.order)
                    mine = _spread(_two_before(rules.order, gram), shards) == shard if shards > 1 else slice(None)
                    each = np.zeros(len(gram))
                    each[mine] = log_probability(table, code, gram[mine], rules.order)
                    upto = np.concatenate(([0.0], np.cumsum(each)))
                    ends = np.cumsum(n)
                    sums[part] -= upto[ends] - upto[ends - n]
            found = {k: pa.array(v) for k, v in made.items()} if head else {k: batch.column(k) for k in BASE}
            if last:
                return found | {nll: pa.array(sums / np.maximum(size, 1), mask=~known), units: pa.array(size)}
            return found | {total: pa.array(sums)}

        if last:
            return add_columns(out, counts + f"`{nll}` double, `{units}` long", work, text, list(keep), holds=True)
        # a row's sum travels with its text to the next shard
        out = saved(add_columns(out, counts + f"`{total}` double", work, text, names, holds=True), *([] if head else [out]))


def _median(rows: DataFrame, group: str, value: Column, step: float) -> DataFrame:
    """(group, median) of a value rounded to multiples of step: exact counts, equal in any partitioning."""
    bins = rows.groupBy(group, F.round(value / step).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    bins = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    return bins.filter("2 * upto >= all").groupBy(group).agg((F.min("bin") * step).alias("median"))


def bands(scored: DataFrame, rules: Rules, lang: str, nll: str, units: str) -> DataFrame:
    """A saved table (band_lang, centre, spread): median mean log-probability of the documents that train the model, and
    the robust spread of one character, per language."""
    seed = scored.filter(~F.col("base_failed") & F.col(nll).isNotNull() & (rules.seed_symbols * F.col("n_symbols") <= F.col("n_words")))
    seed = seed.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("band_lang"), F.col(nll).alias("nll"), F.col(units).alias("units"))
    centre = saved(_median(seed, "band_lang", F.col("nll"), 1e-4).withColumnRenamed("median", "centre"))
    off = seed.join(F.broadcast(centre), "band_lang").withColumn("off", F.log(F.col("units") * F.pow(F.col("nll") - F.col("centre"), 2) + 1e-12))
    # 0.4549 is the median of a squared standard normal deviate
    off = _median(off, "band_lang", F.col("off"), 0.005)
    return saved(centre.join(off, "band_lang").select("band_lang", "centre", F.sqrt(F.exp("median") / 0.4549).alias("spread")), centre)


def judge(scored: DataFrame, limits: DataFrame, rules: Rules, lang: str, nll: str, units: str) -> DataFrame:
    """scored with perplexity, lower, upper (the band at the document's length) and kept."""
    key, centre, spread = (fresh(scored.columns, f"_{c}") for c in ("band_lang", "centre", "spread"))
    limits = limits.select(F.col("band_lang").alias(key), F.col("centre").alias(centre), F.col("spread").alias(spread))
    width = rules.width * F.sqrt(F.pow(spread, 2) / F.greatest(F.col(units), F.lit(1)) + rules.floor**2)
    outside = (F.col("perplexity") < F.col("lower")) | (F.col("perplexity") > F.col("upper"))
    # a row a language, and languages are few
    out = scored.join(F.broadcast(limits), F.coalesce(F.col(lang).cast("string"), F.lit("")) == F.col(key), "left")
    out = out.withColumns({"perplexity": F.exp(nll), "lower": F.exp(F.col(centre) - width), "upper": F.exp(F.col(centre) + width)})
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False)))
    return out.drop(key, centre, spread, nll, units)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs with base counts, perplexity, the band (lower, upper) of its language and length, and kept.

    A null or empty text has no words and fails the base rule. A null language is a language of its own (that of the
    empty name). Where no document of the other half of a language trains its model a text has no perplexity; there the
    base rule alone decides, as it does for languages without a band. Rows are judged one by one, texts of any length whole, so equal rows get equal verdicts. keep names
    the input columns to return (all by default); new columns replace input columns of the same name, others cannot
    clash. An empty table gives an empty result."""
    made = [*BASE, "perplexity", "lower", "upper", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    docs = docs.select(*dict.fromkeys([*names, text, lang]))
    nll, units = (fresh([*docs.columns, *made], c) for c in ("_nll", "_units"))
    counts = saved(count_ngrams(docs, rules, text, lang))
    grams = saved(kneser_ney(counts, rules.order), counts)
    model = write_model(grams, rules)
    drop(grams)
    # texts that are returned travel with their scores, as scoring costs more than writing
    scored = saved(score(docs, model, rules, text, lang, list(dict.fromkeys([*names, lang])), nll, units))
    return judge(scored, bands(scored, rules, lang, nll, units), rules, lang, nll, units).select(*names, *made)
