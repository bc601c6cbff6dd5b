"""Quality rules: n-gram perplexity under a modified Kneser-Ney model.

Units are characters (white space counts as a space, a digit as 0; characters
beyond the first 65,536 share 6,400 codes), so a run of four is a 64-bit code.
Counts come from every document: each task pre-aggregates its n-grams and Spark
sums them, derives the continuation counts of the lower orders and the three
discounts, and interpolates the probability of every n-gram of the highest order,
however rare. As the documents that are scored are those that were counted, each
of their n-grams has an entry. The n-grams whose share in all counts is 1/HOT at
least, at most HOT with all languages together, are broadcast as sorted arrays
that are looked up by binary search; all others are joined, and as each is rare,
none of these keys can be skewed. Logarithms are summed as whole numbers, so the
result doesn't depend on which way an n-gram went.

A document is rejected by the base rules, or when its mean log perplexity lies
outside the band of its language: the quartiles of all documents that pass the
base rules, widened on both sides by ``spread`` interquartile ranges.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import Tally, Words, batches_of, chunks, code_points, mix, signed, store

ORDER = 4
BITS = 16
ALPHABET = 1 << BITS
#: At most this many n-grams are broadcast; the others are joined.
HOT = 1 << 19
#: Logarithms of probabilities are whole multiples of 1/SCALE.
SCALE = 1 << 24
UNKNOWN = "und"
#: Width of the bins of log perplexity from which quartiles are read.
BIN = 0.002


def _table() -> np.ndarray:
    table = np.arange(ALPHABET, dtype=np.uint64)
    table[:32] = 32
    for c in range(ALPHABET):
        if chr(c).isspace():
            table[c] = 32
        elif chr(c).isdigit():
            table[c] = 48
    return table


_CODE: list[np.ndarray] = []
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def codes(text: str) -> np.ndarray:
    """Code of each character."""
    if not _CODE:
        _CODE.append(_table())
    cp = code_points(text)
    return _CODE[0][np.where(cp < ALPHABET, cp, 0xE000 + cp % 0x1900)]


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """Codes of the n-grams that end at each character; 0 is padding in front of a text."""
    c = np.concatenate([np.zeros(order - 1, np.uint64), codes(text)])
    n = len(c) - order + 1
    out = c[:n].copy()
    for i in range(1, order):
        out <<= np.uint64(BITS)
        out |= c[i : n + i]
    return out


def _last(grams: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` characters of each n-gram."""
    return grams & np.uint64((1 << (BITS * k)) - 1)


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys)
    order = np.argsort(h)
    return h[order], values[order].astype(np.float32)


@dataclass
class KneserNey:
    """For each order from 1 up: hashes of n-grams and log10 probabilities, hashes of contexts and log10 back-off weights."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def add(self, keys: np.ndarray, n: np.ndarray, contexts: np.ndarray, totals: np.ndarray, discounts: np.ndarray) -> None:
        """Add the next order: n-grams with their counts, and their contexts with the totals of all counts."""
        order = np.argsort(contexts)
        contexts, totals = contexts[order], totals[order].astype(float)
        own = np.searchsorted(contexts, keys >> np.uint64(BITS))
        left = n - discounts[np.minimum(n, 3)]
        weight = np.clip(1 - np.bincount(own, left, len(contexts)) / np.maximum(totals, 1), 1e-9, 1)
        lower = 10.0 ** self.score(_last(keys, len(self.levels))).astype(float)
        p = left / totals[own] + weight[own] * lower
        self.levels.append((*_sorted(keys, np.log10(p)), *_sorted(contexts, np.log10(weight))))

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for level in self.levels for a in level)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last character of each n-gram."""
        out = np.zeros(len(keys), np.float32)
        todo = np.arange(len(keys))
        for k in range(len(self.levels), 0, -1):
            have, logp, heads, back = self.levels[k - 1]
            keys = _last(keys, k)
            at, found = _find(have, mix(keys))
            out[todo[found]] += logp[at[found]]
            todo, keys = todo[~found], keys[~found]
            if not len(todo):
                return out
            at, found = _find(heads, mix(keys >> np.uint64(BITS)))
            out[todo[found]] += back[at[found]]
        out[todo] -= np.float32(np.log10(ALPHABET))
        return out


def _find(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(have, keys), max(0, len(have) - 1))
    return at, have[at] == keys if len(have) else np.zeros(len(keys), bool)


def _discounts(t: dict[int, int]) -> np.ndarray:
    """The three discounts of the modified form, from how many n-grams were seen once to four times."""
    t = {i: t.get(i, 0) for i in range(1, 5)}
    y = t[1] / (t[1] + 2 * t[2]) if t[1] and t[2] else 0.5
    d = np.array([0.0, 0.5, 0.75, 0.9])
    for i in (1, 2, 3):
        if t[i] and t[i + 1]:
            d[i] = i - (i + 1) * y * t[i + 1] / t[i]
    return np.clip(d, [0.0, 0.05, 0.05, 0.05], [0.0, 0.95, 1.9, 2.9])


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over every document; a null language is ``und``."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: dict[str, Tally] = {}
        for part in chunks(batches, "text"):
            by: dict[str, list] = {}
            for lang, text in zip(part["lang"], part["text"], strict=True):
                if text:
                    by.setdefault(UNKNOWN if lang is None else lang, []).append(grams(text, order))
            for lang, found in by.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                held.setdefault(lang, Tally()).add(signed(keys), n.astype(np.int64))
        for lang, counted in held.items():
            keys, n = counted.total()
            yield from batches_of(schema, lang=[lang] * len(keys), gram=keys, n=n)

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def levels_of(docs: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """(lang, gram, n) for each order from 1 up; lower orders count the distinct characters in front."""
    levels = [store(count_ngrams(docs, order))]
    for k in range(order - 1, 0, -1):
        levels.insert(0, store(levels[0].groupBy("lang", _ending(k).alias("gram")).agg(F.count("*").alias("n"))))
    return levels


def _ending(k: int):
    return F.col("gram").bitwiseAND((1 << (BITS * k)) - 1)


def discounts(level: DataFrame) -> dict[str, np.ndarray]:
    """The discounts of each language."""
    seen = level.groupBy("lang").agg(*(F.count_if(F.col("n") == i) for i in range(1, 5)))
    return {r[0]: _discounts(dict(enumerate(r[1:], 1))) for r in seen.collect()}


def probabilities(levels: list[DataFrame]) -> DataFrame:
    """(lang, gram, n, logp): every n-gram of the highest order, its count and log10 of its interpolated probability, times SCALE."""
    spark, n = levels[0].sparkSession, F.col("n")
    for k, level in enumerate(levels, 1):
        table = spark.createDataFrame([(x, *map(float, d[1:])) for x, d in discounts(level).items()], "lang string, d1 double, d2 double, d3 double")
        same = Window.partitionBy("lang", F.shiftrightunsigned("gram", BITS))  # a context has ALPHABET rows at most
        sums = {"total": F.sum(n), "once": F.count_if(n == 1), "twice": F.count_if(n == 2), "more": F.count_if(n > 2)}
        rows = level.select("lang", "gram", "n", *(c.over(same).alias(x) for x, c in sums.items())).join(F.broadcast(table), "lang")  # a row for each language
        own = n - F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        rest = F.col("d1") * F.col("once") + F.col("d2") * F.col("twice") + F.col("d3") * F.col("more")
        if k == 1:
            shorter = F.lit(1 / ALPHABET)
        else:
            rows = rows.withColumn("ending", _ending(k - 1)).join(lower, ["lang", "ending"])
            shorter = F.col("shorter")
        p = (own + rest * shorter) / F.col("total")
        lower = rows.select("lang", F.col("gram").alias("ending"), p.alias("shorter"))
    return store(rows.select("lang", "gram", "n", F.round(F.log10(p) * SCALE).cast("int").alias("logp")))


def fit(docs: DataFrame, order: int = ORDER, hot: int = HOT) -> dict[str, KneserNey]:
    """A model on the driver for each language, to score texts other than ``docs``; ``quality_rules`` doesn't use it.

    It has the n-grams whose share in the counts of their order is 1/``hot`` at
    least; one without an entry has its whole count discounted, so it backs off.
    """
    models: dict[str, KneserNey] = {}
    for level in levels_of(docs, order):
        total = level.agg(F.sum("n")).first()[0] or 0
        kept = level.filter(F.col("n") * hot >= total).toArrow()
        context = F.shiftrightunsigned("gram", BITS)
        heads = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.max("n").alias("most")).filter(F.col("most") * hot >= total).drop("most").toArrow()
        by_lang = discounts(level)
        where, at = (_by_lang(t) for t in (kept, heads))
        keys, n, context, totals = kept["gram"].to_numpy().view(np.uint64), kept["n"].to_numpy(), heads["context"].to_numpy().view(np.uint64), heads["total"].to_numpy()
        for lang in sorted(where):
            own, head = where[lang], at[lang]
            models.setdefault(lang, KneserNey()).add(keys[own], n[own], context[head], totals[head], by_lang[lang])
    return models


def _by_lang(table: pa.Table) -> dict[str, np.ndarray]:
    """Row numbers of each language."""
    c = table["lang"].combine_chunks().dictionary_encode()
    at = c.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    return dict(zip(c.dictionary.to_pylist(), np.split(order, np.flatnonzero(np.diff(at[order])) + 1), strict=True)) if len(at) else {}


def base_features(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = Words(texts)
    n = len(texts)
    heads = (w.buf & 0xC0) != 0x80
    cuts = np.r_[-1, np.flatnonzero(w.buf == 10)]
    own = np.searchsorted(w.doc_ends - 1, cuts[1:])  # a line feed ends each document
    filled = np.searchsorted(w.starts, cuts[1:]) > np.searchsorted(w.starts, cuts[:-1])
    line = w.spans(cuts[:-1] + 1, cuts[1:])[filled] + np.uint64(0x9E3779B97F4A7C15) * own[filled].astype(np.uint64)
    own = own[filled]
    _, kept = np.unique(line, return_index=True)
    repeated = np.bincount(own, minlength=n) - np.bincount(own[kept], minlength=n)
    at, tri = w.runs(3)
    tri = mix(tri + np.uint64(0x9E3779B97F4A7C15) * (w.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(tri)
    same = tri[order][1:] == tri[order][:-1]
    twice = at[order][np.r_[False, same] | np.r_[same, False]] if len(at) else at
    covered = np.zeros(len(w.doc), bool)
    for i in range(3):
        covered[twice + i] = True
    return {
        "n_words": w.n,
        "word_chars": w.by_doc(heads & ~w.white),
        "n_symbols": w.by_doc(_SYMBOL[w.buf]),
        "n_dup_lines": repeated,
        "n_repeat_words": np.bincount(w.doc[covered], minlength=n),
    }


def mean_scores(model: KneserNey, texts: list[str]) -> np.ndarray:
    """Mean log10 probability a character of each (not empty) text: distinct n-grams are looked up once."""
    found = [grams(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    keys, own = np.unique(np.concatenate(found), return_inverse=True)
    return np.add.reduceat(model.score(keys)[own], np.cumsum(sizes) - sizes, dtype=np.float64) / sizes


def look_up(table: tuple[np.ndarray, np.ndarray] | None, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For each (not empty) text: its length, the sum over the n-grams of the table, and the n-grams it doesn't have with how often they occur."""
    have, logp = table or (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    found = [grams(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    keys, own = np.unique(np.concatenate(found), return_inverse=True)  # distinct n-grams are looked up once
    at, known = _find(have, keys)
    value = np.where(known, logp[at], 0).astype(np.int64) if len(have) else np.zeros(len(keys), np.int64)
    sums = np.add.reduceat(value[own], np.cumsum(sizes) - sizes)
    rest = np.flatnonzero(~known[own])
    doc = np.searchsorted(np.cumsum(sizes), rest, side="right")
    pairs, n = np.unique(doc * len(keys) + own[rest], return_counts=True)
    cuts = np.searchsorted(pairs, np.arange(1, len(texts)) * len(keys))
    return sizes, sums, list(zip(np.split(signed(keys[pairs % len(keys)]), cuts), np.split(n, cuts), strict=True))


def score(docs: DataFrame, table: DataFrame, hot: int = HOT) -> DataFrame:
    """Base features, language and mean log10 perplexity a character of every document (null for an empty text)."""
    total = table.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * hot >= total
    kept = table.filter(is_hot).select("lang", "gram", "logp").toArrow()
    gram, logp = kept["gram"].to_numpy().view(np.uint64), kept["logp"].to_numpy()
    by_lang = {x: own[np.argsort(gram[own])] for x, own in _by_lang(kept).items()}
    sent = docs.sparkSession.sparkContext.broadcast({x: (gram[own], logp[own]) for x, own in by_lang.items()})  # at most HOT n-grams
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), *((x, pa.int64()) for x in names), ("size", pa.int64()), ("known", pa.int64()), ("gram", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches):
        for part in chunks(batches, "text"):
            langs = [UNKNOWN if x is None else x for x in part["lang"]]
            size, known = np.zeros((2, len(langs)), np.int64)
            rest: list = [(None, None)] * len(langs)
            by: dict[str, list[int]] = {}
            for i, (lang, text) in enumerate(zip(langs, part["text"], strict=True)):
                if text:
                    by.setdefault(lang, []).append(i)
            for lang, own in by.items():
                size[own], known[own], found = look_up(sent.value.get(lang), [part["text"][i] for i in own])
                for i, x in zip(own, found, strict=True):
                    rest[i] = x
            yield from batches_of(schema, row=part["row"], doc_id=part["doc_id"], lang=langs, size=size, known=known, gram=[x for x, _ in rest], times=[n for _, n in rest], **base_features(part["text"]))

    kinds = "row long, doc_id long, lang string, " + ", ".join(f"{x} long" for x in names) + ", size long, known long, gram array<long>, times array<long>"
    found = store(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text").mapInArrow(run, kinds))
    rest = found.select("row", "lang", F.inline(F.arrays_zip("gram", "times"))).join(table.filter(~is_hot), ["lang", "gram"])
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("rest"))
    mean = (F.col("known") + F.coalesce("rest", F.lit(0))) / (F.col("size") * SCALE)
    return found.drop("gram", "times").join(rest, "row", "left").select("doc_id", "lang", *names, F.when(F.col("size") > 0, -mean).alias("log_ppl"))


def bands(scored: DataFrame, spread: float) -> list[tuple[str, float, float]]:
    """(language, lowest, highest) mean log10 perplexity, from a histogram of all documents that pass the base rules."""
    hist = scored.filter(~F.col("base_failed") & F.col("log_ppl").isNotNull()).groupBy("lang", F.floor(F.col("log_ppl") / BIN).cast("long").alias("bin")).count().toArrow().to_pylist()
    out = []
    for lang in sorted({r["lang"] for r in hist}):
        rows = sorted((r["bin"], r["count"]) for r in hist if r["lang"] == lang)
        at = np.cumsum([c for _, c in rows])
        q1, q3 = (rows[int(np.searchsorted(at, q * at[-1]))][0] * BIN for q in (0.25, 0.75))
        width = spread * max(q3 - q1, 5 * BIN)
        out.append((lang, q1 - width, q3 + width))
    return out


def quality_rules(docs: DataFrame, spread: float = 4.0, hot: int = HOT) -> DataFrame:
    """One row per document: base features, ``perplexity`` (a character), its language's band, ``base_failed`` and ``kept``.

    Null texts count as empty and fail the base rules; a null language is a
    language of its own; extra columns are ignored; repeated rows each give a
    row; an empty table gives none. ``hot`` says how many n-grams are broadcast
    at most; it doesn't change the result.
    """
    spark = docs.sparkSession
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = store(score(docs, probabilities(levels_of(docs)), hot).withColumn("base_failed", failed))
    table = spark.createDataFrame(bands(scored, spread), "lang string, low double, high double")
    inside = F.col("log_ppl").between(F.col("low"), F.col("high"))
    return (
        scored.join(F.broadcast(table), "lang", "left")  # a row for each language
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .withColumn("perplexity", F.pow(F.lit(10.0), "log_ppl"))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "perplexity", F.pow(F.lit(10.0), "low").alias("lowest"), F.pow(F.lit(10.0), "high").alias("highest"))
    )
