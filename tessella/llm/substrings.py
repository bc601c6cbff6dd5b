"""Substring dedup: matching statistics against a compressed FM-index of each shard.

A repeated window of WINDOW words has a repeated anchor: the smallest of the
hashes of its GRAM-word runs (winnowing). Documents are reduced to the contexts
of anchors that two documents share, and equal contexts to one with the smallest
doc_id, so copies cost one row. The contexts of an anchor go to one shard. There
they are indexed (suffix array, Burrows-Wheeler transform, wavelet matrix with
packed ranks) and streamed through the index by backward search, all in lockstep:
the interval of the last WINDOW words gives the smallest document with that
window. Anchors with more than MOST contexts, which would outgrow a shard, take
an exact way by window hashes, whose minimum Spark pre-aggregates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, _powers, batches_of, chunks, mix, ngram_hashes, signed, store

WINDOW = 50
GRAM = 16
#: Contexts of one anchor, and words of one shard, about.
MOST = 6000
SHARD_WORDS = 700_000
#: Bytes kept of a word's hash.
BYTES = 5
#: Windows that hold one anchor, at most.
REACH = WINDOW - GRAM + 1


class Wavelet:
    """Wavelet matrix of an integer sequence: one packed bit vector a level, with ranks by blocks of 64."""

    def __init__(self, text: np.ndarray, levels: int):
        self.levels, self.n, self.words, self.ranks, self.zeros = levels, len(text), [], [], []
        for level in range(levels - 1, -1, -1):
            bit = ((text >> level) & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(64 - len(bit) % 64, bool)], bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ranks.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            text = np.r_[text[~bit], text[bit]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position (from the start of its own block: see ``first``)."""
        at = at.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block = at >> 6
            ones = self.ranks[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            up = (symbol >> level) & 1 == 1
            at = np.where(up, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Index of contexts (word codes of at least 1, one after the other) with the document of each."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        m, ends = len(sizes), np.cumsum(sizes)
        at = np.arange(len(words)) + np.repeat(np.arange(m), sizes)  # a separator after each context
        n = len(words) + m
        values, codes = np.unique(words, return_inverse=True)
        text = np.zeros(n, np.int64)
        text[at] = codes + 1
        rank = text + m - 1  # separators differ, and come before all words
        rank[ends + np.arange(m)] = np.arange(m)
        order, k = None, 1
        rank = np.unique(rank, return_inverse=True)[1]
        while True:
            later = np.zeros(n, np.int64)
            later[: n - k] = rank[k:] + 1
            key = rank * (n + 1) + later
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = new
            k *= 2
            if new[-1] == n - 1:
                break
        self.text, self.order = text, order
        self.at, self.first = at, np.r_[0, np.cumsum(np.bincount(text))]
        self.wavelet = Wavelet(text[order - 1], max(1, int(len(values)).bit_length()))
        zero = np.arange(len(values) + 1)
        self.base = self.wavelet.rank(zero, np.zeros(len(zero), np.int64))
        own = np.full(n, -1)
        own[at] = np.repeat(np.arange(m), sizes)
        self.docs = np.where(own[order] >= 0, docs[own[order]], np.iinfo(np.int64).max)
        # suffixes that agree in their first words: the longest shared prefix with the suffix in front, up to WINDOW
        self.shared = self._common(order, rank)

    def _common(self, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
        n = len(order)
        padded = np.r_[self.text, np.zeros(WINDOW, np.int64)]
        shared, live = np.zeros(n, np.int64), np.arange(1, n)
        for depth in range(WINDOW):
            a, b = padded[order[live] + depth], padded[order[live - 1] + depth]
            live = live[(a == b) & (a > 0)]
            if not len(live):
                break
            shared[live] = depth + 1
        return shared

    def groups(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of each suffix by its first ``depth`` words, and where groups start and end."""
        new = self.shared < depth
        new[0] = True
        starts = np.flatnonzero(new)
        return np.cumsum(new) - 1, starts, np.r_[starts[1:], len(new)]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns with one more word in front."""
        base = self.first[symbol] - self.base[symbol]
        return base + self.wavelet.rank(symbol, lo), base + self.wavelet.rank(symbol, hi)

    def smallest(self, sizes: np.ndarray) -> list[np.ndarray]:
        """For each indexed context, the smallest document of every WINDOW-word window of it."""
        starts = np.cumsum(sizes) - sizes
        group, first, last = self.groups(WINDOW - 1)
        owner, left, _ = self.groups(WINDOW)
        least = np.minimum.reduceat(self.docs, left)
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(self.text))
        out = np.full(int(sizes.sum()), -1, np.int64)
        for back in range(1, int(sizes.max()) + 1):  # from the last word of every context
            live = np.flatnonzero(sizes >= back)
            at = starts[live] + sizes[live] - back
            lo[live], hi[live] = self.step(self.text[self.at[at]], lo[live], hi[live])
            if back >= WINDOW:
                out[at] = least[owner[lo[live]]]
                g = group[lo[live]]  # give up the last word: all that agree in the others
                lo[live], hi[live] = first[g], last[g]
        return [out[s : s + max(0, n - WINDOW + 1)] for s, n in zip(starts, sizes, strict=True)]


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Positions of the winnowed runs of a document of at least WINDOW words."""
    h = ngram_hashes(hashes, GRAM)
    width = WINDOW - GRAM + 1
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    return np.unique(np.arange(len(view)) + width - 1 - np.argmin(view[:, ::-1], axis=1))


def context(at: np.ndarray, n) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the context of each anchor: all windows that contain it."""
    return np.maximum(0, at - (WINDOW - GRAM)), np.minimum(n, at + WINDOW)


def _anchor_rows(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("ctx", pa.int64())])
    for part in chunks(batches, "text"):
        w = Words(part["text"])
        hashes = w.hashes()
        up, down = _powers(len(hashes) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(hashes * up[: len(hashes)])]
        doc, place = [], []
        for i in np.flatnonzero(w.n >= WINDOW):
            found = anchors(hashes[w.first[i] : w.first[i] + w.n[i]])
            doc.append(np.full(len(found), i))
            place.append(found)
        if not doc:
            continue
        doc, place = np.concatenate(doc), np.concatenate(place)
        lo, hi = context(place, w.n[doc])
        base = w.first[doc]
        span = lambda a, b: mix((sums[base + b] - sums[base + a]) * down[base + a])
        ctx = mix(span(lo, hi) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64))
        ids, th = np.array(part["doc_id"], np.int64), np.array(part["th"], np.int64)
        yield from batches_of(schema, doc_id=ids[doc], th=th[doc], at=place, h=signed(span(place, place + GRAM)), ctx=signed(ctx))


def _context_rows(batches):
    """Words of the contexts that represent others: (h, ctx, doc_id, words)."""
    schema = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary())])
    for part in chunks(batches, "text"):
        w = Words(part["text"])
        short = w.hashes().view(np.uint8).reshape(-1, 8)[:, :BYTES]
        rows = []
        for i, wanted in enumerate(part["wanted"]):
            for x in wanted:
                lo, hi = context(np.int64(x["at"]), w.n[i])
                rows.append((x["h"], x["ctx"], part["doc_id"][i], short[w.first[i] + lo : w.first[i] + hi].tobytes()))
        for k in range(0, len(rows), 5000):
            yield from batches_of(schema, **dict(zip(schema.names, map(list, zip(*rows[k : k + 5000], strict=True)), strict=True)))


def search(table: pa.Table) -> pa.Table:
    """Contexts of a shard with the smallest document of each window."""
    table = table.sort_by([("h", "ascending"), ("ctx", "ascending"), ("doc_id", "ascending")])
    packed = [np.frombuffer(x, np.uint8).reshape(-1, BYTES) for x in table["words"].to_pylist()]
    sizes = np.array([len(x) for x in packed])
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :BYTES] = np.concatenate(packed)
    index = FMIndex(wide.view(np.uint64).ravel(), sizes, table["doc_id"].to_numpy())
    return pa.table({"h": table["h"], "ctx": table["ctx"], "least": pa.array([x.tolist() for x in index.smallest(sizes)], pa.list_(pa.int64()))})


def _window_rows(batches):
    schema = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int32()), ("window", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            wide = np.zeros((len(r["words"]) // BYTES, 8), np.uint8)
            wide[:, :BYTES] = np.frombuffer(r["words"], np.uint8).reshape(-1, BYTES)
            got = signed(ngram_hashes(mix(wide.view(np.uint64).ravel()), WINDOW))
            n = len(got)
            yield from batches_of(schema, h=np.full(n, r["h"]), ctx=np.full(n, r["ctx"]), doc_id=np.full(n, r["doc_id"]), i=np.arange(n), window=got)


def _digests(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])
    for part in chunks(batches, "text"):
        out = {name: [] for name in schema.names}
        for i, text in enumerate(part["text"]):
            tokens = (text or "").encode("utf-8", "surrogatepass").split()
            flag = np.zeros(len(tokens) + 1, np.int64)
            if part.get("at") and part["at"][i]:
                at = np.array(part["at"][i])
                lo, hi = context(at, len(tokens))
                start = lo[:, None] + np.arange(REACH)  # near the ends of a document fewer windows hold the anchor
                start = start[(np.array(part["mask"][i])[:, None] >> np.arange(REACH) & 1 == 1) & (start + WINDOW <= hi[:, None])]
                flag += np.bincount(start, minlength=len(flag)) - np.bincount(start + WINDOW, minlength=len(flag))
            gone = np.cumsum(flag)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
            kept = tokens if not len(edges) else [t for t, g in zip(tokens, gone.tolist(), strict=True) if not g]
            for name, v in zip(schema.names, (part["doc_id"][i], part["th"][i], len(tokens), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), edges.reshape(-1, 2).tolist()), strict=True):
                out[name].append(v)
        yield from batches_of(schema, **out)


_DIGEST = "doc_id long, th long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>"


def dedup(docs: DataFrame, most: int = MOST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (half-open runs of removed words).

    A null text has no words. A null id is neither smaller nor larger than others,
    so such a document stays whole. Rows of one id don't remove each other's
    words. Repeated rows each give a row; an empty table gives none; extra columns
    are ignored.
    """
    keyed = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")
    whole = keyed.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = store(whole.mapInArrow(_anchor_rows, "doc_id long, th long, at int, h long, ctx long"))
    classes = found.groupBy("h", "ctx").agg(F.min(F.struct("doc_id", "th", "at")).alias("rep"), F.max("doc_id").alias("last"))
    shared = classes.groupBy("h").agg(F.min("rep.doc_id").alias("a"), F.max("last").alias("b"), F.count("*").alias("n_ctx")).filter("a < b").select("h", "n_ctx")
    classes = store(classes.join(shared, "h").select("h", "ctx", "rep", "last", "n_ctx"))  # with all columns, so that one exchange serves both sides
    wanted = classes.filter("n_ctx > 1").groupBy(F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")).agg(F.collect_list(F.struct("h", "ctx", F.col("rep.at").alias("at"))).alias("wanted"))  # at most a document's anchors
    contexts = store(whole.join(wanted, ["doc_id", "th"]).select("doc_id", "text", "wanted").mapInArrow(_context_rows, "h long, ctx long, doc_id long, words binary").dropDuplicates(["h", "ctx"]))
    hot = classes.filter(F.col("n_ctx") > most).select("h").distinct()
    n_words = contexts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = 1 + n_words // BYTES // shard_words
    usual = contexts.join(hot, "h", "left_anti").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    least = usual.groupBy("shard").applyInArrow(search, "h long, ctx long, least array<long>")
    windows = contexts.join(hot, "h", "left_semi").mapInArrow(_window_rows, "h long, ctx long, doc_id long, i int, window long")
    first = windows.groupBy("window").agg(F.min("doc_id").alias("least"))
    exact = windows.join(first, "window").groupBy("h", "ctx").agg(F.sort_array(F.collect_list(F.struct("i", "least"))).alias("x")).select("h", "ctx", F.col("x.least").alias("least"))
    least = least.unionByName(exact)
    # one join for the many members of a context, so that adaptive execution can split a hot one
    known = store(classes.select("h", "ctx", F.col("rep.doc_id").alias("rep"), "n_ctx").join(least, ["h", "ctx"], "left"))
    members = found.join(known, ["h", "ctx"]).filter("n_ctx > 1 OR doc_id > rep")
    # a bit for each window of the context that starts in a smaller document; without a list all do
    bits = F.expr("aggregate(transform(least, (x, i) -> if(x < doc_id, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    hits = members.select("doc_id", "th", "at", F.coalesce(bits, F.lit(-1)).alias("mask")).filter("mask <> 0")
    hits = hits.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "mask")).alias("hits"))  # at most a document's anchors
    marked = whole.join(hits, ["doc_id", "th"]).select("doc_id", "th", "text", "hits.at", "hits.mask")
    changed = marked.mapInArrow(_digests, _DIGEST).filter("n_removed > 0").dropDuplicates(["doc_id", "th"])
    plain = keyed.mapInArrow(_digests, _DIGEST)
    changed = changed.select("doc_id", "th", *(F.col(c).alias(f"new_{c}") for c in ("n_removed", "kept_sha256", "spans")))
    out = plain.join(changed, ["doc_id", "th"], "left")
    return out.select("doc_id", "n_words", *(F.coalesce(f"new_{c}", c).alias(c) for c in ("n_removed", "kept_sha256", "spans")))


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("spans")
