"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits of the lower-cased text. Seeds are hashes
of MIN_MATCH tokens; joining those of a document with those of the items tells
which items it may hold enough of. Tiling then is running Karp-Rabin: the length
of the longest match of unmarked tokens is found by rolling hashes of runs, its
matches are checked token by token and marked where they don't overlap marked
ones, and the next length follows, down to MIN_MATCH; so reordered passages still
count. A document is contaminated by an item if its tiles cover ``threshold`` of
the item's tokens. No pairs of positions are listed, so memory is in proportion
to the texts however repetitive they are.

The benchmark is the query set: it is taken in blocks of about BLOCK_BYTES of
text (one item is the least a block can hold), each broadcast to a scan of all
documents; any number of blocks works.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NOT_ALNUM, Words, batches_of, chunks, ngram_hashes, slices, store

MIN_MATCH = 5
THRESHOLD = 0.6
BLOCK_BYTES = 16 << 20


class Tokens:
    """Token hashes of some texts, and hashes of their runs of MIN_MATCH tokens."""

    def __init__(self, texts: list[str | None]):
        w = Words([t.lower() if t else t for t in texts], white=NOT_ALNUM)
        self.hash, self.n, self.first, self.doc = w.hashes(), w.n, w.first, w.doc
        self.at, self.seed = w.runs(MIN_MATCH, self.hash)


class Index:
    """Seeds of benchmark items, sorted."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        self.t = Tokens([x for _, x in items])
        order = np.argsort(self.t.seed, kind="stable")
        self.seed, self.at = self.t.seed[order], self.t.at[order]

    def candidates(self, seeds: np.ndarray, threshold: float) -> list[int]:
        """Items of whose tokens these seeds of a document cover the share ``threshold``."""
        seeds = np.unique(seeds)
        lo, hi = np.searchsorted(self.seed, seeds, "left"), np.searchsorted(self.seed, seeds, "right")
        n = hi - lo
        at = np.sort(self.at[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])  # at most the block's tokens
        if not len(at):
            return []
        item = self.t.doc[at]
        new = np.minimum(np.diff(np.r_[at, at[-1] + MIN_MATCH]), MIN_MATCH)
        new[np.r_[item[1:] != item[:-1], True]] = MIN_MATCH
        covered = np.bincount(item, new, len(self.ids))
        return np.flatnonzero((covered > 0) & (covered >= threshold * self.t.n)).tolist()


def _runs(tokens: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``n`` unmarked tokens start, and their hashes."""
    if len(tokens) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = np.r_[0, np.cumsum(~free)]
    at = np.flatnonzero(marked[n:] == marked[:-n])
    return at, ngram_hashes(tokens, n)[at] if len(at) else np.zeros(0, np.uint64)


def tile(a: np.ndarray, b: np.ndarray, k: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) of two token sequences; of equally long matches the first in b, then in a, is marked first."""
    free_a, free_b, tiles, top = np.ones(len(a), bool), np.ones(len(b), bool), [], min(len(a), len(b))

    def shared(n: int) -> bool:
        return bool(np.isin(_runs(b, free_b, n)[1], _runs(a, free_a, n)[1]).any())

    while top >= k:
        lo, hi = k - 1, top  # the longest match is in this range: if n tokens match, so do n - 1
        while lo < hi:
            middle = (lo + hi + 1) // 2
            lo, hi = (middle, hi) if shared(middle) else (lo, middle - 1)
        if lo < k:
            break
        at_a, h_a = _runs(a, free_a, lo)
        order = np.argsort(h_a, kind="stable")
        at_a, h_a = at_a[order], h_a[order]
        at_b, h_b = _runs(b, free_b, lo)
        first, last = np.searchsorted(h_a, h_b, "left"), np.searchsorted(h_a, h_b, "right")
        upto: dict[int, int] = {}  # how far the places of a run in a are used up
        for y, s, e in zip(at_b.tolist(), first.tolist(), last.tolist(), strict=True):
            if s == e or not free_b[y : y + lo].all():
                continue
            i = upto.get(s, s)
            while i < e and not (free_a[at_a[i] : at_a[i] + lo].all() and np.array_equal(a[at_a[i] : at_a[i] + lo], b[y : y + lo])):
                i += 1
            upto[s] = i
            if i < e:
                x = int(at_a[i])
                tiles.append((x, y, lo))
                free_a[x : x + lo] = free_b[y : y + lo] = False
        top = lo - 1
    return tiles


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, spans) of every contaminated pair; spans are of the document's tokens."""
    return _scan(docs, benchmark, threshold, whole=False)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents (all columns) that no item contaminates.

    Null and empty texts stay; odd items match nothing, as in ``report``; an
    empty table gives none; extra columns are kept whatever their names.
    """
    return _scan(docs, benchmark, threshold, whole=True)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of about BLOCK_BYTES of text."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // BLOCK_BYTES
    held, size = [], 0
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).sort("item_id", "text") if parts > 1 else items.sort("item_id", "text")
        for r in rows.toLocalIterator():
            n = len(r.text.encode("utf-8", "surrogatepass"))
            if held and size + n > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append((r.item_id, r.text))
            size += n
    if held:
        yield held


def _scan(docs: DataFrame, benchmark: DataFrame, threshold: float, whole: bool) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest", pa.int32()), ("spans", pa.list_(pa.list_(pa.int32())))])
    out_type = "doc_id long, item_id long, coverage double, n_tiles int, longest int, spans array<array<int>>"

    def found(index: Index, texts: list[str | None]):
        t = Tokens(texts)
        hit = np.flatnonzero(np.isin(t.seed, index.seed))
        own = t.doc[t.at[hit]]
        for d in np.unique(own).tolist():
            tokens = t.hash[t.first[d] : t.first[d] + t.n[d]]
            for i in index.candidates(t.seed[hit[own == d]], threshold):
                size = int(index.t.n[i])
                tiles = tile(tokens, index.t.hash[index.t.first[i] : index.t.first[i] + size])
                covered = sum(n for _, _, n in tiles)
                if covered >= threshold * size:
                    yield d, i, covered / size, tiles

    out = []
    for k, rows in enumerate(_blocks(items)):
        sent = spark.sparkContext.broadcast(Index(rows))  # a block: BLOCK_BYTES of text or one item
        if whole:

            def keep(batches, sent=sent):
                for part in slices(batches, "text"):
                    mask = np.ones(part.num_rows, bool)
                    for d, *_ in found(sent.value, part.column("text").to_pylist()):
                        mask[d] = False
                    yield part.filter(pa.array(mask))

            docs = (store(docs) if k else docs).mapInArrow(keep, docs.schema)
        else:

            def pairs(batches, sent=sent):
                for part in chunks(batches, "text"):
                    rows = [(part["doc_id"][d], sent.value.ids[i], c, len(t), max(n for *_, n in t), [[x, x + n] for x, _, n in sorted(t)]) for d, i, c, t in found(sent.value, part["text"])]
                    if rows:
                        yield from batches_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

            out.append(docs.select("doc_id", "text").mapInArrow(pairs, out_type))
    if whole:
        return docs
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], out_type)


def report(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each contaminated document and item; clean documents have none.

    Null texts and ids of items, and items shorter than MIN_MATCH tokens, match
    nothing; a null document id is kept as it is; repeated documents each give
    their rows; empty tables give none; extra columns are ignored.
    """
    return matches(docs, benchmark, threshold).drop("spans")
