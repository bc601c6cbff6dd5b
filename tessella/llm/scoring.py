"""LM scoring: a causal self-attention model over subword ids, in numpy.

The probability of a text (its words, joined by single spaces, then an end) is
the product over its subwords of p(class | context) * p(subword | class):

* p(class | context) comes from one attention layer over the preceding 16 to 31
  subwords plus a term for the last subword. The term starts from the counts of all
  training documents. The layer gets its starting point, the same for all partitions,
  by gradient descent on about ``SAMPLE_DOCS`` whole training documents; then each
  partition trains it on all of its training documents, whole, and the partitions'
  results are averaged by their windows.
* p(subword | class, subwords before it in its word) comes from counts of all
  training documents, interpolated from two preceding subwords down to none; it
  depends on the word alone, so it is looked up once for each new word of a task.
  Runs of subwords are in the tables if their share of all is 1/KEPT at least, so at
  most KEPT of each length are; what the others hold goes to the shorter context.

One pass counts words, subwords, runs of subwords within words and neighbours of
subwords over all training documents. Classes are learned from these neighbours.

Windows of 32 subwords overlap by 16 and score their last 16, so each subword is
scored once and always sees at least 16 predecessors where the text has them.

The base score needs the count of each word in all training documents. Words
whose share is at least 1/HOT are at most HOT, so they are broadcast; the others
are joined by hash, and none of those keys can be skewed.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import fold
from .text import Tally, Words, batches_of, broadcast, chunks, signed, store, tally

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s+"
HOT = 1 << 19
BLOCK = 16
CLASSES = 48
WIDTH = 12
SYMBOLS = 1024
SAMPLE_DOCS = 1500
#: One in so many training documents trains the layer, that is all; nothing but a test reads it.
TRAIN_SHARE = 1
TRAIN_RATE = 0.002
#: Blocks of a step: towards the starting point, and in the partitions.
STEP = 129
TRAIN_STEP = 256
#: Rows of a symbol that are added up at once, and blocks that are scored at once.
GROUP = 8
AT_ONCE = 192
KEPT = 1 << 20
MODEL_BYTES = 128 << 20
#: Counted entries that a task holds before it sends them on.
HELD = 1 << 20
#: What is counted: words by hash; subwords; runs of 2 and of 3 subwords in a word; a subword and the next.
WORDS, IDS, RUN2, RUN3, NEXT = range(5)
_CACHE: dict = {}
_BYTES: dict = {}


def _as_one(encode: Callable[[str], list[int]], data: bytes, bytes_of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Subword ids of a text and how many end in each part, whose ends are those of subwords; None if the text isn't valid."""
    try:
        ids = np.array(encode(data.decode()), np.int32)
    except UnicodeDecodeError:
        return None
    return ids, np.diff(np.searchsorted(np.cumsum(bytes_of[ids]), ends, side="right"), prepend=0).astype(np.int32)


class Subwords:
    """Subword ids of words, each remembered as it comes (up to ``limit`` words)."""

    def __init__(self, path: str, within: Within | None = None, limit: int = 400_000, hot: np.ndarray | None = None):
        import tiktoken

        self.within, self.hot = within, hot  # hot: sorted hashes of frequent words

        if path not in _CACHE:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _CACHE[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _BYTES[path] = np.zeros(max(ranks.values()) + 1, np.int64)
            _BYTES[path][list(ranks.values())] = list(map(len, ranks))
        self.encoding = _CACHE[path]
        self.end = self.encoding.n_vocab  # its first free id
        self.bytes_of = _BYTES[path]
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.sizes, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.logp, self.place = np.zeros(0, np.float32), np.zeros(0, np.int64)

    def of(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Index of each word among those remembered; ``ids``, ``starts`` and ``sizes`` have their subwords, ``place`` where they are in ``hot`` or -1."""
        order = np.argsort(hashes)
        values = hashes[order]
        edge = np.r_[True, values[1:] != values[:-1]][: len(values)]
        values, first = values[edge], order[edge]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(edge) - 1
        if len(self.keys) > self.limit:
            self._reset()
        at = np.searchsorted(self.keys, values)
        new = self.keys[np.minimum(at, len(self.keys) - 1)] != values if len(self.keys) else np.ones(len(values), bool)
        if new.any():
            ids, sizes = self._encode(words, first[new])
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.r_[self.ids, ids]
            if self.within is not None:
                self.logp = np.r_[self.logp, self.within.logp(ids, sizes)]
            if self.hot is not None:
                keys = signed(values[new])
                place = _places(self.hot, keys)
                self.place = np.r_[self.place, np.where(self.hot[place] == keys, place, -1) if len(self.hot) else np.full(len(keys), -1)]
            self.keys, self.at = np.insert(self.keys, at[new], values[new]), np.insert(self.at, at[new], len(self.sizes) + np.arange(len(sizes)))
            self.sizes, self.starts = np.r_[self.sizes, sizes], np.r_[self.starts, starts]
            at += np.cumsum(new) - new
        return self.at[at][inverse]

    def _encode(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the words, a space before each, and how many each has.

        No piece of PATTERN goes from a word over the next one's space unless the word ends in white space of more than
        ASCII, so all others are encoded as one text.
        """
        starts, ends, buf = words.starts[at], words.ends[at], words.buf
        last, second, third = (buf[np.maximum(ends - k, starts)] for k in (1, 2, 3))
        alone = (last < 32) | (second == 0xC2) | (third == 0xE1) | (third == 0xE2) | (third == 0xE3) & (second == 0x80)
        encode = self.encoding._core_bpe.encode_ordinary
        sizes = np.zeros(len(at), np.int32)
        parts = []
        for own in (np.flatnonzero(~alone), np.flatnonzero(alone)):
            lengths = ends[own] - starts[own] + 1
            offsets = np.cumsum(lengths) - lengths
            data = buf[np.maximum(np.arange(int(lengths.sum())) + np.repeat(starts[own] - 1 - offsets, lengths), 0)]
            data[offsets] = 32
            got = _as_one(encode, data.tobytes(), self.bytes_of, offsets + lengths) if not alone[own[:1]].any() else None
            if got is None:
                lists = [encode(" " + words.word(i).decode("utf-8", "replace")) for i in at[own]]
                got = np.fromiter((x for g in lists for x in g), np.int32), np.fromiter(map(len, lists), np.int32, len(lists))
            parts.append(got[0])
            sizes[own] = got[1]
        if not alone.any():
            return parts[0], sizes
        out, is_alone = np.empty(int(sizes.sum()), np.int32), np.repeat(alone, sizes)
        out[~is_alone], out[is_alone] = parts
        return out, sizes

    def stream(self, words: Words, hashes: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Subword ids of all texts, an end after each; how many each text has; how many each word (or end) has; log p within their class.

        ``at`` is what ``of`` gave for these words, if it was called before.
        """
        at = self.of(words, hashes) if at is None else at
        n = len(words.n)
        tails = words.first + words.n + np.arange(n)  # where each end goes among the words
        sizes = np.insert(self.sizes[at].astype(np.int64), words.first + words.n, 1)
        starts = np.insert(self.starts[at], words.first + words.n, -1)
        offsets = np.cumsum(sizes) - sizes
        flat = np.arange(int(sizes.sum())) + np.repeat(starts - offsets, sizes)
        ends = offsets[tails]
        flat[ends] = 0
        ids = self.ids[flat] if len(self.ids) else np.zeros(len(flat), np.int32)
        ids[ends] = self.end
        logp = self.logp[flat] if len(self.logp) else np.zeros(len(flat), np.float32)
        logp[ends] = 0
        return ids, np.diff(ends, prepend=-1), sizes, logp


Mapped = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Counts:
    """Counts by kind and key, on the driver."""

    def __init__(self, parts: Iterable[tuple[int, np.ndarray, np.ndarray]]):
        held = [Tally() for _ in range(5)]
        for kind, keys, n in parts:
            held[kind].add(keys, n)
        self.parts = [t.total() for t in held]

    def total(self, kind: int) -> int:
        return int(self.parts[kind][1].sum())

    def of(self, kind: int, to: Mapped | None = None, least: float = 0) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and counts, after ``to`` gave other keys, of those whose count is ``least`` or more."""
        keys, n = self.parts[kind]
        keys, n = tally(*to(keys, n)) if to else (keys, n)
        return keys[n >= least], n[n >= least]


class StoredCounts(Counts):
    """Counts by kind and key in a stored table; what ``of`` returns must be bounded by the keys of ``to`` or by ``least``."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.totals = {r.kind: r.n for r in table.groupBy("kind").agg(F.sum("n").alias("n")).collect()}

    def total(self, kind: int) -> int:
        return self.totals.get(kind, 0)

    def of(self, kind: int, to: Mapped | None = None, least: float = 0) -> tuple[np.ndarray, np.ndarray]:
        rows = self.table.filter(F.col("kind") == kind).select("key", "n")
        if to:
            schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

            def run(batches):
                held = Tally()
                for batch in batches:
                    held.add(*to(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)))
                    yield from _emit(schema, held, HELD)
                yield from _emit(schema, held, 0)

            rows = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        got = rows.filter(F.col("n") >= least).toArrow()
        return tally(got["key"].to_numpy(), got["n"].to_numpy())


def _emit(schema: pa.Schema, held: Tally, limit: int, **columns) -> Iterator[pa.RecordBatch]:
    """What is held, if that is more than ``limit`` entries that merging doesn't halve."""
    if held.held > limit:
        keys, n = held.total()
        if len(keys) > limit // 2:
            held.parts, held.held = [], 0
            yield from batches_of(schema, key=keys, n=n, **{c: np.full(len(keys), v, np.int32) for c, v in columns.items()})


def _places(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value is, or would be, among sorted keys; looked up in order, which is faster than at random."""
    order = np.argsort(values)
    out = np.empty(len(values), np.int64)
    out[order] = np.minimum(np.searchsorted(keys, values[order]), max(0, len(keys) - 1))
    return out


@dataclass
class Within:
    """log p(id | its class, the ids before it in its word), interpolated over contexts of 0 to 2 ids."""

    group: np.ndarray
    base: np.ndarray  # p(id | class)
    levels: list[tuple[np.ndarray, ...]]  # by length of context: (context, id) keys and counts; (context, class) keys, counts with weights of the shorter context, these weights

    @classmethod
    def fit(cls, counts: Counts, freq: np.ndarray, group: np.ndarray) -> Within:
        n = freq + 0.02
        out = cls(group, n / np.bincount(group, n, CLASSES)[group], [])
        to_class = lambda keys, n: (keys // len(group) * CLASSES + group[keys % len(group)], n)
        for kind in (RUN2, RUN3):
            least = counts.total(kind) / KEPT
            pairs, n = counts.of(kind, least=least)
            classes, at, kinds = np.unique(to_class(pairs, n)[0], return_inverse=True, return_counts=True)
            keys, total = counts.of(kind, to_class, least)
            total = total[np.searchsorted(keys, classes)]  # a class with a kept run is kept
            out.levels.append((pairs, n, classes, total + kinds, total + kinds - np.bincount(at, n, len(classes))))
        return out

    @staticmethod
    def _contexts(ids: np.ndarray, sizes: np.ndarray):
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = np.int64(1 << 20)
        for k in (1, 2):
            own = np.flatnonzero(pos >= k)
            yield own, ids[own - 1] + 1 + ((ids[own - 2].astype(np.int64) + 1) * wide if k == 2 else np.int64(0))

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + sum(a.nbytes for level in self.levels for a in level)

    def logp(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        p = self.base[ids]
        for (pairs, n, keys, whole, rest), (own, context) in zip(self.levels, self._contexts(ids, sizes), strict=True):
            if not len(keys):
                continue
            pair, key = context * len(self.group) + ids[own], context * CLASSES + self.group[ids[own]]
            i, j = _places(pairs, pair), _places(keys, key)
            seen = keys[j] == key
            own, i, j, pair = own[seen], i[seen], j[seen], pair[seen]
            p[own] = (np.where(pairs[i] == pair, n[i], 0) + rest[j] * p[own]) / whole[j]
        return np.log(p).astype(np.float32)


def _with_front(rows: np.ndarray) -> np.ndarray:
    """A view of each block of rows but the first, the block in front before it."""
    return np.lib.stride_tricks.as_strided(rows, (len(rows) // BLOCK - 1, 2 * BLOCK, rows.shape[1]), (rows.strides[0] * BLOCK, *rows.strides))


@dataclass
class Attention:
    """One causal attention layer that gives the probabilities of the next subword's class."""

    symbol: np.ndarray  # of each id
    group: np.ndarray  # class of each id
    last: np.ndarray  # logits by the last symbol
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    out: np.ndarray
    near: np.ndarray  # bias by distance

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values())

    def mask(self) -> np.ndarray:
        """Bias of each query of a block for the keys of the block in front and its own; -inf ahead."""
        d = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)
        return np.where(d >= 0, self.near[np.clip(d, 0, 2 * BLOCK - 1)], np.float32(-1e9)).astype(np.float32)

    def attend(self, sym: np.ndarray, fresh: np.ndarray):
        """Batched masked attention of blocks (n x BLOCK) over the block in front and themselves; ``fresh`` blocks have none in front."""
        q, k, v = self.q[sym], self.k[sym], self.v[sym]
        k2 = np.concatenate([np.roll(k, 1, axis=0), k], axis=1)
        v2 = np.concatenate([np.roll(v, 1, axis=0), v], axis=1)
        a = q @ k2.transpose(0, 2, 1)
        a += self.mask()
        a[fresh, :, :BLOCK] = -1e9
        a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(-1, keepdims=True)
        return q, k2, v2, a, a @ v2

    def ready(self) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Queries; keys and values side by side; and the factor of each distance (0 ahead)."""
        top = float(np.linalg.norm(self.q, axis=1).max() * np.linalg.norm(self.k, axis=1).max())
        shrink = np.float32(min(1.0, 60.0 / max(top, 1e-9)))  # exp can't overflow
        return (self.q * shrink, np.hstack([self.k, self.v])), np.exp(self.mask())

    def score(self, ids: np.ndarray, sizes: np.ndarray, within: np.ndarray) -> np.ndarray:
        """log10 probability of each text; ``ids`` are those of all texts, one after the other, ``within`` their log p within classes."""
        ends = np.cumsum(sizes)
        firsts = ends - sizes
        sym = self.symbol[ids]
        blocks = -(-sizes // BLOCK)
        base = np.cumsum(blocks) - blocks
        place = np.arange(len(ids)) + np.repeat(base * BLOCK - firsts, sizes)
        n = int(blocks.sum())
        grid = np.full(n * BLOCK, SYMBOLS - 1, np.int64)
        grid[place[:-1] + 1] = sym[:-1]  # each subword is the input of the next
        grid[base * BLOCK] = SYMBOLS - 1  # a text starts from the padding symbol
        fresh = np.zeros(n, bool)
        fresh[base] = True
        front = np.r_[grid[:BLOCK], grid]  # block i is the one in front of block i of the grid
        grid = grid.reshape(-1, BLOCK)
        got = np.empty(grid.size, np.float32)
        target = CLASSES * np.arange(grid.size)  # where each one's class is among the logits
        target[place] += self.group[ids]
        table, factor = self.ready()
        one = np.ones(CLASSES, np.float32)
        for i in range(0, n, AT_ONCE):
            part = grid[i : i + AT_ONCE]
            q = table[0].take(part, axis=0, mode="clip")
            kv = _with_front(table[1].take(front[i * BLOCK : (i + 1 + len(part)) * BLOCK], axis=0, mode="clip"))
            a = q @ kv[:, :, :WIDTH].transpose(0, 2, 1)
            np.exp(a, out=a)
            a *= factor
            a[fresh[i : i + AT_ONCE], :, :BLOCK] = 0
            o = (a @ kv[:, :, WIDTH:]).reshape(-1, WIDTH)
            o /= np.repeat(a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, np.float32), WIDTH).reshape(o.shape)
            z = self.last.take(part.ravel(), axis=0, mode="clip")
            z += o @ self.out
            at = i * BLOCK
            zt = z.ravel().take(target[at : at + len(z)] - CLASSES * at, mode="clip")
            np.exp(z, out=z)
            got[at : at + len(z)] = zt - np.log(z @ one)
        logp = got[place] + within
        return np.add.reduceat(logp, firsts, dtype=np.float64) / np.log(10)


def _classes(counts: Counts, freq: np.ndarray) -> np.ndarray:
    """Group ids by the ids around them: k-means on the leading singular vectors of neighbour counts."""
    n_ids, wide = len(freq), 400
    top = np.argsort(-freq, kind="stable")[:3000]
    rank = np.full(n_ids, n_ids)
    rank[top] = np.arange(len(top))

    def cells(keys, n):
        a, b = rank[keys // n_ids], rank[keys % n_ids]
        after, before = (b < wide) & (a < n_ids), (a < wide) & (b < n_ids)
        return np.r_[a[after] * 2 * wide + b[after], b[before] * 2 * wide + wide + a[before]], np.r_[n[after], n[before]]

    at, n = counts.of(NEXT, cells)
    x = np.zeros((len(top), 2 * wide))
    x.ravel()[at] = n
    x = np.sqrt(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    mean = x.mean(0)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    y = (x - mean) @ vectors[:, -24:]
    weight = np.sqrt(freq[top])[:, None]
    centre = y[: CLASSES - 2].copy()
    for _ in range(12):
        own = np.argmin((centre**2).sum(1) - 2 * y @ centre.T, axis=1)
        for c in range(len(centre)):
            m = own == c
            if weight[m].sum() > 0:
                centre[c] = (y[m] * weight[m]).sum(0) / weight[m].sum()
    group = np.full(n_ids, CLASSES - 2)
    group[top] = own
    group[n_ids - 1] = CLASSES - 1  # the end
    return group.astype(np.int32)


def _blocks(m: Attention, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets (-1: none) in blocks, aligned to texts, and which blocks start a text."""
    blocks = -(-sizes // BLOCK)
    base, firsts = np.cumsum(blocks) - blocks, np.cumsum(sizes) - sizes
    place = np.arange(len(ids)) + np.repeat(base * BLOCK - firsts, sizes)
    x = np.full(int(blocks.sum()) * BLOCK, SYMBOLS - 1, np.int32)
    inner = np.ones(len(ids), bool)
    inner[firsts] = False
    x[place[1:][inner[1:]]] = m.symbol[ids[:-1]][inner[1:]]
    t = np.full(len(x), -1, np.int32)
    t[place] = m.group[ids]
    fresh = np.zeros(len(x) // BLOCK, bool)
    fresh[base] = True
    return x.reshape(-1, BLOCK), t.reshape(-1, BLOCK), fresh


class Descent:
    """Adam on the attention layer ``m``, which it changes in place."""

    names = ("last", "q", "k", "v", "out", "near")

    def __init__(self, m: Attention):
        self.m, self.step = m, 0
        self.values = tuple(getattr(m, name) for name in self.names)
        self.first, self.second = ([np.zeros_like(x) for x in self.values] for _ in range(2))
        distance = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)
        self.distance, self.behind = np.maximum(distance, 0), (distance >= 0).astype(np.float32)

    def gradient(self, sym: np.ndarray, target: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the mean loss on consecutive blocks, by ``values``; the first block sees none in front."""
        m, fresh, n = self.m, fresh.copy(), sym.size
        fresh[0] = True
        rows = np.empty(BLOCK + n, np.int64)
        rows[BLOCK:] = flat = sym.ravel()
        rows[:BLOCK] = flat[:BLOCK]
        flat = rows[BLOCK:]
        z, q = (x.take(flat, axis=0, mode="clip") for x in (m.last, m.q))
        q = q.reshape(-1, BLOCK, WIDTH)
        k, v = (_with_front(x.take(rows, axis=0, mode="clip")) for x in (m.k, m.v))
        a = q @ k.transpose(0, 2, 1)
        if np.abs(m.near).max() + np.sqrt(np.einsum("ij,ij->i", m.q, m.q).max() * np.einsum("ij,ij->i", m.k, m.k).max()) > 60:  # else exp can't overflow
            a += m.mask()
            a[fresh, :, :BLOCK] = -1e9
            a -= a.max(-1, keepdims=True)
            np.exp(a, out=a)
        else:
            np.exp(a, out=a)
            a *= np.exp(m.near)[self.distance] * self.behind
            a[fresh, :, :BLOCK] = 0
        total = np.repeat(a.reshape(n, -1) @ np.ones(2 * BLOCK, np.float32), WIDTH).reshape(n, WIDTH)
        o = (a @ v).reshape(n, WIDTH)
        o /= total
        z += o @ m.out
        if max(m.last.max(), -m.last.min()) + np.abs(m.v).max() * np.abs(m.out).sum(0).max() > 60:
            z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        target = target.ravel()
        live = np.flatnonzero(target >= 0)
        weight = np.zeros((n, 1), np.float32)
        weight[live] = share = 1 / np.float32(len(live))
        z *= weight / (z @ np.ones((CLASSES, 1), np.float32))
        z.ravel()[live * CLASSES + target[live]] -= share
        do = z @ m.out.T
        do /= total
        own = (do * o) @ np.ones(WIDTH, np.float32)  # what all keys of a query have in common
        do = do.reshape(q.shape)
        ds = do @ v.transpose(0, 2, 1)
        ds -= own.reshape(-1, BLOCK, 1)
        ds *= a
        parts = [z, (ds @ k).reshape(n, WIDTH)]
        for back in (ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do):
            own = back[:, BLOCK:].copy()
            own[:-1] += back[1:, :BLOCK]
            parts.append(own.reshape(n, WIDTH))
        near = np.bincount(self.distance.ravel(), (np.ones((1, len(ds)), np.float32) @ ds.reshape(len(ds), -1)).ravel(), 2 * BLOCK).astype(np.float32)
        return *self._sums(flat, *parts), o.T @ z, near

    @staticmethod
    def _sums(flat: np.ndarray, *parts: np.ndarray) -> Iterator[np.ndarray]:
        """The sum of the rows of each symbol, first in groups of up to GROUP rows, the largest groups in front."""
        order = np.argsort(flat.astype(np.int16), kind="stable")
        sizes = np.bincount(flat, minlength=SYMBOLS)
        groups = -(-sizes // GROUP)
        starts = np.cumsum(groups) - groups
        symbol = np.repeat(np.arange(SYMBOLS), groups)
        before = GROUP * (np.arange(len(symbol)) - starts[symbol])  # rows of the symbol in groups before this one
        size = np.minimum(sizes[symbol] - before, GROUP)
        by_size = np.argsort((GROUP - size).astype(np.int8), kind="stable")
        first = ((np.cumsum(sizes) - sizes)[symbol] + before)[by_size]
        at_least = len(size) - np.cumsum(np.bincount(size, minlength=GROUP + 1))[:GROUP]
        columns = [order[first[:count] + i] for i, count in enumerate(at_least)]
        place = np.empty(len(symbol), np.int64)
        place[by_size] = np.arange(len(symbol))
        single, several = (np.flatnonzero(x) for x in (groups == 1, groups > 1))
        alone = place[starts[single]]
        # the groups of symbols with several, without the single ones between them
        inner, ends = place[groups[symbol] > 1], np.cumsum(groups[several])
        for x in parts:
            held = x.take(columns[0], axis=0, mode="clip")
            for column in columns[1:]:
                held[: len(column)] += x.take(column, axis=0, mode="clip")
            out = np.zeros((SYMBOLS, x.shape[1]), np.float32)
            out[single] = held.take(alone, axis=0, mode="clip")
            if len(several):
                out[several] = np.add.reduceat(held.take(inner, axis=0, mode="clip"), ends - groups[several], axis=0)
            yield out

    def on(self, sym: np.ndarray, target: np.ndarray, fresh: np.ndarray, rate: float) -> None:
        """One step on consecutive blocks."""
        self.step += 1
        scale = np.sqrt(1 - 0.99**self.step) / np.sqrt(0.01)  # first and second are sums, without the factors of 0.1 and 0.01
        rate, least = np.float32(rate * scale * 0.1 / (1 - 0.9**self.step)), np.float32(1e-8 * scale)
        for value, g, first, second in zip(self.values, self.gradient(sym, target, fresh), self.first, self.second, strict=True):
            first *= np.float32(0.9)
            first += g
            g *= g
            second *= np.float32(0.99)
            second += g
            np.sqrt(second, out=g)
            g += least
            np.divide(first, g, out=g)
            g *= rate
            value -= g


def fit(counts: Counts, texts: list[str], path: str = VOCABULARY, steps: int = 400, seed: int = 7) -> tuple[Attention, Within]:
    """The tables of the counts, and an attention layer that begins from them and is trained on the texts."""
    rng = np.random.default_rng(seed)
    sub = Subwords(path)
    n_ids = sub.end + 1
    at, n = counts.of(IDS)
    freq = np.zeros(n_ids, np.int64)
    freq[at] = n
    group = _classes(counts, freq)
    symbol = np.full(n_ids, SYMBOLS - 2, np.int32)
    symbol[np.argsort(-freq, kind="stable")[: SYMBOLS - 2]] = np.arange(SYMBOLS - 2)
    seen = symbol.copy()
    seen[sub.end] = SYMBOLS - 1  # what follows an end is the start of a text
    at, n = counts.of(NEXT, lambda keys, n: (seen[keys // n_ids].astype(np.int64) * CLASSES + group[keys % n_ids], n))
    pair = np.zeros((SYMBOLS, CLASSES))
    pair.ravel()[at] = n
    unigram = (pair.sum(0) + 0.1) / (pair.sum() + 0.1 * CLASSES)
    p = pair + 5 * unigram
    f32 = lambda a: a.astype(np.float32)
    m = Attention(symbol, group, f32(np.log(p / p.sum(1, keepdims=True))), *(f32(rng.normal(0, 0.3, (SYMBOLS, WIDTH))) for _ in range(3)), f32(rng.normal(0, 0.05, (WIDTH, CLASSES))), np.zeros(2 * BLOCK, np.float32))
    w = Words(texts or [""], lower=True)
    x, t, fresh = _blocks(m, *sub.stream(w, w.hashes())[:2])
    size, descent = min(len(x), STEP), Descent(m)
    for step in range(1, steps + 1):
        i = int(rng.integers(0, len(x) - size + 1))
        descent.on(x[i : i + size], t[i : i + size], fresh[i : i + size], 0.02 * (1 - step / (steps + 1)))
    return m, Within.fit(counts, freq, group)


def counted(batches, path: str) -> Iterator[tuple[int, Tally]]:
    """After each chunk of texts, every kind and what is held of its counts; all is held at the end.

    What a word holds is counted once for all its occurrences, when the words remembered are dropped.
    """
    held, sub = [Tally() for _ in range(5)], Subwords(path)
    seen, n_ids = np.zeros(0, np.int64), sub.end + 1

    def flush():
        words, sizes, n = np.empty(len(sub.keys), np.uint64), sub.sizes.astype(np.int64), np.zeros(len(sub.keys), np.int64)
        words[sub.at], n[: len(seen)] = sub.keys, seen
        of_id = np.repeat(n, sizes)
        inner = np.ones(len(sub.ids), bool)
        inner[sub.starts] = False
        inner = np.flatnonzero(inner)
        held[WORDS].add(signed(words), n)
        n = np.bincount(sub.ids, of_id, n_ids).astype(np.int64)
        held[IDS].add(np.flatnonzero(n), n[n > 0])
        runs = ((context * n_ids + sub.ids[own], of_id[own]) for own, context in Within._contexts(sub.ids, sizes))
        after = sub.ids[inner - 1].astype(np.int64) * n_ids + sub.ids[inner], of_id[inner]
        for kind, (keys, n) in zip((RUN2, RUN3, NEXT), (*runs, after), strict=True):
            order = np.argsort(keys)
            held[kind].add(*tally(keys[order], n[order]))

    for part in chunks(batches, "text"):
        if len(sub.keys) > sub.limit:
            flush()
            seen = np.zeros(0, np.int64)
        w = Words(part["text"], lower=True)
        at = sub.of(w, w.hashes())
        seen = np.bincount(at, minlength=len(seen)) + np.r_[seen, np.zeros(len(sub.keys) - len(seen), np.int64)] if len(at) else seen
        first, last = sub.ids[sub.starts], sub.ids[sub.starts + sub.sizes - 1]
        texts, tails = len(w.n), w.first + w.n
        held[IDS].add(np.array([sub.end]), np.array([texts]))
        before = np.insert(last[at], tails, sub.end)  # each word's last subword, or the end, and what comes next
        behind = np.insert(first[at], tails, sub.end)
        held[NEXT].add(*tally(np.r_[sub.end, before[:-1]].astype(np.int64) * n_ids + behind))
        yield from enumerate(held)
    flush()
    yield from enumerate(held)


def train(texts: list[str], path: str = VOCABULARY, steps: int = 400, seed: int = 7) -> tuple[Attention, Within]:
    """A model of a list of texts alone."""
    held = dict(counted([pa.record_batch({"text": pa.array(texts or [""])})], path))
    return fit(Counts((kind, *t.total()) for kind, t in held.items()), texts, path, steps, seed)


def count(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(kind, key, n): how often each word, subword, run and neighbour occurs in the texts, lower-cased."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        last = {}
        for kind, held in counted(batches, path):
            last[kind] = held
            yield from _emit(schema, held, HELD, kind=kind)
        for kind, held in last.items():
            yield from _emit(schema, held, 0, kind=kind)

    got = docs.select("text").mapInArrow(run, "kind int, key long, n long")
    return got.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _flat(m: Attention) -> np.ndarray:
    return np.concatenate([getattr(m, name).ravel() for name in Descent.names]).astype(np.float64)


def trained_on(docs: DataFrame, m: Attention, path: str = VOCABULARY) -> Attention:
    """The layer after each partition went over all of its texts, whole, averaged by their windows."""
    shapes = [getattr(m, name).shape for name in Descent.names]
    schema = pa.schema([("part", pa.int32()), ("weight", pa.float64()), ("values", pa.binary())])

    def run(batches):
        own = replace(m, **{name: getattr(m, name).copy() for name in Descent.names})
        sub, descent, seen = Subwords(path), Descent(own), 0
        for part in chunks(batches, "text"):
            w = Words(part["text"], lower=True)
            x, t, fresh = _blocks(own, *sub.stream(w, w.hashes())[:2])
            for i in range(0, len(x), TRAIN_STEP):
                at = slice(i, i + TRAIN_STEP)
                descent.on(x[at], t[at], fresh[at], TRAIN_RATE)
            seen += len(x)
        if seen:
            from pyspark import TaskContext

            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([float(seen)]), pa.array([(_flat(own) * seen).tobytes()], pa.binary())], schema=schema)

    def add(table):
        total = sum(np.frombuffer(v.as_py()) for v in table["values"])
        return pa.table([table["part"][:1], pa.array([sum(table["weight"].to_pylist())]), pa.array([total.tobytes()], pa.binary())], schema=schema)

    kinds = "part int, weight double, values binary"
    got = docs.filter(F.col("text").isNotNull()).select("text").mapInArrow(run, kinds).groupBy("part").applyInArrow(add, kinds).sort("part").collect()
    if not got:
        return m
    flat = sum(np.frombuffer(r.values) for r in got) / sum(r.weight for r in got)
    parts = np.split(flat, np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
    return replace(m, **{name: p.reshape(x).astype(np.float32) for name, p, x in zip(Descent.names, parts, shapes, strict=True)})


def sample(docs: DataFrame, n_docs: int) -> list[str]:
    """About SAMPLE_DOCS whole texts: the rows whose hash of id and text is within their share, in order; the same on every run."""
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    chosen = docs.filter((place * n_docs < SAMPLE_DOCS) & F.col("text").isNotNull())
    return [r.text for r in chosen.select("text").sort("text").collect()]


def lm_score(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text has only its end; a null id is a training document;
    repeated rows each give a row; without training documents the base score of
    a token is that of an empty vocabulary; extra columns are ignored.
    """
    spark = docs.sparkSession
    training = docs.filter(fold(folds=5) != 1)
    every = store(count(training, path))
    counts = every.filter(F.col("kind") == WORDS).drop("kind")
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_docs = training.count()
    n, v = n_words + n_docs, n_kinds + (n_docs > 0)  # the ends are tokens
    hot = counts.filter(F.col("n") * HOT >= n).toArrow()
    key, c = hot["key"].to_numpy(), hot["n"].to_numpy()
    order = np.argsort(key)
    key, c = key[order], c[order]
    model, within = fit(StoredCounts(every), sample(training, n_docs), path)
    model = trained_on(training, model, path)
    bottom = n + 0.5 * (v + 1)
    hot_log = np.log10((c + 0.5) / bottom)
    end_log = float(np.log10((n_docs + 0.5) / bottom))
    sent = broadcast(spark, (model, within, key, hot_log), model.nbytes + within.nbytes + 16 * len(key), MODEL_BYTES)
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("row", pa.int64()), ("tf", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches):
        m, inside, key, hot_log = sent.value
        sub = Subwords(path, inside, hot=key)
        for part in chunks(batches, "text"):
            w = Words(part["text"], lower=True)
            h = w.hashes()
            k = len(w.n)
            at = sub.of(w, h)
            ids, sizes, _, logp = sub.stream(w, h, at)
            got = m.score(ids, sizes, logp)
            place = sub.place[at]
            is_hot = place >= 0
            base = np.bincount(w.doc[is_hot], hot_log[place[is_hot]], k) + end_log
            row = np.asarray(part["row"], np.int64)
            known = np.bincount(w.doc[is_hot], minlength=k) + int(n_docs > 0)
            yield from batches_of(schema, kind=np.full(k, 1, np.int32), key=row, row=row, tf=np.zeros(k, np.int32), doc_id=part["doc_id"], n_tokens=w.n + 1, known=known, base=base, score=got)
            cold = np.flatnonzero(~is_hot)
            both = w.doc[cold] * len(sub.sizes) + at[cold]  # a text and a word
            order = np.argsort(both)
            both, doc, rest = both[order], w.doc[cold][order], signed(h[cold])[order]
            starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(doc) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[starts, len(doc)])
            e = len(starts)
            for batch in batches_of(pa.schema(list(schema)[:4]), kind=np.zeros(e, np.int32), key=rest[starts], row=row[doc[starts]], tf=tf):
                yield pa.record_batch([*batch.columns, *(pa.nulls(batch.num_rows, f.type) for f in list(schema)[4:])], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, "kind int, key long, row long, tf int, doc_id long, n_tokens long, known long, base double, score double")
    cold = counts.filter(F.col("n") * HOT < n).withColumn("kind", F.lit(0))
    joined = rows.join(cold, ["kind", "key"], "left")
    tf_known = F.when(F.col("kind") == 0, F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).otherwise(F.col("known"))
    part_base = F.when(F.col("kind") == 0, F.col("tf") * F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(float(bottom)))).otherwise(F.col("base"))
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum(tf_known.cast("long")).alias("n_known"), F.sum(part_base).alias("base_score"), F.max("score").alias("score"))
        .select("doc_id", (fold(folds=5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )
