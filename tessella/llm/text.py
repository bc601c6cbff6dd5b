"""Words, hashes and chunking shared by the corpus operators.

Every Python stage here is ``mapInArrow`` over chunks whose text is bounded in
bytes, so that memory doesn't depend on Arrow's batch size or on how long
documents are (one document is the least a chunk can hold).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
#: Bytes that are hashed at once.
BLOCK = 1 << 17
#: ``[^\x20\x09-\x0D]+`` as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Separators when only letters and digits count: every ASCII byte that is neither.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_U = np.uint64
_OWN_FOLDER: dict[str, str] = {}
_P = 0x9E3779B97F4A7C15


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _OWN_FOLDER.setdefault("path", tempfile.mkdtemp(prefix="tessella-"))
    return folder.rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; it is deleted when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def broadcast(spark: SparkSession, value, size: int, bound: int):
    """Send ``value`` to all executors; ``size`` bytes must be within ``bound``."""
    if size > bound:
        raise ValueError(f"{size} bytes to broadcast are above the bound of {bound}")
    return spark.sparkContext.broadcast(value)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose column ``text`` has about ``limit`` bytes at most."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string()).cast(pa.large_binary())), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[dict[str, list]]:
    """Columns as Python lists, split so that the column ``text`` has about ``limit`` bytes at most in a chunk."""
    for part in slices(batches, text, limit):
        yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has (whatever their case): those given, with underscores in front where needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def raw(text: str | None) -> bytes:
    """UTF-8 bytes; a null text counts as empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D (just what ``bytes.split`` does)."""
    return raw(text).split()


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64) | _U(1)


_BYTE = _odd(11, 256)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        n += n // 4
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            values = np.full(n, base, np.uint64)
            values[0] = 1
            _POWERS[name] = np.cumprod(values, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """All words of a list of texts: byte positions, document numbers and 64-bit hashes, in arrays."""

    def __init__(self, texts: list[str | None], lower: bool = False, white: np.ndarray = WHITE):
        parts = [raw(t) for t in texts]
        data = b"\n".join(parts) + b"\n"
        self.data = data.lower() if lower else data  # bytes: only A-Z change
        self.buf = np.frombuffer(self.data, np.uint8)
        self.doc_ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        white = white[self.buf]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edges = np.r_[0, edges]
        self.white, self.starts, self.ends = white, edges[0::2], edges[1::2]
        at = np.searchsorted(self.starts, self.doc_ends)
        self.first = np.r_[0, at[:-1]]
        self.n = at - self.first
        self.doc = np.repeat(np.arange(len(parts)), self.n)

    def by_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are marked."""
        sums = np.cumsum(flags)[self.doc_ends - 1]
        return np.diff(sums, prepend=0)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span; the spans are in order and don't overlap."""
        out = np.zeros(len(starts), np.uint64)
        up, down = _powers(BLOCK + 1)
        i = 0
        while i < len(starts):
            base = int(starts[i])
            j = int(np.searchsorted(ends, base + BLOCK, side="right"))
            if j > i:  # as many spans as end within a block
                part = _BYTE[self.buf[base : int(ends[j - 1])]]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * up[: len(part)], out=sums[1:])
                lo = starts[i:j] - base
                out[i:j] = (sums[ends[i:j] - base] - sums[lo]) * down[lo]
                i = j
            else:  # a span longer than a block
                for k, at in enumerate(range(base, int(ends[i]), BLOCK)):
                    part = _BYTE[self.buf[at : min(at + BLOCK, int(ends[i]))]]
                    out[i] += (part * up[: len(part)]).sum(dtype=np.uint64) * _U(pow(_P, k * BLOCK, 1 << 64))
                i += 1
        return mix(out)

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def runs(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of every run of ``k`` words within one document, and the run's hash."""
        h = ngram_hashes(self.hashes() if hashes is None else hashes, k)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits are usable."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries (a polynomial over 64-bit words, finalised)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 16:
        out = h[:n].copy()
        for i in range(1, k):
            out *= _U(_P)
            out += h[i : n + i]
        return mix(out)
    powers = np.full(len(h) + 1, _P, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    inverse = np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[:-1], dtype=np.uint64, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's ``bigint``."""
    return h.view(np.int64)


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        values, n = np.unique(keys, return_counts=True)
        return values, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


class Tally:
    """Counts by integer key, merged as they come; held entries stay near the number of distinct keys."""

    def __init__(self, every: int = 1 << 21):
        self.parts, self.held, self.every = [], 0, every

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if len(keys):
            self.parts.append((keys, np.ones(len(keys), np.int64) if counts is None else counts))
            self.held += len(keys)
            if self.held > self.every:
                self.total()
                self.every = max(self.every, 2 * self.held)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = tally(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
        self.parts, self.held = [(keys, counts)], len(keys)
        return keys, counts


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def batches_of(schema: pa.Schema, rows: int = 50_000, **columns) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows."""
    table = pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    yield from table.to_batches(max_chunksize=rows)
