"""Line dedup by winnowing over line hashes.

A document is the sequence of the hashes of its lines that have a word. Runs of
GRAM lines are hashed, and of the runs in every window of MIN_LINES lines the
one with the smallest hash is selected: any repeated window has its fingerprint
selected at the same place, so fingerprints that occur once are out. The others
are joined on their positions and extended to both sides, up to the windows of
MIN_LINES lines that hold them: a window that has an earlier equal one, in order
of (doc_id, text hash, line), is deleted, whatever the first places of its
neighbours are. A run of repeated lines is the union of its windows. First
places are minima that Spark pre-aggregates, so common lines cost no pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .text import Words, batches_of, chunks, free_names, ngram_hashes, raw, signed, slices, store

MIN_LINES = 3


def line_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the lines with a word of each text, in order."""
    w = Words(texts)
    cuts = np.r_[-1, np.flatnonzero(w.buf == 10)]
    own = np.searchsorted(w.doc_ends - 1, cuts[1:])
    filled = np.searchsorted(w.starts, cuts[1:]) > np.searchsorted(w.starts, cuts[:-1])
    h = w.spans(cuts[:-1] + 1, cuts[1:])[filled]
    return np.split(h, np.cumsum(np.bincount(own[filled], minlength=len(texts)))[:-1])


def windows_of(lines: np.ndarray, min_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and fingerprint of each window of ``min_lines`` lines, and the fingerprints of the selected places."""
    gram = (min_lines + 1) // 2
    h = ngram_hashes(lines, gram)
    view = np.lib.stride_tricks.sliding_window_view(h, min_lines - gram + 1)
    at = np.arange(len(view)) + view.shape[1] - 1 - np.argmin(view[:, ::-1], axis=1)  # the last of equal minima
    return ngram_hashes(lines, min_lines), h[at], h[np.unique(at)]


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, th, at): the document's key (doc_id, text hash) and the first filled line of each window to delete."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("window", pa.list_(pa.int64())), ("fp", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])

    def sequences(batches):
        for part in chunks(batches, "text"):
            lines = line_hashes(part["text"])
            some = [i for i, x in enumerate(lines) if len(x) >= min_lines]
            found = [tuple(map(signed, windows_of(lines[i], min_lines))) for i in some]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield from batches_of(schema, doc_id=[part["doc_id"][i] for i in some], th=[part["th"][i] for i in some], **dict(zip(("window", "fp", "places"), map(list, columns), strict=True)))

    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("th"), "text").filter(F.col("text").isNotNull())
    seq = store(keyed.mapInArrow(sequences, "doc_id long, th long, window array<long>, fp array<long>, places array<long>"))
    several = seq.select(F.explode("places").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    each = seq.select(F.struct("doc_id", "th").alias("doc"), F.posexplode(F.arrays_zip("window", "fp")).alias("at", "x")).select("doc", "at", "x.window", "x.fp")
    seen = store(each.join(several, "fp").select("doc", "at", "window"))
    first = seen.groupBy("window").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = seen.join(first, "window").filter(F.struct("doc", "at") > F.col("first"))
    return found.groupBy("doc.doc_id", "doc.th").agg(F.collect_set("at").alias("at"))  # at most the document's lines


def delete_runs(text: str, gone: set[int]) -> str:
    """The text without its filled lines of these numbers."""
    kept, at = [], 0
    for line in raw(text).split(b"\n"):
        filled = bool(line.split())
        if not (filled and at in gone):
            kept.append(line)
        at += filled
    return b"\n".join(kept).decode("utf-8", "surrogatepass")


def _marked(docs: DataFrame, at: str, min_lines: int) -> DataFrame:
    """``docs`` with a column of the first lines of its windows to delete (null: none)."""
    ids, hashes = free_names(docs, "_doc_id", "_text_hash")
    found = repeated_runs(docs, min_lines).toDF(ids, hashes, at)
    key = [F.coalesce(docs.doc_id, F.lit(-(1 << 63))).alias(ids), F.xxhash64(docs.text).alias(hashes)]
    return docs.select("*", *key).join(found, [ids, hashes], "left").select(*docs.columns, at)


def _cleaned(texts: list, marks: list, min_lines: int) -> tuple[list, list[int]]:
    """Texts without the marked windows, and how many lines of each went."""
    gone = [{i + k for i in m for k in range(min_lines)} if m else None for m in marks]
    return [delete_runs(t, g) if g else t for t, g in zip(texts, gone, strict=True)], [len(g) if g else 0 for g in gone]


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, removed: str = "n_removed") -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without later repeated runs of lines, and the number of lines that went.

    Rows of equal doc_id and text are one document here. Null and empty texts
    stay as they are; a null id comes before all others; blank lines never go;
    an empty table gives none. Extra columns are kept whatever their names, but a
    column called ``removed`` is replaced.
    """
    docs = docs.drop(removed)
    (at,) = free_names(docs, "_at")
    names = docs.columns
    out = StructType([*docs.schema.fields, StructField(removed, LongType())])

    def apply(batches):
        for part in slices(batches, "text"):
            texts, gone = _cleaned(part.column("text").to_pylist(), part.column(at).to_pylist(), min_lines)
            columns = [pa.array(texts, part.schema.field("text").type) if n == "text" else part.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], names=[*names, removed])

    return _marked(docs, at, min_lines).mapInArrow(apply, out)


def report(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_removed, kept_sha256 of what is left (null text: of nothing).

    Odd rows are treated as by ``dedup_lines``; extra columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches):
        for part in chunks(batches, "text"):
            texts, gone = _cleaned(part["text"], part["at"], min_lines)
            yield from batches_of(schema, doc_id=part["doc_id"], n_lines=[len(x) for x in line_hashes(part["text"])], n_removed=gone, kept_sha256=[hashlib.sha256(raw(t)).hexdigest() for t in texts])

    return _marked(docs.select("doc_id", "text"), "at", min_lines).mapInArrow(digest, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
