"""Language identification by inference of a mixture of languages.

Features are trigrams of lower-case code points around a letter (anything else
counts as one boundary mark), hashed into ``2**HASH_BITS`` buckets, so the model
is bounded by that number of buckets for each label. Counts come from every
labelled training document. For a document, expectation-maximisation estimates
the proportions of the languages from the likelihoods of its trigrams, until they
settle; then the likelihoods of the nested sets of its most probable languages,
less a penalty for each further language, select the set (sets grow until that
falls), and the largest share in it is the prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CHUNK_BYTES, batches_of, broadcast, chunks, code_points

HASH_BITS = 15
BUCKETS = 1 << HASH_BITS
MODEL_BYTES = 256 << 20
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


@dataclass
class Features:
    """Distinct (document, bucket) pairs of some texts, in order, and how often each occurs."""

    doc: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    has_letter: np.ndarray


def features(texts: list[str | None]) -> Features:
    parts = [code_points(f"\n{t.lower()}\n") if t else np.zeros(2, np.uint32) for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    cp = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    is_letter = letters()[cp]
    c = np.where(is_letter, cp, np.uint32(0))
    at = np.flatnonzero(is_letter)
    h = c[at - 1] * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA6B) + c[at + 1] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    doc = np.repeat(np.arange(len(parts), dtype=np.int64), sizes)[at]
    keys = (doc << HASH_BITS) | (h >> np.uint32(32 - HASH_BITS))
    keys.sort()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.r_[starts, len(keys)])
    keys = keys[starts]
    doc = keys >> HASH_BITS
    return Features(doc, keys & (BUCKETS - 1), count, np.bincount(doc, minlength=len(parts)) > 0)


def count(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows with a text and a lang."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for part in chunks(batches, "text"):
            f = features(part["text"])
            names = sorted(set(part["lang"]))
            code = np.array([names.index(x) for x in part["lang"]])
            for i, lang in enumerate(names):
                own = code[f.doc] == i
                n = np.bincount(f.bucket[own], f.count[own], BUCKETS).astype(np.int64)
                held[lang] = held[lang] + n if lang in held else n
        for lang, n in held.items():
            some = np.flatnonzero(n)
            yield from batches_of(schema, lang=[lang] * len(some), bucket=some, n=n[some])

    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Mixture:
    names: list[str]
    p: np.ndarray  # buckets x languages
    penalty: float = 6.0
    settled: float = 0.01  # largest change of a share in the last step
    steps: int = 200

    def predict(self, f: Features, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the languages by share, and shares in the selected set (0 outside of it), for documents with letters."""
        some = np.flatnonzero(f.has_letter)
        row = np.cumsum(f.has_letter)[f.doc] - 1
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        like, n = self.p[f.bucket], f.count.astype(np.float32)
        total = np.add.reduceat(n, starts)[:, None]
        share = self._settle(np.full((len(some), len(self.names)), 1 / len(self.names), np.float32), like, n, row, total)
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
        best, chosen, growing = None, share, np.ones(len(some), bool)
        for k in range(1, len(self.names) + 1):
            own = np.flatnonzero(growing)
            part = growing[row]
            at = np.cumsum(growing)[row[part]] - 1
            s = np.where(rank[own] < k, share[own], 0)
            s /= s.sum(1, keepdims=True)
            if k > 1:
                s = self._settle(s, like[part], n[part], at, total[own])
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            value = np.add.reduceat(n[part] * np.log((s[at] * like[part]).sum(1)), first) - self.penalty * (k - 1) * np.log(total[own, 0] + 1)
            if best is None:
                best, chosen = value, s
                continue
            better = value > best[own]
            best[own[better]], chosen[own[better]] = value[better], s[better]
            growing[own[~better]] = False
            if not growing.any():
                break
        out = np.zeros((n_docs, len(self.names)), np.float32)
        out[some] = chosen
        ranks = np.zeros((n_docs, len(self.names)), np.int64)
        ranks[some] = np.argsort(-chosen, axis=1, kind="stable")
        return ranks, out

    def _settle(self, share, like, n, row, total):
        """Steps of expectation and maximisation for each document until its shares settle; what others do doesn't matter."""
        share, live = share.copy(), np.arange(len(share))
        for _ in range(self.steps):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            new = self._step(share[live], like, n, row, starts, total)
            moving = np.abs(new - share[live]).max(1) >= self.settled
            share[live] = new
            if not moving.any():
                break
            if moving.mean() < 0.8:
                part = moving[row]
                live, total = live[moving], total[moving]
                like, n, row = like[part], n[part], np.cumsum(moving)[row[part]] - 1
        return share

    @staticmethod
    def _step(share, like, n, row, starts, total):
        r = share[row] * like
        r *= (n / r.sum(1))[:, None]
        return np.add.reduceat(r, starts, axis=0) / total


def fit(docs: DataFrame, **options) -> Mixture:
    """A model of the labels of ``docs`` (lang, text)."""
    table = count(docs).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    n = np.zeros((BUCKETS, len(names)))
    where = {x: i for i, x in enumerate(names)}
    n[table["bucket"].to_numpy(), [where[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    return Mixture(names, ((n + 0.5) / (n.sum(0) + 0.5 * BUCKETS)).astype(np.float32), **options)


def predict(docs: DataFrame, model: Mixture) -> DataFrame:
    """(doc_id, lang_pred, score, langs) of every row; only the text is read for it."""
    sent = broadcast(docs.sparkSession, model, model.p.nbytes, MODEL_BYTES)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string()))])

    def run(batches):
        m = sent.value
        for part in chunks(batches, "text", 4 * CHUNK_BYTES // max(4, len(m.names))):
            f, n = features(part["text"]), len(part["text"])
            known = f.has_letter & bool(m.names)
            if known.any():
                order, share = m.predict(f, n)
            pred, score, sets = [], [], []
            for i in range(n):
                if known[i]:
                    own = [k for k in order[i] if share[i, k] > 0.02] or [order[i][0]]
                    pred.append(m.names[own[0]])
                    score.append(min(1.0, float(share[i, own[0]])))
                    sets.append([m.names[k] for k in own])
                else:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    sets.append([])
            yield from batches_of(schema, doc_id=part["doc_id"], lang_pred=pred, score=score, langs=sets)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>")


def fold(doc_id: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: ``held_out``, ``lang_pred``, ``score``, ``langs`` (the selected set, largest share first).

    Learns from documents with a text and a lang whose fold isn't 2. A null or
    letterless text is ``und`` with score 0; without any label all are. Repeated
    rows each give a row, an empty table none, extra columns are ignored.
    """
    model = fit(docs.filter(fold() != 2).select("lang", "text"))
    return predict(docs, model).withColumn("held_out", fold() == 2).select("doc_id", "held_out", "lang_pred", "score", "langs")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents (all columns) whose prediction isn't ``und`` and has a share of ``least`` or more.

    Null, empty and letterless texts go; without any label all go; repeated rows
    are judged alike; an empty table gives none; extra columns are kept whatever
    their names.
    """
    model = fit(docs.filter(fold() != 2).select("lang", "text"))
    sent = broadcast(docs.sparkSession, model, model.p.nbytes, MODEL_BYTES)

    def run(batches):
        m = sent.value
        for batch in batches:
            keep = []
            for part in chunks([batch], "text", 4 * CHUNK_BYTES // max(4, len(m.names))):
                f, n = features(part["text"]), len(part["text"])
                known = f.has_letter & bool(m.names)
                if known.any():
                    order, share = m.predict(f, n)
                    keep.append(known & (share.max(1) >= least))
                else:
                    keep.append(known)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
