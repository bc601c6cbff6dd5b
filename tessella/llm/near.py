"""MinHash near-dedup: consistent weighted sampling by darts over TF-IDF shingles.

Equal texts are first collapsed to one node. A text's weighted set
has its runs of SHINGLE words (a shorter text is one run); the weight is the
run's count times 1 + GAIN * the mean IDF of its words as a share of the largest
IDF. Document frequencies come from every document; words above 1/HOT of all
(document, word) pairs, at most HOT of them, are broadcast, and the others have
the largest IDF.

Each set is sampled BANDS * ROWS times, whatever its size: darts are thrown at
the weights of its shingles, each in one of BANDS * ROWS bins, and the lowest of
a bin is its sample (the darts come from hashes, those of large ranks are never
drawn, so the work is that of one pass over the words).
Samples form bands; any two texts that share a band's key are compared, unless
links have already put them in one class or exact bounds rule it out. One bound is
by total weights; the other, for keys of many members, by each text's own weight,
that of the shingles that no other text of such keys has, its common weight, that
of frequent shingles, and that of the rest: the difference of a pair is its own
weights and the differences of its common ones and its rests at least. So members
are compared with those only whose slack (own weight less a share of the total)
fits theirs, and those of least slack, the likeliest partners of all, lead. This
goes in rounds: leaders of each key meet its members and leave it, keys of one
class end, and later rounds have more leaders, chosen from the texts outside of
the key's largest class. A pair that shares several such keys meets in the
smallest. A pair is linked if its exact weighted Jaccard similarity is at least
THRESHOLD. Classes are the connected components of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Tally, Words, batches_of, broadcast, chunks, mix, ngram_hashes, signed, store

SHINGLE = 5
THRESHOLD = 0.8
GAIN = 0.2
HOT = 1 << 16
BANDS = 12
ROWS = 3
#: How many times more leaders a key has in each further round, and members of a key in a part.
WIDER, PART = 256, 512
#: Leaders of a key by slack: the least in each of as many parts of its members.
LEADERS = 8
#: Keys of more members than this are led, and use the bound by own weights.
FEW = 5
#: Texts that have a common shingle, at least.
COMMON = 8
#: Columns of weight that are drawn for at once.
CELLS = 1 << 18


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(key, n): in how many documents each word is, by its hash."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held = Tally()
        for part in chunks(batches, "text"):
            w = Words(part["text"])
            h = w.hashes()
            order = np.lexsort((w.doc, h))
            h, doc = h[order], w.doc[order]
            held.add(*_counts(signed(h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]] if len(h) else h)))
        keys, n = held.total()
        yield from batches_of(schema, key=keys, n=n)

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, n = np.unique(keys, return_counts=True)
    return values, n.astype(np.int64)


class Weights:
    """Relative IDF (0 to 1) of words by hash."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n_docs: int, least: float):
        order = np.argsort(keys)
        self.keys = keys[order]
        top = max(np.log((1 + n_docs) / (1 + least)), 1e-9)
        self.share = np.clip(np.log((1 + n_docs) / (1 + df[order])) / top, 0, 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        h = signed(h)
        if not len(self.keys):
            return np.ones(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.share[at], 1.0)


def learn(docs: DataFrame) -> Weights:
    counts = store(document_frequencies(docs))
    pairs = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_docs = docs.count()
    hot = counts.filter(F.col("n") * HOT >= pairs).toArrow()  # at most HOT rows
    return Weights(hot["key"].to_numpy(), hot["n"].to_numpy(), n_docs, pairs / HOT)


def shingles(texts: list[str | None], weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of the distinct shingles, in order."""
    w = Words(texts)
    h = w.hashes()
    idf = np.r_[0.0, np.cumsum(weights(h))]
    at, s = w.runs(SHINGLE, h)
    doc, mean = w.doc[at], (idf[at + SHINGLE] - idf[at]) / SHINGLE
    few = np.flatnonzero((w.n > 0) & (w.n < SHINGLE))
    if len(few):
        lo, hi = w.first[few], w.first[few] + w.n[few]
        whole = np.array([ngram_hashes(h[a:b], int(b - a))[0] for a, b in zip(lo, hi, strict=True)], np.uint64)
        doc, s, mean = np.r_[doc, few], np.r_[s, whole], np.r_[mean, (idf[hi] - idf[lo]) / w.n[few]]
    order = np.lexsort((s, doc))
    doc, s, mean = doc[order], s[order], mean[order]
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])]) if len(doc) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[starts, len(doc)])
    return doc[starts], s[starts], tf * (1 + GAIN * mean[starts])


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _darts(h: np.ndarray, weight: np.ndarray, limit: np.ndarray):
    """The darts (number of its shingle, rank, hash) that hit the shingles and rank below ``limit``, block by block.

    A shingle's weight is cut into columns of a fixed width; on each, darts fall
    as a Poisson process of rate 1 over weight and rank, drawn from hashes of
    shingle, column and number alone. A dart hits if its height is within the
    weight. So the lowest dart of a set agrees with that of another with
    probability of their weighted Jaccard similarity.
    """
    width = 1 + GAIN  # a shingle that is there once has one column
    columns = np.ceil(weight / width).astype(np.int64)
    ends = np.cumsum(columns)
    for lo in range(0, int(ends[-1]), CELLS):
        at = np.arange(lo, min(lo + CELLS, int(ends[-1])))
        own = np.searchsorted(ends, at, side="right")
        column = at - (ends[own] - columns[own])
        cell = mix(h[own] + column.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        rank = np.zeros(len(own))
        while True:
            cell = cell + np.uint64(0x9E3779B97F4A7C15)
            dart = mix(cell)
            rank = rank - np.log(_uniform(dart)) / width
            near = rank < limit[own]
            if not near.any():
                break
            own, column, cell, rank = own[near], column[near], cell[near], rank[near]
            dart = mix(dart[near] ^ np.uint64(0xA24BAED4963EE407))
            hit = (column + _uniform(mix(dart ^ np.uint64(0x9FB21C651E98DF25)))) * width < weight[own]
            yield own[hit], rank[hit], dart[hit]


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """BANDS * ROWS consistent weighted samples of each text, as hashes (0: no shingle): the lowest darts of as many bins."""
    k = BANDS * ROWS
    out = np.zeros((n_docs, k), np.uint64)
    mass = np.bincount(doc, weight, n_docs)
    todo = mass > 0
    limit = k * (np.log(k) + 4) / np.maximum(mass, 1e-9)  # few texts have a bin without a dart below this
    while todo.any():
        own = np.flatnonzero(todo[doc])
        found = [(doc[own[i]] * k + (mix(dart) % np.uint64(k)).astype(np.int64), rank, dart) for i, rank, dart in _darts(h[own], weight[own], limit[doc[own]])]
        lowest = _minima(*(np.concatenate(x) for x in zip(*found, strict=True)), n_docs * k).reshape(n_docs, k) if found else out
        out[todo] = lowest[todo]
        todo = todo & (out == 0).any(1)
        limit = limit * 2
    return out


def _minima(group: np.ndarray, value: np.ndarray, sample: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, group))
    g = group[order]
    first = order[np.r_[True, g[1:] != g[:-1]]] if len(g) else order
    out = np.zeros(n, np.uint64)  # 0: no shingle
    out[group[first]] = sample[first]
    return out


def band_keys(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int) -> list[list[int]]:
    """Band keys of each text: BANDS, or none without a shingle."""
    keys = samples(doc, h, weight, n_docs).reshape(n_docs, BANDS, ROWS)
    mixed = np.broadcast_to(np.arange(BANDS).astype(np.uint64), (n_docs, BANDS)).copy()
    for i in range(ROWS):
        mixed = mix(mixed * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, i])
    full = (keys != 0).all(2)
    return [signed(m[f]).tolist() for m, f in zip(mixed, full, strict=True)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 0.0


def _signatures(docs: DataFrame, sent) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("mass", pa.float64())])

    def run(batches):
        for part in chunks(batches, "text"):
            n = len(part["text"])
            doc, h, weight = shingles(part["text"], sent.value)
            yield from batches_of(schema, node=part["node"], doc_id=part["doc_id"], keys=band_keys(doc, h, weight, n), mass=np.bincount(doc, weight, n))

    return docs.mapInArrow(run, "node long, doc_id long, keys array<long>, mass double")


def _verified(pairs: DataFrame, texts: DataFrame, sent, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            for part in chunks([batch], "text_a"):
                doc, h, w = shingles(part["text_b"], sent.value)
                cuts = np.searchsorted(doc, np.arange(len(part["b"]) + 1))
                rows = []
                for i, (a, b) in enumerate(zip(part["a"], part["b"], strict=True)):
                    if last[0] != a:
                        last = (a, shingles([part["text_a"][i]], sent.value)[1:])
                    value = similarity(last[1], (h[cuts[i] : cuts[i + 1]], w[cuts[i] : cuts[i + 1]]))
                    if value >= threshold:
                        rows.append((a, b, value))
                if rows:
                    yield from batches_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _bounds(nodes: DataFrame, texts: DataFrame, sent) -> DataFrame:
    """(node, own, common): total weights of each node's shingles that no other of the nodes has, and that COMMON of them have."""
    schema = pa.schema([("h", pa.int64()), ("node", pa.int64()), ("weight", pa.float64())])

    def run(batches):
        for part in chunks(batches, "text"):
            doc, h, weight = shingles(part["text"], sent.value)
            yield from batches_of(schema, h=signed(h), node=np.array(part["node"], np.int64)[doc], weight=weight)

    rows = store(texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(run, "h long, node long, weight double"))
    counts = rows.groupBy("h").agg(F.count("*").alias("n")).filter(f"n = 1 OR n >= {COMMON}")
    both = rows.join(counts.hint("merge"), "h")
    return both.groupBy("node").agg(F.sum(F.expr("if(n = 1, weight, 0)")).alias("own"), F.sum(F.expr("if(n = 1, 0, weight)")).alias("common"))


def _met(members: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, share) that meet in one round, and the members (key, node, label, mass, slack, common, rest, led) that are left for the next.

    All members of a key of FEW lead, and LEADERS of any key that have little slack. If
    ``width`` isn't 0, also the members of the most frequent label that has
    ``width`` of them at most, and about ``width`` of the others, chosen by hash,
    or all if these are 4 * ``width`` at most. Leaders meet all members of other
    labels and leave; a key ends when one label is left. Members leave too when no
    other's slack fits theirs. ``share`` is the smaller of a pair's masses (total
    weights) over the larger.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(LEADERS))
    least = [F.min(F.when(part == i, F.struct("slack", "node"))).alias(f"l{i}") for i in range(LEADERS)]
    sides = ("(common + rest)", "(common - rest)", "(rest - common)", "(- common - rest)")  # a sum of absolute values is the largest of these sums
    kinds = members.groupBy("key", "label").agg(F.count("*").alias("n"), *least, *(F.min(F.expr(f"slack + {x}")).alias(f"m{i}") for i, x in enumerate(sides)))
    keys = kinds.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("kinds"), *(F.min(c).alias(c) for c in (*(f"m{i}" for i in range(4)), *(f"l{i}" for i in range(LEADERS))))).filter("kinds > 1")
    leaders = F.array_sort(F.array(*(f"l{i}" for i in range(LEADERS))))
    keys = keys.select("key", "n", "top", "m0", "m1", "m2", "m3", leaders.alias("leaders"), leaders[0].alias("least"))
    place = F.pmod(F.xxhash64("node", "key"), F.lit(1 << 30)) / (1 << 30)
    lead = (F.col("n") <= FEW) | F.coalesce(F.array_contains(F.col("leaders.node"), F.col("node")), F.lit(False))
    if width:
        rest = F.col("n") - F.col("top.n")
        lead |= F.when(F.col("label") == F.col("top.label"), F.col("top.n") <= width).otherwise((rest <= 4 * width) | (place * rest < width))
    fits = F.expr("node = least.node OR slack + least.slack <= 1e-6" + "".join(f" AND slack - {x} + m{i} <= 1e-6" for i, x in enumerate(sides)))
    dealt = store(members.join(keys.hint("merge"), "key").filter(fits).select("key", "node", "label", "mass", "slack", "common", "rest", "led", lead.alias("lead"), F.expr(f"n div {PART} + 1").alias("parts")))
    # a hot key's members are dealt to parts; its leaders go to each of them
    left = dealt.filter("lead").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("node").alias("x"), F.col("label").alias("lx"), F.col("mass").alias("mx"), F.col("slack").alias("sx"), F.col("common").alias("cx"), F.col("rest").alias("rx"), F.col("led").alias("kx"))
    right = dealt.select("key", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node", "label", "mass", "slack", "common", "rest", "led", "lead")
    both = left.join(right.hint("merge"), ["key", "part"]).filter("label <> lx AND (NOT lead OR x < node) AND slack + sx + abs(common - cx) + abs(rest - rx) <= 1e-6 AND (led IS NULL OR array_min(array_intersect(led, kx)) = key)")
    share = F.least("mass", "mx") / F.greatest("mass", "mx")
    pairs = both.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"), share.alias("share"))
    return pairs, dealt.filter("NOT lead").select("key", "node", "label", "mass", "slack", "common", "rest", "led")


def _links(members: DataFrame, texts: DataFrame, sent, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The verified links (a, b, similarity), and (node, label) of the components they make.

    Two texts that share a key are compared, unless they are already in one
    component or can't be similar: leaders leave their keys only after they met
    every member.
    """
    # a pair reaches the threshold if its difference is at most this share of its masses, which its own weights are part of
    least = (1 - threshold) / (1 + threshold)
    known = _bounds(members.filter(F.col("n") > FEW).select("node").distinct(), texts, sent)
    lists = members.filter(F.col("n") > FEW).groupBy("node").agg(F.collect_list("key").alias("led"))  # at most BANDS
    of = lambda x, other: F.when(F.col("n") > FEW, x).otherwise(F.lit(other))  # noqa: E731  the members of smaller keys always fit
    members = members.join(known.hint("merge"), "node", "left").join(lists.hint("merge"), "node", "left").fillna(0.0, ["own", "common"])
    bounds = {"slack": of(F.col("own") - least * F.col("mass"), -1e9), "common": of(F.col("common"), 0.0), "rest": of(F.col("mass") - F.col("own") - F.col("common"), 0.0), "led": of(F.col("led"), None)}
    members = members.select("key", "node", F.col("node").alias("label"), "mass", *(c.alias(name) for name, c in bounds.items()))
    links = tried = None
    width = 0
    while True:
        pairs, left = _met(members, width)
        # the least weights sum to the smaller mass at most, so the similarity is ``share`` at most
        pairs = pairs.filter(F.col("share") >= threshold - 1e-9).select("a", "b").distinct()
        pairs = store(pairs if tried is None else pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"))
        found = store(_verified(pairs, texts, sent, threshold))
        links, tried = (found, pairs) if links is None else (links.unionByName(found), tried.unionByName(pairs))
        labels = components(links)
        known = labels.select("node", F.col("label").alias("new"))
        left = left.join(known.hint("merge"), "node", "left").select("key", "node", F.coalesce("new", "label").alias("label"), "mass", "slack", "common", "rest", "led")
        open_keys = left.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
        members = store(left.join(open_keys.hint("merge"), "key", "left_semi"))
        if not members.limit(1).count():
            return links, labels
        width = max(1, width) * WIDER


def components(edges: DataFrame) -> DataFrame:
    """(node, label): nodes of one connected component, and only those, have one label.

    Each node takes the smallest neighbour of its smallest neighbour (itself
    included), and the edges between different labels are the graph of the next
    step, until there are none.
    """
    graph, labels = edges.select(F.col("a").alias("x"), F.col("b").alias("y")), None
    while True:
        both = graph.unionByName(graph.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = store(both.groupBy("x").agg(F.min("y").alias("up")).select("x", F.least("x", "up").alias("up")))
        step = store(up.join(up.select(F.col("x").alias("up"), F.col("up").alias("top")).hint("merge"), "up").select(F.col("x").alias("node"), F.col("top").alias("label")))
        if labels is None:
            labels = step
        else:
            moved = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("new")).hint("merge"), "label", "left")
            labels = store(moved.select("node", F.coalesce("new", "label").alias("label")))
        ends = graph
        for end in ("x", "y"):
            ends = ends.join(step.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")).hint("merge"), end)
        ends = ends.filter("of_x <> of_y").select(F.least("of_x", "of_y").alias("x"), F.greatest("of_x", "of_y").alias("y"))
        graph = store(ends.distinct())
        if not graph.limit(1).count():
            return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), n_links (verified links of its text), n_copies (documents of equal text).

    Null texts and null ids are classes of their own (class_id is the doc_id);
    empty texts are copies of each other; rows of one id are documents of their
    own; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    node = F.conv(F.substring(F.md5(F.encode("text", "UTF-8")), 1, 15), 16, 10).cast("long")
    keyed = docs.select("doc_id", "text", node.alias("node"))
    valid = keyed.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    weights = learn(valid)
    sent = broadcast(spark, weights, weights.keys.nbytes + weights.share.nbytes, 16 * HOT)
    rows = store(_signatures(valid.select("node", "doc_id", "text"), sent))
    reps = store(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.min_by(F.struct("keys", "mass"), "doc_id").alias("x")).select("node", "rep", "n_copies", "x.keys", "x.mass"))
    members = reps.select("node", "mass", F.explode("keys").alias("key"))
    several = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = store(members.join(several, "key"))
    texts = store(valid.select("node", "text").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    links, labels = _links(members, texts, sent, threshold)
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    labelled = reps.select("node", "rep", "n_copies").join(labels, "node", "left").join(ends, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    known = store(labelled.join(known, "label").select("node", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies"))
    merged = rows.select("node", "doc_id").join(known, "node").select("doc_id", "class_id", "n_links", "n_copies")
    alone = keyed.filter("doc_id IS NULL OR text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return merged.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents (all columns) without those whose class has a smaller doc_id.

    Null texts and null ids stay; of rows of one id, all go if one of them has a
    smaller copy, and else all stay; an empty table gives none; extra columns
    are kept whatever their names.
    """
    later = classes(docs, threshold).filter("class_id < doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)
