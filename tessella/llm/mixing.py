"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are shuffled by the MD5 of their id. A document's virtual
finish time is the cumulative size of its source up to it, divided by the
source's target; a second pass over a source follows on its first. The documents
of all sources, ordered by finish time, are taken until the total budget is
used. Running sums are taken in two levels (within hash buckets of a source, then
over the sums of buckets; the same for bins of finish time), so that no task
holds a source or the whole order, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import WORD, store

#: Documents of a bucket or a bin that one task orders, about.
ROWS = 20_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2


def size_of(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by repeating weights, none above PASSES times its size."""
    every = W.partitionBy()
    ranked = sizes.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * PASSES
    by_ratio = W.orderBy(cap / F.col("weight"), "at")
    filled = (
        weighed.withColumn("capped", F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    )
    fits = F.when(F.col("level") <= cap / F.col("weight"), F.col("level"))
    return filled.withColumn("level", F.max(fits).over(every)).select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _order(passed: int) -> Column:
    """What the documents of all sources are ordered by."""
    finish = F.when(F.col("target") > 0, (F.col("upto") + passed * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    return F.struct(finish.alias("finish"), F.col("at").alias("source_at"), F.lit(passed).alias("pass"), F.col("key"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.col("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    A null text has size 0, a null source is a source of its own and comes last,
    a null id shuffles as an empty text; equal rows are taken alike; an empty
    table gives no rows; extra columns are ignored.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    base = store(docs.select("doc_id", "source", size_of().alias("size"), key.alias("key")))
    n = base.count()
    buckets = max(1, n // ROWS)
    base = base.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("int"))
    parts = base.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    known = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share).withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    before = F.sum("part").over(W.partitionBy("source").orderBy("bucket")) - F.col("part")
    parts = parts.withColumn("before", before).alias("p").join(known.alias("k"), F.col("p.source").eqNullSafe(F.col("k.source"))).select("p.*", "source_size", "target", "at")
    within = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    placed = (
        base.withColumn("within", within)
        .alias("b")
        .join(parts.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.bucket") == F.col("p.bucket")))
        .select("doc_id", "b.source", "size", "key", "source_size", "target", "at", (F.col("before") + F.col("within")).alias("upto"))
    )
    placed = store(placed.withColumn("first", _order(0)).withColumn("second", _order(1)).drop("key", "upto", "at"))
    budget = float(share * (parts.agg(F.sum("part")).first()[0] or 0))
    bins = max(1, PASSES * n // ROWS)
    turns = placed.select(F.explode(F.array("first", "second")).alias("turn"))
    turns = turns.withColumn("bin", F.least(F.floor(F.col("turn.finish") * bins), F.lit(4 * bins)).cast("long"))
    sums = turns.groupBy("bin").agg(F.sum("turn.size").alias("part"))
    upto = sums.withColumn("upto", F.sum("part").over(W.orderBy("bin")))
    last = upto.filter(F.col("upto") > budget).orderBy("bin").limit(1).first()
    if last is None:
        taken = F.col("size") * PASSES
    else:
        inside = turns.filter(F.col("bin") == last.bin).withColumn("upto", F.sum("turn.size").over(W.orderBy("turn").rowsBetween(W.unboundedPreceding, 0)) + F.lit(last.upto - last.part))
        end = inside.filter(F.col("upto") <= budget).agg(F.max("turn").alias("turn"))
        placed = placed.crossJoin(F.broadcast(end))  # one row
        earlier = F.floor(F.col("first.finish") * bins) < last.bin, F.floor(F.col("second.finish") * bins) < last.bin
        taken = sum(F.when(e | (F.col(c) <= F.col("turn")), F.col("size")).otherwise(0) for e, c in zip(earlier, ("first", "second"), strict=True))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


SQL = """
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM base GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sizes
), filled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), known AS (
  SELECT source, source_size, place, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT max(level) FROM filled WHERE level <= 2 * source_size / weight)) AS target FROM filled
), placed AS (
  SELECT b.doc_id, b.source, b.size, b.key, k.source_size, k.target, k.place, sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM base b JOIN known k ON b.source IS NOT DISTINCT FROM k.source
), turns AS (
  SELECT p.*, t.pass, CASE WHEN target > 0 THEN (upto + t.pass * source_size) / target ELSE 0 END AS finish FROM placed p, (VALUES (0), (1)) t(pass)
), queued AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, pass, key, coalesce(doc_id, -1), size ROWS UNBOUNDED PRECEDING) AS used FROM turns
)
SELECT doc_id, source, size, source_size, target, CAST(sum(CASE WHEN used <= (SELECT 1.5e0 * sum(size) FROM base) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM queued GROUP BY doc_id, source, size, source_size, target, key
"""
