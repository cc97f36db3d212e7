"""Mixing sources to target weights: token totals, repetition rates, whole copies plus one drawn by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, text_or_empty, without

#: Up to this many sources (about 100 bytes each) the table of targets is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that the seed and the key alone decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources take the weights in turn by code point, null last. They share `share` of all sizes; a
    target stops at `cap` times its source's size, and the excess is shared again by weight. With
    sources sorted by how soon they fill up, those before the first that doesn't are full, so running
    sums settle it at once. The windows run over one row per source, after a partial aggregation.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(turns, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("full", F.lit(cap) * F.col("source_size"))
    fills = Window.orderBy((F.col("full") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(fills.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("k", F.row_number().over(fills))
    per = per.withColumn("stop", F.min(F.when(F.col("full") > F.col("level") * F.col("w"), F.struct("k", "level"))).over(whole)["level"])
    target = F.when(F.col("stop").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("stop") * F.col("w")))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def mixing_plan(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", sized: DataFrame | None = None) -> DataFrame:
    """Every row of docs (source, and text or a size column if `sized` says so) with size, source_size,
    target, rate, copies and taken.

    rate = target / source_size; a row is taken floor(rate) times and once more if its draw, which
    seed and key alone decide, is under the fraction: reruns agree, repeated rows with one key agree. Where the
    key is null, the text decides in its place (without a text column, all such rows draw alike).
    A null or empty text has size 0 and takes 0 words. A null source is a source; a source of size 0
    has target and rate 0. An empty table gives no rows. Input columns named like an added one give
    way. The hot source is never shuffled on: sources are pre-aggregated and joined back by broadcast
    while there are at most BROADCAST_SOURCES of them.
    """
    rows = without(docs, *ADDED).withColumn("size", words(text_or_empty())) if sized is None else docs
    targets = source_targets(rows.select("source", "size") if sized is None else sized.select("source", "size"), weights, share, cap)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = rows.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    nameless = F.concat(F.lit("null:"), F.md5(text_or_empty())) if "text" in docs.columns else F.lit("null")
    copies = F.floor("rate").cast("int") + F.when(draw(F.coalesce(F.col(key).cast("string"), nameless), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("rate", rate).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, whatever their names, each row as many times as its plan says."""
    key = options.get("key", "doc_id")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plan = mixing_plan(docs.select(key, "source", "text", whole.alias("_row")), **options).where("copies > 0")
    return plan.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS draw_key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + CAST((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 AS INT)] AS w, 2.0::DOUBLE * source_size AS full_size FROM p),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY full_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(w) OVER (ORDER BY full_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
s AS (SELECT (SELECT level FROM l WHERE full_size > level * w ORDER BY full_size / w, source NULLS LAST LIMIT 1) AS stop),
t AS (SELECT source, source_size, CASE WHEN stop IS NULL THEN full_size ELSE least(full_size, stop * w) END AS target FROM l, s),
r AS (SELECT d.doc_id, d.size, d.draw_key, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || draw_key), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
