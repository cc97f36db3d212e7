"""The cross-stack linker (JOIN-01..03, WIN-02): calls meet routes by equality keys, never by nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import clean_path, edge_id, is_param, segments
from graphloom.operators.graph import Steps

#: Up to this many masks are broadcast.
MOST_MASKS = 100_000


def _mask(seg: Column) -> Column:
    """Which segments are parameters, as zeros and ones."""
    return F.array_join(F.transform(seg, lambda s: F.when(is_param(s), "1").otherwise("0")), "")


def _masked(seg: Column, call: Column, route: Column) -> Column:
    """The segments under the masks of a call and a route: what is a parameter on either side is left open."""
    open_ = lambda mask, i: F.substr(mask, i + 1, F.lit(1)) == "1"
    shown = F.transform(seg, lambda s, i: F.when(open_(call, i) | open_(route, i), F.lit("{}")).otherwise(s))
    return F.concat(call, F.lit("|"), route, F.lit("|"), F.array_join(shown, "/"))


def _tails(seg: Column) -> Column:
    """All endings of a path, the whole one and none included."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(seg)), lambda i: F.array_join(F.slice(seg, i + 1, F.greatest(F.size(seg) - i, F.lit(0))), "/")))


def candidates(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(method, full_url, dynamic, rank, route) of distinct calls: the first route that fits in each way.

    High is an equality of clean paths. Medium compares segments one by one, and parameters on either side fit
    anything: with the masks of parameters that occur, calls offer their segments under each mask of a route of their
    length, routes under each mask of a call, and both meet by equality. Low is an equality of a whole path and an ending.
    Only the earliest route of a key can win, so routes are cut to one per key first: a call has at most one candidate
    per pair of masks and per ending, however many routes share its shape. Distinct calls and routes are written down, as
    each way reads them again.
    """
    kept = Steps(calls.sparkSession, "link")
    c = calls.select("method", "full_url", "dynamic").distinct().withColumn("clean", clean_path(F.col("full_url"))).withColumn("seg", segments(F.col("full_url"))).withColumn("mask", _mask(F.col("seg")))
    c = kept.put(c, "calls")
    route = F.struct("route_ord", "endpoint_id", F.col("response_fields").alias("route_fields"))
    r = routes.select("method", route.alias("route"), clean_path(F.col("path")).alias("clean"), segments(F.col("path")).alias("seg")).withColumn("mask", _mask(F.col("seg")))
    r = kept.put(r, "routes")
    first = lambda rows, key: rows.groupBy("method", key.alias("key")).agg(F.min_by("route", "route.route_ord").alias("route"))
    masks = lambda rows, name: rows.select("method", F.length("mask").alias("n"), F.col("mask").alias(name)).distinct()
    small = lambda rows: F.broadcast(rows) if rows.limit(MOST_MASKS + 1).count() <= MOST_MASKS else rows
    meet = lambda rows, key, routes, rank: rows.withColumn("key", key).join(routes, ["method", "key"]).select("method", "full_url", "dynamic", F.lit(rank).alias("rank"), "route")
    high = meet(c.where(~F.col("dynamic")), F.col("clean"), first(r, F.col("clean")), 3)
    called = c.withColumn("n", F.length("mask")).join(small(masks(r, "other")), ["method", "n"])
    routed = r.withColumn("n", F.length("mask")).join(small(masks(c, "other")), ["method", "n"])
    medium = meet(called, _masked(F.col("seg"), F.col("mask"), F.col("other")), first(routed, _masked(F.col("seg"), F.col("other"), F.col("mask"))), 2)
    whole = F.array_join("seg", "/")
    by_call = meet(c, whole, first(r.withColumn("tail", F.explode(_tails(F.col("seg")))), F.col("tail")), 1)
    by_route = meet(c.withColumn("tail", F.explode(_tails(F.col("seg")))), F.col("tail"), first(r, whole), 1)
    return high.unionByName(medium).unionByName(by_call).unionByName(by_route)


def link(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls with route_ord, endpoint_id, route_fields and confidence of their best route; nulls without one.

    A route of the call's method matches high if the clean paths are equal and the call is static,
    medium if the segments agree one by one (parameters agree with anything), low if one path ends
    with the other's segments. The earliest route of the best rank wins; equal calls are judged once.
    """
    best = candidates(calls, routes).groupBy("method", "full_url", "dynamic").agg(F.max_by(F.struct("rank", "route"), F.struct("rank", -F.col("route.route_ord"))).alias("b"))
    best = best.select(F.col("method").alias("_m"), F.col("full_url").alias("_u"), F.col("dynamic").alias("_d"), "b.route.*", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("b.rank")).alias("confidence"))
    return calls.join(best, (F.col("method") == F.col("_m")) & (F.col("full_url") == F.col("_u")) & (F.col("dynamic") == F.col("_d")), "left").drop("_m", "_u", "_d")


def call_edges(linked: DataFrame) -> DataFrame:
    """CALLS edges (caller to endpoint), one per pair; the first call's confidence stays (T-8)."""
    rows = linked.where("endpoint_id is not null and caller_id is not null")
    best = rows.groupBy("caller_id", "endpoint_id").agg(F.min_by(F.struct("confidence", "full_url", "method"), "call_ord").alias("c"))
    return best.select(edge_id(F.lit("CALLS"), F.col("caller_id"), F.col("endpoint_id")).alias("id"), F.col("caller_id").alias("src"), F.col("endpoint_id").alias("dst"), F.lit("CALLS").alias("kind"), "c.confidence", F.create_map(F.lit("url"), F.col("c.full_url"), F.lit("method"), F.col("c.method")).alias("meta"))


def field_edges(linked: DataFrame) -> DataFrame:
    """JOIN-02: USES edges from callers to the response fields they read, names compared without case."""
    rows = linked.where("endpoint_id is not null and caller_id is not null").withColumn("use", F.explode("response_fields")).withColumn("own", F.explode("route_fields"))
    rows = rows.where(F.lower("use.field") == F.lower("own.name"))
    best = rows.groupBy("caller_id", F.col("own.id").alias("field_id")).agg(F.min_by(F.struct(F.col("use.confidence").alias("confidence"), F.col("own.name").alias("field")), F.struct("call_ord", "use.line")).alias("f"))
    return best.select(edge_id(F.lit("USES"), F.col("caller_id"), F.col("field_id")).alias("id"), F.col("caller_id").alias("src"), F.col("field_id").alias("dst"), F.lit("USES").alias("kind"), "f.confidence", F.create_map(F.lit("field"), F.col("f.field"), F.lit("source"), F.lit("response-field")).alias("meta"))


def dangling_issues(linked: DataFrame) -> DataFrame:
    """JOIN-03, RUL-07: calls to paths of this project that no route takes."""
    rows = linked.where("endpoint_id is null and caller_id is not null").where(F.col("full_url").startswith("/"))
    return rows.select(F.lit("DANGLING_API_CALL").alias("kind"), F.lit("info").alias("severity"), F.concat(F.lit('Call "'), "method", F.lit(" "), "full_url", F.lit('" matches no known backend route')).alias("message"), F.array("caller_id").alias("nodes"), F.lit(True).alias("candidate"), F.create_map(F.lit("url"), F.col("full_url"), F.lit("method"), F.col("method")).alias("meta"), F.col("call_ord").alias("ord"))
