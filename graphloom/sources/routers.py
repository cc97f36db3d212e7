"""Routers, their mounts and routes as a graph, whatever the framework (JOIN-12, JOIN-13, JOIN-35, GRF-08, GRF-09)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import edge_id, join_path
from graphloom.operators.graph import Steps


@dataclass
class RouterMap:
    """What the files of one framework say.

    services: applications and routers (file, name, framework, type, exported, line, ord), `exported` null where a
    language has none. mounts: a router below another (file, name, parent_file, parent). routes: (file, name: of the
    router; at: the file that registers; framework, method, path: below all prefixes; handlers: names in `at`; shows: the
    model that answers are told to have, or null; line, ord); the method of middleware is USE.
    """

    services: DataFrame
    mounts: DataFrame
    routes: DataFrame


def prefixes(seeds: DataFrame, mounts: DataFrame) -> DataFrame:
    """(file, name, prefix): seeds (file, name, prefix) and every router below them by mounts (parent_file, parent,
    file, name, path), to any depth; a router that would mount itself again ends its path."""
    steps, spot = Steps(seeds.sparkSession, "prefixes"), F.concat("file", F.lit("#"), "name")
    mounts = steps.put(mounts.distinct(), "mounts")
    level = steps.put(seeds.select("file", "name", "prefix", F.array(spot).alias("seen")).distinct(), "0")
    every = level.drop("seen")
    for k in count(1):
        above = level.select(F.col("file").alias("parent_file"), F.col("name").alias("parent"), "prefix", "seen")
        met = above.join(mounts, ["parent_file", "parent"]).where(~F.array_contains("seen", spot))
        level = steps.put(met.select("file", "name", join_path(F.col("prefix"), F.col("path")).alias("prefix"), F.concat("seen", F.array(spot)).alias("seen")).distinct(), str(k))
        if level.isEmpty():
            break
        every = every.unionByName(level.drop("seen"))
    return every.distinct()


def _meta(**values: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def _edge(kind: str, src: Column, dst: Column) -> list[Column]:
    return [edge_id(F.lit(kind), src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind")]


def route_graph(found: RouterMap, declared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JOIN-35: nodes, edges and linker routes of a map and the declarations (file, name, id) that may be handlers.

    Routers are Service nodes, each REGISTERED_IN those that mount it. A route below one prefix is a Route node,
    REGISTERED_IN its router, that EXPOSES its endpoint and USES the handlers declared where it is registered.
    Middleware is a Route without an endpoint, and is left out where none of its handlers is declared.
    """
    text = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    service = F.concat(F.lit("Service:"), "file", F.lit("#"), "name")
    called, aside = F.concat("method", F.lit(" "), "path"), F.col("method") == "USE"
    route, endpoint = F.concat(F.lit("Route:"), "file", F.lit("#"), called), F.concat(F.lit("APIEndpoint:"), called)
    boxes = found.services.select(service.alias("id"), F.lit("Service").alias("kind"), "name", "file", "line", _meta(framework=F.col("framework"), type=F.col("type"), exported=text("exported")).alias("meta"), "ord")
    handled = found.routes.withColumn("handler", F.explode("handlers")).join(declared.select(F.col("file").alias("at"), F.col("name").alias("handler"), F.col("id").alias("handler_id")), ["at", "handler"])
    uses = handled.select(*_edge("USES", route, F.col("handler_id")))
    ends = found.routes.where(~aside)
    kept = ends.unionByName(handled.where(aside).select(*ends.columns))
    meta = _meta(framework=F.col("framework"), method=F.col("method"), path=F.col("path"), router=F.when(~aside & (F.col("framework") == "express"), F.col("name")), middleware=F.when(aside, "true"))
    nodes = kept.select(route.alias("id"), F.lit("Route").alias("kind"), called.alias("name"), "file", "line", meta.alias("meta"), "ord")
    points = ends.select(endpoint.alias("id"), F.lit("APIEndpoint").alias("kind"), called.alias("name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), _meta(method=F.col("method"), path=F.col("path"), source=F.col("framework")).alias("meta"), "ord")
    parent = F.concat(F.lit("Service:"), "parent_file", F.lit("#"), "parent")
    edges = found.mounts.select(*_edge("REGISTERED_IN", service, parent)).unionByName(kept.select(*_edge("REGISTERED_IN", route, service)))
    edges = edges.unionByName(ends.select(*_edge("EXPOSES", route, endpoint))).unionByName(uses).distinct()
    return boxes.unionByName(nodes).unionByName(points), edges, ends.select("method", "path", endpoint.alias("endpoint_id"), "shows").distinct()
