"""OpenAPI and compose documents (SRC-10, SRC-11, FN-30): parsed once per file, then plain columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import norm_path

try:
    import yaml
except ImportError:  # JSON documents still work
    yaml = None

#: Methods of an OpenAPI path item.
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def parse(text: str):
    try:
        return json.loads(text)
    except ValueError:
        pass
    if yaml is None:
        return None
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None


OPERATION = "array<struct<path: string, method: string, operation: string, summary: string>>"
SERVICE = "array<struct<name: string, needs: array<string>>>"


def _operations(texts: pd.Series) -> pd.Series:
    def one(text):
        doc = parse(text) if text else None
        paths = doc.get("paths") if isinstance(doc, dict) else None
        out = []
        for path, item in (paths or {}).items() if isinstance(paths, dict) else ():
            for method, operation in item.items() if isinstance(item, dict) else ():
                if str(method).lower() in METHODS:
                    told = operation if isinstance(operation, dict) else {}
                    out.append({"path": str(path), "method": str(method).upper()} | {k: told.get(name) if isinstance(told.get(name), str) else None for k, name in (("operation", "operationId"), ("summary", "summary"))})
        return out

    return texts.map(one)


def _services(texts: pd.Series) -> pd.Series:
    def one(text):
        doc = parse(text) if text else None
        services = doc.get("services") if isinstance(doc, dict) else None
        out = []
        for name, body in (services or {}).items() if isinstance(services, dict) else ():
            needs = body.get("depends_on") if isinstance(body, dict) else None
            out.append({"name": str(name), "needs": [str(x) for x in (needs or [])]})
        return out

    return texts.map(one)


def openapi(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(endpoint nodes, routes) of (path, content)."""
    rows = files.select(F.col("path").alias("file"), F.posexplode(F.pandas_udf(_operations, OPERATION)("content")).alias("n", "o")).withColumn("p", norm_path(F.col("o.path")))
    node = F.concat(F.lit("APIEndpoint:"), "o.method", F.lit(" "), "p")
    meta = F.map_filter(F.create_map(F.lit("method"), F.col("o.method"), F.lit("path"), F.col("p"), F.lit("source"), F.lit("openapi"), F.lit("operationId"), F.col("o.operation"), F.lit("summary"), F.col("o.summary")), lambda k, v: v.isNotNull())
    nodes = rows.select(node.alias("id"), F.lit("APIEndpoint").alias("kind"), F.concat("o.method", F.lit(" "), "p").alias("name"), "file", meta.alias("meta"), F.col("n").cast("long").alias("ord"))
    routes = rows.select(F.col("n").cast("long").alias("route_ord"), F.col("o.method").alias("method"), F.col("p").alias("path"), node.alias("endpoint_id"))
    return nodes, routes


def compose(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(service nodes, DEPENDS_ON edges); an edge needs its target in the same file (JOIN-33)."""
    rows = files.select(F.col("path").alias("file"), F.posexplode(F.pandas_udf(_services, SERVICE)("content")).alias("n", "s"))
    node = lambda name: F.concat(F.lit("DockerService:"), "file", F.lit("#"), name)
    nodes = rows.select(node(F.col("s.name")).alias("id"), F.lit("DockerService").alias("kind"), F.col("s.name").alias("name"), "file", F.lit(None).cast("map<string,string>").alias("meta"), F.col("n").cast("long").alias("ord"))
    ends = rows.select("file", F.col("s.name").alias("name"), F.explode("s.needs").alias("need"))
    there = rows.select("file", F.col("s.name").alias("need")).distinct()
    edges = ends.join(there, ["file", "need"], "left_semi").select(node(F.col("name")).alias("src"), node(F.col("need")).alias("dst"), F.lit("DEPENDS_ON").alias("kind"))
    return nodes, edges
