"""Reports of other scans as tables (SRC-12, SRC-21): nested metadata is kept as VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import basename, slug
from graphloom.storage import Store

REPO = "id string, name string, root string, role string, stack array<string>"
#: The parts of a report that are read. What it lacks is null, what it has beside them is passed over.
REPORT = (
    f"project struct<name string, stack array<string>, root string, repos array<struct<{REPO}>>>, "
    "nodes array<struct<id string, kind string, name string, loc struct<file string, line int>, meta variant>>, "
    "edges array<struct<id string, `from` string, `to` string, kind string, confidence string, meta variant>>, "
    "issues array<struct<kind string, severity string, message string, nodes array<string>, candidate boolean, meta variant>>"
)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-12: nodes, edges and issues of a report, with `ord`, their place in it, and its repos.

    The document is one JSON value, so one task reads it, in the JVM; its rows are dealt out from there. A file that is no
    report raises. Without repositories, the project is one: its id is the slug of its root's last folder, else
    `repo`, and its role follows from its stack.
    """
    whole = spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = lambda part: whole.select(F.posexplode(part).alias("ord", "x")).select(F.col("ord").cast("long").alias("ord"), "x.*")
    nodes = rows("nodes").select("id", "kind", "name", "loc.file", "loc.line", "meta", "ord")
    edges = rows("edges").select("id", F.col("from").alias("src"), F.col("to").alias("dst"), "kind", "confidence", "meta", "ord")
    issues = rows("issues").select("kind", "severity", "message", "nodes", "candidate", "meta", "ord")
    has = lambda *names: F.exists(F.coalesce("project.stack", F.array().cast("array<string>")), lambda s: s.isin(*names))
    role = F.when(has("next.js", "react"), "frontend").when(has("django"), "backend").otherwise("other")
    at = F.regexp_replace(F.coalesce("project.root", F.lit("")), "/+$", "")
    own = F.coalesce(F.nullif(slug(basename(at)), F.lit("")), F.lit("repo"))
    alone = F.array(F.struct(own.alias("id"), F.initcap(F.replace(own, F.lit("-"), F.lit(" "))).alias("name"), F.col("project.root").alias("root"), role.alias("role"), F.col("project.stack").alias("stack")))
    held = F.when(F.size("project.repos") > 0, F.col("project.repos")).otherwise(alone)
    repos = whole.select(F.inline(held)).withColumn("id", F.coalesce(F.nullif(slug(F.col("id")), F.lit("")), F.lit("repo")))
    name = whole.select(F.coalesce(F.nullif("project.name", F.lit("")), F.lit("Imported report")).alias("name"), "project.stack")
    return {"nodes": nodes, "edges": edges, "issues": issues, "repos": repos, "project": name}


def imported(store: Store, path: str, project: str, finished_at: str | None = None) -> str:
    """SRC-21: a report as the newest scan of a project in a store; the scan's id. It is read whole before anything of it shows."""
    return store.commit(read(store.spark, path), project, finished_at=finished_at)
