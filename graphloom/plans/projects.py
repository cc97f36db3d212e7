"""Several repositories as one project (PRJ-03, SET-08, AGG-27): one graph over all of them, linked across.

Repositories are scanned and parsed by one plan each for scripts and Python, keyed by repository. Names are bound within
a repository (a component or model of that name elsewhere is another), so fragments are assembled one by one;
their ids are then put under the repository's slug in one pass, and calls meet the routes of all repositories.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import edge_id
from graphloom.operators import graph, views
from graphloom.operators.rules import Config
from graphloom.plans import analyze as A
from graphloom.plans.analyzers import Analyzer
from graphloom.sources import files as file_source
from graphloom.sources import python_facts, ts_facts
from graphloom.sources.cache import FactsCache
from graphloom.sources.ts_facts import SIZE_GUARD


@dataclass(frozen=True)
class Repo:
    """A repository of a project; `root` is any path that Spark reads."""

    id: str
    root: str = ""
    name: str = ""
    role: str = "other"

    @property
    def slug(self) -> str:
        return file_source.slug_of(self.id)


def checked(repos: Sequence[Repo]) -> Sequence[Repo]:
    """SET-08: raises without repositories and for ids whose slugs are empty or taken."""
    if not repos:
        raise ValueError("a project needs at least one repository")
    slugs = [r.slug for r in repos]
    for i, (repo, own) in enumerate(zip(repos, slugs, strict=True)):
        if not own:
            raise ValueError(f"invalid repository id: {repo.id}")
        if own in slugs[:i]:
            raise ValueError(f"duplicate repository id: {repo.id}")
    return repos


def under(repo: Column, path: Column) -> Column:
    """A path below its repository's slug."""
    return F.regexp_replace(F.concat(repo, F.lit("/"), path), "/{2,}", "/")


def under_id(repo: Column, id_: Column) -> Column:
    """An id whose part after the kind is below the slug."""
    at = F.instr(id_, ":")
    return F.when(at == 0, under(repo, id_)).otherwise(F.concat(F.substr(id_, F.lit(1), at), under(repo, F.substr(id_, at + 1))))


def rekeyed(part: A.Fragment, repo: Column, order: Column) -> A.Fragment:
    """PRJ-03: a fragment's ids, files and File names below the slug; edge ids follow. Other names and the paths of
    endpoints stay. Routes of earlier repositories come first in `order`."""
    i = lambda c: under_id(repo, F.col(c)).alias(c)
    f = under(repo, F.col("file")).alias("file")
    name = F.when(F.col("kind") == "File", under(repo, F.col("name"))).otherwise(F.col("name")).alias("name")
    nodes, edges = part.nodes, part.edges
    if nodes is not None and edges is not None:
        nodes = nodes.select(i("id"), "kind", name, f, "line", "meta", "ord")
        ends = edges.select("kind", i("src"), i("dst"), "confidence", "meta", "ord")
        edges = ends.select(edge_id(F.col("kind"), F.col("src"), F.col("dst")).alias("id"), "src", "dst", "kind", "confidence", "meta", "ord")
    calls = part.calls.withColumns({"call_ord": F.xxhash64(repo, "call_ord"), "file": under(repo, F.col("file")), "caller_id": under_id(repo, F.col("caller_id"))})
    place = F.shiftleft(order.cast("long"), 48) + F.pmod(F.col("route_ord"), F.lit(1 << 48))
    routes = part.routes.withColumns({"endpoint_id": under_id(repo, F.col("endpoint_id")), "route_ord": place})
    held = F.transform("response_fields", lambda x: F.struct(under_id(repo, x["id"]).alias("id"), x["name"].alias("name")))
    return A.Fragment(nodes, edges, calls, routes.withColumn("response_fields", held))


def fragments(spark: SparkSession, files: DataFrame, repos: Sequence[Repo], cache: FactsCache | None = None, graph_too: bool = True, analyzers: Sequence[Analyzer] = ()) -> A.Fragment:
    """The fragments of all repositories under their slugs, as one: files (repo: its slug, path, content, category, scan_ord).

    Every repository's fragment is written apart, so the plan of what follows does not grow with their number.
    """
    kept = graph.Steps(spark, "project")
    keyed = files.withColumn("path", F.concat("repo", F.lit("/"), "path"))
    script, python = (kept.put(A.facts(source, keyed, cache), name) for source, name in ((ts_facts, "ts"), (python_facts, "py")))
    parts: dict[str, list[DataFrame]] = {"nodes": [], "edges": [], "calls": [], "routes": []}
    for n, repo in enumerate(repos):
        own = lambda rows: rows.where(F.col("file").startswith(repo.slug + "/")).withColumn("file", F.substr(F.col("file"), F.lit(len(repo.slug) + 2)))  # noqa: E731, B023
        mine = files.where(F.col("repo") == repo.slug)
        part = A.extended(A.fragment(mine, own(script), own(python), graph_too), mine, analyzers)
        part = rekeyed(part, F.lit(repo.slug), F.lit(n))
        for name, rows in parts.items():
            if getattr(part, name) is not None:
                rows.append(kept.put(getattr(part, name), f"{name}-{n}"))
    whole: dict[str, DataFrame | None] = {"nodes": None, "edges": None}
    for name, rows in parts.items():
        if not rows:
            continue
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        whole[name] = out
    return A.Fragment(**whole)


def analyze_repos(spark: SparkSession, repos: Sequence[Repo], config: Config | None = None, commits: dict[str, DataFrame] | None = None, reports: dict[str, DataFrame] | None = None, cache: FactsCache | None = None, openapi: DataFrame | None = None, analyzers: Sequence[Analyzer] = (), told: Callable[[str, float, int], None] | None = None) -> A.Analysis:
    """Scans the repositories of a project and joins them to one graph, as `analyze` does with one.

    `commits` and `reports` are git logs and coverage by repository id; coverage is matched within its repository. `openapi`
    holds documents (path, content) whose endpoints stand beside all repositories and lose ties.
    """
    checked(repos)
    kept = graph.Steps(spark, "repos", told)
    scanned = None
    for repo in repos:
        one = file_source.scan(spark, repo.root).withColumn("repo", F.lit(repo.slug))
        scanned = one if scanned is None else scanned.unionByName(one)
    files = kept.put(scanned, "files")
    part = fragments(spark, files, repos, cache, analyzers=analyzers)
    graphed = file_source.numbered(files.drop("scan_ord").withColumn("path", under(F.col("repo"), F.col("path"))))
    union = lambda found, schema: _union(spark, {r.slug: found[r.id] for r in repos if r.id in found}, schema)
    churned = union(commits or {}, "commit_id string, commit_ord long, author string, ts string, file string")
    churned = churned.withColumn("file", under(F.col("repo"), F.col("file"))).withColumn("commit_id", F.concat("repo", F.lit("/"), "commit_id")).drop("repo")
    out = A.finish(spark, graphed, part, config or Config(), churned, union(reports or {}, "report string, content string"), files.select("repo", F.col("path"), "scan_ord"), openapi, told)
    stacks = None
    for repo in repos:
        one = file_source.stack(files.where(F.col("repo") == repo.slug)).withColumn("repo", F.lit(repo.slug))
        stacks = one if stacks is None else stacks.unionByName(one)
    out.extra |= {"stack": views.merged_stack(stacks), "stacks": stacks}
    return out


def _union(spark: SparkSession, found: dict[str, DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema + ", repo string")
    for slug, rows in found.items():
        out = out.unionByName(rows.withColumn("repo", F.lit(slug)))
    return out
