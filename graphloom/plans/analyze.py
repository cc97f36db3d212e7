"""From a repository to its graph, findings and score: one lazy plan per table (UDX-01, UDX-04, RUL-01)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import edge_id
from graphloom.operators import graph, insights, linker, rules
from graphloom.operators.rules import Config
from graphloom.plans.analyzers import Analyzer, results
from graphloom.schema import SECRET_SCAN_CHARS
from graphloom.sources import coverage as coverage_source
from graphloom.sources import files as file_source
from graphloom.sources import python_facts, services, ts_facts
from graphloom.sources.cache import FactsCache
from graphloom.sources.routers import route_graph
from graphloom.sources.ts_facts import SIZE_GUARD

NODE_COLUMNS = ("id", "kind", "name", "file", "line", "meta", "ord")
EDGE_COLUMNS = ("id", "src", "dst", "kind", "confidence", "meta", "ord")


@dataclass
class Analysis:
    """The tables of one scan."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame
    health: DataFrame
    hotspots: DataFrame
    secrets: DataFrame
    calls: DataFrame
    routes: DataFrame
    extra: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {"files": self.files, "nodes": self.nodes, "edges": self.edges, "issues": self.issues, "health": self.health, "hotspots": self.hotspots, "secrets": self.secrets, "coverage": self.extra["coverage"]}


def _fill(df: DataFrame, columns: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kinds.get(c, "string")))
    return df.select(*columns)


def _nodes(df: DataFrame) -> DataFrame:
    return _fill(df, NODE_COLUMNS, {"line": "int", "meta": "map<string,string>", "ord": "long"})


def _edges(df: DataFrame) -> DataFrame:
    return _fill(df, EDGE_COLUMNS, {"meta": "map<string,string>", "ord": "long"}).withColumn("ord", F.coalesce("ord", F.xxhash64("id")))


def endpoints(routes: DataFrame, shown: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Routes (method, path, handler, file, and owner, the handler's kind) as endpoint nodes, EXPOSES edges and
    linker routes; shown: (handler, response_fields)."""
    node = F.concat(F.lit("APIEndpoint:"), "method", F.lit(" "), "path")
    nodes = routes.select(node.alias("id"), F.lit("APIEndpoint").alias("kind"), F.concat("method", F.lit(" "), "path").alias("name"), F.create_map(F.lit("method"), F.col("method"), F.lit("path"), F.col("path")).alias("meta"), F.xxhash64("method", "path").alias("ord"))
    handler = F.concat(F.col("owner"), F.lit(":"), "file", F.lit("#"), "handler")
    edges = routes.select(edge_id(F.lit("EXPOSES"), handler, node).alias("id"), handler.alias("src"), node.alias("dst"), F.lit("EXPOSES").alias("kind"))
    none = F.array().cast("array<struct<id:string,name:string>>")
    fields = none if shown is None else F.coalesce("response_fields", none)
    rows = (routes if shown is None else routes.join(shown, "handler", "left")).select(F.xxhash64("method", "path").alias("route_ord"), "method", "path", node.alias("endpoint_id"), fields.alias("response_fields"))
    return nodes, edges, rows


@dataclass
class Fragment:
    """What the files of one repository say, before calls meet routes; parts that nobody asked for are None."""

    nodes: DataFrame | None
    edges: DataFrame | None
    calls: DataFrame
    routes: DataFrame


def facts(source, files: DataFrame, cache: FactsCache | None = None) -> DataFrame:
    """The facts of `ts_facts` or `python_facts`; with a cache, only of files that it does not know yet. Files over
    the size guard have none (EXT-28)."""
    if cache is None:
        return source.found(files, SIZE_GUARD)
    held = cache.facts(source.wanted(files).select("path", "content"), source.__name__.rpartition(".")[2], source.facts_column(most=SIZE_GUARD))
    return source.rows(held)


def _routes(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<id:string,name:string>>")
    rows = rows.withColumn("response_fields", F.coalesce("response_fields", none) if "response_fields" in rows.columns else none)
    rows = rows if "route_ord" in rows.columns else rows.withColumn("route_ord", F.xxhash64("method", "path"))
    return rows.select("route_ord", "method", "path", "endpoint_id", "response_fields")


def fragment(files: DataFrame, script: DataFrame, python: DataFrame, graph_too: bool = True) -> Fragment:
    """The fragment of one repository's files (path, content, category, scan_ord) and their facts; calls and routes alone
    unless `graph_too`."""
    documents = files.where(F.lower("path").rlike(r"(openapi|swagger)[^/]*\.(ya?ml|json)$"))
    stacks = files.where(F.col("category") == "docker").where(F.lower("path").rlike(r"ya?ml$"))
    api_nodes, api_routes = services.openapi(documents)
    box_nodes, box_edges = services.compose(stacks)
    modules = ts_facts.Modules(file_source.path_aliases(files), file_source.workspace_packages(files))
    end_nodes, end_edges, routes = endpoints(python_facts.drf_routes(python, files).withColumn("owner", F.lit("ViewSet")), python_facts.view_fields(python))
    js_nodes, js_edges, js_routes = route_graph(ts_facts.express_map(script, files, modules), ts_facts.symbols(script).select("file", "name", "id"))
    py_nodes, py_edges, py_routes = route_graph(python_facts.http_map(python), python_facts.functions(python))
    nest_nodes, nest_edges, nest_routes = ts_facts.nest_graph(script)
    routes = _routes(routes)
    for more in (js_routes, py_routes.join(python_facts.answer_fields(python), "shows", "left"), nest_routes, api_routes):
        routes = routes.unionByName(_routes(more))
    if not graph_too:
        return Fragment(None, None, ts_facts.api_calls(script), routes)
    page_nodes, page_edges = ts_facts.page_routes(script)
    own = lambda fact, kind: python.where(F.col("fact") == fact).select(F.concat(F.lit(kind + ":"), "file", F.lit("#"), "name").alias("id"), F.lit(kind).alias("kind"), "name", "file", "line", "ord")
    fields = python.where("fact = 'field'").select(F.concat(F.lit("Field:"), "file", F.lit("#"), F.col("owner"), F.lit("#"), "name").alias("id"), F.lit("Field").alias("kind"), "name", "file", "line", "ord")
    parts = [file_source.file_nodes(files), ts_facts.symbols(script), ts_facts.type_symbols(script), own("function", "Function"), own("model", "Model"), own("serializer", "Serializer"), own("view", "ViewSet"), own("celery_task", "CeleryTask"), own("manager", "Manager"), python_facts.signal_nodes(python), fields, page_nodes, nest_nodes, js_nodes, py_nodes, end_nodes, api_nodes, box_nodes]
    edge_parts = [ts_facts.import_edges(script, files, modules), ts_facts.usage_edges(script, files, modules), python_facts.import_edges(python, files), graph.with_edge_ids(python_facts.model_edges(python)), graph.with_edge_ids(python_facts.use_edges(python)), python_facts.call_edges(python), end_edges, page_edges, nest_edges, js_edges, py_edges, graph.with_edge_ids(box_edges)]
    return Fragment(graph.union_fragments(*[_nodes(p) for p in parts]), graph.union_fragments(*[_edges(p) for p in edge_parts]), ts_facts.api_calls(script), routes)


def extended(part: Fragment, files: DataFrame, analyzers: Sequence[Analyzer]) -> Fragment:
    """SET-02: a fragment and, after it, what the analyzers that find files add; the first node and edge of an
    id stays, routes keep the order numbers that they bring. The tables that the fragment lacks are left out."""
    nodes, edges, calls, routes = [part.nodes], [part.edges], part.calls, part.routes
    for more in results(files, analyzers):
        nodes += [] if more.nodes is None else [_nodes(more.nodes)]
        edges += [] if more.edges is None else [_edges(more.edges)]
        calls = calls if more.calls is None else calls.unionByName(more.calls)
        routes = routes if more.routes is None else routes.unionByName(_routes(more.routes))
    whole = lambda found: found[0] if found[0] is None or len(found) == 1 else graph.union_fragments(*found)
    return Fragment(whole(nodes), whole(edges), calls, routes)


def finish(spark: SparkSession, files: DataFrame, part: Fragment, config: Config, commits: DataFrame, reports: DataFrame, covered_files: DataFrame | None = None, openapi: DataFrame | None = None, told: Callable[[str, float, int], None] | None = None) -> Analysis:
    """Links calls to routes, runs insights and rules, filters ignored paths and scores.

    `covered_files` are the files that coverage reports can name: (path, scan_ord), and repo where `reports`
    have one; the graph's own otherwise. `openapi` are documents (path, content) from elsewhere.
    """
    kept = graph.Steps(spark, "analysis", told)
    part = Fragment(*[kept.put(getattr(part, x), f"part-{x}") for x in ("nodes", "edges", "calls", "routes")])
    routes, nodes = part.routes, [part.nodes]
    if openapi is not None:
        more_nodes, more_routes = services.openapi(openapi)
        later = F.lit(1 << 61) + F.col("route_ord")
        routes, nodes = routes.unionByName(_routes(more_routes.withColumn("route_ord", later))), [*nodes, _nodes(more_nodes)]
    linked = kept.put(linker.link(part.calls, routes), "linked")
    nodes = kept.put(graph.union_fragments(*nodes), "nodes")
    edges = kept.put(graph.union_fragments(part.edges, _edges(linker.call_edges(linked)), _edges(linker.field_edges(linked))), "edges")
    churned = kept.put(insights.churn(commits, None).join(files.select(F.col("path").alias("file")), "file", "left_semi"), "churn")
    by = ["repo"] if "repo" in reports.columns else []
    rows = coverage_source.read_any(reports, by)
    matched = insights.match_coverage(rows, files.select("path", "scan_ord") if covered_files is None else covered_files, by)
    placed = F.concat("repo", F.lit("/"), "path") if by else F.col("path")
    covered = kept.put(insights.coverage(matched.select(placed.alias("file"), "total", "covered")), "coverage")
    complexities = files.select(F.col("path").alias("file"), insights.complexity(F.col("content"), F.col("category")).alias("complexity"))
    hot = kept.put(insights.hotspots(nodes, edges, complexities, churned, covered), "hotspots")
    secrets = kept.put(insights.secrets(files.select(F.col("path").alias("file"), "content"), SECRET_SCAN_CHARS), "secrets")
    issues = rules.run_rules(nodes, edges, files.select(F.col("path").alias("file"), "lines"), config).drop("rule_ord")
    for more in (linker.dangling_issues(linked).drop("ord"), rules.secret_issues(secrets), rules.hotspot_issues(hot)):
        issues = issues.unionByName(more)
    issues = kept.put(issues.withColumn("issue_id", F.xxhash64("kind", "message", "nodes")), "issues")
    issues = rules.filter_ignored(issues, nodes, edges, config.ignore_paths)
    enriched = insights.enrich(nodes, churned, covered, hot)
    return Analysis(files, enriched, edges, issues, rules.health(issues), hot, secrets, part.calls, routes, {"coverage": covered, "churn": churned, "explanations": insights.explanations(hot, secrets, covered)})


def analyze(spark: SparkSession, root: str, config: Config | None = None, commits: DataFrame | None = None, reports: DataFrame | None = None, gitignore: Sequence[str] = (), cache: FactsCache | None = None, openapi: DataFrame | None = None, analyzers: Sequence[Analyzer] = (), told: Callable[[str, float, int], None] | None = None) -> Analysis:
    """Scans root (any path that Spark reads), extracts facts, builds the graph, links calls to routes, runs
    the rules, filters ignored paths and scores. `commits` is a git log, `reports` coverage (report, content), `openapi`
    documents (path, content) from elsewhere; with a `cache`, only changed files are parsed. `analyzers` add to what is built
    in; `told` (say, `phases.Phases`) hears of every phase."""
    kept = graph.Steps(spark, "scan", told)
    files = kept.put(file_source.scan(spark, root, gitignore), "files")
    script, python = (kept.put(facts(source, files, cache), name) for source, name in ((ts_facts, "ts"), (python_facts, "py")))
    commits = spark.createDataFrame([], "commit_id string, commit_ord long, author string, ts string, file string") if commits is None else commits
    reports = spark.createDataFrame([], "report string, content string") if reports is None else reports
    part = extended(fragment(files, script, python), files, analyzers)
    out = finish(spark, files, part, config or Config(), commits, reports, openapi=openapi, told=told)
    out.extra |= {"stack": file_source.stack(files), "entry": ts_facts.entry_point(files)}
    return out
