"""Projections of answers and snapshots (PRJ-13, PRJ-15, PRJ-16, PRJ-19, AGG-19, AGG-26..28, JOIN-26, JOIN-32, SRT-02, SRT-13, SET-08, SET-10, FN-24, FN-31, EXT-29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import round1, slug, tokens_estimate

#: Pieces of evidence by detail, kinds that a reader may pick, roles of a repository.
EVIDENCE = {"brief": 1, "standard": 2, "full": 5}
PICKABLE = ("Component", "Hook", "Page", "Function", "APIEndpoint", "ViewSet", "View", "Serializer", "Model", "Service", "Route", "CeleryTask", "Type")
ROLES = ("frontend", "backend", "shared", "infra")
#: What marks the line of a declaration.
OUTLINE = r"^\s*(export\s|(async\s+)?function\s|class\s|interface\s|type\s|enum\s|(async\s+)?def\s|const\s+\w+\s*=\s*(async\s*)?\(|@\w)"


def locale_order(x: Column) -> Column:
    """SRT-02: a sort key in the order of a reader's language rather than of code points."""
    return F.collate(x, "UNICODE")


def pickable(nodes: DataFrame) -> DataFrame:
    """PRJ-13: nodes that a reader may pick, with the label by which they are listed."""
    return nodes.where(F.col("kind").isin(*PICKABLE)).withColumn("label", F.concat_ws(" ", "kind", "name"))


def issue_refs(issues: DataFrame, nodes: DataFrame, detail: str = "standard") -> DataFrame:
    """PRJ-15, PRJ-16: (issue_id, kind, severity, message, confidence, evidence): candidates are of medium
    confidence; evidence are the first nodes of the issue, in its order, that exist."""
    at = issues.select("issue_id", F.posexplode("nodes").alias("n", "id"))
    shown = at.join(nodes.select("id", "file", "line"), "id").withColumn("_k", F.row_number().over(Window.partitionBy("issue_id").orderBy("n"))).where(F.col("_k") <= EVIDENCE[detail]).groupBy("issue_id").agg(F.array_sort(F.collect_list(F.struct("n", "id", "file", "line"))).alias("all"))
    evidence = F.transform(F.slice(F.coalesce("all", F.array().cast("array<struct<n:int,id:string,file:string,line:int>>")), 1, EVIDENCE[detail]), lambda x: F.struct(x["id"].alias("id"), x["file"].alias("file"), x["line"].alias("line")))
    return issues.join(shown, "issue_id", "left").select("issue_id", "kind", "severity", "message", F.when(F.col("candidate"), "medium").otherwise("high").alias("confidence"), evidence.alias("evidence"))


def meta_summary(meta: Column, most: int = 6, width: int = 80) -> Column:
    """PRJ-19: the first entries by key, long values cut."""
    short = lambda v: F.when(F.char_length(v) > width, F.concat(F.left(v, F.lit(width - 3)), F.lit("..."))).otherwise(v)
    return F.transform(F.slice(F.array_sort(F.map_entries(meta)), 1, most), lambda e: F.concat(e["key"], F.lit("="), short(e["value"])))


def within_budget(rows: DataFrame, size: Column, budget: int, *order: Column) -> DataFrame:
    """SRT-13: the rows of a page, in order, that fit a budget of tokens together; the first always stays. Meant
    for answers, which a limit has cut before."""
    so_far = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.orderBy(*order)) == 1
    return rows.withColumn("_fits", (so_far <= budget) | first).where("_fits").drop("_fits")


def result_stats(rows: DataFrame, total: int) -> DataFrame:
    """AGG-26: (returned, omitted, bytes, tokens) of an answer as JSON."""
    n, size = F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    return rows.agg(n.alias("returned"), F.greatest(F.lit(0), F.lit(total) - n).cast("long").alias("omitted"), size.cast("long").alias("bytes"), tokens_estimate(size).cast("long").alias("tokens"))


def metric_snapshot(issues: DataFrame, nodes: DataFrame, hot: DataFrame, health: DataFrame, covered: DataFrame) -> DataFrame:
    """AGG-19: one row of figures for the history of a project. Each table is one partial aggregate."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    a = issues.agg(F.count("*").alias("issue_count"), (of("DEAD_CODE") + of("UNUSED_ENDPOINT")).alias("dead_count"), of("CIRCULAR_DEPENDENCY").alias("circular_count"))
    b, c = nodes.agg(of("APIEndpoint").alias("endpoint_count")), hot.agg(F.count("*").alias("hotspot_count"), F.coalesce(F.sum("complexity"), F.lit(0)).cast("long").alias("complexity"))
    pct = covered.agg(F.when(F.sum("total") > 0, round1(F.sum("covered") * 100.0 / F.sum("total"))).alias("coverage"))
    return health.select("health").join(a).join(b).join(c).join(pct)


def merged_stack(stacks: DataFrame) -> DataFrame:
    """AGG-27: the sorted distinct tags of all repositories (tags: array), in one row."""
    tags = stacks.select(F.explode("tags").alias("tag")).distinct()
    return tags.agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def report_summary(nodes: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """AGG-28."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(nodes, "nodes").join(count(edges, "edges")).join(count(issues, "issues"))


def dangling_view(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-26: dangling calls with their caller's name, else its id, else `unknown`."""
    rows = issues.where("kind = 'DANGLING_API_CALL'").select(F.col("meta")["method"].alias("method"), F.col("meta")["url"].alias("url"), F.get("nodes", F.lit(0)).alias("id"))
    return rows.join(nodes.select("id", "name"), "id", "left").select("method", "url", F.coalesce("name", "id", F.lit("unknown")).alias("caller"))


def hotspot_history(latest: DataFrame, history: DataFrame, scans: DataFrame, most: int = 12) -> DataFrame:
    """JOIN-32: (node_id, scan_id, churn, complexity, coverage_pct): a point for each of the first `most` hotspots of
    the latest scan (ord, node_id, file) in every scan (scan_id): the scan's first hotspot, in the order of its list
    (scan_id, ord, node_id, file, churn, complexity, coverage_pct), that has the file or the id; nulls where none has.

    The either-or join becomes two equality joins over the few hotspots.
    """
    top = latest.orderBy("ord").limit(most).select(F.col("node_id").alias("node"), F.col("file").alias("at"))
    point = F.struct("churn", "complexity", "coverage_pct")
    rows = history.select("scan_id", "ord", "node_id", "file", point.alias("point"))
    by_node = rows.join(F.broadcast(top), F.col("node_id") == F.col("node"))
    by_file = rows.join(F.broadcast(top.where("at <> ''")), F.col("file") == F.col("at"))
    best = by_node.unionByName(by_file).groupBy("scan_id", "node").agg(F.min_by("point", "ord").alias("point"))
    every = scans.select("scan_id").distinct().crossJoin(F.broadcast(top.select("node").distinct()))
    return every.join(best, ["scan_id", "node"], "left").select(F.col("node").alias("node_id"), "scan_id", "point.*")


def contained(path: Column) -> Column:
    """FN-24: whether a path stays within its root: relative, and never above where it starts."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), (s["ok"] & (s["at"] + F.when(p == "..", -1).otherwise(1) >= 0)).alias("ok")))
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & depth["ok"]


def repo_spec(spec: Column) -> Column:
    """FN-31: id=/path[:role] as (id, path, role); a part after the last colon that is no role is of the path."""
    rest = F.when(F.instr(spec, "=") > 0, F.expr(f"substring({_sql(spec)}, instr({_sql(spec)}, '=') + 1)")).otherwise(spec)
    last = F.substring_index(rest, ":", -1)
    known = (F.instr(rest, ":") > 0) & last.isin(*ROLES)
    path = F.when(known, F.left(rest, F.char_length(rest) - F.char_length(last) - 1)).otherwise(rest)
    return F.struct(F.when(F.instr(spec, "=") > 0, F.substring_index(spec, "=", 1)).alias("id"), path.alias("path"), F.when(known, last).alias("role"))


def _sql(x: Column) -> str:
    return x._jc.toString()


def unique_slugs(repos: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """SET-10: repos with a slug each; the second of one slug is numbered 2, and so on, in their order."""
    base = F.when(slug(F.col(name)) == "", "repo").otherwise(slug(F.col(name)))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    return repos.withColumn("_base", base).withColumn("_n", n).withColumn("slug", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def invalid_repo_ids(repos: DataFrame) -> DataFrame:
    """SET-08: (id, reason) of ids that are empty, no slugs, or taken twice."""
    odd = repos.select("id", F.when(F.coalesce("id", F.lit("")) == "", "empty").when(slug(F.col("id")) != F.col("id"), "not a slug").alias("reason")).where("reason is not null")
    return odd.union(repos.where("coalesce(id, '') <> ''").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("taken twice"))).distinct()


def outline(lines: DataFrame) -> DataFrame:
    """EXT-29: the lines (file, line, text) that look like declarations."""
    return lines.where(F.col("text").rlike(OUTLINE))
