"""Rules over the graph (RUL-*): each returns issue rows (kind, severity, message, nodes, candidate, meta)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import js_number, matches_any, node_path, stem
from graphloom.operators.graph import Steps, strongly_connected
from graphloom.schema import BOUNDARY_KINDS, FRAMEWORK_FILES, FRAMEWORK_NAMES, GOD_MODEL, HEALTH_WEIGHTS, LARGE_FILE

@dataclass
class PublicApi:
    """UDX-02: nodes declared to be used from outside."""

    ids: Sequence[str] = ()
    paths: Sequence[str] = ()
    names: Sequence[str] = ()
    kinds: Sequence[str] = ()

    def holds(self) -> Column:
        """PRJ-09: by id, or by path glob and, where given, kinds and names; without paths only by id."""
        out = F.col("id").isin(*self.ids) if self.ids else F.lit(False)
        if self.paths:
            by = matches_any(node_path(F.col("kind"), F.col("name"), F.col("file"), F.col("id")), self.paths)
            by = by & F.col("kind").isin(*self.kinds) if self.kinds else by
            by = by & F.col("name").isin(*self.names) if self.names else by
            out = out | by
        return F.coalesce(out, F.lit(False))


@dataclass
class Boundary:
    """UDX-02: deny if not allow; groups may be *."""

    src: Sequence[str]
    dst: Sequence[str]
    allow: bool = False
    kinds: Sequence[str] = ()
    message: str | None = None


@dataclass
class Config:
    groups: Mapping[str, Sequence[str]] = field(default_factory=dict)
    boundaries: Sequence[Boundary] = ()
    public_api: Sequence[PublicApi] = ()
    ignore_paths: Sequence[str] = ()
    god_model: int = GOD_MODEL
    large_file: int = LARGE_FILE


def issue(kind: str, severity: str | Column, message: Column, nodes: Column, candidate: bool = False, meta: Column | None = None) -> list[Column]:
    meta = F.lit(None).cast("map<string,string>") if meta is None else meta
    return [F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), message.alias("message"), nodes.alias("nodes"), F.lit(candidate).alias("candidate"), meta.alias("meta")]


def framework_entry() -> Column:
    """PRJ-10: files and names that a framework calls by convention; the stem ends at the first dot (T-13)."""
    return F.coalesce(stem(F.col("file")).isin(*FRAMEWORK_FILES), F.lit(False)) | F.col("name").isin(*FRAMEWORK_NAMES)


def dead_code(nodes: DataFrame, edges: DataFrame, public_api: Sequence[PublicApi] = ()) -> DataFrame:
    """RUL-03: components never rendered, hooks never used, endpoints never called: one anti join."""
    needs = F.when(F.col("kind") == "Component", "RENDERS").when(F.col("kind") == "Hook", "USES").when(F.col("kind") == "APIEndpoint", "CALLS")
    rows = nodes.withColumn("_needs", needs).where("_needs is not null").where(~((F.col("kind") != "APIEndpoint") & framework_entry()))
    for entry in public_api:
        rows = rows.where(~entry.holds())
    used = edges.where(F.col("kind").isin("RENDERS", "USES", "CALLS")).select(F.col("dst").alias("id"), F.col("kind").alias("_needs")).distinct()
    rows = rows.join(used, ["id", "_needs"], "left_anti")
    end = F.when(F.col("kind") == "Component", '" is never rendered').when(F.col("kind") == "Hook", '" is never used').otherwise('" has no frontend caller')
    start = F.when(F.col("kind") == "APIEndpoint", "Endpoint").otherwise(F.col("kind"))
    sure = F.when(F.coalesce(F.col("meta")["exported"], F.lit("false")) == "true", "low").otherwise("high")
    meta = F.when(F.col("kind") != "APIEndpoint", F.create_map(F.lit("confidence"), sure))
    return rows.select(F.when(F.col("kind") == "APIEndpoint", "UNUSED_ENDPOINT").otherwise("DEAD_CODE").alias("kind"), F.lit("low").alias("severity"), F.concat(start, F.lit(' "'), "name", end).alias("message"), F.array("id").alias("nodes"), F.lit(True).alias("candidate"), meta.alias("meta"))


def circular_imports(edges: DataFrame) -> DataFrame:
    """RUL-02: a component per row, members sorted (T-15)."""
    members = strongly_connected(edges.where("kind = 'IMPORTS'")).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    return members.select(*issue("CIRCULAR_DEPENDENCY", "high", F.concat(F.lit("Circular import: "), F.array_join("nodes", " → ")), F.col("nodes")))


def boundary_hits(nodes: DataFrame, edges: DataFrame, groups: Mapping[str, Sequence[str]], rules: Sequence[Boundary]) -> DataFrame:
    """RUL-04, JOIN-20/21: (edge_id, src, dst, rule, index, from_group, to_group, message, allowed): groups of both ends by path,
    then deny rules; an edge they spare must be allowed by some rule of its source group, if there are any, unless both
    ends share a group. Columns are flat, so that what is not asked for (ids of edges are long) passes no shuffle; nodes
    are hashed within partitions, so that no side is sorted and no node table is sent to all."""
    path = node_path(F.col("kind"), F.col("name"), F.col("file"), F.col("id"))
    own = F.array_compact(F.array(*[F.when(matches_any(path, globs), F.lit(g)) for g, globs in groups.items()])) if groups else F.array().cast("array<string>")
    placed = nodes.select("id", path.alias("path"), own.alias("groups")).where(F.size("groups") > 0)
    if rules and not any("*" in x for r in rules for x in (*r.src, *r.dst)):
        # an edge that no rule's source group opens can break none: its groups are all that is looked at
        opens = F.arrays_overlap("groups", F.array(*[F.lit(g) for g in sorted({g for r in rules for g in r.src})]))
        sources = placed.where(opens)
    else:
        sources = placed
    kinds = sorted({k for r in rules for k in (r.kinds or BOUNDARY_KINDS)})
    met = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    met = met.select(F.col("id").alias("edge_id"), "src", "dst", F.col("kind").alias("edge_kind"))
    met = met.join(sources.toDF("src", "src_path", "src_groups").hint("shuffle_hash"), "src").join(placed.toDF("dst", "dst_path", "dst_groups").hint("shuffle_hash"), "dst")
    kind_fits = lambda r: F.col("edge_kind").isin(*(r.kinds or BOUNDARY_KINDS))
    among = lambda column, ids: F.filter(column, lambda g: g.isin(*ids)) if "*" not in ids else F.col(column)
    denies, allows = [r for r in rules if not r.allow], [r for r in rules if r.allow]
    default = F.concat(F.lit("Boundary violation: "), "src_path", F.lit(" "), "edge_kind", F.lit(" "), "dst_path")
    hits = []
    for i, r in enumerate(denies):
        hit = kind_fits(r) & (F.size(among("src_groups", r.src)) > 0) & (F.size(among("dst_groups", r.dst)) > 0)
        hits.append(F.when(hit, F.struct(F.lit("deny").alias("rule"), F.lit(i).cast("string").alias("index"), F.get(among("src_groups", r.src), 0).alias("a"), F.get(among("dst_groups", r.dst), 0).alias("b"), (F.lit(r.message) if r.message else default).alias("message"), F.lit(None).cast("string").alias("allowed"))))
    if allows:
        from_fits = [kind_fits(r) & (F.size(among("src_groups", r.src)) > 0) for r in allows]
        any_applies, any_allows = F.lit(False), F.lit(False)
        for r, fits in zip(allows, from_fits, strict=True):
            any_applies, any_allows = any_applies | fits, any_allows | (fits & (F.size(among("dst_groups", r.dst)) > 0))
        names = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(fits, F.array(*[F.lit(g) for g in r.dst])).otherwise(F.array().cast("array<string>")) for r, fits in zip(allows, from_fits, strict=True)]))))
        bad = any_applies & ~any_allows & ~F.arrays_overlap("src_groups", "dst_groups")
        denied = F.coalesce(*hits).isNotNull() if hits else F.lit(False)
        hits.append(F.when(bad & ~denied, F.struct(F.lit("allow").alias("rule"), F.lit(None).cast("string").alias("index"), F.get("src_groups", 0).alias("a"), F.get("dst_groups", 0).alias("b"), default.alias("message"), F.array_join(names, ", ").alias("allowed"))))
    if not hits:
        empty = F.lit(None).cast("string")
        return met.where("false").select("edge_id", "src", "dst", empty.alias("rule"), empty.alias("index"), empty.alias("from_group"), empty.alias("to_group"), default.alias("message"), empty.alias("allowed"))
    rows = met.withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    return rows.select("edge_id", "src", "dst", "hit.rule", "hit.index", F.col("hit.a").alias("from_group"), F.col("hit.b").alias("to_group"), "hit.message", "hit.allowed")


def boundary_violations(nodes: DataFrame, edges: DataFrame, groups: Mapping[str, Sequence[str]], rules: Sequence[Boundary]) -> DataFrame:
    """RUL-04 as issues."""
    told = (("edgeId", "edge_id"), ("fromGroup", "from_group"), ("toGroup", "to_group"), ("rule", "rule"), ("ruleIndex", "index"), ("allowedTo", "allowed"))
    meta = F.map_filter(F.create_map(*[x for name, c in told for x in (F.lit(name), F.col(c))]), lambda k, v: v.isNotNull())
    return boundary_hits(nodes, edges, groups, rules).select(*issue("BOUNDARY_VIOLATION", "medium", F.col("message"), F.array("src", "dst"), False, meta))


def god_models(nodes: DataFrame, edges: DataFrame, most: int = GOD_MODEL) -> DataFrame:
    """RUL-05, AGG-10."""
    counts = edges.where("kind = 'REFERENCES'").select("id", "src").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    rows = nodes.where("kind = 'Model'").join(counts, "id")
    return rows.select(*issue("GOD_MODEL", "medium", F.concat(F.lit('Model "'), "name", F.lit('" has '), F.col("n").cast("string"), F.lit(" relations")), F.array("id"), False, F.create_map(F.lit("relations"), F.col("n").cast("string"))))


def large_files(lines: DataFrame, most: int = LARGE_FILE) -> DataFrame:
    """RUL-06, AGG-11 over (file, lines)."""
    return lines.where(F.col("lines") > most).select(*issue("LARGE_FILE", "low", F.concat("file", F.lit(" has "), F.col("lines").cast("string"), F.lit(" lines")), F.array(F.concat(F.lit("File:"), "file")), False, F.create_map(F.lit("lines"), F.col("lines").cast("string"))))


def secret_issues(secrets: DataFrame) -> DataFrame:
    """RUL-08."""
    told = F.map_filter(F.create_map(*[x for c, name in (("file", "file"), ("line", "line"), ("col", "column"), ("rule", "rule"), ("preview", "preview"), ("entropy", "entropy")) for x in (F.lit(name), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    return secrets.select(*issue("SECRET_CANDIDATE", "high", F.concat(F.lit("Potential "), "rule", F.lit(" secret in "), "file", F.lit(":"), F.col("line").cast("string")), F.array(F.concat(F.lit("File:"), "file")), True, told))


def hotspot_issues(hotspots: DataFrame, score: int = 25, complexity: int = 18, coverage: int = 50, impact: int = 3) -> DataFrame:
    """RUL-09 and RUL-10."""
    first = hotspots.where((F.col("score") >= score) | (F.col("complexity") >= complexity)).select(*issue("COMPLEXITY_HOTSPOT", F.when(F.col("score") >= score, "medium").otherwise("low"), F.concat("name", F.lit(" has complexity "), F.col("complexity").cast("string"), F.lit(" and hotspot score "), js_number(F.col("score"))), F.array("node_id"), True))
    second = hotspots.where((F.col("coverage_pct") < coverage) & (F.col("impact") >= impact)).select(*issue("UNCOVERED_RISKY_NODE", "medium", F.concat("name", F.lit(" has "), js_number(F.col("coverage_pct")), F.lit("% coverage and impacts "), F.col("impact").cast("string"), F.lit(" nodes")), F.array("node_id"), True))
    return first.unionByName(second)


def run_rules(nodes: DataFrame, edges: DataFrame, lines: DataFrame, config: Config) -> DataFrame:
    """RUL-01: the rules in their order, as one table."""
    parts = [circular_imports(edges), dead_code(nodes, edges, config.public_api), boundary_violations(nodes, edges, config.groups, config.boundaries), god_models(nodes, edges, config.god_model), large_files(lines, config.large_file)]
    whole = None
    for i, part in enumerate(parts):
        part = part.withColumn("rule_ord", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def filter_ignored(issues: DataFrame, nodes: DataFrame, edges: DataFrame, globs: Sequence[str]) -> DataFrame:
    """RUL-11, JOIN-27/28: an issue goes if it has files and all of them match; `issues` has an issue_id.

    Its files are those of its nodes, of the neighbours of nodes without one, and of meta. Globs are asked once per node, and
    an issue with a file of its own that no glob matches stays, whatever else it has. Only what is left is written, and edges
    are read only for its nodes without a file, if there are any.
    """
    if not globs:
        return issues
    kept = Steps(issues.sparkSession, "ignored")
    own = F.coalesce("file", F.when(F.col("kind") == "File", F.col("name")))
    fits = nodes.select("id", matches_any(own, globs).alias("fits"), own.isNotNull().alias("has"))
    at = issues.select("issue_id", F.explode("nodes").alias("id")).join(fits, "id", "left")
    by_id = F.when(F.col("id").startswith("File:"), matches_any(F.expr("substring(id, 6)"), globs))
    at = at.select("issue_id", F.when(F.col("has"), F.col("fits")).otherwise(by_id).alias("fits"), F.when(~F.coalesce("has", F.lit(False)) & ~F.col("id").startswith("File:"), F.col("id")).alias("bare"))
    said = issues.select("issue_id", F.col("meta")["file"].alias("file")).where("file is not null").select("issue_id", matches_any(F.col("file"), globs).alias("fits"), F.lit(None).cast("string").alias("bare"))
    per = at.unionByName(said).groupBy("issue_id").agg(F.bool_and("fits").alias("all"), F.collect_set("bare").alias("bare"))
    per = kept.put(per.where(F.coalesce("all", F.lit(True))), "open")
    bare = per.select("issue_id", F.explode("bare").alias("id"))
    gone = per.select("issue_id", "all")
    if not bare.isEmpty():
        near = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).union(edges.select("dst", "src")).join(bare.select("id").distinct(), "id", "left_semi")
        near = near.join(fits.where("has").select(F.col("id").alias("n"), "fits"), "n").groupBy("id").agg(F.bool_and("fits").alias("all"))
        gone = gone.unionByName(bare.join(near, "id").select("issue_id", "all"))
    gone = gone.groupBy("issue_id").agg(F.bool_and("all").alias("all")).where("all").select("issue_id")
    return issues.join(gone, "issue_id", "left_anti")


def weight() -> Column:
    out = F.lit(0)
    for kind, points in HEALTH_WEIGHTS.items():
        out = F.when(F.col("kind") == kind, points).otherwise(out)
    low = (F.col("kind") == "DEAD_CODE") & F.col("candidate") & (F.col("meta")["confidence"] == "low")
    return F.when(F.coalesce(low, F.lit(False)), 0).otherwise(out)


def breakdown(issues: DataFrame) -> DataFrame:
    """AGG-09: (kind, points) of the kinds that cost any."""
    return issues.withColumn("w", weight()).where("w > 0").groupBy("kind").agg(F.sum("w").cast("long").alias("points"))


def health(issues: DataFrame) -> DataFrame:
    """AGG-09: one row; 100 without issues, never under 0."""
    return breakdown(issues).agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum("points"), F.lit(0))).cast("int").alias("health"))
