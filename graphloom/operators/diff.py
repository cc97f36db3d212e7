"""Snapshots compared (SET-03..05, JOIN-22..24, AGG-16..18, RUL-12/13, WIN-07/08, AGG-21/22)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from graphloom.functions.text import quartile, url_path


#: Up to this many scans are broadcast to the repos of an activity grid.
MOST_SCANS = 100_000


def changes(before: DataFrame, after: DataFrame, what: str, label: Column, key: str = "id", content: Column | Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """SET-03, JOIN-22: (kind, id, label) of rows added, removed and, given content, changed.

    One full outer join on the key; content (a column, or what makes one of a side's rows) is compared by hash, so no row
    travels with it. Labels are
    the new side's where there is one. Of rows with one key, the last in `ord` counts (without such a column, the largest).
    """

    def side(rows: DataFrame, s: str) -> DataFrame:
        digest = F.lit(0).cast("long") if content is None else F.xxhash64(content(rows) if callable(content) else content)
        at = F.struct("ord", label, digest) if "ord" in rows.columns else F.struct(label, digest)
        last = rows.groupBy(F.col(key).alias("id")).agg(F.max_by(F.struct(label.alias("label"), digest.alias("digest")), at).alias("x"))
        return last.select("id", F.col("x.label").alias(f"label_{s}"), F.col("x.digest").alias(f"digest_{s}"))

    a, b = side(before, "a"), side(after, "b")
    kind = F.when(F.col("digest_a").isNull(), f"{what}_added").when(F.col("digest_b").isNull(), f"{what}_removed").when(F.col("digest_a") != F.col("digest_b"), f"{what}_changed")
    return a.join(b, "id", "full_outer").select(kind.alias("kind"), "id", F.coalesce("label_b", "label_a").alias("label")).where("kind is not null")


def stable(nodes: DataFrame, column: str = "meta") -> Column:
    """FN-18: metadata as JSON with sorted keys at every depth; the order within arrays counts, and a null member is not an
    absent one. The column is a VARIANT, a map of texts, or JSON text (what is not JSON stands as it is). Equal metadata are
    equal texts whichever of the three holds them."""
    kind = nodes.schema[column].dataType
    if isinstance(kind, VariantType):
        return F.to_json(column)
    if isinstance(kind, MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
    return F.coalesce(F.to_json(F.try_parse_json(column)), F.col(column))


def node_label() -> Column:
    return F.concat_ws(" ", "kind", "name")


def edge_label() -> Column:
    return F.concat(F.col("kind"), F.lit(" "), F.col("src"), F.lit(" -> "), F.col("dst"))


def issue_key() -> Column:
    return F.concat(F.col("kind"), F.lit(":"), F.array_join(F.array_sort("nodes"), "|"), F.lit(":"), F.col("message"))


def node_content(nodes: DataFrame) -> Column:
    """FN-18: what makes two nodes of one id differ."""
    return F.to_json(F.struct("kind", "name", "file", "line", stable(nodes).alias("meta")))


def diff(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """All changes of two snapshots {nodes, edges, issues}."""
    out = changes(before["nodes"], after["nodes"], "node", node_label(), content=node_content)
    out = out.unionByName(changes(before["edges"], after["edges"], "edge", edge_label()))
    keyed = [x["issues"].withColumn("key", issue_key()) for x in (before, after)]
    return out.unionByName(changes(*keyed, "issue", F.concat_ws(" ", "kind", "message"), key="key"))


def change_counts(found: DataFrame) -> DataFrame:
    """AGG-16, AGG-17."""
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def signature() -> Column:
    """SET-05: METHOD path of an endpoint, else its name."""
    method, path = F.col("meta")["method"], F.col("meta")["path"]
    return F.when((method != "") & (path != ""), F.concat(F.upper(method), F.lit(" "), path)).otherwise(F.col("name"))


def endpoints(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'APIEndpoint'").select("id", signature().alias("signature"))


def methods_by_path(found: DataFrame) -> DataFrame:
    """AGG-18."""
    path = F.regexp_replace("signature", "^[A-Z]+ ", "")
    return found.groupBy(path.alias("path")).agg(F.array_join(F.array_sort(F.collect_set(F.split("signature", " ")[0])), ",").alias("methods"))


def breaking(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """SET-04: (kind, severity, message, nodes): endpoints removed while called, method sets changed
    (additions too, T-12), fields removed that a serializer exposed."""
    old, new = endpoints(before["nodes"]), endpoints(after["nodes"])
    called = after["issues"].where("kind = 'DANGLING_API_CALL'").select(F.concat(F.upper(F.coalesce(F.col("meta")["method"], F.lit("GET"))), F.lit(" "), url_path(F.col("meta")["url"])).alias("signature")).where("signature is not null")
    gone = old.join(new, "signature", "left_anti").join(called, "signature", "left_semi").groupBy("signature").agg(F.max("id").alias("id"))
    row = lambda kind, message, nodes: [F.lit(kind).alias("kind"), F.lit("high").alias("severity"), message.alias("message"), nodes.alias("nodes")]
    first = gone.select(*row("BREAKING_ENDPOINT_REMOVED", F.concat("signature", F.lit(" was removed while a frontend call still targets it.")), F.array("id")))
    both = methods_by_path(old).withColumnRenamed("methods", "a").join(methods_by_path(new).withColumnRenamed("methods", "b"), "path").where("a <> b")
    second = both.select(*row("BREAKING_ROUTE_METHOD_CHANGED", F.concat("path", F.lit(" changed methods from "), "a", F.lit(" to "), "b", F.lit(".")), F.array().cast("array<string>")))
    kinds = before["nodes"].select("id", "kind", "name")
    uses = before["edges"].where("kind = 'USES'").select("src", F.col("dst").alias("id"))
    exposed = uses.join(kinds.where("kind = 'Serializer'").select(F.col("id").alias("src")), "src", "left_semi").select("id").distinct()
    fields = kinds.where("kind = 'Field'").join(exposed, "id", "left_semi").join(after["nodes"].where("kind = 'Field'").select("id"), "id", "left_anti")
    third = fields.select(*row("BREAKING_FIELD_REMOVED", F.concat("name", F.lit(" was removed from a serializer-exposed model field.")), F.array("id")))
    return first.unionByName(second).unionByName(third)


def gates(facts: DataFrame, min_health: int | None = None, max_new_issues: int | None = None, forbid_breaking: bool = False, forbid_boundary: bool = False, min_coverage: float | None = None) -> DataFrame:
    """RUL-12: (kind, message, current, threshold) of the gates that one row of facts (health, new_issues,
    breaking, boundary, coverage) fails. Null new_issues: there is no baseline. Passed if empty."""
    d = lambda c: c.cast("double")
    rows: list[Column] = []

    def add(fails: Column, kind: str, message: Column, current: Column, threshold: float) -> None:
        rows.append(F.when(fails, F.struct(F.lit(kind).alias("kind"), message.alias("message"), d(current).alias("current"), F.lit(float(threshold)).alias("threshold"))))

    text = lambda c: F.col(c).cast("string")
    if min_health is not None:
        add(F.col("health") < min_health, "MIN_HEALTH", F.concat(F.lit("Health score "), text("health"), F.lit(f" is below required {min_health}.")), F.col("health"), min_health)
    if max_new_issues is not None:
        add(F.col("new_issues") > max_new_issues, "MAX_NEW_ISSUES", F.concat(text("new_issues"), F.lit(f" new issue(s) exceed allowed {max_new_issues}.")), F.col("new_issues"), max_new_issues)
    if forbid_breaking:
        add(F.col("breaking") > 0, "BREAKING_CHANGES", F.concat(text("breaking"), F.lit(" breaking change(s) detected.")), F.col("breaking"), 0)
    if forbid_boundary:
        add(F.col("boundary") > 0, "BOUNDARY_VIOLATIONS", F.concat(text("boundary"), F.lit(" boundary violation(s) detected.")), F.col("boundary"), 0)
    if min_coverage is not None:
        add(F.col("coverage").isNull(), "COVERAGE_MISSING", F.lit(f"Coverage data is required for minCoveragePct {min_coverage:g}."), F.lit(None), min_coverage)
        add(F.col("coverage") < min_coverage, "MIN_COVERAGE", F.concat(F.lit("Coverage "), F.format_string("%.1f", d(F.col("coverage"))), F.lit(f"% is below required {min_coverage:g}%.")), F.col("coverage"), min_coverage)
    if not rows:
        rows = [F.lit(None).cast("struct<kind:string,message:string,current:double,threshold:double>")]
    return facts.select(F.explode(F.array_compact(F.array(*rows))).alias("v")).select("v.*")


def pair_snapshots(metrics: DataFrame, *columns: str, key: str = "project_id") -> DataFrame:
    """WIN-07, WIN-08: each snapshot with its predecessor's columns and the differences; null for a first."""
    w = Window.partitionBy(key).orderBy("finished_at", "scan_id")
    out = metrics
    for c in columns:
        out = out.withColumn(f"previous_{c}", F.lag(c).over(w)).withColumn(f"{c}_delta", F.col(c) - F.lag(c).over(w))
    return out


def alerts(paired: DataFrame, drop: int = 5) -> DataFrame:
    """RUL-13: (scan_id, alert) of health drops, new circles and breaking changes."""
    hits = F.array_compact(F.array(F.when(F.col("health_delta") <= -drop, F.lit("health-drop")), F.when(F.col("circular_count_delta") > 0, F.lit("new-circular")), F.when(F.col("breaking_count") > 0, F.lit("breaking-changes"))))
    return paired.select("scan_id", F.explode(hits).alias("alert"))


def newest(runs: DataFrame, n: int = 20, key: str = "project_id") -> DataFrame:
    """WIN-10, SRC-20, SNK-10: the newest n of each project; ranked with a limit per group."""
    w = Window.partitionBy(key).orderBy(F.desc("finished_at"), F.desc("scan_id"))
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def prune(runs: DataFrame, n: int = 20, key: str = "project_id", blob: str = "report_json") -> DataFrame:
    """SNK-10: reports beyond the newest n go, their metric rows stay."""
    w = Window.partitionBy(key).orderBy(F.desc("finished_at"), F.desc("scan_id"))
    return runs.withColumn("_n", F.row_number().over(w)).withColumn(blob, F.when(F.col("_n") <= n, F.col(blob))).drop("_n")


def activity(found: DataFrame, repos: DataFrame, scans: DataFrame) -> DataFrame:
    """AGG-22, WIN-09, FN-29: changes per repo and scan, zero where there are none, with quartiles of the
    global maximum. `found` has a row for each change and repo that it touches. The grid is dimension by dimension, not row by row."""
    counted = found.groupBy("repo_id", "scan_id").agg(F.count("*").alias("n"))
    every = scans.select("scan_id").distinct()
    grid = repos.select("repo_id").distinct().crossJoin(F.broadcast(every) if every.limit(MOST_SCANS + 1).count() <= MOST_SCANS else every)
    rows = grid.join(counted, ["repo_id", "scan_id"], "left").fillna(0, ["n"])
    most = rows.agg(F.max("n").alias("most"))
    return rows.join(F.broadcast(most)).select("repo_id", "scan_id", "n", quartile(F.col("n"), F.col("most")).alias("level"))


def erosion(edges: DataFrame, node_repos: DataFrame, circular: DataFrame) -> DataFrame:
    """AGG-21: per snapshot, circles and edges whose ends lie in different repos."""
    a = node_repos.select("scan_id", F.col("id").alias("src"), F.col("repo_id").alias("ra"))
    b = node_repos.select("scan_id", F.col("id").alias("dst"), F.col("repo_id").alias("rb"))
    crossing = edges.join(a, ["scan_id", "src"]).join(b, ["scan_id", "dst"]).where("ra <> rb").groupBy("scan_id").agg(F.count("*").alias("cross_repo"))
    counted = circular.groupBy("scan_id").agg(F.count("*").alias("circular"))
    return edges.select("scan_id").distinct().join(crossing, "scan_id", "left").join(counted, "scan_id", "left").fillna(0)


def stale_repos(current: DataFrame, scanned: DataFrame) -> DataFrame:
    """JOIN-30, RUL-15: repos whose head moved or which became dirty since their scan."""
    both = current.select("repo_id", "head", "dirty").join(scanned.select("repo_id", F.col("head").alias("old_head"), F.col("dirty").alias("old_dirty")), "repo_id")
    reasons = F.array_compact(F.array(F.when(~F.col("head").eqNullSafe(F.col("old_head")), F.lit("head")), F.when(~F.col("dirty").eqNullSafe(F.col("old_dirty")), F.lit("dirty"))))
    return both.select("repo_id", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")
