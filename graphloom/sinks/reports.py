"""Report documents (SNK-01..06, SNK-08, SNK-09): what the driver writes is a bounded list of findings, never a table."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of SARIF.
LEVELS = {"high": "error", "medium": "warning", "low": "warning", "info": "note"}
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """SNK-01, SNK-09: tables of any size go out as Parquet, in parallel."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def report_json(tables: Mapping[str, DataFrame]) -> str:
    """SNK-01, SNK-02: small tables as one document."""
    return json.dumps({name: [json.loads(x) for (x,) in df.select(F.to_json(F.struct("*"))).collect()] for name, df in tables.items()}, indent=2, sort_keys=True)


def located(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-34: issues with the file and line of their first node that has a file. An issue is known by its
    content, so ids do not depend on how a plan is run; equal issues are located alike."""
    issues = issues.withColumn("_i", F.xxhash64("kind", "severity", "message", "nodes"))
    at = issues.select("_i", F.posexplode("nodes").alias("n", "id")).join(nodes.select("id", F.coalesce("file", F.when(F.col("kind") == "File", F.col("name"))).alias("file"), "line"), "id").where("file is not null")
    first = at.groupBy("_i").agg(F.min_by(F.struct("file", "line"), "n").alias("loc"))
    return issues.join(first, "_i", "left").select("kind", "severity", "message", F.col("loc.file").alias("file"), F.col("loc.line").alias("line"))


def sarif(findings: Iterable[Mapping], violations: Iterable[Mapping] = ()) -> dict:
    """SNK-03: SARIF 2.1.0 of located issues, breaking changes and failed gates."""
    results = []
    for x in findings:
        result = {"ruleId": x["kind"], "level": LEVELS.get(x["severity"], "note"), "message": {"text": x["message"]}}
        if x.get("file"):
            result["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": x["file"]}, "region": {"startLine": x.get("line") or 1}}}]
        results.append(result)
    results += [{"ruleId": f"CI_{v['kind']}", "level": "error", "message": {"text": v["message"]}} for v in violations]
    rules = [{"id": r} for r in sorted({r["ruleId"] for r in results})]
    return {"$schema": SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "graphloom", "rules": rules}}, "results": results}]}


def markdown(passed: bool, violations: Iterable[Mapping], changes: Mapping[str, int], changed: Iterable[str] = (), blast: Mapping[str, list[str]] | None = None, added: Iterable[str] = (), resolved: Iterable[str] = ()) -> str:
    """SNK-04: the comment of a pull request, each list cut where a reader stops."""
    out = ["## Code graph report", "", f"Gate: **{'passed' if passed else 'failed'}**"]
    out += [f"- {v['kind']}: {v['message']}" for v in violations]
    out += ["", "| Change | Count |", "| --- | --- |", *[f"| {k} | {n} |" for k, n in sorted(changes.items())]]
    for title, rows in (("Changed nodes", list(changed)[:20]), ("New issues", list(added)[:20]), ("Resolved issues", list(resolved)[:20])):
        if rows:
            out += ["", f"### {title}", *[f"- {r}" for r in rows]]
    if blast:
        out += ["", "### Blast radius", *[f"- {k}: {', '.join(v[:5])}" for k, v in list(blast.items())[:10]]]
    return "\n".join(out) + "\n"


def text_summary(health: int, by_kind: Mapping[str, int]) -> str:
    """SNK-05."""
    return "\n".join([f"Health {health}/100", *[f"  {k}: {n}" for k, n in by_kind.items()]])


def boundary_suggestion(groups: Iterable[str]) -> str:
    """SNK-06: YAML of path-prefix groups."""
    lines = ["boundaries:", "  groups:"]
    for path in sorted(groups):
        lines += [f"    - id: {path.replace('/', '-')}", f'      paths: ["{path}/**"]']
    return "\n".join([*lines, "  rules: []"]) + "\n"


def progress(stage: str, percent: float) -> str:
    """SNK-08: one JSON line, the percentage clamped."""
    return json.dumps({"type": "progress", "stage": stage, "percent": max(0, min(100, int(percent + 0.5)))})
