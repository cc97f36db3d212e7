"""What one should read before an edit (QRY-08, QRY-10, QRY-11): seeds by priority, windows, impact, risks, tests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.operators.graph import impact
from graphloom.operators.insights import lines_of

#: Priorities of what made a node a seed, and what makes an issue a risk.
PRIORITY = {"id": 100, "file": 95, "risk": 90, "hotspot": 85, "test": 75, "search": 60}
RISKS = ("SECRET_CANDIDATE", "UNCOVERED_RISKY_NODE", "COMPLEXITY_HOTSPOT")
MUST_FIX = ("BREAKING_ENDPOINT_REMOVED", "BREAKING_ROUTE_METHOD_CHANGED", "BREAKING_FIELD_REMOVED", "BOUNDARY_VIOLATION")
SEVERITY = ("high", "medium", "low", "info")


def seeds(tables: dict[str, DataFrame], ids: Sequence[str] = (), files: Sequence[str] = (), query: str = "", most: int = 25) -> DataFrame:
    """(id, reason, priority): per node the reason of highest priority, the first on ties (WIN-03, SRT-07)."""
    nodes = tables["nodes"]
    row = lambda df, reason: df.select("id", F.lit(reason).alias("reason"), F.lit(PRIORITY[reason]).alias("priority"))
    inside = nodes.where(F.col("file").isin(*files)) if files else nodes.where("false")
    tests = search.nearby_tests(inside.select(F.col("file").alias("path")).distinct(), tables["files"]).select(F.concat(F.lit("File:"), "test").alias("id")).distinct()
    risky = tables["issues"].where(F.col("kind").isin(*RISKS)).select(F.explode("nodes").alias("id")).distinct()
    parts = [row(nodes.where(F.col("id").isin(*ids)) if ids else nodes.where("false"), "id"), row(inside, "file"), row(inside.join(risky, "id", "left_semi"), "risk"), row(tables["hotspots"].select(F.col("node_id").alias("id")).join(inside, "id", "left_semi"), "hotspot"), row(nodes.join(tests, "id", "left_semi"), "test")]
    if query:
        parts.append(row(search.search(nodes, query, limit=10), "search"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return search.best_seed(whole.withColumn("ord", F.xxhash64("id"))).orderBy(F.desc("priority"), "id").limit(most)


def prepare_edit(tables: dict[str, DataFrame], ids: Sequence[str] = (), files: Sequence[str] = (), query: str = "") -> dict[str, DataFrame]:
    """QRY-08: seeds, windows, impact of the first three, up to twelve risks, tests and what was spared."""
    nodes, found = tables["nodes"], seeds(tables, ids, files, query).cache()
    places = nodes.join(found.select("id"), "id", "left_semi").where("file is not null").select("id", "kind", "file", "line")
    text = tables["files"].join(places.select(F.col("file").alias("path")).distinct(), "path", "left_semi").select(F.col("path").alias("file"), "content")
    windows = search.windows(places, lines_of(text))
    first = found.orderBy(F.desc("priority"), "id").limit(3).select("id")
    severity = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    at = tables["issues"].withColumn("_id", F.explode_outer("nodes")).join(found.select(F.col("id").alias("_id")), "_id", "left_semi").drop("_id").dropDuplicates(["kind", "message"])
    risks = at.orderBy(severity, "kind", "message").limit(12)
    changed = places.select(F.col("file").alias("path")).distinct()
    spared = search.savings(text.select(F.octet_length("content").alias("n")), windows.select(F.octet_length("text").alias("n")))
    return {"seeds": found, "windows": windows, "impact": impact(nodes, tables["edges"], first), "risks": risks, "tests": search.nearby_tests(changed, tables["files"]), "savings": spared}


def review(tables: dict[str, DataFrame], files: Sequence[str], ids: Sequence[str] = ()) -> tuple[dict[str, DataFrame], DataFrame, bool]:
    """QRY-10, QRY-11: the context of changed files, what must be fixed first, and whether to proceed."""
    context = prepare_edit(tables, ids, files)
    must = context["risks"].where((F.col("severity") == "high") | F.col("kind").isin(*MUST_FIX))
    return context, must, must.isEmpty()


class Session:
    """SET-07: items that were sent before become stubs; a new report clears the memory."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def clear(self) -> None:
        self.seen.clear()

    def stubs(self, items: list[dict]) -> list[dict]:
        out = []
        for item in items:
            key = hashlib.sha1(json.dumps(item, sort_keys=True, default=str).encode()).hexdigest()
            out.append({"seen": key[:12]} if key in self.seen else item)
            self.seen.add(key)
        return out
