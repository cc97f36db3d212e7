"""Diffs of many snapshots in one pass (SET-03, AGG-22, WIN-07): versions of one id lie beside each other.

A snapshot per scan would need a full outer join per pair of scans. Here every version is a row, the rows of an id are
sorted by scan once, and each one is compared with its neighbours: what was not there in the scan before is
added, what is not there in the scan after is removed, what differs is changed. An id has at most one row a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to this many scans are broadcast to their versions.
MOST_SCANS = 100_000


def numbered_scans(scans: DataFrame, project: str = "project_id") -> DataFrame:
    """Scans (project_id, scan_id, finished_at) with pos, from 0, and last, the position of the newest."""
    own = Window.partitionBy(project)
    placed = scans.select(project, "scan_id", "finished_at").distinct().withColumn("pos", F.row_number().over(own.orderBy("finished_at", "scan_id")) - 1)
    return placed.withColumn("last", F.max("pos").over(own))


def version_changes(versions: DataFrame, scans: DataFrame, what: str, content: Column | None, value: Column, project: str = "project_id") -> DataFrame:
    """(project_id, scan_id, kind, id, before, after): all changes of each scan against the one before it.

    versions: (project_id, scan_id, id, ...), of which the last in `ord` counts where an id is repeated within a scan
    (without such a column, the largest value); scans: (project_id, scan_id, finished_at), all of them, also those without rows. `content` is
    compared by hash; without it rows are only added and removed, as edges and issues are. `value` is carried as
    before and after. The first scan of a project has no changes. Versions of unknown scans take no part.
    """
    at = numbered_scans(scans, project)
    few = at.limit(MOST_SCANS + 1).count() <= MOST_SCANS
    places = F.broadcast(at) if few else at
    digest = F.lit(0).cast("long") if content is None else F.xxhash64(content)
    order = F.struct("ord", value, digest) if "ord" in versions.columns else F.struct(value, digest)
    once = versions.groupBy(project, "scan_id", "id").agg(F.max_by(F.struct(value.alias("value"), digest.alias("digest")), order).alias("v"))
    rows = once.join(places.select(project, "scan_id", "pos", "last"), [project, "scan_id"]).select(project, "id", "pos", "last", "v")
    by_scan = Window.partitionBy(project, "id").orderBy("pos")
    rows = rows.withColumn("p", F.lag(F.struct("pos", "v")).over(by_scan)).withColumn("n", F.lead("pos").over(by_scan))
    pos, now = F.col("pos"), F.col("v.value")
    follows = F.coalesce(F.col("p.pos") == pos - 1, F.lit(False))
    event = lambda kind, pos, before, after: F.struct(F.lit(f"{what}_{kind}").alias("kind"), pos.cast("int").alias("pos"), before.alias("before"), after.alias("after"))
    empty = F.when(F.lit(False), now)
    events = F.array(
        F.when((pos > 0) & ~follows, event("added", pos, empty, now)),
        F.when(follows & (F.col("p.v.digest") != F.col("v.digest")), event("changed", pos, F.col("p.v.value"), now)),
        F.when((pos < F.col("last")) & F.coalesce(F.col("n") != pos + 1, F.lit(True)), event("removed", pos + 1, now, empty)),
    )
    found = rows.select(project, "id", F.explode(F.array_compact(events)).alias("e")).select(project, "id", "e.*")
    return found.join(places.select(project, "pos", "scan_id"), [project, "pos"]).select(project, "scan_id", "kind", "id", "before", "after")


def changed_repos(changes: DataFrame, before: Column, after: Column, project: str = "project_id") -> DataFrame:
    """(project_id, scan_id, repo_id), a row for each change and repository that it touches, before or after."""
    touched = F.array_distinct(F.array_compact(F.array(before, after)))
    return changes.select(project, "scan_id", F.explode(touched).alias("repo_id"))
