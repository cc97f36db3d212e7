"""Command line (QRY-17): scans of one repository or several, diffs, gates and questions over the tables that they write."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import prefix_group
from graphloom.operators import diff, insights, search, views
from graphloom.plans import edit_context
from graphloom.plans.analyze import Analysis, analyze
from graphloom.plans.phases import Phases
from graphloom.plans.projects import Repo, analyze_repos
from graphloom.sinks import reports
from graphloom.sources import coverage, files, governance
from graphloom.sources.cache import FactsCache

#: The roles that a repository's binding may end with.
ROLES = (*views.ROLES, "other")
#: Findings that a SARIF file holds; more are counted in a note.
MOST_FINDINGS = 25_000


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("files", "nodes", "edges", "issues", "health", "hotspots", "secrets", "coverage")}


def write(found: Analysis, out: str) -> None:
    for name, df in found.tables().items():
        reports.write_table(df, f"{out}/{name}")


def _documents(spark: SparkSession, path: str | None) -> DataFrame | None:
    """SRC-10: an OpenAPI document by its own path."""
    if not path:
        return None
    text = files.read_small(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return spark.createDataFrame([(path, text)], "path string, content string")


def _measured(spark: SparkSession, phases: Phases | None, out: str) -> None:
    """AGG-29: a scan's phases beside its tables; the run is the second in which it ended."""
    if phases:
        each, whole = phases.run(spark, int(time.time()))
        reports.write_table(each, f"{out}/phases")
        reports.write_table(whole, f"{out}/runs")


def scan(spark: SparkSession, root: str, out: str, config: str | None = None, covered: str | None = None, openapi: str | None = None, git: bool = True, most_commits: int = 500, cache: str | None = None, phases: Phases | None = None) -> None:
    settings = governance.load(spark, root, config).config
    commits = files.git_log(spark, root, most_commits) if git else None
    found = analyze(spark, root, settings, commits, coverage.find(spark, root, covered), cache=FactsCache(spark, cache) if cache else None, openapi=_documents(spark, openapi), told=phases)
    write(found, out)
    _measured(spark, phases, out)


def binding(spec: str) -> Repo:
    """FN-31: id=/path[:role]; a part after the last colon that is no role is of the path."""
    name, equal, rest = spec.partition("=")
    if not equal or not name or not rest:
        raise ValueError(f"{spec} is not id=/path[:role]")
    path, colon, role = rest.rpartition(":")
    return Repo(name, path, name, role) if colon and role in ROLES else Repo(name, rest, name)


def scan_project(spark: SparkSession, repos: Sequence[Repo], out: str, config: str | None = None, covered: str | None = None, openapi: str | None = None, git: bool = True, most_commits: int = 500, cache: str | None = None, phases: Phases | None = None) -> None:
    settings = governance.load_first(spark, [r.root for r in repos], config).config
    commits = {r.id: files.git_log(spark, r.root, most_commits) for r in repos} if git else {}
    found = analyze_repos(spark, repos, settings, commits, {r.id: coverage.find(spark, r.root, covered) for r in repos}, FactsCache(spark, cache) if cache else None, _documents(spark, openapi), told=phases)
    write(found, out)
    _measured(spark, phases, out)


def gate(spark: SparkSession, path: str, baseline: str | None, **limits) -> tuple[list, list]:
    """RUL-12 over a scan and its baseline: (violations, changes by kind). Coverage is that of the scan."""
    now = load(spark, path)
    of = lambda kinds: F.count_if(kinds)
    facts = now["health"].join(now["issues"].agg(of(F.col("kind") == "BOUNDARY_VIOLATION").alias("boundary"), of(F.col("kind").startswith("BREAKING_")).alias("standing")))
    facts = facts.join(insights.overall_coverage(now["coverage"]).select(F.col("pct").alias("coverage")))
    changed: list = []
    new_issues, broken = None, 0
    if baseline:
        before = load(spark, baseline)
        changed = diff.change_counts(diff.diff(before, now)).collect()
        new_issues = next((r.n for r in changed if r.kind == "issue_added"), 0)
        broken = diff.breaking(before, now).count()
    facts = facts.select("health", F.lit(new_issues).cast("long").alias("new_issues"), (F.col("standing") + broken).alias("breaking"), "boundary", "coverage")
    return diff.gates(facts, **limits).collect(), changed


def _summary(spark: SparkSession, path: str) -> str:
    """SNK-05."""
    now = load(spark, path)
    return reports.text_summary(now["health"].first()["health"], {r.kind: r.n for r in search.counts(now["issues"]).orderBy("kind").collect()})


def _ci(spark: SparkSession, opts: argparse.Namespace) -> int:
    limits = dict(governance.load(spark, opts.root or opts.path, opts.config).gates) if opts.root or opts.config else {}
    flags = {"min_health": opts.min_health, "max_new_issues": opts.max_new_issues, "min_coverage": opts.min_coverage, "forbid_breaking": opts.forbid_breaking or None, "forbid_boundary": opts.forbid_boundary or None}
    limits |= {k: v for k, v in flags.items() if v is not None}
    violations, changed = gate(spark, opts.path, opts.baseline, **limits)
    now = load(spark, opts.path)
    found = [v.asDict() for v in violations]
    blast: dict[str, list[str]] = {}
    if opts.baseline:
        rows = diff.changes(load(spark, opts.baseline)["nodes"], now["nodes"], "node", F.col("id"), content=diff.node_content).where("kind <> 'node_removed'").orderBy("id").limit(20).select("id")
        names = [r.id for r in rows.collect()]
        for r in edit_context.impact(now["nodes"], now["edges"], spark.createDataFrame([(n,) for n in names[:10]], "id string")).orderBy("depth", "id").limit(500).collect():
            blast.setdefault(r.seed, []).append(r.id)
    else:
        names = []
    print(reports.markdown(not violations, found, {r.kind: r.n for r in changed}, names, blast))
    if opts.sarif:
        located = reports.located(now["issues"], now["nodes"]).orderBy("kind", "message").limit(MOST_FINDINGS + 1).collect()
        if len(located) > MOST_FINDINGS:
            print(f"{opts.sarif} holds the first {MOST_FINDINGS} findings of {now['issues'].count()}", file=sys.stderr)
        with open(opts.sarif, "w", encoding="utf-8") as f:
            json.dump(reports.sarif([r.asDict() for r in located[:MOST_FINDINGS]], found), f)
    return int(bool(violations))


def _review(spark: SparkSession, opts: argparse.Namespace) -> int:
    tables = load(spark, opts.path)
    if opts.diff:
        with open(opts.diff, encoding="utf-8") as f:
            changed = files.changed_paths(spark.createDataFrame([(f.read(),)], "text string"))
    elif opts.root:
        changed = files.working_tree(spark, opts.root)
    else:
        changed = spark.createDataFrame([], "path string")
    changed = changed.select("path").union(spark.createDataFrame([(p,) for p in opts.file], "path string")).distinct()
    _, must, safe = edit_context.review(tables, [r.path for r in changed.orderBy("path").collect()])
    print(f"Safe to proceed: {'yes' if safe else 'no'}")
    for row in must.orderBy("kind", "message").limit(25).collect():
        print(row.kind, row.message, sep="\t")
    for row in search.nearby_tests(changed, tables["files"]).orderBy("test").limit(25).collect():
        print(row.command)
    return 0


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("graphloom")
    commands = parser.add_subparsers(dest="command", required=True)

    def scanning(one: argparse.ArgumentParser) -> None:
        one.add_argument("--config")
        one.add_argument("--coverage")
        one.add_argument("--openapi")
        one.add_argument("--no-git", action="store_true")
        one.add_argument("--max-git-commits", type=int, default=500)
        one.add_argument("--cache-dir")
        one.add_argument("--progress", action="store_true", help="a JSON line on standard error after each phase, and a table of them")

    one = commands.add_parser("scan", help="a repository")
    one.add_argument("root")
    one.add_argument("out")
    scanning(one)
    one = commands.add_parser("scan-project", help="several repositories as one project")
    one.add_argument("out")
    one.add_argument("--repo", action="append", required=True, help="id=/path[:role]")
    scanning(one)
    one = commands.add_parser("init", help="a governance file of a preset")
    one.add_argument("preset", choices=sorted(governance.PRESETS))
    one = commands.add_parser("suggest-boundaries", help="boundary groups by the folders of a scan")
    one.add_argument("path")
    one = commands.add_parser("diff", help="changes between two scans, by kind")
    one.add_argument("before")
    one.add_argument("after")
    one = commands.add_parser("ci", help="gates over a scan")
    one.add_argument("path")
    one.add_argument("--root", help="the repository whose governance file sets gates")
    one.add_argument("--config", help="a governance file that sets gates")
    one.add_argument("--baseline")
    one.add_argument("--min-health", type=int)
    one.add_argument("--max-new-issues", type=int)
    one.add_argument("--min-coverage", type=float)
    one.add_argument("--forbid-breaking", action="store_true")
    one.add_argument("--forbid-boundary", action="store_true")
    one.add_argument("--sarif")
    one = commands.add_parser("review-diff", help="what stands against changed files")
    one.add_argument("path")
    one.add_argument("--file", action="append", default=[])
    one.add_argument("--diff", help="a unified diff")
    one.add_argument("--root", help="a repository whose working tree is asked without a diff")
    one = commands.add_parser("ask", help="a question")
    one.add_argument("path")
    one.add_argument("question")
    one.add_argument("--baseline")
    one = commands.add_parser("mcp", help="tools on standard input")
    one.add_argument("path")
    one.add_argument("--allow-scan", action="store_true")
    return parser


def main(args: list[str] | None = None) -> int:
    opts = _arguments().parse_args(args)
    if opts.command == "init":
        print(json.dumps(governance.preset(opts.preset), indent=2))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if opts.command in ("scan", "scan-project"):
        rest = {"config": opts.config, "covered": opts.coverage, "openapi": opts.openapi, "git": not opts.no_git, "most_commits": opts.max_git_commits, "cache": opts.cache_dir, "phases": Phases(lambda line: print(line, file=sys.stderr, flush=True)) if opts.progress else None}
        if opts.command == "scan":
            scan(spark, opts.root, opts.out, **rest)
        else:
            scan_project(spark, [binding(x) for x in opts.repo], opts.out, **rest)
        print(_summary(spark, opts.out))
        return 0
    if opts.command == "suggest-boundaries":
        groups = load(spark, opts.path)["files"].where(F.instr("path", "/") > 0).select(prefix_group(F.col("path")).alias("g")).distinct().orderBy("g").limit(1000)
        print(reports.boundary_suggestion([r.g for r in groups.collect()]), end="")
        return 0
    if opts.command == "diff":
        for row in diff.change_counts(diff.diff(load(spark, opts.before), load(spark, opts.after))).orderBy("kind").collect():
            print(row.kind, row.n, sep="\t")
        return 0
    if opts.command == "ci":
        return _ci(spark, opts)
    if opts.command == "review-diff":
        return _review(spark, opts)
    if opts.command == "mcp":
        from graphloom.server import Server

        Server(spark, opts.path, opts.allow_scan).serve()
        return 0
    tables = load(spark, opts.path)
    tables["breaking"] = diff.breaking(load(spark, opts.baseline), tables) if opts.baseline else tables["issues"].where("false").select("kind", "severity", "message", "nodes")
    tool, answer = search.ask(opts.question, tables)
    print(tool)
    for row in answer.limit(25).collect():
        print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
