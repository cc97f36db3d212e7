"""Ranked search and the question tools (FN-10..12, QRY-*, SRT-05..12)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import bare_name, dirname, is_test, score_text
from graphloom.operators.graph import context, impact

#: Most rows by detail (those of `full` depend on the tool), of a budget of tokens, and at all.
DETAIL_ROWS = {"brief": 8, "standard": 25}
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 250, 3, 100


def node_score(query: str) -> Column:
    """FN-12: the best of id, name and file."""
    return F.greatest(score_text(F.col("id"), query), score_text(F.col("name"), query), score_text(F.coalesce("file", F.lit("")), query))


def row_limit(detail: Column, limit: Column, token_budget: Column, fallback: Column) -> Column:
    """SRT-11: the rows of an answer. A limit above zero counts, up to 100; else the tool's own number, cut by
    detail (anything but standard and full is brief) and then by the budget of tokens, which leaves 3."""
    by_detail = F.when(detail == "full", fallback).when(detail == "standard", F.least(fallback, F.lit(DETAIL_ROWS["standard"]))).otherwise(F.least(fallback, F.lit(DETAIL_ROWS["brief"])))
    by_budget = F.when(token_budget > 0, F.greatest(F.lit(LEAST_ROWS), F.least(by_detail, F.floor(token_budget / TOKENS_A_ROW)))).otherwise(by_detail)
    return F.when((limit > 0) & ~F.isnan(limit.cast("double")) & (limit < float("inf")), F.least(F.lit(MOST_ROWS), F.floor(limit))).otherwise(by_budget).cast("int")


def limit_for(detail: str | None = None, limit: float | None = None, token_budget: float | None = None, fallback: int = 25) -> int:
    """SRT-11 for one question."""
    if limit is not None and 0 < limit < float("inf"):
        return min(MOST_ROWS, int(limit))
    rows = fallback if detail == "full" else min(fallback, DETAIL_ROWS.get(detail or "brief", DETAIL_ROWS["brief"]))
    return max(LEAST_ROWS, min(rows, int(token_budget // TOKENS_A_ROW))) if token_budget and token_budget > 0 else rows


def search(nodes: DataFrame, query: str, kinds: Sequence[str] = (), limit: int = 25) -> DataFrame:
    """QRY-01, SRT-05: nodes by score, then id; a top-k, not a sort of all."""
    rows = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    scored = rows.select("id", "kind", "name", "file", node_score(query).alias("score")).where("score > 0")
    grade = F.when(F.col("score") >= 100, "high").when(F.col("score") >= 80, "medium").otherwise("low")
    return scored.withColumn("confidence", grade).orderBy(F.desc("score"), "id").limit(limit)


def best_node(nodes: DataFrame, node_id: str | None = None, query: str | None = None) -> DataFrame:
    """The node of an id, else the first that search finds."""
    if node_id:
        return nodes.where(F.col("id") == node_id).select("id")
    return search(nodes, query or "", limit=1).select("id")


def impact_query(nodes: DataFrame, edges: DataFrame, node_id: str | None = None, query: str | None = None, limit: int = 25) -> DataFrame:
    """QRY-02."""
    return impact(nodes, edges, best_node(nodes, node_id, query)).orderBy("depth", "id").limit(limit)


def dead_code_query(issues: DataFrame, confidence: str | None = None) -> DataFrame:
    """QRY-03, SRT-09: candidates rank medium."""
    rows = issues.where(F.col("kind").isin("DEAD_CODE", "UNUSED_ENDPOINT")).withColumn("confidence", F.when(F.col("candidate"), "medium").otherwise("high"))
    return (rows.where(F.col("confidence") == confidence) if confidence else rows).orderBy("confidence", "message")


def breaking_query(found: DataFrame, issues: DataFrame) -> DataFrame:
    """QRY-04."""
    return found.unionByName(issues.where(F.col("kind").startswith("BREAKING_")).select(*found.columns))


def nearby_tests(changed: DataFrame, files: DataFrame) -> DataFrame:
    """QRY-06, JOIN-29: (path, test, command) of the tests of changed files.

    A test that changed is its own. Those of another file bear its name, without the ending and the mark of a
    test, and lie in its folder or below; at the root, only beside it and in TypeScript. The prefix
    join is an equality: a test offers its name under each folder above it, of which there are few.
    """
    tests = files.where(is_test(F.col("path"))).select(F.col("path").alias("test")).distinct()
    tests = tests.withColumn("name", F.regexp_replace(bare_name(F.col("test")), r"\.(test|spec)$", "")).withColumn("parts", F.split(dirname(F.col("test")), "/"))
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    offered = tests.select("test", "name", F.explode(above).alias("dir")).where((F.col("dir") != "") | F.col("test").rlike(r"^[^/]+\.tsx?$"))
    asked = changed.select("path").distinct()
    own = asked.where(is_test(F.col("path"))).join(tests.select(F.col("test").alias("path")), "path").select("path", F.col("path").alias("test"))
    near = asked.where(~is_test(F.col("path"))).select("path", bare_name(F.col("path")).alias("name"), dirname(F.col("path")).alias("dir")).join(offered, ["name", "dir"])
    return own.unionByName(near.select("path", "test")).withColumn("command", F.concat(F.lit("vitest run "), "test"))


#: Question families in the order in which they are tried, English and Turkish.
FAMILIES = (
    ("check_breaking_changes", r"break|what changed|\bdiff\b|kırıl|bozul"),
    ("impact_query", r"impact|affect|change|depend|etki|değiş"),
    ("find_dead_code", r"dead|unused|remove|ölü|kullanılmayan"),
    ("recommend_tests", r"\btests?\b|verify|\btest\b|doğrula"),
    ("get_node_context", r"context|callers?|neighbo|explain|bağlam"),
)


def plan_question(question: str) -> tuple[str, str]:
    """QRY-07, FN-26: (tool, subject): the first family that fits, else search; the subject is quoted text,
    else the last token that looks like a path, else the question."""
    tool = next((t for t, p in FAMILIES if re.search(p, question, re.IGNORECASE)), "graph_search")
    quoted = re.search(r"[\"'`“]([^\"'`”]+)[\"'`”]", question)
    if quoted:
        return tool, quoted[1]
    paths = [w.strip("?,;!") for w in question.split() if re.search(r"[/#.]", w.strip("?,;!."))]
    return tool, (paths[-1] if paths else question)


def ask(question: str, tables: dict[str, DataFrame]) -> tuple[str, DataFrame]:
    """QRY-07: plans a question and runs its tool over {nodes, edges, issues, breaking, files}."""
    tool, subject = plan_question(question)
    nodes, edges, issues = tables["nodes"], tables["edges"], tables["issues"]
    if tool == "check_breaking_changes":
        return tool, breaking_query(tables["breaking"], issues)
    if tool == "impact_query":
        return tool, impact_query(nodes, edges, query=subject)
    if tool == "find_dead_code":
        return tool, dead_code_query(issues)
    if tool == "recommend_tests":
        return tool, nearby_tests(tables["files"].where(F.col("path").contains(subject)), tables["files"])
    if tool == "get_node_context":
        found = best_node(nodes, query=subject).first()
        return tool, context(nodes, edges, found["id"] if found else "")
    return tool, search(nodes, subject)


def windows(locations: DataFrame, lines: DataFrame, max_windows: int = 8, before: int = 8, after: int = 24) -> DataFrame:
    """QRY-09, PRJ-17: (id, file, line, text) around each location; a file starts at its first line.

    Lines with a secret keyword are masked as a whole.
    """
    own = locations.orderBy("id").limit(max_windows)
    at = F.coalesce("line", F.lit(1))
    spans = own.select("id", "file", F.greatest(F.lit(1), F.when(F.col("kind") == "File", at - 1).otherwise(at - before)).alias("low"), F.when(F.col("kind") == "File", at + 80).otherwise(at + after).alias("high"))
    rows = lines.join(F.broadcast(spans), "file").where(F.col("line").between(F.col("low"), F.col("high")))
    hidden = F.col("text").rlike(r"(?i)(secret|token|api[_-]?key|password|private[_-]?key)\s*[:=]")
    return rows.select("id", "file", "line", F.when(hidden, "[redacted]").otherwise(F.col("text")).alias("text"))


def page(rows: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 25) -> tuple[list, str | None]:
    """SRT-12, QRY-15: a page and the cursor of the next one."""
    found = rows.orderBy(*order).offset(offset).limit(limit + 1).collect()
    return found[:limit], (f"rows:{offset + limit}" if len(found) > limit else None)


def path_budget(sizes: DataFrame, most: int) -> DataFrame:
    """WIN-12: windows (ord, n) taken while they fit; one that doesn't is skipped, not the end.

    The running total depends on what was skipped, so it is one fold over the few windows of an answer.
    """
    step = lambda s, x: F.when(s["used"] + x["n"] <= most, F.struct((s["used"] + x["n"]).alias("used"), F.concat(s["kept"], F.array(x["ord"])).alias("kept"))).otherwise(s)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("n").cast("long").alias("n")))).alias("rows"))
    return listed.select(F.explode(F.aggregate("rows", start, step)["kept"]).alias("ord"))


def savings(files: DataFrame, taken: DataFrame) -> DataFrame:
    """AGG-25, QRY-12: bytes and tokens that windows spare against whole files."""
    whole, part = files.agg(F.sum("n").alias("a")), taken.agg(F.sum("n").alias("b"))
    spared = F.greatest(F.lit(0), F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    return whole.join(F.broadcast(part)).select(spared.cast("long").alias("bytes"), F.ceil(spared / 4).cast("long").alias("tokens"))


def counts(issues: DataFrame, by: str = "kind") -> DataFrame:
    """AGG-13, AGG-14."""
    return issues.groupBy(by).agg(F.count("*").alias("n"))


def kind_histogram(nodes: DataFrame, most: int = 10) -> DataFrame:
    """AGG-15."""
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(most)


def summary(nodes: DataFrame) -> DataFrame:
    """AGG-12."""
    n = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return nodes.agg(n("File", "files"), n("Component", "components"), n("Model", "models"), n("APIEndpoint", "endpoints"))


def api_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JOIN-25, SRT-10: endpoints with what exposes them, the serializer that it uses, the model behind that, and their
    caller with its confidence. Of several edges the first counts; a serializer or model is the first target of its kind.
    An end that is no node keeps its id (exposed_by, caller) and has no name."""
    has = lambda df, c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    meta, words = F.col("meta"), F.split("name", " ")
    place = F.when(F.col("at_line") > 0, F.concat("at_file", F.lit(":"), "at_line")).otherwise(F.col("at_file"))
    points = nodes.where("kind = 'APIEndpoint'").select("id", "name", F.coalesce(meta["method"], words[0]).alias("method"), F.coalesce(meta["path"], F.get(words, F.lit(1)), F.lit("")).alias("path"), meta["source"].alias("source"), has(nodes, "file").alias("at_file"), has(nodes, "line", "int").alias("at_line"))
    points = points.withColumn("location", place).drop("at_file", "at_line")
    named = nodes.select("id", "kind", "name")

    def into(kind: str, end: str) -> DataFrame:
        held = edges.where(F.col("kind") == kind).select(F.col("dst").alias("id"), "src", has(edges, "confidence").alias("confidence"), "ord")
        first = held.groupBy("id").agg(F.min_by(F.struct("src", "confidence"), "ord").alias("e"))
        return first.join(named.select(F.col("id").alias("src"), F.col("name").alias(f"{end}_name")), F.col("e.src") == F.col("src"), "left").select("id", F.col("e.src").alias(end), F.col("e.confidence").alias(f"{end}_confidence"), f"{end}_name")

    def used(source: str, goal: str) -> DataFrame:
        """(from, id, name): the first target of a kind that nodes of another use."""
        ends = named.where(F.col("kind") == goal).select(F.col("id").alias("dst"), F.col("name").alias("goal"))
        rows = edges.where("kind = 'USES'").select("src", "dst", "ord").join(ends, "dst")
        return rows.groupBy(F.col("src").alias(source)).agg(F.min_by(F.struct("dst", "goal"), "ord").alias(goal))

    rows = points.join(into("EXPOSES", "exposed_by"), "id", "left").join(into("CALLS", "caller"), "id", "left")
    rows = rows.withColumn("view", F.when(F.col("exposed_by_name").isNotNull(), F.col("exposed_by"))).join(used("view", "Serializer"), "view", "left")
    rows = rows.withColumn("shown", F.col("Serializer.dst")).join(used("shown", "Model"), "shown", "left")
    out = rows.select("id", "name", "method", "path", "source", "location", "exposed_by", F.col("exposed_by_name").alias("viewset"), F.col("Serializer.goal").alias("serializer"), F.col("Model.goal").alias("model"), "caller", "caller_name", F.col("caller_confidence").alias("confidence"))
    return out.orderBy("path", "method")


#: Up to this many repositories are broadcast to the nodes.
MOST_REPOS = 10_000


def node_repo(nodes: DataFrame, repos: DataFrame) -> DataFrame:
    """JOIN-31: (id, repo_id) of nodes with a file: the first repository (repo_id, role, ord) whose id opens the
    path; else the first whose role does, `other` aside; else the only repository there is. Nodes of none are left out.

    A prefix is what stands before one of a path's slashes, so ids and roles meet paths by equality.
    """
    known = repos.select("repo_id", "role", "ord")
    n = known.count()
    keys = known.select("repo_id", F.explode(F.array(F.struct(F.lit(0).alias("n"), "ord", F.col("repo_id").alias("key")), F.struct(F.lit(1).alias("n"), "ord", F.when(F.col("role") != "other", F.col("role")).alias("key")))).alias("k"))
    first = keys.where("k.key is not null").groupBy(F.col("k.key").alias("key")).agg(F.min(F.struct("k.n", "k.ord", "repo_id")).alias("r"))
    placed = nodes.where("file is not null").select("id", F.split(F.regexp_replace("file", r"\\", "/"), "/").alias("parts"))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("parts") - 1)), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    met = placed.where(F.size("parts") > 1).select("id", F.explode(starts).alias("key")).join(F.broadcast(first) if n <= MOST_REPOS else first, "key")
    best = met.groupBy("id").agg(F.min("r").alias("r")).select("id", F.col("r.repo_id").alias("repo_id"))
    if n != 1:
        return best
    return placed.select("id").distinct().join(F.broadcast(known.select("repo_id"))).select("id", "repo_id")


def rank_within(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def best_seed(seeds: DataFrame) -> DataFrame:
    """WIN-03: per node the seed of highest priority, the first in `ord` (any type that has an order) on ties."""
    place = F.struct(F.col("priority").isNull(), -F.col("priority"), F.col("ord"))
    return seeds.groupBy("id").agg(F.min_by(F.struct("reason", "priority"), place).alias("s")).select("id", "s.*")
