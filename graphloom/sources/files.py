"""Repository files (SRC-01..05, SRC-14..18): listed and read by Spark, ignored and classified by columns."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import basename, category, dirname, line_count
from graphloom.operators.graph import Steps
from graphloom.sources import walk

#: What is never scanned.
DEFAULT_IGNORES = (".git/", "node_modules/", ".venv/", "venv/", "__pycache__/", ".next/", "dist/", "build/", "out/", "coverage/", ".turbo/", ".pytest_cache/", "*.pyc")


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """SRC-02: (regex over a relative path, keeps) of one gitignore line; None for blanks and comments.

    A pattern with a slash before its end is anchored at the root, others fit at any depth; what lies
    below a match is matched too; a trailing slash fits folders only.
    """
    line = pattern.rstrip("\n").strip()
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[1:] if keeps else line
    only_folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    body, i = "", 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            body, i = body + "(?:[^/]+/)*", i + 3
        elif line.startswith("**", i):
            body, i = body + ".*", i + 2
        elif line[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif line[i] == "?":
            body, i = body + "[^/]", i + 1
        else:
            body, i = body + re.escape(line[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_folder else '(?:/.*)?'}$", keeps


def ignored(path: Column, lines: Sequence[str] = ()) -> Column:
    """SRC-02: the last pattern that fits decides."""
    out = F.lit(False)
    for pattern in (*DEFAULT_IGNORES, *lines):
        if compiled := ignore_regex(pattern):
            out = F.when(path.rlike(compiled[0]), F.lit(not compiled[1])).otherwise(out)
    return out


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of one small file on any Hadoop file system, or None. Spark's readers pass over names with a dot
    in front, so settings files are opened directly."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isFile():
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def local_folder(root: str) -> str | None:
    """The folder of a path without a scheme, or with that of local files; None for other file systems."""
    bare = root.partition(":")[2] if root.startswith("file:") else root
    return None if "://" in bare else "/" + bare.lstrip("/") if root.startswith("file:") else bare


def scan(spark: SparkSession, root: str, gitignore: Sequence[str] = ()) -> DataFrame:
    """SRC-01, SRC-03, SRC-05: (path, category, content, lines, scan_ord) of the files kept, by path.

    A folder of a mounted file system is walked in tasks, and ignored folders are not opened. On any other file system
    Spark lists all names, but for those with a dot in front, and a filter stands before the contents. The root's own .gitignore
    is read first; `gitignore` adds lines. Paths are numbered apart from their contents.
    """
    lines = [*DEFAULT_IGNORES, *(read_small(spark, root.rstrip("/") + "/.gitignore") or "").split("\n"), *gitignore]
    folder = local_folder(root)
    if folder is not None:
        kept = walk.read(spark, folder, [c for line in lines if (c := ignore_regex(line))])
    else:
        base = root.rstrip("/").rpartition("/")[2]
        path = F.regexp_extract("path", ".*?/" + re.escape(base) + "/(.*)$", 1)
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        kept = listed.select(path.alias("path"), "content").where((F.col("path") != "") & ~ignored(F.col("path"), lines))
    text = F.col("content").cast("string")
    return numbered(kept.select("path", category(F.col("path")).alias("category"), text.alias("content"), line_count(text).alias("lines")))


def numbered(files: DataFrame) -> DataFrame:
    """SRT-01: files with scan_ord, their place by path from 1. Paths alone are sorted, by ranges, so that no task
    sorts them all; the sorted table is written, so that a range is the same whenever it is read."""
    spark = files.sparkSession
    kept = Steps(spark, "numbered")
    ranged = kept.put(files.select("path").repartitionByRange("path").withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    base = (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_base")
    own = F.row_number().over(Window.partitionBy("_range").orderBy("path"))
    ranks = ranged.join(sizes.select("_range", base), "_range").select("path", (F.col("_base") + own).cast("long").alias("scan_ord"))
    return files.join(ranks, "path")


def stack(files: DataFrame) -> DataFrame:
    """SRC-04: one row, the sorted tags of a repository's files (path, content)."""
    base = basename(F.col("path"))
    first = lambda fits: F.min_by(F.when(fits, F.col("content")), F.when(fits, F.col("path")))
    facts = files.agg(
        first(base == "package.json").alias("manifest"),
        F.lower(F.coalesce(first(base.isin("requirements.txt", "pyproject.toml")), F.lit(""))).alias("needs"),
        F.bool_or(F.lower("path").rlike(r"\.tsx?$")).alias("ts"),
        F.bool_or(base.rlike(r"^vite\.config\.(js|ts|mjs|cjs)$")).alias("vite"),
        F.bool_or(base.rlike(r"^next\.config\.(js|ts|mjs|cjs)$")).alias("next"),
        F.bool_or(base.isin("manage.py", "settings.py")).alias("django"),
        F.bool_or((base == "Dockerfile") | F.lower(base).rlike(r"^(docker-)?compose\.ya?ml$")).alias("docker"),
    )
    parsed = F.from_json("manifest", "dependencies map<string,string>, devDependencies map<string,string>")
    names = F.concat(*[F.coalesce(F.map_keys(parsed[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])
    has = lambda *n: F.arrays_overlap(names, F.array(*[F.lit(x) for x in n]))
    tags = {"typescript": F.col("ts"), "react": has("react"), "express": has("express"), "nest": has("@nestjs/common", "@nestjs/core"), "vite": has("vite") | F.col("vite"), "cra": has("react-scripts"), "next.js": has("next") | F.col("next"), "django": F.col("django") | F.col("needs").contains("django"), "fastapi": F.col("needs").contains("fastapi"), "flask": F.col("needs").rlike("(^|[^a-z])flask"), "docker": F.col("docker")}
    return facts.select(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in tags.items()]))).alias("tags"))


def file_nodes(files: DataFrame) -> DataFrame:
    """PRJ-02."""
    return files.select(F.concat(F.lit("File:"), "path").alias("id"), F.lit("File").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("map<string,string>").alias("meta"), F.col("scan_ord").alias("ord"))


def slug_of(text: str) -> str:
    """FN-21: a repository's id as it stands in paths."""
    return re.sub("[^a-z0-9]+", "-", text.strip().lower()).strip("-")


def workspace_packages(files: DataFrame) -> DataFrame:
    """SRC-14: (name, dir, entry) of every package.json with a name."""
    rows = files.where(basename(F.col("path")) == "package.json").withColumn("p", F.from_json("content", "name string, module string, main string, exports string"))
    dot = F.coalesce(F.get_json_object("content", "$.exports['.'].import"), F.get_json_object("content", "$.exports['.'].default"), F.get_json_object("content", "$.exports['.'].require"))
    return rows.where("p.name is not null").select("p.name", dirname(F.col("path")).alias("dir"), F.coalesce("p.module", "p.main", dot).alias("entry"))


def path_aliases(files: DataFrame) -> DataFrame:
    """SRC-15: (base_url, explicit, pattern, target) of the first tsconfig or jsconfig; comments and commas at ends
    are dropped. explicit: a base URL is set, so bare specifiers resolve below it."""
    clean = F.regexp_replace(F.regexp_replace("content", r"(?m)^\s*//.*$|/\*[\s\S]*?\*/", ""), r",(\s*[}\]])", "$1")
    first = files.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).orderBy(F.desc("path")).limit(1)
    parsed = first.select(F.from_json(clean, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>").alias("c"))
    return parsed.select(F.coalesce("c.compilerOptions.baseUrl", F.lit(".")).alias("base_url"), F.col("c.compilerOptions.baseUrl").isNotNull().alias("explicit"), F.explode_outer("c.compilerOptions.paths").alias("pattern", "targets")).select("base_url", "explicit", "pattern", F.explode_outer("targets").alias("target"))


def changed_paths(diffs: DataFrame, column: str = "text") -> DataFrame:
    """SRC-16, SET-09: distinct paths that unified diffs name, sorted."""
    heads = F.regexp_extract_all(F.col(column), F.lit(r"(?m)^diff --git a/.*? b/(.+)$"), 1)
    news = F.regexp_extract_all(F.col(column), F.lit(r"(?m)^\+\+\+ b/(.+)$"), 1)
    return diffs.select(F.explode(F.concat(heads, news)).alias("path")).where("path <> '/dev/null'").distinct().orderBy("path")


def _git(root: str, *args: str, timeout: float = 5) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def git_log(spark: SparkSession, root: str, most: int = 500) -> DataFrame:
    """SRC-06, WIN-06: (commit_id, commit_ord, author, ts, file), newest first; no repository, no rows.

    The driver asks git for at most `most` commits; each header holds for the file lines after it.
    """
    text = _git(root, "log", f"--max-count={most}", "--date=iso-strict", "--format=%x01%H%x02%an%x02%ad", "--name-only") or ""
    rows, head, n = [], None, 0
    for line in text.splitlines():
        if line.startswith("\x01"):
            n, head = n + 1, line[1:].split("\x02")
        elif line.strip() and head:
            rows.append((head[0], n, head[1], head[2], line.strip()))
    return spark.createDataFrame(rows, "commit_id string, commit_ord long, author string, ts string, file string")


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """SRC-17: paths changed in the tree or the index."""
    paths = {p for args in (("diff", "--name-only"), ("diff", "--name-only", "--cached")) for p in (_git(root, *args) or "").splitlines() if p}
    return spark.createDataFrame([(p,) for p in sorted(paths)], "path string")


def git_state(root: str) -> dict:
    """SRC-18: the head commit and whether anything is uncommitted; nulls outside a repository."""
    head, status = _git(root, "rev-parse", "HEAD"), _git(root, "status", "--porcelain")
    return {"head": head.strip() if head else None, "dirty": None if status is None else bool(status.strip())}
