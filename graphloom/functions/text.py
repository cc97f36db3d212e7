"""Scalar functions as column builders (FN-*, PRJ-*): everything stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(kind: str | Column, *parts: str | Column) -> Column:
    """PRJ-01: Kind:part#part."""
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(c(kind), F.lit(":"), F.concat_ws("#", *[c(p) for p in parts]))


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    """PRJ-01: KIND:a->b."""
    return F.concat(kind, F.lit(":"), src, F.lit("->"), dst)


def js_round(x: Column) -> Column:
    """FN-13: half goes up, for negatives too."""
    return F.floor(x + 0.5)


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def js_number(x: Column) -> Column:
    """A number as text: whole ones without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_path(path: Column) -> Column:
    """FN-01: without query and fragment, one slash in front, between and behind."""
    bare = F.regexp_extract(path, r"^[^?#]*", 0)
    led = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.when(bare == "", F.lit("/")).otherwise(F.regexp_replace(F.regexp_replace(led, "/+", "/"), "([^/])$", "$1/"))


def segments(path: Column) -> Column:
    """FN-02."""
    return F.filter(F.split(clean_path(path), "/"), lambda s: s != "")


def is_param(segment: Column) -> Column:
    """FN-03."""
    return segment.rlike(r"^\{[^}]+\}$") | (segment == ":p")


def segments_match(call: Column, route: Column) -> Column:
    """FN-04: as many segments, each equal or a parameter on either side."""
    pairs = F.zip_with(call, route, lambda a, b: (a == b) | is_param(a) | is_param(b))
    return (F.size(call) == F.size(route)) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))


def suffix_match(shorter: Column, longer: Column) -> Column:
    """FN-04: the last segments of the longer path are the shorter path; no segments suit all."""
    n = F.size(shorter)
    tail = F.slice(longer, F.greatest(F.size(longer) - n + 1, F.lit(1)), n)
    return (n <= F.size(longer)) & ((n == 0) | (tail == shorter))


def route_path(path: Column) -> Column:
    """FN-05: one leading slash, none behind, :id as {id}."""
    led = F.regexp_replace(F.concat(F.lit("/"), trimmed(path)), "/+", "/")
    named = F.regexp_replace(led, r":([A-Za-z_][A-Za-z0-9_]*)", r"{$1}")
    return F.when(named == "/", named).otherwise(F.regexp_replace(named, "/$", ""))


def join_path(base: Column, child: Column) -> Column:
    """FN-06."""
    return route_path(F.concat(F.coalesce(base, F.lit("")), F.lit("/"), F.coalesce(child, F.lit(""))))


def typed_params(path: Column) -> Column:
    """FN-07: <int:id> and <id> as {id}."""
    return F.regexp_replace(path, r"<(?:[^:<>]+:)?([^<>]+)>", r"{$1}")


def norm_path(path: Column) -> Column:
    """FN-08: one leading slash, repeats collapsed, a trailing one kept."""
    return F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")


def join_url(base: Column, url: Column) -> Column:
    """PRJ-05."""
    whole = url.rlike("^https?://")
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url)))
    return F.when(whole | base.isNull() | (base == ""), url).otherwise(joined)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """FN-23."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    """FN-23: the file name up to its first dot."""
    return F.substring_index(basename(path), ".", 1)


def bare_name(path: Column) -> Column:
    """FN-23: the file name without what follows its last dot."""
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def is_test(path: Column) -> Column:
    """FN-23."""
    return path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$")


def glob_regex(glob: str) -> str:
    """PRJ-08, FN-16: an anchored pattern; **/ spans folders, * stays within one."""
    glob = re.sub("/+", "/", glob.replace("\\", "/").removeprefix("./"))
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def tidy_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^\\./", ""), "/+", "/")


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | tidy_path(path).rlike(glob_regex(g))
    return F.coalesce(out, F.lit(False))


def slug(x: Column) -> Column:
    """FN-21, PRJ-03."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def report_path(path: Column, root: str = "") -> Column:
    """FN-22."""
    out = tidy_path(path)
    return F.regexp_replace(out, "^" + re.escape(root.rstrip("/")) + "/", "") if root else out


def node_path(kind: Column, name: Column, file: Column, node: Column) -> Column:
    """PRJ-06: the file, a File's name, else the id between its first colon and hash."""
    rest = F.when(F.instr(node, ":") > 0, F.substring_index(F.expr(f"substring({node._jc.toString()}, instr({node._jc.toString()}, ':') + 1)"), "#", 1))
    return F.coalesce(file, F.when(kind == "File", name), rest)


def prefix_group(path: Column) -> Column:
    """FN-27: apps/x, packages/x, services/x, else the first segment."""
    grouped = F.regexp_extract(path, r"^((?:apps|packages|services)/[^/]+)/", 1)
    return F.when(grouped != "", grouped).otherwise(F.substring_index(path, "/", 1))


def mask(value: Column) -> Column:
    """FN-14."""
    return F.when(F.char_length(value) <= 8, F.lit("***")).otherwise(F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4))))


#: What marks a value as no secret.
ALLOWED = ("example", "placeholder", "dummy", "changeme", "not-a-secret", "localhost")


def allowed_secret(value: Column) -> Column:
    """FN-15."""
    low = F.lower(value)
    out = low.rlike("^x+$") | low.rlike("^0+$")
    for word in ALLOWED:
        out = out | low.contains(word)
    return out


def entropy(value: Column) -> Column:
    """AGG-04: bits per character; counts of distinct characters come from set arithmetic in one row."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.char_length(value)
    share = lambda c: (F.size(F.filter(chars, lambda d: d == c)) / n).cast("double")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def search_words(x: Column) -> Column:
    """FN-10."""
    spaced = F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), "[_./:#-]+", " ")
    return F.filter(F.split(F.lower(trimmed(spaced)), r"\s+"), lambda w: w != "")


def _levels(hay: Column, q: Column) -> Column:
    return F.when(hay == q, 100).when(hay.endswith(q), 80).when(hay.contains(q), 60)


def score_text(hay: Column, query: str) -> Column:
    """FN-11: 100 equal, 80 at the end, 60 within; then by words, joined and apart; 60 if all words are there."""
    q = query.strip().lower()
    if not q:
        return F.lit(0)
    words = [w for w in re.sub("[_./:#-]+", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", query)).lower().split() if w]
    out = _levels(F.lower(trimmed(hay)), F.lit(q))
    if words:
        own = search_words(hay)
        phrase, compact = F.array_join(own, " "), F.array_join(own, "")
        p, c = F.lit(" ".join(words)), F.lit("".join(words))
        either = F.greatest(F.coalesce(_levels(phrase, p), F.lit(0)), F.coalesce(_levels(compact, c), F.lit(0)))
        every = F.size(F.array_except(F.array(*[F.lit(w) for w in words]), own)) == 0
        out = F.coalesce(out, F.when(either > 0, either), F.when(every, 60))
    return F.coalesce(out, F.lit(0)).cast("int")


def clamp_percent(x: Column) -> Column:
    """FN-28."""
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(x)))


def quartile(x: Column, most: Column) -> Column:
    """FN-29: 0, else 1 to 4 by the share of the largest."""
    return F.when((x <= 0) | (most <= 0), 0).otherwise(F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(x * 4 / most)))).cast("int")


def tokens_estimate(chars: Column) -> Column:
    """FN-19."""
    return F.ceil(chars / 4)


def url_path(url: Column) -> Column:
    """FN-25."""
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.when(url.startswith("http"), F.when(path == "", F.lit("/")).otherwise(path)).otherwise(url)


def category(path: Column) -> Column:
    """SRC-03: docker, env, typescript, python, config or other."""
    low = F.lower(basename(path))
    ext = F.when(F.instr(low, ".") > 0, F.concat(F.lit("."), F.substring_index(low, ".", -1))).otherwise("")
    return (
        F.when((low == "dockerfile") | low.startswith("dockerfile.") | low.rlike(r"^(docker-)?compose\.ya?ml$"), "docker")
        .when(low.startswith(".env"), "env")
        .when(ext.isin(".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "typescript")
        .when(ext == ".py", "python")
        .when(ext.isin(".json", ".toml", ".yaml", ".yml", ".ini", ".cfg"), "config")
        .otherwise("other")
    )


def line_count(content: Column) -> Column:
    """SRC-05."""
    return F.when(content.isNull() | (content == ""), 0).otherwise(F.size(F.split(content, "\n", -1))).cast("int")
