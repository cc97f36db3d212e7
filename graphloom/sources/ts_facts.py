"""Facts of TypeScript and JavaScript files (EXT-01..12, EXT-24..27) from tokens and scopes, not from a compiler.

There is no TypeScript parser among the libraries at hand. `scopes` tells code from strings, templates, regular expressions
and the text of elements, and says where brackets and declarations end; facts are patterns over what is code. Positions are
those of the text. Of a variable statement only the first name is followed, and names of qualified types after a colon, an
angle bracket or `as` are known by their capitals.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import dirname, edge_id, join_path, route_path
from graphloom.operators.graph import Steps
from graphloom.sources.parsing import once, parsed
from graphloom.sources.routers import RouterMap, prefixes
from graphloom.sources.scopes import scopes

FACT = "array<struct<fact: string, name: string, owner: string, target: string, extra: string, line: int>>"
SIZE_GUARD = 1_500_000
#: Endings that a module specifier may leave out, in the order in which they are tried.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
IMPORT = re.compile(r"^import\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+([A-Za-z_$][\w$]*))?\s*(?:from\s*)?[\"']([^\"']+)[\"']", re.M)
REEXPORT = re.compile(r"^export\s+(?:\{([^}]*)\}|\*)\s*from\s*[\"']([^\"']+)[\"']", re.M)
DYNAMIC = re.compile(r"(?:(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=[^;\n]*?)?\bimport\(\s*[\"']([^\"']+)[\"']\s*\)")
CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*(?:<[\w$\s.,|&\[\]]*>)?\(")
API = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\.(get|post|put|patch|delete)\s*(?:<[^>(]*>)?\(\s*([\"'`])((?:\\.|(?!\3).)*)\3")
FETCH = re.compile(r"(?<![\w$.])(fetch|ky|got)\(\s*([\"'`])((?:\\.|(?!\2).)*)\2\s*(?:,\s*\{([^}]*)\})?")
AXIOS = re.compile(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*axios\.create\(\s*\{[^}]*?baseURL\s*:\s*[\"'`]([^\"'`]*)[\"'`]", re.S)
TYPE = re.compile(r"^[ \t]*(export\s+)?(?:declare\s+)?(interface|type)\s+([A-Za-z_$][\w$]*)", re.M)
METHOD = re.compile(r"[ \t]*\{")
PROPERTY = re.compile(r"(?<!\.)(?:\?\.|\.)\s*([A-Za-z_][\w$]*)")
QUALIFIED = re.compile(r"(?::|[\w$]<|\bas)\s*[A-Z][\w$]*$")
MEMBER = re.compile(r"(?:readonly\s+)?([\"'])?([A-Za-z_$][\w$]*)(?(1)\1)\??\s*:(?!:)")
#: Property names that are no field reads.
IGNORED_READS = frozenset(("catch", "data", "filter", "finally", "forEach", "get", "json", "length", "map", "post", "push", "reduce", "slice", "then", "toString", "trim"))
CONTEXT = re.compile(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:React\.)?createContext\b")
EXPRESS = re.compile(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(express\(\)|(?:express\.)?Router\()")
EXPRESS_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*\.\s*(use|(?i:get|post|put|patch|delete)|route)\s*(\()")
EXPRESS_VERB = re.compile(r"\s*\.\s*((?i:get|post|put|patch|delete))\s*(\()")
LITERAL = re.compile(r"\s*(?:([\"'])(.*?)\1|`([^`$]*)`)\s*", re.S)
IDENTIFIER = re.compile(r"\s*([A-Za-z_$][\w$]*)\s*")
ROUTE_TAG = re.compile(r"</Route\s*>|<Route\b((?:[^>{]|\{[^}]*\})*?)(/?)>", re.S)
ROUTE_PATH = re.compile(r"\bpath=(?:\{\s*)?([\"'])(.*?)\1", re.S)
ROUTE_ELEMENT = re.compile(r"\belement=\{\s*<([A-Z][\w$]*)")
NEST_CLASS = re.compile(r"@(Controller|Injectable|Module)\(((?:[^()]|\([^()]*\))*)\)\s*(?:@\w+\([^)]*\)\s*)*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)", re.S)
NEST_ROUTE = re.compile(r"@(Get|Post|Put|Patch|Delete)\(\s*(?:([\"'`])(.*?)\2)?[^)]*\)")
#: Where a browser application starts, in the order in which they are tried.
ENTRIES = ("src/main.tsx", "src/main.jsx", "src/index.tsx", "src/index.jsx", "src/main.ts", "src/index.ts", "main.tsx", "index.tsx")
TYPE_REF = re.compile(r"(?::|<|\||&|,|\bas|\bextends)\s*(?:readonly\s+)?([A-Z][\w$]*)")
ANSWER = re.compile(r"(?:const|let|var)\s+(?:([A-Za-z_$][\w$]*)|\{\s*data(?:\s*:\s*([A-Za-z_$][\w$]*))?\s*\})\s*(?::[^=\n]+)?=\s*(?:await\s+)?$")
#: Members of an answer that are no fields.
NO_FIELDS = frozenset(("data", "filter", "forEach", "length", "map", "reduce"))
MADE = re.compile(r"\bfunction\s*\*?\s*$")
HOOK = re.compile(r"use[A-Z]")
USE_CONTEXT = re.compile(r"(?<![\w$])useContext\(\s*([A-Za-z_$][\w$]*)")
THEN = re.compile(r"\s*\.then(\()\s*(?:async\b\s*)?(?:function\b\s*[\w$]*\s*)?\(?\s*([A-Za-z_$][\w$]*)")
ALIAS = re.compile(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*([A-Za-z_$][\w$]*(?:\.data)?)\s*(?=[;\n])")
EQUAL_REF = re.compile(r"=\s*([A-Z][\w$]*)")
DEFAULT = re.compile(r"\bexport\s+default\s+([A-Za-z_$][\w$]*)")
LISTED = re.compile(r"\bexport\s*\{([^}]*)\}(?!\s*from\b)")
#: Texts of which every match of a pattern holds one, so that a file without them is not searched.
NEEDS = {
    IMPORT: ("import",),
    REEXPORT: ("export",),
    DYNAMIC: ("import(",),
    API: (".get", ".post", ".put", ".patch", ".delete"),
    FETCH: ("fetch(", "ky(", "got("),
    AXIOS: ("axios.create(",),
    TYPE: ("interface", "type"),
    CONTEXT: ("createContext",),
    EXPRESS: ("express()", "Router("),
    ROUTE_TAG: ("Route",),
    NEST_CLASS: ("@Controller(", "@Injectable(", "@Module("),
    USE_CONTEXT: ("useContext(",),
    DEFAULT: ("default",),
    LISTED: ("export",),
}
SKIP = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "typeof", "import", "require", "super", "await"))


def _named(group: str | None) -> Iterator[tuple[str, str]]:
    for part in (group or "").split(","):
        words = part.replace("type ", "").split()
        if words:
            yield words[0], words[-1]


def template(url: str) -> tuple[str, bool]:
    """EXT-09: holes of a template become {param}."""
    filled = re.sub(r"\$\{[^}]*\}", "{param}", url)
    return filled, filled != url


def facts_of(text: str | None, most: int | None = None) -> list[dict]:
    if not text or (most is not None and len(text.encode()) > most):
        return []
    seen = scopes(text)
    code, mask = seen.code, seen.mask
    lines = [0] + [m.end() for m in re.finditer("\n", text)]
    rows: list[dict] = []

    def line(at: int) -> int:
        return bisect_right(lines, at)

    def add(fact: str, at: int, name: str = "", owner: str | None = None, target: str | None = None, extra: str | None = None) -> None:
        rows.append({"fact": fact, "name": name, "owner": owner, "target": target, "extra": extra, "line": line(at)})

    def search(pattern: re.Pattern, where: str) -> Iterator[re.Match]:
        return pattern.finditer(where) if any(x in where for x in NEEDS[pattern]) else iter(())

    def in_code(pattern: re.Pattern) -> list[re.Match]:
        """Matches that start in code; what they hold may be a string."""
        return [m for m in search(pattern, code) if mask[m.start()] == code[m.start()]]

    spans = seen.declarations()
    starts = [a for a, *_ in spans]

    def span(at: int) -> tuple[int, int, str | None]:
        i = bisect_right(starts, at) - 1
        return spans[i][:3] if i >= 0 and at < spans[i][1] else (0, len(code), None)

    def owner(at: int) -> str | None:
        return span(at)[2]

    shown = {owner(at) for at, _ in seen.tags}
    for a, b, name, exported, default in spans:
        kind = "Hook" if HOOK.match(name) else "Component" if name[0].isupper() and name in shown else "Function"
        reads = [m[1] for m in PROPERTY.finditer(mask, a, b) if m[1] not in IGNORED_READS and not (m[1][0].isupper() and QUALIFIED.search(mask, max(a, m.start() - 80), m.start()))]
        add("declaration", a, name, target=json.dumps(list(dict.fromkeys(reads))), extra=f"{kind}|{'exported' if exported else ''}|{'default' if default else ''}")
    for m in in_code(IMPORT):
        if m[1] or m[3] or m[2] is None:
            add("import", m.start(), m[1] or m[3] or "", target=m[4], extra="default" if m[1] else "*" if m[3] else "")
        for real, local in _named(m[2]):
            add("import", m.start(), local, target=m[4], extra=real)
    for m in in_code(REEXPORT):
        if m[1] is None:
            add("re_export", m.start(), "*", target=m[2])
        for real, local in _named(m[1]):
            add("re_export", m.start(), local, target=m[2], extra=real)
    for m in in_code(DYNAMIC):
        add("dynamic_import", m.start(), m[1] or "", target=m[2])
    for at, tag in seen.tags:
        if tag[:1].isupper():
            add("provides" if tag.endswith(".Provider") else "jsx", at, tag.removesuffix(".Provider"), owner(at))
    for m in CALL.finditer(mask):
        made = MADE.search(mask[max(0, m.start() - 20) : m.start()]) or METHOD.match(mask, seen.close.get(m.end() - 1, len(mask)) + 1)
        if m[1] not in SKIP and not made:
            add("hook_call" if HOOK.match(m[1]) else "call", m.start(), m[1], owner(m.start()))
    for m in search(USE_CONTEXT, mask):
        add("consumes", m.start(), m[1], owner(m.start()))

    def answered(call: re.Match) -> None:
        """EXT-10: fields read from the answer of a call in its declaration: those of the data, of its aliases,
        and, with less confidence, of the parameter that maps over it; or those that its `then` reads."""
        done = seen.close.get(mask.find("(", call.start()), len(mask)) + 1
        then = THEN.match(mask, done)
        made = ANSWER.search(code[max(0, call.start() - 160) : call.start()])
        if then:
            first, last, roots = then.end(), seen.close.get(then.start(1), len(mask)), [re.escape(then[2]) + r"\.data"]
        elif made:
            first, last = call.end(), span(call.start())[1]
            roots = [re.escape(made[1]) + r"\.data"] if made[1] else [re.escape(made[2] or "data")]
            for m in ALIAS.finditer(mask[first:last]):
                if re.escape(m[2]) in roots:
                    roots.append(re.escape(m[1]))
        else:
            return
        fields: dict[str, tuple[str, int]] = {}
        for root in roots:
            pattern = re.compile(rf"(?<![\w$.]){root}\??\.(?:([A-Za-z_$][\w$]*))(?:(\()\s*(?:async\b\s*)?(?:function\b\s*[\w$]*\s*)?\(?\s*([A-Za-z_$][\w$]*))?")
            reads = []
            for m in pattern.finditer(mask, first, last):
                reads.append(("medium", m[1], m.start()))
                if m[1] == "map" and m[3]:
                    each = re.compile(rf"(?<![\w$.]){re.escape(m[3])}\??\.([A-Za-z_$][\w$]*)")
                    reads += [("low", r[1], r.start()) for r in each.finditer(mask, m.end(), seen.close.get(m.start(2), last))]
            for grade, field, at in reads:
                if field not in NO_FIELDS and (field not in fields or (fields[field][0] == "low" and grade == "medium")):
                    fields[field] = (grade, at)
        for field, (grade, at) in fields.items():
            add("response_field", at, field, owner(call.start()), str(line(call.start())), grade)

    for a, b, name, *_ in spans:
        for ref in sorted({m[1] for m in TYPE_REF.finditer(mask, a, b)}):
            add("type_ref", a, ref, name)
    brackets = sorted(seen.close)
    for m in search(TYPE, mask):
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        if not seen.top(at):
            continue
        head = seen.walk(m.end(), "{=")
        end = seen.close.get(head, len(mask)) + 1 if mask[head : head + 1] == "{" else seen.walk(head + 1, "")
        for ref in sorted({r[1] for r in TYPE_REF.finditer(mask, m.end(), end)} | {r[1] for r in EQUAL_REF.finditer(mask, m.end(), end)}):
            add("type_ref", at, ref, m[3])
        members, around, k = [], [], bisect_right(brackets, m.end() - 1)
        for r in MEMBER.finditer(code, m.end(), end):
            while k < len(brackets) and brackets[k] < r.start():
                while around and seen.close[around[-1]] < brackets[k]:
                    around.pop()
                around.append(brackets[k])
                k += 1
            while around and seen.close[around[-1]] < r.start():
                around.pop()
            before = r.start() - 1
            while mask[before] in " \t":
                before -= 1
            if around and mask[around[-1]] == "{" and mask[before] in "{;,\r\n":
                members.append(r[2])
        add("type", at, m[3], target=json.dumps(list(dict.fromkeys(members))), extra=f"{m[2]}|{'exported' if m[1] else ''}")
    clients, fetches = in_code(API), in_code(FETCH)
    for m in [*clients, *fetches]:
        answered(m)
    for m in clients:
        url, dynamic = template(m[4])
        if url.startswith(("/", "http://", "https://")):
            add("api_call", m.start(), m[1], owner(m.start()), url, f"{m[2].upper()}|{str(dynamic).lower()}")
    for m in fetches:
        url, dynamic = template(m[3])
        method = re.search(r"method\s*:\s*[\"'`](\w+)", m[4] or "")
        if url.startswith(("/", "http://", "https://")):
            add("api_call", m.start(), m[1], owner(m.start()), url, f"{(method[1] if method else 'GET').upper()}|{str(dynamic).lower()}")
    for fact, pattern in (("axios", AXIOS), ("context", CONTEXT)):
        for m in in_code(pattern):
            add(fact, m.start(), m[1], target=m[2] if m.re.groups > 1 else None)
    shown_as = [(m[1], "default") for m in search(DEFAULT, mask)]
    shown_as += [pair for m in search(LISTED, mask) for pair in _named(m[1])]
    for m in in_code(EXPRESS):
        exported = [m[1]] if re.search(r"\bexport\s+$", mask[max(0, m.start() - 20) : m.start()]) else []
        add("express", m.start(), m[1], target=m[2], extra=",".join([*exported, *(name for own, name in shown_as if own == m[1])]))

    def arguments(at: int) -> list[tuple[int, int]]:
        """The spans of what the commas of a bracket part."""
        end = seen.close.get(at, len(mask))
        cuts, i = [at], at + 1
        while i < end:
            if mask[i] in "([{":
                i = seen.close.get(i, end)
            elif mask[i] == ",":
                cuts.append(i)
            i += 1
        return [(a + 1, b) for a, b in zip(cuts, [*cuts[1:], end], strict=True) if code[a + 1 : b].strip()]

    def named(spans_: list[tuple[int, int]]) -> list[str]:
        """The identifiers among arguments and among the members of their arrays."""
        names = []
        for a, b in spans_:
            if m := IDENTIFIER.fullmatch(code, a, b):
                names.append(m[1])
            elif code[a:b].lstrip().startswith("["):
                inner = arguments(code.index("[", a))
                names += [m[1] for x, y in inner if (m := IDENTIFIER.fullmatch(code, x, y))]
        return names

    def literal(spans_: list[tuple[int, int]]) -> str | None:
        m = LITERAL.fullmatch(code, *spans_[0]) if spans_ else None
        return (m[2] or m[3]) if m else None

    for m in EXPRESS_CALL.finditer(mask):
        given, verb = arguments(m.start(3)), m[2]
        path = literal(given)
        if verb == "use":
            if names := named(given[1:] if path else given):
                add("express_use", m.start(), m[1], target=path or "/", extra="USE|" + ",".join(names))
            continue
        rest = given[1:]
        if verb == "route":
            then = EXPRESS_VERB.match(mask, seen.close.get(m.start(3), len(mask)) + 1)
            if not then:
                continue
            verb, rest = then[1], arguments(then.start(2))
        if path:
            add("express_route", m.start(), m[1], target=path, extra=f"{verb.upper()}|{','.join(named(rest))}")
    open_paths: list[str | None] = []
    for m in in_code(ROUTE_TAG):
        if m[1] is None:
            if open_paths:
                open_paths.pop()
            continue
        own, shown = ROUTE_PATH.search(m[1]), ROUTE_ELEMENT.search(m[1])
        if own:
            add("react_route", m.start(), shown[1] if shown else "", target="/".join([p for p in open_paths if p is not None] + [own[2]]))
        if not m[2]:
            open_paths.append(own[2] if own else None)
    nest = in_code(NEST_CLASS)
    for i, m in enumerate(nest):
        body = code[m.end() : nest[i + 1].start() if i + 1 < len(nest) else len(code)]
        literal = re.match(r"\s*([\"'`])(.*?)\1", m[2])
        add("nest_class", m.start(), m[3], target=literal[2] if literal else "", extra={"Controller": "controller", "Injectable": "provider", "Module": "module"}[m[1]])
        if m[1] == "Controller":
            for r in NEST_ROUTE.finditer(body):
                add("nest_route", m.end() + r.start(), m[3], target=r[3] or "", extra=r[1].upper())
            made = re.search(r"\bconstructor\(([^)]*)\)", body)
            for dep in re.findall(r":\s*([A-Za-z_$][\w$]*)", made[1] if made else ""):
                add("nest_dep", m.start(), m[3], target=dep)
        if m[1] == "Module":
            for listed in re.findall(r"\b(?:controllers|providers)\s*:\s*\[([^\]]*)\]", m[2]):
                for member in re.findall(r"(?:^|,)\s*([A-Za-z_$][\w$]*)\s*(?=,|$)", listed):
                    add("nest_member", m.start(), m[3], target=member)
    return rows


def facts_column(content: str = "content", most: int | None = None) -> Column:
    """The facts of each text, as one array."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: facts_of(text, most))

    return F.pandas_udf(run, FACT)(content)


def wanted(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$"))


def rows(held: DataFrame) -> DataFrame:
    """(file, ord, fact, name, owner, target, extra, line) of (path, facts)."""
    found = held.select(F.col("path").alias("file"), F.posexplode("facts").alias("ord", "f"))
    return found.select("file", F.col("ord").cast("long").alias("ord"), "f.*")


def found(files: DataFrame, most: int | None = None) -> DataFrame:
    """The facts of `extract` as a plan; for one use of them, as every further one parses again."""
    return parsed(wanted(files), facts_of, most)


def extract(files: DataFrame, most: int | None = None) -> DataFrame:
    """(file, ord, fact, name, owner, target, extra, line) of script files (path, content), parsed once and written down.
    Files of more than `most` bytes have no facts (EXT-28), as a scan of a repository wants it; by default all have."""
    return once(found(files, most))


@dataclass(frozen=True)
class Modules:
    """What specifiers can name besides relative paths: path aliases (base_url, explicit, pattern, target) and
    packages of the workspace (name, dir, entry)."""

    aliases: DataFrame | None = None
    packages: DataFrame | None = None


def _first(x: Column) -> Column:
    return F.substring_index(x, "/", 1)


def resolve(specifiers: DataFrame, files: DataFrame, modules: Modules | DataFrame = Modules()) -> DataFrame:
    """JOIN-04: (file, target, to): relative and aliased specifiers and packages of the workspace, with the
    first candidate that exists; last, bare ones below an explicit base URL.

    Candidates are rows, and every lookup is an equality join: aliases meet specifiers by their first segment
    (those whose star stands within it by an empty one), packages by their name.
    """
    if isinstance(modules, DataFrame):
        modules = Modules(modules)
    rel = F.when(F.col("target").startswith("."), F.concat_ws("/", F.when(dirname(F.col("file")) != "", dirname(F.col("file"))), "target"))
    start = F.lit(0).cast("long")
    bases = specifiers.select("file", "target", rel.alias("base"), F.lit(0).alias("n"), start.alias("m")).where("base is not null")
    bare = specifiers.where(~F.col("target").startswith("."))
    if modules.aliases is not None:
        star = F.instr("pattern", "*")
        head, tail = F.when(star > 0, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern")), F.when(star > 0, F.substring_index("pattern", "*", -1)).otherwise("")
        named = modules.aliases.where("pattern is not null").select("base_url", F.col("target").alias("goal"), (star > 0).alias("open"), head.alias("head"), tail.alias("tail"), F.xxhash64("pattern", "target").alias("m"))
        named = named.withColumn("key", F.when(F.col("open") & (F.instr("head", "/") == 0), "").otherwise(_first(F.col("head"))))
        rows = bare.withColumn("key", F.explode(F.array(_first(F.col("target")), F.lit("")))).join(named, "key")
        fits = F.when(F.col("open"), F.col("target").startswith(F.col("head")) & F.col("target").endswith(F.col("tail")) & (F.length("target") >= F.length("head") + F.length("tail"))).otherwise(F.col("target") == F.col("head"))
        middle = F.substr(F.col("target"), F.length("head") + 1, F.greatest(F.lit(0), F.length("target") - F.length("head") - F.length("tail")))
        goal = F.when(F.col("open"), F.concat(F.substring_index("goal", "*", 1), middle, F.when(F.instr("goal", "*") > 0, F.substring_index("goal", "*", -1)).otherwise(""))).otherwise(F.col("goal"))
        via = rows.where(fits).select("file", "target", F.concat_ws("/", "base_url", goal).alias("base"), F.lit(1).alias("n"), "m")
        below = bare.join(modules.aliases.where("explicit").select("base_url").distinct(), F.lit(True)).select("file", "target", F.concat_ws("/", "base_url", "target").alias("base"), F.lit(4).alias("n"), start.alias("m"))
        bases = bases.unionByName(via).unionByName(below)
    if modules.packages is not None:
        name = F.when(F.col("target").startswith("@"), F.substring_index("target", "/", 2)).otherwise(_first(F.col("target")))
        rows = bare.withColumn("name", name).join(modules.packages, "name")
        sub = F.substr(F.col("target"), F.length("name") + 2)
        entry = rows.where("target = name and entry is not null").select("file", "target", F.concat_ws("/", "dir", "entry").alias("base"), F.lit(2).alias("n"), start.alias("m"))
        whole = rows.where("target = name").select("file", "target", F.col("dir").alias("base"), F.lit(3).alias("n"), start.alias("m"))
        part = rows.where("target <> name").select("file", "target", F.concat_ws("/", "dir", sub).alias("base"), F.lit(2).alias("n"), start.alias("m"))
        bases = bases.unionByName(entry).unionByName(whole).unionByName(part)
    parts = F.split(F.col("base"), "/")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p.isin(".", ""), s).when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    clean = bases.withColumn("base", F.array_join(folded, "/"))
    path = lambda e: F.regexp_replace(F.concat("base", F.lit(e)), "^/", "")
    tried = clean.select("file", "target", "n", "m", F.posexplode(F.array(*[path(e) for e in ENDINGS])).alias("k", "path"))
    return tried.join(files.select("path"), "path").groupBy("file", "target").agg(F.min_by("path", F.struct("n", "m", "k")).alias("to"))


def import_edges(facts: DataFrame, files: DataFrame, modules: Modules = Modules()) -> DataFrame:
    """JOIN-05: IMPORTS edges between files, dynamic imports and re-exports included."""
    rows = facts.where(F.col("fact").isin("import", "re_export", "dynamic_import")).select("file", "target").distinct()
    ends = resolve(rows, files, modules).where("file <> to").select(F.concat(F.lit("File:"), "file").alias("src"), F.concat(F.lit("File:"), "to").alias("dst")).distinct()
    return ends.select(edge_id(F.lit("IMPORTS"), F.col("src"), F.col("dst")).alias("id"), "src", "dst", F.lit("IMPORTS").alias("kind"))


def exports_closure(facts: DataFrame, files: DataFrame, rounds: int = 10, modules: Modules = Modules()) -> DataFrame:
    """JOIN-06: (file, name, at, real): what a file exports, through barrels of up to ten levels."""
    kept = Steps(facts.sparkSession, "exports")
    own = facts.where("(fact = 'declaration' and extra like '%exported%') or fact in ('type', 'context')").select("file", "name", F.col("file").alias("at"), F.col("name").alias("real"))
    steps = facts.where("fact = 're_export'").select("file", "name", "target", "extra")
    steps = steps.join(resolve(steps.select("file", "target").distinct(), files, modules), ["file", "target"]).select(F.col("file").alias("barrel"), F.col("name").alias("shown"), F.coalesce("extra", F.lit("*")).alias("asked"), "to")
    steps, own = kept.put(steps, "steps"), kept.put(own, "0")
    every, fresh = own, own
    for k in range(1, rounds + 1):
        met = steps.join(fresh, (F.col("to") == F.col("file")) & ((F.col("asked") == F.col("name")) | (F.col("shown") == "*")))
        fresh = kept.put(met.select(F.col("barrel").alias("file"), F.when(F.col("shown") == "*", F.col("name")).otherwise(F.col("shown")).alias("name"), "at", "real").distinct().join(every, ["file", "name"], "left_anti"), str(k))
        if fresh.isEmpty():
            break
        every = every.unionByName(fresh)
    return every


def symbols(facts: DataFrame) -> DataFrame:
    """EXT-01, EXT-07, PRJ-04: nodes of declarations, with the properties that they read, in the order of the text; a default component under pages/ or app/ is a Page."""
    kind, exported, default = F.split("extra", r"\|")[0], F.split("extra", r"\|")[1] == "exported", F.split("extra", r"\|")[2] == "default"
    page = (kind == "Component") & default & F.col("file").rlike(r"(^|/)(pages|app)/")
    kind = F.when(page, "Page").otherwise(kind)
    rows = facts.where("fact = 'declaration'")
    return rows.select(F.concat(kind, F.lit(":"), "file", F.lit("#"), "name").alias("id"), kind.alias("kind"), "name", "file", "line", F.create_map(F.lit("exported"), exported.cast("string"), F.lit("fieldReads"), F.col("target")).alias("meta"), "ord")


def type_symbols(facts: DataFrame) -> DataFrame:
    """EXT-06, EXT-08: nodes of types, with their fields, and of contexts."""
    kind = F.when(F.col("fact") == "type", "Type").otherwise("Context")
    meta = F.when(F.col("fact") == "type", F.create_map(F.lit("exported"), F.col("extra").endswith("exported").cast("string"), F.lit("typeKind"), F.substring_index("extra", "|", 1), F.lit("fields"), F.col("target")))
    return facts.where("fact in ('type', 'context')").select(F.concat(kind, F.lit(":"), "file", F.lit("#"), "name").alias("id"), kind.alias("kind"), "name", "file", "line", meta.alias("meta"), "ord")


def usage_edges(facts: DataFrame, files: DataFrame, modules: Modules = Modules()) -> DataFrame:
    """JOIN-07: RENDERS edges for JSX tags, USES for hooks, CALLS for functions, TYPES for types, PROVIDES and
    CONSUMES for contexts, bound to a declaration of the same file or, through an import, of the file that exports it."""
    nodes = symbols(facts).unionByName(type_symbols(facts))
    uses = facts.where(F.col("fact").isin("jsx", "hook_call", "call", "type_ref", "provides", "consumes") & F.col("owner").isNotNull()).select("file", "owner", "name", "fact").distinct()
    imports = facts.where("fact = 'import'").select("file", "name", "target", "extra").distinct()
    bound = imports.join(resolve(imports.select("file", "target").distinct(), files, modules), ["file", "target"])
    shown = exports_closure(facts, files, modules=modules).select(F.col("file").alias("to"), F.col("name").alias("asked"), "at", "real")
    default = nodes.join(facts.where("fact = 'declaration' and extra like '%default'").select("file", "name"), ["file", "name"], "left_semi").select(F.col("file").alias("to"), F.lit("default").alias("asked"), F.col("file").alias("at"), F.col("name").alias("real"))
    via = bound.withColumn("asked", F.col("extra")).join(shown.unionByName(default), ["to", "asked"]).select("file", "name", "at", "real")
    local = nodes.select("file", "name", F.col("file").alias("at"), F.col("name").alias("real"))
    ends = uses.join(via.unionByName(local).distinct(), ["file", "name"])
    source = nodes.select(F.col("file"), F.col("name").alias("owner"), F.col("id").alias("src"))
    goal = nodes.select(F.col("file").alias("at"), F.col("name").alias("real"), F.col("id").alias("dst"), F.col("kind").alias("to_kind"))
    rows = ends.join(source, ["file", "owner"]).join(goal, ["at", "real"]).where("src <> dst")
    kind = F.when((F.col("fact") == "jsx") & F.col("to_kind").isin("Component", "Page"), "RENDERS").when((F.col("fact") == "hook_call") & (F.col("to_kind") == "Hook"), "USES").when((F.col("fact") == "call") & (F.col("to_kind") == "Function"), "CALLS")
    kind = kind.when((F.col("fact") == "type_ref") & (F.col("to_kind") == "Type"), "TYPES").when((F.col("fact") == "provides") & (F.col("to_kind") == "Context"), "PROVIDES").when((F.col("fact") == "consumes") & (F.col("to_kind") == "Context"), "CONSUMES")
    rows = rows.withColumn("kind", kind).where("kind is not null").select("src", "dst", "kind").distinct()
    return rows.withColumn("id", edge_id(F.col("kind"), F.col("src"), F.col("dst")))


def api_calls(facts: DataFrame) -> DataFrame:
    """EXT-09..12, PRJ-05: calls with their full URL and the fields read from their answers; the base of an axios client is looked up
    by its variable's name in all files, the last one wins."""
    from graphloom.functions.text import join_url

    bases = facts.where("fact = 'axios'").groupBy("name").agg(F.max_by("target", F.struct("file", "ord")).alias("base"))
    nodes = symbols(facts).select("file", F.col("name").alias("owner"), F.col("id").alias("caller"))
    read = F.struct(F.col("name").alias("field"), "line", F.col("extra").alias("confidence"))
    reads = facts.where("fact = 'response_field'").groupBy("file", "owner", F.col("target").cast("int").alias("line")).agg(F.array_sort(F.collect_list(read)).alias("reads"))
    rows = facts.where("fact = 'api_call'").join(bases, "name", "left").join(nodes, ["file", "owner"], "left").join(reads, ["file", "owner", "line"], "left")
    method, dynamic = F.split("extra", r"\|")[0], F.split("extra", r"\|")[1] == "true"
    return rows.select(F.xxhash64("file", "ord").alias("call_ord"), method.alias("method"), F.col("target").alias("url"), F.col("name").alias("client"), dynamic.alias("dynamic"), "line", "file", F.coalesce("caller", F.concat(F.lit("File:"), "file")).alias("caller_id"), join_url(F.col("base"), F.col("target")).alias("full_url"), F.coalesce("reads", F.array().cast("array<struct<field:string,line:int,confidence:string>>")).alias("response_fields"))


def express_map(facts: DataFrame, files: DataFrame, modules: Modules = Modules()) -> RouterMap:
    """EXT-24, JOIN-13, GRF-09: Express applications at /, routers below their mounts, those nobody mounts at /.

    A name is a router of its file or, through an import, the one that the other file exports by the name asked for. The first
    router among the arguments of `use` is mounted; the other names beside it are middleware (without a mounted router
    there is none).
    """
    kept = Steps(facts.sparkSession, "express")
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    verb, names = F.substring_index("extra", "|", 1), split(F.substring_index("extra", "|", -1))
    made = kept.put(facts.where("fact = 'express'").select("file", "name", (F.col("target") == "express()").alias("app"), split(F.col("extra")).alias("shown"), "line", "ord"), "made")
    calls = kept.put(facts.where("fact in ('express_route', 'express_use')").select("fact", "file", "name", verb.alias("method"), F.col("target").alias("path"), names.alias("handlers"), "line", "ord"), "calls")
    asked = calls.select("file", "name").unionByName(calls.where("fact = 'express_use'").select("file", F.explode("handlers").alias("name"))).distinct()
    imports = facts.where("fact = 'import'").select("file", "name", "target", "extra").distinct().join(asked, ["file", "name"], "left_semi")
    bound = imports.join(resolve(imports.select("file", "target").distinct(), files, modules), ["file", "target"])
    exports = made.select(F.col("file").alias("to"), F.explode("shown").alias("extra"), F.col("name").alias("real"))
    local = made.select("file", "name", F.col("file").alias("home"), F.col("name").alias("real"))
    known = kept.put(local.unionByName(bound.join(exports, ["to", "extra"]).select("file", "name", F.col("to").alias("home"), "real")).distinct(), "known")
    placed = calls.join(known, ["file", "name"]).select("fact", F.col("home").alias("parent_file"), F.col("real").alias("parent"), F.col("file").alias("at"), "method", "path", "handlers", "line", "ord")
    args = placed.where("fact = 'express_use'").select("*", F.posexplode("handlers").alias("pos", "arg"))
    child = args.join(known.withColumnsRenamed({"file": "at", "name": "arg"}), ["at", "arg"]).groupBy("at", "ord", "parent_file", "parent", "path").agg(F.min_by(F.struct("home", "real"), "pos").alias("child"))
    child = kept.put(child.select("at", "ord", "parent_file", "parent", "path", F.col("child.home").alias("file"), F.col("child.real").alias("name")), "mounts")
    every = prefixes(made.where("app").select("file", "name", F.lit("/").alias("prefix")), child.select("parent_file", "parent", "file", "name", "path"))
    loose = made.join(every, ["file", "name"], "left_anti").select("file", "name", F.lit("/").alias("prefix"))
    routes = placed.where("fact = 'express_route'").unionByName(placed.where("fact = 'express_use'").join(child, ["at", "ord", "parent_file", "parent"], "left_semi").select(*placed.columns))
    routes = routes.withColumnsRenamed({"parent_file": "file", "parent": "name"}).join(every.unionByName(loose), ["file", "name"])
    routes = routes.select("file", "name", "at", F.lit("express").alias("framework"), "method", join_path(F.col("prefix"), F.col("path")).alias("path"), "handlers", F.lit(None).cast("string").alias("shows"), "line", "ord")
    services = made.select("file", "name", F.lit("express").alias("framework"), F.when(F.col("app"), "app").otherwise("router").alias("type"), (F.size("shown") > 0).alias("exported"), "line", "ord")
    return RouterMap(services, child.select("file", "name", "parent_file", "parent"), routes)


def express_routes(facts: DataFrame, files: DataFrame, modules: Modules = Modules()) -> DataFrame:
    """JOIN-13, JOIN-35: (method, path, handler, file) of Express routes; the handler is the last name given."""
    routes = express_map(facts, files, modules).routes.where("method <> 'USE'")
    return routes.select("method", "path", F.try_element_at("handlers", F.lit(-1)).alias("handler"), F.col("at").alias("file")).distinct()


def _by_name(rows: DataFrame) -> DataFrame:
    """(name, id): one id per name, that of the last file."""
    return rows.groupBy("name").agg(F.max_by("id", F.struct("file", "ord")).alias("id"))


def page_routes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EXT-26, JOIN-15: Route nodes of <Route path> tags, below their ancestors' paths, and RENDERS edges to the
    components they show."""
    rows = facts.where("fact = 'react_route'").withColumn("path", route_path(F.concat(F.lit("/"), "target")))
    node = F.concat(F.lit("Route:"), "file", F.lit("#PAGE "), "path")
    meta = F.create_map(F.lit("framework"), F.lit("react-router"), F.lit("path"), F.col("path"), F.lit("type"), F.lit("page"))
    nodes = rows.select(node.alias("id"), F.lit("Route").alias("kind"), F.concat(F.lit("PAGE "), "path").alias("name"), "file", "line", meta.alias("meta"), "ord")
    shown = _by_name(symbols(facts).where("kind in ('Component', 'Page')").select("name", "id", "file", "ord"))
    ends = rows.join(shown, "name").select(node.alias("src"), F.col("id").alias("dst")).distinct()
    return nodes, ends.select(edge_id(F.lit("RENDERS"), F.col("src"), F.col("dst")).alias("id"), "src", "dst", F.lit("RENDERS").alias("kind"))


def entry_point(files: DataFrame) -> DataFrame:
    """EXT-27: (path) of the first entry candidate that was scanned; no row if there is none."""
    order = F.array_position(F.array(*[F.lit(e) for e in ENTRIES]), F.col("path"))
    return files.where(F.col("path").isin(*ENTRIES)).orderBy(order).limit(1).select("path")


def nest_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EXT-25, JOIN-14, JOIN-35: Service and Route nodes, their edges (members and routes REGISTERED_IN,
    injected types DEPENDS_ON, routes EXPOSES) and linker routes. Names are bound to the last class that has them."""
    found = facts.where("fact = 'nest_class'")
    service = F.concat(F.lit("Service:"), "file", F.lit("#"), "name")
    services = found.select(service.alias("id"), F.lit("Service").alias("kind"), "name", "file", F.create_map(F.lit("framework"), F.lit("nest"), F.lit("type"), F.col("extra")).alias("meta"), "ord")
    named = _by_name(services)
    edge = lambda rows, kind: rows.distinct().select(edge_id(F.lit(kind), F.col("src"), F.col("dst")).alias("id"), "src", "dst", F.lit(kind).alias("kind"))
    ends = lambda fact: facts.where(F.col("fact") == fact).select(service.alias("own"), F.col("target").alias("name")).join(named, "name")
    prefix = found.where("extra = 'controller'").select("file", "name", F.col("target").alias("prefix"))
    path = route_path(F.concat(F.lit("/"), "prefix", F.lit("/"), "target"))
    routes = facts.where("fact = 'nest_route'").join(prefix, ["file", "name"]).select("file", "line", "ord", service.alias("controller"), "name", F.col("extra").alias("method"), path.alias("path"))
    called = F.concat("method", F.lit(" "), "path")
    route, endpoint = F.concat(F.lit("Route:"), "file", F.lit("#"), called), F.concat(F.lit("APIEndpoint:"), called)
    pair = [F.lit("method"), F.col("method"), F.lit("path"), F.col("path")]
    nodes = services.withColumn("line", F.lit(None).cast("int")).unionByName(routes.select(route.alias("id"), F.lit("Route").alias("kind"), called.alias("name"), "file", "line", F.create_map(F.lit("framework"), F.lit("nest"), F.lit("controller"), F.col("name"), *pair).alias("meta"), "ord"))
    points = routes.select(endpoint.alias("id"), F.lit("APIEndpoint").alias("kind"), called.alias("name"), F.lit(None).cast("string").alias("file"), F.create_map(F.lit("source"), F.lit("nest"), *pair).alias("meta"), "ord", F.lit(None).cast("int").alias("line"))
    edges = edge(ends("nest_member").select(F.col("id").alias("src"), F.col("own").alias("dst")), "REGISTERED_IN")
    edges = edges.unionByName(edge(ends("nest_dep").select(F.col("own").alias("src"), F.col("id").alias("dst")), "DEPENDS_ON"))
    edges = edges.unionByName(edge(routes.select(route.alias("src"), F.col("controller").alias("dst")), "REGISTERED_IN"))
    edges = edges.unionByName(edge(routes.select(route.alias("src"), endpoint.alias("dst")), "EXPOSES"))
    return nodes.unionByName(points), edges, routes.select("method", "path", endpoint.alias("endpoint_id")).distinct()
