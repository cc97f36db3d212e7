"""The contract of analyzers (UDX-01, SET-02): a name, the files that it reads, and the tables that it makes of them.

An analyzer whose files a repository lacks does not run; all are asked in one pass. Files are pruned before they are
parsed. What analyzers add follows the built-in facts in the order in which they are listed: the first node or edge of an id stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import edge_id

#: What a parser yields, as mappings of some of these names: `part` is node, edge, call or route.
COLUMNS = ("part", "id", "kind", "name", "src", "dst", "confidence", "method", "url", "line", "meta")
SCHEMA = "part string, id string, kind string, name string, src string, dst string, confidence string, method string, url string, line int, meta map<string,string>, n int"
Parser = Callable[[str, str], Iterable[Mapping]]


@dataclass
class Parts:
    """Tables of an analyzer; None where it makes none. Nodes (id, kind, name, file, line, meta, ord), edges (id, src, dst, kind,
    confidence, meta, ord), calls and routes as the linker wants them; columns may be missing from nodes and edges."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    calls: DataFrame | None = None
    routes: DataFrame | None = None


@dataclass(frozen=True)
class Analyzer:
    name: str
    wanted: Callable[[], Column]
    run: Callable[[DataFrame], Parts]


def by_parser(parse: Parser) -> Callable[[DataFrame], Parts]:
    """An analyzer's run from a function of one file, which yields mappings, as a table function beside the files.

    Nodes need id, kind and name; edges kind, src and dst; calls method and url, and src, their caller, if it is not the
    file; routes method, url and id, their endpoint.
    """

    class Table:
        def eval(self, path: str, content: str) -> Iterator[tuple]:
            if content is not None:
                for n, row in enumerate(parse(path, content)):
                    yield (*[row.get(c) for c in COLUMNS], n)

    def run(files: DataFrame) -> Parts:
        table = F.udtf(Table, returnType=SCHEMA)
        rows = files.select("path", "content").lateralJoin(table(F.col("path").outer(), F.col("content").outer())).drop("content").withColumnRenamed("path", "file")
        at = F.xxhash64("file", "n")
        of = lambda part: rows.where(F.col("part") == part)
        edge = edge_id(F.col("kind"), F.col("src"), F.col("dst"))
        none = lambda fields: F.array().cast(f"array<struct<{fields}>>")
        caller = F.coalesce("src", F.concat(F.lit("File:"), "file"))
        return Parts(
            of("node").select("id", "kind", "name", "file", "line", "meta", at.alias("ord")),
            of("edge").select(edge.alias("id"), "src", "dst", "kind", "confidence", "meta", at.alias("ord")),
            of("call").select(at.alias("call_ord"), F.upper("method").alias("method"), "url", F.col("name").alias("client"), F.lit(False).alias("dynamic"), "line", "file", caller.alias("caller_id"), F.col("url").alias("full_url"), none("field:string,line:int,confidence:string").alias("response_fields")),
            of("route").select(at.alias("route_ord"), F.upper("method").alias("method"), F.col("url").alias("path"), F.col("id").alias("endpoint_id"), none("id:string,name:string").alias("response_fields")),
        )

    return run


def detected(files: DataFrame, analyzers: Sequence[Analyzer]) -> list[Analyzer]:
    """Those that find a file: one aggregate for all of them."""
    if not analyzers:
        return []
    found = files.agg(*[F.bool_or(F.coalesce(a.wanted(), F.lit(False))).alias(f"a{i}") for i, a in enumerate(analyzers)]).first()
    return [a for i, a in enumerate(analyzers) if found[f"a{i}"]]


def results(files: DataFrame, analyzers: Sequence[Analyzer]) -> list[Parts]:
    return [a.run(files.where(a.wanted())) for a in detected(files, analyzers)]
