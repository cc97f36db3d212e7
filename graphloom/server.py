"""A JSON-RPC server on lines of standard input (QRY-13, QRY-14, QRY-16, FN-32): tools over one loaded scan."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from pyspark.sql import DataFrame, SparkSession

from graphloom.cli import load, scan
from graphloom.operators import search
from graphloom.plans.edit_context import Session, prepare_edit


def text(arguments: dict, name: str) -> str | None:
    """A string that is not blank, as it came."""
    value = arguments.get(name)
    return value if isinstance(value, str) and value.strip() else None


def number(arguments: dict, name: str) -> int | None:
    value = arguments.get(name)
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf") else None


class Server:
    """Requests are answered one after another; a tool's rows are bounded by its limit."""

    def __init__(self, spark: SparkSession, path: str | None = None, allow_scan: bool = False):
        self.spark, self.allow_scan, self.session = spark, allow_scan, Session()
        self.tables: dict[str, DataFrame] = load(spark, path) if path else {}
        self.tools: dict[str, tuple[str, Callable[[dict], DataFrame | None]]] = {
            "graph_search": ("nodes by name, id or file", lambda a: search.search(self.tables["nodes"], text(a, "query") or "", limit=search.limit_for(limit=number(a, "limit")))),
            "impact_query": ("what a change affects", lambda a: search.impact_query(self.tables["nodes"], self.tables["edges"], text(a, "nodeId"), text(a, "query"))),
            "find_dead_code": ("unused symbols and endpoints", lambda a: search.dead_code_query(self.tables["issues"], text(a, "confidence"))),
            "get_node_context": ("edges around a node", lambda a: search.context(self.tables["nodes"], self.tables["edges"], text(a, "nodeId") or "")),
            "prepare_edit_context": ("windows to read before an edit", lambda a: prepare_edit(self.tables, [text(a, "nodeId") or ""], query=text(a, "query") or "")["windows"]),
            "load_report": ("switches to another scan", self._load),
        }
        if allow_scan:
            self.tools["scan_project"] = ("scans a folder", self._scan)

    def _load(self, arguments: dict) -> None:
        self.tables = load(self.spark, text(arguments, "path") or "")
        self.session.clear()

    def _scan(self, arguments: dict) -> None:
        scan(self.spark, text(arguments, "root") or "", text(arguments, "out") or "")
        self._load({"path": arguments.get("out")})

    def call(self, name: str, arguments: dict) -> dict:
        found = self.tools[name][1](arguments)
        rows = [] if found is None else [r.asDict(recursive=True) for r in found.limit(search.limit_for(limit=number(arguments, "limit"))).collect()]
        lines = "\n".join("\t".join(str(v) for v in r.values()) for r in rows)
        return {"content": [{"type": "text", "text": lines}], "structuredContent": {"rows": self.session.stubs(rows)}}

    def answer(self, request: dict) -> dict | None:
        if "id" not in request:
            return None
        reply = {"jsonrpc": "2.0", "id": request["id"]}
        method, params = request.get("method"), request.get("params") or {}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object"}} for n, (d, _) in self.tools.items()]}}
        if method == "tools/call" and params.get("name") in self.tools:
            try:
                return reply | {"result": self.call(params["name"], params.get("arguments") or {})}
            except Exception as e:  # a tool's failure is an answer, not the end
                return reply | {"result": {"isError": True, "content": [{"type": "text", "text": str(e)[:500]}]}}
        return reply | {"error": {"code": -32601, "message": f"unknown method or tool: {method}"}}

    def serve(self, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                print(json.dumps(reply, default=str), file=sink, flush=True)
