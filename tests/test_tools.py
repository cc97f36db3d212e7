"""Edit context, server and registered view sets."""

import io
import json

from graphloom import server
from graphloom.plans import edit_context
from graphloom.sources import python_facts


def tables(spark):
    nodes = spark.createDataFrame([("Function:a.ts#f", "Function", "f", "a.ts", 3, None, 0), ("Function:b.py#g", "Function", "g", "b.py", 1, None, 1), ("File:a.test.ts", "File", "a.test.ts", "a.test.ts", None, None, 2)], "id string, kind string, name string, file string, line int, meta map<string,string>, ord long")
    edges = spark.createDataFrame([("CALLS:1", "Function:b.py#g", "Function:a.ts#f", "CALLS", None, None, 0)], "id string, src string, dst string, kind string, confidence string, meta map<string,string>, ord long")
    issues = spark.createDataFrame([("SECRET_CANDIDATE", "high", "s", ["Function:a.ts#f"], True, None)], "kind string, severity string, message string, nodes array<string>, candidate boolean, meta map<string,string>")
    files = spark.createDataFrame([("a.ts", "python", "x\ntoken = 'q'\ndef f(): pass\n" + "y\n" * 90), ("a.test.ts", "python", "t")], "path string, category string, content string")
    return {"nodes": nodes, "edges": edges, "issues": issues, "files": files, "hotspots": spark.createDataFrame([("Function:a.ts#f",)], "node_id string")}


def test_edit_context(spark):
    context, must, proceed = edit_context.review(tables(spark), ["a.ts"])
    assert {(r.id, r.reason) for r in context["seeds"].collect()} == {("Function:a.ts#f", "file"), ("File:a.test.ts", "test")}
    shown = {(r.file, r.line): r.text for r in context["windows"].collect()}
    assert shown[("a.ts", 2)] == "[redacted]" and ("a.ts", 27) in shown and ("a.ts", 28) not in shown
    assert {r.id for r in context["impact"].collect()} == {"Function:b.py#g"}
    assert not proceed and must.count() == 1
    assert context["savings"].first().bytes > 0
    session = edit_context.Session()
    assert session.stubs([{"a": 1}]) == [{"a": 1}] and "seen" in session.stubs([{"a": 1}])[0]


def test_server_lines(spark):
    own = server.Server(spark)
    own.tables = tables(spark)
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "graph_search", "arguments": {"query": "f"}}}, {"method": "note"}, {"id": 4, "method": "nope"}]
    sink = io.StringIO()
    own.serve(io.StringIO("\n".join(map(json.dumps, lines)) + "\n{\n"), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert len(got) == 5 and "scan_project" not in [t["name"] for t in got[1]["result"]["tools"]]
    assert got[2]["result"]["structuredContent"]["rows"][0]["id"] == "Function:a.ts#f"
    assert got[3]["error"]["code"] == -32601 and got[4]["error"]["code"] == -32700


def test_view_sets_times_methods(spark):
    code = "class U(ModelViewSet): ...\nclass R(ReadOnlyModelViewSet): ...\nrouter.register('users', U)\nrouter.register(r'logs', R)\n"
    facts = python_facts.extract(spark.createDataFrame([("v.py", code)], "path string, content string"))
    got = {(r.method, r.path) for r in python_facts.drf_routes(facts).collect()}
    assert got == {(m, "/users/") for m in ("GET", "POST")} | {(m, "/users/{id}/") for m in ("GET", "PUT", "PATCH", "DELETE")} | {("GET", "/logs/"), ("GET", "/logs/{id}/")}
