"""Folder walk, facts cache, store of snapshots, projects of several repositories, and their commands."""

import json
import os

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.operators import diff, rules
from graphloom.plans import analyze, projects
from graphloom.sources import coverage, files, governance, python_facts, report, ts_facts, walk
from graphloom.sources.cache import FactsCache
from graphloom.storage import Store

WEB = {"web/users.tsx": "export function Users() {\n  api.get('/api/users/');\n  return <b>x</b>;\n}\n", "web/other.tsx": "export const Users = () => <i/>;\n"}
API = {"manage.py": "", "conf/settings.py": "ROOT_URLCONF = 'conf.urls'\n", "conf/urls.py": "urlpatterns = [path('api/', include('app.urls'))]\n", "app/urls.py": "router.register('users', UserViewSet)\n", "app/views.py": "class UserViewSet(viewsets.ModelViewSet):\n    pass\ndef help_me(a):\n    return 1 if a else 2\n"}


def put(root, texts):
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_walk_opens_no_ignored_folder(tmp_path, monkeypatch):
    put(tmp_path, {".gitignore": "", ".env": "X=1", ".github/w.yml": "a", "src/a.ts": "a", "src/node_modules/b.js": "b", ".git/c": "c", "deep/er/dist/d.js": "d", "gen/e.ts": "e", "src/f.pyc": "f"})
    os.symlink(tmp_path / "src", tmp_path / "link")
    patterns = [p for line in (*files.DEFAULT_IGNORES, "gen") if (p := files.ignore_regex(line))]
    opened, scandir = [], os.scandir
    monkeypatch.setattr(walk.os, "scandir", lambda path: opened.append(os.path.relpath(path, tmp_path)) or scandir(path))
    monkeypatch.setattr(walk, "PARTS", 3)
    reader = walk.Reader(str(tmp_path), patterns)
    found = sorted(path for part in reader.partitions() for path in reader.files(part))
    assert found == [".env", ".github/w.yml", ".gitignore", "src/a.ts"]
    assert not {p for p in opened if any(x in p for x in ("node_modules", ".git/", "dist", "gen", "link"))} and ".git" not in opened


def test_scan_reads_dotfiles_through_spark(spark, tmp_path):
    put(tmp_path / "app", {".env": "API_TOKEN=abcd1234efgh5678\n", "a/b/c.py": "x = 1\n", "node_modules/x.js": "1", "empty.ts": ""})
    found = {r.path: (r.category, r.lines, r.scan_ord) for r in files.scan(spark, str(tmp_path / "app")).collect()}
    assert found == {".env": ("env", 2, 1), "a/b/c.py": ("python", 2, 2), "empty.ts": ("typescript", 0, 3)}


def test_second_scan_parses_what_changed(spark, tmp_path):
    root = put(tmp_path / "app", WEB | API)
    cache = FactsCache(spark, str(tmp_path / "cache"))

    def agree():
        found = files.scan(spark, root)
        for source in (ts_facts, python_facts):
            rows = [sorted(map(str, analyze.facts(source, found, c).collect())) for c in (cache, None)]
            assert rows[0] == rows[1] and rows[0]

    parsed = lambda: {n: sorted(r.path for r in cache.store.latest(n)[0][1]["facts"].where("parsed").select("path").collect()) for n in ("ts_facts", "python_facts")}
    agree()
    assert parsed() == {"ts_facts": ["web/other.tsx", "web/users.tsx"], "python_facts": sorted(p for p in API if p.endswith(".py"))}
    put(tmp_path / "app", {"app/views.py": API["app/views.py"] + "def more():\n    return help_me(1)\n"})
    os.remove(tmp_path / "app" / "web" / "other.tsx")
    agree()
    assert parsed() == {"ts_facts": [], "python_facts": ["app/views.py"]}
    assert cache.store.latest("ts_facts")[0][1]["facts"].count() == 1


def test_store_publishes_whole_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.latest() == [] and store.runs().count() == 0 and store.metrics().count() == 0
    rows = lambda n: {"nodes": spark.range(n), "edges": spark.range(2 * n)}
    store.commit(rows(1), scan_id="a", metrics={"health": 90, "issues": 3}, finished_at="2024-01-01")
    store.commit(rows(2), scan_id="b", metrics={"health": 80}, finished_at="2024-01-02")
    broken = rows(3) | {"nodes": spark.range(3).selectExpr("raise_error('killed') AS id")}
    with pytest.raises(Exception, match="killed"):
        store.commit({"edges": broken["edges"], "nodes": broken["nodes"]}, scan_id="c")
    store.fail("no memory", scan_id="d", finished_at="2024-01-04")
    (scan, tables), = store.latest()
    assert scan == "b" and tables["nodes"].count() == 2 and tables["edges"].count() == 4
    assert [s for s, _ in store.latest(before="b")] == ["a"] and store.latest("other") == []
    assert {(r.scan_id, r.kind, r.message) for r in store.runs().collect()} == {("a", "success", None), ("b", "success", None), ("d", "error", "no memory")}
    assert store.prune(1) == 1 and store.prune(1) == 0
    assert [s for s, _ in store.latest(n=5)] == ["b"]
    assert {(r.scan_id, r.health, r.issues) for r in store.metrics().collect()} == {("a", 90.0, 3.0), ("b", 80.0, None)}
    assert len(os.listdir(tmp_path / "store" / "data")) == 2  # b, and what the killed writer left


def test_repositories_link_across(spark, tmp_path):
    repos = [projects.Repo("Web App", put(tmp_path / "w", WEB), "web", "frontend"), projects.Repo("api", put(tmp_path / "a", API | {"web/users.tsx": "export const Users = () => <b/>;\n"}), "api", "backend")]
    reports = {"api": spark.createDataFrame([("x.info", "SF:app/views.py\nDA:1,1\nDA:2,0\nend_of_record\n")], "report string, content string")}
    commits = {"api": spark.createDataFrame([("c1", 1, "A", "t", "app/views.py"), ("c1", 1, "A", "t", "gone.py")], "commit_id string, commit_ord long, author string, ts string, file string")}
    found = projects.analyze_repos(spark, repos, rules.Config(), commits, reports)
    edges = {(r.kind, r.src, r.dst) for r in found.edges.collect()}
    assert ("CALLS", "Component:web-app/web/users.tsx#Users", "APIEndpoint:api/GET /api/users/") in edges
    assert ("EXPOSES", "ViewSet:api/app/views.py#UserViewSet", "APIEndpoint:api/GET /api/users/") in edges
    nodes = {r.id: r for r in found.nodes.collect()}
    assert nodes["File:web-app/web/users.tsx"].name == "web-app/web/users.tsx" and nodes["APIEndpoint:api/GET /api/users/"].name == "GET /api/users/"
    assert {"Component:web-app/web/users.tsx#Users", "Component:web-app/web/other.tsx#Users", "Component:api/web/users.tsx#Users"} <= set(nodes)
    assert [(r.file, r.total, r.covered) for r in found.extra["coverage"].collect()] == [("api/app/views.py", 2, 1)]
    assert [(r.file, r.commits) for r in found.extra["churn"].collect()] == [("api/app/views.py", 1)]
    assert not any(r.kind == "DANGLING_API_CALL" for r in found.issues.collect())
    for bad in ([], [projects.Repo("--")], [projects.Repo("a b"), projects.Repo("A-B")]):
        with pytest.raises(ValueError):
            projects.checked(bad)


def test_coverage_is_found_and_matched(spark, tmp_path):
    root = put(tmp_path / "r", {"coverage/coverage-final.json": json.dumps({f"{tmp_path}/r/src/index.ts": {"s": {"0": 1, "1": 0}}})})
    assert [(r.file, r.total) for r in coverage.read_any(coverage.find(spark, root)).collect()] == [("src/index.ts", 2)]
    assert coverage.find(spark, str(tmp_path)).count() == 0 and coverage.find(spark, root, "none.info").count() == 0


def test_commands(spark, tmp_path, capsys):
    web, api, out = put(tmp_path / "w", WEB), put(tmp_path / "a", API), str(tmp_path / "out")
    put(tmp_path / "a", {"lcov.info": "SF:app/views.py\nDA:1,1\nDA:2,0\n", ".graphloom.json": json.dumps({"ci": {"gates": {"minCoveragePct": 80, "minHealth": 10}}})})
    assert cli.main(["scan", api, out, "--coverage", "lcov.info", "--cache-dir", str(tmp_path / "c"), "--no-git"]) == 0
    assert "Health" in capsys.readouterr().out
    assert cli.main(["ci", out, "--root", api]) == 1
    assert "Coverage 50.0% is below required 80%" in capsys.readouterr().out
    assert cli.main(["ci", out, "--root", api, "--min-coverage", "40"]) == 0
    capsys.readouterr()
    assert cli.main(["suggest-boundaries", out]) == 0
    assert "id: app" in capsys.readouterr().out
    assert cli.main(["scan-project", str(tmp_path / "both"), "--repo", f"web={web}:frontend", "--repo", f"api={api}:backend", "--no-git"]) == 0
    kinds = {r.dst for r in spark.read.parquet(str(tmp_path / "both" / "edges")).where("kind = 'CALLS'").collect()}
    assert "APIEndpoint:api/GET /api/users/" in kinds
    (tmp_path / "d.diff").write_text("diff --git a/app/views.py b/app/views.py\n+++ b/app/views.py\n")
    capsys.readouterr()
    assert cli.main(["review-diff", out, "--diff", str(tmp_path / "d.diff")]) == 0
    assert "Safe to proceed" in capsys.readouterr().out
    assert cli.binding("x=/a/b:odd") == projects.Repo("x", "/a/b:odd", "x") and cli.binding("x=/a:backend").role == "backend"
    with pytest.raises(ValueError):
        cli.binding("x")
    assert governance.load_first(spark, [web, api]).gates == {"min_coverage": 80, "min_health": 10}


def test_reports_from_elsewhere(spark, tmp_path):
    node = {"id": "n", "kind": "Page", "name": "N", "loc": {"file": "a.ts", "line": 3}, "meta": {"b": [{"y": 1, "x": [None, 2.5]}], "a": {"deep": True}}}
    whole = {"schemaVersion": 4, "project": {"name": "", "root": "/w/My Shop/", "stack": ["django", "react"]}, "nodes": [node, {"id": "m", "kind": "Page", "name": "M"}], "edges": [{"id": "e", "from": "n", "to": "m", "kind": "USES"}], "issues": [{"kind": "DEAD_CODE", "severity": "low", "message": "x", "nodes": ["n"], "candidate": True}], "scores": {"health": 1}}

    def saved(name, change):
        body = json.loads(json.dumps(whole))
        change(body)
        (tmp_path / name).write_text(json.dumps(body, indent=1))
        return report.read(spark, str(tmp_path / name))

    same = saved("a.json", lambda r: None)
    assert [tuple(r) for r in same["repos"].collect()] == [("my-shop", "My Shop", "/w/My Shop/", "frontend", ["django", "react"])]
    assert same["project"].first().name == "Imported report"
    assert [(r.id, r.file, r.line, r.ord) for r in same["nodes"].orderBy("ord").collect()] == [("n", "a.ts", 3, 0), ("m", None, None, 1)]
    assert same["nodes"].select(diff.stable(same["nodes"]).alias("t")).first().t == '{"a":{"deep":true},"b":[{"x":[null,2.5],"y":1}]}'
    assert saved("r.json", lambda r: r["project"].update(repos=[{"id": "A B", "name": "a", "root": "/a", "role": "backend", "stack": []}]))["repos"].first().id == "a-b"

    def kinds(change):
        return sorted(r.kind for r in diff.diff(same, saved("b.json", change)).collect())

    assert kinds(lambda r: r["nodes"][0].update(meta=dict(reversed(node["meta"].items())))) == []
    assert kinds(lambda r: r["nodes"][0]["meta"]["b"][0]["x"].reverse()) == ["node_changed"]
    assert kinds(lambda r: r["nodes"][0]["meta"].update(c=None)) == ["node_changed"]
    assert kinds(lambda r: r["nodes"][1].update(meta={})) == ["node_changed"]
    assert kinds(lambda r: r.update(nodes=[], issues=[])) == ["issue_removed", "node_removed", "node_removed"]

    flat = spark.createDataFrame([("k", "A", "a", None, None, {"z": "1", "b": None})], "id string, kind string, name string, file string, line int, meta map<string,string>")
    said = flat.withColumn("meta", F.lit('{"b": null, "z": "1"}'))
    assert diff.changes(flat, said, "node", diff.node_label(), content=diff.node_content).count() == 0
    assert diff.changes(flat, said.withColumn("meta", F.lit("{oops")), "node", diff.node_label(), content=diff.node_content).count() == 1

    store = Store(spark, str(tmp_path / "store"))
    report.imported(store, str(tmp_path / "a.json"), "shop")
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception, match="(?i)malformed"):
        report.imported(store, str(tmp_path / "bad.json"), "shop")
    held = store.latest("shop")[0][1]
    assert held["nodes"].count() == 2 and diff.diff(held, same).count() == 0
