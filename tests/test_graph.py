"""Graph operators, linker and rules on small inputs whose answers are known."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import diff, graph, history, insights, linker, rules, search
from graphloom.schema import CALLS, COVERAGE, EDGES, ISSUES, NODES, ROUTES


def nodes(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else None, 1, r[4] if len(r) > 4 else None, i) for i, r in enumerate(rows)], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(f"{k}:{a}->{b}", a, b, k, None, None, i) for i, (k, a, b) in enumerate(rows)], EDGES)


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def test_impact_follows_dependents_and_skips_the_start(spark):
    n = nodes(spark, *[(x, "X", x) for x in ("email", "serializer", "viewset", "endpoint", "hook", "page")])
    e = edges(spark, ("USES", "serializer", "email"), ("USES", "viewset", "serializer"), ("EXPOSES", "viewset", "endpoint"), ("CALLS", "hook", "endpoint"), ("USES", "page", "hook"), ("IMPORTS", "other", "email"))
    seeds = spark.createDataFrame([("email",)], "id string")
    # the viewset uses the serializer, so it is affected as well
    assert ids(graph.impact(n, e, seeds)) == {"serializer", "viewset", "endpoint", "hook", "page"}
    assert {r.id: r.impact for r in graph.impact_size(n, e, n.select("id")).collect()}["page"] == 0


def test_impact_ends_on_cycles_and_walks_through_absent_nodes(spark):
    n = nodes(spark, ("a", "X", "a"), ("b", "X", "b"), ("d", "X", "d"))
    e = edges(spark, ("USES", "b", "a"), ("USES", "a", "b"), ("USES", "gone", "b"), ("PROVIDES", "d", "gone"))
    assert ids(graph.impact(n, e, spark.createDataFrame([("a",)], "id string"))) == {"b", "d"}


def test_first_of_an_id_stays(spark):
    a = nodes(spark, ("x", "A", "first"), ("y", "A", "y"))
    b = nodes(spark, ("x", "B", "second"))
    assert {r.id: r.name for r in graph.union_fragments(a, b).collect()} == {"x": "first", "y": "y"}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(38)}
    reach = {(a, b) for a, b in pairs}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in pairs if b == c}
        if more == reach:
            break
        reach = more
    want = {}
    for a in range(25):
        if (a, a) in reach:
            want[str(a)] = min(str(b) for b in range(25) if (a, b) in reach and (b, a) in reach)
    got = {r.id: r.component for r in graph.strongly_connected(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")).collect()}
    assert got == want


def test_loops_end_with_the_whole_answer_or_raise(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEVELS", 2)
    ring = spark.createDataFrame([(str(i), str((i + 1) % 7)) for i in range(7)], "src string, dst string")
    assert {r.id: r.component for r in graph.strongly_connected(ring).collect()} == {str(i): "0" for i in range(7)}
    # paths are contracted, so what takes a round a hop is a line that leads both ways
    ring = spark.createDataFrame([(str(i + a), str(i + b)) for i in range(6) for a, b in ((0, 1), (1, 0))], "src string, dst string")
    assert {r.id: r.component for r in graph.strongly_connected(ring).collect()} == {str(i): "0" for i in range(7)}
    with pytest.raises(RuntimeError):
        graph.strongly_connected(ring, rounds=3)
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(7)], "at string, next string")
    seed = spark.createDataFrame([("0",)], "id string")
    assert {r.id: r.depth for r in graph.reach(chain, seed).collect()} == {str(i): i for i in range(8)}
    with pytest.raises(RuntimeError):
        graph.reach(chain, seed, most=3)


def test_linker_grades(spark):
    calls = spark.createDataFrame(
        [(i, m, u, "api", d, 1, "f", "Hook:f#h", u, [("email", 3, "medium")]) for i, (m, u, d) in enumerate([("GET", "/api/users/", False), ("GET", "/api/users/{param}/", True), ("GET", "/api/users/123/", False), ("POST", "/api/users", False), ("GET", "/other/users/?x=1", False), ("GET", "/", False), ("GET", "/nothing/here", False), ("GET", "/api/users", True)])], CALLS
    )
    routes = spark.createDataFrame([(0, "GET", "/api/users/", "v", "E:list", [("Field:email", "Email")]), (1, "GET", "/api/users/{id}/", "v", "E:one", []), (2, "GET", "users/", "v", "E:tail", [])], ROUTES)
    linked = linker.link(calls, routes)
    got = {r.call_ord: (r.endpoint_id, r.confidence) for r in linked.collect()}
    assert got[0] == ("E:list", "high") and got[1] == ("E:one", "medium") and got[2] == ("E:one", "medium")
    assert got[3] == (None, None) and got[4] == ("E:tail", "low") and got[5] == ("E:list", "low") and got[7] == ("E:list", "medium")
    assert got[6] == (None, None)
    assert {r.dst: r.confidence for r in linker.call_edges(linked).collect()} == {"E:list": "high", "E:one": "medium", "E:tail": "low"}
    assert ids(linker.field_edges(linked), "dst") == {"Field:email"}
    assert sorted(r.meta["url"] for r in linker.dangling_issues(linked).collect()) == ["/api/users", "/nothing/here"]


def test_dead_code_and_its_exceptions(spark):
    n = nodes(spark, ("c1", "Component", "Card", "src/Card.tsx", {"exported": "true"}), ("c2", "Component", "Used", "src/Used.tsx"), ("c3", "Component", "Layout", "app/layout.test.tsx"), ("h", "Hook", "useX", "src/x.ts"), ("h2", "Hook", "register", "src/y.ts"), ("e", "APIEndpoint", "GET /", "app/page.tsx"), ("p", "Page", "P", "p.tsx"))
    e = edges(spark, ("RENDERS", "p", "c2"), ("CALLS", "p", "h"))
    got = {r.nodes[0]: (r.kind, (r.meta or {}).get("confidence")) for r in rules.dead_code(n, e).collect()}
    assert got == {"c1": ("DEAD_CODE", "low"), "h": ("DEAD_CODE", "high"), "e": ("UNUSED_ENDPOINT", None)}
    api = [rules.PublicApi(ids=["e"]), rules.PublicApi(paths=["src/*.tsx"], kinds=["Component"])]
    assert {r.nodes[0] for r in rules.dead_code(n, e, api).collect()} == {"h"}


def test_boundaries_deny_before_allow(spark):
    n = nodes(spark, ("a", "X", "a", "ui/a.ts"), ("b", "X", "b", "db/b.ts"), ("c", "X", "c", "lib/c.ts"), ("d", "X", "d", "none.ts"))
    e = edges(spark, ("IMPORTS", "a", "b"), ("IMPORTS", "a", "c"), ("EXPOSES", "a", "b"), ("USES", "c", "b"), ("USES", "a", "d"))
    groups = {"ui": ["ui/**"], "db": ["db/**"], "lib": ["lib/**"]}
    found = rules.boundary_violations(n, e, groups, [rules.Boundary(["ui"], ["db"], message="no db in ui"), rules.Boundary(["lib"], ["lib"], allow=True), rules.Boundary(["ui"], ["lib"], allow=True)])
    got = {(r.nodes[0], r.nodes[1]): (r.meta["rule"], r.message, r.meta.get("allowedTo")) for r in found.collect()}
    assert got == {("a", "b"): ("deny", "no db in ui", None), ("c", "b"): ("allow", "Boundary violation: lib/c.ts USES db/b.ts", "lib")}
    assert rules.boundary_violations(n, e, {}, []).count() == 0


def test_health_and_ignored_paths(spark):
    rows = [("CIRCULAR_DEPENDENCY", "high", "m", ["f1"], False, None, 0), ("DEAD_CODE", "low", "m", ["f2"], True, {"confidence": "low"}, 1), ("DEAD_CODE", "low", "m", ["e"], True, {"confidence": "high"}, 2), ("DANGLING_API_CALL", "info", "m", [], True, None, 3), ("SECRET_CANDIDATE", "high", "m", ["File:gen/x.ts"], True, None, 4)]
    issues = spark.createDataFrame(rows, ISSUES)
    assert rules.health(issues).first().health == 74
    assert rules.health(issues.where("false")).first().health == 100
    n = nodes(spark, ("f1", "Function", "f", "src/a.ts"), ("f2", "Function", "g", "gen/b.ts"), ("e", "APIEndpoint", "GET /"), ("v", "ViewSet", "v", "gen/v.py"))
    e = edges(spark, ("EXPOSES", "v", "e"))
    kept = rules.filter_ignored(issues.withColumnRenamed("ord", "issue_id"), n, e, ["gen/**"])
    assert {r.issue_id for r in kept.collect()} == {0, 3}


def test_secrets_by_rule_and_column(spark):
    gh = "ghp_" + "a1B2" * 10
    text = f'x\n  api_key = "abc123def456c123"\nexport MY_TOKEN=zzzz9999yyyy8888\n{gh}\npassword: "example-value-123"\nétoken = "abcdefabcdef1234"'
    got = {(r.line, r.col, r.rule, r.preview) for r in insights.secrets(spark.createDataFrame([("f", text)], "file string, content string")).collect()}
    assert (2, 3, "secret-assignment", "abc1...c123") in got
    assert (3, 1, "secret-assignment", "zzzz...8888") in got
    assert (4, 1, "github-token", "ghp_...a1B2") in got
    assert not any(line == 5 for line, *_ in got)
    assert (6, 2, "secret-assignment", "abcd...1234") in got  # edges of words are ASCII


def test_churn_coverage_and_hotspots(spark):
    commits = spark.createDataFrame([("c2", 1, "A", "2024-02", "f.py"), ("c2", 1, "A", "2024-02", "f.py"), ("c1", 2, "A", "2024-01", "f.py"), ("c0", 3, "B", "2023-12", "g.py")], "commit_id string, commit_ord long, author string, ts string, file string")
    churned = insights.churn(commits)
    assert {r.file: (r.commits, r.authors, r.last_commit_at) for r in churned.collect()} == {"f.py": (2, 1, "2024-02"), "g.py": (1, 1, "2023-12")}
    assert insights.churn(commits, 1).count() == 1
    covered = insights.coverage(spark.createDataFrame([("f.py", 3, 2), ("z", 0, 0)], "file string, total long, covered long"))
    assert {r.file: r.pct for r in covered.collect()} == {"f.py": 66.7, "z": None}
    n = nodes(spark, ("a", "Function", "a", "f.py"), ("b", "Function", "b", "g.py"), ("File:f.py", "File", "f.py", "f.py"))
    e = edges(spark, ("CALLS", "b", "a"))
    cx = spark.createDataFrame([("f.py", 20), ("g.py", 1)], "file string, complexity int")
    hot = insights.hotspots(n, e, cx, churned, covered)
    got = {r.node_id: (r.score, r.fan_in, r.impact, r.coverage_pct) for r in hot.collect()}
    assert got == {"a": (42.0, 1, 1, 66.7), "b": (1.0, 0, 0, None)}
    enriched = {r.id: r.meta for r in insights.enrich(n, churned, covered, hot).collect()}
    assert enriched["a"]["hotspotScore"] == "42" and enriched["File:f.py"]["churn"] == "2"
    kinds = {r.kind for r in rules.hotspot_issues(hot).collect()}
    assert kinds == {"COMPLEXITY_HOTSPOT"}


def test_coverage_paths_by_suffix(spark):
    rows = spark.createDataFrame([("/abs/repo/src/a.ts", 1, 1), ("b.ts", 1, 1)], "file string, total long, covered long")
    files = spark.createDataFrame([("src/a.ts", 0), ("x/b.ts", 1), ("b.ts", 2)], "path string, scan_ord long")
    assert {r.file: r.path for r in insights.match_coverage(rows, files).collect()} == {"/abs/repo/src/a.ts": "src/a.ts", "b.ts": "b.ts"}


def test_snapshot_diff_and_breaking_changes(spark):
    def snap(n, e, i):
        return {"nodes": n, "edges": e, "issues": i}

    point = lambda m, p: (f"E:{m}{p}", "APIEndpoint", f"{m} {p}", None, {"method": m, "path": p})
    before = snap(nodes(spark, point("GET", "/api/users/"), ("F", "Field", "email"), ("S", "Serializer", "S")), edges(spark, ("USES", "S", "F")), spark.createDataFrame([], ISSUES))
    gone = spark.createDataFrame([("DANGLING_API_CALL", "info", "m", ["x"], True, {"method": "get", "url": "http://h/api/users/"}, 0)], ISSUES)
    after = snap(nodes(spark, point("POST", "/api/users/"), ("S", "Serializer", "S2")), edges(spark), gone)
    counts = {r.kind: r.n for r in diff.change_counts(diff.diff(before, after)).collect()}
    assert counts == {"node_added": 1, "node_removed": 2, "node_changed": 1, "edge_removed": 1, "issue_added": 1}
    found = {r.kind: r.message for r in diff.breaking(before, after).collect()}
    assert set(found) == {"BREAKING_ENDPOINT_REMOVED", "BREAKING_ROUTE_METHOD_CHANGED", "BREAKING_FIELD_REMOVED"}
    assert found["BREAKING_ROUTE_METHOD_CHANGED"] == "/api/users/ changed methods from GET to POST."


def test_gates(spark):
    facts = spark.createDataFrame([(80, 3, 1, 0, None)], "health int, new_issues int, breaking int, boundary int, coverage double")
    kinds = [r.kind for r in diff.gates(facts, 90, 2, True, True, 50).collect()]
    assert kinds == ["MIN_HEALTH", "MAX_NEW_ISSUES", "BREAKING_CHANGES", "COVERAGE_MISSING"]
    assert diff.gates(facts).count() == 0


def test_search_and_questions(spark):
    n = nodes(spark, ("Hook:a#useUserList", "Hook", "useUserList", "src/a.ts"), ("Model:User", "Model", "User", "m.py"), ("Field:User#email", "Field", "email", "m.py"))
    got = [(r.id, r.score) for r in search.search(n, "user list").collect()]
    assert got[0] == ("Hook:a#useUserList", 80)
    assert search.search(n, "User", kinds=["Model"]).first().confidence == "high"
    assert search.search(n, " ").count() == 0
    assert search.plan_question('what breaks if "User.email" changes')[0] == "check_breaking_changes"
    assert search.plan_question("impact of src/a.ts please") == ("impact_query", "src/a.ts")
    assert search.plan_question("which code is dead")[0] == "find_dead_code"
    assert search.limit_for("brief") == 8 and search.limit_for(token_budget=100) == 3 and search.limit_for(limit=900) == 100
    assert search.limit_for() == 8 and search.limit_for("standard", fallback=12) == 12 and search.limit_for("full", token_budget=5000) == 20 and search.limit_for("standard", limit=0) == 25
    sizes = spark.createDataFrame([(1, 50), (2, 60), (3, 40)], "ord long, n long")
    assert [r.ord for r in search.path_budget(sizes, 100).collect()] == [1, 3]


def test_tests_of_changed_files(spark):
    names = ["src/a.ts", "src/b.test.ts", "src/sub/a.test.ts", "other/deep/a.spec.ts", "src/a.spec.mjs", "a.ts", "a.test.ts", "a.test.js", "x.conf.ts", "x.conf.spec.tsx", "x.test.ts", "pkg/m.py", "pkg/test_m.py"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    ask = lambda *changed: {(r.path, r.test) for r in search.nearby_tests(spark.createDataFrame([(c,) for c in changed], "path string"), files).collect()}
    assert ask("src/a.ts") == {("src/a.ts", "src/sub/a.test.ts"), ("src/a.ts", "src/a.spec.mjs")}
    assert ask("src/b.test.ts", "gone.test.ts") == {("src/b.test.ts", "src/b.test.ts")}
    assert ask("a.ts") == {("a.ts", "a.test.ts")}
    assert ask("x.conf.ts", "pkg/m.py") == {("x.conf.ts", "x.conf.spec.tsx")}


def test_repositories_of_nodes(spark):
    n = spark.createDataFrame([("1", "web/a.ts"), ("2", "frontend/b.ts"), ("3", "api\\c.py"), ("4", "x/y.ts"), ("5", None), ("6", "web"), ("7", "web/sub/d.ts")], "id string, file string")
    repos = spark.createDataFrame([("web/sub", "frontend", 1), ("web", "other", 2), ("api", "backend", 3)], "repo_id string, role string, ord int")
    got = {r.id: r.repo_id for r in search.node_repo(n, repos).collect()}
    assert got == {"1": "web", "2": "web/sub", "3": "api", "7": "web/sub"}
    one = {r.id: r.repo_id for r in search.node_repo(n, repos.where("repo_id = 'web'")).collect()}
    assert one == {k: "web" for k in "123467"}


def test_changes_of_many_snapshots(spark):
    rows = [("p", "s1", "a", 1), ("p", "s1", "b", 1), ("p", "s2", "a", 2), ("p", "s3", "a", 2), ("p", "s3", "b", 1), ("p", "s4", "c", 1), ("q", "t1", "a", 1), ("p", "lost", "a", 9)]
    scans = [("p", s, s) for s in ("s1", "s2", "s3", "s4", "s5")] + [("q", "t1", "t1")]
    found = history.version_changes(spark.createDataFrame(rows, "project_id string, scan_id string, id string, n int"), spark.createDataFrame(scans, "project_id string, scan_id string, finished_at string"), "node", F.col("n"), F.col("n"))
    got = sorted((r.scan_id, r.kind, r.id, r.before, r.after) for r in found.collect())
    assert got == sorted([("s2", "node_changed", "a", 1, 2), ("s2", "node_removed", "b", 1, None), ("s3", "node_added", "b", None, 1), ("s4", "node_removed", "a", 2, None), ("s4", "node_removed", "b", 1, None), ("s4", "node_added", "c", None, 1), ("s5", "node_removed", "c", 1, None)])


def test_candidates_of_many_like_routes_are_few(spark):
    routes = spark.range(10_000).selectExpr("id AS route_ord", "'GET' AS method", "concat('/api/x/y', id, '/', if(id % 2 = 0, '{id}', 'all')) AS path", "CAST(NULL AS STRING) AS viewset_id", "concat('E', id) AS endpoint_id", "CAST(array() AS array<struct<id:string,name:string>>) AS response_fields")
    calls = spark.range(3_000).selectExpr("id AS call_ord", "'GET' AS method", "concat('/api/x/y', id, if(id % 3 = 0, '/{param}', '/7')) AS full_url", "id % 3 = 0 AS dynamic", "'c' AS caller_id")
    assert linker.candidates(calls, routes).count() <= 3_000
    best = {r.call_ord: (r.endpoint_id, r.confidence) for r in linker.link(calls, routes).collect()}
    assert best == {k: (f"E{k}", "medium") if k % 3 == 0 or k % 2 == 0 else (None, None) for k in range(3_000)}
    wide = calls.selectExpr("call_ord", "method", "'/api/x/{param}/{param}' AS full_url", "true AS dynamic", "caller_id")
    assert linker.candidates(wide, routes).count() == 2  # one mask of a call, two of routes
    assert {(r.endpoint_id, r.confidence) for r in linker.link(wide, routes).collect()} == {("E0", "medium")}


def test_large_levels_are_shuffled_alike(spark, monkeypatch):
    rng = random.Random(3)
    e = edges(spark, *[("USES", f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)])
    seeds = spark.createDataFrame([(f"n{k}",) for k in range(10)], "id string")
    plain = {(r.seed, r.id, r.depth) for r in graph.reach(graph.dependents(e), seeds).collect()}
    monkeypatch.setattr(graph, "FEW", 15)
    assert {(r.seed, r.id, r.depth) for r in graph.reach(graph.dependents(e), seeds).collect()} == plain


def test_long_rings_take_few_rounds(spark, monkeypatch):
    ring = [("IMPORTS", f"r{k}", f"r{(k + 1) % 300}") for k in range(300)]
    tail = [("IMPORTS", "r7", "t0"), *[("IMPORTS", f"t{k}", f"t{k + 1}") for k in range(40)], ("IMPORTS", "t40", "x"), ("IMPORTS", "x", "y"), ("IMPORTS", "y", "x"), ("IMPORTS", "t9", "t9")]
    writes, put = [], graph.Steps.put
    monkeypatch.setattr(graph.Steps, "put", lambda self, df, name: writes.append(name) or put(self, df, name))
    got = {r.id: r.component for r in graph.strongly_connected(edges(spark, *ring, *tail)).collect()}
    assert got == {f"r{k}": "r0" for k in range(300)} | {"x": "x", "y": "x", "t9": "t9"}
    assert sum("-gone-" in name for name in writes) < 25
