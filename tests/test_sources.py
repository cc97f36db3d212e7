"""Sources, facts, scalars and sinks on small inputs."""

import json
import subprocess

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.sinks import reports
from graphloom.sources import coverage, files, python_facts, routers, services, ts_facts
from graphloom.streaming import snapshots


def test_scan_ignores_and_classifies(spark, tmp_path):
    root = tmp_path / "app"
    for name, body in {"src/a.ts": "x\ny", "node_modules/z/i.js": "1", "sub/dist/o.js": "1", "keep.log": " ", "drop.log": "q", "Dockerfile": "FROM x", "package.json": '{"dependencies": {"react": "1"}}', "requirements.txt": "Flask==1"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    found = files.scan(spark, str(root), ["*.log", "!keep.log"])
    got = {r.path: (r.category, r.lines, r.scan_ord) for r in found.collect()}
    assert got == {"Dockerfile": ("docker", 1, 1), "keep.log": ("other", 1, 2), "package.json": ("config", 1, 3), "requirements.txt": ("other", 1, 4), "src/a.ts": ("typescript", 2, 5)}
    assert files.stack(found).first().tags == ["docker", "flask", "react", "typescript"]


def test_git_log_of_a_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    for k in range(2):
        (tmp_path / "f.py").write_text(str(k))
        run("add", ".")
        run("commit", "-m", str(k))
    rows = files.git_log(spark, str(tmp_path)).collect()
    assert [(r.commit_ord, r.author, r.file) for r in rows] == [(1, "A", "f.py"), (2, "A", "f.py")]
    assert files.git_state(str(tmp_path))["dirty"] is False
    assert files.git_log(spark, str(tmp_path / "none")).count() == 0


def test_coverage_reports(spark):
    rows = [("a.info", "TN:\nSF:x.ts\nDA:1,1\nDA:2,0\nDA:3,1\nend_of_record\nDA:9,9\nSF:y.ts\nDA:1,0"), ("b.json", json.dumps({"z.ts": {"s": {"0": 1, "1": 0}}, "total": {"lines": {"total": 5, "covered": 5}}, "w.ts": {"lines": {"total": 4, "covered": 3}}})), ("c.json", "not json")]
    got = {(r.file, r.total, r.covered) for r in coverage.read_any(spark.createDataFrame(rows, "report string, content string")).collect()}
    assert got == {("x.ts", 3, 2), ("y.ts", 1, 0), ("z.ts", 2, 1), ("w.ts", 4, 3)}


def test_services_and_openapi(spark):
    docs = spark.createDataFrame([("o.json", json.dumps({"paths": {"/users//": {"get": {"operationId": "list"}, "post": {}, "x": 1}}})), ("bad", "{")], "path string, content string")
    nodes, routes = services.openapi(docs)
    assert {(r.method, r.path) for r in routes.collect()} == {("GET", "/users/"), ("POST", "/users/")}
    assert nodes.where("name = 'GET /users/'").first().meta["operationId"] == "list"
    stack = spark.createDataFrame([("c.json", json.dumps({"services": {"web": {"depends_on": {"db": {}, "gone": {}}}, "db": {}}}))], "path string, content string")
    assert {(r.src, r.dst) for r in services.compose(stack)[1].collect()} == {("DockerService:c.json#web", "DockerService:c.json#db")}


def test_python_facts(spark):
    app = 'from fastapi import FastAPI\nfrom pkg.users import router as r, helper\napp = FastAPI()\napp.include_router(r, prefix="/api")\n@app.get("/health")\ndef health():\n    return helper()\n'
    users = 'from fastapi import APIRouter\nrouter = APIRouter(prefix="/users")\n@router.get("/{user_id}", response_model=list[User])\nasync def one(user_id): ...\ndef helper():\n    return one(1)\n'
    models = 'class User(models.Model):\n    email = models.CharField()\n    team = models.ForeignKey("Team")\nclass Team(models.Model):\n    name = models.CharField()\nclass S(ModelSerializer):\n    class Meta:\n        model = User\n        fields = ["email"]\nclass V(ModelViewSet):\n    serializer_class = S\n    queryset = User.objects.all()\n@shared_task\ndef job(): ...\n'
    rows = spark.createDataFrame([("main.py", app), ("pkg/users.py", users), ("m.py", models), ("bad.py", "def (")], "path string, content string")
    facts = python_facts.extract(rows)
    facts.cache()
    assert {(r.src, r.dst) for r in python_facts.import_edges(facts, rows).collect()} == {("File:main.py", "File:pkg/users.py")}
    edges = {(r.src, r.dst, r.kind) for r in python_facts.model_edges(facts).collect()}
    assert edges == {("Model:m.py#User", "Model:m.py#Team", "REFERENCES"), ("Serializer:m.py#S", "Model:m.py#User", "USES"), ("ViewSet:m.py#V", "Serializer:m.py#S", "USES")}
    calls = {(r.src, r.dst) for r in python_facts.call_edges(facts).collect()}
    assert calls == {("Function:main.py#health", "Function:pkg/users.py#helper"), ("Function:pkg/users.py#helper", "Function:pkg/users.py#one")}
    kinds = {(r.fact, r.name, r.target) for r in facts.where("fact in ('celery_task', 'view_model', 'serializer_field')").collect()}
    assert kinds == {("celery_task", "job", None), ("view_model", "V", "User"), ("serializer_field", "S", "email")}
    assert {(r.method, r.path, r.handler) for r in python_facts.http_routes(facts).collect()} == {("GET", "/health", "health"), ("GET", "/api/users/{user_id}", "one")}


def test_script_facts(spark):
    app = 'import axios from "axios";\nimport { Button as B } from "./ui";\nimport { useUsers } from "./hooks";\n// import x from "./no"\nconst api = axios.create({ baseURL: "/api" });\nexport default function Home() {\n  const u = useUsers();\n  api.get(`/users/${u}/`);\n  return <B onClick={() => fetch("/x", { method: "post" })} />;\n}\n'
    rows = spark.createDataFrame([("pages/home.tsx", app), ("pages/ui/index.ts", 'export * from "./button";\n'), ("pages/ui/button.tsx", "export const Button = () => <b/>;\n"), ("pages/hooks.ts", "export function useUsers() { return 1 }\n")], "path string, content string")
    facts = ts_facts.extract(rows)
    facts.cache()
    assert {r.id for r in ts_facts.symbols(facts).collect()} == {"Page:pages/home.tsx#Home", "Component:pages/ui/button.tsx#Button", "Hook:pages/hooks.ts#useUsers"}
    ends = {(r.src, r.dst) for r in ts_facts.import_edges(facts, rows).collect()}
    assert ends == {("File:pages/home.tsx", "File:pages/ui/index.ts"), ("File:pages/home.tsx", "File:pages/hooks.ts"), ("File:pages/ui/index.ts", "File:pages/ui/button.tsx")}
    used = {(r.kind, r.dst) for r in ts_facts.usage_edges(facts, rows).collect()}
    assert used == {("RENDERS", "Component:pages/ui/button.tsx#Button"), ("USES", "Hook:pages/hooks.ts#useUsers")}
    calls = {(r.method, r.full_url, r.dynamic, r.caller_id) for r in ts_facts.api_calls(facts).collect()}
    assert calls == {("GET", "/api/users/{param}/", True, "Page:pages/home.tsx#Home"), ("POST", "/x", False, "Page:pages/home.tsx#Home")}


def test_scopes_of_scripts():
    script = """import { a as b } from './m';
const text = `
import bad from './bad'
function Fake() { return <Fake/> } ${helper(x.inHole)}`;
type Other = { kind: 'a'; deep: { er?: string } } | Base<User>;
export function over(a: string): void;
export function over(a: any): { x: string } {
  const re = /[/'"`]{}/.test(a.value);
  function inner(q) { return q.deep?.er }
  return "foo(bar) <Baz/>";
}
const C: React.FC<Props<A, B>> = ({ a = f(1), b }) => {
  axios.get("/u").then((res) => res.data.items.map((i) => i.low) && res.data.email);
  return <Ctx.Provider value={a.b}>don't // stop <b>{list.map((x) => <Item key={x.id} />)}</b></Ctx.Provider>;
};
fetch("/top");
const g = <T,>(x: T) => x.y < 3 / 4 / x.z;
const h = async x => { const r = await api.get("/h"); const d = r.data; const e = d; e.first; d.map(function (it) { return it.second }) };
const not = (1 + 2) * 3;
export default over;
"""
    found = ts_facts.facts_of(script)
    of = lambda fact, *keys: [tuple(r[k] for k in keys) for r in found if r["fact"] == fact]
    assert of("declaration", "name", "line", "target", "extra") == [
        ("over", 7, '["test", "value", "deep", "er"]', "Function|exported|default"),
        ("C", 12, '["items", "low", "email", "Provider", "b", "id"]', "Component||"),
        ("g", 17, '["y", "z"]', "Function||"),
        ("h", 18, '["first", "second"]', "Function||"),
    ]
    assert of("import", "name", "target") == [("b", "./m")]
    assert of("jsx", "name", "owner") == [("Item", "C")] and of("provides", "name", "owner") == [("Ctx", "C")]
    assert {n for n, in of("call", "name")} == {"helper", "f", "fetch"}
    assert of("api_call", "target", "owner") == [("/u", "C"), ("/h", "h"), ("/top", None)]
    assert sorted(of("response_field", "name", "owner", "extra")) == [("email", "C", "medium"), ("first", "h", "medium"), ("items", "C", "medium"), ("second", "h", "low")]
    assert of("type", "name", "target", "extra") == [("Other", '["kind", "deep", "er"]', "type|")]
    for odd in ("", "`${", "<a", "const x = (", "function f(", "interface T", "/* never", "</a>}", "'", "const f = <T", "x = <A b={"):
        ts_facts.facts_of(odd)


def test_express_routes(spark):
    app = 'import users from "./users";\nconst app = express();\napp.use("/users", users);\napp.get("/health", ok);\n'
    users = 'const router = Router();\nrouter.get("/:id", show);\nexport default router;\n'
    rows = spark.createDataFrame([("src/app.ts", app), ("src/users.ts", users)], "path string, content string")
    got = {(r.method, r.path, r.handler) for r in ts_facts.express_routes(ts_facts.extract(rows), rows).collect()}
    assert got == {("GET", "/health", "ok"), ("GET", "/users/{id}", "show")}


def test_route_graphs(spark):
    app = 'import main, { side as extra } from "./users";\nconst app = express();\nexport function log(q, s, n) { n(); }\napp.use(log);\napp.use("/users", log, main);\napp.use(extra);\napp.GET("/health", log);\nmap.get("/not/a/route", log);\n'
    users = 'const router = Router();\nexport const side = express.Router();\nconst loop = Router();\nloop.use("/again", loop);\nfunction show() {}\nrouter.route("/:id").get([show, other]).post(show);\nside.patch("ping", () => { helper("a,b", [show]); });\nloop.get("/l", show);\nrouter.get(`/${x}`, show);\nexport default router;\n'
    rows = spark.createDataFrame([("src/app.ts", app), ("src/users.ts", users)], "path string, content string")
    script = ts_facts.extract(rows)
    nodes, edges, routes = routers.route_graph(ts_facts.express_map(script, rows), ts_facts.symbols(script).select("file", "name", "id"))
    assert {(r.method, r.path) for r in routes.collect()} == {("GET", "/users/{id}"), ("PATCH", "/ping"), ("GET", "/l"), ("GET", "/health")}
    got = {(r.kind, r.src.replace("src/", ""), r.dst.replace("src/", "")) for r in edges.collect()}
    assert {x for x in got if x[0] == "USES"} == {("USES", "Route:app.ts#GET /health", "Function:app.ts#log"), ("USES", "Route:app.ts#USE /users", "Function:app.ts#log"), ("USES", "Route:users.ts#GET /users/{id}", "Function:users.ts#show"), ("USES", "Route:users.ts#GET /l", "Function:users.ts#show")}
    assert {x[1:] for x in got if x[0] == "REGISTERED_IN" and x[1].startswith("Service")} == {("Service:users.ts#router", "Service:app.ts#app"), ("Service:users.ts#side", "Service:app.ts#app"), ("Service:users.ts#loop", "Service:users.ts#loop")}
    meta = {r.id.replace("src/", ""): r.meta for r in nodes.collect()}
    assert meta["Service:users.ts#loop"] == {"framework": "express", "type": "router", "exported": "false"} and meta["Service:users.ts#router"]["exported"] == "true"
    assert meta["Route:app.ts#USE /users"] == {"framework": "express", "method": "USE", "path": "/users", "middleware": "true"}
    assert meta["APIEndpoint:PATCH /ping"] == {"method": "PATCH", "path": "/ping", "source": "express"}

    main = 'from fastapi import FastAPI\nfrom a import users, router as alone\napp = FastAPI()\napp.include_router(users.api, prefix="/v1/")\n@app.get("/", response_model=list[User])\ndef home(): ...\n'
    more = 'api = APIRouter(prefix="users")\nlone = APIRouter(prefix="/lone")\nlone.include_router(deep)\n@api.delete("/{id}")\ndef drop(id): ...\n@lone.get("")\ndef here(): ...\n@nobody.get("/x")\ndef never(): ...\nclass User(BaseModel):\n    email: str\n'
    below = 'deep = APIRouter(prefix="/deep")\n@deep.get("/")\ndef down(): ...\nring = APIRouter(prefix="/ring")\nring.include_router(ring)\n@ring.get("/r")\ndef turn(): ...\n'
    python = python_facts.extract(spark.createDataFrame([("main.py", main), ("a/users.py", more), ("a/deep.py", below)], "path string, content string"))
    nodes, edges, routes = routers.route_graph(python_facts.http_map(python), python_facts.functions(python))
    assert {(r.method, r.path, r.shows) for r in routes.collect()} == {("GET", "/", "User"), ("DELETE", "/v1/users/{id}", None), ("GET", "/lone", None), ("GET", "/lone/deep", None), ("GET", "/ring/r", None)}
    assert ("USES", "Route:a/users.py#DELETE /v1/users/{id}", "Function:a/users.py#drop") in {(r.kind, r.src, r.dst) for r in edges.collect()}
    assert [(r.shows, [tuple(x) for x in r.response_fields]) for r in python_facts.answer_fields(python).collect()] == [("User", [("Field:a/users.py#User#email", "email")])]


def test_scalars(spark):
    row = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first().asDict()
    got = row(a=text.clean_path(F.lit("api//x?y=1")), b=text.clean_path(F.lit("?q")), c=text.route_path(F.lit("users/:id/")), d=text.typed_params(F.lit("/a/<int:id>/<x>")), e=text.join_url(F.lit("/api/"), F.lit("u")), f=text.js_round(F.lit(-2.5)), g=text.mask(F.lit("12345678")), h=text.clamp_percent(F.lit(140.2)), i=text.stem(F.lit("a/page.test.tsx")), j=text.line_count(F.lit("a\nb\n")), k=text.slug(F.lit("My Repo!")))
    assert got == {"a": "/api/x/", "b": "/", "c": "/users/{id}", "d": "/a/{id}/{x}", "e": "/api/u", "f": -2, "g": "***", "h": 100, "i": "page", "j": 3, "k": "my-repo"}
    paths = spark.createDataFrame([("src/a/b.ts",), ("src/b.ts",), (".\\src\\c.ts",), ("xsrc/b.ts",)], "p string")
    assert [r.m for r in paths.select(text.matches_any(F.col("p"), ["src/**/*.ts"]).alias("m")).collect()] == [True, True, True, False]


def test_changed_paths_and_aliases(spark):
    diff = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\ndiff --git a/y b/y\n+++ /dev/null\n"
    assert [r.path for r in files.changed_paths(spark.createDataFrame([(diff,)], "text string")).collect()] == ["x.ts", "y"]
    config = '{\n// c\n"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]},}}'
    rows = spark.createDataFrame([("tsconfig.json", config), ("src/u.ts", ""), ("a.ts", "")], "path string, content string")
    aliases = files.path_aliases(rows)
    spec = spark.createDataFrame([("a.ts", "@/u"), ("a.ts", "react")], "file string, target string")
    assert [(r.target, r.to) for r in ts_facts.resolve(spec, rows, aliases).collect()] == [("@/u", "src/u.ts")]


def test_reports():
    doc = reports.sarif([{"kind": "DEAD_CODE", "severity": "low", "message": "m", "file": "a.ts"}], [{"kind": "MIN_HEALTH", "message": "h"}])
    run = doc["runs"][0]
    assert [r["level"] for r in run["results"]] == ["warning", "error"] and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CI_MIN_HEALTH", "DEAD_CODE"]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert "| node_added | 2 |" in reports.markdown(True, [], {"node_added": 2}, [str(i) for i in range(40)])
    assert json.loads(reports.progress("scan", 250))["percent"] == 100


def test_activity_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1), ("2024-01-01 11:00:00", "a", 2), ("2024-01-09 00:00:00", "b", 1)], "ts string, event_type string, user_id long").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = snapshots.activity_stream(stream).writeStream.format("memory").queryName("activity").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.event_type, r.n) for r in spark.table("activity").collect()} == {("a", 2), ("b", 1)}


def test_entry_registers_queries_with_their_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 40
