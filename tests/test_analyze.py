"""A small repository from files to score, diff, gate and answers."""

import json

from pyspark.sql import functions as F

from graphloom import cli
from graphloom.operators.rules import Boundary, Config
from graphloom.plans import phases
from graphloom.plans.analyze import analyze
from graphloom.plans.analyzers import Analyzer, by_parser

APP = {
    "web/app/page.tsx": 'import { Card } from "../ui/card";\nimport { useUsers } from "../hooks";\nexport default function Home() {\n  useUsers();\n  return <Card />;\n}\n',
    "web/ui/card.tsx": "export const Card = () => <b/>;\nexport const Orphan = () => <i/>;\n",
    "web/hooks.ts": 'import axios from "axios";\nconst api = axios.create({ baseURL: "/api" });\nexport function useUsers() { return api.get("/users") }\nexport function useNone() { return fetch("/nowhere") }\n',
    "api/main.py": 'from fastapi import FastAPI\nfrom api.models import User\napp = FastAPI()\n@app.get("/api/users")\ndef users(): ...\n@app.get("/api/lost")\ndef lost(): ...\n',
    "api/models.py": "from api.main import app\nclass User(BaseModel):\n    email: str\n",
    "api/conf.py": 'API_KEY = "abcd1234efgh5678"\n',
}


def write(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)


def test_repository_end_to_end(spark, tmp_path):
    write(tmp_path / "app", APP)
    found = analyze(spark, str(tmp_path / "app"), Config(groups={"web": ["web/**"], "api": ["api/**"]}, boundaries=[Boundary(["web"], ["api"])]))
    edges = {(r.kind, r.src, r.dst): r.confidence for r in found.edges.collect()}
    assert edges[("CALLS", "Hook:web/hooks.ts#useUsers", "APIEndpoint:GET /api/users")] == "high"
    assert ("RENDERS", "Page:web/app/page.tsx#Home", "Component:web/ui/card.tsx#Card") in edges
    kinds = {}
    for r in found.issues.collect():
        kinds.setdefault(r.kind, set()).add(r.message)
    assert kinds["CIRCULAR_DEPENDENCY"] == {"Circular import: File:api/main.py → File:api/models.py"}
    assert kinds["UNUSED_ENDPOINT"] == {'Endpoint "GET /api/lost" has no frontend caller'}
    assert kinds["DEAD_CODE"] == {'Component "Orphan" is never rendered', 'Hook "useNone" is never used'}
    assert kinds["DANGLING_API_CALL"] == {'Call "GET /nowhere" matches no known backend route'}
    assert len(kinds["SECRET_CANDIDATE"]) == 1
    assert found.health.first().health == 100 - 10 - 2 - 15


def test_outside_analyzers_and_phases(spark, tmp_path, capsys):
    """An analyzer from elsewhere adds nodes, edges, calls and routes; one whose files are absent does not run."""
    write(tmp_path / "app", APP | {"jobs/nightly.job": "run report\ncall get /api/users\nserve get /nowhere\n", "jobs/empty.job": ""})

    def parse(path, content):
        for i, line in enumerate(content.splitlines(), 1):
            words = line.split()
            if words[0] == "run":
                yield {"part": "node", "id": f"Job:{path}#{words[1]}", "kind": "Job", "name": words[1], "line": i, "meta": {"by": "hand"}}
                yield {"part": "edge", "kind": "USES", "src": f"File:{path}", "dst": f"Job:{path}#{words[1]}"}
            elif words[0] == "call":
                yield {"part": "call", "method": words[1], "url": words[2], "name": "job", "line": i}
            else:
                yield {"part": "route", "method": words[1], "url": words[2], "id": "Job:nowhere"}

    def never(files):
        raise AssertionError("no file of its kind")

    told = phases.Phases(lambda line: print(line))
    found = analyze(spark, str(tmp_path / "app"), analyzers=[Analyzer("absent", lambda: F.col("path").endswith(".proto"), never), Analyzer("jobs", lambda: F.col("path").endswith(".job"), by_parser(parse))], told=told)
    assert [(r.name, r.file, r.line) for r in found.nodes.where("kind = 'Job'").collect()] == [("report", "jobs/nightly.job", 1)]
    edges = {(r.kind, r.src, r.dst) for r in found.edges.collect()}
    assert {("USES", "File:jobs/nightly.job", "Job:jobs/nightly.job#report"), ("CALLS", "File:jobs/nightly.job", "APIEndpoint:GET /api/users"), ("CALLS", "Hook:web/hooks.ts#useNone", "Job:nowhere")} <= edges
    assert not found.issues.where("kind = 'DANGLING_API_CALL'").count()
    assert tuple(told.done) == phases.SCAN
    assert told.done["files"][1] == len(APP) + 2 and told.done["nodes"][1] == found.nodes.count()
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(lines) == len(phases.SCAN) and lines[-1] == {"type": "progress", "stage": "issues", "percent": 100}
    each, whole = told.run(spark, 1)
    more = spark.createDataFrame([(2, "files", 50.0, 1)], each.schema)
    mean, total = phases.means(each.unionByName(more), whole.unionByName(spark.createDataFrame([(2, 50.0, 1)], whole.schema)))
    got = {r.phase: r.ms for r in mean.collect()}
    assert abs(got["files"] - (told.done["files"][0] + 50) / 2) < 1e-6 and abs(got["ts"] - told.done["ts"][0] / 2) < 1e-6
    assert total.first().peak_rss > 1
    assert phases.means(each.where("false"), whole.where("false"))[0].count() == 0


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "app", APP)
    assert cli.main(["scan", str(tmp_path / "app"), str(tmp_path / "a")]) == 0
    write(tmp_path / "app", {"web/ui/new.tsx": "export const New = () => <b/>;\n"})
    assert cli.main(["scan", str(tmp_path / "app"), str(tmp_path / "b")]) == 0
    capsys.readouterr()
    assert cli.main(["diff", str(tmp_path / "a"), str(tmp_path / "b")]) == 0
    assert set(capsys.readouterr().out.split("\n")) >= {"node_added\t2", "issue_added\t1"}
    assert cli.main(["ci", str(tmp_path / "b"), "--baseline", str(tmp_path / "a"), "--max-new-issues", "0", "--sarif", str(tmp_path / "s.json")]) == 1
    assert "MAX_NEW_ISSUES" in capsys.readouterr().out
    assert cli.main(["ask", str(tmp_path / "b"), "which code is dead?"]) == 0
    assert "find_dead_code" in capsys.readouterr().out


def test_aliases_and_django_routes_leave_nothing_dangling(spark, tmp_path):
    root = tmp_path / "shop"
    texts = {
        ".gitignore": "junk/\n",
        "junk/x.ts": "export const x = 1;\n",
        "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["web/*"]}}}',
        "web/pages/Home.tsx": "import { Card } from '@/ui/Card';\nexport default function Home() {\n  api.get('/api/users/');\n  return <Card />;\n}\n",
        "web/ui/Card.tsx": "export const Card = () => <b>x</b>;\n",
        "manage.py": "",
        "conf/settings.py": "ROOT_URLCONF = 'conf.urls'\n",
        "conf/urls.py": "urlpatterns = [path('api/', include('app.urls'))]\n",
        "app/urls.py": "router.register('users', UserViewSet)\n",
        "app/views.py": "class UserViewSet(viewsets.ModelViewSet):\n    pass\n",
    }
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = analyze(spark, str(root))
    assert not any(r.path.startswith("junk/") for r in found.files.select("path").collect())
    edges = {(r.kind, r.src, r.dst) for r in found.edges.select("kind", "src", "dst").collect()}
    assert ("IMPORTS", "File:web/pages/Home.tsx", "File:web/ui/Card.tsx") in edges
    assert ("RENDERS", "Page:web/pages/Home.tsx#Home", "Component:web/ui/Card.tsx#Card") in edges
    assert ("EXPOSES", "ViewSet:app/views.py#UserViewSet", "APIEndpoint:GET /api/users/") in edges
    kinds = {(r.kind, r.nodes[0]) for r in found.issues.select("kind", "nodes").collect()}
    assert not any(k == "DANGLING_API_CALL" for k, _ in kinds) and ("DEAD_CODE", "Component:web/ui/Card.tsx#Card") not in kinds
