"""Governance files (SRC-13) and presets (SNK-07): boundary groups and rules, public API, CI gates, ignored paths."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from graphloom.operators.rules import Boundary, Config, PublicApi
from graphloom.sources.files import read_small

try:
    import yaml
except ImportError:  # JSON files work without it
    yaml = None

#: Names below a root, in the order in which they are tried.
NAMES = (".graphloom.yml", ".graphloom.yaml", ".graphloom.json")
GATES = {"minHealth": "min_health", "maxNewIssues": "max_new_issues", "forbidBreakingChanges": "forbid_breaking", "forbidBoundaryViolations": "forbid_boundary", "minCoveragePct": "min_coverage"}


@dataclass
class Governance:
    """config: for the rules; gates: keyword arguments of `diff.gates`."""

    config: Config = field(default_factory=Config)
    gates: dict = field(default_factory=dict)


def _strings(value: object, where: str) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return value
    raise ValueError(f"{where} must be a string or a list of strings")


def _api(item: object, where: str) -> PublicApi:
    """An object, or a string: path#name, Kind:id, or a path."""
    if isinstance(item, str):
        path, hash_, name = item.rpartition("#")
        if hash_ and path:
            return PublicApi(paths=[path], names=[name])
        return PublicApi(ids=[item]) if item.split(":")[0][:1].isupper() and ":" in item else PublicApi(paths=[item])
    if not isinstance(item, dict):
        raise ValueError(f"{where} must be a string or an object")
    parts = {k: _strings(v, f"{where}.{k}") for k in ("ids", "paths", "names", "kinds") if (v := item.get(k, item.get(k[:-1]))) is not None}
    if not parts.get("ids") and not parts.get("paths"):
        raise ValueError(f"{where} requires ids or paths")
    return PublicApi(**parts)


def parse(document: dict | None) -> Governance:
    """A document of boundaries {groups, rules}, publicApi {exports}, ci {gates} and risk {ignorePaths}; what is left
    out is empty, what has another shape raises."""
    document = document or {}
    if not isinstance(document, dict):
        raise ValueError("a governance file holds an object")
    bounds = document.get("boundaries") or {}
    groups = bounds.get("groups") or []
    if isinstance(groups, dict):
        groups = [{"id": k, **(v if isinstance(v, dict) else {"paths": v})} for k, v in groups.items()]
    named = {g["id"]: _strings(g.get("paths", g.get("path")), f"boundaries.groups.{g['id']}") for g in groups}
    rules = []
    for i, r in enumerate(bounds.get("rules") or []):
        where = f"boundaries.rules[{i}]"
        allow = r["allow"] if isinstance(r.get("allow"), bool) else r.get("type") in ("allow", "permit")
        kinds = r.get("edgeKinds", r.get("edges"))
        rules.append(Boundary(_strings(r.get("from"), where), _strings(r.get("to"), where), allow, _strings(kinds, where) if kinds else (), r.get("message")))
    api = document.get("publicApi") or []
    exports = api if isinstance(api, list) else api.get("exports", api.get("exported")) or []
    gates = (document.get("ci") or {}).get("gates") or {}
    if odd := set(gates) - set(GATES):
        raise ValueError(f"ci.gates has no {sorted(odd)}")
    ignored = (document.get("risk") or {}).get("ignorePaths") or []
    config = Config(groups=named, boundaries=rules, public_api=[_api(x, f"publicApi[{i}]") for i, x in enumerate(exports)], ignore_paths=_strings(ignored, "risk.ignorePaths"))
    return Governance(config, {GATES[k]: v for k, v in gates.items()})


def load(spark: SparkSession, root: str, path: str | None = None) -> Governance:
    """SRC-13: the file at `path`, which must be there, else the first of NAMES below the root, else nothing set.
    Any file system that Spark reads will do."""
    tried = [path] if path else [f"{root.rstrip('/')}/{name}" for name in NAMES]
    found, text = next(((p, t) for p in tried if (t := read_small(spark, p)) is not None), (None, None))
    if text is None:
        if path:
            raise FileNotFoundError(path)
        return Governance()
    if found.endswith(".json"):
        return parse(json.loads(text))
    if yaml is None:
        raise ValueError(f"{found} needs a YAML library; use .graphloom.json")
    return parse(yaml.safe_load(text))


def load_first(spark: SparkSession, roots: Sequence[str], path: str | None = None) -> Governance:
    """SRC-13 for several repositories: the file at `path`, else the first that their common folder or one of them, in
    their order, has."""
    if path:
        return load(spark, roots[0], path)
    shared = os.path.commonpath(roots) if all(r.startswith("/") for r in roots) else None
    for root in ([shared] if shared and shared not in ("/", *roots) else []) + list(roots):
        if any(read_small(spark, f"{root.rstrip('/')}/{name}") is not None for name in NAMES):
            return load(spark, root)
    return Governance()


#: Paths whose findings count for nothing.
IGNORED = ["**/*.test.ts", "**/*.test.tsx", "**/*.spec.ts", "**/*.spec.tsx", "**/__tests__/**", "**/test/**", "**/tests/**", "examples/**", "fixtures/**", "dist/**", "build/**", ".next/**", "coverage/**"]
#: Groups, denied imports and public API of each preset.
PRESETS: dict[str, dict] = {
    "next": {
        "groups": {"app": ["app/**", "pages/**", "src/app/**", "src/pages/**"], "components": ["components/**", "src/components/**"], "server": ["server/**", "src/server/**", "lib/server/**", "src/lib/server/**"]},
        "deny": [("components", "server", ["IMPORTS"])],
        "api": [{"paths": ["components/ui/**", "src/components/ui/**"], "kinds": ["Component"]}],
    },
    "next-django": {
        "groups": {"frontend": ["frontend/**", "apps/web/**", "app/**", "pages/**", "src/**"], "backend": ["backend/**", "apps/api/**", "source/**"]},
        "deny": [("frontend", "backend", ["IMPORTS"])],
        "api": [{"paths": ["frontend/components/ui/**", "apps/web/components/ui/**"], "kinds": ["Component"]}, {"paths": ["backend/**/urls.py", "backend/**/views.py"]}],
    },
    "vite-react": {
        "groups": {"routes": ["src/routes/**", "src/pages/**"], "components": ["src/components/**"], "data": ["src/api/**", "src/services/**", "src/lib/**"]},
        "api": [{"paths": ["src/components/ui/**"], "kinds": ["Component"]}],
    },
    "node-api": {
        "groups": {"routes": ["src/routes/**", "routes/**"], "services": ["src/services/**", "services/**"], "data": ["src/db/**", "src/repositories/**", "db/**"]},
        "deny": [("routes", "data", ["IMPORTS", "CALLS"])],
    },
    "python-api": {"groups": {"api": ["**/views.py", "**/urls.py", "**/routers.py", "**/main.py"], "models": ["**/models.py", "**/schemas.py"], "services": ["**/services/**", "**/tasks.py"]}},
    "library": {"api": [{"paths": ["src/index.ts", "src/index.tsx", "index.ts"], "kinds": ["Function", "Type", "Component", "Hook"]}], "ignored": ["demo/**", "playground/**"]},
}


def preset(name: str) -> dict:
    """SNK-07: the document of a preset, as `parse` reads it and a file holds it."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name}; there are {sorted(PRESETS)}")
    p = PRESETS[name]
    return {
        "boundaries": {"groups": [{"id": k, "paths": v} for k, v in p.get("groups", {}).items()], "rules": [{"from": [a], "to": [b], "allow": False, "edgeKinds": kinds} for a, b, kinds in p.get("deny", [])]},
        "publicApi": {"exports": p.get("api", [])},
        "ci": {"gates": {"minHealth": 80, "maxNewIssues": 0, "forbidBreakingChanges": True, "forbidBoundaryViolations": True}},
        "risk": {"ignorePaths": IGNORED + p.get("ignored", [])},
    }
