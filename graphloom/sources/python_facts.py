"""Facts of Python files (EXT-13..22) from the standard parser, one narrow row per fact, and their joins."""

from __future__ import annotations

import ast
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import basename, dirname, edge_id, join_path, typed_params
from graphloom.operators.graph import Steps
from graphloom.sources.parsing import once, parsed
from graphloom.sources.routers import RouterMap, prefixes

FACT = "array<struct<fact: string, name: string, owner: string, target: string, extra: string, line: int>>"
#: Fixed values.
VERBS = ("get", "post", "put", "patch", "delete", "options", "head")
SIZE_GUARD = 1_500_000


#: Nodes with nothing below them that holds a fact.
LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias)


def _last(node: ast.AST) -> str:
    if isinstance(node, ast.Call):
        return _last(node.func)
    if isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else ""


def _source(node: ast.AST) -> str:
    """The source of an expression; of a dotted name without the parser's printer."""
    names, at = [], node
    while isinstance(at, ast.Attribute):
        names.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(names)]) if isinstance(at, ast.Name) else ast.unparse(node)


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


class _Facts(ast.NodeVisitor):
    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.owner: list[str] = []

    def visit(self, node: ast.AST) -> None:
        if not isinstance(node, LEAVES):
            VISITS.get(type(node), _Facts.generic_visit)(self, node)

    def generic_visit(self, node: ast.AST) -> None:
        """All below a node in the order of the text, without the leaves."""
        for name in node._fields:
            value = getattr(node, name, None)
            if isinstance(value, list):
                for item in value:
                    if isinstance(item, ast.AST):
                        self.visit(item)
            elif isinstance(value, ast.AST):
                self.visit(value)

    def add(self, fact: str, node: ast.AST, name: str = "", target: str | None = None, extra: str | None = None) -> None:
        self.rows.append({"fact": fact, "name": name, "owner": ".".join(self.owner) or None, "target": target, "extra": extra, "line": getattr(node, "lineno", None)})

    def visit_Import(self, node: ast.Import) -> None:
        if not self.owner:
            for a in node.names:
                self.add("import", node, (a.asname or a.name).split(".")[0], a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if not self.owner and node.module:
            for a in node.names:
                if a.name != "*":
                    self.add("import", node, a.asname or a.name, "." * node.level + node.module, a.name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [_last(b) for b in node.bases]
        kind = "model" if "Model" in bases or "BaseModel" in bases else "serializer" if any("Serializer" in b for b in bases) else "view" if any(b.endswith(("ViewSet", "View", "ViewSetMixin")) for b in bases) else "manager" if any(b.endswith(("Manager", "QuerySet")) for b in bases) else "class"
        self.add(kind, node, node.name, extra=",".join(bases))
        self.owner.append(node.name)
        for item in node.body:
            if kind == "model" and isinstance(item, ast.Assign) and isinstance(item.value, ast.Call) and _last(item.value).endswith(("Field", "ForeignKey")):
                to = item.value.args[0] if item.value.args else _keyword(item.value, "to")
                link = _last(item.value) in ("ForeignKey", "OneToOneField", "ManyToManyField")
                self.add("field", item, item.targets[0].id if isinstance(item.targets[0], ast.Name) else "", (_text(to) or _last(to)) if link and to is not None else None, _last(item.value))
            elif kind == "model" and isinstance(item, ast.Assign) and isinstance(item.value, ast.Call) and isinstance(item.targets[0], ast.Name):
                made = item.value.func.value if isinstance(item.value.func, ast.Attribute) and item.value.func.attr in ("from_queryset", "as_manager") else item.value
                self.add("model_manager", item, item.targets[0].id, _last(made))
            elif kind == "model" and isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
                self.add("field", item, item.target.id, extra=ast.unparse(item.annotation))
            elif kind == "serializer" and isinstance(item, ast.ClassDef) and item.name == "Meta":
                for meta in item.body:
                    if isinstance(meta, ast.Assign) and isinstance(meta.targets[0], ast.Name):
                        if meta.targets[0].id == "model":
                            self.add("serializer_model", meta, node.name, _last(meta.value))
                        elif meta.targets[0].id == "fields":
                            if isinstance(meta.value, (ast.List, ast.Tuple)):
                                for f in meta.value.elts:
                                    self.add("serializer_field", meta, node.name, _text(f))
                            elif _text(meta.value) == "__all__":
                                self.add("serializer_field", meta, node.name, "__all__")
            elif kind == "view" and isinstance(item, ast.Assign) and isinstance(item.targets[0], ast.Name):
                if item.targets[0].id == "serializer_class":
                    self.add("view_serializer", item, node.name, _last(item.value))
                elif item.targets[0].id == "queryset":
                    root = next((n.value.id for n in ast.walk(item.value) if isinstance(n, ast.Attribute) and n.attr == "objects" and isinstance(n.value, ast.Name)), None)
                    self.add("view_model", item, node.name, root)
        self.generic_visit(node)
        self.owner.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.add("function", node, ".".join([*self.owner, node.name]))
        for d in node.decorator_list:
            if _last(d) in ("shared_task", "task"):
                self.add("celery_task", node, node.name)
            elif isinstance(d, ast.Call) and _last(d) == "receiver" and d.args:
                sender = _keyword(d, "sender")
                self.add("signal", node, node.name, _last(sender) if sender is not None else None, _last(d.args[0]))
            elif isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and _text(d.args[0]) is not None:
                router = _last(d.func.value)
                model = _keyword(d, "response_model")
                shown = _last(model.slice) if isinstance(model, ast.Subscript) else _last(model) if model is not None else None
                if d.func.attr in VERBS:
                    self.rows.append({"fact": "route", "name": node.name, "owner": router, "target": _text(d.args[0]), "extra": f"{d.func.attr.upper()}|{shown or ''}", "line": node.lineno})
                elif d.func.attr == "route":
                    methods = _keyword(d, "methods")
                    for m in [_text(x) for x in methods.elts] if isinstance(methods, (ast.List, ast.Tuple)) else ["GET"]:
                        self.rows.append({"fact": "route", "name": node.name, "owner": router, "target": _text(d.args[0]), "extra": f"{(m or 'GET').upper()}|", "line": node.lineno})
        self.owner.append(node.name)
        self.generic_visit(node)
        self.owner.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Name) and _last(node.value) in ("FastAPI", "APIRouter", "Flask", "Blueprint"):
            prefix = _text(_keyword(node.value, "prefix")) or _text(_keyword(node.value, "url_prefix")) or ""
            self.add("router", node, node.targets[0].id, prefix, _last(node.value))
        if isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Name) and _last(node.value) in ("NestedSimpleRouter", "NestedDefaultRouter") and len(node.value.args) > 1:
            above = _text(node.value.args[1])
            if above:
                self.rows.append({"fact": "nested_router", "name": node.targets[0].id, "owner": _last(node.value.args[0]), "target": above, "extra": _text(_keyword(node.value, "lookup")) or "parent", "line": node.lineno})
        if any(isinstance(t, ast.Name) and t.id == "ROOT_URLCONF" for t in node.targets) and _text(node.value):
            self.add("root_urlconf", node, target=_text(node.value))
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        name = _source(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else ""
        if self.owner and name:
            self.add("call", node, name)
        if _last(node.func) in ("path", "re_path") and len(node.args) > 1 and isinstance(node.args[1], ast.Call) and _last(node.args[1]) == "include" and node.args[1].args:
            prefix, module = _text(node.args[0]), _text(node.args[1].args[0])
            if prefix is not None and module:
                self.add("include", node, target=module, extra=prefix)
        if isinstance(node.func, ast.Attribute):
            if node.func.attr in ("include_router", "register_blueprint") and node.args:
                prefix = _text(_keyword(node, "prefix")) or _text(_keyword(node, "url_prefix")) or ""
                self.add("mount", node, _last(node.func.value), _source(node.args[0]), prefix)
            elif node.func.attr == "register" and len(node.args) > 1 and _text(node.args[0]) is not None:
                self.add("registration", node, _last(node.func.value), _last(node.args[1]), _text(node.args[0]))
            elif node.func.attr == "connect" and node.args and _last(node.args[0]):
                sender = _keyword(node, "sender")
                self.add("signal", node, _last(node.args[0]), _last(sender) if sender is not None else None, _last(node.func.value))
            elif isinstance(node.func.value, ast.Attribute) and node.func.value.attr == "objects":
                self.add("queryset", node, _last(node.func.value.value), extra=node.func.attr)
        self.generic_visit(node)


#: The visitors by class of node.
VISITS = {getattr(ast, name.removeprefix("visit_")): visit for name, visit in vars(_Facts).items() if name.startswith("visit_")}


def facts_of(text: str | None, most: int | None = None) -> list[dict]:
    """All facts of one file; what doesn't parse or has more than `most` bytes (EXT-28) has none."""
    if not text or (most is not None and len(text.encode()) > most):
        return []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = _Facts()
    found.visit(tree)
    return found.rows


def facts_column(content: str = "content", most: int | None = None) -> Column:
    """The facts of each text, as one array."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: facts_of(text, most))

    return F.pandas_udf(run, FACT)(content)


def wanted(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".py"))


def rows(held: DataFrame) -> DataFrame:
    """(file, ord, fact, name, owner, target, extra, line) of (path, facts)."""
    found = held.select(F.col("path").alias("file"), F.posexplode("facts").alias("ord", "f"))
    return found.select("file", F.col("ord").cast("long").alias("ord"), "f.*")


def found(files: DataFrame, most: int | None = None) -> DataFrame:
    """The facts of `extract` as a plan; for one use of them, as every further one parses again."""
    return parsed(wanted(files), facts_of, most)


def extract(files: DataFrame, most: int | None = None) -> DataFrame:
    """(file, ord, fact, name, owner, target, extra, line) of Python files (path, content), parsed once and written down.
    Files of more than `most` bytes have no facts (EXT-28), as a scan of a repository wants it; by default all have."""
    return once(found(files, most))


def modules(files: DataFrame) -> DataFrame:
    """FN-09: (file, module) of Python files."""
    dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/", ".")
    return files.where(F.col("path").endswith(".py")).select(F.col("path").alias("file"), dotted.alias("module"))


def import_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """JOIN-05, JOIN-08: IMPORTS edges between files: the imported name as a module first, else its package."""
    own = modules(files)
    base = F.regexp_replace("target", r"^\.+", "")
    folder = F.regexp_replace(F.regexp_replace("file", "/?[^/]*$", ""), "/", ".")
    level = F.length(F.regexp_extract("target", r"^\.*", 0))
    whole = F.when(level > 0, F.concat_ws(".", F.when(folder != "", folder), base)).otherwise(base)
    rows = facts.where("fact = 'import'").select("file", whole.alias("base"), "extra")
    keyed = rows.select("file", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat_ws(".", "base", "extra").alias("module")), F.struct(F.lit(1).alias("n"), F.col("base").alias("module")))).alias("c"), "base", "extra")
    met = keyed.join(own.withColumnRenamed("file", "to"), F.col("c.module") == F.col("module")).groupBy("file", "base", "extra").agg(F.min_by("to", "c.n").alias("to"))
    ends = met.where("file <> to").select(F.concat(F.lit("File:"), "file").alias("src"), F.concat(F.lit("File:"), "to").alias("dst")).distinct()
    return ends.select(edge_id(F.lit("IMPORTS"), F.col("src"), F.col("dst")).alias("id"), "src", "dst", F.lit("IMPORTS").alias("kind"))


def http_map(facts: DataFrame) -> RouterMap:
    """EXT-22, JOIN-12, GRF-08: FastAPI and Flask applications and routers.

    A router's prefixes are its own behind those of the routers that mount it; applications and routers that nobody
    mounts start with their own. Names are routers of their file, or of the one file that has the name.
    """
    kept = Steps(facts.sparkSession, "http")
    app = F.col("extra").isin("FastAPI", "Flask")
    own = F.when(app, "").otherwise(F.coalesce("target", F.lit("")))
    made = facts.where("fact = 'router'").select("file", "name", own.alias("own"), app.alias("app"), F.when(F.col("extra").isin("Flask", "Blueprint"), "flask").otherwise("fastapi").alias("framework"), "line", "ord")
    made = kept.put(made.groupBy("file", "name").agg(*[F.max_by(c, "ord").alias(c) for c in ("own", "app", "framework", "line")], F.max("ord").alias("ord")), "routers")
    single = made.groupBy("name").agg(F.count("*").alias("n"), F.first("file").alias("only")).where("n = 1").drop("n")
    mounts = facts.where("fact = 'mount'").select("file", F.col("name").alias("parent"), F.substring_index("target", ".", -1).alias("last"), F.coalesce("extra", F.lit("")).alias("path"))
    imported = facts.where("fact = 'import' and extra is not null").select("file", F.col("name").alias("last"), F.col("extra").alias("real")).distinct()
    mounts = mounts.join(imported, ["file", "last"], "left").withColumn("name", F.coalesce("real", "last"))

    def placed(rows: DataFrame, name: str, file: str) -> DataFrame:
        """With `file`: where the router of a name in a file is."""
        near = made.select("file", F.col("name").alias(name), F.col("file").alias("near"))
        far = single.select(F.col("name").alias(name), "only")
        return rows.join(near, ["file", name], "left").join(far, name, "left").withColumn(file, F.coalesce("near", "only")).drop("near", "only").where(F.col(file).isNotNull())

    below = placed(placed(mounts, "parent", "parent_file"), "name", "home").select("parent_file", "parent", F.col("home").alias("file"), "name", "path")
    below = kept.put(below.join(made.select("file", "name", "own"), ["file", "name"]).distinct(), "mounts")
    seeds = made.join(below.select("file", "name", F.lit(True).alias("mounted")).distinct(), ["file", "name"], "left").where("app or mounted is null")
    clean = lambda *c: typed_params(F.concat_ws("/", *c))
    every = prefixes(seeds.select("file", "name", clean("own").alias("prefix")), below.select("parent_file", "parent", "file", "name", clean("path", "own").alias("path")))
    every = every.unionByName(made.join(every, ["file", "name"], "left_anti").select("file", "name", clean("own").alias("prefix")))
    routes = facts.where("fact = 'route'").select("file", F.col("owner").alias("name"), F.array("name").alias("handlers"), F.col("target").alias("path"), F.substring_index("extra", "|", 1).alias("method"), F.nullif(F.substring_index("extra", "|", -1), F.lit("")).alias("shows"), "line", "ord")
    routes = routes.join(made.select("file", "name", "framework"), ["file", "name"]).join(every, ["file", "name"])
    routes = routes.select("file", "name", F.col("file").alias("at"), "framework", "method", join_path(F.col("prefix"), typed_params(F.col("path"))).alias("path"), "handlers", "shows", "line", "ord")
    services = made.select("file", "name", "framework", F.when(F.col("app"), "app").otherwise("router").alias("type"), F.lit(None).cast("boolean").alias("exported"), "line", "ord")
    return RouterMap(services, below.select("file", "name", "parent_file", "parent").distinct(), routes)


def http_routes(facts: DataFrame) -> DataFrame:
    """JOIN-12, JOIN-35: (method, path, handler, file) of FastAPI and Flask routes."""
    return http_map(facts).routes.select("method", "path", F.element_at("handlers", 1).alias("handler"), F.col("at").alias("file")).distinct()


def functions(facts: DataFrame) -> DataFrame:
    """EXT-21: (file, name, id) of functions."""
    return facts.where("fact = 'function'").select("file", "name", F.concat(F.lit("Function:"), "file", F.lit("#"), "name").alias("id")).distinct()


def model_edges(facts: DataFrame) -> DataFrame:
    """JOIN-10: models refer to models by their relations, serializers use models, views use serializers."""
    models = facts.where("fact = 'model'").groupBy("name").agg(F.max_by("file", F.struct("file", "ord")).alias("at"))
    fields = facts.where("fact = 'field' and target is not null").select("file", "owner", F.element_at(F.split("target", r"\."), -1).alias("name"))
    node = lambda kind, file, name: F.concat(F.lit(kind + ":"), file, F.lit("#"), name)
    a = fields.join(models, "name").select(node("Model", F.col("file"), F.col("owner")).alias("src"), node("Model", F.col("at"), F.col("name")).alias("dst"), F.lit("REFERENCES").alias("kind"))
    b = facts.where("fact = 'serializer_model'").select("file", F.col("name").alias("owner"), F.col("target").alias("name")).join(models, "name").select(node("Serializer", F.col("file"), F.col("owner")).alias("src"), node("Model", F.col("at"), F.col("name")).alias("dst"), F.lit("USES").alias("kind"))
    serializers = facts.where("fact = 'serializer'").groupBy("name").agg(F.max_by("file", F.struct("file", "ord")).alias("at"))
    c = facts.where("fact = 'view_serializer'").select("file", F.col("name").alias("owner"), F.col("target").alias("name")).join(serializers, "name").select(node("ViewSet", F.col("file"), F.col("owner")).alias("src"), node("Serializer", F.col("at"), F.col("name")).alias("dst"), F.lit("USES").alias("kind"))
    return a.unionByName(b).unionByName(c).distinct()


def call_edges(facts: DataFrame) -> DataFrame:
    """JOIN-09: CALLS edges between functions of a file, or through an imported name."""
    functions = facts.where("fact = 'function'").select("file", "name")
    calls = facts.where("fact = 'call'").select("file", F.col("owner").alias("caller"), F.regexp_replace("name", "^self\\.", "").alias("name")).where("caller is not null")
    local = calls.join(functions, ["file", "name"]).select("file", "caller", F.col("file").alias("to"), "name")
    imported = facts.where("fact = 'import' and extra is not null").select("file", "name", F.concat(F.regexp_replace(F.regexp_replace("target", r"^\.+", ""), r"\.", "/"), F.lit(".py")).alias("tail"), F.col("extra").alias("real"))
    other = functions.select(F.col("file").alias("to"), F.col("name").alias("real"))
    via = calls.join(imported, ["file", "name"]).join(other, "real").where(F.col("to").endswith(F.col("tail"))).select("file", "caller", "to", F.col("real").alias("name"))
    node = lambda file, name: F.concat(F.lit("Function:"), file, F.lit("#"), name)
    rows = local.unionByName(via).select(node(F.col("file"), F.col("caller")).alias("src"), node(F.col("to"), F.col("name")).alias("dst")).where("src <> dst").distinct()
    return rows.select(edge_id(F.lit("CALLS"), F.col("src"), F.col("dst")).alias("id"), "src", "dst", F.lit("CALLS").alias("kind"))


#: What a model view set answers, as (method, below an object).
VIEWSET_ROUTES = (("GET", False), ("POST", False), ("GET", True), ("PUT", True), ("PATCH", True), ("DELETE", True))


def signal_nodes(facts: DataFrame) -> DataFrame:
    """EXT-18: Signal nodes of receivers and of connect() calls."""
    rows = facts.where("fact = 'signal'")
    return rows.select(_signal().alias("id"), F.lit("Signal").alias("kind"), F.concat("extra", F.lit(":"), "name").alias("name"), "file", "line", F.create_map(F.lit("signal"), F.col("extra"), F.lit("sender"), F.col("target")).alias("meta"), "ord")


def _signal():
    return F.concat(F.lit("Signal:"), F.concat_ws("#", "file", "extra", F.coalesce("target", F.lit("any")), "name"))


def use_edges(facts: DataFrame) -> DataFrame:
    """JOIN-10: models refer to their fields and use their managers, serializers the fields they show, views the
    models of their query sets, functions and managers those they query; handlers are registered in signals."""
    node = lambda kind, *parts: F.concat(F.lit(kind + ":"), F.concat_ws("#", *parts))
    last = lambda fact: facts.where(F.col("fact") == fact).groupBy("name").agg(F.max_by("file", F.struct("file", "ord")).alias("at"))
    edge = lambda rows, src, dst, kind="USES": rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    models, managers = last("model"), last("manager")
    model = node("Model", "at", "name")
    fields = facts.where("fact = 'field'").select("file", "owner", "name")
    out = edge(fields, node("Model", "file", "owner"), node("Field", "file", "owner", "name"), "REFERENCES")
    own = facts.where("fact = 'model_manager'").select("file", F.element_at(F.split("owner", r"\."), -1).alias("model"), F.col("target").alias("name")).join(managers, "name")
    out = out.unionByName(edge(own, node("Model", "file", "model"), node("Manager", "at", "name")))
    shown = facts.where("fact = 'serializer_field'").select("file", F.col("name").alias("serializer"), F.col("target").alias("field"))
    shown = shown.join(facts.where("fact = 'serializer_model'").select("file", F.col("name").alias("serializer"), F.col("target").alias("name")), ["file", "serializer"]).join(models, "name")
    held = fields.select(F.col("file").alias("at"), F.col("owner").alias("name"), F.col("name").alias("own"))
    shown = shown.join(held, ["at", "name"]).where("field = own or field = '__all__'")
    out = out.unionByName(edge(shown, node("Serializer", "file", "serializer"), node("Field", "at", "name", "own")))
    views = facts.where("fact = 'view_model'").select("file", F.col("name").alias("view"), F.col("target").alias("name")).join(models, "name")
    out = out.unionByName(edge(views, node("ViewSet", "file", "view"), model))
    kinds = facts.where("fact in ('view', 'manager')").select("file", F.col("name").alias("first"), F.when(F.col("fact") == "view", "ViewSet").otherwise("Manager").alias("owned")).distinct()
    asked = facts.where("fact = 'queryset' and owner is not null").select("file", "owner", F.substring_index("owner", ".", 1).alias("first"), "name").join(models, "name").join(kinds, ["file", "first"], "left")
    asker = F.when(F.col("owned").isNull(), node("Function", "file", "owner")).otherwise(F.concat("owned", F.lit(":"), "file", F.lit("#"), "first"))
    out = out.unionByName(edge(asked, asker, model))
    signals = facts.where("fact = 'signal'").select("file", "name", "target", "extra")
    out = out.unionByName(edge(signals, node("Function", "file", "name"), _signal(), "REGISTERED_IN"))
    heard = signals.select("file", F.col("name").alias("handler"), F.col("target").alias("name")).join(models, "name")
    return out.unionByName(edge(heard, node("Function", "file", "handler"), model)).distinct()


def view_fields(facts: DataFrame) -> DataFrame:
    """JOIN-02: (handler, response_fields): the model fields that a view's serializer shows, as (id, name)."""
    latest = lambda fact: facts.where(F.col("fact") == fact).groupBy("name").agg(F.max_by("target", F.struct("file", "ord")).alias("to"))
    shown = facts.where("fact = 'serializer_field'").select(F.col("name").alias("serializer"), F.col("target").alias("field")).distinct()
    made = latest("view_serializer").select(F.col("name").alias("handler"), F.col("to").alias("serializer")).join(latest("serializer_model").select(F.col("name").alias("serializer"), F.col("to").alias("model")), "serializer")
    rows = made.join(shown, "serializer").join(_model_fields(facts), "model").where("field = own or field = '__all__'").select("handler", "id", F.col("own").alias("name")).distinct()
    return rows.groupBy("handler").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("response_fields"))


def _model_fields(facts: DataFrame) -> DataFrame:
    """(model, own, id): the fields of models; of models of one name, those of the last file."""
    models = facts.where("fact = 'model'").groupBy("name").agg(F.max_by("file", F.struct("file", "ord")).alias("at"))
    fields = facts.where("fact = 'field'").select("file", F.col("owner").alias("name"), F.col("name").alias("own")).join(models, "name").where("file = at")
    return fields.select(F.col("name").alias("model"), "own", F.concat(F.lit("Field:"), "file", F.lit("#"), "name", F.lit("#"), "own").alias("id"))


def answer_fields(facts: DataFrame) -> DataFrame:
    """JOIN-02: (shows, response_fields): the fields of a model that a route names as its answer."""
    rows = _model_fields(facts).select(F.col("model").alias("shows"), F.struct("id", F.col("own").alias("name")).alias("x")).distinct()
    return rows.groupBy("shows").agg(F.array_sort(F.collect_list("x")).alias("response_fields"))


def url_mounts(facts: DataFrame, files: DataFrame) -> DataFrame:
    """GRF-06: (file, prefix): where each URL file is mounted, by walking include() from the root one. Modules
    are files below the folder of manage.py. A file's includes are followed once, so circles end."""
    steps = Steps(facts.sparkSession, "mounts")
    base = files.where(basename(F.col("path")) == "manage.py").agg(F.coalesce(F.max(dirname(F.col("path"))), F.lit("")).alias("base"))
    located = lambda rows: rows.join(F.broadcast(base)).withColumn("at", F.concat(F.when(F.col("base") != "", F.concat("base", F.lit("/"))).otherwise(""), F.regexp_replace("target", r"\.", "/"), F.lit(".py")))
    includes = steps.put(located(facts.where("fact = 'include'")).select("file", F.col("at").alias("child"), F.coalesce("extra", F.lit("")).alias("below")), "includes")
    root = located(facts.where("fact = 'root_urlconf'").agg(F.max_by("target", F.struct("file", "ord")).alias("target")).where("target is not null"))
    level = steps.put(root.select(F.col("at").alias("file"), F.lit("").alias("prefix")), "0")
    every = level
    for k in count(1):
        fresh = steps.put(level.join(includes, "file").select(F.col("child").alias("file"), F.concat("prefix", "below").alias("prefix")), str(k))
        if fresh.isEmpty():
            break
        level = fresh.join(every.select("file").distinct(), "file", "left_anti")
        every = every.unionByName(fresh)
    return every


def router_prefixes(facts: DataFrame) -> DataFrame:
    """GRF-07: (router, prefix) of nested routers: each below the object its parent registered, to any depth."""
    steps = Steps(facts.sparkSession, "nested")
    nested = facts.where("fact = 'nested_router'").groupBy("name").agg(F.max_by(F.struct("owner", "target", "extra"), F.struct("file", "ord")).alias("x"))
    nested = steps.put(nested.select("name", F.col("x.owner").alias("parent"), F.concat("x.target", F.lit("/{"), "x.extra", F.lit("_pk}/")).alias("own")), "routers")
    level = steps.put(nested.join(nested.select(F.col("name").alias("parent")), "parent", "left_anti").select(F.col("name").alias("router"), F.col("own").alias("prefix")), "0")
    every = level
    for k in count(1):
        level = steps.put(level.join(nested, F.col("router") == F.col("parent")).select(F.col("name").alias("router"), F.concat("prefix", "own").alias("prefix")), str(k))
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every


def drf_routes(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """JOIN-11: (method, path, handler, file): registered view sets times their methods, read-only ones GET only,
    below the prefixes of nested routers and, given files, of the URL files that include them."""
    views = facts.where("fact = 'view'").select(F.col("name").alias("handler"), F.col("extra").contains("ReadOnly").alias("read_only"), F.col("file").alias("view_file"))
    kinds = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(one).alias("one")) for m, one in VIEWSET_ROUTES])
    rows = facts.where("fact = 'registration'").select("file", F.col("name").alias("router"), F.col("extra").alias("prefix"), F.col("target").alias("handler")).join(views, "handler")
    nested = router_prefixes(facts).withColumnRenamed("prefix", "above")
    rows = rows.join(nested, "router", "left").withColumn("prefix", F.concat(F.coalesce("above", F.lit("")), "prefix"))
    if files is not None:
        rows = rows.join(url_mounts(facts, files).withColumnRenamed("prefix", "mount"), "file", "left").withColumn("prefix", F.concat(F.coalesce("mount", F.lit("")), "prefix"))
    rows = rows.withColumn("r", F.explode(kinds)).where((F.col("r.method") == "GET") | ~F.col("read_only"))
    path = F.regexp_replace(F.concat(F.lit("/"), "prefix", F.lit("/"), F.when(F.col("r.one"), "{id}/").otherwise("")), "/+", "/")
    return rows.select(F.col("r.method").alias("method"), path.alias("path"), "handler", F.col("view_file").alias("file")).distinct()
