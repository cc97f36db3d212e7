"""What the findings of round 3 were about, on small inputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, linker, rules
from graphloom.plans import more_queries, queries
from graphloom.sources import parsing, python_facts, scopes, ts_facts


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("source, path, text", [(ts_facts, "a.ts", "export const F = () => 1;\n"), (python_facts, "a.py", "def f():\n    return 1\n")])
def test_files_are_parsed_once_on_all_cores(spark, source, path, text):
    """Joins over facts parse nothing, and few partitions are parsed by all cores."""
    files = spark.createDataFrame([(path, text)], "path string, content string").coalesce(1)
    assert "InArrow" not in plan(source.extract(files)) and "EvalPython" not in plan(source.extract(files))
    cores = spark.sparkContext.defaultParallelism
    assert source.found(files).rdd.getNumPartitions() == parsing.TASKS * cores > 1


def test_facts_of_many_files_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(parsing, "TASKS", 1)
    files = spark.range(3000).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.lit("import a\nimport b\n" * 10).alias("content"))
    assert python_facts.found(files).groupBy("file").count().where("count = 20").count() == 3000


def test_calls_and_routes_are_derived_once(spark):
    """each way of matching reads calls and routes, and derives neither again."""
    asked = F.udf(lambda k: f"/a/{k}", "string")(F.col("id"))
    calls = spark.range(3).select(F.col("id").alias("call_ord"), F.lit("GET").alias("method"), asked.alias("full_url"), F.lit(False).alias("dynamic"))
    routes = spark.range(2).select(F.col("id").alias("route_ord"), F.lit("GET").alias("method"), asked.alias("path"), F.concat(F.lit("E"), "id").alias("endpoint_id"), F.array().cast("array<struct<id:string,name:string>>").alias("response_fields"))
    assert "EvalPython" not in plan(linker.candidates(calls, routes))
    assert {(r.call_ord, r.endpoint_id) for r in linker.link(calls, routes).collect()} == {(0, "E0"), (1, "E1"), (2, None)}


@pytest.mark.parametrize("flags", [("R", "A", "N"), ("A", "N", "R"), ("N", "R", "A")])
def test_best_seed_of_equal_lines_is_the_first(spark, tmp_path, flags):
    """lines of one order, number and part."""
    rows = [(9, 5, 3, "X"), *[(1, 5, 3, f) for f in flags], (1, 5, 2, "Y"), (1, 6, 1, "Z")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.id, r.reason, r.priority) for r in more_queries.win03_best_seed(spark, str(tmp_path)).collect()}
    assert got == {("Part:5", flags[0], 3), ("Part:6", "Z", 1)}


def test_one_barrel_shows_every_component(spark, tmp_path):
    """index.ts shows all, past one file of BESIDE lines."""
    spark.range(1, 1000).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    rows = more_queries.join06_barrel(spark, str(tmp_path)).collect()
    assert {r.real for r in rows} == {f"C{max(1, k // 2)}" for k in range(1, 1000)} and {r.file for r in rows} == {"index.ts"} and len(rows) == 499


def test_ignored_issues_read_edges_only_for_nodes_without_a_file(spark):
    """the neighbours of nodes are asked for only where a node has no file."""
    nodes = spark.createDataFrame([("a", "X", "a", "gen/a.ts"), ("b", "X", "b", "src/b.ts"), ("c", "X", "c", None), ("e", "X", "e", None)], "id string, kind string, name string, file string")
    issues = spark.createDataFrame([("1", ["a"], None), ("2", ["a", "b"], None), ("3", ["a"], {"file": "src/z.ts"}), ("4", [], {"file": "gen/z.ts"}), ("5", ["File:gen/y.ts"], None)], "issue_id string, nodes array<string>, meta map<string,string>")
    never = spark.range(1).select(F.raise_error(F.lit("edges were read")).cast("string").alias("src"), F.lit("a").alias("dst"))
    ids = lambda rows: {r.issue_id for r in rows.collect()}
    assert ids(rules.filter_ignored(issues, nodes, never, ["gen/**"])) == {"2", "3"}
    more = issues.unionByName(spark.createDataFrame([("6", ["c"], None), ("7", ["e"], None), ("8", ["c", "e"], None), ("9", ["gone"], None), ("10", ["b", "c"], None)], issues.schema))
    edges = spark.createDataFrame([("c", "a"), ("b", "e"), ("e", "a"), ("e", "c")], "src string, dst string")
    assert ids(rules.filter_ignored(more, nodes, edges, ["gen/**"])) == {"2", "3", "7", "8", "9", "10"}


def test_plain_stretches_of_a_script_are_one_step(monkeypatch):
    """Tokens are told apart only where a quote, a bracket, a slash or an angle needs them."""

    class Counted:
        n, real = 0, scopes.TOKEN

        def match(self, *at):
            Counted.n += 1
            return self.real.match(*at)

        def finditer(self, *at):
            return self.real.finditer(*at)

    monkeypatch.setattr(scopes, "TOKEN", Counted())
    assert scopes.scopes("const a = b + c;\n" * 100 + "x = 'y';\n").mask.endswith("x = ' ';\n") and Counted.n == 1


def test_a_slash_after_a_plain_stretch_is_told_by_its_last_token():
    assert scopes.scopes("return /a'b/.test(x) + 'c'").mask == "return /   /.test(x) + ' '"
    assert scopes.scopes("x = a / b / 'c'").mask == "x = a / b / ' '"
    assert scopes.scopes("i++ /a/ 'b'").mask == "i++ /a/ ' '" and scopes.scopes("f = () => /a'/").mask == "f = () => /  /"


def test_every_pattern_with_needed_texts_is_found_by_them():
    text = "import A from './a';\nexport { B } from './b';\nexport default function F() { return axios.get('/x'); }\nexport const C = React.createContext(null);\nconst lazy = import('./l');\nconst api = axios.create({ baseURL: '/v1' });\nconst router = express.Router();\nexport { router as r };\nfetch('/y');\ninterface T { a: string }\nconst G = () => useContext(C);\n"
    found = [(f["fact"], f["name"]) for f in ts_facts.facts_of(text)]
    for pair in (("import", "A"), ("re_export", "B"), ("api_call", "axios"), ("api_call", "fetch"), ("context", "C"), ("dynamic_import", "lazy"), ("axios", "api"), ("express", "router"), ("type", "T"), ("consumes", "C"), ("declaration", "F")):
        assert pair in found


def test_dotted_names_are_not_printed(monkeypatch):
    """the names of calls and mounts are read off the tree, by visitors that leave leaves out."""
    monkeypatch.setattr(python_facts.ast, "unparse", None)
    found = python_facts.facts_of("def f():\n    a.b.c(d)\napp.include_router(x.r, prefix='/p')\n")
    assert [(f["fact"], f["name"], f["target"]) for f in found] == [("function", "f", None), ("call", "a.b.c", None), ("mount", "app", "x.r")]


def test_components_move_numbers(spark, monkeypatch):
    """the loops over components read and write numbers; ids are named once at the end."""
    tables, put = {}, graph.Steps.put
    monkeypatch.setattr(graph.Steps, "put", lambda self, df, name: tables.setdefault(name, df) and put(self, df, name))
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "a"), ("c", "b"), ("x", "x"), ("z", "y"), ("y", "w"), ("w", "z"), ("w", None)], "src string, dst string")
    got = {(r.id, r.component) for r in graph.strongly_connected(edges).collect()}
    assert got == {("a", "a"), ("b", "a"), ("x", "x"), ("w", "w"), ("y", "w"), ("z", "w")}
    assert {n for n, df in tables.items() if "string" in {t for _, t in df.dtypes}} == {"named", "numbers"}


def test_boundaries_move_no_edge_ids(spark, tmp_path):
    """what the query does not return passes no shuffle, and edges are not sorted to meet nodes."""
    spark.createDataFrame([(1, "a", 3), (2, "b", 12)], "c_custkey long, c_name string, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, "s", 20), (2, "t", 12)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, 1), (2, 2)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = queries.rul04_boundaries(spark, str(tmp_path))
    physical = rows._jdf.queryExecution().executedPlan().toString()
    assert "USES:" not in physical and "->" not in physical and physical.count("ShuffledHashJoin") == 3
    assert {(r.src, r.dst, r.rule) for r in rows.collect()} == {("Customer:1", "Supplier:1", "deny"), ("Customer:2", "Supplier:1", "deny")}


def test_op3_judges_400_bytes_and_the_pipeline_51_words(spark, tmp_path):
    """op3_suffix_dedup: n_bytes is the input's size whatever is removed; a planted passage under 400 bytes is the third stage's."""
    import corpus_pipeline
    from graphloom.llm.queries import op3_suffix_dedup

    rng = random.Random(4)
    some = lambda n, size: " ".join("".join(rng.choice("abcdefgh") for _ in range(size)) for _ in range(n))
    short, long = some(55, 5), some(55, 8)
    assert len(short) < 400 < len(long)
    parts = [(some(70, 6), p, some(70, 6)) for p in (short, short, long, long, some(55, 8))]
    texts = [f"{a} {k}{p}{k} {b}" for k, (a, p, b) in enumerate(parts)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_dedup(spark, str(tmp_path)).collect()}
    kept = [t.replace(long, "") for t in texts]
    assert got == {k: (len(t), len(t) - len(x), int(t != x), hashlib.sha256(x.encode()).hexdigest()) for k, (t, x) in enumerate(zip(texts, kept))}
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    inner = " ".join(short.split()[1:-1]), " ".join(long.split()[1:-1])
    assert all(x not in t for t in left.values() for x in inner) and left[4] == texts[4]
