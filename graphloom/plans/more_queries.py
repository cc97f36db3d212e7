"""More registered queries: operators over the driver's tables, and extractors over files rendered from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import diff as D
from graphloom.operators import graph as G
from graphloom.operators import insights as I
from graphloom.operators import linker as L
from graphloom.operators import rules as R
from graphloom.operators import search as S
from graphloom.operators import views as V
from graphloom.plans import adapters as A
from graphloom.plans import projects
from graphloom.plans.analyze import endpoints
from graphloom.plans.queries import _endpoint_nodes, query
from graphloom.sinks import reports
from graphloom.sources import coverage, python_facts, routers, ts_facts
from graphloom.sources import files as file_source

# --- graph and search ------------------------------------------------------------------------------


@query("""
WITH RECURSIVE r AS (SELECT doc_id FROM documents WHERE source = 'src3' UNION SELECT d.doc_id FROM r JOIN documents d ON d.doc_id // 2 = r.doc_id AND d.doc_id > 0)
SELECT 'Function:' || doc_id AS id FROM r
""")
def grf10_file_impact(spark, d):
    return G.file_impact(*A.doc_nodes(spark, d), "File:src/src3.py").select("id")


@query("SELECT 'Part:' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'any' END AS kind FROM part")
def set01_fragments(spark, d):
    part = A.table(spark, d, "part").select(A.ref("Part", "p_partkey").alias("id"), "p_size", F.col("p_partkey").alias("ord"))
    return G.union_fragments(part.where("p_size % 2 = 0").select("id", F.lit("even").alias("kind"), "ord"), part.select("id", F.lit("any").alias("kind"), "ord")).select("id", "kind")


@query(f"""
WITH {A.SALES_SQL}, v AS (SELECT id FROM nodes WHERE kind IN ('Region', 'Nation', 'Customer')), e AS (SELECT * FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v))
SELECT id, (SELECT count(*) FROM e WHERE dst = v.id) AS fan_in, (SELECT count(*) FROM e WHERE src = v.id) AS fan_out FROM v
""")
def agg24_view_degrees(spark, d):
    nodes, edges = A.sales_graph(spark, d)
    return G.degrees(*G.view(nodes, edges, F.col("kind").isin("Region", "Nation", "Customer")))


@query("""
WITH r AS (SELECT l_partkey AS part, l_returnflag AS reason, l_linenumber AS priority, l_orderkey AS ord FROM lineitem)
SELECT 'Part:' || part AS id, arg_max(reason, (priority, -ord)) AS reason, max(priority) AS priority FROM r GROUP BY part
""")
def win03_best_seed(spark, d):
    """Lines of one order, number and part are told apart by their place in the table: the first is the one that SQL keeps."""
    place = F.struct("l_orderkey", "_metadata.file_path", "_metadata.row_index")
    rows = A.table(spark, d, "lineitem").select(A.ref("Part", "l_partkey").alias("id"), F.col("l_returnflag").alias("reason"), F.col("l_linenumber").alias("priority"), place.alias("ord"))
    return S.best_seed(rows)


@query("""
WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_nationkey AS ord, 10 + (n_nationkey * 7) % 31 AS n FROM nation),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS took UNION ALL SELECT s.i, CASE WHEN used + s.n <= 200 THEN used + s.n ELSE used END, CASE WHEN used + s.n <= 200 THEN s.ord END FROM f JOIN s ON s.i = f.i + 1)
SELECT took AS ord FROM f WHERE took IS NOT NULL
""")
def win12_path_budget(spark, d):
    return S.path_budget(A.table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), (10 + (F.col("n_nationkey") * 7) % 31).alias("n")), 200)


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages)
SELECT 'APIEndpoint:' || p.page_id AS id, 'get' AS method, path, (SELECT 'Function:' || min(x.page_id) FROM p x WHERE x.page_id // 3 = p.page_id) AS exposed_by, (SELECT 'Page:' || min(x.page_id) FROM p x WHERE x.page_id // 2 = p.page_id) AS caller FROM p
""")
def join25_api_map(spark, d):
    pages = A.table(spark, d, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    nodes = pages.select(A.ref("APIEndpoint", "page_id").alias("id"), F.lit("APIEndpoint").alias("kind"), F.col("url").alias("name"), F.create_map(F.lit("method"), F.lit("get"), F.lit("path"), path).alias("meta"))
    ends = lambda kind, who, by: pages.select(F.lit(kind).alias("kind"), A.ref(who, "page_id").alias("src"), F.concat(F.lit("APIEndpoint:"), F.floor(F.col("page_id") / by).cast("string")).alias("dst"), F.col("page_id").alias("ord"))
    return S.api_map(nodes, ends("EXPOSES", "Function", 3).unionByName(ends("CALLS", "Page", 2))).select("id", "method", "path", "exposed_by", "caller")


@query("""
WITH r(repo_id, role, ord) AS (VALUES ('shop', 'frontend', 2), ('web', 'frontend', 1), ('api', 'backend', 3), ('misc', 'other', 4)),
n AS (SELECT 'Customer:' || c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN 'shop/n.ts' WHEN 1 THEN 'frontend/n' || c_nationkey || '.ts' WHEN 2 THEN 'other/x.ts' ELSE 'api/n/' || c_custkey || '.ts' END AS file FROM customer
 UNION ALL SELECT 'Supplier:' || s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN NULL WHEN s_nationkey % 5 = 1 THEN 'shop.ts' ELSE 'backend/s.py' END FROM supplier),
f AS (SELECT id, coalesce((SELECT arg_min(repo_id, ord) FROM r WHERE starts_with(file, repo_id || '/')), (SELECT arg_min(repo_id, ord) FROM r WHERE role <> 'other' AND starts_with(file, role || '/'))) AS repo_id FROM n)
SELECT id, repo_id FROM f WHERE repo_id IS NOT NULL
""")
def join31_node_repo(spark, d):
    repos = spark.createDataFrame([("shop", "frontend", 2), ("web", "frontend", 1), ("api", "backend", 3), ("misc", "other", 4)], "repo_id string, role string, ord int")
    k, n = F.col("c_nationkey"), F.col("s_nationkey") % 5
    buyers = F.when(k % 4 == 0, "shop/n.ts").when(k % 4 == 1, F.concat(F.lit("frontend/n"), k.cast("string"), F.lit(".ts"))).when(k % 4 == 2, "other/x.ts").otherwise(F.concat(F.lit("api\\n\\"), F.col("c_custkey").cast("string"), F.lit(".ts")))
    sellers = F.when(n == 0, None).when(n == 1, "shop.ts").otherwise("backend/s.py")
    nodes = A.table(spark, d, "customer").select(A.ref("Customer", "c_custkey").alias("id"), buyers.alias("file")).union(A.table(spark, d, "supplier").select(A.ref("Supplier", "s_suppkey"), sellers))
    return S.node_repo(nodes, repos)


@query("""
WITH t AS (SELECT 'src/' || p_brand || '/' || p_partkey || '.tsx' AS path, p_partkey FROM part)
SELECT CASE p_partkey % 3 WHEN 0 THEN path WHEN 1 THEN '/ci/build/' || path ELSE substr(path, 5) END AS file, path, CAST(1 AS INT) AS total FROM t WHERE p_partkey % 5 <> 4
""")
def join16_coverage_paths(spark, d):
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".tsx"))
    rows = A.table(spark, d, "part").select(path.alias("path"), F.col("p_partkey").alias("scan_ord"))
    file = F.when(F.col("scan_ord") % 3 == 0, F.col("path")).when(F.col("scan_ord") % 3 == 1, F.concat(F.lit("/ci/build/"), "path")).otherwise(F.substring("path", 5, 1000))
    found = rows.select(file.alias("file"), F.lit(1).alias("total"), F.lit(1).alias("covered"))
    return I.match_coverage(found, rows.where("scan_ord % 5 <> 4")).select("file", "path", "total")


@query(r"""
WITH t AS (SELECT p_partkey AS k, p_partkey % 6 AS way, p_partkey - p_partkey % 6 AS base, CASE WHEN (p_partkey - p_partkey % 6) % 18 = 0 THEN '.conf' ELSE '' END AS more FROM part),
f AS (SELECT DISTINCT CASE way WHEN 0 THEN 'src/m' || (base % 20) || '/a' || base || more || '.ts' WHEN 1 THEN 'src/m' || (base % 20) || '/a' || base || more || '.test.ts' WHEN 2 THEN 'src/m' || (base % 20) || '/sub/deep/a' || base || more || '.spec.cjs'
  WHEN 3 THEN 'lib/a' || base || more || '.test.ts' WHEN 4 THEN 'a' || base || '.ts' ELSE CASE WHEN k % 12 = 5 THEN 'a' || base || '.spec.tsx' ELSE 'a' || base || '.test.js' END END AS path FROM t),
p AS (SELECT path, regexp_matches(path, '\.(test|spec)\.[cm]?[jt]sx?$') AS is_test, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]+$', '') AS base FROM f)
SELECT c.path, t.path AS test FROM p c JOIN p t ON t.is_test AND CASE WHEN c.is_test THEN c.path = t.path
  ELSE t.path IN (ltrim(c.dir || '/' || c.base || '.test.ts', '/'), ltrim(c.dir || '/' || c.base || '.test.tsx', '/'), ltrim(c.dir || '/' || c.base || '.spec.ts', '/'), ltrim(c.dir || '/' || c.base || '.spec.tsx', '/')) OR (regexp_replace(t.base, '\.(test|spec)$', '') = c.base AND starts_with(t.path, c.dir || '/')) END
""")
def join29_nearby_tests(spark, d):
    """Sources and their tests beside them, below them, in another folder and at the root; tests are asked for as well."""
    k = F.col("p_partkey")
    way, base = k % 6, k - k % 6
    name = F.concat(F.lit("/a"), base.cast("string"), F.when(base % 18 == 0, ".conf").otherwise(""))
    folder = F.concat(F.lit("src/m"), (base % 20).cast("string"))
    root = F.concat(F.lit("a"), base.cast("string"))
    path = F.when(way == 0, F.concat(folder, name, F.lit(".ts"))).when(way == 1, F.concat(folder, name, F.lit(".test.ts"))).when(way == 2, F.concat(folder, F.lit("/sub/deep"), name, F.lit(".spec.cjs")))
    path = path.when(way == 3, F.concat(F.lit("lib"), name, F.lit(".test.ts"))).when(way == 4, F.concat(root, F.lit(".ts"))).when(k % 12 == 5, F.concat(root, F.lit(".spec.tsx"))).otherwise(F.concat(root, F.lit(".test.js")))
    files = A.table(spark, d, "part").select(path.alias("path")).distinct()
    return S.nearby_tests(files, files).select("path", "test")


@query("""
WITH o AS (SELECT o_orderkey, (['brief', 'standard', 'full', 'odd'])[1 + o_orderkey % 4] AS detail, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 130 - 10.5 END AS most, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7000 - 100 END AS budget, 12 + 15 * (o_orderkey % 3) AS fallback FROM orders),
a AS (SELECT *, CASE detail WHEN 'full' THEN fallback WHEN 'standard' THEN least(fallback, 25) ELSE least(fallback, 8) END AS by_detail FROM o),
b AS (SELECT *, CASE WHEN budget > 0 THEN greatest(3, least(by_detail, floor(budget / 250.0))) ELSE by_detail END AS by_budget FROM a)
SELECT o_orderkey, CAST(CASE WHEN most > 0 THEN least(100, floor(most)) ELSE by_budget END AS INT) AS n FROM b
""")
def srt11_limits(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    detail = F.get(F.array(*[F.lit(x) for x in ("brief", "standard", "full", "odd")]), (k % 4).cast("int"))
    most, budget = F.when(c % 3 > 0, c % 130 - 10.5), F.when(k % 5 > 0, k % 7000 - 100)
    return A.table(spark, d, "orders").select("o_orderkey", S.row_limit(detail, most, budget, 12 + 15 * (k % 3)).alias("n"))


EROSION_SQL = """
e AS (SELECT DISTINCT o_orderpriority AS scan_id, o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
x AS (SELECT scan_id, count(*) AS n FROM e JOIN customer ON c_custkey = c JOIN supplier ON s_suppkey = s WHERE c_nationkey % 3 <> s_nationkey % 3 GROUP BY scan_id),
y AS (SELECT o_orderpriority AS scan_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
"""


@query(f"WITH {EROSION_SQL} SELECT DISTINCT e.scan_id, coalesce(x.n, 0) AS cross_repo, coalesce(y.n, 0) AS circular FROM e LEFT JOIN x USING (scan_id) LEFT JOIN y USING (scan_id)")
def agg21_erosion(spark, d):
    t = lambda name: A.table(spark, d, name)
    orders = t("orders")
    edges = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("scan_id"), A.ref("Customer", "o_custkey").alias("src"), A.ref("Supplier", "l_suppkey").alias("dst")).distinct()
    owned = t("customer").select(A.ref("Customer", "c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("repo_id")).union(t("supplier").select(A.ref("Supplier", "s_suppkey"), F.col("s_nationkey") % 3))
    repos = orders.select(F.col("o_orderpriority").alias("scan_id")).distinct().crossJoin(owned)
    return D.erosion(edges, repos, orders.where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("scan_id")))


@query("SELECT CAST(greatest(0, a - b) AS BIGINT) AS bytes, CAST(ceil(greatest(0, a - b) / 4.0) AS BIGINT) AS tokens FROM (SELECT sum(strlen(text)) AS a, sum(strlen(text)) FILTER (WHERE doc_id % 4 = 0) AS b FROM documents)")
def agg25_savings(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return S.savings(rows, rows.where("doc_id % 4 = 0"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[a-z]*)', 1) AS path, CASE WHEN page_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS m, url FROM pages)
SELECT 'APIEndpoint:' || page_id AS id, CASE WHEN path <> '' THEN m || ' ' || path ELSE url END AS signature FROM p
""")
def set05_signatures(spark, d):
    return D.endpoints(_endpoint_nodes(spark, d, F.when(F.col("page_id") % 3 == 0, "get").otherwise("post"), "page_id >= 0"))


@query(r"""
WITH p AS (SELECT regexp_extract(url, '^https?://[^/]+(/[a-z]*)', 1) AS path, CASE WHEN page_id % 3 = 0 THEN 'GET' WHEN page_id % 3 = 1 THEN 'PUT' ELSE 'POST' END AS m FROM pages)
SELECT path, string_agg(DISTINCT m, ',' ORDER BY m) AS methods FROM p WHERE path <> '' GROUP BY path
""")
def agg18_methods(spark, d):
    k = F.col("page_id") % 3
    nodes = _endpoint_nodes(spark, d, F.when(k == 0, "get").when(k == 1, "put").otherwise("post"), "page_id >= 0").where(F.col("meta")["path"] != "")
    return D.methods_by_path(D.endpoints(nodes))


@query("""
WITH used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
SELECT 'Component "' || p_name || '" is never rendered' AS message, 'src/' || p_brand || '/' || p_partkey || '.tsx' AS file, CAST(p_partkey % 90 AS INT) AS line FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM used)
""")
def join34_located(spark, d):
    nodes, edges = A.parts_graph(spark, d)
    return reports.located(R.dead_code(nodes, edges), nodes.withColumn("line", (F.col("ord") % 90).cast("int"))).select("message", "file", "line")


# --- functions -------------------------------------------------------------------------------------


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages), t AS (SELECT page_id, path || '/:id//<int:pk>/x/' AS raw, path FROM p),
r AS (SELECT *, regexp_replace(regexp_replace('/' || raw, '/+', '/', 'g'), ':([A-Za-z_][A-Za-z0-9_]*)', '{\1}', 'g') AS named, regexp_replace(raw, '<([^:<>]+:)?([^<>]+)>', '{\2}', 'g') AS typed FROM t)
SELECT page_id, regexp_replace(named, '/$', '') AS route, typed, regexp_replace('/' || raw, '/+', '/', 'g') AS norm, 'http://h' || path AS joined FROM r
""")
def fn_routes(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    raw = F.concat(path, F.lit("/:id//<int:pk>/x/"))
    return A.table(spark, d, "pages").where("url is not null").select("page_id", T.route_path(raw).alias("route"), T.typed_params(raw).alias("typed"), T.norm_path(raw).alias("norm"), T.join_url(F.lit("http://h/"), path).alias("joined"))


@query("SELECT doc_id, CAST(greatest(0, least(100, floor(n_chars / 40.0::DOUBLE + 0.5))) AS BIGINT) AS percent, CAST(ceil(n_chars / 4.0::DOUBLE) AS BIGINT) AS tokens FROM documents")
def fn28_percent(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.clamp_percent(F.col("n_chars") / 40.0).cast("long").alias("percent"), T.tokens_estimate(F.col("n_chars")).cast("long").alias("tokens"))


@query(r"SELECT p_partkey, 'src/' || p_brand || '/x' || p_partkey || '.ts' AS path FROM part")
def fn22_report_path(spark, d):
    raw = F.concat(F.lit(".\\build\\src//"), "p_brand", F.lit("\\x"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    return A.table(spark, d, "part").select("p_partkey", T.report_path(raw, "build").alias("path"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'docs/a#b' ELSE 'p' || p_partkey END AS path FROM part")
def prj06_node_path(spark, d):
    even = F.col("p_size") % 2 == 0
    rows = A.table(spark, d, "part").select("p_partkey", F.when(even, "File").otherwise("Thing").alias("kind"), F.when(even, "docs/a#b").alias("name"), F.lit(None).cast("string").alias("file"), F.concat(F.lit("Thing:p"), F.col("p_partkey").cast("string"), F.lit("#x")).alias("id"))
    return rows.select("p_partkey", T.node_path(F.col("kind"), F.col("name"), F.col("file"), F.col("id")).alias("path"))


# --- reports and files rendered from the tables ------------------------------------------------------


@query("""
SELECT 'r' || doc_id AS report, 'a/' || doc_id AS file, CAST(2 AS BIGINT) AS total, CAST(CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END AS BIGINT) AS covered FROM documents UNION ALL SELECT 'r' || doc_id, 'b/' || source, 1, 1 FROM documents
""")
def win05_lcov(spark, d):
    docs = A.table(spark, d, "documents")
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x], F.lit("\n"))
    text = F.concat(line("TN:t"), line("DA:7,7"), line("SF:a/", F.col("doc_id")), line("DA:1,", F.col("doc_id") % 3), line("DA:2,0"), line("end_of_record"), line("DA:9,9"), line("SF:b/", F.col("source")), line("DA:5,1"), line("end_of_record"))
    return coverage.lcov(docs.select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("report"), text.alias("content")))


@query("""
SELECT 'r' || doc_id AS report, 'a/' || doc_id AS file, CAST(3 AS BIGINT) AS total, CAST(1 + CASE WHEN doc_id % 2 > 0 THEN 1 ELSE 0 END AS BIGINT) AS covered FROM documents UNION ALL SELECT 'r' || doc_id, 'b', 9, doc_id % 9 FROM documents
""")
def src08_istanbul(spark, d):
    docs = A.table(spark, d, "documents")
    k = F.col("doc_id")
    text = F.concat(F.lit('{"a/'), k.cast("string"), F.lit('": {"s": {"0": 4, "1": 0, "2": '), (k % 2).cast("string"), F.lit('}}, "total": {"lines": {"total": 1, "covered": 1}}, "b": {"lines": {"total": 9, "covered": '), (k % 9).cast("string"), F.lit("}}}"))
    return coverage.istanbul(docs.select(F.concat(F.lit("r"), k.cast("string")).alias("report"), text.alias("content")))


@query("SELECT DISTINCT 'src/' || source || '.py' AS path FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT 'new/' || (doc_id % 50) FROM documents")
def src16_changed_paths(spark, d):
    docs = A.table(spark, d, "documents").where("source is not null")
    k = (F.col("doc_id") % 50).cast("string")
    text = F.concat(F.lit("diff --git a/old b/src/"), "source", F.lit(".py\n--- a/old\n+++ b/new/"), k, F.lit("\n@@ -1 +1 @@\n-x\n+y\n+++ b//dev/null\n"))
    return file_source.changed_paths(docs.select(F.regexp_replace(text, "b//dev/null", "/dev/null").alias("text")))


def _rendered(df, path, content):
    return df.select(path.alias("path"), content.alias("content"))


def _models(spark, d):
    """A Python file per customer: a model that refers to the customer of half its key, a serializer, a view set,
    a registration, a function that calls another, and an import of the module of half its key."""
    k, half = F.col("c_custkey").cast("string"), F.greatest(F.lit(1), F.floor(F.col("c_custkey") / 2)).cast("string")
    parts = ["from django.db import models\nfrom app.m", half, " import M", half, "\nclass M", k, "(models.Model):\n    name = models.CharField(max_length=9)\n    up = models.ForeignKey('M", half, "', on_delete=models.CASCADE)\n\nclass S", k, "(serializers.ModelSerializer):\n    class Meta:\n        model = M", k, "\n        fields = ['name']\n\nclass V", k, "(viewsets.ModelViewSet):\n    serializer_class = S", k, "\n\ndef helper():\n    return 1\n\ndef work():\n    return helper()\n\nrouter.register('c", k, "', V", k, ")\n"]
    return _rendered(A.table(spark, d, "customer"), F.concat(F.lit("app/m"), k, F.lit(".py")), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


@query("SELECT 'app/m' || c_custkey || '.py' AS file, fact, name FROM customer, (VALUES ('model', 'M'), ('serializer', 'S'), ('view', 'V')) AS f(fact, lead), LATERAL (SELECT lead || c_custkey AS name)")
def ext13_python_classes(spark, d):
    return python_facts.found(_models(spark, d)).where("fact in ('model', 'serializer', 'view')").select("file", "fact", "name")


@query("""
WITH c AS (SELECT c_custkey AS k, greatest(1, c_custkey // 2) AS h FROM customer)
SELECT 'Model:app/m' || k || '.py#M' || k AS src, 'Model:app/m' || h || '.py#M' || h AS dst, 'REFERENCES' AS kind FROM c
UNION ALL SELECT 'Serializer:app/m' || k || '.py#S' || k, 'Model:app/m' || k || '.py#M' || k, 'USES' FROM c UNION ALL SELECT 'ViewSet:app/m' || k || '.py#V' || k, 'Serializer:app/m' || k || '.py#S' || k, 'USES' FROM c
""")
def join10_model_edges(spark, d):
    return python_facts.model_edges(python_facts.extract(_models(spark, d))).select("src", "dst", "kind")


@query("SELECT 'File:app/m' || c_custkey || '.py' AS src, 'File:app/m' || greatest(1, c_custkey // 2) || '.py' AS dst FROM customer WHERE c_custkey <> 1")
def join08_python_imports(spark, d):
    files = _models(spark, d)
    return python_facts.import_edges(python_facts.extract(files), files).select("src", "dst")


@query("SELECT 'Function:app/m' || c_custkey || '.py#work' AS src, 'Function:app/m' || c_custkey || '.py#helper' AS dst FROM customer")
def join09_python_calls(spark, d):
    return python_facts.call_edges(python_facts.extract(_models(spark, d))).select("src", "dst")


@query("""
SELECT method, '/api/c' || c_custkey || CASE WHEN one THEN '/{id}/' ELSE '/' END AS path, 'V' || c_custkey AS handler FROM customer, (VALUES ('GET', false), ('POST', false), ('GET', true), ('PUT', true), ('PATCH', true), ('DELETE', true)) AS r(method, one)
""")
def join11_drf_routes(spark, d):
    files = _mounted(spark, d)
    return python_facts.drf_routes(python_facts.extract(files), files).select("method", "path", "handler")


#: Lines of a rendered file that names other files, so that no file grows with its table.
BESIDE = 200


def _in_files(rows, key, line, path, lead="", after=""):
    """A file for every BESIDE keys: `lead`, their lines in order, `after`."""
    grouped = rows.groupBy(F.floor(key / BESIDE).alias("g")).agg(F.array_join(F.array_sort(F.collect_set(line)), "").alias("text"))
    return grouped.select(path(F.col("g").cast("string")).alias("path"), F.concat(F.lit(lead), "text", F.lit(after)).alias("content"))


def _mounted(spark, d):
    """The rendered models and URL files that include them, one level below `api/`. A URL file includes some models
    and two other URL files, so that all of them form a tree and none grows."""
    files = _models(spark, d)
    k = F.col("c_custkey")
    customer = A.table(spark, d, "customer")
    last = customer.agg(F.max(F.floor(k / BESIDE))).first()[0] or 0
    below = spark.range(last + 1).select(F.col("id").alias("g"), F.explode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2)).alias("c")).where(F.col("c") <= last)
    named = customer.select(F.floor(k / BESIDE).alias("g"), F.concat(F.lit("    path('', include('app.m"), k.cast("string"), F.lit("')),\n")).alias("line"))
    lines = named.unionByName(below.select("g", F.concat(F.lit("    path('', include('conf.all"), F.col("c").cast("string"), F.lit("')),\n")).alias("line")))
    inner = _in_files(lines, F.col("g") * BESIDE, F.col("line"), lambda g: F.concat(F.lit("conf/all"), g, F.lit(".py")), "from django.urls import path, include\nurlpatterns = [\n", "]\n")
    outer = spark.createDataFrame([("conf/urls.py", "urlpatterns = [path('api/', include('conf.all0'))]\n"), ("conf/settings.py", "ROOT_URLCONF = 'conf.urls'\n"), ("manage.py", "")], "path string, content string")
    return files.unionByName(inner).unionByName(outer)


@query("""
SELECT 'GET' AS method, '/v1/p' || p_partkey || '/items/{id}' AS path, 'read' AS handler, 'api/r' || p_partkey || '.py' AS file FROM part UNION ALL SELECT 'POST', '/v1/p' || p_partkey, 'make', 'api/r' || p_partkey || '.py' FROM part
""")
def join35_http_routes(spark, d):
    """A router file per part; an application mounts some of them."""
    k = F.col("p_partkey").cast("string")
    part = A.table(spark, d, "part")
    files = _rendered(part, F.concat(F.lit("api/r"), k, F.lit(".py")), F.concat(F.lit("from fastapi import APIRouter\nr"), k, F.lit(" = APIRouter(prefix='/p"), k, F.lit("')\n\n@r"), k, F.lit(".get('/items/{id}')\ndef read(id):\n    return id\n\n@r"), k, F.lit(".post('')\ndef make():\n    return 1\n")))
    app = _in_files(part, F.col("p_partkey"), F.concat(F.lit("app.include_router(r"), k, F.lit(", prefix='/v1')\n")), lambda g: F.concat(F.lit("api/main"), g, F.lit(".py")), "from fastapi import FastAPI\napp = FastAPI()\n")
    return python_facts.http_routes(python_facts.extract(files.unionByName(app)))


def _scripts(spark, d):
    """A component per part that renders that of half its key, through a relative import, a path alias or a
    workspace package by turns, and calls an endpoint."""
    n = F.col("p_partkey")
    k, h = n.cast("string"), F.greatest(F.lit(1), F.floor(n / 2)).cast("string")
    how = F.when(n % 3 == 0, "./").when(n % 3 == 1, "@/").otherwise("@acme/web/src/")
    text = F.concat(F.lit("import { C"), h, F.lit(" } from '"), how, F.lit("c"), h, F.lit("';\n// <Ghost />\nexport const C"), k, F.lit(" = () => {\n  useThing();\n  api.get(`/items/${id}/"), k, F.lit("`);\n  return <C"), h, F.lit(" a={1} />;\n};\n"))
    files = _rendered(A.table(spark, d, "part"), F.concat(F.lit("web/src/c"), k, F.lit(".tsx")), text)
    rest = [("web/package.json", '{"name": "@acme/web", "main": "src/c1.tsx"}'), ("tsconfig.json", '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["web/src/*"]}},\n}')]
    return files.unionByName(spark.createDataFrame(rest, "path string, content string"))


def _modules(files):
    return ts_facts.Modules(file_source.path_aliases(files), file_source.workspace_packages(files))


@query("SELECT 'File:web/src/c' || p_partkey || '.tsx' AS src, 'File:web/src/c' || greatest(1, p_partkey // 2) || '.tsx' AS dst FROM part WHERE p_partkey <> 1")
def join04_script_imports(spark, d):
    files = _scripts(spark, d)
    return ts_facts.import_edges(ts_facts.extract(files), files, _modules(files)).select("src", "dst")


@query("SELECT 'Component:web/src/c' || p_partkey || '.tsx#C' || p_partkey AS src, 'Component:web/src/c' || greatest(1, p_partkey // 2) || '.tsx#C' || greatest(1, p_partkey // 2) AS dst, 'RENDERS' AS kind FROM part WHERE p_partkey <> 1")
def join07_renders(spark, d):
    files = _scripts(spark, d)
    return ts_facts.usage_edges(ts_facts.extract(files), files, _modules(files)).select("src", "dst", "kind")


@query("SELECT 'Component:web/src/c' || p_partkey || '.tsx#C' || p_partkey AS caller_id, 'GET' AS method, '/items/{param}/' || p_partkey AS full_url, true AS dynamic, CAST(5 AS INT) AS line FROM part")
def ext09_api_calls(spark, d):
    return ts_facts.api_calls(ts_facts.extract(_scripts(spark, d))).select("caller_id", "method", "full_url", "dynamic", "line")


@query("SELECT DISTINCT 'web/src/c' || greatest(1, p_partkey // 2) || '.tsx' AS at, 'C' || greatest(1, p_partkey // 2) AS real, 'index.ts' AS file FROM part")
def join06_barrel(spark, d):
    """One barrel shows every component, through a tree of barrels, so that it is whole and no file grows with its table."""
    files = _scripts(spark, d)
    n = F.greatest(F.lit(1), F.floor(F.col("p_partkey") / 2))
    h, part = n.cast("string"), A.table(spark, d, "part")
    barrel = _in_files(part, n, F.concat(F.lit("export { C"), h, F.lit(" } from '../inner/c"), h, F.lit("';\n")), lambda g: F.concat(F.lit("index/b"), g, F.lit(".ts")))
    inner = part.select(F.concat(F.lit("inner/c"), h, F.lit(".ts")).alias("path"), F.concat(F.lit("export * from '../web/src/c"), h, F.lit("';\n")).alias("content")).distinct()
    group = part.select(F.floor(n / BESIDE).alias("g")).distinct()
    middle = _in_files(group, F.col("g"), F.concat(F.lit("export * from './b"), F.col("g").cast("string"), F.lit("';\n")), lambda g: F.concat(F.lit("index/t"), g, F.lit(".ts")))
    above = group.select(F.concat(F.lit("export * from './index/t"), F.floor(F.col("g") / BESIDE).cast("string"), F.lit("';\n")).alias("line"))
    top = _in_files(above, F.lit(0), F.col("line"), lambda g: F.lit("index.ts"))
    for more in (barrel, middle, top, inner):
        files = files.unionByName(more)
    return ts_facts.exports_closure(ts_facts.extract(files), files).where("file = 'index.ts'").select("at", "real", "file")


@query("""
SELECT 'GET' AS method, '/api/p' || p_partkey || '/x/{id}' AS path, 'show' AS handler FROM part
""")
def join13_express_routes(spark, d):
    k = F.col("p_partkey").cast("string")
    part = A.table(spark, d, "part")
    routers = _rendered(part, F.concat(F.lit("srv/r"), k, F.lit(".js")), F.lit("const router = express.Router();\nrouter.get('/x/:id', show);\nexport default router;\n"))
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    grouped = part.groupBy(F.floor(F.col("p_partkey") / BESIDE).alias("g")).agg(F.array_join(F.collect_list(line("import r", k, " from './r", k, "';\n")), "").alias("imports"), F.array_join(F.collect_list(line("app.use('/api/p", k, "', r", k, ");\n")), "").alias("mounts"))
    app = grouped.select(line("srv/app", F.col("g").cast("string"), ".js").alias("path"), line(F.col("imports"), "const app = express();\n", F.col("mounts")).alias("content"))
    files = routers.unionByName(app)
    return ts_facts.express_routes(ts_facts.extract(files), files).select("method", "path", "handler")


@query("""
WITH k AS (SELECT p_partkey AS k, p_partkey // 200 AS g, p_partkey % 4 AS c FROM part),
js AS (SELECT k, c, 'srv/r' || k || '.js' AS f, 'srv/app' || g || '.js' AS a, '/api/p' || k AS p FROM k WHERE c IN (0, 2)),
py AS (SELECT k, c, 'py/r' || k || '.py' AS f, 'py/main' || g || '.py' AS a FROM k WHERE c IN (1, 3)),
r AS (
  SELECT f, 'router' AS own, 'GET ' || p || '/x/{id}' AS called, ['auth', 'show'] AS handlers FROM js WHERE c = 0
  UNION ALL SELECT f, 'router', 'POST ' || p || '/y', ['show'] FROM js WHERE c = 0
  UNION ALL SELECT f, 'inner', 'DELETE ' || p || '/in/z', [] FROM js WHERE c = 2
  UNION ALL SELECT f, 'router', 'PUT ' || p || '/w', [] FROM js WHERE c = 2
  UNION ALL SELECT a, 'app', 'USE ' || p, ['guard'] FROM js
  UNION ALL SELECT f, 'r' || k, 'GET /p' || k || '/items/{id}', ['read'] FROM py WHERE c = 1
  UNION ALL SELECT f, 'r' || k, unnest(['GET', 'PUT']) || ' /v1/b' || k || '/{n}', ['both'] FROM py WHERE c = 3),
e AS (
  SELECT 'REGISTERED_IN' AS kind, 'Route:' || f || '#' || called AS src, 'Service:' || f || '#' || own AS dst FROM r
  UNION ALL SELECT 'EXPOSES', 'Route:' || f || '#' || called, 'APIEndpoint:' || called FROM r WHERE called NOT LIKE 'USE %'
  UNION ALL SELECT 'USES', 'Route:' || f || '#' || called, 'Function:' || f || '#' || unnest(handlers) FROM r
  UNION ALL SELECT 'REGISTERED_IN', 'Service:' || f || '#router', 'Service:' || a || '#app' FROM js
  UNION ALL SELECT 'REGISTERED_IN', 'Service:' || f || '#inner', 'Service:' || f || '#router' FROM js WHERE c = 2
  UNION ALL SELECT 'REGISTERED_IN', 'Service:' || f || '#r' || k, 'Service:' || a || '#web' FROM py WHERE c = 3)
SELECT kind, src, dst FROM e
""")
def join35_route_graph(spark, d):
    """A router file per part, in four shapes: Express with middleware, a chained route and text that looks like code; two
    Express routers of which a renamed one is exported; FastAPI that nobody mounts; a Flask blueprint."""
    n = F.col("p_partkey")
    k, g = n.cast("string"), F.floor(n / BESIDE)
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    plain = F.lit("const router = express.Router();\nfunction auth(q, s, n) { n(); }\nconst show = (q, s) => { s.end(); };\n// router.get('/never', show);\nconst note = \"router.get('/text', show)\";\nrouter.get('/x/:id', auth, [missing, show]);\nrouter.route('/y').post(show);\nexport default router;\n")
    nested = line("const inner = Router();\nconst router = Router();\nrouter.use('/in', inner);\ninner.delete(`/z`, drop);\nrouter.put('w', function (q, s) { s.end(); });\nexport { router as r", k, " };\n")
    fast = line("from fastapi import APIRouter\nr", k, " = APIRouter(prefix='/p", k, "/')\n\n@r", k, ".get('/items/{id}')\ndef read(id):\n    return '@r.get(1)'\n")
    flask = line("from flask import Blueprint\nr", k, " = Blueprint('b', __name__, url_prefix='/b", k, "')\n\n@r", k, ".route('/<int:n>', methods=['GET', 'PUT'])\ndef both(n):\n    return n\n")
    part, script = A.table(spark, d, "part"), n % 2 == 0
    files = _rendered(part, F.when(script, line("srv/r", k, ".js")).otherwise(line("py/r", k, ".py")), F.when(n % 4 == 0, plain).when(n % 4 == 2, nested).when(n % 4 == 1, fast).otherwise(flask))
    joined = lambda rows, text: F.array_join(F.collect_list(F.when(rows, text)), "")
    asked = F.when(n % 4 == 0, line("r", k)).otherwise(line("{ r", k, " }"))
    apps = part.groupBy(g.cast("string").alias("g")).agg(joined(script, line("import ", asked, " from './r", k, "';\n")).alias("imports"), joined(script, line("app.use('/api/p", k, "', guard, r", k, ");\n")).alias("uses"), joined(n % 4 == 3, line("web.register_blueprint(r", k, ", url_prefix='/v1')\n")).alias("blueprints"))
    files = files.unionByName(_rendered(apps, line("srv/app", F.col("g"), ".js"), line(F.col("imports"), "const app = express();\nfunction guard(q, s, n) { n(); }\napp.use(guard);\n", F.col("uses"))))
    files = files.unionByName(_rendered(apps, line("py/main", F.col("g"), ".py"), line("from flask import Flask\nweb = Flask(__name__)\n", F.col("blueprints"))))
    script, python = ts_facts.extract(files), python_facts.extract(files)
    js = routers.route_graph(ts_facts.express_map(script, files), ts_facts.symbols(script).select("file", "name", "id"))[1]
    return js.unionByName(routers.route_graph(python_facts.http_map(python), python_facts.functions(python))[1]).select("kind", "src", "dst")


@query("""
SELECT 'Route:ui/r' || p_partkey || '.tsx#PAGE /s' || p_partkey || '/{id}' AS id, 'Component:ui/r' || p_partkey || '.tsx#P' || p_partkey AS shows FROM part UNION ALL SELECT 'Route:ui/r' || p_partkey || '.tsx#PAGE /s' || p_partkey, NULL FROM part
""")
def join15_page_routes(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("export const P"), k, F.lit(" = () => <b>x</b>;\nexport const App = () => (\n  <Route path=\"/s"), k, F.lit("\">\n    <Route index element={<Ghost />} />\n    <Route path=\":id\" element={<P"), k, F.lit(" a={1} />} />\n  </Route>\n);\n"))
    nodes, edges = ts_facts.page_routes(ts_facts.extract(_rendered(A.table(spark, d, "part"), F.concat(F.lit("ui/r"), k, F.lit(".tsx")), text)))
    return nodes.select("id").join(edges.select(F.col("src").alias("id"), F.col("dst").alias("shows")), "id", "left")


@query("""
WITH k AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'REGISTERED_IN' AS kind, 'Service:n/c' || k || '.ts#C' || k AS src, 'Service:n/c' || k || '.ts#Mod' || k AS dst FROM k UNION ALL SELECT 'DEPENDS_ON', 'Service:n/c' || k || '.ts#C' || k, 'Service:n/c' || k || '.ts#S' || k FROM k UNION ALL SELECT 'REGISTERED_IN', 'Service:n/c' || k || '.ts#S' || k, 'Service:n/c' || k || '.ts#Mod' || k FROM k
UNION ALL SELECT 'REGISTERED_IN', 'Route:n/c' || k || '.ts#GET /n' || k || '/{id}', 'Service:n/c' || k || '.ts#C' || k FROM k UNION ALL SELECT 'EXPOSES', 'Route:n/c' || k || '.ts#GET /n' || k || '/{id}', 'APIEndpoint:GET /n' || k || '/{id}' FROM k
""")
def join14_nest(spark, d):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("@Injectable()\nexport class S"), k, F.lit(" {}\n\n@Controller('n"), k, F.lit("')\nexport class C"), k, F.lit(" {\n  constructor(private readonly s: S"), k, F.lit(") {}\n\n  @Get(':id')\n  one(@Param('id') id: string) { return id; }\n}\n\n@Module({ controllers: [C"), k, F.lit("], providers: [S"), k, F.lit("] })\nexport class Mod"), k, F.lit(" {}\n"))
    return ts_facts.nest_graph(ts_facts.extract(_rendered(A.table(spark, d, "supplier"), F.concat(F.lit("n/c"), k, F.lit(".ts")), text)))[1].select("kind", "src", "dst")


@query("SELECT 'p' || (p_partkey) AS name, 'pk/d' || p_partkey AS dir, CASE p_partkey % 3 WHEN 0 THEN 'a.js' WHEN 1 THEN 'b.js' END AS entry FROM part")
def src14_packages(spark, d):
    k = F.col("p_partkey").cast("string")
    more = F.when(F.col("p_partkey") % 3 == 0, F.lit(', "module": "a.js", "main": "z.js"')).when(F.col("p_partkey") % 3 == 1, F.lit(', "exports": {".": {"import": "b.js"}}')).otherwise(F.lit(""))
    files = _rendered(A.table(spark, d, "part"), F.concat(F.lit("pk/d"), k, F.lit("/package.json")), F.concat(F.lit('{"name": "p'), k, F.lit('"'), more, F.lit("}")))
    return file_source.workspace_packages(files)


@query("SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS scan_ord FROM (SELECT 'src/' || p_brand || '/' || p_partkey || '.tsx' AS path FROM part)")
def srt01_path_order(spark, d):
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".tsx"))
    return file_source.numbered(A.table(spark, d, "part").select(path.alias("path"))).select("path", "scan_ord")


@query("SELECT page_id, NOT (path LIKE '%/raw/%' OR path LIKE '%.pyc' OR path LIKE 'tmp/%') OR path LIKE '%keep.pyc' AS kept FROM (SELECT page_id, (['tmp/a.ts', 'x/raw/y.ts', 'z/b.pyc', 'z/keep.pyc', 'ok/raw2/c.ts'])[1 + page_id % 5] AS path FROM pages)")
def src02_ignored(spark, d):
    path = F.get(F.array(*[F.lit(x) for x in ("tmp/a.ts", "x/raw/y.ts", "z/b.pyc", "z/keep.pyc", "ok/raw2/c.ts")]), (F.col("page_id") % 5).cast("int"))
    return A.table(spark, d, "pages").select("page_id", (~file_source.ignored(path, ["# comment", "raw/", "/tmp", "!keep.pyc"])).alias("kept"))


# --- projections of answers --------------------------------------------------------------------------


@query("""
WITH used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
SELECT p_partkey AS issue_id, 'medium' AS confidence, 'Component:' || p_partkey AS first_id, 'src/' || p_brand || '/' || p_partkey || '.tsx' AS first_file, CAST(1 AS INT) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM used)
""")
def prj15_issue_refs(spark, d):
    nodes, edges = A.parts_graph(spark, d)
    issues = R.dead_code(nodes, edges).withColumn("issue_id", F.substring(F.col("nodes")[0], 11, 20).cast("long")).withColumn("candidate", F.lit(True))
    found = V.issue_refs(issues, nodes.withColumn("line", F.lit(1)))
    return found.select("issue_id", "confidence", F.col("evidence")[0]["id"].alias("first_id"), F.col("evidence")[0]["file"].alias("first_file"), F.size("evidence").alias("n"))


@query("SELECT p_partkey, 'brand=' || p_brand || '|name=' || CASE WHEN length(x) > 80 THEN left(x, 77) || '...' ELSE x END AS summary FROM (SELECT *, repeat(p_name || ' ', 1 + p_size % 9) AS x FROM part)")
def prj19_meta_summary(spark, d):
    long = F.expr("repeat(concat(p_name, ' '), 1 + p_size % 9)")
    return A.table(spark, d, "part").select("p_partkey", F.array_join(V.meta_summary(F.create_map(F.lit("name"), long, F.lit("brand"), F.col("p_brand"))), "|").alias("summary"))


@query(f"""
WITH i AS (SELECT 'DEAD_CODE' AS kind, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS w FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
 UNION ALL SELECT 'GOD_MODEL', 5 FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 15)),
c AS (SELECT count(*) AS total, sum(quality) AS covered FROM documents JOIN labels USING (doc_id))
SELECT CAST(greatest(0, 100 - coalesce((SELECT sum(w) FROM i), 0)) AS INT) AS health, (SELECT count(*) FROM i) AS issue_count, (SELECT count(*) FROM i WHERE kind = 'DEAD_CODE') AS dead_count, CAST(0 AS BIGINT) AS circular_count, (SELECT count(*) FROM pages) AS endpoint_count,
 (SELECT count(*) FROM part) AS hotspot_count, (SELECT CAST(sum(p_size) AS BIGINT) FROM part) AS complexity, (SELECT floor(covered * 100.0::DOUBLE / total * 10 + 0.5) / 10 FROM c) AS coverage
""")
def agg19_metric_snapshot(spark, d):
    issues = R.dead_code(*A.parts_graph(spark, d)).unionByName(R.god_models(*A.models_graph(spark, d)))
    nodes = _endpoint_nodes(spark, d, F.lit("get"), "page_id >= 0")
    hot = A.table(spark, d, "part").select(F.col("p_size").alias("complexity"))
    return V.metric_snapshot(issues, nodes, hot, R.health(issues), A.coverage_rows(spark, d))


@query("SELECT string_agg(t, ',' ORDER BY t) AS tags FROM (SELECT DISTINCT source AS t FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def agg27_merged_stack(spark, d):
    rows = A.table(spark, d, "documents").select(F.array_compact(F.array("source", "lang")).alias("tags"))
    return V.merged_stack(rows).select(F.array_join("tags", ",").alias("tags"))


@query(f"WITH {A.SALES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM part) AS issues")
def agg28_report_summary(spark, d):
    return V.report_summary(*A.sales_graph(spark, d), A.table(spark, d, "part"))


@query(f"WITH {A.LINK_SQL} SELECT method, full_url AS url, CASE WHEN call_ord % 2 = 0 THEN 'n' || call_ord ELSE caller_id END AS caller FROM c LEFT JOIN best USING (call_ord) WHERE endpoint_id IS NULL AND starts_with(full_url, '/')")
def join26_dangling_view(spark, d):
    issues = L.dangling_issues(L.link(*A.calls_and_routes(spark, d)))
    named = A.table(spark, d, "pages").where("page_id % 2 = 0").select(A.ref("Page", "page_id").alias("id"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("name"))
    return V.dangling_view(issues, named)


@query("""
WITH top AS (SELECT 'n' || p_partkey AS node, CASE WHEN p_partkey % 5 > 0 THEN 'f' || (p_partkey % 40) END AS place FROM part ORDER BY p_partkey LIMIT 12),
h AS (SELECT l_returnflag || l_linestatus || (l_linenumber % 3) AS scan_id, min(l_orderkey * 10 + l_linenumber) AS ord, 'n' || l_partkey AS node_id, 'f' || (l_suppkey % 40) AS file, count(*) AS churn, CAST(sum(l_linenumber) AS BIGINT) AS complexity, CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey % 100 END AS coverage_pct FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber % 3, l_partkey, l_suppkey),
m AS (SELECT scan_id, node, arg_min({'a': churn, 'b': complexity, 'c': coverage_pct}, ord) AS x FROM h JOIN top ON node_id = node OR file = place GROUP BY scan_id, node),
g AS (SELECT node, scan_id FROM top CROSS JOIN (SELECT DISTINCT scan_id FROM h UNION SELECT 'none'))
SELECT node AS node_id, scan_id, x.a AS churn, x.b AS complexity, x.c AS coverage_pct FROM g LEFT JOIN m USING (node, scan_id)
""")
def join32_hotspot_history(spark, d):
    k, s = F.col("p_partkey"), F.col("l_suppkey")
    latest = A.table(spark, d, "part").select(k.alias("ord"), F.concat(F.lit("n"), k.cast("string")).alias("node_id"), F.when(k % 5 > 0, F.concat(F.lit("f"), (k % 40).cast("string"))).alias("file"))
    scan = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string"))
    listed = A.table(spark, d, "lineitem").groupBy(scan.alias("scan_id"), "l_partkey", "l_suppkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.count("*").alias("churn"), F.sum("l_linenumber").cast("long").alias("complexity"))
    history = listed.select("scan_id", "ord", F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("node_id"), F.concat(F.lit("f"), (s % 40).cast("string")).alias("file"), "churn", "complexity", F.when(s % 7 > 0, s % 100).alias("coverage_pct"))
    scans = history.select("scan_id").union(spark.createDataFrame([("none",)], "scan_id string"))
    return V.hotspot_history(latest, history, scans)


@query("SELECT page_id, (['a/b', '../x', 'a/../b', 'a/../../b', '/etc', 'C:/x', './ok', 'a/./b/..'])[1 + page_id % 8] AS path, (page_id % 8) IN (0, 2, 6, 7) AS ok FROM pages")
def fn24_contained(spark, d):
    path = F.get(F.array(*[F.lit(x) for x in ("a/b", "../x", "a/../b", "a/../../b", "/etc", "C:/x", "./ok", "a/./b/..")]), (F.col("page_id") % 8).cast("int"))
    return A.table(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", "path", V.contained(F.col("path")).alias("ok"))


@query("SELECT s_suppkey, 'r' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 2 THEN '/src/x:odd' ELSE '/src/x' END AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'backend' END AS role FROM supplier")
def fn31_repo_spec(spark, d):
    k = F.col("s_suppkey")
    spec = F.concat(F.lit("r"), k.cast("string"), F.lit("=/src/x"), F.when(k % 3 == 0, ":backend").when(k % 3 == 2, ":odd").otherwise(""))
    return A.table(spark, d, "supplier").select("s_suppkey", spec.alias("spec")).select("s_suppkey", V.repo_spec(F.col("spec")).alias("r")).select("s_suppkey", "r.*")


@query("""
WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part)
SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM s)
""")
def set10_unique_slugs(spark, d):
    return V.unique_slugs(A.table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "slug")


@query("SELECT p_name AS id, 'not a slug' AS reason FROM part WHERE p_name <> trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') UNION SELECT p_name, 'taken twice' FROM part GROUP BY p_name HAVING count(*) > 1")
def set08_repo_ids(spark, d):
    return V.invalid_repo_ids(A.table(spark, d, "part").select(F.col("p_name").alias("id")))


@query(r"SELECT 'app/m' || c_custkey || '.py' AS file, line, text FROM customer, LATERAL (SELECT unnest(['class M' || c_custkey || '(models.Model):', 'class S' || c_custkey || '(serializers.ModelSerializer):', '    class Meta:', 'class V' || c_custkey || '(viewsets.ModelViewSet):', 'def helper():', 'def work():']) AS text, unnest([3, 7, 8, 12, 15, 18]) AS line)")
def ext29_outline(spark, d):
    return V.outline(I.lines_of(_models(spark, d).withColumnRenamed("path", "file"))).select("file", "line", "text")


@query("SELECT count(*) AS returned, 100000 - count(*) AS omitted FROM nation")
def agg26_result_stats(spark, d):
    return V.result_stats(A.table(spark, d, "nation"), 100_000).select("returned", "omitted")


@query("SELECT n_nationkey FROM (SELECT *, sum(10 + n_nationkey % 7) OVER (ORDER BY n_nationkey) AS s FROM nation) WHERE s <= 120")
def srt13_budget(spark, d):
    return V.within_budget(A.table(spark, d, "nation").select("n_nationkey"), 10 + F.col("n_nationkey") % 7, 120, F.col("n_nationkey"))


def _readers(spark, d):
    """A script per customer that reads fields of the answer of one call: from the data, an alias and a mapping."""
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("interface Row"), k, F.lit(" { name: string }\nexport const Ctx"), k, F.lit(" = createContext(null);\nexport const P"), k, F.lit(" = async (row: Row"), k, F.lit(") => {\n  const res = await api.get('/api/c"), k, F.lit("/');\n  const own = res.data;\n  use(own.name, res.data.up, own.length);\n  own.map((x) => x.other);\n  useContext(Ctx"), k, F.lit(");\n  return <Ctx"), k, F.lit(".Provider value={1} />;\n};\n"))
    return _rendered(A.table(spark, d, "customer"), F.concat(F.lit("web/p"), k, F.lit(".tsx")), text)


@query("SELECT 'web/p' || c_custkey || '.tsx' AS file, f.field, f.line, f.confidence FROM customer, (VALUES ('name', 6, 'medium'), ('other', 7, 'low'), ('up', 6, 'medium')) AS f(field, line, confidence)")
def ext10_response_fields(spark, d):
    calls = ts_facts.api_calls(ts_facts.extract(_readers(spark, d)))
    return calls.select("file", F.explode("response_fields").alias("f")).select("file", "f.*")


@query("SELECT 'Component:web/p' || c_custkey || '.tsx#P' || c_custkey AS src, 'Field:app/m' || c_custkey || '.py#M' || c_custkey || '#name' AS dst, 'medium' AS confidence FROM customer")
def join02_field_links(spark, d):
    """Calls of the rendered scripts meet the routes of the rendered view sets, whose serializers show `name`."""
    python = python_facts.extract(_models(spark, d))
    routes = python_facts.drf_routes(python).withColumn("path", F.concat(F.lit("/api"), "path")).withColumn("owner", F.lit("ViewSet"))
    rows = endpoints(routes, python_facts.view_fields(python))[2]
    return L.field_edges(L.link(ts_facts.api_calls(ts_facts.extract(_readers(spark, d))), rows)).select("src", "dst", "confidence")


@query("SELECT 'Component:web/web/p' || c_custkey || '.tsx#P' || c_custkey AS src, 'APIEndpoint:api/GET /api/c' || c_custkey || '/' AS dst, 'high' AS confidence FROM customer")
def prj03_repo_links(spark, d):
    """Two repositories, the scripts that call and the view sets that answer, as one project."""
    rows = _readers(spark, d).withColumn("repo", F.lit("web")).unionByName(_mounted(spark, d).withColumn("repo", F.lit("api")))
    files = rows.withColumns({"category": T.category(F.col("path")), "scan_ord": F.xxhash64("path")})
    part = projects.fragments(spark, files, [projects.Repo("web", role="frontend"), projects.Repo("api", role="backend")], graph_too=False)
    return L.call_edges(L.link(part.calls, part.routes)).select("src", "dst", "confidence")


@query("""
WITH c AS (SELECT 'web/p' || c_custkey || '.tsx#' AS spot, c_custkey AS k FROM customer)
SELECT 'Component:' || spot || 'P' || k AS src, 'Type:' || spot || 'Row' || k AS dst, 'TYPES' AS kind FROM c UNION ALL SELECT 'Component:' || spot || 'P' || k, 'Context:' || spot || 'Ctx' || k, 'PROVIDES' FROM c UNION ALL SELECT 'Component:' || spot || 'P' || k, 'Context:' || spot || 'Ctx' || k, 'CONSUMES' FROM c
""")
def join07_types_contexts(spark, d):
    files = _readers(spark, d)
    return ts_facts.usage_edges(ts_facts.extract(files), files).select("src", "dst", "kind")


@query("""
WITH s AS (SELECT 'u/d' || s_suppkey || '.py#' AS spot, s_suppkey AS k FROM supplier)
SELECT 'Model:' || spot || 'D' || k AS src, 'Field:' || spot || 'D' || k || '#name' AS dst, 'REFERENCES' AS kind FROM s UNION ALL SELECT 'Model:' || spot || 'D' || k, 'Manager:' || spot || 'Mgr' || k, 'USES' FROM s
UNION ALL SELECT 'ViewSet:' || spot || 'W' || k, 'Model:' || spot || 'D' || k, 'USES' FROM s UNION ALL SELECT 'Function:' || spot || 'on_save', 'Model:' || spot || 'D' || k, 'USES' FROM s
UNION ALL SELECT 'Function:' || spot || 'on_save', 'Signal:' || spot || 'post_save#D' || k || '#on_save', 'REGISTERED_IN' FROM s UNION ALL SELECT 'Serializer:' || spot || 'Z' || k, 'Field:' || spot || 'D' || k || '#name', 'USES' FROM s
""")
def join10_use_edges(spark, d):
    k = F.col("s_suppkey").cast("string")
    parts = ["class Mgr", k, "(models.Manager):\n    def live(self):\n        return 1\n\nclass D", k, "(models.Model):\n    name = models.CharField(max_length=9)\n    objects = Mgr", k, "()\n\nclass Z", k, "(serializers.ModelSerializer):\n    class Meta:\n        model = D", k, "\n        fields = '__all__'\n\nclass W", k, "(viewsets.ModelViewSet):\n    queryset = D", k, ".objects.all()\n\n@receiver(post_save, sender=D", k, ")\ndef on_save(sender, **kw):\n    return D", k, ".objects.filter(x=1)\n"]
    files = _rendered(A.table(spark, d, "supplier"), F.concat(F.lit("u/d"), k, F.lit(".py")), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return python_facts.use_edges(python_facts.extract(files))


def _shapes(spark, d):
    """A script per part in one of four shapes: nested functions and overloads; strings, templates with holes, comments and
    regular expressions that look like code; elements with text and quotes; statements outside declarations."""
    k = F.col("p_partkey").cast("string")
    put = lambda shape: F.replace(F.lit(shape), F.lit("@"), k)
    nested = "export function F@(a: string): void;\nexport function F@(row: any): { x: string } {\n  function inner(x) { return x.deep@; }\n  return inner(row.top) + row.list.map((r) => r.each).length;\n}\nfetch('/late/@');\n"
    quoted = "export const F@ = async (row: Row<A, B>) => {\n  const s = \"row.no <No/>\"; // row.no\n  const t = `row.no\nfunction Fake() { return row.no }\n${row.hole ? `${row.in@} ${fetch(`/hole/@`)}` : 1}`;\n  return s + t + /row\\.no[/\"]/.test(row.re) + \"fetch('/no')\";\n};\n"
    shown = "interface Props@ { user: { tag: string }; \"quoted\"?: number; on(e: Event, n: number): void }\nconst F@ = ({ user }: Props@) => (\n  <Ctx.Provider value={user.name}>\n    it's row.no // not {/* a.no */ 1} <b title=\"x.no\" onClick={() => fetch('/click/@', { method: 'post' })}>{user?.tag@}</b>\n  </Ctx.Provider>\n);\nexport { F@ as default };\n"
    loose = "const F@ = function () { return this.own@; };\nif (F@) {\nconst hidden = () => axios.put('/loose/@', window.no);\n}\n"
    way = F.col("p_partkey") % 4
    return _rendered(A.table(spark, d, "part"), F.concat(F.lit("web/f"), k, F.lit(".tsx")), F.when(way == 0, put(nested)).when(way == 1, put(quoted)).when(way == 2, put(shown)).otherwise(put(loose)))


@query("""
SELECT CASE p_partkey % 4 WHEN 2 THEN 'Component' ELSE 'Function' END || ':web/f' || p_partkey || '.tsx#F' || p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 2 THEN 2 ELSE 1 END::INT AS line, CASE WHEN p_partkey % 4 < 2 THEN 'true' ELSE 'false' END AS exported FROM part
""")
def ext01_scoped_symbols(spark, d):
    return ts_facts.symbols(ts_facts.found(_shapes(spark, d))).select("id", "line", F.col("meta")["exported"].alias("exported"))


@query("""
WITH f(way, field, own) AS (VALUES (0, 'deep', true), (0, 'top', false), (0, 'list', false), (0, 'each', false), (1, 'hole', false), (1, 'in', true), (1, 'test', false), (1, 're', false), (2, 'Provider', false), (2, 'name', false), (2, 'tag', true), (3, 'own', true))
SELECT CASE way WHEN 2 THEN 'Component' ELSE 'Function' END || ':web/f' || p_partkey || '.tsx#F' || p_partkey AS id, field || CASE WHEN own THEN p_partkey::VARCHAR ELSE '' END AS field FROM part JOIN f ON way = p_partkey % 4
""")
def ext07_field_reads(spark, d):
    nodes = ts_facts.symbols(ts_facts.found(_shapes(spark, d)))
    return nodes.select("id", F.explode(F.from_json(F.col("meta")["fieldReads"], "array<string>")).alias("field"))


@query("""
WITH c(way, caller, method, url) AS (VALUES (0, 'File', 'GET', '/late/'), (1, 'Function', 'GET', '/hole/'), (2, 'Component', 'POST', '/click/'), (3, 'File', 'PUT', '/loose/'))
SELECT caller || ':web/f' || p_partkey || '.tsx' || CASE caller WHEN 'File' THEN '' ELSE '#F' || p_partkey END AS caller_id, method, url || p_partkey AS full_url FROM part JOIN c ON way = p_partkey % 4
""")
def ext12_scoped_calls(spark, d):
    return ts_facts.api_calls(ts_facts.extract(_shapes(spark, d))).select("caller_id", "method", "full_url")


@query("SELECT 'Type:web/f' || p_partkey || '.tsx#Props' || p_partkey AS id, f.field FROM part, (VALUES ('user'), ('tag'), ('quoted')) AS f(field) WHERE p_partkey % 4 = 2")
def ext06_type_fields(spark, d):
    nodes = ts_facts.type_symbols(ts_facts.found(_shapes(spark, d)))
    return nodes.select("id", F.explode(F.from_json(F.col("meta")["fields"], "array<string>")).alias("field"))
