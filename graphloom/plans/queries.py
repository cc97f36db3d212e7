"""Registered queries of the graph engine, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import diff as D
from graphloom.operators import graph as G
from graphloom.operators import history as H
from graphloom.operators import insights as I
from graphloom.operators import linker as L
from graphloom.operators import rules as R
from graphloom.operators import search as S
from graphloom.plans import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


IMPACT_SQL = f"""
WITH RECURSIVE {A.SALES_SQL},
reach AS (SELECT 'Region:1' AS id, 0 AS depth UNION SELECT edges.src, depth + 1 FROM reach JOIN edges ON edges.dst = reach.id)
SELECT nodes.id, nodes.kind, nodes.name, CAST(depth AS INT) AS depth FROM reach JOIN nodes ON nodes.id = reach.id WHERE depth > 0
"""


@query(IMPACT_SQL)
def grf03_impact(spark, d):
    nodes, edges = A.sales_graph(spark, d)
    return G.impact(nodes, edges, spark.createDataFrame([("Region:1",)], "id string")).select("id", "kind", "name", "depth")


@query(f"""
WITH RECURSIVE {A.SALES_SQL},
reach AS (SELECT id AS seed, id FROM nodes WHERE kind IN ('Region', 'Nation') UNION SELECT reach.seed, edges.src FROM reach JOIN edges ON edges.dst = reach.id)
SELECT seed AS id, CAST(count(*) - 1 AS BIGINT) AS impact FROM reach GROUP BY seed
""")
def agg07_impact_size(spark, d):
    nodes, edges = A.sales_graph(spark, d)
    return G.impact_size(nodes, edges, nodes.where("kind in ('Region', 'Nation')").select("id"))


@query(f"""
WITH RECURSIVE {A.SALES_SQL},
reach AS (SELECT 'Nation:3' AS id UNION SELECT edges.src FROM reach JOIN edges ON edges.dst = reach.id)
SELECT 'DEPENDS_ON:' || src || '->' || dst AS id, src, dst FROM edges WHERE src IN (SELECT id FROM reach) AND dst IN (SELECT id FROM reach)
""")
def grf04_impact_subgraph(spark, d):
    nodes, edges = A.sales_graph(spark, d)
    return G.impact_subgraph(nodes, edges, spark.createDataFrame([("Nation:3",)], "id string"))[1].select("id", "src", "dst")


@query(f"""
WITH RECURSIVE {A.CYCLES_SQL},
reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT reach.a, edges.dst FROM reach JOIN edges ON edges.src = reach.b)
SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a
""")
def grf05_cycles(spark, d):
    return G.strongly_connected(A.supplier_cycles(spark, d))


@query(f"""
WITH RECURSIVE {A.CYCLES_SQL},
reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT reach.a, edges.dst FROM reach JOIN edges ON edges.src = reach.b),
c AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT 'CIRCULAR_DEPENDENCY' AS kind, 'high' AS severity, 'Circular import: ' || string_agg(id, ' → ' ORDER BY id) AS message FROM c GROUP BY component
""")
def rul02_circular(spark, d):
    return R.circular_imports(A.supplier_cycles(spark, d)).select("kind", "severity", "message")


@query(f"""
WITH {A.SALES_SQL}
SELECT id, CAST((SELECT count(*) FROM edges WHERE dst = nodes.id) AS BIGINT) AS fan_in, CAST((SELECT count(*) FROM edges WHERE src = nodes.id) AS BIGINT) AS fan_out FROM nodes
""")
def agg06_degrees(spark, d):
    return G.degrees(*A.sales_graph(spark, d))


@query("""
SELECT 'Customer:' || c_custkey AS src, 'Nation:' || c_nationkey AS dst FROM customer WHERE c_nationkey = 7
UNION SELECT 'Nation:' || n_nationkey, 'Region:' || n_regionkey FROM nation WHERE n_nationkey = 7
""")
def grf11_context(spark, d):
    return G.context(*A.sales_graph(spark, d), "Nation:7").select("src", "dst")


@query("""
WITH used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
SELECT 'Component:' || p_partkey AS node, 'DEAD_CODE' AS kind, 'low' AS severity, 'Component "' || p_name || '" is never rendered' AS message, CASE WHEN p_size % 2 = 0 THEN 'low' ELSE 'high' END AS confidence FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM used)
""")
def rul03_dead_code(spark, d):
    return R.dead_code(*A.parts_graph(spark, d)).select(F.col("nodes")[0].alias("node"), "kind", "severity", "message", F.col("meta")["confidence"].alias("confidence"))


@query("""
WITH used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
SELECT 'Component:' || p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM used) AND NOT starts_with(p_brand, 'Brand#1') AND p_partkey <> 7
""")
def prj09_public_api(spark, d):
    api = [R.PublicApi(ids=["Component:7"], paths=["src/Brand#1*/**"], kinds=["Component"])]
    return R.dead_code(*A.parts_graph(spark, d), api).select(F.col("nodes")[0].alias("node"))


@query("""
SELECT 'Model:' || c_custkey AS node, 'GOD_MODEL' AS kind, 'Model "' || c_name || '" has ' || count(*) || ' relations' AS message FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15
""")
def rul05_god_models(spark, d):
    return R.god_models(*A.models_graph(spark, d)).select(F.col("nodes")[0].alias("node"), "kind", "message")


@query(r"""
WITH f AS (SELECT 'doc/' || doc_id AS file, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM documents)
SELECT file || ' has ' || lines || ' lines' AS message, 'LARGE_FILE' AS kind, 'low' AS severity FROM f WHERE lines > 20
""")
def rul06_large_files(spark, d):
    docs = A.table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), T.line_count(F.col("text")).alias("lines"))
    return R.large_files(docs, 20).select("message", "kind", "severity")


GROUPS = {"north": ["*/nation1?/**", "*/nation[0]/**"], "buyers": ["buyers/**"], "sellers": ["sellers/nation2*/**"]}
BOUNDARIES = [R.Boundary(["buyers"], ["sellers"]), R.Boundary(["north"], ["north"], allow=True)]


@query(f"""
WITH {A.TRADE_SQL},
g AS (SELECT *, nation BETWEEN 10 AND 19 AS north, side = 'buyer' AS buyers, side = 'seller' AND starts_with(CAST(nation AS VARCHAR), '2') AS sellers FROM nodes),
m AS (SELECT e.src, e.dst, a.file AS fa, b.file AS fb, a.north AS an, b.north AS bn, b.sellers AS bs FROM edges e JOIN g a ON e.src = a.id JOIN g b ON e.dst = b.id WHERE (b.north OR b.sellers))
SELECT src, dst, 'deny' AS rule, 'buyers' AS from_group, 'sellers' AS to_group, 'Boundary violation: ' || fa || ' USES ' || fb AS message FROM m WHERE bs
UNION ALL SELECT src, dst, 'allow', 'north', CASE WHEN bn THEN 'north' ELSE 'sellers' END, 'Boundary violation: ' || fa || ' USES ' || fb FROM m WHERE NOT bs AND an AND NOT bn
""")
def rul04_boundaries(spark, d):
    return R.boundary_hits(*A.trade_graph(spark, d), GROUPS, BOUNDARIES).select("src", "dst", "rule", "from_group", "to_group", "message")


@query(f"WITH {A.LINK_SQL} SELECT c.call_ord, best.endpoint_id, best.confidence FROM c LEFT JOIN best USING (call_ord)")
def join01_linker(spark, d):
    return L.link(*A.calls_and_routes(spark, d)).select("call_ord", "endpoint_id", "confidence")


@query(f"""WITH {A.LINK_SQL} SELECT 'CALLS:' || caller_id || '->' || endpoint_id AS id, confidence FROM c JOIN best USING (call_ord)""")
def join01_call_edges(spark, d):
    return L.call_edges(L.link(*A.calls_and_routes(spark, d))).select("id", "confidence")


@query(f"""WITH {A.LINK_SQL} SELECT caller_id AS node, 'Call "' || method || ' ' || full_url || '" matches no known backend route' AS message FROM c LEFT JOIN best USING (call_ord) WHERE endpoint_id IS NULL AND starts_with(full_url, '/')""")
def join03_dangling(spark, d):
    return L.dangling_issues(L.link(*A.calls_and_routes(spark, d))).select(F.col("nodes")[0].alias("node"), "message")


COMMITS_SQL = """
commits AS (SELECT CAST(event_id AS VARCHAR) AS commit_id, row_number() OVER (ORDER BY ts DESC, event_id) AS commit_ord, event_type AS author, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'user/' || user_id AS file FROM events),
churn AS (SELECT file, count(DISTINCT commit_id) AS commits, count(DISTINCT author) AS authors, arg_min(ts, commit_ord) AS last_commit_at FROM commits GROUP BY file)
"""


@query(f"WITH {COMMITS_SQL} SELECT * FROM churn")
def agg01_churn(spark, d):
    return I.churn(A.commits(spark, d), None)


COVERAGE_SQL = """
cov AS (SELECT source || '/' || lang AS file, CAST(count(*) AS BIGINT) AS total, CAST(sum(quality) AS BIGINT) AS covered, CASE WHEN count(*) > 0 THEN floor(sum(quality) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 END AS pct FROM documents JOIN labels USING (doc_id) GROUP BY 1)
"""


@query(f"WITH {COVERAGE_SQL} SELECT * FROM cov")
def agg02_coverage(spark, d):
    return I.coverage(A.coverage_rows(spark, d))


@query(f"WITH {COVERAGE_SQL} SELECT sum(covered) * 100.0::DOUBLE / sum(total) AS pct, CAST(floor(avg(pct) + 0.5) AS BIGINT) AS mean_pct FROM cov")
def agg03_overall_coverage(spark, d):
    return I.overall_coverage(A.coverage_rows(spark, d))


SECRETS_SQL = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
hits AS (
  SELECT doc_id, n, 'aws-access-key' AS rule, unnest(regexp_extract_all(line, '\b(AKIA[0-9A-Z]{16})\b', 1)) AS value FROM lines
  UNION ALL SELECT doc_id, n, 'github-token', unnest(regexp_extract_all(line, '\b(ghp_[A-Za-z0-9_]{30,}|github_pat_[A-Za-z0-9_]{40,})\b', 1)) FROM lines
  UNION ALL SELECT doc_id, n, 'slack-token', unnest(regexp_extract_all(line, '\b(xox[baprs]-[A-Za-z0-9-]{20,})\b', 1)) FROM lines
  UNION ALL SELECT doc_id, n, 'secret-assignment', unnest(regexp_extract_all(line, '(?i)\b[A-Z0-9_]*(?:SECRET|TOKEN|API[_-]?KEY|PASSWORD|PRIVATE[_-]?KEY)[A-Z0-9_]*\b\s*[:=]\s*["'']([^"'']{12,})["'']', 1)) FROM lines
  UNION ALL SELECT doc_id, n, 'secret-assignment', unnest(regexp_extract_all(line, '(?i)^\s*(?:export\s+)?[A-Z0-9_]*(?:SECRET|TOKEN|API[_-]?KEY|PASSWORD|PRIVATE[_-]?KEY)[A-Z0-9_]*\b\s*=\s*([^"''\s#]{12,})', 1)) FROM lines
  UNION ALL SELECT doc_id, n, 'high-entropy', unnest(regexp_extract_all(line, '[A-Za-z0-9+/=_-]{32,}')) FROM lines WHERE regexp_matches(line, '(?i)(secret|token|api[_-]?key|password|private[_-]?key)')),
scored AS (SELECT *, (SELECT -sum(c / length(value) * log2(c / length(value))) FROM (SELECT count(*)::DOUBLE AS c FROM (SELECT unnest(string_split(value, '')) AS ch) GROUP BY ch)) AS bits FROM hits)
"""


@query(f"""WITH {SECRETS_SQL} SELECT 'doc/' || doc_id AS file, CAST(n AS INT) AS line, rule, CASE WHEN length(value) <= 8 THEN '***' ELSE left(value, 4) || '...' || right(value, 4) END AS preview,
  CASE WHEN rule IN ('secret-assignment', 'high-entropy') THEN floor(bits * 10 + 0.5) / 10 END AS entropy FROM scored
WHERE (rule <> 'high-entropy' OR bits >= 4.2) AND NOT regexp_matches(lower(value), 'example|placeholder|dummy|changeme|not-a-secret|localhost|^x+$|^0+$')""")
def fn20_secrets(spark, d):
    docs = A.table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("content"))
    return I.secrets(docs).select("file", "line", "rule", "preview", "entropy")


COMPLEXITY_SQL = r"""cx AS (SELECT doc_id, source, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE 1 + len(regexp_extract_all(text, '\b(if|elif|else\s+if|for|while|case|catch|except|switch)\b')) + len(regexp_extract_all(text, '&&|\|\||\?')) END AS complexity FROM documents)"""


@query(f"WITH {COMPLEXITY_SQL} SELECT doc_id, CAST(complexity AS INT) AS complexity FROM cx")
def agg05_complexity(spark, d):
    return A.table(spark, d, "documents").select("doc_id", I.complexity(F.coalesce("text", F.lit("")), F.lit("python")).alias("complexity"))


@query(f"""
WITH RECURSIVE {COMPLEXITY_SQL}, {COMMITS_SQL},
files AS (SELECT 'src/' || source || '.py' AS file, max(complexity) AS complexity FROM cx GROUP BY source),
ch AS (SELECT 'src/src' || substr(file, 6) || '.py' AS file, commits, authors FROM churn),
n AS (SELECT doc_id, 'Function:' || doc_id AS node_id, 'src/' || source || '.py' AS file FROM documents),
deg AS (SELECT n.node_id, (SELECT count(*) FROM documents x WHERE x.doc_id > 0 AND x.doc_id // 2 = n.doc_id) AS fan_in, CASE WHEN n.doc_id > 0 THEN 1 ELSE 0 END AS fan_out FROM n),
s AS (SELECT n.node_id, n.file, coalesce(commits, 0) AS churn, coalesce(authors, 0) AS authors, coalesce(complexity, 0) AS complexity, fan_in, fan_out, CASE WHEN coalesce(commits, 0) > 0 THEN floor(complexity * commits * (1 + fan_in * 0.05::DOUBLE + fan_out * 0.02::DOUBLE) + 0.5) ELSE 0 END AS score FROM n JOIN deg USING (node_id) LEFT JOIN files USING (file) LEFT JOIN ch USING (file)),
top AS (SELECT * FROM s WHERE score > 0 OR complexity >= 18 ORDER BY score DESC, complexity DESC, node_id LIMIT 25),
r AS (SELECT node_id AS seed, CAST(string_split(node_id, ':')[2] AS BIGINT) AS id FROM top UNION SELECT seed, doc_id FROM r JOIN documents ON doc_id // 2 = id AND doc_id > 0),
sizes AS (SELECT seed AS node_id, count(*) - 1 AS impact FROM r GROUP BY seed)
SELECT node_id, file, CAST(churn AS BIGINT) AS churn, CAST(complexity AS INT) AS complexity, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out, CAST(score AS DOUBLE) AS score, impact FROM top JOIN sizes USING (node_id)
""")
def agg08_hotspots(spark, d):
    nodes, edges = A.doc_nodes(spark, d)
    docs = A.table(spark, d, "documents")
    cx = docs.select(F.concat(F.lit("src/"), "source", F.lit(".py")).alias("file"), I.complexity(F.coalesce("text", F.lit("")), F.lit("python")).alias("c")).groupBy("file").agg(F.max("c").alias("complexity"))
    churned = I.churn(A.commits(spark, d), None).withColumn("file", F.concat(F.lit("src/src"), F.substring("file", 6, 100), F.lit(".py")))
    covered = I.coverage(A.coverage_rows(spark, d))
    return I.hotspots(nodes, edges, cx, churned, covered).select("node_id", "file", "churn", "complexity", "fan_in", "fan_out", "score", "impact")


def _issues(spark, d):
    return R.dead_code(*A.parts_graph(spark, d)).unionByName(R.god_models(*A.models_graph(spark, d)))


ISSUES_SQL = """
issues AS (SELECT 'DEAD_CODE' AS kind, 'low' AS severity, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS w FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
 UNION ALL SELECT 'GOD_MODEL', 'medium', 5 FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 15))
"""


@query(f"WITH {ISSUES_SQL} SELECT kind, CAST(sum(w) AS BIGINT) AS points FROM issues WHERE w > 0 GROUP BY kind")
def agg09_breakdown(spark, d):
    return R.breakdown(_issues(spark, d))


@query(f"WITH {ISSUES_SQL} SELECT CAST(greatest(0, 100 - coalesce(sum(w), 0)) AS INT) AS health FROM issues")
def agg09_health(spark, d):
    return R.health(_issues(spark, d))


@query(f"WITH {ISSUES_SQL} SELECT kind, count(*) AS n FROM issues GROUP BY kind")
def agg13_by_kind(spark, d):
    return S.counts(_issues(spark, d), "kind")


@query(f"WITH {ISSUES_SQL} SELECT severity, count(*) AS n FROM issues GROUP BY severity")
def agg14_by_severity(spark, d):
    return S.counts(_issues(spark, d), "severity")


@query(f"WITH {A.SALES_SQL} SELECT kind, count(*) AS n FROM nodes GROUP BY kind ORDER BY n DESC, kind LIMIT 10")
def agg15_histogram(spark, d):
    return S.kind_histogram(A.sales_graph(spark, d)[0])


@query("SELECT CAST(0 AS BIGINT) AS files, (SELECT count(*) FROM part) AS components, (SELECT count(*) FROM customer) AS models, CAST(0 AS BIGINT) AS endpoints")
def agg12_summary(spark, d):
    nodes = A.parts_graph(spark, d)[0].unionByName(A.models_graph(spark, d)[0])
    return S.summary(nodes)


def _snapshots(spark, d):
    orders = A.table(spark, d, "orders").withColumn("id", F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string")))
    before = orders.where("o_orderkey % 10 <> 0").withColumn("state", F.col("o_orderstatus"))
    after = orders.where("o_orderkey % 10 <> 1").withColumn("state", F.when(F.col("o_orderkey") % 10 == 2, "X").otherwise(F.col("o_orderstatus")))
    return before, after


DIFF_SQL = """
b AS (SELECT o_orderkey, o_orderstatus AS state FROM orders WHERE o_orderkey % 10 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 2 THEN 'X' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 10 <> 1),
diff AS (SELECT CASE WHEN b.o_orderkey IS NULL THEN 'node_added' WHEN a.o_orderkey IS NULL THEN 'node_removed' ELSE 'node_changed' END AS kind, 'Order:' || coalesce(a.o_orderkey, b.o_orderkey) AS id, coalesce(a.state, b.state) AS label FROM b FULL JOIN a USING (o_orderkey) WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR a.state <> b.state)
"""


@query(f"WITH {DIFF_SQL} SELECT * FROM diff")
def set03_diff(spark, d):
    return D.changes(*_snapshots(spark, d), "node", F.col("state"), content=F.col("state"))


@query("""
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'node_added' WHEN o_orderkey % 10 = 1 THEN 'node_removed' ELSE 'node_changed' END AS kind,
  'Order:' || o_orderkey AS id, 'Order ' || o_orderkey AS label
FROM orders WHERE o_orderkey % 10 IN (0, 1, 2, 4)
""")
def set03_nested_meta(spark, d):
    """Orders with nested metadata: of those that stay, some change within an array, some get a null member, and all are
    written in another order of keys the second time, which is no change."""
    key = F.col("o_orderkey")
    text = F.col("o_orderkey").cast("string")
    orders = A.table(spark, d, "orders").select(key, F.concat(F.lit("Order:"), text).alias("id"), F.lit("Order").alias("kind"), text.alias("name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), "o_orderstatus", F.col("o_custkey").cast("string").alias("who"))
    state = F.concat(F.lit('{"state": "'), "o_orderstatus", F.lit('", "n": 1}'))
    first = F.concat(F.lit('{"by": {"id": '), "who", F.lit(', "tags": ["a", "b"]}, "parts": ['), state, F.lit(', {"x": [1, 2]}]}'))
    x = F.when(key % 10 == 2, "[1, 3]").otherwise("[1, 2]")
    again = F.concat(F.lit('{ "parts": ['), F.concat(F.lit('{"n": 1, "state": "'), "o_orderstatus", F.lit('"}')), F.lit(', {"x": '), x, F.lit('}], "by": {"tags": ["a", "b"], "id": '), "who", F.when(key % 10 == 4, ', "note": null}}').otherwise("}}"))
    before, after = orders.where(key % 10 != 0).withColumn("meta", F.parse_json(first)), orders.where(key % 10 != 1).withColumn("meta", F.parse_json(again))
    return D.changes(before, after, "node", D.node_label(), content=D.node_content)


@query(f"WITH {DIFF_SQL} SELECT kind, count(*) AS n FROM diff GROUP BY kind")
def agg16_change_counts(spark, d):
    return D.change_counts(D.changes(*_snapshots(spark, d), "node", F.col("state"), content=F.col("state")))


def _endpoint_nodes(spark, d, method, keep):
    pages = A.table(spark, d, "pages").where(keep).withColumn("path", F.regexp_extract("url", r"^https?://[^/]+(/[a-z]*)", 1))
    return pages.select(F.concat(F.lit("APIEndpoint:"), F.col("page_id").cast("string")).alias("id"), F.lit("APIEndpoint").alias("kind"), F.col("url").alias("name"), F.create_map(F.lit("method"), method, F.lit("path"), F.col("path")).alias("meta"))


BREAKING_SQL = r"""
p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(/[a-z]*)', 1) AS path FROM pages),
o AS (SELECT path, CASE WHEN page_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS m FROM p WHERE page_id % 2 = 0 AND path <> ''),
w AS (SELECT path, CASE WHEN page_id % 5 = 0 THEN 'GET' ELSE 'PUT' END AS m FROM p WHERE page_id % 2 = 1 AND path <> ''),
om AS (SELECT path, string_agg(DISTINCT m, ',' ORDER BY m) AS methods FROM o GROUP BY path), wm AS (SELECT path, string_agg(DISTINCT m, ',' ORDER BY m) AS methods FROM w GROUP BY path),
breaking AS (
SELECT 'BREAKING_ROUTE_METHOD_CHANGED' AS kind, path || ' changed methods from ' || om.methods || ' to ' || wm.methods || '.' AS message FROM om JOIN wm USING (path) WHERE om.methods <> wm.methods
UNION ALL SELECT DISTINCT 'BREAKING_ENDPOINT_REMOVED', o.m || ' ' || o.path || ' was removed while a frontend call still targets it.' FROM o WHERE (m, path) NOT IN (SELECT m, path FROM w) AND m = 'POST'
UNION ALL SELECT 'BREAKING_FIELD_REMOVED', p_name || ' was removed from a serializer-exposed model field.' FROM part WHERE p_partkey % 4 = 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))
"""


@query(f"WITH {BREAKING_SQL} SELECT * FROM breaking")
def set04_breaking(spark, d):
    """All branches: endpoints of even pages become those of odd ones, every page calls POST on its path, and
    a quarter of the fields, which suppliers' serializers expose, goes."""
    none = A.none().alias("meta")
    part, line = A.table(spark, d, "part"), A.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    fields = part.select(A.ref("Field", "p_partkey").alias("id"), F.lit("Field").alias("kind"), F.col("p_name").alias("name"), none)
    makers = A.table(spark, d, "supplier").select(A.ref("Serializer", "s_suppkey").alias("id"), F.lit("Serializer").alias("kind"), F.col("s_name").alias("name"), none)
    uses = line.select(A.ref("Serializer", "l_suppkey").alias("src"), A.ref("Field", "l_partkey").alias("dst"), F.lit("USES").alias("kind"))
    points = lambda method, keep: _endpoint_nodes(spark, d, method, keep).where(F.col("meta")["path"] != "")
    old = points(F.when(F.col("page_id") % 3 == 0, "get").otherwise("post"), "page_id % 2 = 0")
    new = points(F.when(F.col("page_id") % 5 == 0, "get").otherwise("put"), "page_id % 2 = 1")
    path = F.regexp_extract("url", r"^https?://[^/]+(/[a-z]*)", 1)
    called = A.table(spark, d, "pages").select(F.lit("DANGLING_API_CALL").alias("kind"), F.create_map(F.lit("method"), F.lit("post"), F.lit("url"), F.concat(F.lit("https://x.test"), path)).alias("meta"))
    before = {"nodes": old.unionByName(fields).unionByName(makers), "edges": uses}
    after = {"nodes": new.unionByName(fields.where("cast(substring(id, 7) as long) % 4 <> 0")).unionByName(makers), "issues": called}
    return D.breaking(before, after).select("kind", "message")


@query(f"""
WITH {ISSUES_SQL}, {COVERAGE_SQL}, {DIFF_SQL}, {BREAKING_SQL},
f AS (SELECT greatest(0, 100 - (SELECT sum(w) FROM issues)) AS health, (SELECT count(*) FROM diff WHERE kind = 'node_added') AS new_issues, (SELECT sum(covered) * 100.0::DOUBLE / sum(total) FROM cov) AS coverage,
  (SELECT count(*) FROM breaking) AS breaking, (SELECT count(*) FROM issues WHERE kind = 'GOD_MODEL') AS boundary)
SELECT 'MIN_HEALTH' AS kind, CAST(health AS DOUBLE) AS current, 90.0::DOUBLE AS threshold FROM f WHERE health < 90
UNION ALL SELECT 'MAX_NEW_ISSUES', CAST(new_issues AS DOUBLE), 10.0 FROM f WHERE new_issues > 10
UNION ALL SELECT 'BREAKING_CHANGES', CAST(breaking AS DOUBLE), 0.0 FROM f WHERE breaking > 0
UNION ALL SELECT 'BOUNDARY_VIOLATIONS', CAST(boundary AS DOUBLE), 0.0 FROM f WHERE boundary > 0
UNION ALL SELECT 'MIN_COVERAGE', coverage, 95.0 FROM f WHERE coverage < 95
""")
def rul12_gates(spark, d):
    changed = D.changes(*_snapshots(spark, d), "node", F.col("state"), content=F.col("state"))
    facts = R.health(_issues(spark, d)).join(changed.agg(F.count_if(F.col("kind") == "node_added").alias("new_issues"))).join(I.overall_coverage(A.coverage_rows(spark, d)).select(F.col("pct").alias("coverage")))
    facts = facts.join(set04_breaking(spark, d).agg(F.count("*").alias("breaking"))).join(_issues(spark, d).agg(F.count_if(F.col("kind") == "GOD_MODEL").alias("boundary")))
    return D.gates(facts, min_health=90, max_new_issues=10, forbid_breaking=True, forbid_boundary=True, min_coverage=95).select("kind", "current", "threshold")


def _metrics(spark, d):
    days = A.table(spark, d, "events").groupBy(F.col("event_type").alias("project_id"), F.date_format("ts", "yyyy-MM-dd").alias("finished_at")).agg(F.count("*").alias("health"), F.countDistinct("user_id").alias("circular_count"))
    return days.withColumn("scan_id", F.concat_ws("/", "project_id", "finished_at"))


METRICS_SQL = "m AS (SELECT event_type AS project_id, strftime(ts, '%Y-%m-%d') AS finished_at, count(*) AS health, count(DISTINCT user_id) AS circular_count, event_type || '/' || strftime(ts, '%Y-%m-%d') AS scan_id FROM events GROUP BY 1, 2)"


@query(f"WITH {METRICS_SQL} SELECT scan_id, health, health - lag(health) OVER w AS health_delta, circular_count - lag(circular_count) OVER w AS circular_count_delta FROM m WINDOW w AS (PARTITION BY project_id ORDER BY finished_at)")
def win07_trend(spark, d):
    return D.pair_snapshots(_metrics(spark, d), "health", "circular_count").select("scan_id", "health", "health_delta", "circular_count_delta")


@query(f"""WITH {METRICS_SQL}, p AS (SELECT scan_id, health - lag(health) OVER w AS hd, circular_count - lag(circular_count) OVER w AS cd FROM m WINDOW w AS (PARTITION BY project_id ORDER BY finished_at))
SELECT scan_id, 'health-drop' AS alert FROM p WHERE hd <= -5 UNION ALL SELECT scan_id, 'new-circular' FROM p WHERE cd > 0""")
def rul13_alerts(spark, d):
    return D.alerts(D.pair_snapshots(_metrics(spark, d), "health", "circular_count").withColumn("breaking_count", F.lit(0)))


@query(f"WITH {METRICS_SQL} SELECT scan_id FROM (SELECT scan_id, row_number() OVER (PARTITION BY project_id ORDER BY finished_at DESC) AS n FROM m) WHERE n <= 3")
def win10_retention(spark, d):
    return D.newest(_metrics(spark, d), 3).select("scan_id")


VERSIONS_SQL = """
o AS (SELECT strftime(o_orderdate, '%Y-%m') AS scan_id, o_custkey AS k, count(*) AS n, max(o_orderkey) AS top FROM orders GROUP BY 1, 2),
v AS (SELECT scan_id, k, n, top, 'r' || ((c_nationkey + n) % 10) AS repo FROM o JOIN customer ON c_custkey = k),
s AS (SELECT scan_id, lead(scan_id) OVER (ORDER BY scan_id) AS next_id FROM (SELECT DISTINCT scan_id FROM v)),
b AS (SELECT next_id, v.* FROM v JOIN s USING (scan_id) WHERE next_id IS NOT NULL), a AS (SELECT * FROM v WHERE scan_id > (SELECT min(scan_id) FROM v)),
d AS (SELECT coalesce(a.scan_id, b.next_id) AS scan_id, CASE WHEN b.k IS NULL THEN 'node_added' WHEN a.k IS NULL THEN 'node_removed' ELSE 'node_changed' END AS kind, 'Customer:' || coalesce(a.k, b.k) AS id, b.repo AS was, a.repo AS is_now FROM b FULL JOIN a ON b.next_id = a.scan_id AND b.k = a.k WHERE a.k IS NULL OR b.k IS NULL OR a.n <> b.n OR a.top <> b.top)
"""


def _versions(spark, d):
    """A snapshot per month of orders: its customers, with how many orders they placed and the last of them. They lie in a repository
    that moves with that number."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    orders = A.table(spark, d, "orders").groupBy(month.alias("scan_id"), "o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"))
    rows = orders.join(A.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = rows.select(F.lit("p").alias("project_id"), "scan_id", A.ref("Customer", "o_custkey").alias("id"), "n", "top", F.concat(F.lit("r"), ((F.col("c_nationkey") + F.col("n")) % 10).cast("string")).alias("repo_id"))
    return rows, A.table(spark, d, "orders").select(F.lit("p").alias("project_id"), month.alias("scan_id"), month.alias("finished_at")).distinct()


@query(f"WITH {VERSIONS_SQL} SELECT scan_id, kind, id, was, is_now FROM d")
def set03_versions(spark, d):
    rows, scans = _versions(spark, d)
    found = H.version_changes(rows, scans, "node", F.struct("n", "top"), F.col("repo_id"))
    return found.select("scan_id", "kind", "id", F.col("before").alias("was"), F.col("after").alias("is_now"))


@query(f"""
WITH {VERSIONS_SQL},
x AS (SELECT scan_id, is_now AS repo_id FROM d WHERE is_now IS NOT NULL UNION ALL SELECT scan_id, was FROM d WHERE was IS NOT NULL AND was IS DISTINCT FROM is_now),
c AS (SELECT repo_id, scan_id, count(*) AS n FROM x GROUP BY 1, 2),
g AS (SELECT r.repo_id, s.scan_id, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT repo AS repo_id FROM v) r CROSS JOIN s LEFT JOIN c ON c.repo_id = r.repo_id AND c.scan_id = s.scan_id)
SELECT repo_id, scan_id, n, CAST(CASE WHEN n <= 0 THEN 0 WHEN n * 4 <= max(n) OVER () THEN 1 WHEN n * 2 <= max(n) OVER () THEN 2 WHEN n * 4 <= 3 * max(n) OVER () THEN 3 ELSE 4 END AS INT) AS level FROM g
""")
def agg22_activity(spark, d):
    """Changes of consecutive snapshots per repository and month."""
    rows, scans = _versions(spark, d)
    found = H.version_changes(rows, scans, "node", F.struct("n", "top"), F.col("repo_id"))
    return D.activity(H.changed_repos(found, F.col("before"), F.col("after")), rows.select("repo_id"), scans)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def agg23_contributions(spark, d):
    return A.table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def _search_nodes(spark, d):
    part = A.parts_graph(spark, d)[0].select("id", "kind", "name", "file")
    return part


@query(r"""
WITH w AS (SELECT 'Component:' || p_partkey AS id, p_name AS name, 'src/' || p_brand || '/' || p_partkey || '.tsx' AS file FROM part),
h AS (SELECT id, name, unnest([id, name, file]) AS hay FROM w),
t AS (SELECT id, name, lower(trim(hay)) AS h, list_filter(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace(hay, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_./:#-]+', ' ', 'g'))), '\s+'), lambda x: x <> '') AS words FROM h),
s AS (SELECT id, name, CASE WHEN h = 'small ring' THEN 100 WHEN ends_with(h, 'small ring') THEN 80 WHEN contains(h, 'small ring') THEN 60
  ELSE coalesce(nullif(greatest(CASE WHEN array_to_string(words, ' ') = 'small ring' THEN 100 WHEN ends_with(array_to_string(words, ' '), 'small ring') THEN 80 WHEN contains(array_to_string(words, ' '), 'small ring') THEN 60 ELSE 0 END, CASE WHEN array_to_string(words, '') = 'smallring' THEN 100 WHEN ends_with(array_to_string(words, ''), 'smallring') THEN 80 WHEN contains(array_to_string(words, ''), 'smallring') THEN 60 ELSE 0 END), 0), CASE WHEN list_contains(words, 'small') AND list_contains(words, 'ring') THEN 60 ELSE 0 END) END AS score FROM t),
b AS (SELECT id, name, max(score) AS score FROM s GROUP BY id, name)
SELECT id, name, CAST(score AS INT) AS score, CASE WHEN score >= 100 THEN 'high' WHEN score >= 80 THEN 'medium' ELSE 'low' END AS confidence FROM b WHERE score > 0 ORDER BY score DESC, id LIMIT 25
""")
def qry01_search(spark, d):
    return S.search(_search_nodes(spark, d), "small ring").select("id", "name", "score", "confidence")


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^?#]*') AS bare FROM pages)
SELECT page_id, regexp_replace(regexp_replace('/' || bare, '/+', '/', 'g'), '/?$', '/') AS clean, CASE WHEN starts_with(url, 'http') THEN CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END ELSE url END AS path,
  CAST(len(list_filter(string_split(regexp_replace('/' || bare, '/+', '/', 'g'), '/'), lambda s: s <> '')) AS INT) AS n_segments, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_extract(url, '[^/]*$') AS base FROM p
""")
def fn_paths(spark, d):
    u = F.col("url")
    return A.table(spark, d, "pages").select("page_id", T.clean_path(u).alias("clean"), T.url_path(u).alias("path"), F.size(T.segments(u)).alias("n_segments"), T.slug(u).alias("slug"), T.basename(u).alias("base"))


@query(r"""
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(trim(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_./:#-]+', ' ', 'g'))), '\s+'), lambda x: x <> ''), '|') AS words,
  floor((SELECT -sum(c / length(p_name) * log2(c / length(p_name))) FROM (SELECT count(*)::DOUBLE AS c FROM (SELECT unnest(string_split(p_name, '')) AS ch) GROUP BY ch)) * 10 + 0.5) / 10 AS bits, CASE WHEN length(p_name) <= 8 THEN '***' ELSE left(p_name, 4) || '...' || right(p_name, 4) END AS preview, CAST(ceil(length(p_name) / 4.0) AS BIGINT) AS tokens FROM part
""")
def fn_text(spark, d):
    n = F.col("p_name")
    return A.table(spark, d, "part").select("p_partkey", F.array_join(T.search_words(n), "|").alias("words"), T.round1(T.entropy(n)).alias("bits"), T.mask(n).alias("preview"), T.tokens_estimate(F.char_length(n)).cast("long").alias("tokens"))


@query(r"""
WITH f AS (SELECT page_id, (['Dockerfile', 'a/docker-compose.yml', '.env.local', 'x/b.tsx', 'c.PY', 'd.toml', 'README'])[1 + page_id % 7] AS path FROM pages)
SELECT page_id, (['docker', 'docker', 'env', 'typescript', 'python', 'config', 'other'])[1 + page_id % 7] AS category FROM f
""")
def src03_category(spark, d):
    names = F.array(*[F.lit(x) for x in ("Dockerfile", "a/docker-compose.yml", ".env.local", "x/b.tsx", "c.PY", "d.toml", "README")])
    return A.table(spark, d, "pages").select("page_id", T.category(F.get(names, (F.col("page_id") % 7).cast("int"))).alias("category"))


@query("SELECT l_orderkey AS id, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS first_part, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS last_part FROM lineitem GROUP BY l_orderkey")
def win01_first_last(spark, d):
    rows = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    first = G.first_wins(rows, "id").select("id", F.col("l_partkey").alias("first_part"))
    return first.join(G.last_wins(rows, "id").select("id", F.col("l_partkey").alias("last_part")), "id")


@query(f"""
WITH {A.TRADE_SQL}, i AS (SELECT src, dst, a.file AS fa, b.file AS fb FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id)
SELECT src, dst FROM i WHERE NOT (starts_with(fa, 'buyers/nation1') AND starts_with(fb, 'sellers/nation1'))
""")
def rul11_ignored(spark, d):
    nodes, edges = A.trade_graph(spark, d)
    issues = edges.select(F.col("id").alias("issue_id"), F.array("src", "dst").alias("nodes"), A.none().alias("meta"))
    kept = R.filter_ignored(issues, nodes, edges, ["*/nation1*/**"])
    return kept.select(F.col("nodes")[0].alias("src"), F.col("nodes")[1].alias("dst"))


@query(f"WITH {A.SALES_SQL}, o AS (SELECT id, kind, CAST(string_split(id, ':')[2] AS BIGINT) AS ord FROM nodes) SELECT id, CAST(CASE kind WHEN 'Region' THEN 0 WHEN 'Nation' THEN 260 ELSE 520 END AS BIGINT) AS x, CAST((row_number() OVER (PARTITION BY kind ORDER BY ord, id) - 1) * 136 AS BIGINT) AS y FROM o WHERE kind IN ('Region', 'Nation', 'Customer')")
def prj20_layout(spark, d):
    nodes = A.sales_graph(spark, d)[0].where("kind in ('Region', 'Nation', 'Customer')")
    return G.layout(nodes, ["Region", "Nation"]).select("id", "x", "y")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(p, '^(apps|packages|services)/[^/]+/') THEN regexp_extract(p, '^((apps|packages|services)/[^/]+)/', 1) ELSE string_split(p, '/')[1] END AS grp FROM (SELECT page_id, (['apps/web', 'packages/ui', 'lib'])[1 + page_id % 3] || '/x' || page_id AS p FROM pages)""")
def fn27_prefix_groups(spark, d):
    path = F.concat(F.get(F.array(F.lit("apps/web"), F.lit("packages/ui"), F.lit("lib")), (F.col("page_id") % 3).cast("int")), F.lit("/x"), F.col("page_id").cast("string"))
    return A.table(spark, d, "pages").select("page_id", T.prefix_group(path).alias("grp"))


@query("""
WITH s AS (SELECT o_custkey AS repo_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS head, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS old_head FROM orders GROUP BY 1)
SELECT repo_id, 'head' AS reasons FROM s WHERE head <> old_head
""")
def join30_stale(spark, d):
    at = F.struct("o_orderdate", "o_orderkey")
    rows = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo_id")).agg(F.max_by("o_orderstatus", at).alias("head"), F.min_by("o_orderstatus", at).alias("old"))
    return D.stale_repos(rows.select("repo_id", "head", F.lit(False).alias("dirty")), rows.select("repo_id", F.col("old").alias("head"), F.lit(False).alias("dirty")))
