"""Registered queries of insight issues, documents of services, and question tools."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from graphloom.operators import diff as D
from graphloom.operators import insights as I
from graphloom.operators import rules as R
from graphloom.operators import search as S
from graphloom.plans import adapters as A
from graphloom.plans import phases
from graphloom.plans.analyzers import Analyzer, by_parser, results
from graphloom.plans.more_queries import _rendered
from graphloom.plans.queries import BREAKING_SQL, COMMITS_SQL, COVERAGE_SQL, METRICS_SQL, SECRETS_SQL, _issues, _metrics, query, set04_breaking
from graphloom.sources import python_facts, services, ts_facts

FOUND_SQL = f"""{SECRETS_SQL}, found AS (SELECT 'doc/' || doc_id AS file, n, rule FROM scored WHERE (rule <> 'high-entropy' OR bits >= 4.2) AND NOT regexp_matches(lower(value), 'example|placeholder|dummy|changeme|not-a-secret|localhost|^x+$|^0+$'))"""


def _secrets(spark, d):
    docs = A.table(spark, d, "documents").where("text is not null")
    return I.secrets(docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("content")))


@query(f"WITH {FOUND_SQL} SELECT 'SECRET_CANDIDATE' AS kind, 'high' AS severity, 'Potential ' || rule || ' secret in ' || file || ':' || n AS message, 'File:' || file AS node, true AS candidate, CAST(n AS VARCHAR) AS at_line FROM found")
def rul08_secret_issues(spark, d):
    return R.secret_issues(_secrets(spark, d)).select("kind", "severity", "message", F.col("nodes")[0].alias("node"), "candidate", F.col("meta")["line"].alias("at_line"))


HOT_SQL = "h AS (SELECT 'Function:' || p_partkey AS node_id, p_name AS name, 'f' || p_partkey AS file, CAST(p_size AS INT) AS complexity, (p_partkey % 60) / 2.0::DOUBLE AS score, p_partkey % 9 AS churn, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 1000) / 10.0::DOUBLE END AS pct, p_partkey % 7 AS impact FROM part)"
#: A double as a script prints it.
NUMBER_SQL = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


def _hot(spark, d):
    k = F.col("p_partkey")
    return A.table(spark, d, "part").select(A.ref("Function", "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.concat(F.lit("f"), k.cast("string")).alias("file"), F.col("p_size").alias("complexity"), (k % 60 / F.lit(2.0)).alias("score"), (k % 9).alias("churn"), F.when(k % 4 > 0, k % 1000 / F.lit(10.0)).alias("coverage_pct"), (k % 7).alias("impact"))


@query(f"""
WITH {HOT_SQL}
SELECT 'COMPLEXITY_HOTSPOT' AS kind, CASE WHEN score >= 25 THEN 'medium' ELSE 'low' END AS severity, name || ' has complexity ' || complexity || ' and hotspot score ' || {NUMBER_SQL.format('score')} AS message, node_id AS node FROM h WHERE score >= 25 OR complexity >= 18
UNION ALL SELECT 'UNCOVERED_RISKY_NODE', 'medium', name || ' has ' || {NUMBER_SQL.format('pct')} || '% coverage and impacts ' || impact || ' nodes', node_id FROM h WHERE pct < 50 AND impact >= 3
""")
def rul09_hotspot_issues(spark, d):
    """RUL-09 and RUL-10."""
    return R.hotspot_issues(_hot(spark, d)).select("kind", "severity", "message", F.col("nodes")[0].alias("node"))


@query(f"""
WITH {HOT_SQL}, {FOUND_SQL}, {COVERAGE_SQL}, low AS (SELECT * FROM cov WHERE pct < 50),
top AS (SELECT * FROM h ORDER BY score DESC, complexity DESC, node_id LIMIT 1)
SELECT 'top-hotspot' AS id, 'Top hotspot' AS title, name || ' is the highest ranked hotspot: score ' || {NUMBER_SQL.format('score')} || ', complexity ' || complexity || ', churn ' || churn || '.' AS summary, file || ' highest hotspot score' AS labels FROM top
UNION ALL SELECT 'secret-review', 'Secret review', count(*) || ' committed secret candidate' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' need manual verification.', (SELECT count(*)::VARCHAR FROM (SELECT * FROM found LIMIT 5)) FROM found HAVING count(*) > 0
UNION ALL SELECT 'coverage-gaps', 'Coverage gaps', count(*) || ' covered file' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' are below 50% line/statement coverage.', (SELECT string_agg(file || ' ' || {NUMBER_SQL.format('pct')} || '% covered', '|' ORDER BY file) FROM (SELECT * FROM low ORDER BY file LIMIT 5)) FROM low HAVING count(*) > 0
""")
def rul14_explanations(spark, d):
    """With what stands out of all tables; the secrets' evidence is counted, as several may stand in one place."""
    rows = I.explanations(_hot(spark, d), _secrets(spark, d), I.coverage(A.coverage_rows(spark, d)))
    labels = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["file"], e["label"])), "|")
    return rows.select("id", "title", "summary", F.when(F.col("id") == "secret-review", F.size("evidence").cast("string")).otherwise(labels).alias("labels"))


@query(f"""
WITH {COMMITS_SQL}, {COVERAGE_SQL}, c2 AS (SELECT 'src/src' || substr(file, 6) || '.py' AS file, commits, authors FROM churn), v AS (SELECT 'src/' || file || '.py' AS file, pct FROM cov),
n AS (SELECT doc_id, 'Function:' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'src/' || source || '.py' ELSE 'src/' || source || '/' || lang || '.py' END AS file FROM documents),
m AS (SELECT n.*, commits, authors, pct, doc_id % 3 = 0 AS hot FROM n LEFT JOIN c2 USING (file) LEFT JOIN v USING (file))
SELECT id, concat_ws(',', 'authors=' || authors, 'churn=' || commits, CASE WHEN hot THEN 'complexity=' || (doc_id % 50) END, 'coveragePct=' || {NUMBER_SQL.format('pct')}, CASE WHEN hot THEN 'fanIn=1' END, CASE WHEN hot THEN 'fanOut=' || (doc_id % 5) END, CASE WHEN hot THEN 'hotspotScore=' || (doc_id % 90) END, CASE WHEN hot THEN 'impact=2' END, 'own=x') AS meta FROM m
""")
def join19_enriched(spark, d):
    """Functions with the churn and coverage of their files and, every third, a hotspot's figures."""
    docs, k = A.table(spark, d, "documents"), F.col("doc_id")
    file = F.when(k % 2 == 0, F.concat(F.lit("src/"), "source", F.lit(".py"))).otherwise(F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit(".py")))
    nodes = docs.select(A.ref("Function", "doc_id").alias("id"), F.lit("Function").alias("kind"), file.alias("file"), F.create_map(F.lit("own"), F.lit("x")).alias("meta"))
    churned = I.churn(A.commits(spark, d), None).withColumn("file", F.concat(F.lit("src/src"), F.substring("file", 6, 100), F.lit(".py")))
    covered = I.coverage(A.coverage_rows(spark, d)).withColumn("file", F.concat(F.lit("src/"), "file", F.lit(".py")))
    hot = docs.where(k % 3 == 0).select(A.ref("Function", "doc_id").alias("node_id"), (k % 50).alias("complexity"), F.lit(1).alias("fan_in"), (k % 5).alias("fan_out"), F.lit(2).alias("impact"), (k % 90).cast("double").alias("score"))
    meta = F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return I.enrich(nodes, churned, covered, hot).select("id", F.array_join(meta, ",").alias("meta"))


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier), o AS (SELECT k, 'GET' AS method, '/s' || k || '/x/' AS path, 'list' || k AS operation, CAST(NULL AS VARCHAR) AS summary FROM s UNION ALL SELECT k, 'POST', '/s' || k || '/x/', NULL, 'makes' FROM s UNION ALL SELECT k, 'DELETE', '/plain' || k, NULL, NULL FROM s WHERE k % 2 = 0)
SELECT 'APIEndpoint:' || method || ' ' || path AS id, method, path, 'openapi' AS source, operation, summary, 'docs/openapi' || k || '.json' AS file FROM o
""")
def src10_openapi(spark, d):
    """A document per supplier: repeated slashes, upper-case methods, keys that are none, and broken ones."""
    k = F.col("s_suppkey")
    more = F.when(k % 2 == 0, _text(', "plain', k.cast("string"), '": {"delete": true}')).otherwise("")
    text = _text('{"paths": {"/s', k.cast("string"), '//x/": {"get": {"operationId": "list', k.cast("string"), '", "summary": 5}, "POST": {"summary": "makes"}, "x-note": {}, "parameters": []}, "odd": []', more, "}}")
    files = _rendered(A.table(spark, d, "supplier"), _text("docs/openapi", k.cast("string"), ".json"), text).unionByName(spark.createDataFrame([("bad.json", "{"), ("list.yml", "- 1")], "path string, content string"))
    nodes, routes = services.openapi(files)
    meta = F.col("meta")
    return nodes.join(routes.select(F.col("endpoint_id").alias("id"), "method", "path"), "id").select("id", "method", "path", meta["source"].alias("source"), meta["operationId"].alias("operation"), meta["summary"].alias("summary"), "file")


@query("""
WITH s AS (SELECT s_suppkey AS k, 'stack/' || s_suppkey || '.yml#' AS spot FROM supplier)
SELECT 'DockerService:' || spot || 'web' AS src, 'DockerService:' || spot || 'db' AS dst FROM s UNION ALL SELECT 'DockerService:' || spot || 'job', 'DockerService:' || spot || 'web' FROM s WHERE k % 3 = 0
""")
def src11_compose(spark, d):
    """Dependencies as maps and as lists, in two notations; targets that are no service of the file are left out."""
    k = F.col("s_suppkey")
    json_text = '{"services": {"web": {"depends_on": {"db": {}, "gone": {}}}, "db": null}}'
    yaml_text = F.when(k % 3 == 0, F.lit("services:\n  web:\n    depends_on: [db, gone]\n  db: {}\n  job:\n    depends_on:\n      - web\n")).otherwise(F.lit("services:\n  web:\n    depends_on: [db, gone]\n  db: {}\n"))
    files = _rendered(A.table(spark, d, "supplier"), _text("stack/", k.cast("string"), ".yml"), F.when((k % 2 == 0) & (k % 3 != 0), json_text).otherwise(yaml_text))
    return services.compose(files)[1].select("src", "dst")


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'n' || k AS router, 'up' || k || '/{one_pk}/' AS prefix FROM s UNION ALL SELECT 'm' || k, 'up' || k || '/{one_pk}/mid/{two_pk}/' FROM s
""")
def grf07_nested_routers(spark, d):
    """Per supplier a router, one nested below it and one below that."""
    k = F.col("s_suppkey").cast("string")
    text = _text("r", k, " = DefaultRouter()\nr", k, ".register('up", k, "', V)\nn", k, " = NestedSimpleRouter(r", k, ", 'up", k, "', lookup='one')\nn", k, ".register('mid', V)\nm", k, " = NestedSimpleRouter(n", k, ", 'mid', lookup='two')\n")
    files = _rendered(A.table(spark, d, "supplier"), _text("nest/u", k, ".py"), text)
    return python_facts.router_prefixes(python_facts.extract(files))


@query("SELECT 'jobs/t' || s_suppkey || '.py' AS file, name FROM supplier, (VALUES ('plain'), ('called'), ('bound')) AS f(name)")
def ext19_celery_tasks(spark, d):
    """Decorators with and without a call, on names and on attributes; other decorators and texts that look alike are none."""
    k = F.col("s_suppkey").cast("string")
    text = _text("# @shared_task\nnote = '''\n@shared_task\ndef ghost(): pass\n'''\n@shared_task\ndef plain():\n    @cached\n    def inner(): pass\n\n@shared_task(bind=True)\ndef called(self): pass\n\n@app.task\nasync def bound(): pass\n\n@tasks.other\ndef no", k, "(): pass\n")
    files = _rendered(A.table(spark, d, "supplier"), _text("jobs/t", k, ".py"), text)
    return python_facts.found(files).where("fact = 'celery_task'").select("file", "name")


@query("""
WITH p AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'File:lib/a' || k || '.ts' AS caller_id, 'GET' AS method, '/v' || k || '/top' AS full_url, false AS dynamic FROM p
UNION ALL SELECT 'Function:lib/a' || k || '.ts#load', 'PATCH', '/v' || k || '/one/{param}', true FROM p UNION ALL SELECT 'Function:lib/a' || k || '.ts#load', 'GET', 'https://else.where/x', false FROM p UNION ALL SELECT 'Function:lib/a' || k || '.ts#load', 'PUT', '/plain', false FROM p
""")
def ext11_client_calls(spark, d):
    """EXT-11, EXT-12: a client with a base address, called outside and inside a function, with a whole address, and fetch."""
    k = F.col("s_suppkey").cast("string")
    text = _text("const http", k, " = axios.create({\n  timeout: 5,\n  baseURL: '/v", k, "/',\n});\n// http", k, ".get('/ghost')\nhttp", k, ".get('/top');\nexport function load(id) {\n  http", k, ".patch(`/one/${id}`);\n  http", k, ".get('https://else.where/x');\n  return fetch('/plain', { method: 'put' });\n}\n")
    files = _rendered(A.table(spark, d, "supplier"), _text("lib/a", k, ".ts"), text)
    return ts_facts.api_calls(ts_facts.extract(files)).select("caller_id", "method", "full_url", "dynamic")


@query("""
WITH used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
SELECT 'DEAD_CODE' AS kind, 'Component "' || p_name || '" is never rendered' AS message, 'medium' AS confidence, 'Component:' || p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM used)
""")
def qry03_dead_code(spark, d):
    return S.dead_code_query(_issues(spark, d), "medium").select("kind", "message", "confidence", F.col("nodes")[0].alias("node"))


@query(f"WITH {BREAKING_SQL} SELECT kind, message FROM breaking UNION ALL SELECT 'BREAKING_' || upper(s_name), 'standing' FROM supplier")
def qry04_breaking(spark, d):
    """What a diff finds, then what the report itself holds; issues of other kinds are left out."""
    standing = A.table(spark, d, "supplier").select(F.concat(F.lit("BREAKING_"), F.upper("s_name")).alias("kind"), F.lit("standing").alias("message"))
    other = A.table(spark, d, "part").select(F.lit("DEAD_CODE").alias("kind"), F.col("p_name").alias("message"))
    return S.breaking_query(set04_breaking(spark, d), standing.unionByName(other))


@query(f"WITH {METRICS_SQL} SELECT scan_id, health, CASE WHEN row_number() OVER (PARTITION BY project_id ORDER BY finished_at DESC, scan_id DESC) <= 4 THEN 'r' || scan_id END AS report_json FROM m")
def snk10_prune(spark, d):
    return D.prune(_metrics(spark, d).withColumn("report_json", F.concat(F.lit("r"), "scan_id")), 4).select("scan_id", "health", "report_json")


@query(f"""
WITH RECURSIVE {A.SALES_SQL}, reach AS (SELECT 'Nation:3' AS id, 0 AS depth UNION SELECT edges.src, depth + 1 FROM reach JOIN edges ON edges.dst = reach.id)
SELECT nodes.id, kind, CAST(depth AS INT) AS depth FROM reach JOIN nodes ON nodes.id = reach.id WHERE depth > 0 ORDER BY depth, nodes.id LIMIT 40
""")
def qry02_impact(spark, d):
    nodes, edges = A.sales_graph(spark, d)
    return S.impact_query(nodes, edges, node_id="Nation:3", limit=40).select("id", "kind", "depth")


def _ddl(path, content):
    """Tables of a schema file as models, their references, and a route for each."""
    for m in re.finditer(r"CREATE TABLE (\w+) \(([^;]*)\);", content):
        own = f"Model:{path}#{m[1]}"
        yield {"part": "node", "id": own, "kind": "Model", "name": m[1], "line": content.count("\n", 0, m.start()) + 1, "meta": {"source": "ddl"}}
        for to in re.findall(r"REFERENCES (\w+)", m[2]):
            yield {"part": "edge", "kind": "REFERENCES", "src": own, "dst": f"Model:schema/{to}.sql#{to}"}
        yield {"part": "route", "method": "get", "url": f"/rows/{m[1]}", "id": f"APIEndpoint:GET /rows/{m[1]}"}


DDL = Analyzer("ddl", lambda: F.col("path").endswith(".sql"), by_parser(_ddl))


@query("""
WITH t AS (SELECT s_suppkey AS k, s_suppkey // 2 AS h FROM supplier)
SELECT 'node' AS what, 'Model:schema/t' || k || '.sql#t' || k AS id, NULL AS dst FROM t UNION ALL SELECT 'edge', 'Model:schema/t' || k || '.sql#t' || k, 'Model:schema/t' || h || '.sql#t' || h FROM t WHERE h > 0 UNION ALL SELECT 'route', '/rows/t' || k, 'APIEndpoint:GET /rows/t' || k FROM t
""")
def udx01_analyzer(spark, d):
    """An outside analyzer of schema files, one per supplier; another finds no file and does not run."""
    k, h = F.col("s_suppkey").cast("string"), F.floor(F.col("s_suppkey") / 2)
    refers = F.when(h > 0, F.concat(F.lit(", up INT REFERENCES t"), h.cast("string"))).otherwise("")
    files = _rendered(A.table(spark, d, "supplier"), F.concat(F.lit("schema/t"), k, F.lit(".sql")), F.concat(F.lit("-- one\nCREATE TABLE t"), k, F.lit(" (id INT"), refers, F.lit(");\n")))
    none = Analyzer("none", lambda: F.col("path").endswith(".prisma"), by_parser(_ddl))
    (part,) = results(files, [none, DDL])
    nodes = part.nodes.where("kind = 'Model'").select(F.lit("node").alias("what"), "id", F.lit(None).cast("string").alias("dst"))
    return nodes.unionByName(part.edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), "dst")).unionByName(part.routes.select(F.lit("route").alias("what"), F.col("path").alias("id"), F.col("endpoint_id").alias("dst")))


@query("""
WITH p AS (SELECT user_id AS run, event_type AS phase, CAST(round(value * 100) AS BIGINT) AS ms FROM events), r AS (SELECT user_id AS run, CAST(sum(round(value * 100)) AS BIGINT) AS total_ms, max(event_id) AS peak_rss FROM events GROUP BY user_id),
w AS (SELECT CAST(sum(total_ms) AS DOUBLE) / count(*) AS ms, max(peak_rss) AS peak_rss, count(*) AS n FROM r)
SELECT phase, round(CAST(sum(ms) AS DOUBLE) / (SELECT n FROM w), 6) AS ms, CAST(NULL AS BIGINT) AS peak_rss FROM p GROUP BY phase UNION ALL SELECT 'total', round(ms, 6), peak_rss FROM w
""")
def agg29_phase_means(spark, d):
    """Events as phases of runs, one run per user."""
    ms = F.round(F.col("value") * 100).cast("long")
    events = A.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("phase"), ms.alias("ms"), "event_id")
    each, whole = phases.means(events, events.groupBy("run").agg(F.sum("ms").alias("total_ms"), F.max("event_id").alias("peak_rss")))
    each = each.select("phase", F.round("ms", 6).alias("ms"), F.lit(None).cast("long").alias("peak_rss"))
    return each.unionByName(whole.select(F.lit("total").alias("phase"), F.round("total_ms", 6).alias("ms"), "peak_rss"))


@query("""
WITH p AS (SELECT page_id AS i FROM pages), x AS (SELECT i // 3 AS e, min(i) AS v FROM p GROUP BY 1), c AS (SELECT i // 2 AS e, max(i) AS c FROM p GROUP BY 1),
m AS (SELECT i, CASE WHEN i + 1 IN (SELECT i FROM p) THEN i + 1 ELSE i // 5 END AS m FROM p)
SELECT 'APIEndpoint:' || p.i AS id, CASE WHEN p.i % 4 = 0 THEN 'get' ELSE 'POST' END AS method, CASE WHEN p.i % 4 = 0 THEN '/p/' ELSE '/x/' END || p.i AS path, CASE WHEN p.i % 2 = 1 THEN 'drf' END AS source,
 CASE WHEN p.i % 3 <> 0 THEN 'f' || p.i || CASE WHEN p.i % 2 = 0 THEN ':' || (p.i + 1) ELSE '' END END AS location, CASE WHEN v % 7 <> 0 THEN 'V' || v END AS viewset, CASE WHEN v % 7 <> 0 THEN 'S' || (v // 2) END AS serializer,
 CASE WHEN v % 7 <> 0 THEN 'M' || m.m END AS model, 'P' || c AS caller_name, CASE c % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence
FROM p LEFT JOIN x ON x.e = p.i LEFT JOIN c ON c.e = p.i LEFT JOIN m ON m.i = v // 2
""")
def join25_api_chain(spark, d):
    """Pages as endpoints, view sets, serializers, models and callers; some view sets are no nodes, some metadata is absent,
    and the first use of a view set is of another kind."""
    i = F.col("page_id")
    s = lambda prefix, n=i: F.concat(F.lit(prefix), F.floor(n).cast("string"))
    pages = A.table(spark, d, "pages")
    meta = F.when(i % 4 != 0, F.create_map(F.lit("method"), F.lit("POST"), F.lit("path"), s("/x/"), F.lit("source"), F.when(i % 2 == 1, "drf")))
    none = F.lit(None).cast("map<string,string>")
    node = lambda kind, short: pages.select(s(kind + ":").alias("id"), F.lit(kind).alias("kind"), s(short).alias("name"), none.alias("meta"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"))
    nodes = pages.select(s("APIEndpoint:").alias("id"), F.lit("APIEndpoint").alias("kind"), s("get /p/").alias("name"), meta.alias("meta"), F.when(i % 3 != 0, s("f")).alias("file"), F.when((i % 3 != 0) & (i % 2 == 0), i + 1).alias("line"))
    for more in (node("ViewSet", "V").where(F.substring("name", 2, 20).cast("long") % 7 != 0), node("Serializer", "S"), node("Model", "M"), node("Page", "P")):
        nodes = nodes.unionByName(more)
    edge = lambda kind, src, dst, order, grade=F.lit(None).cast("string"): pages.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), grade.alias("confidence"), order.alias("ord"))
    edges = edge("EXPOSES", s("ViewSet:"), s("APIEndpoint:", i / 3), i)
    for more in (
        edge("USES", s("ViewSet:"), s("Model:"), i * 10),
        edge("USES", s("ViewSet:"), s("Serializer:", i / 2), i * 10 + 1),
        edge("USES", s("ViewSet:"), s("Serializer:"), i * 10 + 2),
        edge("USES", s("Serializer:"), s("Model:", i + 1), i * 10 + 3),
        edge("USES", s("Serializer:"), s("Model:", i / 5), i * 10 + 4),
        edge("CALLS", s("Page:"), s("APIEndpoint:", i / 2), -i, F.when(i % 3 == 0, "high").when(i % 3 == 1, "medium").otherwise("low")),
    ):
        edges = edges.unionByName(more)
    return S.api_map(nodes, edges).select("id", "method", "path", "source", "location", "viewset", "serializer", "model", "caller_name", "confidence")
