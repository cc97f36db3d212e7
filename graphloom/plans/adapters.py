"""The driver's tables as graph tables: projections that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import edge_id

def none():
    return F.lit(None).cast("map<string,string>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, kind: str, key: str, name: str, file=None, meta=None) -> DataFrame:
    meta = none() if meta is None else meta
    return df.select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), (F.lit(None).cast("string") if file is None else file).alias("file"), meta.alias("meta"), F.col(key).cast("long").alias("ord"))


def _edges(df: DataFrame, kind: str, src, dst, order) -> DataFrame:
    rows = df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), order.cast("long").alias("ord"))
    return rows.select(edge_id(F.col("kind"), F.col("src"), F.col("dst")).alias("id"), "src", "dst", "kind", F.lit(None).cast("string").alias("confidence"), none().alias("meta"), "ord")


def ref(kind: str, column: str):
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def sales_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and orders; each depends on the one before."""
    t = lambda name: table(spark, sf_dir, name)
    nodes = _nodes(t("region"), "Region", "r_regionkey", "r_name").unionByName(_nodes(t("nation"), "Nation", "n_nationkey", "n_name")).unionByName(_nodes(t("customer"), "Customer", "c_custkey", "c_name")).unionByName(_nodes(t("orders"), "Order", "o_orderkey", "o_orderpriority"))
    edges = (
        _edges(t("nation"), "DEPENDS_ON", ref("Nation", "n_nationkey"), ref("Region", "n_regionkey"), F.col("n_nationkey"))
        .unionByName(_edges(t("customer"), "DEPENDS_ON", ref("Customer", "c_custkey"), ref("Nation", "c_nationkey"), F.col("c_custkey")))
        .unionByName(_edges(t("orders"), "DEPENDS_ON", ref("Order", "o_orderkey"), ref("Customer", "o_custkey"), F.col("o_orderkey")))
    )
    return nodes, edges


SALES_SQL = """
nodes AS (SELECT 'Region:' || r_regionkey AS id, 'Region' AS kind, r_name AS name FROM region UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 'Order:' || o_orderkey, 'Order', o_orderpriority FROM orders),
edges AS (SELECT 'Nation:' || n_nationkey AS src, 'Region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey FROM customer UNION ALL SELECT 'Order:' || o_orderkey, 'Customer:' || o_custkey FROM orders)
"""


def supplier_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMPORTS edges between suppliers that follow one another within an order."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pairs = rows.withColumn("next", nxt).where("next is not null").groupBy("l_suppkey", "next").agg(F.min("l_orderkey").alias("l_orderkey"))
    return _edges(pairs, "IMPORTS", ref("Supplier", "l_suppkey"), ref("Supplier", "next"), F.col("l_orderkey"))


CYCLES_SQL = """
pairs AS (SELECT 'Supplier:' || l_suppkey AS src, 'Supplier:' || lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
edges AS (SELECT DISTINCT src, dst FROM pairs WHERE dst IS NOT NULL)
"""


def parts_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as components that returned bulk lines render; a part of even size is exported."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    meta = F.create_map(F.lit("exported"), (F.col("p_size") % 2 == 0).cast("string"))
    nodes = _nodes(part, "Component", "p_partkey", "p_name", F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".tsx")), meta)
    rows = line.where("l_returnflag = 'R' and l_quantity > 45")
    edges = _edges(rows, "RENDERS", ref("Order", "l_orderkey"), ref("Component", "l_partkey"), F.col("l_orderkey"))
    return nodes, edges


def models_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as models that refer to their orders."""
    nodes = _nodes(table(spark, sf_dir, "customer"), "Model", "c_custkey", "c_name")
    edges = _edges(table(spark, sf_dir, "orders"), "REFERENCES", ref("Model", "o_custkey"), ref("Order", "o_orderkey"), F.col("o_orderkey"))
    return nodes, edges


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers under paths of their nation; a customer uses the suppliers of its orders."""
    t = lambda name: table(spark, sf_dir, name)
    path = lambda folder, nation: F.concat(F.lit(folder + "/nation"), F.col(nation).cast("string"), F.lit("/file.ts"))
    nodes = _nodes(t("customer"), "Customer", "c_custkey", "c_name", path("buyers", "c_nationkey")).unionByName(_nodes(t("supplier"), "Supplier", "s_suppkey", "s_name", path("sellers", "s_nationkey")))
    joined = t("lineitem").join(t("orders").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return nodes, _edges(joined, "USES", ref("Customer", "o_custkey"), ref("Supplier", "l_suppkey"), F.lit(0))


TRADE_SQL = """
nodes AS (SELECT 'Customer:' || c_custkey AS id, 'buyers/nation' || c_nationkey || '/file.ts' AS file, c_nationkey AS nation, 'buyer' AS side FROM customer UNION ALL SELECT 'Supplier:' || s_suppkey, 'sellers/nation' || s_nationkey || '/file.ts', s_nationkey, 'seller' FROM supplier),
edges AS (SELECT DISTINCT 'Customer:' || o_custkey AS src, 'Supplier:' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def calls_and_routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every page's url as a call; every page's path, digits as parameters, as a route. Every seventh page calls
    something below its path, which no route takes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    target = F.when(F.col("page_id") % 7 == 6, F.concat(path, F.lit("/raw"))).when(F.col("page_id") % 2 == 0, path).otherwise(F.col("url"))
    calls = pages.select(F.col("page_id").alias("call_ord"), F.when(F.col("page_id") % 5 == 0, "POST").otherwise("GET").alias("method"), (F.col("page_id") % 3 == 0).alias("dynamic"), F.concat(F.lit("Page:"), F.col("page_id").cast("string")).alias("caller_id"), target.alias("full_url"), F.array().cast("array<struct<field:string,line:int,confidence:string>>").alias("response_fields"))
    shape = F.when(F.col("page_id") % 4 == 0, path).otherwise(F.regexp_replace(path, "[0-9]+", "{id}"))
    routes = pages.select(F.col("page_id").alias("route_ord"), F.when(F.col("page_id") % 5 == 0, "POST").otherwise("GET").alias("method"), shape.alias("path"), F.concat(F.lit("APIEndpoint:"), F.col("page_id").cast("string")).alias("endpoint_id"), F.array().cast("array<struct<id:string,name:string>>").alias("response_fields"))
    return calls, routes


LINK_SQL = r"""
p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages),
calls AS (SELECT page_id AS call_ord, CASE WHEN page_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method, page_id % 3 = 0 AS dynamic, 'Page:' || page_id AS caller_id, CASE WHEN page_id % 7 = 6 THEN path || '/raw' WHEN page_id % 2 = 0 THEN path ELSE url END AS full_url FROM p),
routes AS (SELECT page_id AS route_ord, CASE WHEN page_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN page_id % 4 = 0 THEN path ELSE regexp_replace(path, '[0-9]+', '{id}', 'g') END AS path, 'APIEndpoint:' || page_id AS endpoint_id FROM p),
c1 AS (SELECT *, regexp_extract(full_url, '^[^?#]*') AS bare FROM calls), r1 AS (SELECT *, regexp_extract(path, '^[^?#]*') AS bare FROM routes),
c AS (SELECT *, CASE WHEN bare = '' THEN '/' ELSE regexp_replace(regexp_replace(CASE WHEN starts_with(bare, '/') THEN bare ELSE '/' || bare END, '/+', '/', 'g'), '/?$', '/') END AS clean FROM c1),
r AS (SELECT *, CASE WHEN bare = '' THEN '/' ELSE regexp_replace(regexp_replace(CASE WHEN starts_with(bare, '/') THEN bare ELSE '/' || bare END, '/+', '/', 'g'), '/?$', '/') END AS clean FROM r1),
cs AS (SELECT *, list_filter(string_split(clean, '/'), lambda s: s <> '') AS seg FROM c), rs AS (SELECT *, list_filter(string_split(clean, '/'), lambda s: s <> '') AS seg FROM r),
m AS (SELECT cs.call_ord, cs.caller_id, cs.full_url, cs.method, rs.route_ord, rs.endpoint_id,
  CASE WHEN cs.clean = rs.clean AND NOT dynamic THEN 3
       WHEN len(cs.seg) = len(rs.seg) AND len(list_filter(range(1, len(cs.seg) + 1), lambda i: NOT (cs.seg[i] = rs.seg[i] OR regexp_matches(cs.seg[i], '^\{[^}]+\}$') OR cs.seg[i] = ':p' OR regexp_matches(rs.seg[i], '^\{[^}]+\}$') OR rs.seg[i] = ':p'))) = 0 THEN 2
       WHEN len(cs.seg) <= len(rs.seg) AND cs.seg = rs.seg[len(rs.seg) - len(cs.seg) + 1:] THEN 1
       WHEN len(rs.seg) <= len(cs.seg) AND rs.seg = cs.seg[len(cs.seg) - len(rs.seg) + 1:] THEN 1 END AS rank
  FROM cs JOIN rs ON cs.method = rs.method),
best AS (SELECT call_ord, endpoint_id, ['low', 'medium', 'high'][rank] AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY call_ord ORDER BY rank DESC, route_ord) AS n FROM m WHERE rank IS NOT NULL) WHERE n = 1)
"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits, newest first: a user's page is the file, the kind of event the author."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    # ranked by day first, then counted within, so that no single task sorts all rows
    day = F.to_date("ts")
    per_day = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    before = per_day.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("day", "base")
    own = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ts"), "event_id"))
    placed = rows.withColumn("day", day).join(before, "day").withColumn("commit_ord", F.col("base") + own)
    return placed.select(F.col("event_id").cast("string").alias("commit_id"), "commit_ord", F.col("event_type").alias("author"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file"))


def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.concat("source", F.lit("/"), F.col("lang")).alias("file"), F.lit(1).alias("total"), F.col("quality").alias("covered"))


def doc_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as functions of their source's file; each calls the one of half its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    nodes = _nodes(docs, "Function", "doc_id", "doc_id", F.concat(F.lit("src/"), F.col("source"), F.lit(".py")))
    edges = _edges(docs.where("doc_id > 0"), "CALLS", ref("Function", "doc_id"), F.concat(F.lit("Function:"), F.floor(F.col("doc_id") / 2).cast("string")), F.col("doc_id"))
    return nodes, edges
