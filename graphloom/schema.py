"""Canonical tables and vocabularies of the graph engine.

nodes(id, kind, name, file, line, meta, ord) and edges(id, src, dst, kind, confidence, meta, ord) hold the
graph; meta is a map of strings, ord the order of insertion. Edges may name nodes that are absent.
"""

from __future__ import annotations

NODES = "id string, kind string, name string, file string, line int, meta map<string,string>, ord long"
EDGES = "id string, src string, dst string, kind string, confidence string, meta map<string,string>, ord long"
ISSUES = "kind string, severity string, message string, nodes array<string>, candidate boolean, meta map<string,string>, ord long"
CALLS = "call_ord long, method string, url string, client string, dynamic boolean, line int, file string, caller_id string, full_url string, response_fields array<struct<field:string,line:int,confidence:string>>"
ROUTES = "route_ord long, method string, path string, viewset_id string, endpoint_id string, response_fields array<struct<id:string,name:string>>"
CHURN = "file string, commits long, authors long, last_commit_at string"
COVERAGE = "file string, total long, covered long, pct double, source string"
FILES = "path string, graph_path string, category string, content string"

#: Points that an issue of each kind takes off the health score.
HEALTH_WEIGHTS = {
    "CIRCULAR_DEPENDENCY": 10, "GOD_MODEL": 5, "GOD_COMPONENT": 5, "LARGE_FILE": 2, "UNUSED_ENDPOINT": 2, "DEAD_CODE": 1, "DANGLING_API_CALL": 0,
    "SECRET_CANDIDATE": 15, "UNCOVERED_RISKY_NODE": 4, "COMPLEXITY_HOTSPOT": 3, "BOUNDARY_VIOLATION": 8, "BREAKING_ENDPOINT_REMOVED": 20,
    "BREAKING_ROUTE_METHOD_CHANGED": 20, "BREAKING_FIELD_REMOVED": 15,
}
#: Along these kinds the source depends on the target, along the others the target on the source.
IMPACT_REVERSE = ("USES", "CALLS", "RENDERS", "DEPENDS_ON", "TYPES", "CONSUMES", "PROVIDES")
IMPACT_FORWARD = ("EXPOSES", "PROVIDES")
BOUNDARY_KINDS = ("IMPORTS", "USES", "CALLS", "RENDERS", "DEPENDS_ON", "REFERENCES", "REGISTERED_IN", "TYPES", "CONSUMES", "PROVIDES")
FRAMEWORK_FILES = ("page", "layout", "loading", "error", "global-error", "not-found", "template", "default", "route", "middleware", "instrumentation")
FRAMEWORK_NAMES = ("generateMetadata", "generateStaticParams", "generateViewport", "metadata", "viewport", "getServerSideProps", "getStaticProps", "getStaticPaths", "getInitialProps", "middleware", "register")
HOTSPOT_SCORE, COMPLEXITY, LOW_COVERAGE, HIGH_IMPACT, TOP_HOTSPOTS = 25, 18, 50, 3, 25
GOD_MODEL, LARGE_FILE = 15, 300
SECRET_SCAN_CHARS = 1_500_000
