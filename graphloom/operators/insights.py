"""Churn, coverage, secrets, complexity and hotspots (AGG-01..08, FN-20, JOIN-16..19, SRT-03/04, RUL-14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import allowed_secret, entropy, js_number, js_round, mask, round1
from graphloom.operators.graph import Steps, degrees, impact_size
from graphloom.schema import COMPLEXITY, TOP_HOTSPOTS

#: The patterns of secret rules. ASCII word edges are written out, as Java's \b is not ASCII.
EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
FIXED_RULES = (("aws-access-key", r"(AKIA[0-9A-Z]{16})"), ("github-token", r"(ghp_[A-Za-z0-9_]{30,}|github_pat_[A-Za-z0-9_]{40,})"), ("slack-token", r"(xox[baprs]-[A-Za-z0-9-]{20,})"))
SECRET_NAME = r"[A-Z0-9_]*(?:SECRET|TOKEN|API[_-]?KEY|PASSWORD|PRIVATE[_-]?KEY)[A-Z0-9_]*"
QUOTED = rf"(?i){EDGE_L}{SECRET_NAME}{EDGE_R}\s*[:=]\s*[\"']([^\"']{{12,}})[\"']"
ENV = rf"(?i)^\s*(?:export\s+)?{SECRET_NAME}{EDGE_R}\s*=\s*([^\"'\s#]{{12,}})"
RUN = r"[A-Za-z0-9+/=_-]{32,}"
KEYWORD = r"(?i)(secret|token|api[_-]?key|password|private[_-]?key)"
LOOP_WORDS = r"(?<![A-Za-z0-9_])(if|elif|else\s+if|for|while|case|catch|except|switch)(?![A-Za-z0-9_])"


def churn(commits: DataFrame, most: int | None = 500) -> DataFrame:
    """AGG-01: (file, commits, authors, last_commit_at) of (commit_id, commit_ord, author, ts, file).

    The newest `most` commits count, or all if it is None, each file once per commit. Their cut is one
    value, found by a distinct count over commit_ord that a top-k bounds.
    """
    if most is not None:
        newest = commits.select("commit_ord").distinct().orderBy("commit_ord").limit(most)
        cut = newest.agg(F.max("commit_ord").alias("cut"))
        commits = commits.join(F.broadcast(cut), F.col("commit_ord") <= F.col("cut"))
    rows = commits.groupBy("file", "commit_id").agg(F.min(F.struct("commit_ord", "author", "ts")).alias("c"))
    return rows.groupBy("file").agg(F.count("*").alias("commits"), F.countDistinct("c.author").alias("authors"), F.min_by("c.ts", "c.commit_ord").alias("last_commit_at"))


def pct(covered: Column, total: Column) -> Column:
    return F.when(total > 0, round1(covered * 100.0 / total))


def coverage(rows: DataFrame) -> DataFrame:
    """AGG-02: sums per file."""
    sums = rows.groupBy("file").agg(F.sum("total").cast("long").alias("total"), F.sum("covered").cast("long").alias("covered"))
    return sums.withColumn("pct", pct(F.col("covered"), F.col("total")))


def overall_coverage(rows: DataFrame) -> DataFrame:
    """AGG-03: not rounded, for gates; AGG-20: the mean of rounded shares."""
    shares = coverage(rows)
    return shares.agg(F.when(F.sum("total") > 0, F.sum("covered") * 100.0 / F.sum("total")).alias("pct"), js_round(F.avg(F.coalesce("pct", F.lit(0.0)))).cast("long").alias("mean_pct"))


def match_coverage(rows: DataFrame, files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """JOIN-16: each coverage path with the scanned file it names: equal, else the first that ends with it
    or that it ends with. `by` are columns of both sides that must agree.

    An ending begins after a slash, so each side offers its endings, as many as it has folders, and meets the other's
    whole paths by equality; many files of one name are no hot key.
    """
    endings = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.array_join(F.slice(F.split(c, "/"), n, F.size(F.split(c, "/"))), "/"))
    asked = rows.select(*by, "file", "total", "covered").withColumn("file", F.regexp_replace("file", r"^\./", ""))
    known = files.select(*by, "path", "scan_ord")
    names = asked.select(*by, "file").distinct()
    longer = names.withColumn("path", F.explode(endings(F.col("file")))).join(known, [*by, "path"])
    shorter = known.withColumn("file", F.explode(endings(F.col("path")))).join(names, [*by, "file"])
    met = longer.select(*by, "file", "path", "scan_ord").unionByName(shorter.select(*by, "file", "path", "scan_ord"))
    first = met.groupBy(*by, "file").agg(F.min_by("path", F.struct(F.col("file") != F.col("path"), "scan_ord")).alias("path"))
    return asked.join(first, [*by, "file"])


def lines_of(files: DataFrame) -> DataFrame:
    """(file, line, text) of (file, content)."""
    return files.select("file", F.posexplode(F.split("content", "\n", -1)).alias("_p", "text")).select("file", (F.col("_p") + 1).alias("line"), "text")


def secrets(files: DataFrame, most_chars: int | None = None) -> DataFrame:
    """FN-20: (file, line, col, rule, preview, entropy) of (file, content), all in the JVM.

    A cheap keyword test goes first, so few lines meet the costly patterns. The column is where the
    match starts; rows come per hit, and one value may be reported by several rules. Files over
    `most_chars` are skipped, none if it is None. Positions of repeated hits follow from splitting at each match.
    """
    rows = lines_of(files if most_chars is None else files.where(F.char_length("content") <= most_chars))
    rows = rows.where(F.col("text").rlike(KEYWORD) | F.col("text").rlike("AKIA|ghp_|github_pat_|xox[baprs]-"))
    none = F.lit(None).cast("double")

    def hits(rule: str, pattern: str, group: int, scored: Column) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), 0)
        values = F.regexp_extract_all("text", F.lit(pattern), group)
        before = F.aggregate(
            F.zip_with(found, values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))),
            F.struct(F.col("text").alias("rest"), F.lit(1).alias("at"), F.array().cast("array<struct<col:int,v:string>>").alias("out")),
            lambda s, x: F.struct(
                F.substr(s["rest"], F.instr(s["rest"], x["m"]) + F.char_length(x["m"])).alias("rest"),
                (s["at"] + F.instr(s["rest"], x["m"]) - 1 + F.char_length(x["m"])).alias("at"),
                F.concat(s["out"], F.array(F.struct((s["at"] + F.instr(s["rest"], x["m"]) - 1).cast("int").alias("col"), x["v"].alias("v")))).alias("out"),
            ),
        )
        return F.transform(before["out"], lambda h: F.struct(F.lit(rule).alias("rule"), h["col"].alias("col"), h["v"].alias("value"), (entropy(h["v"]) if scored else none).alias("bits")))

    every = [hits(rule, EDGE_L + pattern + EDGE_R, 1, False) for rule, pattern in FIXED_RULES]
    every += [hits("secret-assignment", QUOTED, 1, True), hits("secret-assignment", ENV, 1, True)]
    runs = F.when(F.col("text").rlike(KEYWORD), F.filter(hits("high-entropy", RUN, 0, True), lambda h: h["bits"] >= 4.2))
    every.append(F.coalesce(runs, F.array().cast("array<struct<rule:string,col:int,value:string,bits:double>>")))
    out = rows.select("file", "line", F.explode(F.concat(*every)).alias("h")).where(~allowed_secret(F.col("h.value")))
    return out.select("file", "line", F.col("h.col").alias("col"), F.col("h.rule").alias("rule"), mask(F.col("h.value")).alias("preview"), round1(F.col("h.bits")).alias("entropy"))


def secret_order() -> Column:
    """SRT-04: file:line:column as text."""
    return F.concat_ws(":", "file", F.col("line").cast("string"), F.col("col").cast("string"))


def complexity(content: Column, category: Column) -> Column:
    """AGG-05: 1 and one more for every branching word and for &&, || and ?; other languages have 0."""
    count = 1 + F.regexp_count(content, F.lit(LOOP_WORDS)) + F.regexp_count(content, F.lit(r"&&|\|\||\?"))
    return F.when(category.isin("typescript", "python") & (content != ""), count).otherwise(0).cast("int")


def hotspots(nodes: DataFrame, edges: DataFrame, complexities: DataFrame, churned: DataFrame, covered: DataFrame, most: int = TOP_HOTSPOTS, with_impact: bool = True) -> DataFrame:
    """AGG-08, JOIN-18, SRT-03: the top nodes by score, complexity and id.

    `complexities` is (file, complexity). The order needs no impact, so nodes are cut to the top first
    and only those are traversed, together.
    """
    rows = nodes.where(F.col("file").isNotNull() & ~F.col("kind").isin("File", "Directory"))
    rows = rows.join(complexities, "file", "left").join(churned.select("file", "commits", "authors"), "file", "left").join(covered.select("file", F.col("pct").alias("coverage_pct")), "file", "left").join(degrees(nodes, edges), "id")
    rows = rows.fillna(0, ["complexity", "commits", "authors"])
    computed = F.when(F.col("commits") > 0, js_round(F.col("complexity") * F.col("commits") * (1 + F.col("fan_in") * 0.05 + F.col("fan_out") * 0.02))).otherwise(0)
    rows = rows.withColumn("score", F.coalesce(F.col("meta")["hotspotScore"].try_cast("double"), computed.cast("double"))).where((F.col("score") > 0) | (F.col("complexity") >= COMPLEXITY))
    top = rows.orderBy(F.desc("score"), F.desc("complexity"), "id").limit(most).select(F.col("id").alias("node_id"), "kind", "name", "file", F.col("commits").alias("churn"), "authors", "complexity", "fan_in", "fan_out", "score", "coverage_pct")
    if not with_impact:
        return top
    top = Steps(nodes.sparkSession, "hotspots").put(top, "top")  # read by the traversal and beside it, computed once
    sizes = impact_size(nodes, edges, top.select(F.col("node_id").alias("id"))).withColumnRenamed("id", "node_id")
    return top.join(sizes, "node_id")


def enrich(nodes: DataFrame, churned: DataFrame, covered: DataFrame, hot: DataFrame) -> DataFrame:
    """JOIN-19: churn, coverage and, for hotspots, their figures go into meta."""
    text = lambda c: js_number(F.col(c))
    rows = nodes.join(churned.select("file", "commits", "authors"), "file", "left").join(covered.select("file", "pct"), "file", "left").join(hot.select(F.col("node_id").alias("id"), "complexity", "fan_in", "fan_out", "impact", "score"), "id", "left")
    fresh = F.map_filter(F.create_map(*[x for name, c in (("churn", "commits"), ("authors", "authors"), ("coveragePct", "pct"), ("complexity", "complexity"), ("fanIn", "fan_in"), ("fanOut", "fan_out"), ("impact", "impact"), ("hotspotScore", "score")) for x in (F.lit(name), text(c))]), lambda k, v: v.isNotNull())
    own = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(fresh, k))
    return rows.withColumn("meta", F.map_concat(kept, fresh)).select(*nodes.columns)


#: The row that stands alone where nothing stands out; how much evidence a row carries.
CLEAN = ("phase-10-clean", "No phase-10 hotspots", "No churn hotspots, secret candidates, or coverage gaps were detected from the available local inputs.")
EVIDENCE = 5
EVIDENCE_TYPE = "array<struct<node_id:string,issue_kind:string,file:string,label:string>>"


def explanations(hot: DataFrame, found: DataFrame, covered: DataFrame, low: int = 50) -> DataFrame:
    """RUL-14: (ord, id, title, summary, evidence) of what stands out, or one row that nothing does.

    Evidence are the first five secrets, and files of low coverage, in the order of a reader's language (SRT-02, SRT-04). Each is
    a top-k beside a count, so no table is sorted.
    """
    none = F.lit(None).cast("string")
    said = lambda node, kind, file, label: F.struct(node.alias("node_id"), kind.alias("issue_kind"), file.alias("file"), label.alias("label"))
    row = lambda n, id_, title, summary, evidence: [F.lit(n).alias("ord"), F.lit(id_).alias("id"), F.lit(title).alias("title"), summary.alias("summary"), evidence.cast(EVIDENCE_TYPE).alias("evidence")]
    plural = lambda n: F.when(n == 1, "").otherwise("s")

    def counted(rows: DataFrame, order: Column, evidence: Column) -> DataFrame:
        top = rows.withColumn("_order", order).withColumn("_e", evidence).orderBy(F.collate("_order", "UNICODE"), "_order").limit(EVIDENCE)
        placed = top.select(F.row_number().over(Window.orderBy(F.collate("_order", "UNICODE"), "_order")).alias("k"), "_e")  # five rows
        listed = placed.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "_e"))), lambda x: x["_e"]).alias("evidence"))
        return rows.agg(F.count("*").alias("n")).where("n > 0").join(F.broadcast(listed))

    first = hot.orderBy(F.desc("score"), F.desc("complexity"), "node_id").limit(1)
    summary = F.concat("name", F.lit(" is the highest ranked hotspot: score "), js_number(F.col("score")), F.lit(", complexity "), F.col("complexity").cast("string"), F.lit(", churn "), F.col("churn").cast("string"), F.lit("."))
    first = first.select(*row(0, "top-hotspot", "Top hotspot", summary, F.array(said(F.col("node_id"), none, F.col("file"), F.lit("highest hotspot score")))))
    n = F.col("n")
    second = counted(found, secret_order(), said(none, F.lit("SECRET_CANDIDATE"), F.col("file"), F.concat("rule", F.lit(" at line "), F.col("line").cast("string"))))
    second = second.select(*row(1, "secret-review", "Secret review", F.concat(n.cast("string"), F.lit(" committed secret candidate"), plural(n), F.lit(" need manual verification.")), F.col("evidence")))
    third = counted(covered.where(F.col("pct") < low), F.col("file"), said(none, none, F.col("file"), F.concat(js_number(F.col("pct")), F.lit("% covered"))))
    third = third.select(*row(2, "coverage-gaps", "Coverage gaps", F.concat(n.cast("string"), F.lit(" covered file"), plural(n), F.lit(f" are below {low}% line/statement coverage.")), F.col("evidence")))
    rows = first.unionByName(second).unionByName(third)
    clean = rows.agg(F.count("*").alias("n")).where("n = 0").select(*row(3, CLEAN[0], CLEAN[1], F.lit(CLEAN[2]), F.array()))
    return rows.unionByName(clean)
