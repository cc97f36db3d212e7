"""Coverage reports (SRC-07, SRC-08, WIN-05): parsed by columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.files import read_small

#: Where coverage reports are looked for, in this order.
DEFAULTS = ("coverage/lcov.info", "coverage/coverage-final.json", "coverage/coverage.json")


def lcov(reports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(report, file, total, covered) of (report, content): each DA line belongs to the SF line before it;
    end_of_record ends a file."""
    lines = reports.select(*by, "report", F.posexplode(F.split("content", r"\r?\n")).alias("n", "text"))
    mark = F.when(F.col("text").startswith("SF:"), F.expr("trim(substring(text, 4))")).when(F.col("text") == "end_of_record", F.lit(""))
    so_far = Window.partitionBy(*by, "report").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("file", F.last(mark, ignorenulls=True).over(so_far)).where(F.col("text").startswith("DA:") & (F.coalesce("file", F.lit("")) != ""))
    hits = F.regexp_extract("text", r"^DA:\d+,(-?\d+)", 1).try_cast("long")
    return rows.groupBy(*by, "report", "file").agg(F.count("*").alias("total"), F.count_if(hits > 0).alias("covered"))


def istanbul(reports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(report, file, total, covered): statement hits where there are any, else the lines summary; the
    total entry of a summary is left out, invalid JSON gives no rows."""
    parsed = F.from_json("content", "map<string, struct<s: map<string,long>, lines: struct<total: long, covered: long>>>")
    rows = reports.select(*by, "report", F.explode(parsed).alias("file", "x")).where("file <> 'total'")
    hits = F.map_values("x.s")
    total = F.when(F.col("x.s").isNotNull(), F.size(hits).cast("long")).otherwise(F.col("x.lines.total"))
    covered = F.when(F.col("x.s").isNotNull(), F.size(F.filter(hits, lambda h: h > 0)).cast("long")).otherwise(F.col("x.lines.covered"))
    return rows.select(*by, "report", "file", total.alias("total"), covered.alias("covered")).where("total is not null")


def read_any(reports: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SRC-09: by the report's name, LCOV for .info, JSON for others; columns `by` stay beside the report."""
    return lcov(reports.where(F.col("report").endswith(".info")), by).unionByName(istanbul(reports.where(~F.col("report").endswith(".info")), by))


def find(spark: SparkSession, root: str, path: str | None = None) -> DataFrame:
    """SRC-09: (report, content) of the report at `path`, absolute or below the root, else of the first of DEFAULTS
    that is there; no row if there is none."""
    root = root.rstrip("/")
    tried = [path if "://" in path or path.startswith("/") else f"{root}/{path}"] if path else [f"{root}/{name}" for name in DEFAULTS]
    found = next(((p, text) for p in tried if (text := read_small(spark, p)) is not None), None)
    rows = spark.createDataFrame([found] if found else [], "report string, content string")
    # absolute names below the root become relative ones
    here = (root.partition("://")[2] if "://" in root else root.removeprefix("file:")) + "/"
    return rows.withColumn("content", F.replace("content", F.lit(here), F.lit("")))
