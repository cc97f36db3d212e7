"""Files parsed once, on all cores: one narrow row per fact, whatever the language."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Steps

ROWS = "file string, ord long, fact string, name string, owner string, target string, extra string, line int"
SCHEMA = pa.schema([("file", pa.string()), ("ord", pa.int64()), *((c, pa.string()) for c in ("fact", "name", "owner", "target", "extra")), ("line", pa.int32())])
#: Facts that a worker holds before it hands them on.
HELD = 20_000
#: Tasks per core: parsing takes far longer than its bytes tell, and some files take longer than others.
TASKS = 4


def parsed(files: DataFrame, facts_of: Callable[[str | None, int | None], list[dict]], most: int | None = None) -> DataFrame:
    """(file, ord, fact, name, owner, target, extra, line) of (path, content), parsed by every use of the plan.

    Files are dealt over all cores first, as few partitions (a small table that files are rendered from is one) would
    be parsed by as few. A worker hands on its facts by some thousands, so it holds those of few files at once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                file = path.as_py()
                held += [(file, i, f["fact"], f["name"], f["owner"], f["target"], f["extra"], f["line"]) for i, f in enumerate(facts_of(text.as_py(), most))]
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    dealt = files.select("path", F.col("content").cast("string").alias("content")).repartition(TASKS * files.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(run, ROWS)


def once(facts: DataFrame) -> DataFrame:
    """The facts written down, so that the many joins over them read rows and parse nothing again."""
    return Steps(facts.sparkSession, "facts").put(facts, "facts")
