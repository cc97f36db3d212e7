"""Alerts of a stream against those of the whole table."""

import random
from datetime import datetime, timedelta

import pytest

from graphloom.operators import diff
from graphloom.streaming import alerts

SCHEMA = "project_id string, scan_id string, finished_at timestamp, health int, circular_count int, breaking_count int"


def test_alerts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(6)
    start = datetime(2024, 3, 1)
    rows = [(p, f"{p}{k:02}", start + timedelta(minutes=10 * k), rng.randint(60, 100), rng.randint(0, 4), int(rng.random() < 0.2)) for p in "ab" for k in range(30)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = {(r.scan_id, r.alert) for r in diff.alerts(diff.pair_snapshots(table, "health", "circular_count")).collect()}
    with pytest.raises(ValueError):
        alerts.alert_stream(table)
    rows.sort(key=lambda r: r[2] + timedelta(minutes=rng.randint(0, 25)))  # late, within the delay
    parts = [rows[i : i + 12] for i in range(0, len(rows), 12)]
    parts[2] = parts[2] + parts[1][:5] + [rows[1]]  # repeated, also such as were judged before
    parts.append([("end", "end", start + timedelta(days=9), 100, 0, 0)])
    parts.append([("a", "a-late", start, 0, 99, 1), ("end", "end2", start + timedelta(days=10), 100, 0, 0)])
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/k={k}")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, alerts.PROVIDER)
    try:
        got = []
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = alerts.alert_stream(source, late="30 minutes").writeStream.foreachBatch(lambda df, _: got.extend((r.scan_id, r.alert) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.unset(key)
    assert len(got) == len(set(got)) and set(got) == want and want
