"""WARC archives: written and read through Spark's file systems, captures assembled by concurrent-to ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, without

CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, http_length long, fields string, payload binary"
ADDED = ("_key", "_digest", "_first", "_bytes")
FILE_BYTES = 32 << 20
#: About 100 bytes each.
BROADCAST_DIGESTS = 50_000


def record_id(kind: str, key: Column) -> Column:
    """<urn:uuid:...> that kind and key alone decide."""
    h = F.md5(F.concat(F.lit(kind + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    at = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12)), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in headers]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", date: str = "2024-01-01T00:00:00Z", least: int = 100) -> None:
    """A request, a response or revisit, and a metadata record for each row of pages (key, url, html).

    Payloads of at least `least` bytes that are equal are stored once, with the smallest key; the
    others become revisits of it. First keys of payloads that repeat come from a partial aggregation by
    digest; up to BROADCAST_DIGESTS of them go back by broadcast, more by a shuffled join, where
    adaptive execution splits a hot payload. Null html is an empty payload, a null URL
    becomes urn:null, line breaks in URLs are percent-encoded. Rows that repeat a key with its payload
    are responses alike. The archive is Spark text output whose line separator ends a record, so any
    Hadoop file system takes it, and the commit protocol drops what lost executors half wrote.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = without(pages, *ADDED).select(F.col(key).alias("_key"), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("urn:null")), "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"), F.sha2(html, 256).alias("_digest"), F.octet_length(html).cast("long").alias("_bytes"))
    firsts = rows.where(F.col("_bytes") >= least).groupBy("_digest").agg(F.min("_key").alias("_first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = Scratch(pages.sparkSession, "warc-firsts").put(firsts, "firsts")
    mean = rows.agg(F.avg("_bytes")).first()[0] or 0
    few = firsts.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(firsts) if few else firsts, "_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_key"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    response = record_id("response", F.col("_key"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF + CRLF))
    digest = F.concat(F.lit("sha256:"), F.col("_digest"))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    target = F.regexp_extract("url", "://[^/?#]*([^#]*)", 1)
    records = F.array(
        _record([("WARC-Type", F.lit("request")), *common, ("WARC-Record-ID", record_id("request", F.col("_key"))), ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))),
        F.when(revisit, _record([("WARC-Type", F.lit("revisit")), *common, ("WARC-Record-ID", response), ("WARC-Profile", F.lit(REVISIT)), ("WARC-Refers-To", record_id("response", F.col("_first"))), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], http)).otherwise(
            _record([("WARC-Type", F.lit("response")), *common, ("WARC-Record-ID", response), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("html")))
        ),
        _record([("WARC-Type", F.lit("metadata")), *common, ("WARC-Record-ID", record_id("metadata", F.col("_key"))), ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("key: "), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit(CRLF))),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", max(3, 3 * int(FILE_BYTES / (mean + 1500)))).text(path)


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of one archive (plain, or gzip in one or many members), by their Content-Length."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data) + member.flush())
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        size = int(head.get("content-length", 0))
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        kind = head.get("warc-type")
        row = {"record_id": head.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "payload_digest": head.get("warc-payload-digest"), "http_length": None, "fields": None, "payload": None}
        if kind in ("response", "revisit") and head.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            for line in http.split(b"\r\n"):
                if line[:15].lower() == b"content-length:":
                    row["http_length"] = int(line[15:])
            if kind == "response":
                row["payload"] = payload
        elif kind == "metadata":
            row["fields"] = block.decode("utf-8", "replace")
        yield row
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path. Where an archive is cut short or a header is no header,
    its records up to there are read and one of type `damaged` says what is wrong, in `fields`; `assemble`
    leaves it out."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("http_length", pa.int64()), ("fields", pa.string()), ("payload", pa.binary())])

    def records(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for row in readable(content.as_py()):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 4 << 20 or len(rows) >= 3000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def readable(data):
        try:
            yield from parse_warc(data)
        except (ValueError, zlib.error) as odd:
            yield dict.fromkeys(schema.names) | {"type": "damaged", "fields": str(odd)}

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with the requests and the metadata that are
    concurrent to it, and what a revisit refers to.

    Rows meet by the record id that concurrent-to names. Records whose partner is missing leave an
    empty list, or are dropped if there is no response; records that share an id are paired in turn.
    """
    is_main = F.col("type").isin("response", "revisit")
    main = F.struct("record_id", "type", "refers_to", "target_uri", "date", "payload_digest", "http_length", "payload")
    side = F.struct("record_id", "target_uri", "date", "fields")
    grouped = records.withColumn("capture", F.when(is_main, F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture is not null").groupBy("capture").agg(
        F.collect_list(F.when(is_main, main)).alias("mains"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", side))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", side))).alias("metadata"),
    )
    captures = grouped.select("capture", F.posexplode("mains").alias("i", "main"), "requests", "metadata")
    pick = lambda c: F.get(F.col(c), F.least(F.col("i"), F.size(c) - 1)).alias(c)
    return captures.select("capture", "main", pick("requests"), pick("metadata")).withColumnRenamed("requests", "request")
