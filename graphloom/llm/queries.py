"""The registered queries of this subpackage: thin, over whole tables, each through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard_join, mixing, near_vectors, pieces, quality, sharding, spelling, suffix_dedup, topk, url_filter, warc, whitening
from graphloom.llm.common import Scratch, load, small_batches


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = bpe.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded=True)
    names = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(names, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(load(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = suffix_dedup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = Scratch(spark, "mixing").put(docs.select("doc_id", "source", mixing.words(F.coalesce("text", F.lit(""))).alias("size")), "sized")
    return mixing.mixing_plan(sized, sized=sized).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archive")
    warc.write_warc(load(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_warc(spark, path)).select(
        F.regexp_extract("metadata.fields", r"key: (-?\d+)", 1).try_cast("long").alias("page_id"),
        "capture",
        F.when(F.col("main.type") == "response", F.octet_length("main.payload").cast("long")).otherwise(F.col("main.http_length")).alias("payload_bytes"),
        F.when(F.col("main.type") == "response", F.sha2("main.payload", 256)).otherwise(F.substring_index("main.payload_digest", ":", -1)).alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.col("main.refers_to").alias("refers"),
    )
    stored = captures.where("record_type = 'response'").groupBy(F.col("capture").alias("_at")).agg(F.min("page_id").alias("refers_to"))
    originals = captures.where("record_type = 'response'").select(*[c for c in captures.columns if c not in ("capture", "refers")], F.lit(None).cast("long").alias("refers_to"))
    revisits = captures.where("record_type = 'revisit'").join(stored, F.col("refers") == F.col("_at"), "left").drop("capture", "refers", "_at")
    return originals.unionByName(revisits)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(load(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OLD_SHARDS, NEW_SHARDS = 16, 24


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: an old layout by hash of doc_id is dealt anew. A null text has size 8, null and repeated
    ids are rows like others; the columns read are doc_id and text, so no other one can clash."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    scratch = Scratch(spark, "sharding")
    schema = sharding.lay_out(docs, size, F.pmod(F.xxhash64(F.lit("old"), "doc_id"), F.lit(OLD_SHARDS)), scratch.path("old"))
    placed, _ = sharding.reshard(spark, scratch.path("old"), schema, OLD_SHARDS, NEW_SHARDS, scratch.path("new"))
    return placed.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: eigenvectors are iterated to a certified residual; tests/llm holds them against dense ones."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", whitening.fixed_point("embedding").alias("x")).where("x is not null")
    model = whitening.fit(rows, "x", k=32)
    n, shares = (model.n, [float(e / model.trace) for e in model.values]) if model else (0, [])
    error = whitening.identity_error(rows, "x", model) if shares else None
    white = whitening.transform(rows, "x", model).where("whitened is not null")
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.lit(shares).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


#: Runs of fewer code points cannot become words of five, so they are not looked for.
RUN = r"[A-Za-z\u00C0-\u00FF]{5,}"


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: its functions have no crc32; tests/llm holds it against a brute force. A null doc_id counts as no digits."""
    runs = spelling.runs(load(spark, sf_dir, "documents").select("doc_id", "text"), RUN)
    seed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    words = spelling.counted(runs, spelling.one_less(F.col("run"), seed, 97), least_points=5, least_n=3)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = pieces.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), model_path(), decoded=True)
    names = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(names, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_bpe": op2_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_url_filters": op7_url_filters,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_near_vectors": op10_near_vectors,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_pieces": op13_pieces,
}

OP5_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

#: The whole matrix of products: exact, and quadratic in the rows.
OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op1_topk": OP1_SQL, "op4_mixing": mixing.ORACLE_SQL, "op5_warc": OP5_SQL, "op7_url_filters": url_filter.ORACLE_SQL}
