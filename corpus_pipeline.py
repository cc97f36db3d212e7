"""Corpus pipeline: quality filter, near-duplicate groups, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result to the
shared folder and rereads it as the next one's docs. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard_join, mixing, quality, suffix_dedup
from graphloom.llm.common import Scratch, load, small_batches
from graphloom.llm.queries import tokenizer_path

#: Words of the shortest passage that the third stage takes out where it repeats.
PASSAGE_WORDS = 51
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # suffix sorting, a trained model and merges have no SQL; tests use brute force


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model predicts 1 for. It learns from labels of rows not held out."""
    small_batches(spark)
    model = quality.train(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("score >= 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingle links connect, the one with the smallest doc_id; of rows that repeat
    that id, one. Documents without words, or without an id, link with nothing and stay."""
    small_batches(spark)
    groups = jaccard_join.jaccard_components(docs).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    alone = docs.where(F.col("doc_id").isNull()).select(*COLUMNS)
    stay = docs.join(groups, F.col("doc_id") == F.col("_kept"), "left_semi").select(*COLUMNS)
    one = Window.partitionBy("doc_id").orderBy("text", "source", "lang")
    return stay.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*COLUMNS).unionByName(alone)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of over 50 words that start anywhere else as well, in this text or
    another: the suffix sorting of op3 over words instead of bytes, since such a passage may take
    any number of bytes from 101 on. n_chars follows the text; a document of which nothing is left stays,
    with what lay before and after its passages; a null text stays null."""
    small_batches(spark)
    found = suffix_dedup.dedup(docs.select(*COLUMNS), words=PASSAGE_WORDS)
    same = F.size("removed") == 0
    text = F.when(same, F.col("text")).otherwise(F.col("kept").cast("string"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its ids and the offsets of its pieces."""
    small_batches(spark)
    return bpe.encode(docs.select("doc_id", "text", "source"), tokenizer_path()).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts")


STAGES = [("quality classifier", quality_filter), ("n-gram Jaccard join", one_of_each_group), ("suffix-array dedup", repeated_passages), ("mixing sources", mix), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), str(k))
    return docs
