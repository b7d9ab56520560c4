"""A training corpus in five stages: quality, passages, near copies, benchmarks, tokens.

Every stage is a function of (session, documents, table directory). All but the last give back
documents with the same columns, so stages can be left out, repeated or put in another order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendbook.llm import bpe, decontaminate, line_chunks, near_dedup, quality
from lendbook.llm.common import DOCUMENT_COLUMNS, bound_batches, cut_lineage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects. Null texts have no words and go."""
    bound_batches(spark)
    measured = docs.select(*DOCUMENT_COLUMNS, quality.measures(F.col("text")).alias("_m"))
    bits = measured.select(*DOCUMENT_COLUMNS, "_m.*").withColumn("_bits", quality.fail_bits())
    return bits.where(quality.passes(quality.CURRENT, F.col("_bits"))).select(*DOCUMENT_COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one of which no word is left goes."""
    return line_chunks.rewrite(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn(
        "n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``_row``, a number of each row's own whatever its id; written once."""
    return cut_lineage(docs.select(*DOCUMENT_COLUMNS).withColumn(
        "_row", F.monotonically_increasing_id()))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of ``rows`` whose ``_row`` is not in ``gone``."""
    return rows.join(cut_lineage(gone), "_row", "left_anti").select(*DOCUMENT_COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Every row is a document of its own: null and repeated ids take no other row with them. A null
    id comes after all others.
    """
    bound_batches(spark)
    rows = numbered(docs)
    found = near_dedup.groups(rows, id_col="_row").select(
        F.col("doc_id").alias("_row"), "component_id")
    placed = cut_lineage(found.join(rows.select("_row", "doc_id"), "_row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    stays = placed.groupBy("component_id").agg(first.alias("first")).select("first._row")
    return without(rows, placed.select("_row").join(stays, "_row", "left_anti"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text."""
    rows = numbered(docs)
    found = decontaminate.contaminated(
        rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    return without(rows, found.select(F.col("doc_id").alias("_row")).distinct())


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of every document, their number, and whether they decode to it."""
    bound_batches(spark)
    coded = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path(
        "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: Sketches, retrieval and encoding are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
