"""The registered queries of the operators and what SQL can say about them."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendbook.llm import (block_search, bpe, decontaminate, html_text, line_chunks, mixture,
                          near_dedup, periodic_runs, pii, quality, shards, token_counts, warc)
from lendbook.llm.common import cut_lineage, table
from lendbook.llm.sql import SQL  # noqa: F401  (registered with the queries)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file stands; they are installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the maximum-scoring subsequence."""
    return html_text.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and places."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def places(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    base = F.filter("pii", lambda s: s["base"])
    return found.select(
        "doc_id", *[of_kind(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(places(base), 256).alias("base_sha256"),
        places(F.col("pii")).alias("spans"))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document under the current policy."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = quality.Policy("", quality.BASE_RULES)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(base, F.col("fail_bits"))).alias("base_failed"),
        quality.passes(quality.CURRENT, F.col("fail_bits")).alias("kept"),
        "fail_bits")


def op3_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy over the whole table: what each of its rules rejects, and rejects alone."""
    docs = table(spark, sf_dir, "documents")
    return quality.ablations(cut_lineage(quality.ledger(docs).select("doc_id", "fail_bits")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that repeat."""
    return line_chunks.remove_repeated(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, long ones spliced from overlapping chunks."""
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        tokenizer_file("piece_bpe_32k.model")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the evidence."""
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents; counts at most one apart, equal texts together where they fit."""
    return shards.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a page resolved to the response it stands for."""
    captures = warc.captures_from_pages(table(spark, sf_dir, "pages"))
    return warc.resolve(captures).select(
        "capture_id", "url", "canonical_url", "ts", "status", "refers_to",
        warc.header_lines(F.col("headers")).alias("headers"), "payload_digest", "payload_length")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document; its smallest id is kept."""
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the transducer, and what they decode to."""
    import public_tokenizers

    coded = bpe.encode_decode(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("token_ids")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix by source takes; each source is a pattern."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    taken, sources = mixture.mix(
        table(spark, sf_dir, "documents").select("doc_id", "text", "source"), words,
        F.array("source"))
    named = sources.select(F.col("source").alias("pattern"), F.col("size").alias("source_size"),
                           "target")
    return taken.join(named, "pattern").select("doc_id", "size", "source_size", "target", "taken")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, and the text without their repeats."""
    docs = periodic_runs.with_looped_tails(
        table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = periodic_runs.longest(F.col("runs"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", best).withColumn(
        "length", -F.col("best.less"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "length",
        "best.period", F.expr("1000 * length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return block_search.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` one after the other."""
    return _corpus_pipeline().run(spark, sf_dir)


def _corpus_pipeline():
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.insert(0, top)
    return importlib.import_module("corpus_pipeline")


QUERIES = {
    name: query for name, query in sorted(globals().items())
    if name.startswith("op") and name[2].isdigit() or name == "pipeline"
}
