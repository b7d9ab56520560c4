"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, everywhere."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lendbook.llm import (bpe, decontaminate, html_text, line_chunks, near_dedup, pii, quality,
                          shards, token_counts, warc)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

OPERATORS = {
    "html": lambda df: html_text.extract(df.withColumn("page_id", F.col("doc_id")), html_col="text",
                                         into="main"),
    "pii": pii.detect,
    "quality": quality.ledger,
    "lines": line_chunks.remove_repeated,
    "tokens": lambda df: token_counts.count_tokens(df, PIECES),
    "shards": shards.shard_documents,
    "near": near_dedup.groups,
    "bpe": lambda df: bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, name):
    assert len(OPERATORS[name](odd).collect()) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_results_for_texts_without_content(odd):
    blank = odd.where("text is null or text = ''").select("doc_id", "text")
    for row in pii.detect(blank).collect():
        assert row["pii"] == []
    for row in quality.ledger(blank).collect():
        assert row["n_words"] == 0 and row["fail_bits"] == 1
    for row in token_counts.count_tokens(blank, PIECES).collect():
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (0, 0, False)
    for row in near_dedup.groups(blank).collect():
        assert (row["n_shingles"], row["kept"]) == (0, True)
    for row in bpe.encode_decode(blank, RANKS, public_tokenizers.PATTERN).collect():
        assert (row["token_ids"], row["decoded"]) == ([], "")
    for row in shards.shard_documents(blank).collect():
        assert (row["size"], row["text_crc32"]) == (1, 0)


def test_null_texts_stay_null_in_line_dedup(odd):
    found = {row["text"] is None for row in line_chunks.remove_repeated(odd).where(
        "n_lines = 0").collect()}
    assert found == {True}


def test_decontamination_of_odd_rows(spark, odd):
    items = odd.select(F.monotonically_increasing_id().alias("item_id"), "text", "key")
    found = decontaminate.contaminated(odd, items)
    assert found.where("doc_id = 16").count() > 0
    assert decontaminate.contaminated(odd.limit(0), items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, items.where("text is null")).count() == 0


def test_revisits_of_odd_rows(spark, odd):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"),
                       F.col("text").alias("html"), "key", "kept")
    rows = warc.resolve(warc.captures_from_pages(pages)).collect()
    assert len(rows) == pages.count()
    assert {r["status"] for r in rows if r["url"] is None} == {"no_url"}
    assert warc.resolve(warc.captures_from_pages(pages.limit(0))).collect() == []


def test_stages_keep_the_columns_of_documents(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (odd, odd.limit(0)):
            out = stage(spark, rows, "/root/testdata/sf0.001")
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() == odd.count()
