"""The pipeline, stage by stage, against plain definitions on the smallest tables."""

import re

import duckdb
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

import corpus_pipeline
from lendbook.llm import bpe, decontaminate, near_dedup, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        out.append(rows)
        if "text" in rows[0].asDict():
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_quality_keeps_what_no_rule_rejects(stages):
    kept = {r["doc_id"] for r in stages[1]}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    for row in stages[0]:
        m = dict(zip(quality.MEASURES, quality.measure_text(row["text"])))
        bad = (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
               or 10 * m["n_symbols"] > m["n_words"]
               or m["n_lines"] >= 4 and 100 * m["n_dup_lines"] > 50 * m["n_lines"]
               or 100 * m["n_upper_words"] > 30 * m["n_words"]
               or m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 15 * m["n_words"])
        assert (row["doc_id"] in kept) != bad
        if labels.get(row["doc_id"]) == 0:
            assert bad


def test_line_dedup_removes_only_what_stood_before(stages):
    seen = {}
    before = {r["doc_id"]: r["text"] for r in stages[1]}
    for row in sorted(stages[2], key=lambda r: r["doc_id"]):
        assert row["n_chars"] == len(row["text"])
        assert set(row["text"].split("\n")) <= set(before[row["doc_id"]].split("\n"))
        for line in row["text"].split("\n"):
            if len(line) >= 200:
                assert seen.setdefault(line, row["doc_id"]) == row["doc_id"]


def test_near_copies_leave_one(stages):
    sets = {r["doc_id"]: near_dedup.shingles(near_dedup.words_of(r["text"])) for r in stages[2]}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if near_dedup.similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in stages[3]} == {i for i in ids if find(i) == i}


def test_documents_with_benchmark_items_go(stages):
    items = [decontaminate.words_of(t) for t, in
             duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    kept = {r["doc_id"] for r in stages[4]}
    for row in stages[3]:
        text = b" " + b" ".join(decontaminate.words_of(row["text"])) + b" "
        assert (row["doc_id"] in kept) != any(b" " + b" ".join(i) + b" " in text for i in items)


def test_tokens_are_the_librarys(stages):
    library = tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(path("byte_bpe_50k.tiktoken")))
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[5]) == len(texts)
    for row in stages[5]:
        assert row["token_ids"] == library.encode_ordinary(texts[row["doc_id"]])
        assert row["round_trip"] and row["n_tokens"] == len(row["token_ids"])


def test_run_is_its_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, rows)) == sorted((r["doc_id"], r["n_tokens"]) for r in stages[5])


def test_stage_names_follow_the_order():
    assert [re.sub(r"\W+", " ", name) for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near dedup", "benchmark decontamination", "byte level BPE"]


def test_null_and_repeated_ids_take_no_other_row_with_them(spark):
    words = [f"w{i} x{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:59]), " ".join(reversed(words))]
    (item,), = duckdb.sql(f"SELECT min(text) FROM '{SF}/benchmark.parquet'").fetchall()
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def left(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs.repartition(3), SF).collect()),
                      key=str)

    # A group of null ids only, one with a null id, and a row that is like no other.
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2])]
    got = left(corpus_pipeline.near_stage, rows)
    assert len(got) == 2 and (None, texts[2]) in got
    rows = [(7, texts[0]), (None, texts[1]), (None, texts[2]), (7, "another text " * 9)]
    assert left(corpus_pipeline.near_stage, rows) == sorted(
        [rows[0], rows[2], rows[3]], key=str)
    rows = [(None, item), (None, texts[0]), (7, f"so {item}"), (7, texts[2])]
    assert left(corpus_pipeline.benchmark_stage, rows) == sorted([rows[1], rows[3]], key=str)
