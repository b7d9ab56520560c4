"""Operators that bring rows together, against brute force and SQL."""

import collections
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lendbook.llm import decontaminate, line_chunks, near_dedup, shards, warc
from lendbook.llm.queries import QUERIES
from lendbook.llm.sql import SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, name):
    base = duckdb.connect()
    for file in os.listdir(SMALL):
        base.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SMALL}/{file}'")
    told = base.execute(SQL[name])
    names = [d[0] for d in told.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(
        told.fetchall(), key=key)


def near_texts(rnd):
    """Chains of edits, exact copies, short texts and unrelated ones."""
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(25):
        text = [rnd.choice(words) for _ in range(rnd.randrange(1, 90))]
        for _ in range(rnd.randrange(1, 9)):
            texts.append(" ".join(text))
            for _ in range(rnd.randrange(0, 3)):
                text = list(text)
                text[rnd.randrange(len(text))] = rnd.choice(words)
    return texts + ["A B", "a b", "a  b\n", "c", None, "", " \t"]


def union_find(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_duplicates_against_all_pairs(spark):
    texts = near_texts(random.Random(11))
    sets = []
    for text in texts:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(links) > 30
    want = union_find(links, range(len(sets)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in near_dedup.groups(rows).collect()}
    for i in range(len(sets)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (
            len(sets[i]), want[i], want[i] == i)


def test_pivots_with_many_partners(spark):
    """Blocks of a pivot; members of one bucket that are not all similar to its pivot."""
    rnd = random.Random(2)
    core = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(300):
        text = list(core)
        for place in rnd.sample(range(100), 2):
            text[place] = f"x{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(text))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near_dedup.shingles(near_dedup.words_of(t)) for t in texts]
    want = union_find([(i, j) for i in range(300) for j in range(i)
                       if near_dedup.similar(sets[i], sets[j])], range(300))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(rows).collect()}
    assert got == want


def test_sketches_estimate_similarity():
    rnd = np.random.default_rng(3)
    for share in (0.5, 0.75, 0.9):
        agree = []
        for _ in range(60):
            both = rnd.integers(0, 2 ** 63, 400).astype(np.uint64)
            cut = int(400 * (1 - share) / 2)
            a, b = near_dedup.sketch(both[:400 - cut]), near_dedup.sketch(both[cut:])
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - (400 - 2 * cut) / 400) < 0.02
    for size in (1, 2, 5):
        bins = near_dedup.sketch(near_dedup.mix(np.arange(1, size + 1, dtype=np.uint64)))
        assert (bins != near_dedup._EMPTY).all()


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500), (700, 700)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r["id"]: r["component"] for r in near_dedup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


def test_repeated_passages_are_found_wherever_they_stand(spark):
    passage = "\n".join(f"shared line {i} of the passage, told again" for i in range(12))
    single = "one very long line of a passage " * 10
    rows = [(1, f"head one\n{passage}\ntail one"), (2, f"other\nlines\nhere\n{passage}\nend two"),
            (3, f"three\n{single}"), (4, f"{single}\nfour"), (5, "three\nfour"), (6, "head one"),
            (7, passage)]
    got = {r["doc_id"]: r for r in line_chunks.remove_repeated(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1]
    assert got[2]["text"] == "other\nlines\nhere\nend two" and got[2]["n_lines_removed"] == 12
    assert got[4]["text"] == "four"
    assert got[5]["text"] == "three\nfour" and got[6]["text"] == "head one"
    assert got[7]["text"] == ""


def test_passages_of_few_lines_go_wholly(spark):
    """Pasted among short lines of two documents, cut by any boundaries; short repeats stay."""
    rnd = random.Random(11)
    line = lambda words: " ".join(str(rnd.randrange(10 ** 6)) for _ in range(words))
    rows, want = [], {}
    for case in range(60):
        n = (2, 3, 4, 6, 12)[case % 5]
        passage = [line(-(-51 // n)) for _ in range(n)]
        hosts = [[line(4) for _ in range(8)] for _ in range(2)]
        at = [rnd.randrange(9) for _ in hosts]
        texts = [host[:i] + passage + host[i:] for host, i in zip(hosts, at)]
        rows += [(2 * case + k, "\n".join(lines)) for k, lines in enumerate(texts)]
        want |= {2 * case: "\n".join(texts[0]), 2 * case + 1: "\n".join(hosts[1])}
    rows += [(1000, "title\nby\nan author of few words"), (1001, "title\nby\nsomebody else")]
    want |= {i: text for i, text in rows if i >= 1000}
    got = line_chunks.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {r["doc_id"]: r["text"] for r in got.collect()}
    wrong = [i for i in want if left[i] != want[i]]
    assert not wrong, [(left[i], want[i]) for i in wrong[:2]]


def test_line_dedup_of_rows_with_null_and_equal_ids(spark):
    """Rows without an id are documents of their own; equal rows are one."""
    passage = "\n".join(f"line {i} that many texts hold" for i in range(30))
    texts = [f"one\n{passage}\nend", f"two\n{passage}\nlast", f"three\n{passage}\nover"]
    for ids in ([None, None, None], [5, 5, 5], [None, 5, 5]):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        got = line_chunks.remove_repeated(docs).collect()
        whole = [row for row in got if not row["n_chunks_removed"]]
        assert len(got) == 3 and len(whole) == 1 and passage in whole[0]["text"]
    alike = spark.createDataFrame([(3, texts[0])] * 3, "doc_id long, text string")
    assert {row["text"] for row in line_chunks.remove_repeated(alike).collect()} == {texts[0]}


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """With a digest that tells nothing, only chunks that are really equal go."""
    blocks = ["\n".join(f"block {b} line {i} of it" for i in range(12)) for b in range(3)]
    docs = spark.createDataFrame(
        [(1, blocks[0]), (2, blocks[1]), (3, blocks[0]), (4, blocks[2])],
        "doc_id long, text string")
    seen = line_chunks.occurrences
    monkeypatch.setattr(line_chunks, "occurrences", lambda rows: seen(rows).withColumn(
        "key", F.unhex(F.lit("00"))))
    got = {row["doc_id"]: row for row in line_chunks.remove_repeated(docs).collect()}
    assert got[1]["text"] == blocks[0] and got[2]["text"] == blocks[1]
    assert got[4]["text"] == blocks[2] and got[3]["n_chunks_removed"] <= 1


def test_line_dedup_has_no_python(spark):
    rows = spark.createDataFrame([(1, "a\nb"), (2, "a\nb")], "doc_id long, text string")
    plan = line_chunks.remove_repeated(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_items_in_documents(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(6, 40))).capitalize() + ". "
              + " ".join(word() for _ in range(4)) + ".") for i in range(60)]
    docs = []
    for i in range(120):
        words = [word() for _ in range(rnd.randrange(10, 400))]
        if i % 3 == 0:
            words.insert(rnd.randrange(len(words)), items[i % 60][1].upper())
        docs.append((i, " ".join(words)))
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), max_group_words=500)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {
        (i, i % 60) for i in range(0, 120, 3)}


def test_wand_finds_what_scoring_all_items_finds():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rnd.choice(words[: rnd.choice([10, 80])]) for _ in range(12)))
             for i in range(70)]
    frequency = collections.Counter(
        w for _, text in items for w in set(decontaminate.words_of(text)))
    index = decontaminate.Index.build(items, frequency, 70, 12.0, share=0.5)
    hits = 0
    for _ in range(400):
        terms = np.array(sorted({index.terms[w.encode()] for w in rnd.sample(words, 14)
                                 if w.encode() in index.terms}))
        every = index.whole(terms)
        want = [i for i, score in enumerate(every) if score >= 1]
        got = decontaminate.block_max_wand(index, terms.tolist())
        assert [i for i, _ in got] == want
        assert np.allclose([score for _, score in got], every[want])
        assert (index.bounds(terms)[np.array(want, int) // decontaminate.BLOCK_ITEMS] >= 1 - 1e-9).all()
        hits += len(want)
    assert hits > 20


def test_quotas_keep_counts():
    rnd = random.Random(1)
    for _ in range(300):
        demand = {(a, b): rnd.randrange(9) for a in range(4) for b in range(4) if a != b}
        free = {a: rnd.randrange(12) for a in range(4)}
        granted, filling = shards.quotas(demand, free, 4)
        assert all(n <= demand[pair] for pair, n in granted.items())
        for a in range(4):
            assert sum(n for (x, _), n in filling.items() if x == a) <= free[a]
            out = sum(n for (x, _), n in [*granted.items(), *filling.items()] if x == a)
            back = sum(n for (_, x), n in [*granted.items(), *filling.items()] if x == a)
            assert out == back


def test_shards_are_even_and_keep_equal_texts(spark):
    rnd = random.Random(6)
    texts = [f"text {rnd.randrange(300)}" for _ in range(1000)] + ["hot"] * 700 + [None, "", "x"] * 9
    texts += [f"alone {i}" for i in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = shards.shard_documents(rows).collect()
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
    sizes = [len(by_shard[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and len(got) == len(texts)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    places = collections.defaultdict(collections.Counter)
    for r in got:
        places[texts[r["doc_id"]]][r["shard"]] += 1
    cut = sum(sum(p.values()) - max(p.values()) for t, p in places.items()
              if t and t.startswith("text"))
    assert cut < 100                 # dealt at random it is above 700
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in shards.shard_documents(rows).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def test_revisits_across_stretches_against_a_scan(spark):
    rnd = random.Random(8)
    captures = []
    for i in range(400):
        full = rnd.random() < 0.3
        tag = rnd.choice(["a", "b", None])
        headers = {"date": str(i)} | ({"etag": ("" if full else rnd.choice(["", "W/"])) + tag}
                                      if tag else {})
        captures.append((i, rnd.choice(["http://www.A.com/x?b=1&a=2", "https://a.com/x?a=2&b=1#f",
                                        "http://a.com/y", None]),
                         full, rnd.randrange(150), headers, rnd.choice(["d", "e", None]), i))
    rows = spark.createDataFrame(
        captures, "capture_id long, url string, is_full boolean, ts long, "
        "headers map<string,string>, digest string, length long")
    got = {r["capture_id"]: r for r in warc.resolve(rows, captures_per_stretch=40).collect()}
    place = lambda url: url and url.rsplit("/", 1)[1][0]
    for c in (c for c in captures if not c[2]):
        earlier = [f for f in captures if f[2] and c[1] and place(f[1]) == place(c[1])
                   and f[3] < c[3]]
        full = max(earlier, key=lambda f: (f[3], f[0]), default=None)
        bare = lambda h: h["etag"].removeprefix("W/")
        if c[1] is None:
            want = "no_url"
        elif full is None:
            want = "no_earlier_response"
        elif "etag" in c[4] and "etag" in full[4]:
            want = "resolved" if bare(c[4]) == bare(full[4]) else "validator_mismatch"
        elif c[5] and full[5]:
            want = "resolved" if c[5] == full[5] else "validator_mismatch"
        else:
            want = "no_validator"
        assert got[c[0]]["status"] == want
        assert got[c[0]]["refers_to"] == (full[0] if want == "resolved" else None)
        if want == "resolved":
            assert got[c[0]]["headers"] == full[4] | c[4]


def test_payload_of_a_resolved_revisit(spark):
    resolved = spark.createDataFrame([(1, 0), (3, None)], "capture_id long, refers_to long")
    bodies = spark.createDataFrame([(0, "body")], "capture_id long, html string")
    got = {r["capture_id"]: r["payload"] for r in warc.with_payload(resolved, bodies).collect()}
    assert got == {1: "body", 3: None}


def test_positions_are_gapless(spark):
    from lendbook.llm.common import positions
    rows = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, 1).otherwise(2))
    got = positions(rows, F.col("id"), ["g"], rows_per_bin=300).collect()
    for g in (1, 2):
        at = sorted(r["position"] for r in got if r["g"] == g)
        assert at == list(range(len(at)))
