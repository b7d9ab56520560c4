"""Mixing, periodic runs and ranked search against plain definitions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendbook.llm import block_search, mixture, periodic_runs
from lendbook.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


# Periodic runs

def plain_runs(words, least=12):
    """All runs, period after period."""
    words, found = np.array(words), {}
    for period in range(1, len(words) // 2 + 1):
        equal = np.concatenate([[0], words[:-period] == words[period:], [0]]).astype(int)
        turns = np.flatnonzero(np.diff(equal))
        for start, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if end - start + period >= max(least, 2 * period):
                found.setdefault((start, end - start + period), period)
    return sorted((start, length, period) for (start, length), period in found.items())


def words_with_runs(rnd):
    kind = rnd.randrange(4)
    if kind < 2:
        return [rnd.randrange(2 + kind) for _ in range(rnd.randrange(70))]
    if kind == 2:                                       # runs inside runs
        a, b = "a", "b"
        for _ in range(rnd.randrange(2, 9)):
            a, b = (a + b, a) if rnd.random() < 0.7 else (a + a + b, a)
        return [ord(c) for c in a[:150]]
    words = []
    while len(words) < 100:
        block = [rnd.randrange(2) for _ in range(rnd.randrange(1, 9))]
        words += block * rnd.randrange(1, 9)
    return words


@pytest.mark.parametrize("least", [1, 12])
def test_runs_against_all_periods(least):
    rnd = random.Random(least)
    for _ in range(800):
        words = words_with_runs(rnd)
        got = periodic_runs.find_runs(np.array(words, np.int64), least)
        assert list(map(tuple, got.tolist())) == plain_runs(words, least)


def test_a_period_no_neighbouring_occurrence_tells():
    words = [ord(c) for c in "x" + "abababa" * 2 + "y"]
    got = periodic_runs.find_runs(np.array(words, np.int64), 1)
    assert [1, 14, 7] in got.tolist()


def test_runs_do_not_cross_texts_in_a_block():
    text = [b"a", b"b"] * 10
    for block in ([text], [text, text], [[], text, [b"z"], text[1:]]):
        for words, (runs, kept) in zip(block, periodic_runs.of_texts(block)):
            wanted = plain_runs([hash(w) for w in words])
            assert list(map(tuple, runs.tolist())) == wanted
            assert kept == b" ".join(words[:2] if wanted else words)


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_periodic_runs_query(spark, documents):
    got = {row["doc_id"]: row for row in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(documents)
    told = 0
    for doc_id, text in zip(documents.doc_id, documents.text):
        words = looped(doc_id, WORD.findall(text or ""))
        number = {word: i for i, word in enumerate(words)}
        runs = plain_runs([number[w] for w in words])
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        best = min(((-length, s, p) for s, length, p in runs), default=None)
        row = got[doc_id]
        told += bool(runs)
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (
            (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert told > 10


def test_periodic_runs_of_odd_rows(spark, odd):
    rows = periodic_runs.periodic_runs(periodic_runs.with_looped_tails(odd)).collect()
    assert len(rows) == odd.count()
    for row in rows:
        if not row["n_words"]:
            assert (row["runs"], row["collapsed"]) == ([], "")
    tall = [row for row in rows if row["n_words"] == 20_000]
    assert [tuple(run) for run in tall[0]["runs"]][0][1:] == (20_000, 1) or tall[0]["doc_id"]
    assert periodic_runs.periodic_runs(odd.limit(0)).collect() == []
    assert periodic_runs.with_looped_tails(odd).columns == odd.columns


def test_one_long_text_is_one_run():
    (runs, kept), = periodic_runs.of_texts([[b"long"] * 300_000])
    assert (runs.tolist(), kept) == ([[0, 300_000, 1]], b"long")


# Mixing

def plain_targets(sizes, weights, limit=3):
    total, full = float(sum(sizes)), set()
    while True:
        left = total - sum(limit * sizes[i] for i in full)
        rest = sum(w for i, w in enumerate(weights) if i not in full)
        shares = [limit * s if i in full else left * weights[i] / rest if rest else 0.0
                  for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in full and shares[i] > limit * s}
        if not above:
            return shares
        full |= above


def test_targets(spark):
    rnd = random.Random(4)
    for sizes in ([], [0], [0, 0, 0], [5], [1, 1000], [1, 10, 100, 1000, 10_000],
                  [rnd.randrange(1, 1 << rnd.randrange(1, 14)) for _ in range(30)]):
        frame = spark.createDataFrame(
            [(i, s, i % 3 + 1) for i, s in enumerate(sizes)], "i int, size bigint, weight bigint")
        got = [row["target"] for row in mixture.targets(
            frame, sum(sizes)).orderBy("i").collect()]
        assert got == pytest.approx(plain_targets(sizes, [i % 3 + 1 for i in range(len(sizes))]))


def plain_flow(patterns, quotas, turns):
    """(words, cost) of the greatest and then cheapest flow, trying every use of every edge."""
    edges = [(p, s) for p, (_, own) in enumerate(patterns) for s in own]
    best = (0, 0)
    ranges = [range(min(turns * patterns[p][0], quotas[s]) + 1) for p, s in edges]
    for amounts in itertools.product(*ranges):
        given, taken = [0] * len(patterns), [0] * len(quotas)
        for (p, s), amount in zip(edges, amounts):
            given[p] += amount
            taken[s] += amount
        if all(g <= turns * w for g, (w, _) in zip(given, patterns)) and all(
                t <= q for t, q in zip(taken, quotas)):
            best = max(best, (sum(given), -sum(map(price, given, patterns))))
    return best


def price(given, pattern):
    words = pattern[0]
    return sum(turn * max(0, min(words, given - turn * words)) for turn in range(3))


def test_cheapest_flow_against_all_flows():
    rnd = random.Random(9)
    for _ in range(60):
        n_sources = rnd.randrange(1, 4)
        patterns = [(rnd.randrange(1, 4), sorted(rnd.sample(
            range(n_sources), rnd.randrange(1, min(2, n_sources) + 1)))) for _ in range(3)]
        quotas = [rnd.randrange(0, 6) for _ in range(n_sources)]
        flow = mixture.cheapest_flow(patterns, quotas)
        given = [sum(row) for row in flow]
        assert min((x for row in flow for x in row), default=0) >= 0
        for source, quota in enumerate(quotas):
            assert sum(row[own.index(source)] for row, (_, own) in zip(flow, patterns)
                       if source in own) <= quota
        assert (sum(given), -sum(map(price, given, patterns))) == plain_flow(patterns, quotas, 3)


def test_chosen_comes_near():
    rnd = random.Random(2)
    for seed in range(300):
        sizes = np.array(sorted(rnd.sample(range(1, 400), 30), reverse=True))
        counts = np.array([rnd.randrange(1, 4) for _ in sizes])
        wanted = rnd.randrange(int((sizes * counts).sum()) + 1)
        got = mixture.chosen(sizes, counts, wanted, seed)
        assert (got >= 0).all() and (got <= counts).all()
        assert abs(int((got * sizes).sum()) - wanted) <= 8
    none = mixture.chosen(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 1)
    assert len(none) == 0
    assert mixture.chosen(np.array([100]), np.array([1]), 60, 1).tolist() == [1]
    assert mixture.chosen(np.array([100]), np.array([1]), 40, 1).tolist() == [0]


def test_source_mix_query(spark, documents):
    got = QUERIES["op11_source_mix"](spark, SMALL).toPandas()
    again = QUERIES["op11_source_mix"](spark, SMALL).toPandas()
    key = ["doc_id", "taken"]
    assert got.sort_values(key).reset_index(drop=True).equals(
        again.sort_values(key).reset_index(drop=True))
    docs = documents.assign(size=[len(WORD.findall(t or "")) for t in documents.text])
    rows = got.merge(docs[["doc_id", "source", "size"]], on="doc_id", suffixes=("", "_own"))
    assert len(rows) == len(docs) and (rows["size"] == rows["size_own"]).all()
    sizes = docs.groupby("source")["size"].sum().sort_index()
    wanted = plain_targets(sizes.tolist(), [i % 3 + 1 for i in range(len(sizes))])
    for (source, total), target in zip(sizes.items(), wanted):
        own = rows[rows.source == source]
        assert (own.source_size == total).all()
        assert own.target.tolist() == pytest.approx([target] * len(own))
        assert abs(own.taken.sum() - target) <= max(own["size"].min(), 0.01 * target)
    assert (rows.taken <= 3 * rows["size"]).all()
    assert (rows.taken % rows["size"].clip(lower=1) == 0).all()


def test_overlapping_sources_meet_their_quotas(spark):
    rows = [(i, "w " * 10, ["a"] if i < 200 else ["a", "b"] if i < 300 else ["b", None])
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, of array<string>")
    taken, sources = mixture.mix(docs, F.lit(10), F.col("of"))
    told = {row["name"]: (row["size"], row["weight"], row["target"])
            for row in sources.collect()}
    # 4000 words by 1, 2, 3; the null source can give 3000.
    assert told == {"a": (3000, 1, 4000 / 6), "b": (2000, 2, 8000 / 6), None: (1000, 3, 2000.0)}
    by = {row["pattern"]: row["taken"] for row in taken.groupBy("pattern").agg(
        F.sum("taken").alias("taken")).collect()}
    assert abs(sum(by.values()) - 4000) <= 30
    assert by['["b",null]'] >= 2000 - 10           # only this pattern feeds the null source
    assert by['["a"]'] + by['["a","b"]'] >= 4000 / 6 - 20


def test_mix_of_odd_rows(spark, odd):
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    taken, sources = mixture.mix(odd, size, F.array("lang", "source"))
    rows = taken.collect()
    assert len(rows) == odd.count()
    assert all(0 <= row["taken"] <= 3 * row["size"] for row in rows)
    assert None in {row["name"] for row in sources.collect()}
    taken, sources = mixture.mix(odd.limit(0), size, F.array("source"))
    assert (taken.collect(), sources.collect()) == ([], [])
    unplaced, _ = mixture.mix(odd, size, F.lit(None).cast("array<string>"))
    assert {row["taken"] for row in unplaced.collect()} == {0}


def test_mix_with_one_hot_source(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit("x").alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 900))
        .alias("source"), (F.col("id") % 7 + 1).alias("size"))
    taken, sources = mixture.mix(docs, F.col("size"), F.array("source"))
    sums = taken.groupBy(F.col("pattern").alias("source")).agg(F.sum("taken").alias("taken"))
    far = sums.join(sources, "source").where("abs(taken - target) > 7")
    assert (far.collect(), taken.count()) == ([], 30_000)


# Ranked search

def collection(rnd, n_docs, n_terms=60):
    """Postings of documents with skewed terms, some of them copies."""
    docs = []
    for _ in range(n_docs):
        if docs and rnd.random() < 0.2:
            docs.append(dict(rnd.choice(docs)))
        else:
            docs.append({min(int(rnd.expovariate(0.08)), n_terms - 1): rnd.randrange(1, 6)
                         for _ in range(rnd.randrange(1, 25))})
    return docs


def test_blocks_against_scoring_all():
    rnd = random.Random(5)
    skipped = 0
    for trial in range(12):
        docs = collection(rnd, rnd.choice([1, 40, 700]))
        sizes = np.array([sum(d.values()) + rnd.randrange(30) for d in docs])
        holding = [sum(t in d for d in docs) for t in range(60)]
        queries = block_search.Queries(
            [np.array(sorted(rnd.sample(range(60), rnd.randrange(1, 12)))) for _ in range(8)],
            np.array([block_search.weight(len(docs), h) for h in holding]), len(docs),
            int(sizes.sum()))
        ends = np.cumsum([0, *map(len, docs)])
        terms = np.array([t for d in docs for t in d])
        counts = np.array([c for d in docs for c in d.values()])
        impacts = queries.impacts(counts, sizes[np.repeat(np.arange(len(docs)), np.diff(ends))])
        shard = block_search.Shard(queries, ends, terms, impacts, block=8)
        for term, members in shard.members.items():
            assert sorted(members.tolist()) == [i for i, d in enumerate(docs) if term in d]
            assert max(np.diff(shard.starts[term])) <= 8
        scores = np.zeros((len(docs), 8))
        for place, doc in enumerate(docs):
            for (t, _), impact in zip(doc.items(), impacts[ends[place]:ends[place + 1]]):
                for query in queries.of_term[t].tolist():
                    scores[place, query] += impact * int(queries.weights[t])
        ids = np.stack([np.zeros(len(docs)), np.arange(len(docs))[::-1]], axis=1).astype(int)
        for query in range(8):
            best = block_search.Best(5)
            best.ids = ids
            scored = shard.search(query, best)
            skipped += int((scores[:, query] > 0).sum()) - scored
            wanted = sorted((-s, i) for s, i in zip(scores[:, query], ids[:, 1]) if s > 0)[:5]
            assert [(-s, i) for s, i in zip(best.scores, best.kept[:, 1])] == wanted
            for t in queries.terms[query].tolist():
                if t in shard.members:
                    column = np.searchsorted(queries.of_term[t], query)
                    bounds = shard.bounds[t][:, column]
                    for block, (low, high) in enumerate(itertools.pairwise(shard.starts[t])):
                        assert bounds[block] >= scores[shard.members[t][low:high], query].max()
    assert skipped > 500


def plain_search(docs, items, k):
    """(item_id, rank, doc_id, score) with every document scored for every item."""
    pattern = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return pattern.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))

    held = [(doc_id, terms(text)) for doc_id, text in docs if terms(text)]
    all_terms, out = sum(len(t) for _, t in held), []
    sets = [set(t) for _, t in held]
    for item, text in items:
        scores = []
        for (doc_id, own), distinct in zip(held, sets):
            m = 100 - 50 + (50 * len(own) * len(held)) // all_terms
            score = 0
            for term in set(terms(text)) & distinct:
                df, tf = sum(term in s for s in sets), own.count(term)
                w = int(1000 * np.log((2 * len(held) + 2) / (2 * df + 1)))
                score += w * ((10 ** 9 * tf) // (1000 * tf + 20 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(
            scores, key=lambda s: s[:3])[:k])]
    return out


def test_search_of_odd_rows(spark, odd):
    items = spark.createDataFrame(
        [(1, "word LONG text"), (1, "over and over"), (None, "É😀 ß x"), (2, ""), (3, None),
         (4, "nothing of this kind")], "item_id bigint, text string")
    got = sorted(map(tuple, block_search.search(odd, items, k=4).collect()), key=str)
    docs = [(row["doc_id"], row["text"]) for row in odd.collect()]
    # Equal words stand in rows of several ids here; equal scores leave only the ids' order open.
    wanted = plain_search(docs, [tuple(r) for r in items.collect()], 4)
    assert got == sorted(wanted, key=str)
    assert block_search.search(odd.limit(0), items).collect() == []
    assert block_search.search(odd, items.limit(0)).collect() == []


def test_search_does_not_depend_on_groups_or_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    wanted = sorted(map(tuple, block_search.search(docs, items).collect()))
    assert wanted == sorted(map(tuple, block_search.search(
        docs.repartition(5, "doc_id"), items, group_words=400).collect()))


def test_search_among_many_copies(spark):
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("red fox in the snow"))
        .otherwise(F.concat(F.lit("the "), F.col("id"), F.lit(" fox"))).alias("text"))
    items = spark.createDataFrame([(7, "A red fox!")], "item_id bigint, text string")
    got = block_search.search(docs, items).orderBy("rank").collect()
    assert [row["doc_id"] for row in got] == list(range(0, 150, 3))
    assert len({row["score"] for row in got}) == 1
