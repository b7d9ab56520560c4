"""Ranked lexical search over posting lists blocked by document similarity.

One scan turns every document into its vector: the number of its terms, and the query terms it
holds with their occurrences. From the written vectors come the counts of the collection (documents,
terms, documents per term), and from these the impact of a term in a document.

The index is cut by documents. A shard holds a bounded number of vectors. Each of its posting
lists is clustered: some of its documents stand for a cluster each, every other joins the one it is
most similar to (cosine of sketches by random signs), and clusters are cut into blocks of at
most ``BLOCK_DOCS`` documents. A block stores the coordinatewise maximum of its documents' vectors,
for all terms that a query of this list can hold. The product of a query and that summary bounds
the score of every document of the block. Sums are whole numbers below 2^53, so bounds are exact.

A query reads the blocks of its lists from the greatest bound down, scores whole documents, and
stops at the first bound below its mark: the score that ``k`` documents are known to reach. The
mark starts with the k-th best of a bounded sample of documents, rises with every shard of a
task, and only ever skips what cannot be among the first k. Ties with the mark are scored, since
the smaller id wins. Each task gives its best k, which are ranked in two steps.

Queries are handled in groups of bounded size; each group is one pass over the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendbook.llm.common import cut_lineage

TOP = 50
#: Words of the queries searched at once. It bounds the terms, and with them a shard's matrix.
GROUP_WORDS = 8_000
#: Documents and postings of a shard; a longer document is a shard by itself.
SHARD_DOCS, SHARD_POSTINGS = 2048, 400_000
BLOCK_DOCS = 32
SKETCH = 32
#: Documents that give the first marks. Marks only save work, results do not depend on them.
MARK_DOCS = 4096
#: Parts of each query's candidates that are ranked by themselves first.
PARTS = 64

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32
               for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Stretches of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case."""
    return text.encode().translate(_TERMS).split() if text else []


_VECTORS = "doc_id bigint, n_terms bigint, terms array<int>, counts array<int>"


def vectors(docs: DataFrame, numbers: dict[bytes, int], text_col: str = "text",
            id_col: str = "doc_id") -> DataFrame:
    """Per row its id, its number of terms, and the terms in ``numbers`` with their occurrences."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms_of(text.as_py())
                held = Counter(map(numbers.get, words))
                held.pop(None, None)
                sizes.append(len(words))
                terms += held.keys()
                counts += held.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))],
                names=["doc_id", "n_terms", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        rows, _VECTORS)


def weight(documents: int, holding: int) -> int:
    """What a term weighs that ``holding`` of all ``documents`` hold."""
    return floor(1000 * log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Queries:
    """Queries as lists of term numbers, and what the collection says of the terms."""

    terms: list[np.ndarray]
    weights: np.ndarray
    documents: int
    all_terms: int

    def __post_init__(self) -> None:
        size, held = len(self.weights), [[] for _ in self.weights]
        for query, terms in enumerate(self.terms):
            for term in terms.tolist():
                held[term].append(query)
        #: Per term the queries that hold it, and the terms these hold.
        self.of_term = [np.array(queries, np.int64) for queries in held]
        self.beside = [np.unique(np.concatenate([self.terms[q] for q in queries])) if queries
                       else np.zeros(0, np.int64) for queries in held]
        signs = np.random.default_rng(7).integers(0, 2, (size, SKETCH)) * 2 - 1
        self.signs = signs.astype(np.float32) * self.weights[:, None].astype(np.float32)

    def impacts(self, counts: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
        """What occurrences count in documents of so many terms, without the term's weight."""
        length = 100 - 50 + 50 * n_terms * self.documents // self.all_terms
        return 1_000_000_000 * counts // (1000 * counts + 20 * length)


def clusters(sketches: np.ndarray, block: int = BLOCK_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of blocks): rows in order of cluster, cut at clusters and ``block`` rows."""
    size = len(sketches)
    if size <= block:
        return np.arange(size), np.zeros(1, np.int64)
    heads = sketches[::block]
    cluster = np.argmax(sketches @ heads.T, axis=1)
    order = np.argsort(cluster, kind="stable")
    cluster = cluster[order]
    first = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
    within = np.arange(size) - np.repeat(first, np.diff(np.append(first, size)))
    return order, np.flatnonzero(within % block == 0)


class Shard:
    """Vectors with blocked posting lists.

    ``bounds[t]`` holds for each block of term t (rows) and each query with t (columns) the bound
    by the block's summary; ``members[t]`` its documents, and ``starts[t]`` where blocks begin.
    """

    def __init__(self, queries: Queries, ends: np.ndarray, terms: np.ndarray,
                 impacts: np.ndarray, block: int = BLOCK_DOCS) -> None:
        size, width = len(ends) - 1, len(queries.weights)
        owner = np.repeat(np.arange(size), np.diff(ends))
        self.queries, self.size = queries, size
        self.matrix = np.zeros((size, width), np.float32)     # below 2^24: exact
        self.matrix[owner, terms] = impacts
        sketches = self.matrix @ queries.signs
        sketches /= np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-9)
        order = np.argsort(terms, kind="stable")
        cuts = np.searchsorted(terms[order], np.arange(width + 1))
        self.members: dict[int, np.ndarray] = {}
        self.starts: dict[int, np.ndarray] = {}
        self.bounds: dict[int, np.ndarray] = {}
        for term in np.flatnonzero(np.diff(cuts)).tolist():
            listed = owner[order[cuts[term]:cuts[term + 1]]]
            by_cluster, starts = clusters(sketches[listed], block)
            listed = listed[by_cluster]
            beside = queries.beside[term]
            summary = np.maximum.reduceat(self.matrix[np.ix_(listed, beside)], starts, axis=0)
            weights = np.zeros((len(beside), len(queries.of_term[term])))
            for column, query in enumerate(queries.of_term[term].tolist()):
                own = queries.terms[query]
                weights[np.searchsorted(beside, own), column] = queries.weights[own]
            self.members[term], self.starts[term] = listed, np.append(starts, len(listed))
            self.bounds[term] = summary.astype(np.float64) @ weights

    def search(self, query: int, best: "Best") -> int:
        """Offer all documents to ``best`` that may stand in it; gives how many were scored."""
        terms = [t for t in self.queries.terms[query].tolist() if t in self.members]
        if not terms:
            return 0
        bounds = [self.bounds[t][:, np.searchsorted(self.queries.of_term[t], query)]
                  for t in terms]
        which = np.repeat(np.arange(len(terms)), [len(b) for b in bounds])
        number = np.concatenate([np.arange(len(b)) for b in bounds])
        bounds = np.concatenate(bounds)
        may = np.flatnonzero(bounds >= max(best.mark, 1))
        may = may[np.argsort(-bounds[may], kind="stable")]
        own = self.queries.terms[query]
        weights = self.queries.weights[own].astype(np.float64)
        seen = np.zeros(self.size, bool)
        at, step, scored = 0, 8, 0
        while at < len(may) and bounds[may[at]] >= best.mark:
            fresh = seen.copy()
            for block in may[at:at + step].tolist():
                term, place = terms[which[block]], number[block]
                low, high = self.starts[term][place:place + 2]
                fresh[self.members[term][low:high]] = True
            docs = np.flatnonzero(fresh & ~seen)
            seen, at, step = fresh, at + step, 2 * step
            scored += len(docs)
            best.offer(docs, self.matrix[np.ix_(docs, own)].astype(np.float64) @ weights)
        return scored


class Best:
    """The ``k`` best (score, id) of a query, equal scores by id, null ids last.

    ``ids`` is set to the (is null, id) rows of the shard whose documents are offered.
    """

    def __init__(self, k: int, mark: float = 0) -> None:
        self.k, self.mark = k, mark
        self.scores, self.kept = np.zeros(0), np.zeros((0, 2), np.int64)
        self.ids = self.kept

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero(scores >= max(self.mark, 1))
        if not len(good):
            return
        scores = np.concatenate([self.scores, scores[good]])
        ids = np.concatenate([self.kept, self.ids[docs[good]]])
        order = np.lexsort((ids[:, 1], ids[:, 0], -scores))[:self.k]
        self.scores, self.kept = scores[order], ids[order]
        if len(order) == self.k:
            self.mark = max(self.mark, self.scores[-1])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, n_terms, ends, terms, counts) of bounded numbers of vectors that are not empty."""
    held, postings = [], 0

    def joined() -> tuple[np.ndarray, ...]:
        ids, sizes, lengths, terms, counts = (np.concatenate(part) for part in zip(*held))
        return ids, sizes, np.concatenate([[0], np.cumsum(lengths)]), terms, counts

    def flat(column: pa.ListArray) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            room = SHARD_DOCS - sum(len(part[0]) for part in held)
            part = batch.slice(at, room)
            doc_ids, sizes, terms, counts = part.columns
            lengths = np.diff(terms.offsets.to_numpy())
            fits = int(np.searchsorted(np.cumsum(lengths), SHARD_POSTINGS - postings, "right"))
            fits = fits if held else max(fits, 1)
            part = part.slice(0, fits)
            if part.num_rows:
                doc_ids, sizes, terms, counts = part.columns
                empty = np.asarray(doc_ids.is_null())
                ids = np.stack([empty, doc_ids.fill_null(0).to_numpy(zero_copy_only=False)],
                               axis=1).astype(np.int64)
                held.append((ids, sizes.to_numpy(zero_copy_only=False), lengths[:fits],
                             flat(terms), flat(counts)))
                postings += int(lengths[:fits].sum())
                at += fits
            if fits < len(lengths) or sum(len(p[0]) for p in held) >= SHARD_DOCS:
                yield joined()
                held, postings = [], 0
    if held:
        yield joined()


_FOUND = "query int, doc_id bigint, score bigint"


def candidates(rows: DataFrame, queries: Queries, k: int, marks: dict[int, int]) -> DataFrame:
    """(query, doc_id, score): of every task the ``k`` best, as far as they reach the marks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, marks.get(query, 0)) for query in range(len(queries.terms))]
        for ids, sizes, ends, terms, counts in shards(batches):
            owner = np.repeat(np.arange(len(ids)), np.diff(ends))
            shard = Shard(queries, ends, terms, queries.impacts(counts, sizes[owner]))
            for query, kept in enumerate(best):
                kept.ids = ids
                shard.search(query, kept)
        counted = [len(kept.scores) for kept in best]
        ids = np.concatenate([kept.kept for kept in best])
        scores = np.concatenate([kept.scores for kept in best]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), counted), pa.int32()),
             pa.array(ids[:, 1], pa.int64(), mask=ids[:, 0] > 0), pa.array(scores)],
            names=["query", "doc_id", "score"])

    return rows.mapInArrow(search, _FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank`` from 1 to ``k`` in each query, ranked in parts first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    rank = F.row_number()
    first = parts.withColumn("rank", rank.over(
        Window.partitionBy("query", "_part").orderBy(*order))).where(F.col("rank") <= k)
    return first.drop("_part").withColumn("rank", rank.over(
        Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text_col: str = "text",
           id_col: str = "doc_id", item_col: str = "item_id",
           group_words: int = GROUP_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, scores above 0.

    Every row of ``items`` is a query of its own, also where ids are null or repeat; a query
    without terms finds nothing. Every row of ``docs`` is a document of its own; one without terms
    is found by nothing and counts nowhere. Equal scores go by ascending id, null ids last, and
    rows equal in both take any order. Texts of any length are read whole; other columns are not
    read. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    queries = items.select(F.col(item_col).cast("long").alias("item_id"), "text").where(
        "text is not null")
    words = queries.select(F.sum(F.length("text"))).first()[0] or 0
    n_groups = max(1, -(-words // (6 * group_words)))
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_groups))
    result = None
    for number in range(n_groups):
        # Bounded: queries of some 6 * group_words characters.
        rows = sorted(queries.where(group == number).collect(),
                      key=lambda row: (row["item_id"] is None, row["item_id"] or 0, row["text"]))
        held = [(row["item_id"], set(terms_of(row["text"]))) for row in rows]
        held = [(item, terms) for item, terms in held if terms]
        numbers = {term: place for place, term in enumerate(sorted(set().union(
            *(terms for _, terms in held))))}
        own = cut_lineage(vectors(docs, numbers, text_col, id_col).where("n_terms > 0"))
        total = own.agg(F.count(F.lit(1)).alias("n"), F.sum("n_terms").alias("all")).first()
        if not total["n"] or not held:
            continue
        holding = {row["term"]: row["count"] for row in own.select(
            F.explode("terms").alias("term")).groupBy("term").count().collect()}
        asked = Queries(
            [np.array(sorted(map(numbers.get, terms)), np.int64) for _, terms in held],
            np.array([weight(total["n"], holding.get(t, 0)) for t in range(len(numbers))],
                     np.int64), total["n"], total["all"])
        every = max(1, total["n"] // MARK_DOCS)
        some = own.where(F.pmod(F.xxhash64("doc_id", "n_terms"), F.lit(every)) == 0)
        marks = {row["query"]: row["score"] for row in ranked(candidates(
            some, asked, k, {}), k).where(F.col("rank") == k).collect()}
        names = spark.createDataFrame([(place, item) for place, (item, _) in enumerate(held)],
                                      "query int, item_id bigint")
        found = ranked(candidates(own, asked, k, marks), k).join(F.broadcast(names), "query")
        found = found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        result = found if result is None else result.union(found)
    if result is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return result
