"""Benchmark items found in training text by BM25 over an inverted index with block-max WAND.

The index is over test items: postings of term and item with the term's BM25 share, sorted by
item, in blocks with their greatest share. Every passage of every document is a query. An item is
retrieved when the passage scores at least ``SHARE`` of what the item's own text scores, so all
shares are divided by that mark and the threshold is 1 for every item. Retrieved pairs are then
verified: runs of words of the item's question and of its answer must stand in the passage.

Scores of a whole document bound those of its passages. A document whose block bounds stay below
1 holds no passage that could be retrieved; only the others are read passage by passage.

Items are indexed in groups whose postings are held to a size limit. Each group is one pass over
the documents, so a benchmark of any size is searched without an unbounded broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
SHARE = 0.6
BLOCK_ITEMS = 4
#: Words of an item text whose index is sent to the executors at once: about 100 MB.
MAX_GROUP_WORDS = 2_000_000
#: Runs of words that are compared, and the part of them that must be found.
RUN = 5
MIN_QUESTION, MIN_ANSWER = 0.5, 0.5
_PUNCTUATION = re.compile("[\u2000-\u206f\u3000-\u303f]+")
_TO_SPACE = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, between white space and punctuation, as UTF-8."""
    if not text:
        return []
    data = text.lower().encode()
    if b"\xe2\x80" in data or b"\xe2\x81" in data or b"\xe3\x80" in data:
        data = _PUNCTUATION.sub(" ", data.decode()).encode()
    return data.translate(_TO_SPACE).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and of its answer.

    The answer is the last sentence or line. An item of one sentence is its own question; its
    last third is what must be found as the answer.
    """
    parts = [words for words in map(words_of, _SENTENCE.split(text)) if words]
    if not parts:
        return [], []
    if len(parts) == 1:
        return parts[0], parts[0][-max(1, len(parts[0]) // 3):]
    return [word for part in parts[:-1] for word in part], parts[-1]


def runs(words: list[bytes], size: int = RUN) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``size`` words; a shorter sequence is one run."""
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """The share of the part's runs that stand in the passage; 1 for an empty part."""
    wanted = runs(part)
    if not wanted:
        return 1.0
    size = len(next(iter(wanted)))
    return len(wanted & {tuple(passage[i:i + size])
                         for i in range(len(passage) - size + 1)}) / len(wanted)


@dataclass
class Index:
    """Postings of one group of items; see the module's text.

    ``starts`` cuts ``items`` and ``shares`` by term; ``block_starts`` cuts ``blocks`` and
    ``block_shares`` in the same way. Items are numbered by their order of id.
    """

    terms: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    shares: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_shares: np.ndarray
    ids: list[int]
    questions: list[list[bytes]]
    answers: list[list[bytes]]
    longest: int

    @staticmethod
    def build(items: list[tuple[int, str]], document_frequency: dict[bytes, int], n_items: int,
              mean_words: float, share: float = SHARE) -> "Index":
        ids, texts = [i for i, _ in items], [words_of(text) for _, text in items]
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for number, words in enumerate(texts):
            scores = {}
            for word in set(words):
                tf, df = words.count(word), document_frequency[word]
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
                scores[word] = weight * float(np.log(1 + (n_items - df + 0.5) / (df + 0.5)))
            mark = share * sum(scores.values())
            for word, score in scores.items():
                postings.setdefault(word, []).append((number, score / mark))
        starts, block_starts = [0], [0]
        flat_items, flat_shares, flat_blocks, flat_block_shares = [], [], [], []
        for posting in postings.values():
            best: dict[int, float] = {}
            for number, score in posting:
                flat_items.append(number)
                flat_shares.append(score)
                block = number // BLOCK_ITEMS
                best[block] = max(best.get(block, 0.0), score)
            flat_blocks += best.keys()
            flat_block_shares += best.values()
            starts.append(len(flat_items))
            block_starts.append(len(flat_blocks))
        parts = [question_and_answer(text) for _, text in items]
        return Index(
            {word: number for number, word in enumerate(postings)}, np.array(starts),
            np.array(flat_items, np.int64), np.array(flat_shares), np.array(block_starts),
            np.array(flat_blocks, np.int64), np.array(flat_block_shares), ids,
            [q for q, _ in parts], [a for _, a in parts], max(map(len, texts), default=0))

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """Per block, a bound of what any passage with only these distinct terms can score."""
        return _sums(terms, self.block_starts, self.blocks, self.block_shares,
                     -(-len(self.ids) // BLOCK_ITEMS))

    def whole(self, terms: np.ndarray) -> np.ndarray:
        """Per item, the score of a text with these distinct terms."""
        return _sums(terms, self.starts, self.items, self.shares, len(self.ids))


def _sums(terms: np.ndarray, starts: np.ndarray, at: np.ndarray, values: np.ndarray,
          size: int) -> np.ndarray:
    low, lengths = starts[terms], starts[terms + 1] - starts[terms]
    ends = np.cumsum(lengths)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + lengths, lengths)
    return np.bincount(at[places], values[places], size)


def block_max_wand(index: Index, terms: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
    """All items that score at least ``threshold`` for the distinct terms, in order of item.

    Cursors stand on the terms' postings. The pivot is the first item at which the greatest
    shares of the cursors up to it can reach the threshold. The blocks the pivot lies in may say
    that it cannot; then all of these cursors skip to the end of the nearest block. Otherwise
    the pivot is scored once every cursor before it has caught up.
    """
    starts, items, shares = index.starts, index.items, index.shares
    cursors = []
    for term in terms:
        low, high = int(starts[term]), int(starts[term + 1])
        if low < high:
            first, last = int(index.block_starts[term]), int(index.block_starts[term + 1])
            best = dict(zip(index.blocks[first:last].tolist(),
                            index.block_shares[first:last].tolist()))
            cursors.append([int(items[low]), low, high, max(best.values()), best])
    found = []

    def move(cursor: list, item: int) -> None:
        """To the first posting of an item not before ``item``."""
        cursor[1] += int(np.searchsorted(items[cursor[1]:cursor[2]], item))
        cursor[0] = int(items[cursor[1]]) if cursor[1] < cursor[2] else 1 << 60

    slack = 1e-9            # sums in another order must not lose an item on the mark
    while True:
        cursors = sorted((c for c in cursors if c[0] < 1 << 60), key=lambda c: c[0])
        bound, place = 0.0, -1
        for number, cursor in enumerate(cursors):
            bound += cursor[3]
            if bound >= threshold - slack:
                place = number
                break
        if place < 0:
            return found
        pivot = cursors[place][0]
        while place + 1 < len(cursors) and cursors[place + 1][0] == pivot:
            place += 1
        ahead = cursors[:place + 1]
        block = pivot // BLOCK_ITEMS
        if sum(c[4].get(block, 0.0) for c in ahead) < threshold - slack:
            limit = (block + 1) * BLOCK_ITEMS
            if place + 1 < len(cursors):
                limit = min(limit, cursors[place + 1][0])
            for cursor in ahead:
                move(cursor, max(limit, pivot + 1))
        elif cursors[0][0] == pivot:
            score = sum(float(shares[c[1]]) for c in ahead)
            if score >= threshold - slack:
                found.append((pivot, score))
            for cursor in ahead:
                move(cursor, pivot + 1)
        else:
            for cursor in ahead:
                if cursor[0] < pivot:
                    move(cursor, pivot)


def search(index: Index, text: str | None) -> list[tuple[int, float, int, float, float]]:
    """Items verified in a text: (item id, score, first word of the passage, question, answer).

    Passages are twice as long as the longest item and start every half passage, so each item
    lies whole in one of them. Of several passages that hold an item the best is told.
    """
    words = words_of(text)
    if not words or not index.ids:
        return []
    numbers = np.array(list(map(index.terms.get, words, repeat(-1))), np.int64)
    terms = np.unique(numbers[numbers >= 0])
    if not len(terms) or index.bounds(terms).max() < 1 - 1e-9:
        return []
    if index.whole(terms).max() < 1 - 1e-9:
        return []
    half = max(1, index.longest)
    best: dict[int, tuple[float, int, float, float]] = {}
    for begin in range(0, max(1, len(words) - half), half):
        part = numbers[begin:begin + 2 * half]
        part = np.unique(part[part >= 0])
        if not len(part) or index.bounds(part).max() < 1 - 1e-9:
            continue
        for item, score in block_max_wand(index, part.tolist()):
            passage = words[begin:begin + 2 * half]
            told = (score, begin, overlap(index.questions[item], passage),
                    overlap(index.answers[item], passage))
            if told[2] >= MIN_QUESTION and told[3] >= MIN_ANSWER and (
                    item not in best or (told[2] + told[3], told[0]) > (
                        best[item][2] + best[item][3], best[item][0])):
                best[item] = told
    return [(index.ids[item], *told) for item, told in sorted(best.items())]


_FOUND = ("doc_id bigint, item_id bigint, score double, first_word bigint, "
          "question_overlap double, answer_overlap double")


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                 id_col: str = "doc_id", max_group_words: int = MAX_GROUP_WORDS) -> DataFrame:
    """(doc_id, item_id) of items verified in documents, with score, place and overlaps.

    Null and wordless documents and items match nothing; repeated documents are told as often as
    they occur; items with equal ids are indexed each by its own text. A null id stays null.
    Other columns are not read. An empty table on either side gives an empty result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "text is not null")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                if words := words_of(text.as_py()):
                    rows += [(word.decode(), 0) for word in set(words)] + [("", len(words))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in rows], pa.string()),
                 pa.array([n for _, n in rows], pa.int64())], names=["word", "size"])

    frequency = items.select("text").mapInArrow(terms, "word string, size bigint").groupBy(
        "word").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    total = frequency.where("word = ''").first()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).alias("text"))
    if total is None:
        return texts.select("doc_id").limit(0).mapInArrow(lambda batches: batches, _FOUND)
    n_groups = -(-total["size"] // max_group_words)
    grouped = items.withColumn("_group", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_groups)))
    result = None
    for group in range(n_groups):
        own = grouped.where(F.col("_group") == group)
        # Bounded by ``max_group_words``, as are the words that occur in these items.
        rows = sorted(((row["item_id"], row["text"]) for row in own.collect()),
                      key=lambda row: (row[0] is None, row[0] or 0, row[1]))
        words = docs.sparkSession.createDataFrame(
            [(word.decode(),) for word in {w for _, text in rows for w in words_of(text)}] or
            [("",)], "word string")
        known = {row["word"].encode(): row["n"] for row in frequency.join(words, "word").collect()}
        rows = [row for row in rows if words_of(row[1])]
        index = docs.sparkSession.sparkContext.broadcast(Index.build(
            rows, known, total["n"], total["size"] / total["n"]))

        def found(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(),
                                                         batch.column(1))
                        for hit in search(index.value, text.as_py())]
                columns = list(zip(*hits)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(),
                         pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "item_id", "score", "first_word", "question_overlap",
                           "answer_overlap"])

        part = texts.mapInArrow(found, _FOUND)
        result = part if result is None else result.union(part)
    return result
