"""Stretches of words that repeat with a period, by a dictionary of basic factors.

The dictionary names, for every power of two m, the factor of m words at every place: equal
factors have equal names. A name of 2 m words is the pair of the names of its halves, so a level is
one sort, and factors that stand only once drop out for all further levels.

A run of smallest period p with m <= p < 2 m repeats its first m words p words later. Per level, the
places of one name are therefore read in order. Places at most m / 2 apart lie in one arithmetic
progression, whose step is the factor's own period; such a progression inside itself tells only
periods of lower levels. Between progressions less than 2 m apart (at most three follow one) the
differences again form a progression of periods, each proposed once, at its first place. Proposals
whose stretch begins earlier are left out, the others are extended to the right over the levels
from long to short, and of equal stretches the one with the smallest period stays.

Documents are read in blocks of ``BLOCK_WORDS`` words, a longer document by itself; words of
different documents never have a name in common. A block takes some 4 bytes a word and level,
that is 4 * log2(words of the longest repeated stretch) bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
BLOCK_WORDS = 100_000

#: Levels of the dictionary: names by place; places that recur, by name and place; their names.
Levels = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def basic_factors(words: np.ndarray) -> Levels:
    """The dictionary of a sequence of numbers, one level for each length 1, 2, 4, ...

    Factors that stand once have a name of their own, beyond those of factors that recur. The
    last level is the last one on which a factor recurs.
    """
    size, length, levels = len(words), 1, []
    alone = np.arange(size, 2 * size, dtype=np.int64 if size > 1 << 30 else np.int32)
    at, keys = np.arange(size), words
    while True:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        differs = np.ones(len(order) + 1, bool)
        differs[1:-1] = ordered[1:] != ordered[:-1]
        recurs = ~(differs[1:] & differs[:-1])
        places = at[order[recurs]]
        if not len(places):
            return levels
        named = np.cumsum(differs[:-1])[recurs] - 1
        names = alone.copy()
        names[places] = named
        levels.append((names, places, named))
        live = np.zeros(size + length, bool)
        live[places] = True
        at = np.flatnonzero(live[:size] & live[length:])
        keys = names[at].astype(np.int64) * size + names[at + length]
        length *= 2


def proposals(places: np.ndarray, named: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first places, periods) between the progressions of one level; see the module's text."""
    near = (named[1:] == named[:-1]) & (2 * (places[1:] - places[:-1]) <= length)
    first = np.flatnonzero(np.concatenate([[True], ~near]))
    last = np.append(first[1:], len(places)) - 1
    more = last - first
    step = np.where(more > 0, places[np.minimum(first + 1, len(places) - 1)] - places[first], 0)
    begin, end, name = places[first], places[last], named[first]
    starts, periods = [], []
    for hop in (1, 2, 3):
        left = np.flatnonzero((name[hop:] == name[:-hop])
                              & (begin[hop:] - end[:-hop] < 2 * length))
        right = left + hop
        least = begin[right] - end[left]
        by = np.maximum(np.maximum(step[left], step[right]), 1)
        low = np.maximum(0, -(-(length - least) // by))
        high = np.minimum(more[left] + more[right], (2 * length - 1 - least) // by)
        counts = np.maximum(0, high - low + 1)
        pair = np.repeat(np.arange(len(left)), counts)
        turn = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts) + low[pair]
        periods.append(least[pair] + by[pair] * turn)
        starts.append(end[left][pair] - by[pair] * np.minimum(turn, more[left][pair]))
    return np.concatenate(starts), np.concatenate(periods)


def common_length(levels: Levels, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words are equal from ``left`` and from ``right`` on; right lies behind left."""
    equal = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        names = levels[level][0]
        there = right + equal
        inside = np.minimum(there, len(names) - 1)
        same = (names[left + equal - (there - inside)] == names[inside]) & (there < len(names))
        equal += same.astype(np.int64) << level
    return equal


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs, by start and then period.

    A run is as long as twice its smallest period and ``min_length`` at least.
    """
    levels = basic_factors(words)
    found = [np.zeros((0, 3), np.int64)]
    for level, (_, places, named) in enumerate(levels):
        starts, periods = proposals(places, named, 1 << level)
        begins = (starts == 0) | (words[starts - 1] != words[starts - 1 + periods])
        starts, periods = starts[begins], periods[begins]
        lengths = periods + common_length(levels, starts, starts + periods)
        whole = lengths >= np.maximum(min_length, 2 * periods)
        found.append(np.stack([starts, lengths, periods], axis=1)[whole])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    other = np.ones(len(runs), bool)
    other[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[other]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated(size: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``size`` words some run contains after its first period."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0


def of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH
             ) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each sequence of words its runs and the words that are kept, joined by spaces."""
    numbers, limits = [], [0]
    for words in texts:
        known: dict[bytes, int] = {}
        base = limits[-1]
        numbers += [known.setdefault(word, base + place) for place, word in enumerate(words)]
        limits.append(base + len(words))
    runs = find_runs(np.array(numbers, np.int64), min_length)
    gone = repeated(len(numbers), runs)
    cuts = np.searchsorted(runs[:, 0], limits)
    for number, words in enumerate(texts):
        base = limits[number]
        own = runs[cuts[number]:cuts[number + 1]] - [base, 0, 0]
        if len(own):
            drop = gone[base:limits[number + 1]].tolist()
            words = [word for word, dropped in zip(words, drop) if not dropped]
        yield own, b" ".join(words)


def blocks(texts: list[list[bytes]], size: int = BLOCK_WORDS) -> Iterator[list[list[bytes]]]:
    """The texts in order, cut into blocks of ``size`` words or one longer text."""
    block, words = [], 0
    for text in texts:
        if block and words + len(text) > size:
            yield block
            block, words = [], 0
        block.append(text)
        words += len(text)
    if block:
        yield block


_RUNS = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
_SCHEMA = ("doc_id bigint, n_words bigint, "
           "runs array<struct<start bigint, length bigint, period bigint>>, collapsed string")


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, the runs (start, length, period) and the text without their repeats.

    One row for each row. Words stand between ASCII white space and are compared byte by byte.
    Null, empty and wordless texts have no runs and collapse to the empty string; texts of any
    length are read whole; null and repeated ids are passed on, other columns are not read. Runs
    are sorted by start and then period.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(text.as_py() or "").encode().split() for text in batch.column(1)]
            done = 0
            for block in blocks(texts):
                found = list(of_texts(block, min_length))
                flat = np.concatenate([runs for runs, _ in found])
                offsets = np.cumsum([0, *[len(runs) for runs, _ in found]])
                struct = pa.StructArray.from_arrays(
                    [pa.array(flat[:, i]) for i in range(3)], fields=list(_RUNS))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(block)),
                     pa.array([len(words) for words in block], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
                     pa.array([kept.decode() for _, kept in found], pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
                done += len(block)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        rows, _SCHEMA)


def with_looped_tails(docs: DataFrame, text_col: str = "text",
                      id_col: str = "doc_id") -> DataFrame:
    """The documents with the tail of every tenth text turned into a loop of its first words.

    With h the checksum of the decimal id, h % 10 = 0 and n words, the words from a = (h / 10) % n
    on repeat the p = 1 + (n - a) / (3 + (h / 10) % 8) words there. Null ids have no checksum;
    their texts, like those without words, stay as they are.
    """
    check = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda word: word != "")
    looped = F.expr(
        "array_join(transform(sequence(0L, _n - 1), i -> element_at(_words, cast(1 + if("
        "i < _g % _n, i, _g % _n + (i - _g % _n) % (1 + (_n - _g % _n) div (3 + _g % 8))) as int))"
        "), ' ')")
    marked = docs.withColumn("_h", check).withColumn("_g", F.expr("_h div 10")).withColumn(
        "_words", F.when(F.col("_h") % 10 == 0, words)).withColumn(
        "_n", F.size("_words").cast("long"))
    return marked.withColumn(text_col, F.when(F.col("_n") > 0, looped).otherwise(
        F.col(text_col))).select(*docs.columns)


def longest(runs: Column) -> Column:
    """The longest run, of equal ones the first, of these that with the smallest period."""
    return F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))


def run_lines(runs: Column) -> Column:
    """Every run as start,length,period and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(
        ",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
