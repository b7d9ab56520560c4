"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch. Coordinates are filled in rounds: in round i every shingle throws a value into one
bin, and values of earlier rounds always win. In the first t rounds the bin is hashed, in the
last t rounds it is bin i - t for all, so after 2 t rounds every one of the t bins is filled. A
document with many shingles is done after a few rounds. Each coordinate agrees with probability
equal to the similarity, and the share that agrees is concentrated around it.

Candidates. Texts with equal words are one class from the start. Classes with an equal band meet
in a bucket. A bucket is not turned into pairs: its members are checked against its smallest
member, the pivot. First each class checks the pivot it shares most bands with; links that hold
are joined into components; then pivots of other components are checked. What is left are members of
buckets that still hold several components. Their pairs are not emitted either: they are joined on
the shingles that a similar pair must share among its rarest ones (see ``crossing``), which is
exact. A pair inside a component is never looked at, since it could not change the result.

Verification. Pairs are checked on full sets of shingles. The pairs of a pivot are cut into
blocks, the texts are dealt to the blocks they take part in, and each block reads the pivot's
text first and then streams over the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendbook.llm.common import cut_lineage

WORDS = 5
PERCENT = 75
COORDINATES = 128
BAND_ROWS = 4                   # 32 bands: a pair at the limit is missed once in 190,000 times
PAIRS_PER_BLOCK = 64

_ROUND_SHIFT, _EMPTY = np.uint64(48), np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case and all else as it is."""
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word windows; shorter sequences count as one window."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - size + 1
    out = hashes[:count].copy()
    for place in range(1, size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[place:place + count]
    return np.unique(mix(out))


_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(hashes: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The ``size`` coordinates of a set that is not empty; ``size`` is a power of two."""
    bins = np.full(size, _EMPTY, np.uint64)
    for turn in range(2 * size):
        thrown = mix(hashes ^ _SEEDS[turn])
        values = np.uint64(turn) << _ROUND_SHIFT | thrown >> np.uint64(16)
        if turn < size:
            np.minimum.at(bins, thrown & np.uint64(size - 1), values)
        else:
            bins[turn - size] = min(bins[turn - size], values.min())
        if not (bins == _EMPTY).any():
            break
    return bins


def band_keys(coordinates: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    table = coordinates.reshape(-1, rows)
    keys = mix(np.arange(1, len(table) + 1, dtype=np.uint64))
    for row in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + table[:, row])
    return keys.view(np.int64)


_SKETCHED = "doc_id bigint, n_shingles bigint, class_key binary, bands array<bigint>"


def sketched(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size of the set, a key equal for equal words, and the band keys; one row per row.

    Documents without words have size zero and neither key nor bands.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hashes = shingles(words)
                sizes.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                bands.append(band_keys(sketch(hashes)) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "class_key", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        rows, _SKETCHED)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b), for ids that have one.

    Alternating stars: every id's greater neighbours are hung on its smallest neighbour, then the
    smaller ones too, until each component is one star. Smallest neighbours are written before
    they are joined back, so that an id with very many links is a skewed join Spark can split.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias(
        "lo")).where("hi <> lo").distinct())
    while not _only_stars(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(
            F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut_lineage(both.where("v > u").join(least, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct())
        least = cut_lineage(large.groupBy("hi").agg(F.min("lo").alias("m")))
        edges = cut_lineage(
            large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct())
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def _only_stars(edges: DataFrame) -> bool:
    """Whether every id hangs on one smaller id, on which nothing but ids hang."""
    ends = edges.select(F.col("hi").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(edges.select("lo", F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return sums.where("hangs > 1 or (hangs > 0 and holds > 0)").isEmpty()


def similar(left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets, as sorted distinct hashes, share enough of their union."""
    if not len(left) or not len(right):
        return False
    if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
        return False
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= percent * (len(left) + len(right) - shared)


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT,
             pairs_per_block: int = PAIRS_PER_BLOCK) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose documents (doc_id, text) are similar.

    A pivot ``a`` with many partners is cut into blocks; its text is read once per block.
    """
    counts = cut_lineage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")))
    blocked = pairs.join(counts, "a").select("a", "b", F.pmod(
        F.xxhash64("b"), F.ceil(F.col("_n") / pairs_per_block)).alias("block"))
    roles = blocked.select(F.col("b").alias("doc_id"), "a", "block", F.lit(1).alias("role")).union(
        counts.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(
            F.lit(0).cast("long"), F.ceil(F.col("_n") / pairs_per_block) - 1)).alias("block"),
            F.lit(0).alias("role")))
    dealt = docs.join(roles, "doc_id").repartition("a", "block").sortWithinPartitions(
        "a", "block", "role").select("a", "block", "role", "doc_id", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = None, []
        for batch in batches:
            linked = []
            columns = [batch.column(i) for i in range(4)]
            for a, block, role, doc, text in zip(*(c.to_pylist() for c in columns),
                                                 batch.column(4)):
                hashes = shingles(words_of(text.as_py()))
                if (a, block) != at:
                    at, pivots = (a, block), []
                if role == 0:
                    pivots.append(hashes)
                elif any(similar(pivot, hashes, percent) for pivot in pivots):
                    linked.append((a, doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in linked], pa.int64()),
                 pa.array([b for _, b in linked], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(check, "a bigint, b bigint")


def groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``.

    Null, empty and wordless texts have no shingles, are linked with nothing and are kept. Rows
    with equal ids are one document whose links are united. A null id is no candidate for the
    smallest id: such a row gets the component of its text, or null, and is not kept unless it
    has no words. Other columns are not read; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).alias("text"))
    rows = cut_lineage(sketched(texts))
    classes = cut_lineage(rows.where("class_key is not null").groupBy("class_key").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    found = linked_classes(classes, texts)
    placed = classes.select("class_key", "rep").join(
        found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "class_key", F.coalesce("component", "rep").alias("_component"))
    component = F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(
        F.col("_component"))
    return rows.drop("bands").join(cut_lineage(placed), "class_key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.when(F.col("class_key").isNull(), F.lit(True)).otherwise(F.coalesce(
            F.col("doc_id") == F.col("_component"), F.lit(False))).alias("kept"))


def linked_classes(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, component) of the class representatives that are linked with another."""
    members = classes.where("rep is not null").select("rep", F.explode("bands").alias("band"))
    buckets = cut_lineage(members.groupBy("band").agg(
        F.min("rep").alias("pivot"), F.max("rep").alias("_most")).where(
        "pivot < _most").drop("_most"))
    met = cut_lineage(members.join(buckets, "band"))
    candidates = cut_lineage(met.where("rep <> pivot").groupBy(
        F.col("pivot").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("shared")))
    first = candidates.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links = cut_lineage(verified(first.select("a", "b"), texts))
    found = components(links)

    def across(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        return pairs.join(known.select(F.col("id").alias("a"), F.col("component").alias("_ca")),
                          "a", "left").join(
            known.select(F.col("id").alias("b"), F.col("component").alias("_cb")),
            "b", "left").where(
            F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")

    tried = first.select("a", "b")
    rest = cut_lineage(across(candidates.select("a", "b").join(tried, ["a", "b"], "left_anti"),
                              found))
    if not rest.isEmpty():
        links = links.union(cut_lineage(verified(rest, texts)))
        found = components(links)

    # Members of buckets that still hold several components.
    labelled = met.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = cut_lineage(labelled)
    open_buckets = cut_lineage(labelled.groupBy("band").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high")).where(
        "_low < _high").select("band"))
    left = cut_lineage(labelled.join(open_buckets, "band").select("rep", "component").distinct())
    if left.isEmpty():
        return found
    untried = cut_lineage(crossing(left, texts).join(
        candidates.select("a", "b"), ["a", "b"], "left_anti"))
    if untried.isEmpty():
        return found
    last = cut_lineage(verified(untried, texts))
    return found if last.isEmpty() else components(links.union(last))


HOT_SHINGLE = 64
SIZE_STEP = 0.95
_SETS = "rep bigint, component bigint, n bigint, set_key binary, tokens array<bigint>"


def crossing(members: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of ``members`` (rep, component) of different components that may be similar.

    Shingles are ordered by how many members have them, the rarest first. Of a similar pair, the
    first shared shingle in that order stands so early in both that enough can follow; so each
    member is met only by its first shingles, and most of what members of one family have in
    common is never joined on. For shingles that many members have, the sizes are dealt into
    narrow classes and a member answers to a class of partners only where the shingle stands
    early enough for partners of that size. No similar pair is lost.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [shingles(words_of(text.as_py())).view(np.int64) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(len, tokens)), pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(t.tobytes()) for t in tokens], pa.binary()),
                 pa.array(tokens, pa.list_(pa.int64()))],
                names=["rep", "component", "n", "set_key", "tokens"])

    own = ["rep", "set_key"]
    long = cut_lineage(texts.join(members, F.col("doc_id") == F.col("rep")).select(
        "rep", "component", "text").mapInArrow(sets, _SETS)).select(
        "rep", "component", "n", "set_key", F.explode("tokens").alias("token"))
    # Shingles of one member only match nothing; they count as the first of their member.
    shared = cut_lineage(long.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    whole = Window.partitionBy(*own)
    placed = long.join(shared, "token").withColumn(
        "place", F.col("n") - F.count(F.lit(1)).over(whole)
        + F.row_number().over(whole.orderBy("df", "token")) - 1)
    first = cut_lineage(placed.where(
        F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100)))

    def pairs(rows: DataFrame, keys: list[str], also: Column) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        able = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
        same = also
        for key in keys:
            same = same & (F.col(f"x.{key}") == F.col(f"y.{key}"))
        return x.join(y, same & (F.col("x.component") < F.col("y.component")) & (
            able * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)).select(
            F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))

    rare = pairs(first.where(F.col("df") <= HOT_SHINGLE), ["token"], F.lit(True))
    step = -math.log(SIZE_STEP)
    reach = math.ceil(math.log(100 / percent) / step + 1e-6)
    own_class = F.floor(F.log("n") / step)
    # The later the place, the smaller the largest partner: no class above its size is listed.
    most_size = (F.col("n") - F.col("place")) * (100 + percent) / percent - F.col("n")
    lowest = F.col("class") - reach
    highest = F.least(F.col("class") + reach, F.greatest(
        lowest, F.floor(F.log((most_size + 1) / 0.999) / step + 1e-6)))
    classed = first.where(F.col("df") > HOT_SHINGLE).withColumn("class", own_class).withColumn(
        "partner", F.explode(F.sequence(lowest, highest)))
    least_size = F.floor(F.exp(F.col("partner") * step) * 0.999)
    answering = cut_lineage(classed.where(
        F.col("place") <= F.col("n") - F.ceil((F.col("n") + least_size) * percent / (
            100 + percent))).select(
        "token", "rep", "component", "n", "place", "class",
        F.least("class", "partner").alias("low"), F.greatest("class", "partner").alias("high")))
    hot = pairs(answering, ["token", "low", "high"], F.col("x.class") + F.col("y.class") == (
        F.col("x.low") + F.col("x.high")))
    return rare.union(hot).distinct()
