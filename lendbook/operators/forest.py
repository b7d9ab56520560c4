"""Random forests over any number of rows, without a bound on their nodes.

Rows are packed once into chunks of bin numbers, at most 32 bins a column. While a node holds more
than ``ROWS_PER_NODE`` rows, all tasks count their rows of it, and its best cut is found from the
sums: one pass over the chunks for each level of large nodes. Then every node's rows are dealt to a
task that grows all below it in numpy. If all rows are no more than ``ROWS_WHOLE``, a task is given
them once and grows several trees. So what a task holds is bounded, and no process holds the
forest: trees stay in a table, one row for each part that a task grew, and scoring pairs parts with
chunks of rows and adds up.

Trees are those of Spark's random forest: rows drawn by Poisson numbers, ``mtry`` columns tried at
each node, the best cut by Gini impurity that leaves ``least`` rows on both sides.
"""

from __future__ import annotations

import json
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendbook.session import work_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
#: Rows of a chunk.
ROWS_AT_ONCE = 65_536
#: Drawn rows of a node, up to which one task grows all below it.
ROWS_PER_NODE = 1_000_000
#: Rows up to which a task is given all of them, a byte for each column.
ROWS_WHOLE = 2_500_000
MAX_PARTITIONS = 4000
#: Trees whose rows are dealt at a time; it bounds what a task writes for a chunk.
TREES_AT_ONCE = 100
#: Tasks for each core that trees without large nodes are dealt to; each is given all rows.
TREE_TASKS = 4
#: Shares are added as whole numbers of 2 ** -40, so that sums do not depend on their order.
UNIT = 2.0 ** 40

_PART = ("tree int, region int, feature array<int>, cut array<int>, left array<int>, "
         "share array<double>, importance array<double>")


@dataclass
class Top:
    """The nodes of a tree that were too large for one task; leaves have feature -1 and are the
    regions that parts were grown for."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    depth: list[int]


def quantile_cuts(rows: DataFrame, column: str, width: int) -> list[np.ndarray]:
    """Up to 31 cuts for each entry of an array column; a value above a cut lies right of it."""
    names = [f"c{place}" for place in range(width)]
    wide = rows.select(*[F.get(column, F.lit(i)).alias(name) for i, name in enumerate(names)])
    shares = [step / (BINS - 1) for step in range(BINS)]
    found = wide.approxQuantile(names, shares, 0.002) if names else []
    return [np.unique(values)[:-1] for values in found]


def codes_of(features: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value, a row per column; what is missing lies right of all."""
    return np.stack([np.searchsorted(own, column).astype(np.uint8)
                     for own, column in zip(cuts, features.T)])


def packed(rows: DataFrame, features: str, cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """(chunk, n, codes, kept): rows by the chunk, ``kept`` being the columns to keep, as Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, []

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.num_rows
            values = np.asarray(table[features].combine_chunks().flatten()).reshape(n, -1)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select(keep).schema) as stream:
                stream.write_table(table.select(keep))
            return pa.RecordBatch.from_pydict({
                "chunk": [f"{task}-{number}"], "n": pa.array([n], pa.int32()),
                "codes": [codes_of(values, cuts).tobytes()],
                "kept": [sink.getvalue().to_pybytes()]})

        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                held.append(batch.slice(first, ROWS_AT_ONCE))
                if sum(part.num_rows for part in held) >= ROWS_AT_ONCE:
                    yield chunk()
                    held, number = [], number + 1
        if sum(part.num_rows for part in held):
            yield chunk()

    return _written(rows.select(*dict.fromkeys(keep), features).mapInArrow(
        run, "chunk string, n int, codes binary, kept binary"))


def drawn(seed: int, tree: int, chunk: str, n: int) -> np.ndarray:
    """How often each row of a chunk is drawn for a tree."""
    rng = np.random.default_rng([seed, tree, zlib.crc32(chunk.encode())])
    return np.minimum(rng.poisson(1.0, n), 255).astype(np.uint8)


def by_rows(codes: np.ndarray) -> np.ndarray:
    """The same codes, those of a row lying together, as ``walk`` reads them."""
    return np.ascontiguousarray(codes.T).T


def walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, codes: np.ndarray,
         own: np.ndarray | None = None) -> np.ndarray:
    """The leaf of every row, or of the rows ``own``.

    Rows at a leaf stay there, so rows on their way are told apart every fourth level only.
    """
    width, rows = codes.shape
    going = np.arange(rows) if own is None else own
    node, ends = np.zeros(len(going), np.int64), feature < 0
    flat = np.ascontiguousarray(codes.T).ravel()
    place, going = going * width, np.arange(len(going) if not ends[0] else 0)
    feature, cut, left = (np.where(ends, still, told).astype(np.int64) for still, told in (
        (0, feature), (255, cut), (np.arange(len(left)), left)))
    at = node
    while len(going):
        for _ in range(4):
            at = left.take(at) + (flat.take(place + feature.take(at)) > cut.take(at))
        node[going] = at
        further = np.flatnonzero(~ends.take(at))
        going, place, at = going.take(further), place.take(further), at.take(further)
    return node


def plain_tops(tops: dict[int, Top]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Large nodes as arrays that ``walk`` takes; workers need no class of this module for them."""
    return {tree: (np.array(top.feature), np.array(top.cut), np.array(top.left))
            for tree, top in tops.items()}


def tried_columns(rng: np.random.Generator, nodes: int, width: int, mtry: int) -> np.ndarray:
    return np.argpartition(rng.random((nodes, width)), mtry - 1, axis=1)[:, :mtry]


def best_bins(n: np.ndarray, good: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the last bin on the left of its best cut, and the gain; -inf without a cut.

    ``n`` and ``good`` are rows and defaults per node and bin. The gain is the fall of impurity
    times the node's rows.
    """
    left, low = np.cumsum(n, axis=1), np.cumsum(good, axis=1)
    total, all_good = left[:, -1:], low[:, -1:]
    left, low = left[:, :-1], low[:, :-1]
    right, high = total - left, all_good - low
    with np.errstate(divide="ignore", invalid="ignore"):
        score = ((low ** 2 + (left - low) ** 2) / left
                 + (high ** 2 + (right - high) ** 2) / right)
        before = (all_good ** 2 + (total - all_good) ** 2) / total
    score[(left < least) | (right < least)] = -np.inf
    place = np.argmax(score, axis=1)
    return place, score[np.arange(len(place)), place] - before[:, 0]


def grow(codes: np.ndarray, labels: np.ndarray, weights: np.ndarray, mtry: int, least: int,
         max_depth: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The tree of some rows, level by level: place 0 is its root, leaves have feature -1."""
    width = len(codes)
    mtry, importance = min(mtry, width), np.zeros(width)
    flat = np.ascontiguousarray(codes.T).ravel()        # a row's codes lie together
    node, place = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1]) * width
    weight, label = weights.astype(np.float64), labels.astype(np.int64)
    levels, nodes, below, depth = [], 1, 1, 0
    while nodes:
        fine, good = np.bincount(label * nodes + node, weight, 2 * nodes).reshape(2, -1)
        total = fine + good
        feature, cut, left = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes, int)
        open_ = np.flatnonzero((total >= 2 * least) & (good > 0) & (good < total)
                               & (depth < max_depth))
        number = np.full(nodes, -1)
        number[open_] = np.arange(len(open_))
        node = number.take(node)
        held = np.flatnonzero(node >= 0)
        node, place, weight, label = (own.take(held) for own in (node, place, weight, label))
        gain, found = np.full(len(open_), 1e-9), np.full(len(open_), -1)
        bins = np.zeros(len(open_), int)
        first = (label * len(open_) + node) * BINS
        for column in tried_columns(rng, len(open_), width, mtry).T if len(open_) else ():
            key = first + flat.take(place + column.take(node))
            fine, good_ = np.bincount(key, weight, 2 * len(open_) * BINS).reshape(2, -1, BINS)
            at, own = best_bins(fine + good_, good_, least)
            better = own > gain
            gain[better], found[better], bins[better] = own[better], column[better], at[better]
        split = np.flatnonzero(found >= 0)
        feature[open_[split]], cut[open_[split]] = found[split], bins[split]
        left[open_[split]] = below + 2 * np.arange(len(split))
        importance += np.bincount(found[split], gain[split], width)
        levels.append((feature, cut, left, good / np.maximum(total, 1)))
        child = np.full(len(open_), -1)
        child[split] = 2 * np.arange(len(split))
        held = np.flatnonzero(child.take(node) >= 0)
        node, place, weight, label = (own.take(held) for own in (node, place, weight, label))
        node = child.take(node) + (flat.take(place + found.take(node)) > bins.take(node))
        nodes = 2 * len(split)
        below += nodes
        depth += 1
    feature, cut, left, share = (np.concatenate(part) for part in zip(*levels))
    return {"feature": feature, "cut": cut, "left": left, "share": share,
            "importance": importance}


def large_nodes(chunks: DataFrame, rows: int, width: int, trees: int, mtry: int, least: int,
                max_depth: int, seed: int, rows_per_node: int
                ) -> tuple[dict[int, Top], list[tuple]]:
    """The nodes of all trees above ``rows_per_node`` rows, and parts (without rows of their own)
    for those that cannot be cut. A pass over the chunks for each level."""
    tops = {tree: Top([-1], [0], [0], [0]) for tree in range(trees)}
    done: list[tuple] = []
    importance = np.zeros((trees, width))
    open_ = {tree: [0] for tree in tops} if rows > rows_per_node else {}
    mtry = min(mtry, width)
    while open_:
        shared = chunks.sparkSession.sparkContext.broadcast((plain_tops(tops), open_))

        def columns(tree: int, node: int) -> np.ndarray:
            return tried_columns(np.random.default_rng([seed, tree, node]), 1, width, mtry)[0]

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tops, open_ = shared.value
            sums: dict[tuple[int, int], np.ndarray] = {}
            for frame in frames:
                for chunk, n, codes, labels in frame.itertuples(index=False):
                    codes = by_rows(np.frombuffer(codes, np.uint8).reshape(width, n))
                    labels = np.frombuffer(labels, np.uint8)
                    for tree, nodes in open_.items():
                        weights, at = drawn(seed, tree, chunk, n), walk(*tops[tree], codes)
                        for node in nodes:
                            own = np.flatnonzero((at == node) & (weights > 0))
                            weight = weights[own].astype(np.float64)
                            bad = weight * labels[own]
                            told = sums.setdefault((tree, node), np.zeros((mtry, 2, BINS)))
                            for place, column in enumerate(columns(tree, node)):
                                code = codes[column, own]
                                told[place, 0] += np.bincount(code, weight, BINS)
                                told[place, 1] += np.bincount(code, bad, BINS)
            for (tree, node), told in sums.items():
                yield pd.DataFrame({"tree": [tree], "node": [node], "told": [told.tobytes()]})

        def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            told = sum(np.frombuffer(part) for part in frame["told"]).reshape(mtry, 2, BINS)
            place, gain = best_bins(told[:, 0], told[:, 1], least)
            best = int(np.argmax(gain))
            left = told[best, 0, :place[best] + 1].sum()
            total, good = told[0].sum(axis=1)
            return pd.DataFrame({
                "tree": [key[0]], "node": [key[1]], "feature": [columns(*key)[best]],
                "cut": [place[best]], "gain": [gain[best]], "lefts": [left],
                "rights": [total - left], "share": [good / max(total, 1)]})

        counted = chunks.mapInPandas(count, "tree int, node int, told binary")
        chosen = counted.groupBy("tree", "node").applyInPandas(
            choose, "tree int, node int, feature int, cut int, gain double, lefts double, "
                    "rights double, share double").collect()
        open_ = {}
        for row in sorted(chosen, key=lambda row: (row["tree"], row["node"])):
            top, node = tops[row["tree"]], row["node"]
            if not row["gain"] > 1e-9 or top.depth[node] >= max_depth:
                done.append((row["tree"], node, [-1], [0], [0], [row["share"]], [0.0] * width))
                continue
            top.feature[node], top.cut[node] = row["feature"], row["cut"]
            top.left[node] = len(top.feature)
            importance[row["tree"], row["feature"]] += row["gain"]
            for size in (row["lefts"], row["rights"]):
                if size > rows_per_node:
                    open_.setdefault(row["tree"], []).append(len(top.feature))
                top.feature.append(-1)
                top.cut.append(0)
                top.left.append(0)
                top.depth.append(top.depth[node] + 1)
    # The gains of large nodes belong to no part: a part of no region tells of them.
    done += [(tree, -1, [-1], [0], [0], [0.0], importance[tree].tolist())
             for tree in tops if importance[tree].any()]
    return tops, done


class Forest:
    """A grown forest: cuts of its columns, large nodes, and the table of its parts."""

    def __init__(self, spark: SparkSession, place: str, cuts: list[np.ndarray],
                 tops: dict[int, Top]):
        self.spark, self.place, self.cuts, self.tops = spark, place, cuts, tops

    @property
    def parts(self) -> DataFrame:
        return self.spark.read.schema(_PART).parquet(f"{self.place}/parts")

    @staticmethod
    def fit(rows: DataFrame, label: str, features: str, mtry: int, least: int, trees: int,
            max_depth: int, seed: int, rows_per_node: int | None = None) -> "Forest":
        """A forest of (label, array of features) without missing values."""
        spark, rows_whole = rows.sparkSession, rows_per_node or ROWS_WHOLE
        rows_per_node = rows_per_node or ROWS_PER_NODE
        first = rows.select(F.size(features)).first()
        if first is None:
            raise ValueError("there are no rows to fit")
        width = first[0]
        cuts = quantile_cuts(rows, features, width)
        place = f"{work_folder(spark)}/forests/{uuid.uuid4().hex}"
        bound_batches(spark)
        chunks = packed(rows.withColumn("_label", F.col(label).cast("byte")), features, cuts,
                        ["_label"])
        labelled = _with_labels(chunks)
        total = chunks.agg(F.sum("n")).first()[0]
        whole = total <= rows_whole
        tops, done = large_nodes(labelled, 0 if whole else total, width, trees, mtry, least,
                                 max_depth, seed, rows_per_node)
        held = {row[:2] for row in done}
        if whole:
            _grow_whole(labelled, width, trees, mtry, least, max_depth,
                        seed).write.parquet(f"{place}/parts")
        for first in range(0, 0 if whole else trees, TREES_AT_ONCE):
            some = {tree: tops[tree] for tree in range(first, min(trees, first + TREES_AT_ONCE))}
            _grow_regions(labelled, width, some, held, mtry, least, max_depth,
                          seed).write.mode("append").parquet(f"{place}/parts")
        spark.createDataFrame(done, _PART).write.mode("append").parquet(f"{place}/parts")
        forest = Forest(spark, place, cuts, tops)
        forest._describe(place)
        return forest

    def _describe(self, place: str) -> None:
        told = {"cuts": [own.tolist() for own in self.cuts],
                "tops": [vars(self.tops[tree]) for tree in sorted(self.tops)]}
        self.spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(
            1).write.mode("overwrite").text(f"{place}/forest")

    def save(self, place: str) -> None:
        self.parts.write.mode("overwrite").parquet(f"{place}/parts")
        self._describe(place)

    @staticmethod
    def load(spark: SparkSession, place: str) -> "Forest":
        told = json.loads(spark.read.text(f"{place}/forest").first()[0])
        return Forest(spark, place, [np.array(own) for own in told["cuts"]],
                      {tree: Top(**top) for tree, top in enumerate(told["tops"])})

    def digest(self) -> str:
        """Tells of every cut and leaf, whatever the order of the parts."""
        code = F.xxhash64(*self.parts.columns)
        row = self.parts.agg(F.count("*").alias("n"), F.sum(code.cast("decimal(38,0)")).alias(
            "sum")).first()
        top = zlib.crc32(repr(([own.tolist() for own in self.cuts], sorted(
            (tree, vars(top)) for tree, top in self.tops.items()))).encode())
        return f"{row['n']}:{row['sum']}:{top}"

    def importances(self) -> np.ndarray:
        """Mean share of each column in the gains of a tree; they add up to one."""
        position = F.posexplode("importance").alias("column", "gain")
        per_tree = self.parts.select("tree", position).groupBy("tree", "column").agg(
            F.sum("gain").alias("gain"))
        whole = per_tree.groupBy("tree").agg(F.sum("gain").alias("whole")).where("whole > 0")
        told = per_tree.join(whole, "tree").groupBy("column").agg(
            F.sum(F.col("gain") / F.col("whole")).alias("share")).collect()
        found = np.zeros(len(self.cuts))
        for row in told:
            found[row["column"]] = row["share"]
        return found / (found.sum() or 1)

    def score(self, rows: DataFrame, features: str, pd_col: str) -> DataFrame:
        """The rows with the mean share of their leaves, without the features; written once.

        Every part meets every chunk, so chunks are filled across the partitions of the rows, and
        parts meet them by the batch: a chunk comes once for some megabytes of parts.
        """
        spark, tops, trees = self.spark, self.tops, len(self.tops)
        keep = [name for name in rows.columns if name != features]
        schema = rows.select(*keep, F.lit(None).cast("double").alias(pd_col)).schema
        width = len(self.cuts)

        def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write_batch(batch)
                yield pa.RecordBatch.from_pydict({"parts": [sink.getvalue().to_pybytes()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for packed_parts, chunk, n, codes in zip(*(
                        batch[name] for name in ("parts", "chunk", "n", "codes"))):
                    n = n.as_py()
                    codes = by_rows(np.frombuffer(codes.as_buffer(), np.uint8).reshape(width, n))
                    told = sums.setdefault(chunk.as_py(), np.zeros(n, np.int64))
                    some = pa.ipc.open_stream(packed_parts.as_buffer()).read_all()
                    for one in some.to_pandas().itertuples(index=False):
                        units = np.rint(one.share * UNIT).astype(np.int64)
                        if shared.value[one.tree][0][0] < 0:        # the part is the tree
                            told += units.take(walk(one.feature, one.cut, one.left, codes))
                            continue
                        own = np.flatnonzero(walk(*shared.value[one.tree], codes) == one.region)
                        leaf = walk(one.feature, one.cut, one.left, codes, own)
                        told[own] += units.take(leaf)
            for chunk, told in sums.items():
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "told": [told.tobytes()]})

        def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            told = sum(np.frombuffer(part, np.int64) for part in frame["told"])
            return pd.DataFrame({"chunk": [key[0]], "told": [told.tobytes()]})

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for kept, told in zip(batch["kept"], batch["told"]):
                    table = pa.ipc.open_stream(kept.as_buffer()).read_all()
                    pds = np.frombuffer(told.as_buffer(), np.int64) / UNIT / trees
                    yield from table.append_column(pd_col, pa.array(pds)).to_batches()

        shared = spark.sparkContext.broadcast(plain_tops(tops))
        tasks = min(MAX_PARTITIONS, 4 * spark.sparkContext.defaultParallelism)
        bound_batches(spark)
        chunks = packed(rows.coalesce(max(1, -(-rows.count() // ROWS_AT_ONCE))), features,
                        self.cuts, keep)
        parts = self.parts.where("region >= 0").drop("importance").coalesce(tasks).mapInArrow(
            batched, "parts binary").repartition(tasks)
        sums = parts.crossJoin(chunks.drop("kept")).mapInArrow(
            add, "chunk string, told binary").groupBy("chunk").applyInPandas(
            total, "chunk string, told binary")
        return _written(chunks.select("chunk", "kept").join(sums, "chunk").select(
            "kept", "told").mapInArrow(unpack, schema))


def _with_labels(chunks: DataFrame) -> DataFrame:
    """Chunks with the labels as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [pa.ipc.open_stream(kept).read_all()["_label"] for kept in frame["kept"]]
            if any(own.null_count or not np.isin(own, (0, 1)).all() for own in told):
                raise ValueError("labels are 0 or 1")
            labels = [own.to_numpy().astype(np.uint8).tobytes() for own in told]
            yield frame[["chunk", "n", "codes"]].assign(labels=labels)

    return chunks.mapInPandas(run, "chunk string, n int, codes binary, labels binary")


def _grow_whole(chunks: DataFrame, width: int, trees: int, mtry: int, least: int,
                max_depth: int, seed: int) -> DataFrame:
    """The trees of rows that are not more than one task may hold: each task is given all chunks
    once and grows some of the trees, where rows dealt by the tree come once for each."""
    tasks = min(trees, TREE_TASKS * chunks.sparkSession.sparkContext.defaultParallelism)

    def compress(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["chunk", "n"]].assign(rows=[
                pa.compress(codes + labels, "zstd", asbytes=True)
                for codes, labels in zip(frame["codes"], frame["labels"])])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}
        for frame in frames:
            for task, *chunk in frame.itertuples(index=False):
                held.setdefault(task, []).append(chunk)
        for task, own in held.items():
            own.sort(key=lambda one: one[0])        # chunks come in any order
            chunks = [(chunk, n) for chunk, n, _ in own]
            total, filled = sum(n for _, n in chunks), 0
            rows, labels = np.empty((total, width), np.uint8), np.empty(total, np.uint8)
            for _, n, packed in own:
                told = np.frombuffer(pa.decompress(
                    packed, (width + 1) * n, "zstd", asbytes=True), np.uint8).reshape(width + 1, n)
                rows[filled:filled + n], labels[filled:filled + n] = told[:width].T, told[width]
                filled += n
            own.clear()
            for tree in range(task, trees, tasks):
                weights = np.concatenate([drawn(seed, tree, chunk, n) for chunk, n in chunks])
                at = np.flatnonzero(weights)
                if len(at):
                    grown = grow(rows.take(at, axis=0).T, labels[at], weights[at], mtry, least,
                                 max_depth, np.random.default_rng([seed, tree, 0, 1]))
                    yield pd.DataFrame({"tree": [tree], "region": [0],
                                        **{name: [value] for name, value in grown.items()}})

    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    return chunks.mapInPandas(compress, "chunk string, n int, rows binary").select(
        every, "chunk", "n", "rows").repartitionById(tasks, "task").mapInPandas(run, _PART)


def _grow_regions(chunks: DataFrame, width: int, tops: dict[int, Top], done: set, mtry: int,
                  least: int, max_depth: int, seed: int) -> DataFrame:
    """The parts of all regions, each grown by a task from the rows dealt to it."""
    context = chunks.sparkSession.sparkContext
    shared = context.broadcast(plain_tops(tops))
    depths = {tree: top.depth for tree, top in tops.items()}

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, n, codes, labels in frame.itertuples(index=False):
                codes = by_rows(np.frombuffer(codes, np.uint8).reshape(width, n))
                labels = np.frombuffer(labels, np.uint8)
                for tree, top in shared.value.items():
                    weights, at = drawn(seed, tree, chunk, n), walk(*top, codes)
                    for region in np.unique(at[weights > 0]).tolist():
                        if (tree, region) in done:
                            continue
                        own = np.flatnonzero((at == region) & (weights > 0))
                        rows = np.vstack([codes[:, own], labels[own], weights[own]])
                        yield pd.DataFrame({
                            "tree": [tree], "region": [region], "chunk": [chunk],
                            "n": [len(own)],
                            "rows": [pa.compress(rows.tobytes(), "zstd", asbytes=True)]})

    def part(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree, region = key
        frame = frame.sort_values("chunk")      # rows come in any order
        rows = np.concatenate([np.frombuffer(pa.decompress(
            packed, (width + 2) * n, "zstd", asbytes=True), np.uint8).reshape(width + 2, n)
            for packed, n in zip(frame["rows"], frame["n"].tolist())], axis=1)
        grown = grow(rows[:width], rows[width], rows[width + 1], mtry, least,
                     max_depth - depths[tree][region],
                     np.random.default_rng([seed, tree, region, 1]))
        return pd.DataFrame({"tree": [tree], "region": [region],
                             **{name: [value] for name, value in grown.items()}})

    regions = sum(top.feature.count(-1) for top in tops.values())
    tasks = max(min(regions, 8 * context.defaultParallelism), min(MAX_PARTITIONS, regions // 4))
    dealt = chunks.mapInPandas(deal, "tree int, region int, chunk string, n int, rows binary")
    return dealt.repartition(tasks, "tree", "region").groupBy(
        "tree", "region").applyInPandas(part, _PART)


def _written(df: DataFrame) -> DataFrame:
    place = f"{work_folder(df.sparkSession)}/forests/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, for the session: a row here holds thousands."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
