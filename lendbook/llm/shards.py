"""Sharding by balanced label propagation.

Documents start dealt evenly over the shards. In every round each linked document looks where
most of its neighbours are and asks to move there. Moves are granted by quotas per pair of shards
that keep every shard's count as it is: as many go one way as come back, and where fewer want to
come back, documents without links fill the places, which costs no cut. The greatest gains go
first.

Links are given by hubs: documents with the same hub (here: the same text) are neighbours. What
is counted is hub and shard, never pairs of documents, so a hub with a third of all documents is
a sum over eight shards. Rows carry everything the result needs; the texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendbook.llm.common import cut_lineage, positions

SHARDS = 8
MAX_ROUNDS = 6
ROWS_PER_CELL = 50_000
GAIN_CLASSES = 16


def quotas(demand: dict[tuple[int, int], int], free: dict[int, int],
           shards: int) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Grants per (from, to) for documents that ask, and for unlinked ones that fill places.

    For every pair of shards the number that goes equals the number that comes.
    """
    granted, filling, left = {}, {}, dict(free)
    pairs = [(a, b) for a in range(shards) for b in range(a + 1, shards)]
    for a, b in pairs:
        more, less = ((a, b), (b, a)) if demand.get((a, b), 0) >= demand.get((b, a), 0) \
            else ((b, a), (a, b))
        common = demand.get(less, 0)
        fill = min(demand.get(more, 0) - common, left.get(more[1], 0))
        left[more[1]] = left.get(more[1], 0) - fill
        granted[less], granted[more] = common, common + fill
        filling[more[1], more[0]] = fill
    return granted, filling


def _granted(asking: DataFrame, grants: dict[tuple[int, int], int], cells: DataFrame) -> DataFrame:
    """Rows of ``asking`` with ``moves``: the first of every (from, to), as many as granted.

    Cells of (from, to, priority, bin) are summed in order; all but the last cell of a pair move
    whole or not at all, and rows are numbered only inside such a last cell.
    """
    spark = asking.sparkSession
    table = spark.createDataFrame([(a, b, n) for (a, b), n in grants.items()],
                                  "shard int, wanted int, _grant long")
    before = Window.partitionBy("shard", "wanted").orderBy("priority", "bin").rowsBetween(
        Window.unboundedPreceding, -1)
    taken = cells.join(F.broadcast(table), ["shard", "wanted"]).withColumn(
        "_take", F.least("n", F.greatest(F.lit(0), F.col("_grant") - F.coalesce(
            F.sum("n").over(before), F.lit(0))))).select(
        "shard", "wanted", "priority", "bin", "_take", (F.col("_take") == F.col("n")).alias("_all"))
    keys = ["shard", "wanted", "priority", "bin"]
    rows = asking.join(taken, keys, "left").fillna({"_take": 0, "_all": False})
    part = (F.col("_take") > 0) & ~F.col("_all")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("row_hash", "doc_id"))
    some = rows.where(part).withColumn("moves", number <= F.col("_take"))
    rest = rows.where(~part).withColumn("moves", F.col("_all"))
    return rest.unionByName(some).drop("_take", "_all")


def propagate(rows: DataFrame, shards: int = SHARDS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Shards of rows (doc_id, hub and any others) after balanced label propagation.

    A null hub has no links. Counts of the shards differ by one at most. Repeated rows count
    each on its own; an empty table gives an empty one.
    """
    total = rows.count()
    row_hash = F.xxhash64(F.lit("row"), "doc_id", "hub")
    dealt = positions(rows.withColumn("row_hash", row_hash), F.struct("row_hash", "doc_id"),
                      rows=total)
    sizes = rows.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where(
        "_n > 1").select("hub", F.lit(True).alias("linked"))
    state = cut_lineage(dealt.join(sizes, "hub", "left").select(
        *rows.columns, "row_hash", F.coalesce("linked", F.lit(False)).alias("linked"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard")))
    bins = max(1, -(-total // (ROWS_PER_CELL * shards)))
    for turn in range(max_rounds):
        after = _round(state, turn, bins, shards)
        if after is None:
            break
        state = after
    return state.drop("row_hash", "linked")


def _round(state: DataFrame, turn: int, bins: int, shards: int) -> DataFrame | None:
    """One round; None when nothing moves."""
    counts = state.where("linked").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("_n"))
    # All members of a hub see the same greatest shard; a hash of both settles ties.
    best = counts.groupBy("hub").agg(
        F.max_by(F.struct(F.col("shard").alias("wanted"), F.col("_n").alias("_most")),
                 F.struct("_n", F.xxhash64("hub", "shard"))).alias("b")).select("hub", "b.*")
    # Gain over a lone place, in doubling classes; the greatest come first.
    gain = F.least(F.lit(GAIN_CLASSES), F.floor(F.log2(F.col("_most")))).cast("int")
    asks = state.join(best, "hub", "left").withColumn(
        "priority", F.coalesce(GAIN_CLASSES - gain, F.lit(GAIN_CLASSES + 1)))
    asks = asks.withColumn("wanted", F.coalesce("wanted", F.lit(-1))).drop("_most").withColumn(
        "bin", F.pmod(F.xxhash64("row_hash", F.lit(turn)), F.lit(bins)).cast("int"))
    asks = cut_lineage(asks)
    keys = ["shard", "wanted", "priority", "bin"]
    wanting = asks.where((F.col("wanted") >= 0) & (F.col("wanted") != F.col("shard")))
    unlinked = asks.where(~F.col("linked"))
    cells = wanting.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    demand = {(r["shard"], r["wanted"]): r["n"] for r in cells.groupBy("shard", "wanted").agg(
        F.sum("n").alias("n")).collect()}                       # at most shards squared rows
    free = {r["shard"]: r["n"] for r in unlinked.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    granted, filling = quotas(demand, free, shards)
    if not any(granted.values()):
        return None
    movers = _granted(wanting, granted, cells)
    # Fillers: each shard's unlinked documents are dealt to the shards that gave it some.
    slots = [(a, b, n) for (a, b), n in filling.items() if n]
    fillers = _fill(unlinked, slots, bins)
    staying = asks.where(F.col("linked") & (F.col("wanted") == F.col("shard")))
    moved = F.when(F.col("moves"), F.col("wanted")).otherwise(F.col("shard"))
    columns = state.columns
    return cut_lineage(
        movers.withColumn("shard", moved).select(columns)
        .unionByName(fillers.select(columns)).unionByName(staying.select(columns)))


def _fill(unlinked: DataFrame, slots: list[tuple[int, int, int]], bins: int) -> DataFrame:
    """Unlinked rows, as many of each shard moved to others as ``slots`` (from, to, n) says."""
    if not slots:
        return unlinked
    spark = unlinked.sparkSession
    ends: dict[int, int] = {}
    ranges = []
    for a, b, n in sorted(slots):
        ranges.append((a, b, ends.get(a, 0), ends.get(a, 0) + n))
        ends[a] = ends.get(a, 0) + n
    needed = spark.createDataFrame(list(ends.items()), "shard int, _needed long")
    cells = unlinked.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0))
                           .alias("_before")).join(F.broadcast(needed), "shard").where(
        F.col("_before") < F.col("_needed"))
    rows = unlinked.join(offsets, ["shard", "bin"], "left")
    number = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("row_hash", "doc_id"))
    some = rows.where("_before is not null").withColumn(
        "_place", F.col("_before") + number - 1)
    target: Column = F.col("shard")
    for a, b, low, high in ranges:
        target = F.when((F.col("shard") == a) & (F.col("_place") >= low)
                        & (F.col("_place") < high), F.lit(b)).otherwise(target)
    columns = unlinked.columns
    return some.withColumn("shard", target.cast("int")).select(columns).unionByName(
        rows.where("_before is null").select(columns))


def shard_documents(docs: DataFrame, shards: int = SHARDS, text_col: str = "text",
                    id_col: str = "doc_id", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, one row per row.

    Neighbours are documents with equal texts. Null texts have size 1, checksum 0 and no links.
    Null and repeated ids are sharded like any other; columns of other names are not read.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("hub"))
    placed = propagate(cut_lineage(rows), shards, max_rounds)
    hashed = placed.withColumn("_order", F.xxhash64(F.lit("slot"), "doc_id", "text_crc32"))
    return positions(hashed, F.struct("_order", "doc_id", "size"), ["shard"]).select(
        "doc_id", "size", "text_crc32", "shard", F.col("position").alias("slot"))


def cut_edges(placed: DataFrame) -> DataFrame:
    """Per hub, documents outside the hub's greatest shard: the cut of a star of its members."""
    counts = placed.where("hub is not null").groupBy("hub", "shard").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.groupBy("hub").agg((F.sum("n") - F.max("n")).alias("cut"))
