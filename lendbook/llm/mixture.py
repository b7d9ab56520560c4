"""A mix of sources that meets target weights, by a min-cost flow over membership patterns.

Documents may belong to several sources at once. Those with the same set of sources are one
pattern, and the flow runs over patterns only: words flow from a pattern to the sources in it, each
source takes up to its quota, and a pattern gives its words once, then a second and a third time at
a rising price. As the price depends on the pattern's turn alone, the cheapest flow is a
greatest flow over first turns, extended to a greatest flow over second turns, and so on. Patterns
that share no source, not even over others, are solved apart, each set in a task of its own.

Whole documents are then selected. All documents of a pattern are taken as often as whole turns
were used, and some once more, to fill the rest. From the longest to the shortest, so many
documents of each length are chosen, near the share the rest asks for and rounded by a seed, that
shorter ones can still fill what is missing. A seeded hash decides which of equally long documents
these are. Lengths of a pattern are counted, not its documents: their number is below the root of
twice the pattern's words.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendbook.llm.common import cut_lineage, positions
from lendbook.llm.near_dedup import components
from lendbook.operators.prefix import running_totals

MAX_TURNS = 3
SEED = 11


def targets(sources: DataFrame, total: float, limit: int = MAX_TURNS) -> DataFrame:
    """``sources`` (size, weight) with ``target``: shares of ``total`` by weight.

    No target is above ``limit`` times its source's size. What is above goes to the others by
    weight, again and again, until none is above; each round is one sum over the sources.
    """
    full, before, rate = F.lit(False), -1, None
    while True:
        row = sources.agg(
            F.sum(F.when(full, limit * F.col("size")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == before or not row["weight"]:
            break
        before = row["n"]
        rate = (float(total - row["full"]), float(row["weight"]))
        full = limit * F.col("size") < F.lit(rate[0]) * F.col("weight") / F.lit(rate[1])
    share = F.lit(0.0) if rate is None else F.lit(rate[0]) * F.col("weight") / F.lit(rate[1])
    return sources.withColumn("target", F.least(
        (limit * F.col("size")).cast("double"), share))


def cheapest_flow(patterns: list[tuple[int, list[int]]], quotas: list[int],
                  turns: int = MAX_TURNS) -> list[list[int]]:
    """Words from each pattern (its words, its sources) to each of its sources.

    Each turn adds the patterns' words once more and extends the flow to a greatest one by
    shortest paths, which may lead words already placed to another source.
    """
    flow = [[0] * len(own) for _, own in patterns]
    users: list[list[tuple[int, int]]] = [[] for _ in quotas]
    for number, (_, own) in enumerate(patterns):
        for place, source in enumerate(own):
            users[source].append((number, place))
    open_quota = list(quotas)
    for _ in range(turns):
        left = [words for words, _ in patterns]
        while True:
            path = _path(patterns, users, flow, left, open_quota)
            if path is None:
                break
            first, source = path[0][0], patterns[path[-1][0]][1][path[-1][1]]
            room = min([left[first], open_quota[source]]
                       + [flow[p][i] for p, i in path[1::2]])
            for step, (pattern, place) in enumerate(path):
                flow[pattern][place] += room if step % 2 == 0 else -room
            left[first] -= room
            open_quota[source] -= room
    return flow


def _path(patterns, users, flow, left, quotas) -> list[tuple[int, int]] | None:
    """The shortest way from a pattern with words left to a source with quota left.

    Its edges (pattern, place) alternate between words added and words taken back.
    """
    came: dict[int, list[tuple[int, int]]] = {}
    queue = deque(p for p in range(len(patterns)) if left[p])
    by_pattern: dict[int, list[tuple[int, int]]] = {p: [] for p in queue}
    while queue:
        pattern = queue.popleft()
        for place, source in enumerate(patterns[pattern][1]):
            if source in came:
                continue
            came[source] = by_pattern[pattern] + [(pattern, place)]
            if quotas[source]:
                return came[source]
            for other, at in users[source]:
                if other not in by_pattern and flow[other][at]:
                    by_pattern[other] = came[source] + [(other, at)]
                    queue.append(other)
    return None


def _routes(edges: pd.DataFrame) -> pd.DataFrame:
    """Rows (pattern, source, routed) of one set of patterns and sources."""
    edges = edges.sort_values(["pattern", "source"])
    names = sorted(edges["source"].unique())
    number = {source: place for place, source in enumerate(names)}
    quota = edges.groupby("source")["quota"].first()
    groups = [(name, own) for name, own in edges.groupby("pattern", sort=True)]
    flow = cheapest_flow(
        [(int(own["words"].iloc[0]), [number[s] for s in own["source"]]) for _, own in groups],
        [int(quota[s]) for s in names])
    return pd.DataFrame(
        [(name, source, words) for (name, own), given in zip(groups, flow)
         for source, words in zip(own["source"], given)],
        columns=["pattern", "source", "routed"])


def chosen(sizes: np.ndarray, counts: np.ndarray, wanted: int, seed: int) -> np.ndarray:
    """How many documents of each size to choose so that their words come nearest to ``wanted``.

    ``sizes`` fall and are positive. At each size the share of what is still missing is rounded up or
    down by the seed, within what keeps the rest reachable by smaller documents. In the end single
    documents are exchanged as long as that comes nearer.
    """
    out = np.zeros(len(sizes), np.int64)
    missing = int(wanted)
    below = int((sizes * counts).sum())
    for place, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist())):
        if missing <= 0:
            break
        share = min(1.0, missing / below)
        below -= size * count
        low = max(0, -(-(missing - below) // size))
        high = min(count, missing // size)
        dice = xxhash.xxh3_64_intdigest(str(size).encode(), seed) / 2 ** 64
        take = int(share * count + dice)
        if low <= high:
            take = min(max(take, low), high)
        else:                           # no number fits: the nearest, what smaller ones add known
            more, fewer = min(low, count), max(high, 0)
            over = abs(missing - size * more)
            under = missing - size * fewer - min(below, missing - size * fewer)
            take = more if over < under else fewer
        out[place] = take
        missing -= size * take
    return _nearer(sizes, counts, out, missing)


def _nearer(sizes: np.ndarray, counts: np.ndarray, out: np.ndarray, missing: int) -> np.ndarray:
    """``out`` after the exchanges of one document for another, or none, that help most."""
    while missing:
        drop = np.append(np.flatnonzero(out > 0), -1)
        add = np.append(np.flatnonzero(out < counts)[::-1], -1)
        gain = np.where(add >= 0, sizes[add], 0) if len(sizes) else np.zeros(1, np.int64)
        loss = np.where(drop >= 0, sizes[drop], 0) if len(sizes) else np.zeros(1, np.int64)
        order = np.argsort(gain, kind="stable")
        gain, add = gain[order], add[order]
        near = np.searchsorted(gain, loss + missing)
        best = min(
            ((abs(missing + int(loss[i]) - int(gain[j])), int(drop[i]), int(add[j]))
             for i, at in enumerate(near.tolist()) for j in (at - 1, at) if 0 <= j < len(gain)),
            default=(abs(missing), -1, -1))
        if best[0] >= abs(missing):
            break
        for place, by in ((best[1], -1), (best[2], 1)):
            if place >= 0:
                out[place] += by
                missing -= by * int(sizes[place])
    return out


def _picks(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Per size of one pattern how often all are taken and how many once more."""
    rows = rows.sort_values("size", ascending=False)
    words, routed = int(rows["words"].iloc[0]), int(rows["routed"].iloc[0])
    turns = min(MAX_TURNS, routed // words)
    rest = routed - turns * words if turns < MAX_TURNS else 0
    name = rows["pattern"].iloc[0]
    more = chosen(rows["size"].to_numpy(), rows["n"].to_numpy(), rest,
                  xxhash.xxh3_64_intdigest(name.encode(), seed))
    return pd.DataFrame({"pattern": name, "size": rows["size"], "turns": turns, "more": more,
                         "n": rows["n"]})


def mix(docs: DataFrame, size: Column, members: Column, weights=None, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, pattern, taken) of every document, and (source, size, weight, target).

    ``members`` is an array with the names of a document's sources; null is a name like any other,
    and a document with a null or empty array has none and is not taken. ``weights`` maps the
    sources' numbers by code point, null last, from 0, to weights; 1, 2, 3, repeating, without
    it. ``taken`` is a whole multiple, 3 at most, of the document's size. Null sizes count as 0;
    documents of size 0 are taken 0 times. Ids may be null or repeat; rows equal in id, text, size
    and sources stand for each other. Reruns give equal results. An empty table gives empty results.
    """
    rows = cut_lineage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"}).alias(
            "pattern"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col)).alias("_hash")))
    patterns = cut_lineage(rows.groupBy("pattern").agg(F.sum("size").alias("words")))
    total = patterns.agg(F.sum("words")).first()[0] or 0
    edges = patterns.select("pattern", "words", F.explode(F.from_json(
        "pattern", "array<string>")).alias("name"))
    sums = edges.groupBy("name").agg(F.sum("words").alias("size")).select(
        F.to_json(F.array("name")).alias("source"), "name", "size",
        F.col("name").isNull().alias("_none"), F.lit(1).alias("one"))
    numbered = running_totals(sums, ["_none", "name"], ["one"]).withColumn(
        "number", F.col("cum_one").cast("long") - 1)
    weight = weights(F.col("number")) if weights else F.col("number") % 3 + 1
    sources = cut_lineage(numbered.select("source", "name", "number", "size",
                                          weight.cast("long").alias("weight")))
    sources = cut_lineage(targets(sources, total))

    quotas = sources.select("source", "number", F.floor(F.col("target") + 0.5).alias("quota"))
    edges = cut_lineage(edges.select("pattern", "words", F.to_json(F.array("name")).alias(
        "source")).where("words > 0").join(quotas, "source"))
    links = edges.groupBy("pattern").agg(
        F.min("number").alias("a"), F.collect_set("number").alias("all")).select(
        "a", F.explode("all").alias("b")).where("a <> b")
    joined = components(links.select("a", "b"))
    grouped = edges.join(joined, edges["number"] == joined["id"], "left").withColumn(
        "component", F.coalesce("component", "number"))
    routed = grouped.select("component", "pattern", "source", "words", "quota").groupBy(
        "component").applyInPandas(_routes, "pattern string, source string, routed long")
    routed = routed.groupBy("pattern").agg(F.sum("routed").alias("routed"))

    sizes = rows.where("size > 0").groupBy("pattern", "size").agg(F.count(F.lit(1)).alias("n"))
    picks = cut_lineage(sizes.join(patterns, "pattern").join(routed, "pattern").groupBy(
        "pattern").applyInPandas(
        lambda group: _picks(group, seed),
        "pattern string, size long, turns long, more long, n long"))
    placed = rows.join(picks, ["pattern", "size"], "left")
    turns = F.coalesce("turns", F.lit(0))
    out = ["doc_id", "size", "pattern"]
    some = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    sure = placed.where(~F.coalesce(some, F.lit(False))).select(*out, (F.col("size") * (
        turns + F.when(F.col("more") > 0, 1).otherwise(0))).alias("taken"))
    drawn = positions(cut_lineage(placed.where(some)), F.col("_hash"), ["pattern", "size"])
    drawn = drawn.select(*out, (F.col("size") * (turns + (
        F.col("position") < F.col("more")).cast("long"))).alias("taken"))
    return sure.unionByName(drawn), sources
