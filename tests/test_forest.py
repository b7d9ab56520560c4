"""The benchmark forest: parts of bounded size, whatever the size of a node or a tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendbook.operators import forest as module
from lendbook.operators.forest import Forest, best_bins, grow, packed, walk


def labelled(spark, rows=4000):
    """Three columns: the first one decides, the second one within it, the third one is noise."""
    key = F.col("id")
    first, second, noise = key % 97, F.floor(key / 97) % 89, F.floor(key * 7919) % 83
    return spark.range(0, rows, 1, 4).select(
        key.alias("application_id"),
        ((first > 60) | (first > 30) & (second > 50)).cast("int").alias("default_flag"),
        F.array(*[c.cast("double") for c in (first, second, noise)]).alias("features"))


def fit(rows, **other):
    return Forest.fit(rows, "default_flag", "features", **{
        "mtry": 2, "least": 5, "trees": 6, "max_depth": 30, "seed": 3, **other})


@pytest.mark.parametrize("rows_per_node", [300, None])
def test_large_nodes_are_cut_before_rows_are_dealt(spark, rows_per_node, tmp_path, monkeypatch):
    monkeypatch.setattr("lendbook.operators.forest.TREES_AT_ONCE", 4)
    rows = labelled(spark)
    forest = fit(rows, rows_per_node=rows_per_node)
    assert any(len(top.feature) > 1 for top in forest.tops.values()) == bool(rows_per_node)
    regions = forest.parts.where("region >= 0").groupBy("tree").count().collect()
    assert sorted((r["tree"], r["count"]) for r in regions) == [
        (tree, top.feature.count(-1)) for tree, top in sorted(forest.tops.items())]
    assert forest.importances().sum() == pytest.approx(1)
    assert forest.importances()[2] < 0.1
    scored = forest.score(rows, "features", "pd")
    assert scored.columns == ["application_id", "default_flag", "pd"]
    assert scored.select("application_id").distinct().count() == scored.count() == 4000
    wrong = scored.where("(pd >= 0.5) <> (default_flag = 1)").count()
    assert wrong < 120
    forest.save(str(tmp_path / "forest"))
    again = Forest.load(spark, str(tmp_path / "forest"))
    assert again.digest() == forest.digest()
    assert again.score(rows, "features", "pd").exceptAll(scored).count() == 0


def test_rows_with_gaps_and_repeated_rows_are_scored(spark):
    forest = fit(labelled(spark, 800))
    odd = spark.createDataFrame(
        [(1, [3.0, 4.0, 5.0]), (1, [3.0, 4.0, 5.0]), (None, [70.0, 1.0, 1.0]),
         (2, [float("nan"), 1.0, 1.0])], "application_id long, features array<double>")
    told = sorted((r["application_id"] or 0, r["pd"]) for r in forest.score(
        odd, "features", "pd").collect())
    assert [key for key, _ in told] == [0, 1, 1, 2]
    assert told[1] == told[2] and told[1][1] < 0.2
    assert told[0][1] > 0.8 and told[3][1] > 0.8        # what is missing lies right of all cuts
    assert forest.score(odd.where("false"), "features", "pd").count() == 0


def test_labels_must_be_there(spark):
    rows = labelled(spark, 200)
    for wrong in (F.lit(None).cast("int"), F.lit(2)):
        with pytest.raises(Exception, match="labels are 0 or 1"):
            fit(rows.withColumn("default_flag", F.when(
                F.col("application_id") == 7, wrong).otherwise(F.col("default_flag"))))


def test_cuts_are_the_best_ones():
    rng = np.random.default_rng(4)
    codes, labels = rng.integers(0, 32, (3, 400)).astype(np.uint8), rng.integers(0, 2, 400)
    weights = rng.poisson(1.0, 400).astype(np.uint8)

    def gini(own):
        n, bad = weights[own].sum(), (weights * labels)[own].sum()
        return 2 * bad * (n - bad) / n if n else 0.0

    everyone = np.ones(400, bool)
    gains = {(c, b): gini(everyone) - gini(codes[c] <= b) - gini(codes[c] > b)
             for c in range(3) for b in range(31)
             if min(weights[codes[c] <= b].sum(), weights[codes[c] > b].sum()) >= 20}
    grown = grow(codes, labels, weights, 3, 20, 1, np.random.default_rng(0))
    assert gains[grown["feature"][0], grown["cut"][0]] == pytest.approx(max(gains.values()))
    assert grown["importance"].sum() == pytest.approx(max(gains.values()))
    deep = grow(codes, labels, weights, 3, 20, 30, np.random.default_rng(0))
    leaf = walk(deep["feature"], deep["cut"], deep["left"], codes)
    sizes = np.bincount(leaf, weights, len(deep["feature"]))
    assert sizes[deep["feature"] < 0].min() >= 20
    bad = np.bincount(leaf, weights * labels, len(deep["feature"]))
    ends = deep["feature"] < 0
    assert deep["share"][ends] == pytest.approx(bad[ends] / sizes[ends])
    assert best_bins(np.array([[5.0] + [0.0] * 31]), np.zeros((1, 32)), 1)[1][0] == -np.inf


def test_rows_in_many_partitions_are_scored_as_one_chunk(spark, monkeypatch):
    rows, seen = labelled(spark, 2000), []

    def watched(*args):
        seen.append(packed(*args))
        return seen[-1]

    forest = fit(rows)
    plain = forest.score(rows, "features", "pd")
    monkeypatch.setattr("lendbook.operators.forest.packed", watched)
    scored = forest.score(rows.repartition(40), "features", "pd")
    assert [chunks.count() for chunks in seen] == [1]       # 40 before: every tree met each
    assert scored.count() == 2000 and scored.exceptAll(plain).count() == 0


def test_rows_beyond_a_chunk_are_scored_in_several(spark, monkeypatch):
    rows = labelled(spark, 2000)
    forest = fit(rows)
    plain = forest.score(rows, "features", "pd")
    monkeypatch.setattr("lendbook.operators.forest.ROWS_AT_ONCE", 300)
    scored = forest.score(rows, "features", "pd")
    assert scored.count() == 2000 and scored.exceptAll(plain).count() == 0


def test_rows_of_small_trees_come_once_for_a_task(spark, monkeypatch):
    rows = labelled(spark, 900)
    cuts = module.quantile_cuts(rows, "features", 3)
    chunks = module._with_labels(packed(
        rows.withColumn("_label", F.col("default_flag").cast("byte")), "features", cuts,
        ["_label"])).persist()
    monkeypatch.setattr(module, "TREE_TASKS", 1)
    tops = {tree: module.Top([-1], [0], [0], [0]) for tree in range(30)}
    dealt = module._grow_regions(chunks, 3, tops, set(), 2, 5, 30, 3)
    whole = module._grow_whole(chunks, 3, 30, 2, 5, 30, 3)
    assert whole.rdd.getNumPartitions() == min(30, spark.sparkContext.defaultParallelism)
    assert whole.count() == 30 and whole.exceptAll(dealt).count() == 0
    chunks.unpersist()

    def by_tree(*args):
        raise AssertionError("rows are dealt by the tree")      # as they were for every forest

    monkeypatch.setattr(module, "_grow_regions", by_tree)
    assert fit(rows, trees=30).parts.select("tree").distinct().count() == 30
    with pytest.raises(AssertionError, match="by the tree"):
        fit(rows, rows_per_node=300)


def test_rows_beyond_a_node_are_given_whole(spark, monkeypatch):
    """Before, all rows of more than a node's bound were dealt by the tree."""
    rows = labelled(spark, 900)
    monkeypatch.setattr(module, "ROWS_PER_NODE", 300)
    plain = fit(rows)
    assert all(top.feature == [-1] for top in plain.tops.values())
    monkeypatch.setattr(module, "ROWS_WHOLE", 800)
    dealt = fit(rows)
    assert all(len(top.feature) > 1 for top in dealt.tops.values())
    for forest in (plain, dealt):
        assert forest.score(rows, "features", "pd").where("(pd >= 0.5) <> (default_flag = 1)").count() < 45


def test_walk_ends_at_the_leaf_of_each_row():
    rng = np.random.default_rng(8)
    codes, labels = rng.integers(0, 32, (3, 700)).astype(np.uint8), rng.integers(0, 2, 700)
    tree = grow(codes, labels, np.ones(700, np.uint8), 2, 1, 30, rng)
    expected = np.zeros(700, int)
    for row in range(700):
        node = 0
        while tree["feature"][node] >= 0:
            node = tree["left"][node] + (codes[tree["feature"][node], row] > tree["cut"][node])
        expected[row] = node
    parts = [tree[name].astype(np.int32) for name in ("feature", "cut", "left")]
    assert np.array_equal(walk(*parts, codes), expected)
    assert np.array_equal(walk(*parts, module.by_rows(codes)), expected)
    own = np.arange(1, 700, 3)
    assert np.array_equal(walk(*parts, codes, own), expected[own])
    assert len(walk(*parts, codes, own[:0])) == 0
    assert not walk(*(part[:1] * 0 - (i == 0) for i, part in enumerate(parts)), codes).any()
