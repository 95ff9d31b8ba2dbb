"""Hardness measures and learners against plain versions."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.operators import cells, hardness, neighbours
from evenhand.operators.learners import NaiveBayes, Tree
from evenhand.operators.neighbours import nearest, within
from evenhand.operators.trees import TreeModel


def points(spark, data):
    return spark.createDataFrame([(i, y, [float(v) for v in x]) for i, (y, x) in enumerate(data)], "row_id long, label int, features array<double>")


def complexities(df, kind, **options):
    return {r["row_id"]: r["complexity"] for r in hardness.REGISTRY[kind](df, **options).collect()}


def plain_spanning_tree(x):
    """Kruskal over all pairs, by distance and ids."""
    up = list(range(len(x)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    out = []
    for _, a, b in sorted((sum((p - q) ** 2 for p, q in zip(x[i], x[j], strict=True)), i, j) for i, j in itertools.combinations(range(len(x)), 2)):
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.append((a, b))
    return set(out)


@pytest.mark.parametrize("block", [4096, 40])
def test_spanning_tree_by_all_pairs(spark, monkeypatch, block):
    """Ties and copies included; with small blocks rows of several components share cells."""
    monkeypatch.setattr(cells, "BLOCK", block)
    r = np.random.default_rng(5)
    data = [(int(r.integers(0, 2)), r.integers(0, 12, 2).tolist()) for _ in range(110)] + [(1, [500, 500]), (0, [500, 501])]
    df = points(spark, data)
    want = plain_spanning_tree([x for _, x in data])
    assert {(e["a"], e["b"]) for e in hardness.spanning_tree(df).collect()} == want
    if block > 100:
        got = complexities(df, "n1")
        for i in range(len(data)):
            ends = [b if a == i else a for a, b in want if i in (a, b)]
            assert got[i] == pytest.approx(sum(data[j][0] != data[i][0] for j in ends) / len(ends))


def test_spanning_tree_of_one_row_and_none(spark):
    assert hardness.spanning_tree(points(spark, [(0, [1])])).collect() == []
    assert hardness.spanning_tree(points(spark, [])).collect() == []


def test_nearest_where_most_rows_look_into_no_other_cell(spark, monkeypatch):
    """Of rows with copies the cells beyond are ruled out, so all batches but that of the last row have lists of nothing."""
    monkeypatch.setattr(cells, "BLOCK", 50)
    df = points(spark, [(0, [100 * (i % 6), 0]) for i in range(1200)] + [(0, [149, 60])])
    got = {r["query_id"]: (r["row_id"], r["d2"]) for r in nearest(df, df, 1, n_rows=1201, n_queries=1201).collect()}
    assert got == {i: (i % 6 if i > 5 else i + 6, 0.0) for i in range(1200)} | {1200: (1, 49.0**2 + 60.0**2)}


def test_spanning_tree_of_separate_clusters(spark, monkeypatch):
    """More rows lie together than are known of a row, so components have to search again, and far."""
    monkeypatch.setattr(cells, "BLOCK", 60)
    r = np.random.default_rng(8)
    data = [(0, (np.array([i % 9, i % 5]) * 1000 + r.integers(0, 9, 2)).tolist()) for i in range(300)]
    df = points(spark, data)
    assert {(e["a"], e["b"]) for e in hardness.spanning_tree(df).collect()} == plain_spanning_tree([x for _, x in data])


def test_nearest_unlike_with_many_labels(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.normal(size=(12, 3))[r.integers(0, 12, 400)] * 30 + r.normal(size=(400, 3))
    df = points(spark, [(int(i // 4), v) for i, v in enumerate(x.tolist())])
    key = lambda d: [tuple(q) for q in d.orderBy("query_id", "rank").collect()]
    want = key(nearest(df, df, 2, unlike=True))
    monkeypatch.setattr(cells, "BLOCK", 50)
    assert key(nearest(df, df, 2, unlike=True)) == want


def test_counts_within_radii_by_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = r.normal(size=(15, 3))[r.integers(0, 15, 500)] * 30 + r.normal(size=(500, 3))
    x[50:200] = x[50]
    y, radius = r.integers(0, 2, 500), r.choice([0.0, 0.5, 3.0, 30.0, 500.0, math.inf], 500)
    df = points(spark, list(zip(y.tolist(), x.tolist(), strict=True)))
    radii = spark.createDataFrame(list(enumerate(radius.tolist())), "row_id long, radius double")
    d = np.sqrt(sum((x[:, None, c] - x[None, :, c]) ** 2 for c in range(3)))
    same = y[:, None] == y[None, :]
    inside = (d < radius[:, None]) & same & ~np.eye(500, dtype=bool)
    want = {i: (int(inside[i].sum()), int(inside[:, i].sum()), float(np.where(same[i], d[i], 0).max())) for i in range(500)}
    for block in (4096, 40):
        monkeypatch.setattr(cells, "BLOCK", block)
        compared = spark.sparkContext.accumulator(0)
        got = {q["row_id"]: (q["n_within"], q["n_holding"], q["farthest"]) for q in within(df, radii, compared=compared).collect()}
        assert got == want
        assert compared.value < 0.25 * 500 * 500


def test_searches_write_no_pairs_of_rows_and_blocks(spark, monkeypatch):
    """Vectors without structure need all blocks; each row is dealt out once, to its home, and no row for every block."""
    monkeypatch.setattr(cells, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "HELD", 1 << 14)  # blocks are held in several parts
    dealt, meet = [], neighbours._meet
    monkeypatch.setattr(neighbours, "_meet", lambda q, counts, r: (dealt.append(q.count()), meet(q, counts, r))[1])
    x = np.random.default_rng(6).normal(size=(700, 12))
    df = points(spark, [(i % 2, v) for i, v in enumerate(x.tolist())])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    compared = spark.sparkContext.accumulator(0)
    got = {(r["query_id"], r["rank"]): r["row_id"] for r in nearest(df, df, 3, compared=compared).collect()}
    assert got == {(i, rank + 1): int(j) for i in range(700) for rank, j in enumerate(np.argsort(d[i])[:3])}
    assert sum(dealt) <= 700 and compared.value > 0.5 * 700 * 700
    # blocks hold cells of both labels; only rows of the own one count
    by_label = {(r["query_id"], r["rank"]): r["row_id"] for r in nearest(df, df, 2, by=["label"]).collect()}
    apart = np.where((np.arange(700)[:, None] - np.arange(700)) % 2 == 0, d, np.inf)
    assert by_label == {(i, rank + 1): int(j) for i in range(700) for rank, j in enumerate(np.argsort(apart[i])[:2])}
    dealt.clear()
    radius = np.sqrt(np.median(d, axis=1))
    found = {r["row_id"]: (r["n_within"], r["n_holding"], round(r["farthest"], 9)) for r in within(df, spark.createDataFrame(list(enumerate(radius.tolist())), "row_id long, radius double")).collect()}
    inside = (np.sqrt(d) < radius[:, None]) & ((np.arange(700)[:, None] - np.arange(700)) % 2 == 0)
    farthest = np.sqrt(np.where(np.isfinite(apart), apart, 0).max(1))
    assert found == {i: (int(inside[i].sum()), int(inside[:, i].sum()), round(float(farthest[i]), 9)) for i in range(700)} and not dealt


def test_tables_of_a_search_go_when_nothing_reads_them(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 50)
    written = []
    for module in (neighbours, hardness):
        monkeypatch.setattr(module, "cut", lambda df, made=module.cut: (written.append(made(df)), written[-1])[1])
    df = points(spark, [(i % 2, v) for i, v in enumerate(np.random.default_rng(7).normal(size=(300, 4)).tolist())])
    found = hardness._friends_and_enemies(df)
    left = [t.path for t in written if os.path.exists(t.path)]
    wide = [t.path for t in written if {"features", "points", "rows"} & set(t.columns)]
    assert len(wide) > 10 and not set(wide) & set(left) and found.path in left and found.count() == 300


def plain_pruned(nodes, price, node=1):
    """Leaves of the cheapest subtree, and its cost."""
    counts = [c["n"] for c in nodes[node]["counts"]]
    alone = sum(counts) - sum(c * c for c in counts) / sum(counts) + price
    if nodes[node]["feature"] < 0:
        return [node], alone
    (a, x), (b, y) = plain_pruned(nodes, price, 2 * node), plain_pruned(nodes, price, 2 * node + 1)
    return ([node], alone) if alone <= x + y else (a + b, x + y)


def test_pruning_by_recursion(spark):
    r = np.random.default_rng(8)
    data = [(k, int(v[0] + r.normal() > 0), v.tolist()) for k in (0, 1) for v in r.normal(size=(80, 2))]
    df = spark.createDataFrame([(k, i, y, x) for i, (k, y, x) in enumerate(data)], "k int, row_id long, label int, features array<double>")
    model = Tree().fit(df, "k")
    for alpha in (0.0, 0.01, 1.0):
        kept = model.pruned(alpha).nodes.collect()
        for k in (0, 1):
            nodes = {n["node"]: n for n in model.nodes.where(F.col("k") == k).collect()}
            leaves, _ = plain_pruned(nodes, alpha * 80)
            assert {n["node"] for n in kept if n["k"] == k and n["feature"] < 0} == set(leaves)
            assert {n["node"] for n in kept if n["k"] == k} == {n >> i for n in leaves for i in range(n.bit_length())}


def test_tree_measures_by_hand(spark):
    df = points(spark, [(0, [0]), (0, [0]), (0, [0]), (1, [9]), (1, [10]), (0, [10])])
    model = Tree().fit(df)
    assert isinstance(model, TreeModel) and {r["row_id"]: r["node"] for r in model.leaves(df).collect()} == {0: 2, 1: 2, 2: 2, 3: 6, 4: 7, 5: 7}
    assert complexities(df, "tree_depth_unpruned") == {0: 0.5, 1: 0.5, 2: 0.5, 3: 1.0, 4: 1.0, 5: 1.0}
    assert complexities(df, "disjunct_size") == {0: 0.0, 1: 0.0, 2: 0.0, 3: 1.0, 4: 0.5, 5: 0.5}
    # at this price the first split alone stays
    got = complexities(df, "disjunct_class_percentage", alpha=0.1)
    assert {i: round(c, 6) for i, c in got.items()} == {0: 0, 1: 0, 2: 0, 3: 0.333333, 4: 0.333333, 5: 0.666667}
    assert set(complexities(df, "tree_depth_pruned", alpha=9.0).values()) == {0.0}


def test_likelihoods_by_numpy(spark):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(60, 3)) * [1, 5, 0] + [0, 1, 7], r.integers(0, 3, 60)
    x[y == 1, 0] += 2
    df = points(spark, list(zip(y.tolist(), x.tolist(), strict=True)))
    low = 1e-9 * x.var(0).max()
    log = np.stack([np.log((y == c).mean()) - 0.5 * (np.log(2 * math.pi * (x[y == c].var(0) + low)) + (x - x[y == c].mean(0)) ** 2 / (x[y == c].var(0) + low)).sum(1) for c in range(3)], 1)
    p = np.exp(log - log.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    got = complexities(df, "class_likelihood")
    assert [got[i] for i in range(60)] == pytest.approx((1 - p[np.arange(60), y]).tolist(), abs=1e-7)
    other = np.where(np.arange(3)[None, :] == y[:, None], 0, p).max(1)
    got = complexities(df, "likelihood_difference")
    assert [got[i] for i in range(60)] == pytest.approx(((1 - p[np.arange(60), y] + other) / 2).tolist(), abs=1e-7)
    twice = df.withColumn("weight", F.lit(2))
    a, b = ({(q["row_id"], q["class"]): q["p"] for q in NaiveBayes().fit(d).probabilities(df).collect()} for d in (df, twice))
    assert a == pytest.approx(b)


def test_constant_features_of_naive_bayes(spark):
    df = points(spark, [(0, [1, 2]), (0, [1, 2]), (1, [1, 2])])
    assert {(q["class"], round(q["p"], 6)) for q in NaiveBayes().fit(df).probabilities(df).collect()} == {(0, 0.666667), (1, 0.333333)}


def test_feature_rounds_by_hand(spark):
    # the second feature separates rows 0, 1 and 4; of the rest the first separates 2 from 3, a single class each
    df = points(spark, [(0, [5, 0]), (0, [5, 1]), (0, [1, 5]), (1, [2, 5]), (1, [5, 9]), (1, [2, 5])])
    assert complexities(df, "f4") == {0: 0.0, 1: 0.0, 4: 0.0, 2: 0.5, 3: 0.5, 5: 0.5}
    assert set(complexities(points(spark, [(0, [1]), (1, [1])]), "f4").values()) == {1.0}
    row = hardness.overlap_volume(points(spark, [(0, [0, 0]), (0, [4, 1]), (1, [2, 1]), (1, [6, 3])])).first()
    assert (row["f2"], row["f3"]) == (0.0, 0.5)
