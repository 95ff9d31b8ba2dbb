import statistics

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evenhand.operators import cells, comparison, ensemble, evaluation, hardness, neighbours, ranking, sampling, trees
from evenhand.operators.learners import Forest, NearestCentroid, Tree
from evenhand.operators.neighbours import nearest
from evenhand.plans import catalog
from evenhand.sources import staging
from evenhand.sources.frame import imbalanced, validated
from evenhand.streaming import score_stream

SF = "/root/testdata/sf0.001"
QUICK = ["knn_within_class", "hardness_lsc", "hardness_harmfulness", "hardness_f1", "hardness_statistics", "evaluate_split_nc", "class_counts", "class_info", "target_mean", "minmax_features", "hardness_overlap", "hardness_neighborhood", "gaussian_weights", "undersample_weighted", "seed_lookup", "stratified_folds", "stratified_split", "mu_grid", "mu_distribution", "generated_imbalance", "hardness_error_rate_tree", "binary_metrics", "classification_report", "roc_auc", "resample_mid"]


def rows(frame, names):
    return sorted(tuple("null" if pd.isna(x) else str(x) if isinstance(x, str) else f"{float(x):.5f}" for x in r) for r in frame[names].astype(object).values.tolist())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()
    got = catalog.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def points(spark, data):
    return spark.createDataFrame([(i, y, [float(v) for v in x]) for i, (y, x) in enumerate(data)], "row_id long, label int, features array<double>")


def test_overlap_by_hand(spark):
    df = points(spark, [(0, [0]), (0, [2]), (1, [8]), (1, [10])] * 3)
    got = {tuple(r) for r in hardness.overlap(df).select("label", "complexity").distinct().collect()}
    assert {(a, round(b, 9)) for a, b in got} == {(0, 0.0), (0, 1.0), (1, 1.0), (1, 0.0)}


def test_equal_hardness_is_one_over_n(spark):
    df = points(spark, [(0, [0])] * 5 + [(1, [1])] * 5)
    assert {r["complexity"] for r in hardness.overlap(df).collect()} == {0.1}


def test_resampled_classes_have_the_target_size(spark):
    df = points(spark, [(0, [i, i % 3]) for i in range(30)] + [(1, [i + 0.5, 7]) for i in range(6)])
    counts = {r["label"]: r["n"] for r in evaluation.class_counts(sampling.resample(df)).collect()}
    assert counts == {0: 18, 1: 18}


def test_bags_of_all_settings_share_a_search_for_neighbours(spark, monkeypatch):
    """One search for each fold, and bags as those of each setting alone."""
    df = points(spark, [(0, [i, i * i % 37]) for i in range(60)] + [(1, [i + 0.5, 7 + i % 5]) for i in range(24)])
    searched = []
    monkeypatch.setattr(sampling, "nearest", lambda *a, **o: (searched.append(1), nearest(*a, **o))[1])
    settings = [("a", "overlap", 0.2), ("b", "class_balance", 0.2), ("c", "overlap", 0.5)]
    made, _ = ensemble.of_all_folds(df, settings, 2, 2)
    assert len(searched) == 2
    key = lambda d: sorted((r["held"], r["member_id"], r["label"], *r["features"]) for r in d.collect())
    for one in settings[::2]:
        alone = sampling.Resampler(one[1])
        train, _ = evaluation.in_folds(df, 2, True, 42)
        for held in range(2):
            bag = ensemble.bags_of(alone.fit(train.where(F.col("held") == held).drop("held")), ensemble.mu_grid(spark, 2), one[2], 5).withColumn("held", F.lit(held))
            assert key(made.where((F.col("name") == one[0]) & (F.col("held") == held))) == key(bag)


def test_nearest_of_many_equal_rows(spark):
    df = points(spark, [(0, [i % 2 + 0.1, 0.7, 3.3]) for i in range(200)])
    for exclude in (True, False):
        got = nearest(df, df, 3, exclude_self=exclude).orderBy("query_id", "rank").toPandas()
        for q, near in got.groupby("query_id")["row_id"]:
            others = [i for i in range(q % 2, 200, 2) if i != q]
            assert near.tolist() == (others[:3] if exclude else [q, *others[:2]])


def test_diversity_by_hand(spark):
    bags = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [2.0]), (1, [3.0]), (2, [4.0])], "member_id int, features array<double>")
    assert abs(ensemble.diversity(bags).first()["diversity"] - 8 / 9) < 1e-9


def test_validation(spark):
    with pytest.raises(ValueError, match="rows"):
        validated(points(spark, [(0, [1]), (1, [2])]))
    with pytest.raises(ValueError):
        hardness.with_complexity(points(spark, [(0, [1])]), "nothing")
    with pytest.raises(ValueError):
        ensemble.Ensemble(members=0)
    with pytest.raises(ValueError):
        ensemble.Ensemble(sigma=0)


def test_ranks_in_bins(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANKED", 7)
    rows = [(i, i % 2, float(2.0 ** (i * 37 % 11 - 5)), float(i * 37 % 101)) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, label int, w double, v double")
    for place, order in ((ranking.by_octave(F.col("w")), ["w", "row_id"]), (ranking.by_uniform(F.col("v") / 101), ["v", "row_id"])):
        for most in (None, 13):
            got = {(r["label"], r["row_id"]): r["rk"] for r in ranking.ranked(df, ["label"], place, order, "rk", None if most is None else F.lit(most)).collect()}
            column = 2 if order[0] == "w" else 3
            want = {(y, r[0]): n for y in (0, 1) for n, r in enumerate(sorted((r for r in rows if r[1] == y), key=lambda r: (r[column], r[0])), 1) if most is None or n <= most}
            assert got == want
    got = {(r["label"], r["v"]): r["rk"] for r in ranking.in_order(df, ["label"], "v", "rk").collect()}
    assert got == {(y, v): n for y in (0, 1) for n, v in enumerate(sorted(r[3] for r in rows if r[1] == y), 1)}
    got = {r["label"]: r["median"] for r in ranking.medians(df, "label", "v").collect()}
    assert got == {y: statistics.median(r[3] for r in rows if r[1] == y) for y in (0, 1)}


def test_slots_come_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SLOTS", 4)
    short = spark.createDataFrame([(0, 9), (1, 4)], "label int, missing long")
    assert sorted(tuple(r) for r in sampling.slots_of(short, "label").collect()) == [(0, i) for i in range(1, 10)] + [(1, i) for i in range(1, 5)]


def test_many_classes_and_local_sets(spark):
    df = points(spark, [(i // 2, [float(i)]) for i in range(3000)])
    got = {r["row_id"]: r["complexity"] for r in hardness.n2(df).collect()}
    assert len(got) == 3000 and {i for i, c in got.items() if c != 0.5} == {0, 2999}  # at the ends the enemy is twice as far
    one = points(spark, [(0, [0]), (0, [1]), (0, [5]), (1, [3])])
    assert [round(r["complexity"], 6) for r in hardness.usefulness(one).orderBy("row_id").collect()] == [round(1 - n / 3, 6) for n in (2, 2, 1)] + [0.0]


def test_error_rate_falls_back_to_all_rows(spark):
    df = points(spark, [(i % 3, [float(i)]) for i in range(9)])
    got = hardness.error_rate(df, NearestCentroid(), 5).collect()
    assert len(got) == 9 and all(0 <= r["complexity"] < 1 for r in got)


def test_resampler_settings(spark):
    one = sampling.Resampler(seed=1)
    assert one.with_params(seed=2).get_params() == {"hardness": "overlap", "strategy": "auto", "seed": 2} and one.seed == 1
    fitted = one.fit(points(spark, [(0, [i, 1]) for i in range(12)] + [(1, [i, 2]) for i in range(4)]))
    assert fitted.complexities().count() == 16
    assert {r["label"]: r["n"] for r in evaluation.class_counts(fitted.resample(1.0)).collect()} == {0: 8, 1: 8}
    with pytest.raises(ValueError):
        one.fit(points(spark, [(0, [1])] * 12))
    assert ensemble.Ensemble().with_params(members=3).get_params()["members"] == 3


def test_bagging_and_generated_tables(spark):
    df = imbalanced(spark, 300, 6, informative=2, redundant=2, flip=0.0)
    model = Forest(3, every=True).fit(df)
    pred = ensemble.best_class(model.probabilities(df))
    assert pred.where("label = pred").count() > 280
    x = np.array([r["features"] for r in df.collect()])
    assert np.linalg.matrix_rank(x[:, :4], tol=1e-6) == 2 and np.linalg.matrix_rank(x) == 4


def test_winners_are_the_first_of_equals(spark):
    table = spark.createDataFrame([(0, "a", 0.5, 0.1, 0.2), (1, "b", 0.5, 0.3, 0.1)], "position int, name string, f1 double, auc double, recall double")
    assert {(r["metric"], r["name"]) for r in evaluation.winners(table).collect()} == {("f1", "a"), ("auc", "b"), ("recall", "a")}


def streamed(spark, model, df, folder, name):
    df.write.parquet(folder)
    scored = score_stream(model, spark.readStream.schema(df.schema).parquet(folder))
    scored.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize(("learner", "voting"), [(Tree(), "hard"), (Forest(3), "soft"), (NearestCentroid(), "soft")])
def test_votes_on_streams_and_tables(spark, tmp_path, learner, voting):
    df = points(spark, [(int(i % 3 == 0), [float(i * 7 % 11 + 4 * (i % 3 == 0)), float(i % 5)]) for i in range(40)])
    model = ensemble.Ensemble(members=3, voting=voting, learner=learner).fit(df)
    got = streamed(spark, model, df, str(tmp_path / "in"), f"rows_{voting}_{type(learner).__name__}").collect()
    p = model.probabilities(df)
    want = ensemble.soft_vote(p, 3) if voting == "soft" else ensemble.hard_vote(p)
    assert {(r["row_id"], r["pred"]) for r in got} == {(r["row_id"], r["pred"]) for r in want.collect()} and len(got) == 40
    means = {(r["row_id"], r["class"]): r["p"] for r in ensemble.mean_probabilities(p, 3).collect()}
    assert {(r["row_id"], c["class"]): pytest.approx(c["p"]) for r in got for c in r["probability"]} == means


def test_member_scores_a_stream(spark, tmp_path):
    df = points(spark, [(i % 2, [float(i % 2), float(i)]) for i in range(20)])
    got = streamed(spark, Tree().fit(df), df, str(tmp_path / "in"), "scored_rows").collect()
    assert len(got) == 20 and all([(c["class"], c["p"]) for c in r["votes"][0]] == [(r["label"], 1.0)] for r in got)


def test_models_too_large_to_be_sent(spark, monkeypatch):
    df = points(spark, [(i % 2, [float(i * 7 % 11), float(i % 5)]) for i in range(40)])
    model = ensemble.Ensemble(members=2).fit(df)
    want = sorted(map(tuple, model.predict(df).collect()))
    monkeypatch.setattr(trees, "MOST_NODES", 1)
    assert model.scored(df) is None and sorted(map(tuple, model.predict(df).collect())) == want
    with pytest.raises(ValueError, match="stream"):
        score_stream(model, df)


def test_trees_that_rows_meet_in_groups(spark, monkeypatch):
    """Scores, sums and leaves are the same by trees that are sent, in groups of trees and parts of rows, and by levels."""
    df = points(spark, [(i * i % 7 // 3, [float(i * 7 % 11), float(i % 5), 1.0]) for i in range(60)]).withColumn("held", (F.col("row_id") % 3).cast("int"))
    forest = Forest(5).fit(df, "held")
    parts = lambda: (forest.probabilities(df, ("held",)), forest.probabilities(df), forest.model.probabilities(df, ("held",)), forest.model.leaves(df))
    key = lambda found: [sorted(map(tuple, f.select(sorted(f.columns)).collect())) for f in found]
    want = key(parts())
    assert [len(w) > 0 for w in want] == [True] * 4
    monkeypatch.setattr(trees, "MOST_NODES", 1)
    monkeypatch.setattr(trees, "GROUP", 60)
    monkeypatch.setattr(trees, "SMALL", 90)
    assert key(parts()) == want
    monkeypatch.setattr(trees, "LARGEST", 0)
    assert key(parts()) == want


def plain_tree(rows, depth=0):
    """(feature, low, high, cut, left, right) or the class counts of rows (x, y), by loops."""
    counts = {c: sum(y == c for _, y in rows) for c in {y for _, y in rows}}
    best = None
    for f in range(len(rows[0][0])) if len(counts) > 1 and depth < trees.MAX_DEPTH else ():
        low, high = min(x[f] for x, _ in rows), max(x[f] for x, _ in rows)
        if high == low:
            continue
        place = [min(trees.BINS - 1, int((x[f] - low) / (high - low) * trees.BINS)) for x, _ in rows]
        for cut in range(1, trees.BINS):
            sides = [[y for (_, y), b in zip(rows, place, strict=True) if (b >= cut) == s] for s in (False, True)]
            if all(sides):
                score = sum(sum(side.count(c) ** 2 for c in counts) / len(side) for side in sides)
                if best is None or score > best[0]:
                    best = (score, f, low, high, cut, place)
    if best is None:
        return counts
    _, f, low, high, cut, place = best
    return (f, low, high, cut, *(plain_tree([r for r, b in zip(rows, place, strict=True) if (b >= cut) == s], depth + 1) for s in (False, True)))


def as_tree(nodes, node=1):
    n = nodes[node]
    if n["feature"] < 0:
        return {c["class"]: c["n"] for c in n["counts"]}
    return (n["feature"], n["low"], n["high"], n["cut"], as_tree(nodes, 2 * node), as_tree(nodes, 2 * node + 1))


@pytest.mark.parametrize("small", [5, 1000])
def test_trees_by_plain_loops(spark, monkeypatch, small):
    """Whether tasks finish nodes or levels split them, ties and constant features included."""
    monkeypatch.setattr(trees, "SMALL", small)
    data = {k: [((float(i * 37 % 101), float(i % 4), 7.0, float(i * i % (13 + k))), (i * i + k * i) % 7 // 3) for i in range(60)] + [((5.0, 1.0, 7.0, 2.0), y) for y in (0, 1, 1)] for k in (0, 1)}
    df = spark.createDataFrame([(k, i, y, list(x)) for k, rows in data.items() for i, (x, y) in enumerate(rows)], "k int, row_id long, label int, features array<double>")
    model = Tree(max_depth=8 if small == 5 else 30).fit(df, "k")
    monkeypatch.setattr(trees, "MAX_DEPTH", 8 if small == 5 else 30)
    for k, rows in data.items():
        assert as_tree({r["node"]: r for r in model.nodes.where(F.col("k") == k).collect()}) == plain_tree(rows)


def test_weights_count_as_rows(spark):
    data = [(i * 5 % 3 % 2, [float(i * 7 % 11), float(i % 5)]) for i in range(40)]
    twice = points(spark, [r for i, r in enumerate(data) for _ in range(i % 3)])
    once = points(spark, data).withColumn("weight", F.col("row_id") % 3)
    key = lambda m: sorted(map(str, m.nodes.collect()))
    assert key(Tree().fit(once)) == key(Tree().fit(twice))
    assert Tree().fit(once.where("false")).nodes.count() == 0
    with pytest.raises(ValueError):
        Tree(max_depth=0)


def test_few_bytes_with_much_work_are_spread(spark, tmp_path):
    """Tasks that compute long over few bytes are not merged into one."""
    rows = spark.range(100).withColumn("b", F.col("id") % 20)
    staging.spread(rows, 3.2, "b").groupBy("b").applyInPandas(lambda part: part[:1], "id long, b long").write.parquet(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) == 4
    assert staging.spread(rows, 0.5, "b") is rows


def test_counts_within_radii_at_ties():
    """Radii that are distances of rows, equal rows and far offsets, by matrix products as by plain loops."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(60, 12)), np.repeat(r.normal(size=(1, 12)), 20, 0)]) + 1000.0
    d = np.zeros((80, 80))
    for c in range(12):
        d += (x[:, c, None] - x[None, :, c]) ** 2
    d = np.sqrt(d)
    radius = np.where(np.arange(80) % 9 == 0, np.inf, d[np.arange(80), r.integers(0, 80, 80)])
    got = pd.concat(neighbours._counted(np.arange(80), x, radius, np.arange(80), x)).groupby("row_id").agg({"n_within": "sum", "n_holding": "sum", "farthest": "max"})
    inside = (d < radius[:, None]) & ~np.eye(80, dtype=bool)
    assert got["n_within"].tolist() == inside.sum(1).tolist() and got["n_holding"].tolist() == inside.sum(0).tolist()
    assert got["farthest"].tolist() == d.max(1).tolist()


def clouds(n=1500, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(25, 4))[r.integers(0, 25, n)] * 20 + r.normal(size=(n, 4))
    x[100:600] = x[100]  # copies of one row, a third of all
    return r.permutation(n).tolist(), r.integers(0, 3, n).tolist(), x.tolist()


@pytest.mark.parametrize("options", [{}, {"by": ["label"], "exclude_self": False}, {"unlike": True}, {"exclude_self": False}])
def test_pruned_neighbours_equal_all_pairs(spark, monkeypatch, options):
    df = spark.createDataFrame(list(zip(*clouds(), strict=True)), "row_id long, label int, features array<double>")
    some = df.where("row_id % 7 = 0") if options in ({}, {"exclude_self": False}) else None
    key = lambda d: [tuple(r) for r in d.orderBy("query_id", "rank").collect()]
    want = [key(nearest(q, df, 4, **options)) for q in (df, some) if q is not None]
    monkeypatch.setattr(cells, "BLOCK", 64)
    compared = spark.sparkContext.accumulator(0)
    assert key(nearest(df, df, 4, compared=compared, **options)) == want[0]
    assert compared.value < 0.1 * 1500 * 1500, compared.value  # under a tenth of all pairs
    assert some is None or key(nearest(some, df, 4, **options)) == want[1]


def test_pruned_neighbours_without_structure(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = [*r.normal(size=(300, 12)).tolist(), *[[1e6 + i % 3] * 12 for i in range(40)], *[[0.0] * 12] * 5]
    df = spark.createDataFrame([(str(i), "ab"[i % 2], v) for i, v in enumerate(x)], "row_id string, label string, features array<double>")
    key = lambda d: [tuple(r) for r in d.orderBy("query_id", "rank").collect()]
    want = key(nearest(df, df, 7))
    monkeypatch.setattr(cells, "BLOCK", 50)
    assert key(nearest(df, df, 7)) == want


def test_text_ids_all_the_way(spark):
    df = points(spark, [(int(i % 4 == 0), [float(i * 7 % 11), float(i % 5)]) for i in range(40)])
    text = df.withColumn("row_id", F.concat(F.lit("r"), F.lpad(F.col("row_id").cast("string"), 3, "0")))
    got = sampling.resample(text, 0.5)
    assert {r["label"]: r["n"] for r in evaluation.class_counts(got).collect()} == {0: 20, 1: 20}
    assert got.where("NOT is_synthetic AND row_id NOT LIKE 'r0%'").count() == 0 and got.where("is_synthetic AND neighbor_row_id NOT LIKE 'r0%'").count() == 0
    for kind in ("neighborhood", "lsc"):
        a, b = ({int(str(r["row_id"]).lstrip("r")): round(r["complexity"], 9) for r in hardness.REGISTRY[kind](d).collect()} for d in (df, text))
        assert a == b, kind
    train, test = text.where("row_id < 'r030'"), text.where("row_id >= 'r030'")
    assert comparison.compare_strategies(train, test, NearestCentroid()).count() == 4


def test_seeds_of_large_classes_in_nested_ranges(spark, monkeypatch):
    df = points(spark, [(0, [1.0])] * 300).withColumn("weight", (F.col("row_id") % 5).cast("double"))
    slots = spark.range(1, 20_001).select(F.lit(0).alias("label"), F.col("id").alias("slot"))
    want = {tuple(r) for r in sampling.seeds(df, slots).collect()}
    monkeypatch.setattr(sampling, "RANGES", 4)
    monkeypatch.setattr(sampling, "RANKED", 2)
    got = sampling.seeds(df, slots).collect()
    assert len(got) == 20_000 == len(want) and {r["slot"] for r in got} == set(range(1, 20_001))
    times = np.bincount([r["seed_row_id"] for r in got], minlength=300)
    expected = np.arange(300) % 5 * 20_000 / 600
    assert (times[::5] == 0).all() and (abs(times - expected) <= 6 * np.sqrt(expected + 1)).all()


def test_entry_lists_every_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
