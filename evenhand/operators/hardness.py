"""How hard each row is: a ``complexity`` column beside row_id and label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.vectors import distance, min_max
from evenhand.operators.cells import share
from evenhand.operators.evaluation import class_counts, in_folds
from evenhand.operators.learners import NaiveBayes, Tree, centroids
from evenhand.operators.neighbours import nearest, within
from evenhand.operators.trees import TreeModel
from evenhand.sources.staging import cut, let_go, once


def feature_ranges(df: DataFrame) -> DataFrame:
    """pos, low and high of each feature."""
    return df.select(F.posexplode("features").alias("pos", "v")).groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def scaled(df: DataFrame) -> DataFrame:
    """The rows with features scaled to [0, 1]; a constant feature becomes 0. The ranges travel as one row."""
    ranges = feature_ranges(df).agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("~r"))
    put = F.zip_with("features", "~r", lambda x, r: min_max(x, r["low"], r["high"]))
    return df.crossJoin(F.broadcast(ranges)).withColumn("features", put).drop("~r")


def overlap(df: DataFrame) -> DataFrame:
    """Closeness to the nearest centroid of another class, 1 / (1 + distance) on scaled features, brought to [0, 1]."""
    points = scaled(once(df))
    others = centroids(points).agg(F.collect_list(F.struct("label", "centroid")).alias("~c"))  # one entry for each class
    away = F.transform(F.filter("~c", lambda c: c["label"] != F.col("label")), lambda c: distance(F.col("features"), c["centroid"]))
    raw = points.crossJoin(F.broadcast(others)).select("row_id", "label", F.coalesce(1 / (1 + F.array_min(away)), F.lit(0.0)).alias("r"))
    span = raw.agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("n"))
    return raw.crossJoin(F.broadcast(span)).select("row_id", "label", min_max(F.col("r"), F.col("low"), F.col("high"), F.col("n")).alias("complexity"))


def neighbourhood(df: DataFrame, k: int = 5) -> DataFrame:
    """Share of the k nearest other rows, on raw features, whose class differs."""
    near = nearest(df, df, k)
    own = df.select(F.col("row_id").alias("query_id"), F.col("label").alias("own"))
    share = near.join(own, "query_id").groupBy("query_id").agg(F.avg((F.col("label") != F.col("own")).cast("double")).alias("s"))
    return df.join(share, F.col("row_id") == F.col("query_id"), "left").select("row_id", "label", F.coalesce("s", F.lit(0.0)).alias("complexity"))


def error_rate(df: DataFrame, learner=None, folds: int = 5) -> DataFrame:
    """1 - out-of-fold probability of the true class, by a decision tree unless another learner is given; a class that the
    training folds lack counts 1. If every class has fewer rows than there are folds, all rows train and are scored."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    learner = learner or Tree()
    own = df.select("row_id", "label", "features")
    if (class_counts(own).agg(F.max("n")).first()[0] or 0) < folds:
        out = learner.fit(own).probabilities(own)
    else:
        train, test = in_folds(own, folds)
        out = learner.fit(train, "held").probabilities(test, ("held",))
    true = out.where(F.col("class") == F.col("label")).select("row_id", "p")
    return df.select("row_id", "label").join(true, "row_id", "left").select("row_id", "label", (1 - F.coalesce("p", F.lit(0.0))).alias("complexity"))


def class_balance(df: DataFrame) -> DataFrame:
    """n / classes - share of the row's class, from below 0 (common class) upwards."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("c"))
    table = counts.crossJoin(F.broadcast(total)).select("label", (1 / F.col("c") - F.col("n") / F.col("all")).alias("complexity"))
    return df.select("row_id", "label").join(F.broadcast(table), "label").select("row_id", "label", "complexity")


def minority_value(df: DataFrame) -> DataFrame:
    """1 - size of the row's class over the largest class."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    table = counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("m")))).select("label", (1 - F.col("n") / F.col("m")).alias("complexity"))
    return df.select("row_id", "label").join(F.broadcast(table), "label").select("row_id", "label", "complexity")


def _friends_and_enemies(df: DataFrame) -> DataFrame:
    """row_id, label, friend (distance of the nearest other row of the class), enemy and enemy_id (nearest row of another)."""
    n = df.count()
    df = once(df)
    own = df.select(F.col("row_id").alias("query_id"), F.col("label"))
    near = nearest(df, df, 1, by=["label"], n_rows=n, n_queries=n)
    friend = cut(near.select("query_id", F.sqrt("d2").alias("friend")))
    let_go(*near.reads)
    near = nearest(df, df, 1, n_rows=n, n_queries=n, unlike=True)
    enemy = near.select("query_id", F.sqrt("d2").alias("enemy"), F.col("row_id").alias("enemy_id"))
    out = cut(own.join(friend, "query_id", "left").join(enemy, "query_id", "left").withColumnRenamed("query_id", "row_id"))
    let_go(friend, *near.reads)
    return out


def n2(df: DataFrame) -> DataFrame:
    """r / (1 + r) of the ratio r of the distances to the nearest friend and the nearest enemy; 1 without either."""
    r = F.col("friend") / F.when(F.col("enemy") > 0, F.col("enemy"))
    return _friends_and_enemies(df).select("row_id", "label", F.coalesce(r / (1 + r), F.lit(1.0)).alias("complexity"))


def _local_sets(df: DataFrame) -> DataFrame:
    """row_id, label, enemy, n_within, n_holding, farthest and n (rows of the class): the local set of a row are the rows of its
    class that are nearer than its nearest enemy."""
    near = _friends_and_enemies(df).withColumn("radius", F.coalesce("enemy", F.lit(float("inf"))))
    found = within(df, near).join(near.select("row_id", "label", "enemy"), "row_id")
    return found.join(F.broadcast(class_counts(df)), "label")


def local_set_cardinality(df: DataFrame) -> DataFrame:
    """1 - share of the class that the row's local set, the row included, makes up."""
    return _local_sets(df).select("row_id", "label", (1 - (F.col("n_within") + 1) / F.col("n")).alias("complexity"))


def local_set_radius(df: DataFrame) -> DataFrame:
    """1 - distance of the nearest enemy over that of the farthest row of the class, at least 0."""
    share = F.when(F.col("farthest") > 0, F.least(F.lit(1.0), F.coalesce("enemy", "farthest") / F.col("farthest"))).otherwise(F.lit(1.0))
    return _local_sets(df).select("row_id", "label", (1 - share).alias("complexity"))


def usefulness(df: DataFrame) -> DataFrame:
    """1 - share of the class whose local sets hold the row, the row's own included."""
    return _local_sets(df).select("row_id", "label", (1 - (F.col("n_holding") + 1) / F.col("n")).alias("complexity"))


def harmfulness(df: DataFrame) -> DataFrame:
    """Share of the rows of other classes whose nearest enemy the row is."""
    hit = _friends_and_enemies(df).where(F.col("enemy_id").isNotNull()).groupBy(F.col("enemy_id").alias("row_id")).agg(F.count(F.lit(1)).alias("hits"))
    counts = class_counts(df)
    others = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("label", (F.col("all") - F.col("n")).alias("others"))
    share = F.when(F.col("others") > 0, F.coalesce("hits", F.lit(0)) / F.col("others")).otherwise(F.lit(0.0))
    return df.select("row_id", "label").join(hit, "row_id", "left").join(F.broadcast(others), "label").select("row_id", "label", share.alias("complexity"))


def feature_overlap(df: DataFrame) -> DataFrame:
    """Share of the features whose value lies where the ranges of all classes overlap."""
    ranges = df.select("label", F.posexplode("features").alias("pos", "v")).groupBy("label", "pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    both = ranges.groupBy("pos").agg(F.max("low").alias("low"), F.min("high").alias("high")).agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("~r"))
    inside = F.aggregate(F.zip_with("features", "~r", lambda x, r: ((x >= r["low"]) & (x <= r["high"])).cast("double")), F.lit(0.0), lambda t, x: t + x)
    return df.crossJoin(F.broadcast(both)).select("row_id", "label", (inside / F.size("features")).alias("complexity"))


def feature_efficiency(df: DataFrame) -> DataFrame:
    """Share of the features that it took to separate the row, 1 if all together don't.

    In each round the feature that separates most of the rows left (outside the range that all classes left share; the first of
    equals) is taken out, and these rows with it. Rows of a single class left are separate.
    """
    width = df.select(F.size("features").alias("w")).first()
    left, done, used = df.select("row_id", "label", "features"), None, []
    for turn in range(width["w"] if width else 0):
        ranges = left.select("label", F.posexplode("features").alias("pos", "v")).groupBy("label", "pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        # one row for each feature
        shared = ranges.groupBy("pos").agg(F.max("low").alias("low"), F.min("high").alias("high"), F.count(F.lit(1)).alias("classes")).where(~F.col("pos").isin(used))
        packed = cut(shared.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high", "classes"))).alias("~r")))
        outside = lambda r: (r["classes"] < 2) | (F.element_at(F.col("features"), r["pos"] + 1) < r["low"]) | (F.element_at(F.col("features"), r["pos"] + 1) > r["high"])
        marked = left.crossJoin(F.broadcast(packed)).withColumn("~o", F.transform("~r", lambda r: F.struct(r["pos"].alias("pos"), outside(r).alias("out"))))
        counts = marked.select(F.explode("~o").alias("o")).groupBy("o.pos").agg(F.sum(F.col("o.out").cast("long")).alias("n"))
        best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "pos")).alias("b")).first()["b"]
        if best is None or best["n"] == 0:
            break
        used.append(best["pos"])
        marked = cut(marked.withColumn("~out", F.filter("~o", lambda o: o["pos"] == best["pos"])[0]["out"]).drop("~r", "~o"))
        gone = marked.where("`~out`").select("row_id", "label", F.lit(turn / width["w"]).alias("complexity"))
        done = gone if done is None else done.unionByName(gone)
        left = marked.where("NOT `~out`").drop("~out")
    stays = left.select("row_id", "label", F.lit(1.0).alias("complexity"))
    return stays if done is None else done.unionByName(stays)


def overlap_volume(df: DataFrame) -> DataFrame:
    """One row: f2, the product over features of the share of the range that all classes share (0 where nothing is), and f3, the
    share of rows that the best single feature leaves in it."""
    ranges = df.select("label", F.posexplode("features").alias("pos", "v")).groupBy("label", "pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    shared = ranges.groupBy("pos").agg(F.max("low").alias("low"), F.min("high").alias("high"), (F.max("high") - F.min("low")).alias("span"))
    # one row for each feature
    packed = cut(shared.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high", "span"))).alias("~r")))
    part = F.transform("~r", lambda r: F.when(r["span"] > 0, F.greatest(F.lit(0.0), r["high"] - r["low"]) / r["span"]).otherwise(F.lit(1.0)))
    volume = packed.select(F.aggregate(part, F.lit(1.0), lambda t, x: t * x).alias("f2"))
    inside = F.zip_with("features", "~r", lambda x, r: ((x >= r["low"]) & (x <= r["high"])).cast("double"))
    share = df.crossJoin(F.broadcast(packed)).select(F.posexplode(inside).alias("pos", "i")).groupBy("pos").agg(F.avg("i").alias("s")).agg(F.min("s").alias("f3"))
    return volume.crossJoin(F.broadcast(share))


def class_likelihood(df: DataFrame) -> DataFrame:
    """1 - probability of the row's class by naive Bayes, fitted on all rows."""
    p = NaiveBayes().fit(df).probabilities(df)
    return p.where(F.col("class") == F.col("label")).select("row_id", "label", (1 - F.col("p")).alias("complexity"))


def likelihood_difference(df: DataFrame) -> DataFrame:
    """Half of 1 less the probability of the row's class plus the largest of another, by naive Bayes on all rows."""
    own = F.max(F.when(F.col("class") == F.col("label"), F.col("p")))
    other = F.coalesce(F.max(F.when(F.col("class") != F.col("label"), F.col("p"))), F.lit(0.0))
    return NaiveBayes().fit(df).probabilities(df).groupBy("row_id", "label").agg(((1 - own + other) / 2).alias("complexity"))


#: What a leaf costs where trees are pruned.
ALPHA = 0.01


def _tree_depth(model: TreeModel, df: DataFrame) -> DataFrame:
    depth = F.floor(F.log2(F.col("node").cast("double")))
    deepest = model.nodes.agg(F.max(depth).alias("d"))
    share = F.when(F.col("d") > 0, depth / F.col("d")).otherwise(F.lit(0.0))
    return model.leaves(df).crossJoin(F.broadcast(deepest)).select("row_id", "label", share.alias("complexity"))


def tree_depth_unpruned(df: DataFrame) -> DataFrame:
    """Depth of the row's leaf over the depth of a tree on all rows."""
    return _tree_depth(Tree().fit(df), df)


def tree_depth_pruned(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The same in the tree pruned at ``alpha``."""
    return _tree_depth(Tree().fit(df).pruned(alpha), df)


def disjunct_size(df: DataFrame) -> DataFrame:
    """1 - (rows of the row's leaf - 1) / (rows of the largest leaf - 1) in a tree on all rows; 1 if all leaves have one row."""
    model = Tree().fit(df)
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + c["n"])
    sizes = model.nodes.where("feature < 0").select("node", size.alias("n"))
    largest = sizes.agg(F.max("n").alias("m"))
    share = F.when(F.col("m") > 1, (F.col("n") - 1) / (F.col("m") - 1)).otherwise(F.lit(0.0))
    return model.leaves(df).join(sizes, "node").crossJoin(F.broadcast(largest)).select("row_id", "label", (1 - share).alias("complexity"))


def disjunct_class_percentage(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """1 - share of the row's class in its leaf of the tree pruned at ``alpha``."""
    p = Tree().fit(df).pruned(alpha).probabilities(df)
    return p.where(F.col("class") == F.col("label")).select("row_id", "label", (1 - F.col("p")).alias("complexity"))


#: Neighbours of a row that are kept from one search to the next in ``spanning_tree``, and parts that copies are dealt into.
KNOWN, PARTS = 8, 16


def spanning_tree(df: DataFrame) -> DataFrame:
    """a, b and d2 of the edges of the minimum spanning tree; of equal distances the edge with the smaller ids counts as shorter.

    Rows with equal vectors hang from the one with the smallest id, so only the first of each go on. Boruvka rounds: each
    component's shortest edge out of it is in the tree, and components that edges join become one by pointer jumping. Edges
    come from the nearest rows that are known of each row. Components only grow, so a known row stays the nearest of other
    components until it joins the row's own; a row whose known rows all did is searched for again only if its component's
    shortest edge is no shorter than the distance of the last of them, and no farther than that edge.
    """
    rows = cut(df.select("row_id", "features", share("row_id", PARTS).alias("part")))
    parts = rows.groupBy("features", "part").agg(F.min("row_id").alias("first"))
    firsts = cut(parts.groupBy("features").agg(F.min("first").alias("a")))
    hung = rows.join(parts.join(firsts, "features").select("features", "part", "a"), ["features", "part"])
    edges = cut(hung.where(F.col("row_id") != F.col("a")).select("a", F.col("row_id").alias("b"), F.lit(0.0).alias("d2")))
    points = firsts.select(F.col("a").alias("row_id"), "features")
    n = points.count()
    if n < 2:
        return edges
    state = cut(points.select("row_id", F.col("row_id").alias("label")))
    placed = points.withColumn("label", F.col("row_id"))
    links, bounds = _known(nearest(placed, placed, KNOWN, n_rows=n, n_queries=n))
    while True:
        own, other = state.withColumnRenamed("label", "own"), state.withColumnsRenamed({"row_id": "other", "label": "target"})
        links = cut(links.select("row_id", "other", "d2").join(own, "row_id").join(other, "other").where("own <> target"))
        best = cut(_shortest(links))
        open_ = cut(_open(state, links, bounds, best))
        n_components = state.select("label").distinct().count()
        # while enough components know their shortest edge, these alone go on
        if open_.select("label").distinct().count() * 4 > n_components * 3:
            here = cut(points.join(state, "row_id"))
            lost = open_.where("reach IS NULL")
            if not lost.isEmpty():
                # a component without an edge gets one from its row with the farthest neighbours
                one = lost.groupBy("label").agg(F.max(F.struct("bound", "row_id"))["row_id"].alias("row_id"))
                links, bounds = _searched(one.withColumn("reach", F.lit(float("inf"))), here, n, links, bounds)
                best = cut(_shortest(links))
                open_ = cut(_open(state, links, bounds, best))
            if not open_.isEmpty():
                links, bounds = _searched(open_.select("row_id", "label", "reach"), here, n, links, bounds)
                best = cut(_shortest(links))
        else:
            best = best.join(open_.select("label").distinct(), "label", "left_anti")
        best = cut(best)
        edges = edges.unionByName(cut(best.select("a", "b", "d2").distinct()))
        # two components that chose each other are a root, the smaller one, and those without an edge are roots
        back = best.select(F.col("label").alias("target"), F.col("target").alias("~back"))
        chosen = state.select("label").distinct().join(best.select("label", "target"), "label", "left").join(back, "target", "left")
        root = F.col("target").isNull() | ((F.col("~back") == F.col("label")) & (F.col("label") < F.col("target")))
        up = cut(chosen.select("label", F.when(root, F.col("label")).otherwise(F.col("target")).alias("up")))
        while True:
            step = up.join(up.select(F.col("label").alias("up"), F.col("up").alias("~next")), "up")
            moved = cut(step.select("label", F.col("~next").alias("up"), (F.col("~next") != F.col("up")).alias("moves")))
            up = moved.select("label", "up")
            if moved.where("moves").isEmpty():
                break
        state = cut(state.join(up, "label").select("row_id", F.col("up").alias("label")))
        if state.select("label").distinct().limit(2).count() < 2:
            return edges


def _known(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """row_id, other and d2 of the rows known of each row, and row_id and bound: no row that isn't known is nearer."""
    links = cut(near.select(F.col("query_id").alias("row_id"), F.col("row_id").alias("other"), "d2"))
    bound = F.when(F.count(F.lit(1)) < KNOWN, F.lit(float("inf"))).otherwise(F.max("d2"))
    return links, cut(links.groupBy("row_id").agg(bound.alias("bound")))


def _shortest(links: DataFrame) -> DataFrame:
    """label, d2, a, b and target: the shortest known edge out of each component."""
    edge = F.struct("d2", F.least("row_id", "other").alias("a"), F.greatest("row_id", "other").alias("b"), "target")
    return links.groupBy(F.col("own").alias("label")).agg(F.min(edge).alias("e")).select("label", "e.*")


def _open(state: DataFrame, links: DataFrame, bounds: DataFrame, best: DataFrame) -> DataFrame:
    """row_id, label, bound and reach (the squared length of the component's shortest known edge): the rows without a known row
    in another component that may yet have the component's shortest edge."""
    idle = state.join(links.select("row_id").distinct(), "row_id", "left_anti").join(bounds, "row_id")
    met = idle.join(best.select("label", F.col("d2").alias("reach")), "label", "left")
    return met.where(F.col("reach").isNull() | (F.col("bound") <= F.col("reach"))).select("row_id", "label", "bound", "reach")


def _searched(asking: DataFrame, here: DataFrame, n: int, links: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and bounds with what is found for ``asking`` (row_id, label, reach) within reach, in other components."""
    asking = cut(asking.join(here.select("row_id", "features"), "row_id"))
    near = nearest(asking, here, KNOWN, n_rows=n, n_queries=n, unlike=True).join(asking.select(F.col("row_id").alias("query_id"), F.col("label").alias("own"), "reach"), "query_id")
    found = cut(near.where(F.col("d2") <= F.col("reach")).select(F.col("query_id").alias("row_id"), F.col("row_id").alias("other"), "d2", "own", F.col("label").alias("target")))
    last = found.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("last"))
    now = asking.select("row_id", "reach").join(last, "row_id", "left").select("row_id", F.when(F.col("n") == KNOWN, F.col("last")).otherwise(F.col("reach")).alias("bound"))
    kept = bounds.join(asking.select("row_id"), "row_id", "left_anti")
    return cut(links.unionByName(found)), cut(kept.unionByName(now))


def borderline_points(df: DataFrame) -> DataFrame:
    """Share of the row's edges in the minimum spanning tree that lead to other classes."""
    edges = spanning_tree(df)
    twice = edges.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("x")).select("x.*")
    label = df.select("row_id", "label")
    met = twice.join(label.withColumnsRenamed({"row_id": "i", "label": "~own"}), "i").join(label.withColumnsRenamed({"row_id": "j", "label": "~other"}), "j")
    share = met.groupBy(F.col("i").alias("row_id")).agg(F.avg((F.col("~own") != F.col("~other")).cast("double")).alias("s"))
    return label.join(share, "row_id", "left").select("row_id", "label", F.coalesce("s", F.lit(0.0)).alias("complexity"))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "overlap": overlap, "neighborhood": neighbourhood, "kdn": neighbourhood, "error_rate": error_rate,
    "class_balance": class_balance, "minority_value": minority_value, "n2": n2, "lsc": local_set_cardinality,
    "lsr": local_set_radius, "usefulness": usefulness, "harmfulness": harmfulness, "f1": feature_overlap,
    "f4": feature_efficiency, "class_likelihood": class_likelihood, "likelihood_difference": likelihood_difference,
    "tree_depth_unpruned": tree_depth_unpruned, "tree_depth_pruned": tree_depth_pruned, "disjunct_size": disjunct_size,
    "disjunct_class_percentage": disjunct_class_percentage, "n1": borderline_points,
}


def with_complexity(df: DataFrame, kind: str | Callable[[DataFrame], DataFrame] = "overlap", normalize: bool = False, **options) -> DataFrame:
    """df with ``complexity`` by a registered measure or a function of the table."""
    if not callable(kind) and kind not in REGISTRY:
        raise ValueError(f"unknown hardness {kind!r}; known: {', '.join(sorted(REGISTRY))}")
    found = (kind if callable(kind) else REGISTRY[kind])(df, **options).select("row_id", "complexity")
    if normalize:
        span = found.agg(F.min("complexity").alias("low"), F.max("complexity").alias("high"), F.count(F.lit(1)).alias("n"))
        found = found.crossJoin(F.broadcast(span)).select("row_id", min_max(F.col("complexity"), F.col("low"), F.col("high"), F.col("n")).alias("complexity"))
    return df.join(found, "row_id")
