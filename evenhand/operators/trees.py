"""Decision trees, forests and bagging: all trees of all keys (members, folds, settings) grow together in one plan.

A node splits at one of BINS - 1 evenly spaced cuts of one feature's range inside the node, so the cuts get finer on the way
down. The best cut has the least Gini impurity; ties go to the lower feature, then to the lower cut. Nodes split until they
are pure, have no feature that varies, or are at the depth limit. Counts are whole numbers, so the result depends on the rows
alone.

Nodes with more than SMALL values are split level by level: one aggregate finds the ranges of all features in all nodes,
another counts (tree, node, feature, bin, class). Smaller nodes are grouped, and each finishes its subtree inside a task by the
same rules. A fitted model is a table of nodes; up to MOST_NODES of them are sent to all tasks for scoring, of more each group of
trees meets the rows in tasks of their own, and trees of over LARGEST nodes are joined with the rows level by level.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.functions.vectors import uniform
from evenhand.sources.staging import cut, spread

#: Bins of a feature's range, and the depth at which nodes are leaves. 2 ** 62 nodes are numbered in a long.
BINS, MAX_DEPTH = 32, 30
#: Values (rows times features) of a node that a task finishes, and nodes that are sent to all tasks.
SMALL, MOST_NODES = 600_000, 200_000
#: Counts that a task holds at once; nodes of a group of trees that meets rows in a task, and of the largest tree there.
CELLS, GROUP, LARGEST = 2_000_000, 400_000, 2_000_000
#: Rows of all trees that are worth a task.
TASK = 50_000


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0 to bins - 1 inside the range, below 0 to the left of it; the largest value is in the last bin."""
    return F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def _draw(seed: int, tree: str, node: int, feature: int) -> float:
    """The number that ``uniform`` gives for these keys."""
    return (int(hashlib.md5(f"{seed}:features:{tree}:{node}:{feature}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52


def _tried(low: np.ndarray, high: np.ndarray, nodes: np.ndarray, rule: Tree, tree: str) -> np.ndarray:
    """Of each node, which features are tried."""
    varies = high > low
    if rule.features is not None:
        for i in np.flatnonzero(varies.sum(1) > rule.features).tolist():
            node = int(nodes[i])
            drawn = sorted(np.flatnonzero(varies[i]).tolist(), key=lambda f: (_draw(rule.seed, tree, node, f), f))  # noqa: B023
            varies[i, drawn[rule.features :]] = False
    return varies


def _splits(x: np.ndarray, y: np.ndarray, w: np.ndarray, place: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, tried: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and cut of each node, and whether each row goes right; place tells the node of a row."""
    n_nodes, n_classes = counts.shape
    # the tried features of a node first, in their order
    among = np.argsort(~tried, axis=1, kind="stable")[:, : int(tried.sum(1).max())]
    some = np.take_along_axis(tried, among, 1)
    base, span = np.take_along_axis(low, among, 1), np.take_along_axis(high, among, 1) - np.take_along_axis(low, among, 1)
    value = np.take_along_axis(x, among[place], 1)
    bin_ = np.minimum(np.floor((value - base[place]) / np.where(some, span, 1.0)[place] * bins), bins - 1).astype(np.int64)
    bin_ = np.where(some[place], bin_, 0)
    width = among.shape[1]
    cells = ((place[:, None] * width + np.arange(width)) * bins + bin_) * n_classes + y[:, None]
    table = np.bincount(cells.ravel(), weights=np.repeat(w, width), minlength=n_nodes * width * bins * n_classes).reshape(n_nodes, width, bins, n_classes)
    left = table.cumsum(2)[:, :, :-1]
    right = counts[:, None, None, :] - left
    a, b = left.sum(3), right.sum(3)
    both = (a > 0) & (b > 0) & some[:, :, None]
    score = np.where(both, (left**2).sum(3) / np.where(both, a, 1) + (right**2).sum(3) / np.where(both, b, 1), -1.0).reshape(n_nodes, -1)
    best = np.argmax(score, 1)
    column, at = best // (bins - 1), best % (bins - 1) + 1
    return among[np.arange(n_nodes), column], at, bin_[np.arange(len(place)), column[place]] >= at[place]


def _subtree(x: np.ndarray, y: np.ndarray, w: np.ndarray, n_classes: int, root: int, depth: int, rule: Tree, tree: str) -> tuple[np.ndarray, ...]:
    """node, feature, low, high, cut and class counts of all nodes below and with ``root``; feature -1 in leaves.

    All nodes of a level are split at once, in stretches of CELLS counts; rows lie by node.
    """
    nodes, place, found = np.array([root], np.int64), np.zeros(len(x), np.int64), []
    while len(nodes):
        counts = np.bincount(place * n_classes + y, weights=w, minlength=len(nodes) * n_classes).reshape(len(nodes), n_classes)
        feature, at = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes), np.int32)
        low, high = np.zeros((2, len(nodes)))
        impure = (counts > 0).sum(1) > 1 if depth < rule.max_depth else np.zeros(len(nodes), bool)
        keep = impure[place]
        x, y, w, place = x[keep], y[keep], w[keep], (np.cumsum(impure) - 1)[place[keep]]
        open_ = np.flatnonzero(impure)
        goes = np.zeros(len(x), bool)
        split = np.zeros(len(open_), bool)
        if len(open_):
            starts = np.searchsorted(place, np.arange(len(open_) + 1))
            lows, highs = np.minimum.reduceat(x, starts[:-1], axis=0), np.maximum.reduceat(x, starts[:-1], axis=0)
            tried = _tried(lows, highs, nodes[open_], rule, tree)
            split = tried.any(1)
            step = max(1, CELLS // (int(tried.sum(1).max() or 1) * rule.bins * n_classes))
            where = np.flatnonzero(split)
            for begin in range(0, len(where), step):
                part = where[begin : begin + step]
                rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part.tolist()]) if len(part) < part[-1] - part[0] + 1 else np.arange(starts[part[0]], starts[part[-1] + 1])
                own = np.searchsorted(part, place[rows])
                f, c, goes[rows] = _splits(x[rows], y[rows], w[rows], own, counts[open_[part]], lows[part], highs[part], tried[part], rule.bins)
                feature[open_[part]], at[open_[part]], low[open_[part]], high[open_[part]] = f, c, lows[part, f], highs[part, f]
        found.append((nodes, feature, low, high, at, counts.astype(np.int64)))
        keep = split[place]
        x, y, w, goes, below = x[keep], y[keep], w[keep], goes[keep], 2 * (np.cumsum(split) - 1)[place[keep]]
        order = np.argsort(below + goes, kind="stable")
        x, y, w, place = x[order], y[order], w[order], (below + goes)[order]
        nodes = (2 * nodes[open_[split]][:, None] + np.arange(2)).ravel()
        depth += 1
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as rows of a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _values(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class Tree:
    """fit(rows, *keys) grows one tree for each value of the keys. Rows have label and features, and maybe a whole ``weight``.

    With ``features`` only so many of those that vary in a node are tried, drawn by the tree and node.
    """

    max_depth: int = MAX_DEPTH
    bins: int = BINS
    features: int | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        if not 1 <= self.max_depth <= 60 or self.bins < 2:
            raise ValueError("max_depth must be from 1 to 60 and bins at least 2")

    def fit(self, rows: DataFrame, *keys: str) -> TreeModel:
        weight = F.col("weight").cast("long") if "weight" in rows.columns else F.lit(1).cast("long")
        state = rows.select(*keys, "label", "features", weight.alias("w")).where("w > 0").withColumn("node", F.lit(1).cast("long")).withColumn("depth", F.lit(0))
        return self._grown(state, keys, rows.groupBy(*keys))

    def _grown(self, state: DataFrame, keys: tuple[str, ...], trees: GroupedData, bags: int = 1) -> TreeModel:
        """The trees of ``state``; ``trees`` groups rows with features, at least as many in a group as each of ``bags`` trees has."""
        got = trees.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")).agg(F.max("n"), F.max("width"), F.sum("n")).first()
        work = (got[2] or 0) * bags / TASK
        if (got[0] or 0) * (got[1] or 1) <= SMALL:
            return TreeModel(cut(self._finished(state, keys, work)), keys, self.bins)
        most = SMALL // (got[1] or 1)
        state = cut(state)
        by, done = [*keys, "node"], []
        while True:
            sizes = state.groupBy(*by).agg((F.count(F.lit(1)) > most).alias("large"))
            large = cut(sizes.where("large").select(*by))
            if large.isEmpty():
                done.append(self._finished(state, keys, work))
                break
            done.append(self._finished(state.join(large, by, "left_anti"), keys, work))
            split, state = self._level(state.join(large, by), keys)
            done.append(split)
        nodes = done[0]
        for part in done[1:]:
            nodes = nodes.unionByName(part)
        return TreeModel(cut(nodes), keys, self.bins)

    def _schema(self, rows: DataFrame, keys: tuple[str, ...]) -> T.StructType:
        counts = T.ArrayType(T.StructType([T.StructField("class", rows.schema["label"].dataType), T.StructField("n", T.LongType())]))
        more = (("node", T.LongType()), ("feature", T.IntegerType()), ("low", T.DoubleType()), ("high", T.DoubleType()), ("cut", T.IntegerType()), ("counts", counts))
        return T.StructType([*(rows.schema[k] for k in keys), *(T.StructField(n, t) for n, t in more)])

    def _finished(self, state: DataFrame, keys: tuple[str, ...], work: float) -> DataFrame:
        """The subtrees of nodes of SMALL values at most, each in a task."""
        schema, rule = self._schema(state, keys), self

        def grow(part: pa.Table) -> pa.Table:
            classes, y = np.unique(_values(part["label"]), return_inverse=True)
            first = {k: part[k][0] for k in keys}
            tree = ":".join(str(first[k].as_py()) for k in keys)
            found = _subtree(_vectors(part["features"]), y, _values(part["w"]).astype(float), len(classes), part["node"][0].as_py(), part["depth"][0].as_py(), rule, tree)
            which, code = np.nonzero(found[5])
            ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(found[0])))]).astype(np.int32)
            counts = pa.StructArray.from_arrays([pa.array(classes, part["label"].type).take(pa.array(code)), pa.array(found[5][which, code])], ["class", "n"])
            made = {k: pa.repeat(v, len(found[0])) for k, v in first.items()} | {n: pa.array(c) for n, c in zip(("node", "feature", "low", "high", "cut"), found, strict=False)}
            return pa.table(made | {"counts": pa.ListArray.from_arrays(pa.array(ends), counts)})

        return spread(state, work, *keys, "node").groupBy(*keys, "node").applyInArrow(grow, schema)

    def _level(self, state: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        """The nodes of one level, and the rows in their children."""
        by = [*keys, "node"]
        classes = state.groupBy(*by, "label", "depth").agg(F.sum("w").alias("n"))
        counts = cut(classes.groupBy(*by, "depth").agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("class"), "n"))).alias("counts")))
        impure = counts.where((F.size("counts") > 1) & (F.col("depth") < self.max_depth)).select(*by)
        cells = state.join(impure, by).select(*by, F.posexplode("features").alias("feature", "v"))
        ranges = cells.groupBy(*by, "feature").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("high > low")
        if self.features is not None:
            tree = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
            drawn = Window.partitionBy(*by).orderBy(uniform(self.seed, "features", tree, F.col("node"), F.col("feature")), "feature")
            ranges = ranges.withColumn("~d", F.row_number().over(drawn)).where(F.col("~d") <= self.features).drop("~d")
        ranges = cut(ranges)
        packed = ranges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("feature", "low", "high"))).alias("r"))
        # an entry for each feature of each row, aggregated before it is shuffled
        entry = F.transform("r", lambda r: F.struct(r["feature"].alias("feature"), bin_of(F.element_at(F.col("features"), r["feature"] + 1), r["low"], r["high"], self.bins).alias("bin")))
        binned = state.join(packed, by).select(*by, "label", "w", F.explode(entry).alias("e"))
        table = binned.groupBy(*by, "e.feature", "e.bin", "label").agg(F.sum("w").alias("n"))
        at = [*by, "feature"]
        sums = table.groupBy(*at, "bin").agg(F.collect_list(F.struct("label", "n")).alias("c"))
        # at most BINS rows of a feature meet
        upto = Window.partitionBy(*at).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        flat = sums.withColumn("~l", F.flatten(F.collect_list("c").over(upto)))
        left = flat.select(*at, (F.col("bin") + 1).alias("cut"), F.explode("~l").alias("x")).groupBy(*at, "cut", "x.label").agg(F.sum("x.n").alias("l"))
        whole = table.groupBy(*at, "label").agg(F.sum("n").alias("t"))
        cuts = left.select(*at, "cut").distinct().join(whole, at).join(left, [*at, "cut", "label"], "left").withColumn("l", F.coalesce("l", F.lit(0)))
        right = F.col("t") - F.col("l")
        square = lambda c: F.sum(c * c).cast("double")
        scored = cuts.groupBy(*at, "cut").agg((square(F.col("l")) / F.sum("l") + square(right) / F.when(F.sum(right) > 0, F.sum(right))).alias("score")).where("score IS NOT NULL")
        best = scored.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("s"), "feature", "cut")).alias("b")).select(*by, F.col("b.feature").alias("feature"), F.col("b.cut").alias("cut"))
        best = cut(best.join(ranges, at))
        nodes = counts.join(best, by, "left").select(*by, F.coalesce("feature", F.lit(-1)).alias("feature"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"), F.coalesce("cut", F.lit(0)).alias("cut"), "counts")
        goes = bin_of(F.element_at(F.col("features"), F.col("feature") + 1), F.col("low"), F.col("high"), self.bins) >= F.col("cut")
        below = state.join(best, by).select(*keys, "label", "features", "w", (F.col("node") * 2 + goes.cast("long")).alias("node"), (F.col("depth") + 1).alias("depth"))
        return nodes, cut(below)


@dataclass(frozen=True)
class Forest:
    """Trees on keyed bootstrap bags: each row counts as often in a bag as a Poisson draw of mean 1 by its key and the tree says.
    Each node tries as many features as the root of their number, rounded up; with ``every`` all (bagging)."""

    trees: int = 10
    every: bool = False
    max_depth: int = MAX_DEPTH
    seed: int = 42

    def fit(self, rows: DataFrame, *keys: str) -> ForestModel:
        width = rows.select(F.size("features")).first()
        tried = None if self.every or width is None else int(np.ceil(np.sqrt(width[0])))
        # synthetic rows of a resampled table have a slot instead of an id
        ids = [F.col(c) for c in ("row_id", "slot") if c in rows.columns]
        limits, part = [], exp(-1.0)
        for n in range(1, 12):
            limits.append((limits[-1] if limits else 0.0) + part)
            part /= n
        # drawn once for each row and tree: as columns the draws would be computed for each limit again
        drawn = F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.struct(t.alias("tree"), uniform(self.seed, "bag", t, *ids).alias("u")))
        times = lambda u: sum(((u >= F.lit(b)).cast("long") for b in limits), F.lit(0).cast("long"))
        counted = F.filter(F.transform(drawn, lambda x: F.struct(x["tree"].alias("tree"), times(x["u"]).alias("w"))), lambda x: x["w"] > 0)
        bags = rows.select(*keys, "label", "features", F.explode(counted).alias("~b"))
        state = bags.select(*keys, "~b.tree", "label", "features", "~b.w", F.lit(1).cast("long").alias("node"), F.lit(0).alias("depth"))
        rule = Tree(self.max_depth, features=tried, seed=self.seed)
        return ForestModel(rule._grown(state, (*keys, "tree"), rows.groupBy(*keys), self.trees), self.trees)


class _Packed:
    """The trees of a table of nodes (with ``classes`` and ``ns``, the counts) in arrays."""

    def __init__(self, nodes: pa.Table, keys: tuple[str, ...], bins: int) -> None:
        self.bins, self.keys, self.trees = bins, keys, {}
        self.kinds = {k: nodes[k].type for k in keys} | {"class": nodes["classes"].type.value_type}
        self.classes, code = np.unique(_values(pa.chunked_array([nodes["classes"].combine_chunks().flatten()])), return_inverse=True)
        n = nodes["ns"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        size = nodes["ns"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        p = n / np.repeat(np.add.reduceat(n, start), size) if len(n) else np.zeros(0)
        node, columns = _values(nodes["node"]), [_values(nodes[c]) for c in ("feature", "low", "high", "cut")]
        which = pd.MultiIndex.from_arrays([_values(nodes[k]) for k in keys]).factorize(sort=True) if keys else (np.zeros(len(node), np.int64), [()])
        order = np.lexsort((node, which[0]))
        bounds = np.searchsorted(which[0][order], np.arange(len(which[1]) + 1))
        for i, key in enumerate(which[1]) if len(node) else ():
            at = order[bounds[i] : bounds[i + 1]]
            child = np.searchsorted(node[at], 2 * node[at])
            held = np.repeat(start[at], size[at]) + _inside(size[at])
            leaf = (np.cumsum(size[at]) - size[at], size[at], code[held], p[held])
            self.trees[key if isinstance(key, tuple) else (key,)] = (child, *(c[at] for c in columns), leaf, node[at])

    def leaves(self, key: tuple, x: np.ndarray) -> np.ndarray:
        """Places of the leaves that the rows of x come to."""
        child, feature, low, high, at = self.trees[key][:5]
        place = np.zeros(len(x), np.int64)
        inner = np.arange(len(x))
        while (inner := inner[feature[place[inner]] >= 0]).size:
            here = place[inner]
            f = feature[here]
            bins = np.minimum(np.floor((x[inner, f] - low[here]) / (high[here] - low[here]) * self.bins), self.bins - 1)
            place[inner] = child[here] + (bins >= at[here])
        return place

    def chances(self, key: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the row in x, code of the class and p."""
        place, (start, size, code, p) = self.leaves(key, x), self.trees[key][5]
        held = np.repeat(start[place], size[place]) + _inside(size[place])
        return np.repeat(np.arange(len(x)), size[place]), code[held], p[held]


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each stretch."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _scored(trees: _Packed, rows: pa.Table, own: tuple[str, ...], what: str):
    """What the trees say of the rows: the ``leaf`` of each, the ``class`` and p of each, or their ``sum`` over the last key."""
    x = _vectors(rows["features"])
    at = [trees.keys.index(k) for k in own]
    mine = pd.MultiIndex.from_arrays([_values(rows[k]) for k in own]) if own else None
    found, sums = (mine.factorize() if own else (np.zeros(len(x), np.int64), None)), {}
    places = {tuple(k): np.flatnonzero(found[0] == i) for i, k in enumerate(found[1])} if own else {(): np.arange(len(x))}
    classes = pa.array(trees.classes, trees.kinds["class"])

    def made(key: tuple, who: np.ndarray, **more) -> pa.Table:
        columns = {k: pa.repeat(pa.scalar(v, trees.kinds[k]), len(who)) for k, v in zip(trees.keys, key, strict=False)}
        return pa.table(columns | {c: rows[c].take(pa.array(who)) for c in ("row_id", "label")} | more)

    for key, tree in trees.trees.items():
        which = places.get(tuple(key[i] for i in at), np.zeros(0, np.int64))
        if not len(which):
            continue
        if what == "leaf":
            yield made(key, which, node=pa.array(tree[6][trees.leaves(key, x[which])]))
            continue
        who, code, p = trees.chances(key, x[which])
        if what == "class":
            yield made(key, which[who], **{"class": classes.take(pa.array(code)), "p": pa.array(p)})
        else:
            total = sums.setdefault(key[:-1], (which, np.zeros((len(which), len(trees.classes)))))[1]
            total[who, code] += p
    for key, (which, total) in sums.items():
        who, code = np.nonzero(total)
        yield made(key, which[who], **{"class": classes.take(pa.array(code)), "p": pa.array(total[who, code])})


@dataclass(frozen=True)
class TreeModel:
    """nodes: keys..., node (1, its children 2 and 3, ...), feature (-1: leaf), low, high, cut and counts of classes."""

    nodes: DataFrame
    keys: tuple[str, ...] = ()
    bins: int = BINS

    def _flat(self) -> DataFrame:
        return self.nodes.select(*self.keys, "node", "feature", "low", "high", "cut", F.col("counts.class").alias("classes"), F.col("counts.n").alias("ns"))

    def packed(self) -> _Packed | None:
        """All trees in arrays, if they have MOST_NODES nodes at most."""
        return _Packed(self._flat().toArrow(), self.keys, self.bins) if self.nodes.count() <= MOST_NODES else None

    def probabilities(self, rows: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
        """keys..., row_id, label, class, p by each tree, classes with p above 0 only. Of the keys in ``own``, which are columns
        of the rows too, a row meets only trees with the same values."""
        found = self._scores(rows, own, "class")
        return self._joined(rows, own) if found is None else found

    def summed(self, rows: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
        """keys... but the last, row_id, label, class and p, summed over some of the trees in each row of the result."""
        found = self._scores(rows, own, "sum")
        return self._joined(rows, own).drop(self.keys[-1]) if found is None else found

    def leaves(self, rows: DataFrame) -> DataFrame:
        """keys..., row_id, label and the node of the leaf that each row comes to in each tree."""
        found = self._scores(rows, (), "leaf")
        return self._ends(rows, ()).select(*self.keys, "row_id", "label", "node") if found is None else found

    def _scores(self, rows: DataFrame, own: tuple[str, ...], what: str) -> DataFrame | None:
        """What ``_scored`` gives, by trees that are sent to all tasks or that rows meet in groups; None if a tree is too large for a
        task."""
        rows = rows.select(*dict.fromkeys(["row_id", "label", "features", *own]))
        kept = self.keys[:-1] if what == "sum" else self.keys
        ends = [T.StructField("node", T.LongType())] if what == "leaf" else [T.StructField("class", self.nodes.schema["counts"].dataType.elementType["class"].dataType), T.StructField("p", T.DoubleType())]
        schema = T.StructType([*(self.nodes.schema[k] for k in kept), rows.schema["row_id"], rows.schema["label"], *ends])
        names, trees = schema.names, self.packed()
        if trees is None:
            return self._met(rows, own, what, schema)
        shipped = rows.sparkSession.sparkContext.broadcast(trees)

        def score(batches):
            for batch in batches:
                for made in _scored(shipped.value, pa.Table.from_batches([batch]), own, what):
                    yield from made.select(names).to_batches()

        return rows.mapInArrow(score, schema)

    def _met(self, rows: DataFrame, own: tuple[str, ...], what: str, schema: T.StructType) -> DataFrame | None:
        """Groups of trees with some GROUP nodes together, and the rows that they score, dealt into parts: each pair of a group and a
        part meets in a task, so a row is sent once for each group."""
        before = Window.partitionBy(*own).orderBy(*(k for k in self.keys if k not in own)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sizes = self.nodes.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))  # one row for each tree
        groups = cut(sizes.withColumn("~g", F.floor((F.sum("n").over(before) - 1) / GROUP)))
        if groups.agg(F.max("n")).first()[0] > LARGEST:
            return None
        keys, bins, names, by = self.keys, self.bins, schema.names, [*own, "~g"]
        values, n = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")).agg(F.max(F.col("n") * F.col("width")), F.sum("n")).first()
        parts = max(1, -(-(values or 0) // SMALL))
        asked = groups.select(*by).distinct()
        left = rows.withColumn("~p", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int"))
        left = left.join(F.broadcast(asked), list(own)) if own else left.crossJoin(F.broadcast(asked))
        right = self._flat().join(F.broadcast(groups.select(*keys, F.col("~g").alias("~h"))), list(keys)).withColumn("~q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            kinds = {k: right[k].type for k in keys} | {k: left[k].type for k in ("row_id", "label")} | {"class": right["classes"].type.value_type, "p": pa.float64(), "node": pa.int64()}
            made = [t.select(names) for t in _scored(_Packed(right, keys, bins), left, own, what)] if len(left) and len(right) else []
            return pa.concat_tables(made) if made else pa.table({n: pa.array([], kinds[n]) for n in names})

        work = (n or 0) * groups.count() / TASK
        left, right = spread(left, work, *by, "~p"), spread(right, work, *own, "~h", "~q")
        return left.groupBy(*by, "~p").cogroup(right.groupBy(*own, "~h", "~q")).applyInArrow(meet, schema)

    def votes(self, rows: DataFrame, trees_of: int = 1) -> DataFrame | None:
        """rows with ``votes``: the classes and their p by each tree, or the means of each ``trees_of`` trees that follow each other;
        None if the model is too large to be sent. A transform of single rows, for streams too."""
        trees = self.packed()
        if trees is None:
            return None
        shipped = rows.sparkSession.sparkContext.broadcast(trees)
        kind = self.nodes.schema["counts"].dataType.elementType["class"].dataType
        vote = T.ArrayType(T.ArrayType(T.StructType([T.StructField("class", kind), T.StructField("p", T.DoubleType())])))
        schema = T.StructType([*rows.schema.fields, T.StructField("votes", vote)])

        def score(batches):
            known = shipped.value
            keys, classes = list(known.trees), known.classes.tolist()
            for batch in batches:
                x = np.array(batch["features"].tolist(), float).reshape(len(batch), -1)
                votes: list[list] = [[] for _ in range(len(batch))]
                for at in range(0, len(keys), trees_of):
                    total = np.zeros((len(batch), len(classes)))
                    for key in keys[at : at + trees_of]:
                        who, code, p = known.chances(key, x)
                        total[who, code] += p
                    for mine, out in zip(total.tolist(), votes, strict=True):
                        out.append([{"class": c, "p": round(p / trees_of, 12)} for c, p in zip(classes, mine, strict=True) if p])
                yield batch.assign(votes=votes)

        return rows.mapInPandas(score, schema)

    def _joined(self, rows: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
        """The same by joins, one for each level, for models that are too large to be sent."""
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + c["n"])
        ends = self._ends(rows, own).select(*self.keys, "row_id", "label", total.alias("t"), F.explode("counts").alias("c"))
        return ends.select(*self.keys, "row_id", "label", F.col("c.class").alias("class"), (F.col("c.n") / F.col("t")).alias("p"))

    def _ends(self, rows: DataFrame, own: tuple[str, ...]) -> DataFrame:
        """Rows at their leaves, with its columns."""
        others = [k for k in self.keys if k not in own]
        roots = self.nodes.where("node = 1").select(*self.keys)
        # one row for each tree
        state = rows.select("row_id", "label", "features", *own)
        state = (state.join(roots, list(own)) if own else state.crossJoin(F.broadcast(roots))).select("row_id", "label", "features", *own, *others, F.lit(1).cast("long").alias("node"))
        by, done = [*self.keys, "node"], None
        while True:
            met = cut(state.join(self.nodes, by))
            ends = met.where("feature < 0").select(*by, "row_id", "label", "counts")
            done = ends if done is None else done.unionByName(ends)
            inner = met.where("feature >= 0")
            if inner.isEmpty():
                return done
            goes = bin_of(F.element_at(F.col("features"), F.col("feature") + 1), F.col("low"), F.col("high"), self.bins) >= F.col("cut")
            state = inner.select("row_id", "label", "features", *self.keys, (F.col("node") * 2 + goes.cast("long")).alias("node"))

    def pruned(self, alpha: float) -> TreeModel:
        """The smallest subtree of least cost: impurity of the leaves, weighted by their share of the rows, plus alpha for each leaf.

        From the deepest nodes upwards: a node becomes a leaf if that costs no more than its children do. All trees go up level
        by level together.
        """
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + c["n"])
        squares = F.aggregate("counts", F.lit(0.0), lambda t, c: t + c["n"].cast("double") * c["n"])
        depth = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
        own = self.nodes.select(*self.keys, "node", "feature", depth.alias("depth"), (total - squares / total).alias("impurity"), total.alias("n"))
        own = cut(own)
        whole = own.where("node = 1").select(*self.keys, (F.col("n") * F.lit(float(alpha))).alias("price"))
        priced = own.join(F.broadcast(whole), list(self.keys)) if self.keys else own.crossJoin(F.broadcast(whole))  # one row for each tree
        deepest = own.agg(F.max("depth")).first()[0]
        leaves, below, by = None, None, [*self.keys, "node"]
        for level in range(deepest if deepest is not None else -1, -1, -1):
            here = priced.where(F.col("depth") == level).withColumn("alone", F.col("impurity") + F.col("price"))
            if below is None:
                here = here.withColumn("children", F.lit(None).cast("double"))
            else:
                costs = below.groupBy(*self.keys, F.shiftright("node", 1).alias("node")).agg(F.sum("cost").alias("children"))
                here = here.join(costs, by, "left")
            leaf = (F.col("feature") < 0) | (F.col("alone") <= F.col("children"))
            below = cut(here.select(*by, leaf.alias("leaf"), F.when(leaf, F.col("alone")).otherwise(F.col("children")).alias("cost")))
            now = below.where("leaf").select(*by)
            leaves = now if leaves is None else leaves.unionByName(now)
        if leaves is None:
            return self
        # nodes with a leaf above them go
        up = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("node").cast("double"))).cast("int")), lambda i: F.call_function("shiftright", F.col("node"), i))
        above = self.nodes.select(*by, F.explode(up).alias("up")).join(leaves.select(*self.keys, F.col("node").alias("up"), F.lit(True).alias("is_leaf")), [*self.keys, "up"])
        top = above.groupBy(*by).agg(F.min("up").alias("top"))
        kept = self.nodes.join(top, by, "left").where("top IS NULL OR top = node")
        return TreeModel(cut(kept.withColumn("feature", F.when(F.col("top").isNotNull(), -1).otherwise(F.col("feature"))).select(*self.nodes.columns)), self.keys, self.bins)


@dataclass(frozen=True)
class ForestModel:
    model: TreeModel
    trees: int

    @property
    def keys(self) -> tuple[str, ...]:
        return self.model.keys[:-1]

    def probabilities(self, rows: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
        """Means over the trees, to 12 places, so that the order of summing doesn't matter; a class that a tree lacks counts 0."""
        each = self.model.summed(rows, own)
        return each.groupBy(*self.keys, "row_id", "label", "class").agg(F.round(F.sum("p") / self.trees, 12).alias("p"))

    def votes(self, rows: DataFrame) -> DataFrame | None:
        return self.model.votes(rows, self.trees)
