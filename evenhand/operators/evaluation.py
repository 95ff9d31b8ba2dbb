"""Splits, folds and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.vectors import uniform
from evenhand.operators.ranking import by_uniform, in_order, medians, ranked
from evenhand.sources.staging import cut, once


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def stratified_split(df: DataFrame, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """row_id, label, is_test: of each class the nearest whole number of rows, drawn by keyed uniforms."""
    keyed = df.select("row_id", "label", uniform(seed, "split", F.col("row_id")).alias("u"))
    numbered = ranked(keyed, ["label"], by_uniform(F.col("u")), ["u", "row_id"], "rk").join(F.broadcast(class_counts(df)), "label")
    return numbered.select("row_id", "label", (F.col("rk") <= F.floor(F.col("n") * test_share + 0.5)).alias("is_test"))


def stratified_folds(df: DataFrame, folds: int = 5, shuffle: bool = False, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., row_id, label, fold: classes in the order of first appearance are dealt to folds in turn, and the rows of a class
    go to its folds in runs (shuffled: in the order of keyed uniforms)."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    keys = [*by, "label"]
    classes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    before = Window.partitionBy(*by).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row for each class
    starts = classes.withColumn("o", F.coalesce(F.sum("n").over(before), F.lit(0)))
    dealt = starts.select(*keys, "n", "o", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    # places o .. o + n - 1 hold this many p with p % folds == fold
    upto = lambda p: F.floor((p - 1 - F.col("fold")) / folds) + 1
    dealt = dealt.withColumn("size", upto(F.col("o") + F.col("n")) - upto(F.col("o")))
    sums = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = dealt.withColumn("end", F.sum("size").over(sums)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("fold", "end"))).alias("ends"))
    if shuffle:
        keyed = df.select(*keys, "row_id", uniform(seed, "fold", F.col("row_id")).alias("u"))
        numbered = ranked(keyed, keys, by_uniform(F.col("u")), ["u", "row_id"], "rk")
    else:
        numbered = in_order(df.select(*keys, "row_id"), keys, "row_id", "rk")
    return numbered.join(F.broadcast(ends), keys).select(*by, "row_id", "label", F.filter("ends", lambda e: F.col("rk") <= e["end"])[0]["fold"].alias("fold"))


def in_folds(df: DataFrame, folds: int, shuffle: bool = False, seed: int = 42, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of all folds at once: a row trains for every fold ``held`` but its own, in which it is tested."""
    df = once(df)
    assigned = cut(df.join(stratified_folds(df, folds, shuffle, seed, by), [*by, "row_id", "label"]))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold")))
    return assigned.withColumn("held", others).drop("fold"), assigned.withColumnRenamed("fold", "held")


def confusion(pred: DataFrame) -> DataFrame:
    """label, pred, n."""
    return pred.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(pred: DataFrame, positive=1, *by: str) -> DataFrame:
    """by..., tn, fp, fn, tp, accuracy, recall, precision and f1 of the positive class; 0 where a denominator is."""
    yes, said = F.col("label") == F.lit(positive), F.col("pred") == F.lit(positive)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    cells = pred.groupBy(*by).agg(count(~yes & ~said).alias("tn"), count(~yes & said).alias("fp"), count(yes & ~said).alias("fn"), count(yes & said).alias("tp"))
    return cells.select("*", _ratio("tn + tp", "tn + fp + fn + tp").alias("accuracy"), _ratio("tp", "tp + fn").alias("recall"), _ratio("tp", "tp + fp").alias("precision"), _ratio("2 * tp", "2 * tp + fp + fn").alias("f1"))


def _ratio(a: str, b: str):
    return F.expr(f"CASE WHEN {b} > 0 THEN ({a}) / cast({b} AS double) ELSE 0e0 END")


def per_class(pred: DataFrame, *by: str) -> DataFrame:
    """by..., label, precision, recall, f1, support of each true or predicted class."""
    flat = pred.select(*by, F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("label") == F.col("pred")).cast("int").alias("h")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("x"))
    cells = flat.groupBy(*by, F.col("x.c").alias("label")).agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum("x.h").alias("h"))
    return cells.select(*by, "label", _ratio("h", "p").alias("precision"), _ratio("h", "t").alias("recall"), _ratio("2 * h", "t + p").alias("f1"), F.col("t").alias("support"))


def weighted_f1(pred: DataFrame, *by: str) -> DataFrame:
    return per_class(pred, *by).groupBy(*by).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def report(pred: DataFrame) -> DataFrame:
    """The rows of per_class, and accuracy, macro avg and weighted avg."""
    each = per_class(pred)
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    macro = each.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), "*")
    weighted = each.agg(*(mean(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), "*")
    hit = F.avg((F.col("label") == F.col("pred")).cast("double"))
    accuracy = pred.agg(hit.alias("precision"), hit.alias("recall"), hit.alias("f1"), F.count(F.lit(1)).alias("support")).select(F.lit("accuracy").alias("label"), "*")
    return each.withColumn("label", F.col("label").cast("string")).unionByName(accuracy).unionByName(macro).unionByName(weighted)


def roc_auc(scored: DataFrame, positive=1, *by: str) -> DataFrame:
    """by..., auc: area under the ROC curve of ``score``, ties counted half: from counts by distinct score, range-partitioned at
    sampled quantiles, so that windows run over the distinct scores of one partition only, however they are spread."""
    yes = (F.col("label") == F.lit(positive)).cast("long")
    counts = cut(scored.groupBy(*by, "score").agg(F.sum(yes).alias("p"), F.sum(1 - yes).alias("n")))
    ranged = cut(counts.repartitionByRange(*by, "score").withColumn("part", F.spark_partition_id()))
    over = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = ranged.groupBy(*by, "part").agg(F.sum("n").alias("n")).select(*by, "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("below"))
    inside = Window.partitionBy(*by, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.join(parts, [*by, "part"]).withColumn("under", F.col("below") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return numbered.groupBy(*by).agg((F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """mean, population std, min and max of ``score``."""
    return scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))


def hardness_statistics(df: DataFrame) -> DataFrame:
    """mean, std, min, max, median of complexity, overall (null label) and by class."""
    df = cut(df.select("label", "complexity"))
    c, key = F.col("complexity"), F.coalesce(F.concat(F.lit("of "), F.col("label").cast("string")), F.lit("all")).alias("~k")
    stats = df.rollup("label").agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).select("*", key)
    twice = df.select(F.explode(F.array(F.concat(F.lit("of "), F.col("label").cast("string")), F.lit("all"))).alias("~k"), "complexity")
    return stats.join(F.broadcast(medians(twice, "~k", "complexity")), "~k").drop("~k")


def scores(probabilities: DataFrame, positive=1, *by: str) -> DataFrame:
    """by..., row_id, label, pred (the class with the largest p, the smallest among equals) and score (p of the positive
    class; 0 if it has none)."""
    best = F.min(F.struct((-F.col("p")).alias("n"), "class"))["class"]
    return probabilities.groupBy(*by, "row_id", "label").agg(best.alias("pred"), F.coalesce(F.max(F.when(F.col("class") == F.lit(positive), F.col("p"))), F.lit(0.0)).alias("score"))


def all_metrics(scored: DataFrame, positive=1, *by: str) -> DataFrame:
    """by..., accuracy, precision, recall, f1 and auc of each group of scored rows (label, pred, score)."""
    yes, said = F.col("label") == F.lit(positive), F.col("pred") == F.lit(positive)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    cells = scored.groupBy(*by).agg(count(~yes & ~said).alias("tn"), count(~yes & said).alias("fp"), count(yes & ~said).alias("fn"), count(yes & said).alias("tp"))
    out = cells.select(*by, _ratio("tn + tp", "tn + fp + fn + tp").alias("accuracy"), _ratio("tp", "tp + fp").alias("precision"), _ratio("tp", "tp + fn").alias("recall"), _ratio("2 * tp", "2 * tp + fp + fn").alias("f1"))
    area = roc_auc(scored, positive, *by)
    return out.join(F.broadcast(area), list(by)) if by else out.crossJoin(F.broadcast(area))


def winners(table: DataFrame, metrics: tuple[str, ...] = ("f1", "auc", "recall")) -> DataFrame:
    """metric, name and value of the best row for each metric; table has ``position`` and name, the first of equals wins."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("x")
    best = table.select("position", "name", each).groupBy("x.metric").agg(F.min(F.struct((-F.col("x.value")).alias("n"), "position", "name")).alias("b"))
    return best.select("metric", F.col("b.name").alias("name"), (-F.col("b.n")).alias("value"))
