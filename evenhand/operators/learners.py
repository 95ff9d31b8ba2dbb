"""Base learners: fit(rows, *keys) gives a model for each value of the keys, all in one plan.

A model's probabilities(rows, own) are (keys..., row_id, label, class, p); ``own`` names keys that the rows have too, and a row
then meets only the models with its values. votes(rows) are the rows with all models' opinions beside each, without any
aggregation, so that streams can be scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.vectors import distance
from evenhand.operators.trees import Forest, Tree  # noqa: F401  the other learners
from evenhand.sources.staging import cut

#: A variance of a feature in a class is at least this share of the largest variance of a feature.
LEAST_VARIANCE = 1e-9


def centroids(df: DataFrame, *keys: str) -> DataFrame:
    """keys..., label and the mean vector of each class: partial sums by feature, then one row for each class."""
    keys = (*keys, "label")
    cells = df.select(*keys, F.posexplode("features").alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("m"))
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c")).select(*keys, F.transform("c", lambda x: x["m"]).alias("centroid"))


@dataclass(frozen=True)
class NearestCentroid:
    """Probabilities in proportion to 1 / (1 + distance to the class mean)."""

    def fit(self, rows: DataFrame, *keys: str) -> ClassModel:
        means = centroids(rows, *keys).withColumnRenamed("label", "class")
        return ClassModel(cut(means), keys, self)

    def score(self, features: Column, fitted: Column) -> Column:
        return 1 / (1 + distance(features, fitted["centroid"]))


@dataclass(frozen=True)
class NaiveBayes:
    """Gaussian naive Bayes: for each class the share of rows, and of each feature mean and variance, by partial sums. To each
    variance LEAST_VARIANCE of the largest variance of a feature over all rows is added. A column ``weight`` counts."""

    def fit(self, rows: DataFrame, *keys: str) -> ClassModel:
        w = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
        # partial sums by feature and class; values are taken around the mean of the feature, so that squares stay exact enough
        cells = rows.select(*keys, F.col("label").alias("class"), w.alias("w"), F.posexplode("features").alias("pos", "v"))
        by = [*keys, "class", "pos"]
        means = cells.groupBy(*by).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
        whole = cells.groupBy(*keys, "pos").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("wm"))
        # one row for each class and feature
        spread = cells.join(F.broadcast(means), by).join(F.broadcast(whole), [*keys, "pos"])
        sums = spread.groupBy(*by).agg(F.max("m").alias("m"), F.sum("w").alias("w"), (F.sum(F.col("w") * (F.col("v") - F.col("m")) ** 2) / F.sum("w")).alias("s"), F.sum(F.col("w") * (F.col("v") - F.col("wm")) ** 2).alias("ws"))
        sums = cut(sums)
        total = sums.groupBy(*keys, "pos").agg((F.sum("ws") / F.sum("w")).alias("v"), F.sum("w").alias("all")).groupBy(*keys).agg(F.max("v").alias("v"), F.max("all").alias("all"))
        met = sums.join(F.broadcast(total), list(keys)) if keys else sums.crossJoin(F.broadcast(total))
        each = F.struct("pos", "m", (F.col("s") + LEAST_VARIANCE * F.col("v")).alias("s"))
        fitted = met.groupBy(*keys, "class").agg(F.array_sort(F.collect_list(each)).alias("g"), F.log(F.max("w") / F.max("all")).alias("prior"))
        return ClassModel(cut(fitted), keys, self)

    def score(self, features: Column, fitted: Column) -> Column:
        """exp of the log joint density, less a shift that all classes share: see ``ClassModel.scored``."""
        return log_density(features, fitted["g"]) + fitted["prior"]


def log_density(features: Column, fitted: Column) -> Column:
    """Log density of a vector under independent normals (pos, m, s); a variance of 0 allows the mean alone."""
    one = lambda x, g: F.when(g["s"] > 0, -0.5 * (F.log(2 * F.pi() * g["s"]) + (x - g["m"]) * (x - g["m"]) / g["s"])).when(x == g["m"], F.lit(0.0)).otherwise(F.lit(float("-inf")))
    return F.aggregate(F.zip_with(features, fitted, one), F.lit(0.0), lambda t, x: t + x)


@dataclass(frozen=True)
class ClassModel:
    """One row for each key and class, and the learner that scores a vector by it."""

    means: DataFrame
    keys: tuple[str, ...]
    learner: object

    def _packed(self) -> DataFrame:
        """keys... and the classes in one array: as many rows as models."""
        fitted = [c for c in self.means.columns if c not in self.keys]
        return self.means.groupBy(*self.keys).agg(F.array_sort(F.collect_list(F.struct("class", *(c for c in fitted if c != "class")))).alias("~m"))

    def _chances(self, packed: Column) -> Column:
        """class and p of each class of one model."""
        scores = F.transform(packed, lambda m: F.struct(m["class"].alias("class"), self.learner.score(F.col("features"), m).alias("s")))
        if isinstance(self.learner, NaiveBayes):
            top = lambda s: F.array_max(F.transform(s, lambda x: x["s"]))
            # where no class allows the row, all are alike
            scores = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.struct(x["class"].alias("class"), F.when(top(s) == float("-inf"), 1.0).otherwise(F.exp(x["s"] - top(s))).alias("s"))))[0]
        total = lambda s: F.aggregate(s, F.lit(0.0), lambda t, x: t + x["s"])
        return F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.struct(x["class"].alias("class"), (x["s"] / total(s)).alias("p"))))[0]

    def probabilities(self, rows: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
        packed = F.broadcast(self._packed())  # one row for each model
        met = rows.join(packed, list(own)) if own else rows.crossJoin(packed)
        return met.select(*self.keys, "row_id", "label", F.explode(self._chances(F.col("~m"))).alias("x")).select(*self.keys, "row_id", "label", "x.class", "x.p")

    def votes(self, rows: DataFrame) -> DataFrame:
        """rows with ``votes``: for each model the classes and their p."""
        packed = self._packed().agg(F.array_sort(F.collect_list(F.struct(*self.keys, "~m"))).alias("~all"))
        return rows.crossJoin(F.broadcast(packed)).withColumn("votes", F.transform("~all", lambda m: self._chances(m["~m"]))).drop("~all")
