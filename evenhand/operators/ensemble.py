"""An ensemble whose members differ in the hardness that their bags prefer."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenhand.operators import evaluation
from evenhand.operators.learners import Tree
from evenhand.operators.sampling import FittedResampler, Resampler, resample_weighted, with_weights
from evenhand.sources.staging import cut


def mu_grid(spark: SparkSession, members: int) -> DataFrame:
    """member_id and mu, evenly from 0 to 1; 0.5 for a single member."""
    if members < 1:
        raise ValueError("at least one member is needed")
    mu = F.col("id") / (members - 1) if members > 1 else F.lit(0.5)
    return spark.range(members).select(F.col("id").cast("int").alias("member_id"), mu.cast("double").alias("mu"))


def mu_distribution(grid: DataFrame) -> DataFrame:
    return grid.agg(F.avg("mu").alias("mean"), F.stddev_pop("mu").alias("std"), F.min("mu").alias("min"), F.max("mu").alias("max"), F.count(F.lit(1)).alias("n_members"))


def bags(df: DataFrame, members: int = 10, sigma: float = 0.2, k: int = 5, hardness="overlap", strategy: str = "auto", seed: int = 42) -> DataFrame:
    """The bags of all members in one plan: hardness is computed once, and all windows run by member and class.

    Members share their random numbers, so that mu alone tells them apart.
    """
    return bags_of(Resampler(hardness, strategy, seed).fit(df), mu_grid(df.sparkSession, members), sigma, k)


def bags_of(fitted: FittedResampler, grid: DataFrame, sigma: float = 0.2, k: int = 5, keys: tuple[str, ...] = ("member_id",)) -> DataFrame:
    """keys... and the rows of a bag for each row of ``grid`` (keys... and mu; one row for each bag)."""
    weighted = with_weights(fitted.hard.crossJoin(F.broadcast(grid)), F.col("mu"), sigma, *keys)
    return resample_weighted(weighted, fitted.info.select("label", "target"), k, fitted.settings.seed, keys, fitted.hard)


def mean_probabilities(probabilities: DataFrame, members: int | Column, *by: str) -> DataFrame:
    """by..., row_id, label, class, p: means over members, a class that a member lacks counting 0, over the row's sum + 1e-10.
    Means have 12 places, so that the order of summing doesn't matter."""
    means = probabilities.groupBy(*by, "row_id", "label", "class").agg(F.round(F.sum("p") / members, 12).alias("m"))
    total = Window.partitionBy(*by, "row_id")
    return means.withColumn("p", F.col("m") / (F.sum("m").over(total) + 1e-10)).drop("m")


def best_class(scores: DataFrame, score: str = "p", *by: str) -> DataFrame:
    """by..., row_id, label, pred: the class with the largest score, the smallest class among equals."""
    best = F.min(F.struct((-F.col(score)).alias("n"), "class"))["class"]
    return scores.groupBy(*by, "row_id", "label").agg(best.alias("pred"))


def soft_vote(probabilities: DataFrame, members: int | Column, *by: str) -> DataFrame:
    return best_class(mean_probabilities(probabilities, members, *by), "p", *by)


def hard_vote(probabilities: DataFrame, *by: str) -> DataFrame:
    """The class that most members predict; ties go to the smallest class."""
    votes = best_class(probabilities, "p", *by, "member_id").groupBy(*by, "row_id", "label", F.col("pred").alias("class")).agg(F.count(F.lit(1)).alias("votes"))
    return best_class(votes, "votes", *by)


def chances(votes: Column, members: int) -> Column:
    """What ``mean_probabilities`` gives of the votes of a row: class and p."""
    every = F.array_sort(F.array_distinct(F.transform(F.flatten(votes), lambda x: x["class"])))
    of = lambda c: F.aggregate(F.filter(F.flatten(votes), lambda x: x["class"] == c), F.lit(0.0), lambda t, x: t + x["p"])
    means = F.transform(every, lambda c: F.struct(c.alias("class"), F.round(of(c) / members, 12).alias("m")))
    total = lambda m: F.aggregate(m, F.lit(0.0), lambda t, x: t + x["m"]) + 1e-10
    # one entry, to name the means
    return F.transform(F.array(means), lambda m: F.transform(m, lambda x: F.struct(x["class"].alias("class"), (x["m"] / total(m)).alias("p"))))[0]


def first_of(scores: Column, score: str = "p") -> Column:
    """The class of the largest score in an array, the smallest class among equals."""
    return F.array_min(F.transform(scores, lambda x: F.struct((-x[score]).alias("n"), x["class"].alias("class"))))["class"]


def majority(votes: Column) -> Column:
    """What ``hard_vote`` gives of the votes of a row."""
    said = F.transform(votes, lambda v: first_of(v))
    counts = F.transform(F.array_distinct(said), lambda c: F.struct(c.alias("class"), F.size(F.filter(said, lambda x: x == c)).alias("n")))
    return first_of(counts, "n")


def diversity(bags: DataFrame) -> DataFrame:
    """Mean Jaccard distance between the members' sets of distinct feature vectors; 0 for fewer than two members."""
    rows = bags.select("member_id", "features").distinct()
    sizes = rows.groupBy("member_id").agg(F.count(F.lit(1)).alias("n"))
    # members that hold a vector: at most all members, so pairs are formed from short lists
    held = rows.groupBy("features").agg(F.array_sort(F.collect_list("member_id")).alias("m"))
    pair = F.flatten(F.transform("m", lambda i: F.transform(F.filter("m", lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    common = held.select(F.explode(pair).alias("x")).groupBy("x.i", "x.j").agg(F.count(F.lit(1)).alias("c"))
    a, b = (sizes.select(F.col("member_id").alias(i), F.col("n").alias(f"n{i}")) for i in "ij")
    every = a.join(b, F.col("i") < F.col("j")).join(common, ["i", "j"], "left")
    shared = F.coalesce("c", F.lit(0))
    return every.agg(F.coalesce(F.avg(1 - shared / (F.col("ni") + F.col("nj") - shared + 1e-10)), F.lit(0.0)).alias("diversity"))


@dataclass(frozen=True)
class Ensemble:
    """Settings; fit gives an EnsembleModel."""

    members: int = 10
    hardness: str = "overlap"
    sigma: float = 0.2
    k: int = 5
    voting: str = "soft"
    strategy: str = "auto"
    seed: int = 42
    learner: object = field(default_factory=Tree)

    def __post_init__(self) -> None:
        if self.members < 1:
            raise ValueError("at least one member is needed")
        if not 0 < self.sigma <= 1:
            raise ValueError("sigma must be above 0 and at most 1")
        if self.voting not in ("soft", "hard"):
            raise ValueError(f"unknown voting {self.voting!r}")

    def get_params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_params(self, **changed) -> Ensemble:
        return replace(self, **changed)

    def fit(self, df: DataFrame) -> EnsembleModel:
        made = cut(bags(df, self.members, self.sigma, self.k, self.hardness, self.strategy, self.seed))
        return EnsembleModel(self, made, self.learner.fit(made, "member_id"))


@dataclass(frozen=True)
class EnsembleModel:
    settings: Ensemble
    bags: DataFrame
    fitted: object

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """member_id, row_id, label, class, p."""
        return self.fitted.probabilities(rows)

    def scored(self, rows: DataFrame) -> DataFrame | None:
        """rows with ``probability`` (class and p, as voted softly) and ``pred`` by the vote that is set: all members score a row at
        once and nothing is aggregated, so rows may be a stream. None if the members are too large to be sent to all tasks."""
        with_votes = self.fitted.votes(rows)
        if with_votes is None:
            return None
        out = with_votes.withColumn("probability", chances(F.col("votes"), self.settings.members))
        pred = first_of(F.col("probability")) if self.settings.voting == "soft" else majority(F.col("votes"))
        return out.withColumn("pred", pred).drop("votes")

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """row_id, label, class, p."""
        voted = self.scored(rows)
        if voted is None:
            return mean_probabilities(self.probabilities(rows), self.settings.members)
        return voted.select("row_id", "label", F.explode("probability").alias("x")).select("row_id", "label", "x.class", "x.p")

    def predict(self, rows: DataFrame) -> DataFrame:
        """row_id, label, pred."""
        voted = self.scored(rows)
        if voted is None:
            p = self.probabilities(rows)
            return soft_vote(p, self.settings.members) if self.settings.voting == "soft" else hard_vote(p)
        return voted.select("row_id", "label", "pred")

    def score(self, rows: DataFrame) -> DataFrame:
        """Accuracy."""
        return self.predict(rows).agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))

    def diversity(self) -> DataFrame:
        return diversity(self.bags)


# The configurations that are compared by default.
CONFIGURATIONS = (
    {"name": "overlap", "hardness": "overlap", "sigma": 0.2},
    {"name": "error_rate", "hardness": "error_rate", "sigma": 0.2},
    {"name": "neighborhood", "hardness": "neighborhood", "sigma": 0.2},
    {"name": "overlap_wide", "hardness": "overlap", "sigma": 0.5},
)


def of_all_folds(df: DataFrame, settings: list[tuple[str, object, float]], members: int, folds: int, k: int = 5, strategy: str = "auto", seed: int = 42, shuffle: bool = True) -> tuple[DataFrame, DataFrame]:
    """Bags of all settings (name, hardness, sigma) and folds, by name, held and member_id, and the test rows, by held.

    Hardness is found once for each fold and measure. The bags of all settings of a fold are made in one plan, so neighbours are
    searched once for each fold; the bags of all folds are rows of one table.
    """
    train, test = evaluation.in_folds(df, folds, shuffle, seed)
    grid, out = mu_grid(df.sparkSession, members), None
    measures = list(dict.fromkeys(hardness for _, hardness, _ in settings))
    every = _union(grid.select(F.lit(name).alias("name"), "member_id", "mu", F.lit(float(sigma)).alias("sigma"), F.lit(measures.index(hardness)).alias("measure")) for name, hardness, sigma in settings)
    for held in range(folds):
        own = cut(train.where(F.col("held") == held).drop("held"))
        fitted = [Resampler(hardness, strategy, seed).fit(own) for hardness in measures]
        hard = _union(one.hard.select("row_id", "label", "features", "complexity", F.lit(i).alias("measure")) for i, one in enumerate(fitted))
        # one row for each bag
        weighted = with_weights(hard.join(F.broadcast(every), "measure"), F.col("mu"), F.col("sigma"), "name", "member_id")
        bags = resample_weighted(weighted, fitted[0].info.select("label", "target"), k, seed, ("name", "member_id"), own)
        part = cut(bags.select("name", F.lit(held).alias("held"), "member_id", "label", "features"))
        out = part if out is None else out.unionByName(part)
    return out, test


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def compare_configurations(df: DataFrame, members: int = 10, configurations=CONFIGURATIONS, folds: int = 3, seed: int = 42, learner=None, measures: dict | None = None) -> DataFrame:
    """name, mean, std, min and max of the weighted F1 of each configuration over shuffled folds; members of all configurations and
    folds are fitted in one plan. ``measures`` replaces named hardness measures by others."""
    settings = [(c["name"], (measures or {}).get(c["hardness"], c["hardness"]), c["sigma"]) for c in configurations]
    made, test = of_all_folds(df, settings, members, folds, seed=seed)
    p = (learner or Tree()).fit(made, "name", "held", "member_id").probabilities(test, ("held",))
    pred = soft_vote(p, members, "name", "held")
    return evaluation.summary(evaluation.weighted_f1(pred, "name", "held").withColumnRenamed("weighted_f1", "score"), "name")


def compare_learners(df: DataFrame, learners: dict, members: int = 10, folds: int = 5, seed: int = 42, learner=None) -> DataFrame:
    """name, mean, std, min and max of the weighted F1 over folds of each learner (by name), and of the ensemble of ``learner``."""
    train, test = evaluation.in_folds(df, folds, False, seed)
    preds = [best_class(one.fit(train, "held").probabilities(test, ("held",)), "p", "held").withColumn("name", F.lit(name)) for name, one in learners.items()]
    made, again = of_all_folds(df, [("ensemble", "overlap", 0.2)], members, folds, seed=seed, shuffle=False)
    p = (learner or Tree()).fit(made, "held", "member_id").probabilities(again, ("held",))
    pred = soft_vote(p, members, "held").withColumn("name", F.lit("ensemble"))
    for one in preds:
        pred = pred.unionByName(one)
    return evaluation.summary(evaluation.weighted_f1(pred, "name", "held").withColumnRenamed("weighted_f1", "score"), "name")


def members_sweep(train: DataFrame, test: DataFrame, sizes: tuple[int, ...] = (3, 5, 10, 15, 20), learner=None, positive=1, seed: int = 42) -> DataFrame:
    """members, f1 on test and mu_std of ensembles of each size; hardness is found once, and all members of all sizes are fitted in
    one plan."""
    grid = None
    for n in sizes:
        part = mu_grid(train.sparkSession, n).select(F.lit(n).alias("members"), "member_id", "mu")
        grid = part if grid is None else grid.unionByName(part)
    keys = ("members", "member_id")
    made = cut(bags_of(Resampler(seed=seed).fit(train), grid, keys=keys))
    p = (learner or Tree()).fit(made, *keys).probabilities(test)
    f1 = evaluation.binary_metrics(soft_vote(p, F.first("members"), "members"), positive, "members").select("members", "f1")
    return f1.join(F.broadcast(grid.groupBy("members").agg(F.stddev_pop("mu").alias("mu_std"))), "members")
