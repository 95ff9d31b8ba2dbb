"""Comparisons of resampling settings on rows that are left out: one row of metrics for each setting, and the winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.operators import ensemble, evaluation
from evenhand.operators.sampling import Resampler
from evenhand.sources.staging import cut

METRICS = ("accuracy", "precision", "recall", "f1", "auc")
# The settings of mu that are compared, and the hardness measures.
STRATEGIES = (("easy_instances", 0.0), ("uniform", 0.5), ("hard_instances", 1.0))
MEASURES = ("overlap", "neighborhood", "error_rate")


def keyed(resampled: DataFrame) -> DataFrame:
    """Resampled rows with a row_id for the synthetic ones too, by a digest of class and slot: a number below zero, or a text."""
    digest = F.substring(F.md5(F.concat_ws(":", F.col("label").cast("string"), F.col("slot").cast("string")).cast("binary")), 1, 15)
    text = resampled.schema["row_id"].dataType.typeName() == "string"
    made = F.concat(F.lit("~"), digest) if text else -1 - F.conv(digest, 16, 10).cast("long")
    return resampled.withColumn("row_id", F.coalesce("row_id", made))


def evaluate(train: DataFrame, test: DataFrame, learner, positive=1) -> DataFrame:
    """One row of METRICS of the learner fitted on train, on test."""
    return evaluation.all_metrics(evaluation.scores(learner.fit(train).probabilities(test), positive), positive)


def _table(settings: list[tuple[str, DataFrame]], test: DataFrame, learner, positive) -> DataFrame:
    """position, name and METRICS; the learners of all settings are fitted in one plan."""
    train, names = None, test.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(settings)], "position int, name string")
    for i, (_, rows) in enumerate(settings):
        part = rows.select(F.lit(i).alias("position"), "row_id", "label", "features")
        train = part if train is None else train.unionByName(part)
    p = learner.fit(cut(train), "position").probabilities(test)
    scored = evaluation.all_metrics(evaluation.scores(p, positive, "position"), positive, "position")
    return scored.join(F.broadcast(names), "position").select("position", "name", *METRICS)


def compare_strategies(train: DataFrame, test: DataFrame, learner, sigma: float = 0.2, k: int = 5, seed: int = 42, positive=1) -> DataFrame:
    """Without resampling, and with mu at 0, 0.5 and 1."""
    fitted = Resampler("overlap", seed=seed).fit(train)
    settings = [("baseline", train), *((name, keyed(fitted.resample(mu, sigma, k))) for name, mu in STRATEGIES)]
    return _table(settings, test, learner, positive)


def compare_measures(train: DataFrame, test: DataFrame, learner, measures=MEASURES, mu: float = 0.5, sigma: float = 0.2, k: int = 5, seed: int = 42, positive=1) -> DataFrame:
    """Resampled by each hardness measure (a name, or a name and a measure)."""
    named = [(m, m) if isinstance(m, str) else m for m in measures]
    settings = [(name, keyed(Resampler(m, seed=seed).fit(train).resample(mu, sigma, k))) for name, m in named]
    return _table(settings, test, learner, positive)


def sweep_mu(train: DataFrame, learner, steps: int = 5, folds: int = 3, sigma: float = 0.2, k: int = 5, seed: int = 42, positive=1) -> DataFrame:
    """position, mu, mean and std of the F1 over unshuffled folds of the resampled rows (synthetic ones are in them too); the
    learners of all steps and folds are fitted in one plan."""
    grid = ensemble.mu_grid(train.sparkSession, steps).withColumnRenamed("member_id", "position")
    made = keyed(ensemble.bags_of(Resampler("overlap", seed=seed).fit(train), grid, sigma, k, ("position",))).select("position", "row_id", "label", "features")
    part, rest = evaluation.in_folds(made, folds, by=("position",))
    keys = ("position", "held")
    pred = ensemble.best_class(learner.fit(part, *keys).probabilities(rest, keys), "p", *keys)
    scores = evaluation.binary_metrics(pred, positive, *keys).select("position", F.col("f1").alias("score"))
    return evaluation.summary(scores, "position").join(F.broadcast(grid), "position").select("position", "mu", "mean", "std")


def best_mu(swept: DataFrame) -> DataFrame:
    """mu and mean of the best step, the first of equals."""
    return swept.orderBy(F.desc("mean"), "position").limit(1).select("mu", "mean")
