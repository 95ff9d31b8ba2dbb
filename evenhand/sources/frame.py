"""The canonical table (row_id, label, features) and its sources."""

from __future__ import annotations

import random
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions.vectors import uniform

LEAST_ROWS, LEAST_CLASSES = 10, 2


def canonical(df: DataFrame, row_id: str, features: list[str] | str, label: str | None = None) -> DataFrame:
    """row_id, label and features (array of doubles) from named columns, or from one array column.

    Without a label column the last one is taken, with a warning.
    """
    if label is None:
        label = df.columns[-1]
        warnings.warn(f"no label column given; using {label!r}", stacklevel=2)
    if label not in df.columns:
        raise ValueError(f"label column {label!r} is not in the table")
    vector = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(c).cast("double") for c in features))
    return df.select(F.col(row_id).alias("row_id"), F.col(label).alias("label"), vector.alias("features"))


def validated(df: DataFrame) -> DataFrame:
    """The table itself, if it has enough rows and classes, no nulls, NaNs, uneven vectors or repeated ids; else ValueError."""
    bad = F.col("label").isNull() | F.col("row_id").isNull() | F.col("features").isNull() | F.exists("features", lambda x: x.isNull() | F.isnan(x))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes"), F.sum(bad.cast("int")).alias("bad"), F.count_distinct(F.size("features")).alias("widths"), F.count_distinct("row_id").alias("ids")).first()
    for fails, message in (
        (got["n"] < LEAST_ROWS, f"at least {LEAST_ROWS} rows are needed"),
        (got["classes"] < LEAST_CLASSES, f"at least {LEAST_CLASSES} classes are needed"),
        (got["bad"], "null or NaN in row_id, label or features"),
        (got["widths"] > 1, "feature vectors differ in length"),
        (got["ids"] < got["n"], "row_id is not unique"),
    ):
        if fails:
            raise ValueError(message)
    return df


def doc_table(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    """Labelled documents: features n_chars, number of spaces, quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(docs, "doc_id").withColumn("spaces", spaces)
    return canonical(rows, "doc_id", ["n_chars", "spaces", "quality"], label)


def embedding_table(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return canonical(rows.withColumn("label", (F.col("label") < 2).cast("int")) if binary else rows, "vec_id", "embedding", "label")


def imbalanced(spark: SparkSession, n: int, n_features: int = 20, weights: tuple[float, ...] = (0.9, 0.1), informative: int = 10, flip: float = 0.05, seed: int = 42, redundant: int = 0) -> DataFrame:
    """A generated table: Gaussian clouds whose centres differ by class in the informative features, some labels flipped. After
    the informative features come redundant ones, linear in them, then noise."""

    def u(purpose: str) -> Column:
        return uniform(seed, purpose, F.col("row_id"))

    def normal(i: int) -> Column:
        return F.sqrt(-2 * F.log(u(f"a{i}"))) * F.cos(2 * F.pi() * u(f"b{i}"))

    rows = spark.range(n).withColumnRenamed("id", "row_id")
    drawn, label, above = u("class"), F.lit(len(weights) - 1), 0.0
    steps = []
    for c, w in enumerate(weights[:-1]):
        above += w / sum(weights)
        steps.append((c, above))
    for c, limit in reversed(steps):
        label = F.when(drawn < limit, c).otherwise(label)
    rows = rows.withColumn("true", label).withColumn("label", F.when(u("flip") < flip, F.floor(u("to") * len(weights)).cast("int")).otherwise(F.col("true")))
    values = [normal(i) + (F.col("true") * (1.5 if i % 2 else -1.5) if i < informative else F.lit(0.0)) for i in range(n_features)]
    draw = random.Random(seed)
    for i in range(informative, min(informative + redundant, n_features)):
        values[i] = sum((draw.uniform(-1, 1) * v for v in values[:informative]), F.lit(0.0))
    return rows.select("row_id", "label", F.array(*values).alias("features"))
