"""Weights by hardness, and resampling of every class to one size."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.vectors import gaussian, interpolated, uniform
from evenhand.operators.evaluation import class_counts
from evenhand.operators.hardness import with_complexity
from evenhand.operators.neighbours import nearest
from evenhand.operators.ranking import RANKED, by_octave, ranked
from evenhand.sources.frame import validated
from evenhand.sources.staging import cut, once

#: Hash ranges of a class in which running weights are summed, and ranges inside each where classes are large.
RANGES = 64
#: Slots that one row stands for until they are dealt out.
SLOTS = 10_000

# The names of the target sizes.
STRATEGIES = {"auto": "mean", "all": "mean", "mean": "mean", "median": "median", "max": "max", "min": "min"}


def target_size(counts: DataFrame, strategy: str = "auto") -> DataFrame:
    """One row: ``target``, the truncated mean or median, or the largest or smallest, of the class sizes n."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    n = {"mean": F.expr("sum(n) div count(*)"), "median": F.floor(F.percentile("n", F.lit(0.5))), "max": F.max("n"), "min": F.min("n")}
    return counts.agg(n[STRATEGIES[strategy]].cast("long").alias("target"))


def class_info(df: DataFrame, strategy: str = "auto") -> DataFrame:
    """label, n, target, n_classes of each class."""
    counts = class_counts(df)
    total = counts.agg(F.count(F.lit(1)).alias("n_classes"))
    return counts.crossJoin(F.broadcast(target_size(counts, strategy))).crossJoin(F.broadcast(total))


def with_weights(df: DataFrame, mu=0.5, sigma: Column | float = 0.2, *by: str) -> DataFrame:
    """df with ``weight``, the Gaussian of complexity around mu with a floor of 1e-10, and ``p``, its share in the class."""
    out = df.withColumn("weight", gaussian(F.col("complexity"), mu, sigma))
    total = out.groupBy(*by, "label").agg(F.sum("weight").alias("~t"))
    return out.join(F.broadcast(total), [*by, "label"]).withColumn("p", F.col("weight") / F.col("~t")).drop("~t")


def undersample(df: DataFrame, targets: DataFrame, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """``target`` rows of each class, without replacement, with chances by weight: the smallest keys -ln(u) / weight.

    ``targets`` has label and target. Classes that aren't larger are kept whole.
    """
    key = -F.log(uniform(seed, "under", F.col("row_id"))) / F.col("weight")
    rows = df.withColumn("~key", key).join(F.broadcast(targets.select("label", F.col("target").alias("~t"))), "label")
    return ranked(rows, [*by, "label"], by_octave(F.col("~key")), ["~key", "row_id"], "~rk", F.col("~t")).drop("~key", "~rk", "~t")


def slots_of(short: DataFrame, *keys: str) -> DataFrame:
    """keys... and slot from 1 to ``missing``, in stretches that are dealt out before they are written down."""
    parts = short.select(*keys, "missing", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("missing") - 1) / SLOTS))).alias("part"))
    first = F.col("part") * SLOTS + 1
    return parts.repartition(*keys, "part").select(*keys, F.explode(F.sequence(first, F.least(F.col("missing"), first + SLOTS - 1))).alias("slot"))


def seeds(df: DataFrame, slots: DataFrame, seed: int = 42, by: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """slots (by..., label, slot) with seed_row_id, drawn with replacement with chances by weight.

    A slot's number u times the class total falls into one row's stretch of the running weight. Rows lie in hash ranges, which
    nest: RANGES of the whole class, RANGES of each of these, and so on until a range has some RANKED rows. A slot looks through
    the RANGES entries of one range on each level, then finds its row by an as-of union inside the last. Only the first level,
    RANGES entries for each class, is broadcast. ``most``, the rows of the largest class, saves counting.
    """
    keys = [*by, "label"]
    most = most or df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    levels = 1
    while RANGES**levels * RANKED < most:
        levels += 1
    u = uniform(seed, "range", F.col("row_id"))
    block = lambda level: F.floor(u * RANGES**level).cast("long").alias(f"b{level}")
    rows = df.select(*keys, "row_id", "weight", *(block(i) for i in range(1, levels + 1)))
    sums = rows.groupBy(*keys, *(f"b{i}" for i in range(1, levels + 1))).agg(F.sum("weight").alias("w"))
    sums = cut(sums) if levels > 1 else sums
    asked = slots.select(*keys, "slot")
    for level in range(1, levels + 1):
        parent = keys if level == 1 else [*keys, f"b{level - 1}"]
        packed = _stretches(sums.groupBy(*parent, f"b{level}").agg(F.sum("w").alias("w")), parent, f"b{level}")
        if level == 1:
            met = asked.join(F.broadcast(packed), parent).withColumn("x", uniform(seed, "seed", F.col("label"), F.col("slot")) * F.col("t"))
        else:
            met = asked.join(packed, parent).withColumn("x", F.least(F.col("pos"), F.col("t")))
        at = F.element_at(F.filter("r", lambda r: r["begin"] <= F.col("x")), -1)
        asked = met.withColumn("a", at).select(*keys, "slot", F.col("a.block").alias(f"b{level}"), (F.col("x") - F.col("a.begin")).alias("pos"))
    last = f"b{levels}"
    inside = Window.partitionBy(*keys, last).orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select(*keys, last, F.coalesce(F.sum("weight").over(inside), F.lit(0.0)).alias("pos"), F.lit(0).alias("kind"), "row_id", F.lit(None).cast("long").alias("slot"))
    both = starts.unionByName(asked.select(*keys, last, "pos", F.lit(1).alias("kind"), F.lit(None).cast(df.schema["row_id"].dataType).alias("row_id"), "slot"))
    before = Window.partitionBy(*keys, last).orderBy("pos", "kind", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("seed_row_id", F.last("row_id", ignorenulls=True).over(before)).where(F.col("kind") == 1).select(*keys, "slot", "seed_row_id")


def _stretches(sums: DataFrame, parent: list[str], block: str) -> DataFrame:
    """parent..., r (block, begin and end of its stretch, RANGES at most) and t (the end of the last)."""
    upto = Window.partitionBy(*parent).orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = sums.withColumn("end", F.sum("w").over(upto))
    ranges = ranges.withColumn("begin", F.lag("end", 1, 0.0).over(Window.partitionBy(*parent).orderBy(block)))
    return ranges.groupBy(*parent).agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("block"), "begin", "end"))).alias("r"), F.max("end").alias("t"))


def oversample(df: DataFrame, targets: DataFrame, k: int = 3, seed: int = 42, by: tuple[str, ...] = (), base: DataFrame | None = None) -> DataFrame:
    """Synthetic rows that bring smaller classes to ``target``: label, slot, seed_row_id, neighbor_row_id, alpha, features.

    Each lies between a seed drawn by weight and one of the k nearest rows of its class, the seed included. ``base`` has the
    rows once, if df has them several times.
    """
    keys = [*by, "label"]
    base = df if base is None else base
    counts = base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(targets.select("label", "target")), "label").where(F.col("n") < F.col("target"))
    # a row for each class
    n_short, most = (n or 1 for n in counts.agg(F.sum("n"), F.max("n")).first())
    short = df.select(*keys).distinct().join(F.broadcast(counts), "label").withColumn("missing", F.col("target") - F.col("n"))
    drawn = seeds(df.join(F.broadcast(counts.select("label")), "label"), slots_of(short, *keys), seed, by, most)
    points = base.select("row_id", "label", "features").join(F.broadcast(counts.select("label")), "label")
    near = nearest(points, points, k, by=["label"], exclude_self=False, n_rows=n_short, n_queries=n_short).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "row_id"))).alias("near"))
    u = lambda purpose: uniform(seed, purpose, F.col("label"), F.col("slot"))
    picked = drawn.join(near, F.col("seed_row_id") == F.col("query_id")).withColumn("pick", F.floor(u("nbr") * F.size("near")).cast("int"))
    picked = picked.select(*keys, "slot", "seed_row_id", F.get("near", F.col("pick"))["row_id"].alias("neighbor_row_id"), u("alpha").alias("alpha"))
    a = points.select(F.col("row_id").alias("seed_row_id"), F.col("features").alias("~a"))
    b = points.select(F.col("row_id").alias("neighbor_row_id"), F.col("features").alias("~b"))
    return picked.join(a, "seed_row_id").join(b, "neighbor_row_id").select(*keys, "slot", "seed_row_id", "neighbor_row_id", "alpha", interpolated("~a", "~b", F.col("alpha")).alias("features"))


def resample_weighted(df: DataFrame, targets: DataFrame, k: int = 3, seed: int = 42, by: tuple[str, ...] = (), base: DataFrame | None = None) -> DataFrame:
    """by..., label, row_id (null in synthetic rows), slot, is_synthetic, seed_row_id, neighbor_row_id, features."""
    kept = undersample(df, targets, seed, by)
    none, nobody = F.lit(None).cast("long"), F.lit(None).cast(df.schema["row_id"].dataType)
    real = kept.select(*by, "label", "row_id", none.alias("slot"), F.lit(False).alias("is_synthetic"), nobody.alias("seed_row_id"), nobody.alias("neighbor_row_id"), "features")
    made = oversample(df, targets, k, seed, by, base)
    synthetic = made.select(*by, "label", nobody.alias("row_id"), "slot", F.lit(True).alias("is_synthetic"), "seed_row_id", "neighbor_row_id", "features")
    return real.unionByName(synthetic)


def resample(df: DataFrame, mu: float = 0.5, sigma: float = 0.2, k: int = 3, hardness="overlap", strategy: str = "auto", seed: int = 42) -> DataFrame:
    """Every class at the target size, easy rows preferred for mu near 0 and hard ones for mu near 1."""
    return Resampler(hardness, strategy, seed).fit(df).resample(mu, sigma, k)


@dataclass(frozen=True)
class Resampler:
    """Settings; fit gives a FittedResampler."""

    hardness: object = "overlap"
    strategy: str = "auto"
    seed: int = 42

    def get_params(self) -> dict:
        return asdict(self)

    def with_params(self, **changed) -> Resampler:
        return replace(self, **changed)

    def fit(self, df: DataFrame) -> FittedResampler:
        """Validates the rows and finds their hardness (a ``complexity`` column of their own is taken as it is)."""
        rows = validated(once(df))  # hardness reads the rows several times
        hard = rows if "complexity" in rows.columns else cut(with_complexity(rows, self.hardness))
        return FittedResampler(self, hard, cut(class_info(hard, self.strategy)))


@dataclass(frozen=True)
class FittedResampler:
    """Rows with their hardness, resampled as often as asked for."""

    settings: Resampler
    hard: DataFrame
    info: DataFrame

    def complexities(self) -> DataFrame:
        return self.hard.select("row_id", "complexity")

    def resample(self, mu: float = 0.5, sigma: float = 0.2, k: int = 3) -> DataFrame:
        return resample_weighted(with_weights(self.hard, mu, sigma), self.info.select("label", "target"), k, self.settings.seed)


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """df with ``ord``, keyed uniforms by which the rows are in random order."""
    return df.withColumn("ord", uniform(seed, "ord", F.col("row_id")))


def get_complexities(df: DataFrame, kind: str = "overlap", **options) -> DataFrame:
    """row_id and complexity, without validation."""
    return with_complexity(df, kind, **options).select("row_id", "complexity")
