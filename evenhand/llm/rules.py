"""Quality rules: statistics of whole texts, and an isolation forest over them.

All labelled documents that pass the plain rules take part, good and bad ones alike. Half of them are dealt out to the trees,
each of which is grown in a task by random splits of its share: the bad ones widen the ranges that are split, so that few
splits part them from the rest. The score is 2 ** (-mean path length / expected path length), in whole ten-thousandths; the
cut-off comes from exact counts of the scores of the other half.

Null and empty texts have no words and fail the plain rules. Very long texts are measured whole. Repeated rows and ties are
judged alike. Without usable labels there is no verdict of the forest: what passes the plain rules is kept. Of ids with
several labels or rows the smallest label and the smallest counts are learnt from. Other columns, whatever their names, are not looked at. An empty table has
an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.common import WHITE, col, cut, field, text_map

# Symbols that count, words in a window, the limits of the plain rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
#: Decimal places of scores.
PLACES = 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for j in range(window):
        keys += hashed[j : j + n] * _MULTIPLIERS[j]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    seen = Counter(tuple(words[i : i + window]) for i in at)  # the words themselves decide
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def _without(raw: bytes, those: bytes) -> int:
    return len(raw) - len(raw.translate(None, those))


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    return (
        len(words),
        len(text or "") - _without(raw, WHITE),
        _without(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts of each whole text."""
    fields = [field(n, "bigint") for n in COUNTS]
    return text_map(docs, text_col, list(keep), fields, lambda texts: [list(c) for c in zip(*map(measure, texts), strict=True)] or [[]] * len(fields))


#: What the trees split on: rates, so that long and short documents compare.
FEATURES = {
    "word_length": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbols_per_word": lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
    "symbol_rate": lambda c: c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
    "repeat_rate": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
}


def features() -> F.Column:
    return F.array(*(f(F.col).cast("double") for f in FEATURES.values()))


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees in arrays, one row each: feature (-1 in leaves), threshold, children, path length on reaching a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    expected: float

    def mean_path(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            while (inner := self.feature[t][node] >= 0).any():
                here = node[inner]
                goes = rows[at_row[inner], self.feature[t][here]] < self.threshold[t][here]
                node[inner] = np.where(goes, self.left[t][here], self.right[t][here])
            total += self.path[t][node]
        return total / max(1, len(self.feature))

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self.mean_path(rows) / max(self.expected, 1e-9))


def depth_limit(per_tree: int) -> int:
    return max(1, math.ceil(math.log2(max(2, per_tree))))


def tree(rows: np.ndarray, limit: int, rng: np.random.Generator) -> list[list[float]]:
    """Nodes of a tree that splits rows at random features and values until they are alone or the depth limit is met."""
    nodes: list[list[float]] = []

    def build(x: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + expected_path(len(x))])
        low, high = x.min(axis=0), x.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth < limit and len(x) > 1 and len(open_):
            f = int(rng.choice(open_))
            at = rng.uniform(low[f], high[f])
            goes = x[:, f] < at
            if goes.any() and not goes.all():
                nodes[me][0], nodes[me][1] = f, at
                nodes[me][2] = build(x[goes], depth + 1)
                nodes[me][3] = build(x[~goes], depth + 1)
        return me

    build(rows, 0)
    return nodes


def forest(grown: list[list[list[float]]], expected: float) -> Forest:
    width = max(map(len, grown))
    box = np.zeros((len(grown), width, 5))
    box[:, :, 0] = -1
    for t, nodes in enumerate(grown):
        box[t, : len(nodes)] = nodes
    return Forest(box[:, :, 0].astype(np.int64), box[:, :, 1], box[:, :, 2].astype(np.int64), box[:, :, 3].astype(np.int64), box[:, :, 4], expected)


def grow(rows: np.ndarray, trees: int, per_tree: int, seed: int) -> Forest:
    """A forest in one process, of a draw of rows for each tree."""
    rng = np.random.default_rng(seed)
    per_tree = min(per_tree, len(rows))
    grown = [tree(rows[rng.choice(len(rows), per_tree, replace=False)], depth_limit(per_tree), rng) for _ in range(trees)]
    return forest(grown, expected_path(per_tree))


def calibrate(score: np.ndarray, good: np.ndarray, bad: np.ndarray, most_good_lost: float) -> float:
    """The cut-off with the largest gain in bad documents over good ones that loses at most the given share of the good. Of each
    score, in rising order, the numbers of good and bad documents are given."""
    if not good.sum():
        return math.inf
    above = lambda n: n.sum() - np.cumsum(n) + n  # noqa: E731  with that score or a larger one
    lost, caught = above(good) / good.sum(), above(bad) / max(1, bad.sum())
    # the score of the good document at that quantile, itself not lost
    floor = score[np.searchsorted(np.cumsum(good), math.ceil((good.sum() - 1) * (1 - most_good_lost)) + 1)]
    tried = np.flatnonzero((score > floor) & (bad > 0))
    least = np.searchsorted(score, floor, "right")
    gain = [(caught[i] - lost[i]) if i < len(score) else 0.0 for i in (least, *tried)]
    best = int(np.argmax(gain))
    return float(np.nextafter(floor, 2)) if best == 0 else float(score[tried[best - 1]])


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _anomaly(spark: SparkSession, model: Forest) -> Column:
    """The score of a row with the counts. The forest, a few thousand nodes, goes to all tasks."""
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def anomaly(x):
        import pandas as pd

        return pd.Series(np.round(shipped.value.score(np.array(x.tolist(), float).reshape(len(x), len(FEATURES))), PLACES))

    return anomaly(features())


def fit(counted: DataFrame, labels: DataFrame, label_col: str = "quality", trees: int = 200, per_tree: int = 32, most_good_lost: float = 0.005, seed: int = 7) -> tuple[Forest, float] | None:
    """The forest and its cut-off from all rows of ``statistics`` that have a label and pass the plain rules.

    Half of them, by a hash of the id, grow the trees: each is in the share of one tree, or of so many that shares have about
    ``per_tree`` rows. The other half sets the cut-off. The driver gets the trees and a histogram of scores.
    """
    spark = counted.sparkSession
    one = labels.where(col("doc_id").isNotNull() & col(label_col).isNotNull()).groupBy(col("doc_id").alias("id")).agg(F.min(col(label_col)).cast("int").alias("y"))
    rows = counted.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct(*COUNTS)).alias("c")).select("id", "c.*")
    known = cut(rows.where(~base_failed()).join(one, "id").withColumn("grows", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 0))
    n, good = known.agg(F.count_if("grows"), F.count_if(~F.col("grows") & (F.col("y") == 1))).first()
    if n < 8 or not good:
        return None
    times = math.ceil(trees * per_tree / n)
    # 1 in a table of some size
    shares = known.where("grows").select("id", features().alias("x"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("turn"))
    shares = shares.select("x", F.pmod(F.xxhash64("id", "turn", F.lit(seed)), F.lit(trees)).cast("int").alias("tree"))

    def one_tree(part):
        import pandas as pd

        made = tree(np.array(part["x"].tolist(), float), depth_limit(per_tree), np.random.default_rng([seed, int(part["tree"].iloc[0])]))
        return pd.DataFrame({"tree": part["tree"].iloc[:1], "rows": len(part), "nodes": [made]})

    # ``trees`` rows, of trees of depth_limit(per_tree)
    grown = sorted(shares.groupBy("tree").applyInPandas(one_tree, "tree int, rows long, nodes array<array<double>>").collect())
    made = forest([g["nodes"] for g in grown], float(np.mean([expected_path(g["rows"]) for g in grown])))
    scored = known.where("NOT grows").select("y", _anomaly(spark, made).alias("s"))
    # a row for each score at most, of which there are 10 ** PLACES + 1
    got = scored.groupBy("s").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") != 1).alias("bad")).toPandas().sort_values("s")
    return made, calibrate(got["s"].to_numpy(), got["good"].to_numpy(), got["bad"].to_numpy(), most_good_lost)


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly (0 to 1; null without a forest) and kept, for each row."""
    got = cut(statistics(docs))
    model = fit(got, labels, **options)
    got = got.withColumn("base_failed", base_failed())
    if model is None:
        return got.withColumn("anomaly", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    made, limit = model
    return got.withColumn("anomaly", _anomaly(docs.sparkSession, made)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(limit)))
