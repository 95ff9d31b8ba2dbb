"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking.

Vectors are scaled by the largest norm and given one more component that brings them to length one, so that the largest
inner product with a query is the nearest direction. In each table three rounds of random signs and a fast Hadamard
transform rotate them, and the nearest signed axis is the bucket. A query probes, in each table, the buckets of its
largest rotated components; what it finds is ranked by exact inner products on the original vectors in double precision.

The number of probes is fitted on a bounded sample (``CALIBRATION`` rows) until the recall there reaches ``target``;
every row is indexed and no bucket is capped. Of equal vectors only the k + 1 smallest ids can be among the k nearest, so
only those are searched. Large buckets are split by a hash of the id, and queries meet each part.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of another length
than most. Fewer candidates than k give fewer rows. Repeated ids count once (the smallest vector of them). Ties go to the
smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import col

#: Rows of the sample that fits the number of probes, and queries among them.
CALIBRATION, CALIBRATION_QUERIES = 4096, 256
#: Buckets that travel together, and the rows of a part of them or of a block of queries, about.
TOGETHER, PART = 32, 8192


class Rotation:
    """Pseudo-rotations of all tables: three rounds of random signs and Hadamard transforms each."""

    def __init__(self, width: int, tables: int, seed: int, largest: float) -> None:
        self.width, self.tables, self.largest = width, tables, largest
        self.size = 1 << int(np.ceil(np.log2(width + 1)))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Points on the unit sphere."""
        out = np.zeros((len(x), self.size))
        out[:, : self.width] = x / self.largest
        out[:, self.width] = np.sqrt(np.maximum(0, 1 - np.square(out).sum(axis=1)))
        return out

    def asked(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), self.size))
        out[:, : self.width] = q / np.linalg.norm(q, axis=1, keepdims=True)
        return out

    def turn(self, points: np.ndarray, table: int) -> np.ndarray:
        x = points
        for signs in self.signs[table]:
            x = x * signs
            h = 1
            while h < self.size:
                y = x.reshape(len(x), -1, 2, h)
                x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), self.size)
                h *= 2
            x = x / np.sqrt(self.size)
        return x

    def buckets(self, points: np.ndarray, table: int) -> np.ndarray:
        """Nearest signed axis: 2 * axis, and 1 more on its negative side."""
        x = self.turn(points, table)
        axis = np.abs(x).argmax(axis=1)
        return 2 * axis + (x[np.arange(len(x)), axis] < 0)

    def probes(self, points: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n nearest signed axes of each query."""
        x = self.turn(points, table)
        both = np.stack([x, -x], axis=2).reshape(len(x), 2 * self.size)
        return np.argsort(-both, axis=1, kind="stable")[:, :n]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (double array) of the vectors that take part, one row for each id."""
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return vectors.select(col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine)


def calibrated(x: np.ndarray, q: np.ndarray, own: np.ndarray, rotation: Rotation, k: int, target: float) -> int:
    """Least probes a table with which the sample's queries find the target share of their k nearest."""
    scores = q @ x.T
    scores[np.arange(len(q)), own] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 2 * rotation.size
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    points, asked = rotation.lifted(x), rotation.asked(q)
    needed = np.full(true.shape, 2 * rotation.size)
    for t in range(rotation.tables):
        order = rotation.probes(asked, t, 2 * rotation.size)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(2 * rotation.size)[None, :], axis=1)
        needed = np.minimum(needed, np.take_along_axis(place, rotation.buckets(points, t)[true], axis=1))
    return int(np.quantile(needed, target, method="higher")) + 1


def _column(values) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, target: float = 0.95, seed: int = 23) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest found of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    out_type = "query_id long, vec_id long, score double"
    flagged = usable(vectors.withColumn("~q", is_query), id_col, vector_col)
    queries_of = usable(vectors.where(is_query), id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    points = flagged.groupBy("id").agg(F.min("v").alias("v"))
    widths = points.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m")).orderBy(F.desc("n"), "w").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width, largest = widths[0]["w"], widths[0]["m"] * (1 + 1e-12)
    points, queries_of = points.where(F.size("v") == width), queries_of.where(F.size("v") == width)
    rotation = Rotation(width, tables, seed, largest)
    sample = points.orderBy(F.xxhash64("id", F.lit(seed))).limit(CALIBRATION).toPandas()
    x = _column(sample["v"])
    asked = np.arange(min(len(x), CALIBRATION_QUERIES))
    n_probes = calibrated(x, x[asked], asked, rotation, k, target)

    same = Window.partitionBy("v").orderBy("id")
    distinct = points.withColumn("~n", F.row_number().over(same)).where(F.col("~n") <= k + 1).drop("~n")
    shipped = spark.sparkContext.broadcast(rotation)
    groups = -(-2 * rotation.size // TOGETHER)

    def place(batches):
        for batch in batches:
            p = shipped.value.lifted(_column(batch["v"]).reshape(len(batch), width))
            for t in range(tables):
                b = shipped.value.buckets(p, t)
                yield pd.DataFrame({"g": t * groups + b // TOGETHER, "b": b.astype(np.int32), "id": batch["id"], "v": batch["v"]})

    def probe(batches):
        for batch in batches:
            p = shipped.value.asked(_column(batch["v"]).reshape(len(batch), width))
            for t in range(tables):
                found = shipped.value.probes(p, t, n_probes)
                for g in range(groups):
                    here = found // TOGETHER == g
                    rows = np.flatnonzero(here.any(axis=1))
                    if len(rows):
                        yield pd.DataFrame({"g": np.full(len(rows), t * groups + g), "b": [found[r][here[r]].astype(np.int32) for r in rows], "id": batch["id"].to_numpy()[rows], "v": batch["v"].to_numpy()[rows]})

    indexed = distinct.mapInPandas(place, "g int, b int, id long, v array<double>")
    probing = queries_of.mapInPandas(probe, "g int, b array<int>, id long, v array<double>")
    # one row for each group of buckets, tables * groups in all, so this side is small by construction
    parts = indexed.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PART)).cast("int").alias("parts"))
    asks = probing.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PART)).cast("int").alias("asks"))
    sizes = F.broadcast(parts.join(asks, "g"))
    one = lambda n: F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(sizes, "g").select("g", one("parts").alias("p"), every("asks").alias("a"), "b", "id", "v")
    right = probing.join(sizes, "g").select("g", every("parts").alias("p"), one("asks").alias("a"), "b", "id", "v")

    def rank(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        candidates = candidates.sort_values("id")
        x, ids, at = _column(candidates["v"]), candidates["id"].to_numpy(), candidates["b"].to_numpy()
        got = []
        for begin in range(0, len(queries), 256):
            block = queries.iloc[begin : begin + 256]
            q, own = _column(block["v"]), block["id"].to_numpy()
            probed = np.zeros((len(block), 2 * rotation.size), bool)
            for i, b in enumerate(block["b"]):
                probed[i, b] = True
            score = np.where(probed[:, at] & (ids[None, :] != own[:, None]), q @ x.T, -np.inf)
            # all that rounding of the block product can't tell from the k-th, so that it can't hide a tie
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1] if score.shape[1] > k else np.full(len(block), -np.inf)
            rounding = 4 * (width + 4) * np.finfo(float).eps * np.linalg.norm(q, axis=1) * largest
            r, j = np.nonzero((score >= (kth - rounding)[:, None]) & (score > -np.inf))
            got.append(pd.DataFrame({"query_id": own[r], "vec_id": ids[j], "score": exact(q[r], x[j])}))
        out = pd.concat(got).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return out.groupby("query_id", sort=False).head(k)

    found = left.groupBy("g", "p", "a").cogroup(right.groupBy("g", "p", "a")).applyInPandas(rank, out_type)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total
