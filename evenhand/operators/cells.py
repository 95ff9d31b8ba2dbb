"""Voronoi cells around sampled rows, with bounds that tell which cells can hold a row near enough to a query.

The rows of a segment (a class, or all rows) belong to the cell of their nearest pivot. Of each cell the number of rows and
the least and largest distance to its pivot are known. Small cells that lie together share a block of about BLOCK rows, a
large cell is dealt into several blocks by a hash of the id. Pivots and cells are bounded in number whatever the table is, so
both are collected and sent to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block.
BLOCK = 4096
#: Pivots, and cells of all segments together unless there are more segments.
MOST_PIVOTS, MOST_CELLS = 1024, 1 << 16
#: Labels up to which cells hold one label each where rows look for other labels.
MOST_LABELS = 16


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def slack(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How far a squared distance by matrix product may be off, for each row of p."""
    return 4 * (x.shape[1] + 4) * np.finfo(float).eps * (np.linalg.norm(p, axis=1) + np.linalg.norm(x, axis=1).max()) ** 2


def products(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by matrix product, within ``slack``."""
    d = -2 * p @ x.T
    d += (p * p).sum(1)[:, None]
    d += (x * x).sum(1)[None, :]
    return d


def pivots_of(rows: DataFrame, n_rows: int, n_segments: int) -> np.ndarray:
    """The vectors of rows drawn by a hash of their ids, without repeats, each followed by its nearest that is left."""
    m = max(2, min(MOST_PIVOTS, int(2 * n_rows**0.5), max(2, MOST_CELLS // n_segments)))
    # at most MOST_PIVOTS vectors
    drawn = rows.select("features", F.xxhash64(F.col("row_id").cast("string")).alias("h")).orderBy("h").limit(m).collect()
    x = np.unique(np.array([r["features"] for r in drawn], float), axis=0)
    order, left = [0], set(range(1, len(x)))
    d = products(x, x)
    while left:
        rest = np.fromiter(left, int)
        order.append(int(rest[np.argmin(d[order[-1], rest])]))
        left.discard(order[-1])
    return x[order]


@dataclass(frozen=True)
class Cells:
    pivots: np.ndarray
    segment: np.ndarray  # of each cell, as text
    pivot: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    block: np.ndarray  # its first block, and how many it has
    parts: np.ndarray
    code: np.ndarray  # of the label of its rows
    pure: np.ndarray  # whether all have the same

    def bounds(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each row of p: least and largest distance to each pivot, nearest pivot, and the squared distances."""
        d2, s = products(p, self.pivots), slack(p, self.pivots)[:, None]
        return np.sqrt(np.maximum(d2 - s, 0)), np.sqrt(np.maximum(d2, 0) + s), np.argmin(d2, 1), d2

    def admitted(self, segments: np.ndarray, codes: np.ndarray, unlike: bool) -> np.ndarray:
        """Cells that a query of each segment and label may look into."""
        if unlike:
            return ~(self.pure[None, :] & (codes[:, None] == self.code[None, :]))
        return segments[:, None] == self.segment[None, :]

    def rounding(self, p: np.ndarray) -> np.ndarray:
        """How far a distance by matrix product between each row of p and the rows of each cell may be off."""
        return np.sqrt(slack(p, self.pivots))[:, None] + np.sqrt(4 * (p.shape[1] + 4) * np.finfo(float).eps) * self.high[None, :]

    def least(self, p: np.ndarray, bounds: tuple) -> np.ndarray:
        """A lower bound on the distance of each row of p to the rows of each cell."""
        low, high, near, d2 = bounds
        x = self.pivots
        off = self.rounding(p) ** 2
        apart = np.sqrt(np.maximum(products(x[near], x), 0) + slack(x[near], x)[:, None])[:, self.pivot]
        nearest = d2[np.arange(len(p)), near][:, None]
        # rows of the cell lie beyond the plane between its pivot and the query's
        plane = (d2[:, self.pivot] - nearest - 8 * off) / (2 * apart)
        ring = np.maximum(low[:, self.pivot] - self.high[None, :], self.low[None, :] - high[:, self.pivot])
        return np.fmax(np.fmax(plane, ring), 0.0)

    def most(self, bounds: tuple, admitted: np.ndarray, k: int, unlike: bool) -> np.ndarray:
        """An upper bound on the distance of the k-th row for each query, from the sizes of cells alone. Of a cell with several
        labels only one row is sure to be unlike the query."""
        sizes = np.where(self.pure, self.n, 1) if unlike else self.n
        reach = np.where(admitted, bounds[1][:, self.pivot] + self.high[None, :], np.inf)
        order = np.argsort(reach, axis=1)
        count = np.cumsum(np.where(np.take_along_axis(admitted, order, 1), sizes[order], 0), axis=1)
        at = np.argmax(count >= k, axis=1)
        found = np.take_along_axis(reach, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
        return np.where(count[:, -1] >= k, found, np.inf)


def segments(by: list[str]) -> Column:
    return F.concat_ws(":", *(F.col(c).cast("string") for c in by)) if by else F.lit("")


def share(column: str, parts: Column | int) -> Column:
    """The part of a row by a hash of its id."""
    return F.pmod(F.xxhash64(F.col(column).cast("string"), F.lit(7)), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (row_id, label, features, seg) with pivot, low and high: the nearest pivot and bounds on the distance to it."""
    shipped = rows.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most

    def put(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                p = matrix(part["features"])
                d2, s = products(p, shipped.value), slack(p, shipped.value)
                near = np.argmin(d2, 1)
                own = d2[np.arange(len(p)), near]
                yield part.assign(pivot=near, low=np.sqrt(np.maximum(own - s, 0)), high=np.sqrt(np.maximum(own, 0) + s))

    schema = T.StructType([*rows.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    return rows.mapInPandas(put, schema)


def cells_of(dealt_rows: DataFrame, pivots: np.ndarray) -> Cells:
    """Sizes and bounds of the cells, and their blocks."""
    got = dealt_rows.groupBy("seg", "pivot").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("code").alias("code"), F.max("code").alias("last")).toPandas()
    got = got.sort_values(["seg", "pivot"], kind="stable")
    n = got["n"].to_numpy()
    block, parts, at, room = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), -1, 0
    for i, size in enumerate(n.tolist()):
        if size > BLOCK:
            block[i], parts[i] = at + 1, -(-size // BLOCK)
            at, room = at + int(parts[i]), 0
        else:
            if size > room:
                at, room = at + 1, BLOCK
            block[i] = at
            room -= size
    return Cells(pivots, got["seg"].to_numpy(object), got["pivot"].to_numpy(), n, got["low"].to_numpy(), got["high"].to_numpy(), block, parts, got["code"].to_numpy(), (got["code"] == got["last"]).to_numpy())


def in_blocks(dealt_rows: DataFrame, cells: Cells) -> DataFrame:
    """The rows with cell and block."""
    # one row for each cell
    table = dealt_rows.sparkSession.createDataFrame(
        [(str(s), int(p), i, int(b), int(k)) for i, (s, p, b, k) in enumerate(zip(cells.segment, cells.pivot, cells.block, cells.parts, strict=True))], "seg string, pivot int, cell int, first int, parts int"
    )
    placed = dealt_rows.join(F.broadcast(table), ["seg", "pivot"])
    return placed.withColumn("block", F.col("first") + share("row_id", F.col("parts"))).drop("pivot", "low", "high", "first", "parts")
