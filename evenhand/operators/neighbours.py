"""Exact nearest neighbours: a join that looks only where a nearer row can be, and a blocked one for what fits one block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenhand.operators import cells as voronoi
from evenhand.operators.cells import matrix, products, segments, share, slack
from evenhand.sources.staging import cut, let_go, spread as dealt_out

#: Bytes of the blocks that a task holds while queries pass by.
HELD = 1 << 25


def _blocks(queries: DataFrame, rows: DataFrame, by: list[str], a: int, b: int) -> tuple:
    """The two sides, dealt into a times b blocks, to be grouped by (g, x, y) and (h, u, v)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group, code = segments(by), F.xxhash64(F.col("label").cast("string")).alias("code")
    left = queries.select(group.alias("g"), share("row_id", a).alias("x"), every(b).alias("y"), "row_id", "features", code, *(c for c in queries.columns if c == "radius"))
    right = rows.select(group.alias("h"), every(a).alias("u"), share("row_id", b).alias("v"), F.col("row_id").alias("rid"), "label", F.col("features").alias("rf"), code)
    return left.groupBy("g", "x", "y").cogroup(right.groupBy("h", "u", "v"))


def _parts(n: int) -> int:
    return max(1, -(-n // voronoi.BLOCK))


def _exact(p: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for c in range(x.shape[1]):
        out += (p[i, c] - x[j, c]) ** 2
    return out


def _best(own: np.ndarray, p: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, exclude_self: bool, barred=None, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows and their squared distances: the k nearest rows of each query, equal ones in their order.

    ``barred`` takes a slice of the queries and says which rows they may not meet. Rows beyond the squared distance ``limit``
    of a query may be left out.
    """
    place = pd.Index(ids).get_indexer(own)  # of the query itself among the rows
    got = []
    for begin in range(0, len(own), 256):
        part, itself = p[begin : begin + 256], place[begin : begin + 256]
        d = products(part, x)
        if exclude_self:
            d[np.flatnonzero(itself >= 0), itself[itself >= 0]] = np.inf
        if barred is not None:
            d[barred(slice(begin, begin + 256))] = np.inf
        # the product may reorder near ties: exact distances decide among all that rounding can't tell from the k-th
        if limit is not None and np.isfinite(limit[begin : begin + 256]).all():
            kth = limit[begin : begin + 256]
        else:
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(part), np.inf)
        i, j = np.nonzero(~(d > (kth + slack(part, x))[:, None]) & (d < np.inf))
        d2 = _exact(part, x, i, j)
        order = np.lexsort((j, j != itself[i], d2, i))
        i, j, d2 = i[order], j[order], d2[order]
        first = np.searchsorted(i, i)  # of the query's own
        top = np.arange(len(i)) - first < k
        got.append((i[top] + begin, j[top], d2[top]))
    return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, int),) * 2 + (np.zeros(0),)


def _result(rows: DataFrame) -> T.StructType:
    kind = rows.schema["row_id"].dataType
    return T.StructType([T.StructField("query_id", kind), T.StructField("row_id", kind), T.StructField("d2", T.DoubleType()), T.StructField("label", rows.schema["label"].dataType)])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("d2", F.col("query_id") != F.col("row_id"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "d2", "label")


def nearest(queries: DataFrame, rows: DataFrame, k: int, by: list[str] | None = None, exclude_self: bool = True, n_rows: int | None = None, n_queries: int | None = None, unlike: bool = False, compared: Accumulator | None = None) -> DataFrame:
    """query_id, rank, row_id, d2 (squared distance) and the ``label`` of each neighbour: the k nearest of each query, with
    ``by`` among the rows that agree in these columns, with ``unlike`` among the rows of other labels.

    Ties go to the query itself and then to the smaller id. Up to BLOCK rows are one block, which all queries meet. More are
    dealt into Voronoi cells, and a query meets a cell only if a row there can be as near as the k-th known: see ``pruned``.
    The numbers of rows, if they are known (an upper bound will do), save counting. ``compared`` counts the pairs compared.
    ``reads`` of the result names the tables that were written for it, to be let go by a caller that has cut what it made of it.
    """
    n = n_rows or rows.count()
    if n > voronoi.BLOCK:
        return pruned(queries, rows, k, by, exclude_self, n, unlike, compared)
    schema = _result(rows)

    def top(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return _none(schema)
        r = r.sort_values("rid")
        ids, own, codes, own_codes = r["rid"].to_numpy(), q["row_id"].to_numpy(), r["code"].to_numpy(), q["code"].to_numpy()
        barred = (lambda s: own_codes[s, None] == codes[None, :]) if unlike else None
        i, j, d2 = _best(own, matrix(q["features"]), ids, matrix(r["rf"]), k, exclude_self, barred)
        if compared is not None:
            compared.add(len(q) * len(r))
        return pd.DataFrame({"query_id": own[i], "row_id": ids[j], "d2": d2, "label": r["label"].to_numpy()[j]})

    found = _blocks(queries, rows, by or [], _parts(n_queries or queries.count()), 1).applyInPandas(top, schema)
    out = _ranked(found, k)
    out.reads = []
    return out


def _meet(queries: DataFrame, counts: DataFrame, rows: DataFrame):
    """Queries and rows of the same block, in chunks of about BLOCK queries: only the rows of a block that more queries ask
    for are repeated. ``counts`` has block and the number of its queries, n."""
    # one row for each block
    chunks = cut(counts.select("block", F.ceil(F.col("n") / voronoi.BLOCK).cast("int").alias("chunks")))
    left = queries.join(chunks, "block").withColumn("chunk", share("query_id", F.col("chunks"))).drop("chunks")
    right = rows.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    work = chunks.agg(F.sum("chunks")).first()[0] or 0
    left, right = (dealt_out(side, work, "block", "chunk") for side in (left, right))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))


def _needed_blocks(known: voronoi.Cells, needed: np.ndarray, cell: np.ndarray | None = None) -> np.ndarray:
    """The blocks of the cells that any query needs; of a query's own ``cell``, if it has one part, none."""
    if cell is not None:
        needed = needed.copy()
        alone = np.flatnonzero(known.parts[cell] == 1)
        needed[alone, cell[alone]] = False
    cells = np.flatnonzero(needed.any(0))
    times = known.parts[cells]
    return np.unique(np.repeat(known.block[cells] - np.cumsum(times) + times, times) + np.arange(times.sum()))


def _packed_blocks(placed: DataFrame) -> DataFrame:
    """One row for each block: ids and labels as lists; cells, codes and features as bytes. Rows are sorted by cell and id."""
    kind, label = placed.schema["row_id"].dataType, placed.schema["label"].dataType
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("labels", T.ArrayType(label)), *(T.StructField(c, T.BinaryType()) for c in ("cells", "codes", "rows"))])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "row_id"])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "ids": [rows["row_id"].tolist()], "labels": [rows["label"].tolist()], "cells": [rows["cell"].to_numpy(np.int32).tobytes()], "codes": [rows["code"].to_numpy(np.int64).tobytes()], "rows": [matrix(rows["features"]).tobytes()]})

    return placed.groupBy("block").applyInPandas(pack, schema)


def _paired(packs: DataFrame, blocks: DataFrame, n: int, width: int) -> DataFrame:
    """Each pack of queries (one row) beside each block that it needs (``needs``).

    A product of partitions: a task reads the packs of one and the blocks of one, so nothing is repeated on disk, whatever the
    number of pairs is. It holds its blocks, HELD bytes of features or a little more, and packs come one after the other.
    """
    conf = packs.sparkSession.conf
    right = max(1, min(-(-n * width * 8 // HELD), -(-n // voronoi.BLOCK)))
    left = max(1, min(-(-int(conf.get("spark.sql.shuffle.partitions")) // right), -(-n // voronoi.BLOCK)))
    return packs.repartition(left).join(blocks.repartition(right).hint("shuffle_replicate_nl"), F.array_contains("needs", F.col("block")))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows as dictionaries of Arrow scalars, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(at)[i] for at, name in enumerate(batch.schema.names)}


def _numbers(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _values(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def _by_cell(block: dict) -> Iterator[tuple[int, slice]]:
    """The cells of a block and their rows there."""
    cells = _numbers(block["cells"], np.int32)
    edges = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, len(cells)]
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(cells[x]), slice(x, y)


def _asked(needed: Callable[[slice], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries by the cells that they need, and where each cell's begin; ``needed`` says for a slice of the n queries which."""
    got = [np.nonzero(needed(slice(at, at + 256)).T) for at in range(0, n, 256)]
    cells, who = np.concatenate([c for c, _ in got]), np.concatenate([(q + 256 * at) for at, (_, q) in enumerate(got)])
    order = np.argsort(cells, kind="stable")
    return who[order].astype(np.int32), cells[order].astype(np.int32)


def pruned(queries: DataFrame, rows: DataFrame, k: int, by: list[str] | None = None, exclude_self: bool = True, n_rows: int | None = None, unlike: bool = False, compared: Accumulator | None = None) -> DataFrame:
    """What ``nearest`` gives, by Voronoi cells.

    1. Of rows with equal vectors in a segment (their class, if it matters) only the k + 1 with the smallest ids can be
       neighbours; the others go, by a limit that Spark applies before its shuffle. So copies fill no cell.
    2. Each query meets its nearest cell with enough rows. The k-th distance found there, or a bound from the sizes of the
       cells around, is its radius.
    3. It meets the blocks that hold other cells which its radius reaches: cells are ruled out by the distance of their rings
       and by the planes between pivots. Queries of one home are a pack, and tasks read packs and blocks in turns: see ``_paired``.

    Queries may have a column ``reach``, a squared distance beyond which rows are of no use to them: what is found beyond it
    may lack nearer rows. At home, blocks that many queries ask for are repeated for chunks of them, so a task has about BLOCK
    rows on either side. Vectors without structure (many independent dimensions) rule out little, and the work is then that of
    all blocks; what is written stays in proportion to the rows, times k for each HELD bytes of them.
    """
    n_segments = rows.select(*(["label"] if unlike else by)).distinct().count() if by or unlike else 1
    # with few labels cells hold one each; with many, as in growing components, rows of several share a cell
    seg = segments(["label"] if unlike and n_segments <= voronoi.MOST_LABELS else by or [])
    code = F.xxhash64(F.col("label").cast("string")).alias("code")
    added = not exclude_self and queries is rows  # each query's own row is then known without a search
    plain = lambda df: df.select("row_id", "label", "features", seg.alias("seg"), code)
    points = plain(rows)
    if exclude_self or added:
        copies = Window.partitionBy("seg", "features", *(["code"] if unlike else [])).orderBy("row_id")
        points = points.withColumn("~copy", F.row_number().over(copies)).where(F.col("~copy") <= k + 1).drop("~copy")
    n = n_rows or rows.count()
    points = cut(dealt_out(points, n / voronoi.BLOCK, "row_id"))
    pivots = voronoi.pivots_of(points, n, 1 if unlike and n_segments > voronoi.MOST_LABELS else max(1, n_segments))
    put = cut(voronoi.dealt(points, pivots))
    cells = voronoi.cells_of(put, pivots)
    placed = cut(voronoi.in_blocks(put, cells))
    let_go(points, put)
    shipped = rows.sparkSession.sparkContext.broadcast(cells)
    kind, label = rows.schema["row_id"].dataType, rows.schema["label"].dataType
    asking = T.StructType([T.StructField("query_id", kind), T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("seg", T.StringType()), T.StructField("code", T.LongType()), T.StructField("reach", T.DoubleType())])
    reach = (F.col("reach") if "reach" in queries.columns else F.lit(float("inf"))).cast("double").alias("reach")

    # the query's home: the nearest cell with more than k rows, or the largest
    def home(batches):
        known = shipped.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                p = matrix(part["features"])
                admitted = known.admitted(part["seg"].to_numpy(object), part["code"].to_numpy(), unlike)
                away = np.where(admitted, known.bounds(p)[1][:, known.pivot], np.inf)
                enough = np.where(known.n[None, :] > k, away, np.inf)
                cell = np.where(np.isfinite(enough.min(1)), np.argmin(enough, 1), np.argmin(away, 1))
                some = admitted.any(1)
                yield pd.DataFrame({"query_id": part["row_id"], "features": part["features"], "seg": part["seg"], "code": part["code"], "reach": part["reach"], "cell": cell, "first": known.block[cell], "parts": known.parts[cell]})[some]

    homes = dealt_out(queries.select("row_id", "features", seg.alias("seg"), code, reach), n / voronoi.BLOCK, "row_id").mapInPandas(home, T.StructType([*asking.fields, *(T.StructField(c, T.IntegerType()) for c in ("cell", "first", "parts"))]))
    homes = cut(homes.withColumn("block", F.col("first") + share("query_id", F.col("parts"))).drop("first", "parts"))

    def within_reach(known, p, segs, codes, radius):
        """For each query the cells that its radius reaches."""
        bounds, admitted = known.bounds(p), known.admitted(segs, codes, unlike)
        return admitted & (known.least(p, bounds) <= (radius * (1 + 1e-9))[:, None])

    def compare(own, p, codes, asks, ids, x, theirs, limit=None):
        """(queries, rows, squared distances) of the best that the queries at ``asks`` meet in a cell."""
        barred = (lambda s, a=codes[asks], b=theirs: a[s, None] == b[None, :]) if unlike else None
        if compared is not None:
            compared.add(len(asks) * len(ids))
        i, j, d2 = _best(own[asks], p[asks], ids, x, k, exclude_self or added, barred, None if limit is None else limit[asks])
        return asks[i], j, d2

    binary = lambda *names: [T.StructField(c, T.BinaryType()) for c in names]
    met = T.StructType([T.StructField("pack", T.StringType()), T.StructField("home", T.IntegerType()), T.StructField("needs", T.ArrayType(T.IntegerType())), T.StructField("own", T.ArrayType(kind)), T.StructField("segs", T.ArrayType(T.StringType())), *binary("asking", "points", "radii", "at")])
    met = T.StructType([*met.fields, T.StructField("query_ids", T.ArrayType(kind)), T.StructField("row_ids", T.ArrayType(kind)), T.StructField("d2s", T.ArrayType(T.DoubleType())), T.StructField("found", T.ArrayType(label))])

    def at_home(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        """One row: the queries of a pack, what they need beyond, and the nearest rows at home."""
        if not len(q):
            return _none(met)
        known = shipped.value
        q, r = q.reset_index(drop=True), r.sort_values("row_id").reset_index(drop=True)
        cell, own, codes, p, segs = q["cell"].to_numpy(), q["query_id"].to_numpy(), q["code"].to_numpy(), matrix(q["features"]), q["seg"].to_numpy(object)
        got = [(np.zeros(0, int),) * 2 + (np.zeros(0),)]
        for c, part in r.groupby("cell", sort=True):
            asks = np.flatnonzero(cell == c)
            if len(asks):
                i, j, d2 = compare(own, p, codes, asks, part["row_id"].to_numpy(), matrix(part["features"]), part["code"].to_numpy())
                got.append((i, part.index.to_numpy()[j], d2))
        i, j, d2 = (np.concatenate(c) for c in zip(*got, strict=True))
        kth = np.full(len(q), np.inf)
        full = np.bincount(i, minlength=len(q)) >= k
        last = np.zeros(len(q))
        np.maximum.at(last, i, d2)
        kth[full] = last[full]
        radius, blocks = np.sqrt(np.minimum(kth, q["reach"].to_numpy(float))), []
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            # one row more, as the query may be among them
            radius[part] = np.minimum(radius[part], known.most(known.bounds(p[part]), known.admitted(segs[part], codes[part], unlike), k + 1, unlike))
            blocks.append(_needed_blocks(known, within_reach(known, p[part], segs[part], codes[part], radius[part]), cell[part]))
        block, chunk = int(q["block"].iloc[0]), int(q["chunk"].iloc[0])
        lists = {"query_ids": own[i], "row_ids": r["row_id"].to_numpy()[j], "d2s": d2, "found": r["label"].to_numpy()[j]}
        return pd.DataFrame({"pack": [f"{block}:{chunk}"], "home": [block], "needs": [np.unique(np.concatenate(blocks)).tolist()], "own": [own.tolist()], "segs": [segs.tolist()], "asking": [codes.astype(np.int64).tobytes()], "points": [p.tobytes()], "radii": [radius.tobytes()], "at": [cell.astype(np.int32).tobytes()], **{c: [v.tolist()] for c, v in lists.items()}})

    first = cut(_meet(homes, homes.groupBy("block").agg(F.count(F.lit(1)).alias("n")), placed).applyInPandas(at_home, met))
    blocks = cut(_packed_blocks(placed))
    let_go(homes, placed)
    schema = _result(rows)
    width = pivots.shape[1]

    def at_once(meets, segment, ids):
        """Queries and rows that meet: where most queries need most cells of a segment, all of its rows at once are less work."""
        out = []
        for name in dict.fromkeys(segment):
            mine = [m for m, s in zip(meets, segment, strict=True) if s == name]
            some, rows_there = np.unique(np.concatenate([asks for asks, _ in mine])), np.concatenate([at for _, at in mine])
            if 2 * sum(len(asks) * len(at) for asks, at in mine) >= len(some) * len(rows_there):
                mine = [(some, rows_there[np.argsort(ids[rows_there], kind="stable")])]
            out += mine
        return out

    def beyond(batches):
        known, now = shipped.value, None

        def best(found: list[pd.DataFrame]) -> pd.DataFrame:
            whole = pd.concat(found)
            whole = whole.assign(other=whole["row_id"].to_numpy() != now["own"][whole["i"]]).sort_values(["i", "d2", "other", "row_id"])
            return whole[whole.groupby("i").cumcount().to_numpy() < k].drop(columns="other")

        def done():
            found = best(now["found"])
            whole = pd.DataFrame({"query_id": now["own"][found["i"]], "row_id": found["row_id"], "d2": found["d2"], "label": found["label"]})
            return pa.RecordBatch.from_pandas(whole, arrow, preserve_index=False)

        for row in _each(batches):
            if now is None or now["pack"] != row["pack"].as_py():
                if now is not None and now["found"]:
                    yield done()
                p, segs, codes, radius = _numbers(row["points"], float).reshape(-1, width), _values(row["segs"]).astype(object), _numbers(row["asking"], np.int64), _numbers(row["radii"], float)
                who, cells = _asked(lambda s, p=p, segs=segs, codes=codes, radius=radius: within_reach(known, p[s], segs[s], codes[s], radius[s]), len(p))
                now = {"pack": row["pack"].as_py(), "own": _values(row["own"]), "home": row["home"].as_py(), "cell": _numbers(row["at"], np.int32), "found": [], "limit": radius * radius * (1 + 1e-9)}
            here = row["block"].as_py()
            ids, labels, x, theirs = _values(row["ids"]), _values(row["labels"]), _numbers(row["rows"], float).reshape(-1, width), _numbers(row["codes"], np.int64)
            meets, segment = [], []
            for c, part in _by_cell(row):
                asks = who[np.searchsorted(cells, c) : np.searchsorted(cells, c, "right")]
                if here == now["home"]:
                    asks = asks[now["cell"][asks] != c]
                meets.append((asks, np.arange(part.start, part.stop)))
                segment.append(known.segment[c])
            if here != now["home"]:
                meets = at_once(meets, segment, ids)
            new = []
            for asks, at in meets:
                if len(asks):
                    i, j, d2 = compare(now["own"], p, codes, asks, ids[at], x[at], theirs[at], now["limit"] if now["found"] else None)
                    new.append(pd.DataFrame({"i": i, "row_id": ids[at[j]], "d2": d2, "label": labels[at[j]]}))
            if any(map(len, new)):
                whole = best([*now["found"], *new])
                last = whole.groupby("i")["d2"].agg(["size", "max"])
                full = last[last["size"] >= k]
                now["limit"][full.index.to_numpy()] = full["max"].to_numpy()
                now["found"] = [whole]
        if now is not None and now["found"]:
            yield done()

    arrow = to_arrow_schema(schema)
    far = _paired(first.drop("query_ids", "row_ids", "d2s", "found"), blocks, n, width).mapInArrow(beyond, schema)
    near = first.select(F.explode(F.arrays_zip("query_ids", "row_ids", "d2s", "found")).alias("x")).select(F.col("x.query_ids").alias("query_id"), F.col("x.row_ids").alias("row_id"), F.col("x.d2s").alias("d2"), F.col("x.found").alias("label"))
    found = near.unionByName(far)
    if added:
        found = found.unionByName(rows.select(F.col("row_id").alias("query_id"), "row_id", F.lit(0.0).alias("d2"), "label"))
    out = _ranked(found, k)
    out.reads = [first, blocks]
    return out


def _none(schema: T.StructType) -> pd.DataFrame:
    """No rows, of a type that all columns take."""
    return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})


def within(rows: DataFrame, radii: DataFrame, n_rows: int | None = None, compared: Accumulator | None = None) -> DataFrame:
    """row_id, n_within (rows of its label nearer than its radius, itself not counted), n_holding (rows of its label that hold
    it within theirs) and farthest (distance of the farthest row of its label).

    radii has row_id and radius. Up to BLOCK rows are one block. More are dealt into Voronoi cells: a cell that lies wholly
    inside a row's radius is counted as a whole, one that lies outside not at all, and only rows of the others are compared,
    and of those that can hold the farthest row. Equal rows fill a cell of no width, so copies are counted and not compared.
    """
    asking = rows.join(radii.select("row_id", "radius"), "row_id")
    n = n_rows or rows.count()
    schema = T.StructType([T.StructField("row_id", rows.schema["row_id"].dataType), T.StructField("n_within", T.LongType()), T.StructField("n_holding", T.LongType()), T.StructField("farthest", T.DoubleType())])
    if n > voronoi.BLOCK:
        found = _within_cells(asking, n, schema, compared)
    else:

        def count(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return _none(schema)
            return pd.concat(_counted(q["row_id"].to_numpy(), matrix(q["features"]), q["radius"].to_numpy(float), r["rid"].to_numpy(), matrix(r["rf"])))

        found = _blocks(asking, rows, ["label"], 1, 1).applyInPandas(count, schema)
    return found.groupBy("row_id").agg(F.sum("n_within").alias("n_within"), F.sum("n_holding").alias("n_holding"), F.max("farthest").alias("farthest"))


def _counted(own: np.ndarray, p: np.ndarray, radius: np.ndarray, ids: np.ndarray, x: np.ndarray, counts=None, far=None) -> list[pd.DataFrame]:
    """What rows x add to the counts of the rows p, and these to theirs; ``counts`` and ``far`` say for which of p."""
    place, holding, out = pd.Index(ids).get_indexer(own), np.zeros(len(ids), np.int64), []
    for begin in range(0, len(own), 256):
        part = slice(begin, begin + 256)
        d, s, r = products(p[part], x), slack(p[part], x)[:, None], radius[part, None]
        inside = np.sqrt(np.maximum(d, 0)) < r
        # radii are distances of rows: exact distances decide where rounding could
        off = 2 * s + 1e-12 * np.where(np.isfinite(r), r, 0.0) ** 2
        i, j = np.nonzero(np.isfinite(r) & (np.abs(d - np.where(np.isfinite(r), r, 0.0) ** 2) <= off))
        inside[i, j] = np.sqrt(_exact(p[part], x, i, j)) < radius[part][i]
        itself = place[part]
        inside[np.flatnonzero(itself >= 0), itself[itself >= 0]] = False
        if counts is not None:
            inside &= counts[part, None]
        holding += inside.sum(0)
        last = d >= d.max(1)[:, None] - 2 * s
        if far is not None:
            last &= far[part, None]
        i, j = np.nonzero(last)
        farthest = np.zeros(len(d))
        np.maximum.at(farthest, i, np.sqrt(_exact(p[part], x, i, j)))
        out.append(pd.DataFrame({"row_id": own[part], "n_within": inside.sum(1), "n_holding": 0, "farthest": farthest}))
    return [*out, pd.DataFrame({"row_id": ids, "n_within": 0, "n_holding": holding, "farthest": 0.0})]


def _within_cells(asking: DataFrame, n: int, schema: T.StructType, compared: Accumulator | None) -> DataFrame:
    """Parts of the sums of ``within``, by cells of each label."""
    points = asking.select("row_id", "label", "features", segments(["label"]).alias("seg"), F.xxhash64(F.col("label").cast("string")).alias("code"), F.col("radius").cast("double").alias("radius"))
    points = cut(dealt_out(points, n / voronoi.BLOCK, "row_id"))
    pivots = voronoi.pivots_of(points, n, points.select("seg").distinct().count())
    put = cut(voronoi.dealt(points, pivots))
    cells = voronoi.cells_of(put, pivots)
    placed = cut(voronoi.in_blocks(put, cells))
    let_go(points, put)
    shipped = asking.sparkSession.sparkContext.broadcast(cells)
    kind = asking.schema["row_id"].dataType

    def wanted(known, p, segs, codes, radius):
        """Whether each cell lies inside the radius, is to be counted by rows, or may hold the farthest row."""
        radius, bounds, admitted = radius[:, None], known.bounds(p), known.admitted(segs, codes, False)
        low, high = (b[:, known.pivot] for b in bounds[:2])
        upper = high + known.high[None, :]
        whole = admitted & (upper < radius)
        some = admitted & ~whole & (known.least(p, bounds) < radius)
        # the cell's outermost row, or its innermost, is at least so far away, but for rounding
        sure = np.maximum(low - known.low[None, :], known.high[None, :] - high) - 4 * known.rounding(p)
        sure = np.where(admitted, sure, -np.inf).max(1)
        return whole, some, admitted & (upper >= (sure * (1 - 1e-9))[:, None])

    def reached(batches):
        """Rows, and for each cell whether it lies inside the radius, is to be counted by rows, or may hold the farthest row."""
        known = shipped.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256].reset_index(drop=True)
                yield known, part, *wanted(known, matrix(part["features"]), part["seg"].to_numpy(object), part["code"].to_numpy(), part["radius"].to_numpy(float))

    def wholly(batches):
        for known, part, whole, _, _ in reached(batches):
            own = whole[np.arange(len(part)), part["cell"].to_numpy()].astype(np.int64)  # the row itself is no neighbour
            yield pd.DataFrame({"row_id": part["row_id"], "n_within": (whole * known.n[None, :]).sum(1) - own, "n_holding": -own, "farthest": 0.0})

    def covered(batches):
        for _, _, whole, _, _ in reached(batches):
            times = whole.sum(0)
            yield pd.DataFrame({"cell": np.flatnonzero(times).astype(np.int32), "n": times[times > 0]})

    rows = placed.select("row_id", "features", "seg", "code", "radius", "cell")
    inner = rows.mapInPandas(wholly, schema)
    times = rows.mapInPandas(covered, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    held = placed.join(times, "cell").select("row_id", F.lit(0).cast("long").alias("n_within"), F.col("n").alias("n_holding"), F.lit(0.0).alias("farthest"))
    width = pivots.shape[1]
    binary = [T.StructField(c, T.BinaryType()) for c in ("asking", "points", "radii")]
    packed = T.StructType([T.StructField("pack", T.IntegerType()), T.StructField("needs", T.ArrayType(T.IntegerType())), T.StructField("own", T.ArrayType(kind)), T.StructField("segs", T.ArrayType(T.StringType())), *binary])

    def pack(q: pd.DataFrame) -> pd.DataFrame:
        """One row: the rows of a block as queries, and the blocks that they need."""
        blocks = [_needed_blocks(known, some | far) for known, _, _, some, far in reached([q])]
        return pd.DataFrame({"pack": q["block"].iloc[:1], "needs": [np.unique(np.concatenate(blocks)).tolist()], "own": [q["row_id"].tolist()], "segs": [q["seg"].tolist()], "asking": [q["code"].to_numpy(np.int64).tobytes()], "points": [matrix(q["features"]).tobytes()], "radii": [q["radius"].to_numpy(float).tobytes()]})

    packs = cut(placed.groupBy("block").applyInPandas(pack, packed))
    arrow = to_arrow_schema(schema)

    def compare(batches):
        """Counts of the queries, given when the last block of a pack has passed, and of the rows, given at the end."""
        known, now, holding = shipped.value, None, {}

        def made(ids, within, held, farthest):
            some = (within > 0) | (held > 0) | (farthest > 0)
            return pa.RecordBatch.from_pandas(pd.DataFrame({"row_id": ids[some], "n_within": within[some], "n_holding": held[some], "farthest": farthest[some]}), arrow, preserve_index=False)

        def done():
            return made(now["own"], now["within"], np.zeros(len(now["own"]), np.int64), now["farthest"])

        for row in _each(batches):
            if now is None or now["pack"] != row["pack"].as_py():
                if now is not None:
                    yield done()
                own, segs, codes = _values(row["own"]), _values(row["segs"]).astype(object), _numbers(row["asking"], np.int64)
                p, radius = _numbers(row["points"], float).reshape(-1, width), _numbers(row["radii"], float)
                now = {"pack": row["pack"].as_py(), "own": own, "within": np.zeros(len(own), np.int64), "farthest": np.zeros(len(own))}
                (who, cells), (who_far, cells_far) = (_asked(lambda s, m=m, p=p, segs=segs, codes=codes, radius=radius: wanted(known, p[s], segs[s], codes[s], radius[s])[m], len(p)) for m in (1, 2))
            here, ids, x = row["block"].as_py(), _values(row["ids"]), _numbers(row["rows"], float).reshape(-1, width)
            held = holding.setdefault(here, (ids, np.zeros(len(ids), np.int64)))[1]
            # cells that the same queries count are compared at once
            alike: dict[tuple, list] = {}
            for c, part in _by_cell(row):
                counts, far = (w[np.searchsorted(k, c) : np.searchsorted(k, c, "right")] for w, k in ((who, cells), (who_far, cells_far)))
                if len(counts) or len(far):
                    alike.setdefault((known.segment[c], counts.tobytes()), []).append((counts, far, np.arange(part.start, part.stop)))
            for same in alike.values():
                counts, far, at = same[0][0], np.unique(np.concatenate([f for _, f, _ in same])), np.concatenate([r for _, _, r in same])
                a = np.union1d(counts, far)
                *mine, theirs = _counted(own[a], p[a], radius[a], ids[at], x[at], np.isin(a, counts), np.isin(a, far))
                now["within"][a] += np.concatenate([m["n_within"].to_numpy() for m in mine])
                now["farthest"][a] = np.maximum(now["farthest"][a], np.concatenate([m["farthest"].to_numpy() for m in mine]))
                held[at] += theirs["n_holding"].to_numpy()
                if compared is not None:
                    compared.add(len(a) * len(at))
        if now is not None:
            yield done()
        for ids, held in holding.values():
            yield made(ids, np.zeros(len(ids), np.int64), held, np.zeros(len(ids)))

    near = _paired(packs, cut(_packed_blocks(placed)), n, width).mapInArrow(compare, schema)
    return inner.unionByName(held).unionByName(near)
