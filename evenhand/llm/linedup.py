"""Line dedup: lines that many documents hold go from all of them but the one with the largest id.

1. Each text gives a row for every line whose key is long enough: a 128-bit hash of the key, document, position.
2. Rows are range-partitioned and sorted by hash, document (largest first) and position. A frequent line spreads over as many
   partitions as its rows need, for the document is part of the range.
3. Each partition is streamed once. The first document of a hash keeps its lines, those from the third on lose them, and the
   second loses them if a third follows. Only a partition's first and last hash may go on in others: of these at most two
   documents' lines wait, and at most three ids of each tell the others what the partition held (six rows a partition).
4. Positions that go are gathered by document and become a bitmap of lines that stay, packed and compressed. Texts aren't
   moved for it; ``applied`` brings bitmaps and texts together where the lines themselves are asked for.

A null or empty text is one empty line. Keys are compared after stripping spaces, tabs, line feeds, vertical tabs, form feeds
and carriage returns and lower-casing A-Z. Rows that share an id are one document, whatever their texts; a null id is one
document that is smaller than all others. Repeated rows therefore don't make a line frequent, and repeat in the result. All
lines of the largest document stay, equal ones too. Ids are whole numbers. Very long texts are taken whole. Other columns,
whatever their names, are not looked at. An empty table has an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.llm.common import WHITE, col, cut

# Code points that a key has at least, and documents that hold it.
LEAST_POINTS, LEAST_DOCUMENTS = 20, 3
#: Output rows of the stream at a time.
ROWS = 65_536


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line, as UTF-8."""
    return [line.strip(WHITE) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS) -> DataFrame:
    """a, b (hash of the key), id, t (tells the texts of one id apart) and pos of each line with a key that is long enough."""
    names = ["a", "b", "id", "t", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows, texts, places, size = [], [], [], [], 0
            ids, digests = batch.column(0), batch.column(2).to_pylist()

            def made(hashes=hashes, rows=rows, texts=texts, places=places, ids=ids):
                pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                columns = [pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])), ids.take(pa.array(rows, pa.int64())), pa.array(texts, pa.int64()), pa.array(places, pa.int32())]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                keys = line_keys(text)
                long = [p for p, key in enumerate(keys) if len(key) >= least_points and _points(key) >= least_points]
                if not long:
                    continue
                hashes += [xxhash.xxh3_128_digest(keys[p]) for p in long]
                rows += [i] * len(long)
                texts += [digests[i]] * len(long)
                places += long
                size += len(long)
                if size >= ROWS:
                    yield made()
                    for part in (hashes, rows, texts, places):
                        part.clear()
                    size = 0
            yield made()

    narrow = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    return narrow.mapInArrow(run, "a long, b long, id long, t long, pos int")


GOES, WAITS, TELLS = 0, 1, 2


class _Stream:
    """State of one partition: the current hash, how many documents of it went by, and the second one's rows."""

    def __init__(self, least: int) -> None:
        self.least, self.hash, self.first, self.seen = least, None, True, 0
        self.doc = None
        self.held: list[np.ndarray] = []  # rows of the documents whose fate the number of documents decides
        self.told: list[tuple] = []  # the largest documents of the current hash

    def close(self, last: bool) -> list[tuple[int, np.ndarray]]:
        """What the end of the current hash settles: held rows stay, unless the hash may go on in another partition."""
        if self.hash is None or not (self.first or last):
            return []
        out = [(WAITS, rows) for rows in self.held]
        told = np.array([(*self.hash, has, doc, 0, 0) for has, doc in self.told], np.int64).reshape(-1, 6)
        return [*out, (TELLS, told)]

    def run(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Rows (a, b, has, id, t, pos) of one hash, in order."""
        docs = rows[:, 2:4]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (docs[1:] != docs[:-1]).any(1)
        fresh[0] = self.doc is None or tuple(docs[0]) != self.doc
        number = self.seen + np.cumsum(fresh)
        for i in np.flatnonzero(fresh & (number <= self.least)):
            self.told.append(tuple(docs[i]))
        self.seen, self.doc = int(number[-1]), tuple(docs[-1])
        out = []
        if self.seen >= self.least and not self.first:
            out += [(GOES, held) for held in self.held]
            self.held = []
        # in the first hash the largest document may lie in another partition, so even the first here has to wait
        low = 1 if self.first else 2
        waits = (number >= low) & (number < self.least)
        goes = number >= self.least
        if waits.any():
            if self.seen >= self.least and not self.first:
                goes |= waits
            else:
                self.held.append(rows[waits])
        if goes.any():
            out.append((GOES, rows[goes]))
        return out

    def batch(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        edges = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        bounds = np.concatenate([[0], edges, [len(rows)]])
        if self.hash is not None and tuple(rows[0, :2]) == self.hash:
            yield from self.run(rows[: bounds[1]])
            bounds = bounds[1:]
        if len(bounds) < 2:
            return
        # hashes that begin and end inside the batch and aren't the partition's first are settled all at once
        if self.hash is None:
            self.hash = tuple(rows[0, :2])
            yield from self.run(rows[: bounds[1]])
            bounds = bounds[1:]
            if len(bounds) < 2:
                return
        yield from self.close(False)
        inner = rows[bounds[0] : bounds[-2]]
        if len(inner):
            yield GOES, inner[self.settled(inner)]
        tail = rows[bounds[-2] :]
        self.hash, self.first, self.seen, self.doc, self.held, self.told = tuple(tail[0, :2]), False, 0, None, [], []
        yield from self.run(tail)

    def settled(self, rows: np.ndarray) -> np.ndarray:
        """Which rows of whole hashes go: those beyond the first document, where there are enough documents."""
        new_hash, fresh = np.ones(len(rows), bool), np.ones(len(rows), bool)
        new_hash[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        fresh[1:] = (rows[1:, :4] != rows[:-1, :4]).any(1)
        run, count = np.cumsum(new_hash) - 1, np.cumsum(fresh)
        before = (count - 1)[new_hash][run]
        total = np.bincount(run, weights=fresh)[run]
        return (total >= self.least) & (count - before > 1)


def streamed(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """kind (GOES, WAITS or TELLS), a, b, has, id, t, pos from lines in range partitions."""
    names = ["kind", "a", "b", "has", "id", "t", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(least_documents)

        def made(found):
            for kind, rows in found:
                if len(rows):
                    columns = [np.full(len(rows), kind, np.int64), *(np.ascontiguousarray(rows[:, i]) for i in range(6))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in batches:
            if batch.num_rows:
                yield from made(state.batch(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)], 1)))
        yield from made(state.close(True))

    keys = lines.select("a", "b", F.col("id").isNotNull().cast("long").alias("has"), F.coalesce("id", F.lit(0)).alias("id"), "t", F.col("pos").cast("long").alias("pos"))
    order = ["a", "b", F.desc("has"), F.desc("id"), "t", "pos"]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "kind long, a long, b long, has long, id long, t long, pos long")


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """has, id, t and pos of every line that goes."""
    if least_documents < 2:
        raise ValueError("a line of a single document can't be repeated")
    lines = cut(hashed_lines(docs, id_col, text_col, least_points))  # ranges are sampled from it
    found = cut(streamed(lines, least_documents))
    told = found.where(F.col("kind") == TELLS).select("a", "b", F.struct("has", "id").alias("d"))
    # two hashes and three ids of each a partition
    verdict = told.groupBy("a", "b").agg(F.max("d").alias("top"), (F.size(F.array_distinct(F.collect_list("d"))) >= least_documents).alias("many"))
    waits = found.where(F.col("kind") == WAITS).join(F.broadcast(verdict), ["a", "b"]).where(F.col("many") & (F.col("top") != F.struct("has", "id")))
    kept = ["has", "id", "t", "pos"]
    return found.where(F.col("kind") == GOES).select(*kept).unionByName(waits.select(*kept))


def packed(n_lines: int, gone: list[int]) -> bytes:
    """A compressed bitmap of the lines that stay, the first line in the highest bit."""
    keep = np.ones(n_lines, bool)
    keep[np.asarray(gone, np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """has, id, t, n_dropped, last and keep of each text that loses lines: a compressed bitmap of the lines up to the last one that
    goes, set for those that stay. Lines behind it stay."""

    @F.pandas_udf("binary")
    def bitmap(pos):
        import pandas as pd

        return pd.Series([packed(int(max(p)) + 1, p) for p in pos])

    lost = dropped(docs, id_col, text_col, **options).groupBy("has", "id", "t").agg(F.collect_set("pos").alias("p"))
    return lost.select("has", "id", "t", F.size("p").cast("long").alias("n_dropped"), F.array_max("p").alias("last"), bitmap("p").alias("keep"))


def applied(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """id_col, n_lines, n_dropped, kept_sha256 and keep (null: all lines stay) of each row; with ``texts`` the kept text too."""
    rows = docs.select(col(id_col).alias("~doc"), col(id_col).cast("long").alias("~n"), col(text_col).cast("string").alias("~text"))
    rows = rows.select("~doc", "~text", F.col("~n").isNotNull().cast("long").alias("has"), F.coalesce("~n", F.lit(0)).alias("id"), F.xxhash64("~text").alias("t"))
    met = rows.join(maps, ["has", "id", "t"], "left").select("~doc", "~text", "last", "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text, last, keep in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                raw, keep = (text.as_py() or "").encode("utf-8", "surrogatepass"), keep.as_py()
                n = raw.count(b"\n") + 1
                lost = 0
                if keep is not None:
                    stays = unpacked(keep, last.as_py() + 1)
                    lines = raw.split(b"\n")
                    raw = b"\n".join([x for x, k in zip(lines, stays.tolist(), strict=False) if k] + lines[len(stays) :])
                    lost = int((~stays).sum())
                for values, value in zip(out, (n, lost, hashlib.sha256(raw).hexdigest(), raw if texts else b""), strict=True):
                    values.append(value)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), batch.column(3)]
            if texts:
                arrays.append(pa.array(out[3], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    fields = [T.StructField("d", met.schema["~doc"].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("keep", T.BinaryType())]
    schema = T.StructType(fields + ([T.StructField("kept_text", T.StringType())] if texts else []))
    return met.mapInArrow(run, schema).withColumnRenamed("d", id_col)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, **options) -> DataFrame:
    """Each row's id, counts, digest of the lines that stay, and their bitmap."""
    return applied(docs, cut(bitmaps(docs, id_col, text_col, **options)), id_col, text_col, texts)
