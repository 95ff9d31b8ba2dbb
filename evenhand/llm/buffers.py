"""Texts as the byte buffers of Arrow columns: classes of bytes, prefix sums and words of many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.llm.common import col

#: Bytes of text that are scanned at a time, unless one text alone is longer.
CHUNK = 1 << 21
#: Elements of the wider arrays that are made on the way, whatever the length of a text.
PIECE = 1 << 20


def classes(*members: bytes) -> np.ndarray:
    """A table of 256 booleans, true for the given bytes."""
    table = np.zeros(256, bool)
    table[np.frombuffer(b"".join(members), np.uint8)] = True
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, and where each begins and the last ends; null is empty. Nothing is copied."""
    wide = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of rows of about CHUNK bytes: first row, row behind the last, their bytes and offsets."""
    data, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def counts_between(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True entries between each offset and the next: differences of prefix sums, which are made a piece at a time."""
    sums, base = np.zeros(len(offsets), np.int64), 0
    for at in range(0, len(mask), PIECE):
        run = np.cumsum(mask[at : at + PIECE], dtype=np.int64)
        a, b = np.searchsorted(offsets, (at + 1, at + len(run) + 1))
        sums[a:b] = base + run[offsets[a:b] - at - 1]
        base += int(run[-1])
        sums[b:] = base
    return np.diff(sums)


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true entries; none crosses an offset."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    some = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][some], offsets[1:][some] - 1
    starts[first], ends[last] = inside[first], inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given spans one behind the other, and the place of each inside its span."""
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return data[np.repeat(starts, sizes) + place], place


def pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of spans of about PIECE bytes in all, or one longer span."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        yield first, last
        first = last


def buffer_map(df: DataFrame, text_col: str, keep: list[str], outputs: list[T.StructField], fn: Callable[[np.ndarray, np.ndarray], list]) -> DataFrame:
    """The columns ``keep`` and, beside them, what ``fn`` makes of each text.

    fn takes the bytes of a stretch of texts and their offsets, and returns an array for each field of ``outputs``. Rows stay
    where they are: there is no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    narrow = df.select(*(col(c).alias(f"k{i}") for i, c in enumerate(keep)), col(text_col).cast("string").alias("text"))
    made = T.StructType([*narrow.schema.fields[: len(keep)], *(T.StructField(f"o{i}", f.dataType, True) for i, f in enumerate(outputs))])
    kinds, n = [to_arrow_type(f.dataType) for f in outputs], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(n)):
                arrays = [pa.array(x, type=t) for x, t in zip(fn(data, offsets), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns[:n], *arrays], names=made.names)

    out = narrow.mapInArrow(run, made)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f"o{i}").alias(f.name) for i, f in enumerate(outputs)))
