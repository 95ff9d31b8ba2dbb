"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.sources.staging import cut, shared_folder  # noqa: F401  for the modules beside this one

#: Rows handed to a text function at a time; bounds what a worker holds beside the Arrow batch.
ROWS_AT_ONCE = 512
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_enough(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of a digest or an id or two in each row, to be broadcast if it has at most ``most`` rows: about 10 MB. Larger ones
    are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def text_map(df: DataFrame, text_col: str, keep: list[str], outputs: list[T.StructField], fn: Callable[[list], list[list]]) -> DataFrame:
    """The columns ``keep`` and, beside them, what ``fn`` makes of each text.

    fn takes a list of texts (None for null) and returns one list for each field of ``outputs``.
    Rows stay where they are: there is no shuffle.
    """
    kept = [col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    narrow = df.select(*kept, col(text_col).alias("text"))
    made = T.StructType([*narrow.schema.fields[: len(keep)], *(T.StructField(f"o{i}", f.dataType, True) for i, f in enumerate(outputs))])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in outputs]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                columns = fn(batch.column(n).to_pylist())
                arrays = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=made.names)

    out = narrow.mapInArrow(run, made)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f"o{i}").alias(f.name) for i, f in enumerate(outputs)))


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind), True)


def labelled_sample(docs: DataFrame, labels: DataFrame, value_col: str, limit: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, y and text of at most ``limit`` labelled documents, one row for each id, the same at every run.

    A label that is null is none; where an id has several labels or texts the smallest holds.
    """
    one = labels.where(col(id_col).isNotNull() & col(value_col).isNotNull()).groupBy(col(id_col).alias("~id")).agg(F.min(col(value_col)).cast("int").alias("~y"))
    picked = one.orderBy(F.xxhash64(F.col("~id"), F.lit(seed)), "~id").limit(limit)
    # ``limit`` rows of two numbers are broadcast
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("~id"))
    return rows.groupBy("id").agg(F.min("~y").alias("y"), F.min("text").alias("text"))
