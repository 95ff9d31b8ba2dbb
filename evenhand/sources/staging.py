"""Tables written on the way, so that plans stay small and what is read several times is computed once."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: The session setting with which Spark removes the shuffle files of a query at its end.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark runs
    in one process, as in tests."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to a new table in the shared folder, and read again from there.

    Parquet takes a fraction of the room of a checkpoint, planning knows its size, and a lost executor loses nothing of it.
    The tables stay until the folder is cleared, as checkpoints of a failed application would, unless ``let_go`` removes them.
    Shuffle files go once the table is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evenhand-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.is_cut, out.path = True, path
    return out


def let_go(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` has written for the caller alone, once all that reads them is cut as well."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, work: float, *by: str) -> DataFrame:
    """df dealt out by columns, for tasks that compute long over few bytes, which Spark would merge into a few tasks: ``work``
    partitions, spark.sql.shuffle.partitions at most."""
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(work))
    return df.repartition(parts, *by) if parts > 1 else df


def once(df: DataFrame) -> DataFrame:
    """df, cut unless it comes from ``cut`` as it is: for operators that read their rows several times."""
    return df if getattr(df, "is_cut", False) else cut(df)
