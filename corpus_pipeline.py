"""A corpus pipeline from the operators of evenhand.llm.

Each stage reads what the one before it wrote. Stages keep the columns of documents; the last one returns token digests and
each document's place in the mixture. Empty tables pass through; null and empty texts are scored, kept as documents of their
own, have no secrets and no tokens. Very long texts are taken whole. Repeated rows are copies of each other, and one stays.
Ties are settled by id, then by a digest of the text. Other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenhand.llm import bpe, minhash, nbsvm, pfair, secrets
from evenhand.llm.common import cut, shared_folder, small_enough, table
from evenhand.llm.queries import TARGETS
from evenhand.llm.suffix import text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a lower score go.
QUALITY = 0.3
#: Files whose rows are summed in one window.
FILES = 1024
#: Rows that go to a Python worker at a time: texts are long, and executors have little room beside their heap.
ARROW_ROWS = 1000


def _narrow_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    _narrow_batches(spark)
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return nbsvm.scored(docs, model, keep=tuple(COLUMNS)).where(F.col("score") >= QUALITY).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest id, of several rows of that id the one with the smallest
    digest of its text, of equal rows one. Texts without words are no duplicates and stay."""
    _narrow_batches(spark)
    keyed = docs.select(*COLUMNS, text_key("text").alias("~t"))
    found = cut(minhash.near_duplicates(keyed, keep=("~t",)).select(F.col("doc_id").alias("~id"), F.col("~t").alias("~k"), "component"))
    real = found.where(F.col("component").isNotNull())
    order = F.struct(F.col("~id").isNull().alias("none"), F.col("~id").alias("id"), F.col("~k").alias("k"))
    best = real.groupBy("component").agg(F.min(order).alias("m")).select(F.col("m.id").alias("~id"), F.col("m.k").alias("~k"))
    best = best.select(F.col("~id").alias("~bid"), F.col("~k").alias("~bk"))
    # pairs of id and digest that go are fewer than those that stay, and texts without words are never among them
    goes = real.select("~id", "~k").distinct().join(best, F.col("~id").eqNullSafe(F.col("~bid")) & (F.col("~k") == F.col("~bk")), "left_anti")

    same = F.col("doc_id").eqNullSafe(F.col("~id")) & (F.col("~t") == F.col("~k"))
    left = keyed.join(small_enough(cut(goes)), same, "left_anti")
    # rows that are repeated whole are rare, so only they are shuffled
    shared = cut(real.groupBy("~id", "~k").count().where("count > 1").select("~id", "~k"))
    if not shared.isEmpty():
        once = left.join(small_enough(shared), same, "left_semi").dropDuplicates(["doc_id", "~t"])
        left = left.join(small_enough(shared), same, "left_anti").unionByName(once)
    return left.select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by marks; n_chars follows."""
    _narrow_batches(spark)
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: the files written follow each other slot by slot."""
    return pfair.in_order(pfair.mixed(docs.select(*COLUMNS), TARGETS)).select(*COLUMNS)


def file_starts(sizes: DataFrame) -> DataFrame:
    """file and start, the rows of all files before it, from file and n: files go by the number in their names, which Spark writes
    with five digits or more, then by name. Rows are summed inside groups of FILES files, then over the groups."""
    number = F.coalesce(F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    placed = sizes.select("file", "n", number.alias("i")).withColumn("g", F.floor(F.col("i") / FILES))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each FILES files
    groups = placed.groupBy("g").agg(F.sum("n").alias("t")).select("g", F.coalesce(F.sum("t").over(upto(Window.orderBy("g"))), F.lit(0)).alias("over"))
    own = F.coalesce(F.sum("n").over(upto(Window.partitionBy("g").orderBy("i", "file"))), F.lit(0))
    return placed.withColumn("own", own).join(groups, "g").select("file", (F.col("own") + F.col("over")).alias("start"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, position, n_tokens, ids_sha256 and decoded_sha256 of each document left.

    The position is the place in the mixture, from 0: the rows of the files in the order of their numbers. Rows that come from
    no file have none.
    """
    _narrow_batches(spark)
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("~file"), F.col("_metadata.row_index").alias("~row"))
    except AnalysisException:
        placed = docs.select("*", F.lit("").alias("~file"), F.lit(None).cast("long").alias("~row"))
    starts = cut(file_starts(placed.groupBy(F.col("~file").alias("file")).agg(F.count(F.lit(1)).alias("n"))))
    made = bpe.round_trip(placed, keep=("doc_id", "source", "~file", "~row"))
    # rows of digests; Spark broadcasts the files if they are few enough
    out = made.join(starts, F.col("~file") == F.col("file"))
    return out.select("doc_id", "source", (F.col("start") + F.col("~row")).alias("position"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("redact", redact), ("mix", mix), ("encode", encode)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them the rows are written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
