"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Texts are encoded where they are; only (length, documents) pairs are shuffled, pre-aggregated in each task. Suffix sums
run in two levels: inside blocks of lengths, and over the few block totals. With them each context limit L has its
number of longer documents, and its tokens when every document is cut at L.

A null or empty text has length 0. Repeated rows count each time. Very long texts are encoded whole, one at a time. Other
columns, whatever their names, are not looked at. An empty table has an empty histogram, no quantile and totals of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.bpe import default_path, default_pattern, encoder
from evenhand.llm.common import col, cut, field, text_map

#: Lengths in a block of the two-level sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` and n_tokens of each whole text."""
    path, pattern = path or default_path(), pattern or default_pattern()
    return text_map(docs, text_col, list(keep), [field("n_tokens", "bigint")], lambda texts: [list(map(encoder(path, pattern).count, texts))])


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row for each length: n_docs of it, docs_ge and tokens_ge (this length or longer), docs_le,
    truncated_tokens (all documents cut at this length) and total_docs, total_tokens."""
    # a row for each length is all that is left of the texts; written once, as it is read twice below
    counts = cut(lengths.groupBy(col(length_col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs")))
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("long")
    # one row for each block of lengths: the longest document bounds it, not the number of documents
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), none).alias("d_after"), F.coalesce(F.sum("t").over(later), none).alias("t_after"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, d = F.col("n_tokens"), F.col("n_docs")
    out = counts.join(blocks, "block").select(
        n, d,
        (F.sum(d).over(inside) + F.col("d_after")).alias("docs_ge"),
        (F.sum(d * n).over(inside) + F.col("t_after")).alias("tokens_ge"),
        "total_docs", "total_tokens",
    )
    return out.select(
        n, d, "docs_ge", "tokens_ge",
        (F.col("total_docs") - F.col("docs_ge") + d).alias("docs_le"),
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("docs_ge") * n).alias("truncated_tokens"),
        "total_docs", "total_tokens",
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, longer_docs and kept_tokens for any context limits, whether or not a document has that length.

    Above the limit each document counts as the limit; the first histogram row above it has what is needed. All limits are
    answered in one aggregation, without a join.
    """
    n = F.col("n_tokens")
    first = [F.struct(F.lit(int(x)).cast("long").alias("limit"), F.min(F.when(n > x, F.struct("n_tokens", "docs_ge", "tokens_ge"))).alias("a")) for x in limits]
    one = hist.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total"), F.array(*first).alias("l")).select("total", F.explode("l").alias("l"))
    longer, tokens = F.coalesce(F.col("l.a.docs_ge"), F.lit(0)), F.coalesce(F.col("l.a.tokens_ge"), F.lit(0))
    return one.select(F.col("l.limit").alias("limit"), longer.alias("longer_docs"), (F.col("total") - tokens + longer * F.col("l.limit")).alias("kept_tokens"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least that share of documents doesn't exceed; null for no documents."""
    reached = lambda x: F.min(F.when(F.col("docs_le") >= F.ceil(F.lit(float(x)) * F.col("total_docs")), F.col("n_tokens")))
    return hist.agg(F.array(*(F.struct(F.lit(float(x)).alias("share"), reached(x).alias("n_tokens")) for x in shares)).alias("q")).select(F.explode("q").alias("q")).select("q.share", "q.n_tokens")
