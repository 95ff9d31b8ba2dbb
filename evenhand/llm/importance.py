"""Target-distribution importance resampling: documents that look like a target are drawn by Gumbel keys.

Features are runs of one to three words, hashed into buckets by crc32. Buckets are counted over all documents and over the
target, and each bucket has an integer gain, the log ratio of the two; the gains (one number a bucket) are an array that
travels to the tasks. A document's weight is the sum of its features' gains, and its score the weight plus Gumbel noise
that depends on its id alone, so that the largest scores are a draw without replacement.

The crc32 of a run comes from those of its words: appending n bytes is a linear map of 32 bits, four table lookups, so a word
is read once, all words of a stretch of texts at a time, and no run is ever spelled out.

Ranks come from an exact histogram of the integer scores. It is range-partitioned by score; sums over each range and over
the few ranges before it give each score the number of documents above it. The scores for which that number is below the
draw's size survive, and row_number by id inside each of them completes the rank. Only the histogram is sorted; noise
spreads copies of one text over some 10,000 scores, 1 in 2,700 of them at most on one.

Null and empty texts have no features and weight 0. Texts with fewer words than needed are scored and not drawn. Rows that
share an id have the same noise; ties go by id, then by weight and number of features, and a null id, whose noise is that of
an empty id, comes last. Repeated rows are drawn one by one. Very long texts are taken whole, in stretches of words. Other
columns, whatever their names, are not looked at. An empty table has an empty result; without a target all counts of it are 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.buffers import buffer_map, chunks, classes, words
from evenhand.llm.common import col, cut, field

# Buckets, words in a run, words that a document needs, percent drawn, seed.
BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42

#: Letters, digits and all that isn't ASCII; A-Z are lowered.
_INSIDE = classes(bytes(range(0x30, 0x3A)), bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), bytes(range(0x80, 0x100)))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Words whose runs are made at a time, and bytes up to which a word is handled in tables.
WORDS_AT_ONCE, SHORT = 1 << 17, 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _appending() -> np.ndarray:
    """What n zero bytes (0 to SHORT + 1) make of a crc32, by each byte of it."""
    x = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    out = [x]
    for _ in range(SHORT + 1):
        x = _CRC[x & 255] ^ (x >> 8)
        out.append(x)
    return np.concatenate(out)


_APPEND = _appending()


def extended(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The part of the crc32 of a text followed by ``sizes`` more bytes that the text's own crc32 makes."""
    out, left = crc, sizes
    while True:
        step = np.minimum(left, SHORT + 1)
        base = step * 1024
        out = _APPEND[base + (out & 255)] ^ _APPEND[base + 256 + ((out >> 8) & 255)] ^ _APPEND[base + 512 + ((out >> 16) & 255)] ^ _APPEND[base + 768 + (out >> 24)]
        left = left - step
        if not left.any():
            return out


def word_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of each word, its letters lowered."""
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = zlib.crc32(_LOWER[data[starts[i] : starts[i] + sizes[i]]].tobytes())
    short = np.flatnonzero(sizes <= SHORT)
    short = short[np.argsort(-sizes[short], kind="stable")]  # longest first: those that still have a letter come first
    at, left = starts[short], np.bincount(sizes[short], minlength=SHORT + 2)
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    active = len(short)
    for j in range(SHORT):
        active -= int(left[j])
        if not active:
            break
        crc[:active] = _CRC[(crc[:active] ^ _LOWER[data[at[:active] + j]]) & 255] ^ (crc[:active] >> 8)
    out[short] = ~crc
    return out


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First word and buckets of the runs of 1, 2 and 3 words that begin at each word of a stretch; BUCKETS for none.

    ``last`` is the number of the last word of each word's text."""
    space = np.uint32(zlib.crc32(b" "))
    for a in range(0, len(starts), WORDS_AT_ONCE):
        b, c = min(a + WORDS_AT_ONCE, len(starts)), min(a + WORDS_AT_ONCE + LONGEST_RUN - 1, len(starts))
        sizes = ends[a:c] - starts[a:c]
        own = word_crcs(data, starts[a:c], sizes)
        spaced = extended(np.full(len(own), space, np.uint32), sizes) ^ own
        out = np.full((LONGEST_RUN, b - a), BUCKETS, np.int64)
        crc = own[: b - a]
        out[0] = crc % BUCKETS
        for k in range(1, LONGEST_RUN):
            n = min(b - a, c - a - k)
            if n <= 0:
                break
            crc = extended(crc[:n], sizes[k : k + n] + 1) ^ spaced[k : k + n]
            inside = np.arange(a, a + n) + k <= last[a : a + n]
            out[k, :n] = np.where(inside, crc % BUCKETS, BUCKETS)
        yield a, out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the number of words before each text, and the last word of each word's text."""
    starts, ends = words(_INSIDE[data], offsets)
    before = np.searchsorted(starts, offsets)
    return starts, ends, before, np.repeat(before[1:] - 1, np.diff(before))


def bucket_counts(rows: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all texts: counted in arrays in each task, then summed; BUCKETS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                starts, ends, _, last = _words(data, offsets)
                for _, found in runs(data, starts, ends, last):
                    total += np.bincount(found.ravel(), minlength=BUCKETS + 1)[:BUCKETS]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in rows.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + BUCKETS) / ((s + 1) (T + BUCKETS)))) of each bucket."""
    whole, aim = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(((t + 1) * whole) / ((s + 1) * aim))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_words, n_features and weight of each whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(np.append(gain, 0))  # one number a bucket, and none for no run

    def weigh(data, offsets):
        starts, ends, before, last = _words(data, offsets)
        per_word = np.zeros(len(starts) + 1, np.int64)
        for a, found in runs(data, starts, ends, last):
            per_word[a + 1 : a + 1 + found.shape[1]] = shipped.value[found].sum(0)
        sums = np.cumsum(per_word)
        n = np.diff(before)
        return [n, sum(np.maximum(n - k, 0) for k in range(LONGEST_RUN)), np.diff(sums[before])]

    return buffer_map(docs, text_col, list(keep), [field(c, "bigint") for c in ("n_words", "n_features", "weight")], weigh)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))), u being (h + 0.5) / 2 ** 32 and h the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight and score of every document."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = weighted(docs, gain, text_col, (id_col,))
    return rows.select(col(id_col).alias("id"), "n_words", "n_features", "weight").withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def score_histogram(scores: DataFrame) -> DataFrame:
    """score, n and above: documents of each integer score and of all larger ones."""
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(cut(counts).repartitionByRange(F.desc("score")).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    totals = ranged.groupBy("range").agg(F.sum("n").alias("t")).select("range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("over"))
    inside = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(totals), "range").select("score", "n", (F.col("over") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("above"))


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows with rank: 1 for the largest score of those with enough words, null beyond the draw."""
    enough = F.col("n_words") >= least_words
    size = rows.where(enough).count() * percent // 100
    surviving = cut(score_histogram(rows.where(enough).select("score")).where(F.col("above") < size).select("score", "above"))
    cutoff = surviving.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    inside = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), F.desc("weight"), "n_features")
    high = rows.where(enough & (F.col("score") >= cutoff)).join(surviving, "score")
    place = F.col("above") + F.row_number().over(inside)
    ranked = high.select(*rows.columns, F.when(place <= size, place).alias("rank"))
    return rows.where(~(enough & (F.col("score") >= cutoff))).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (null if not drawn) of every document."""
    return drawn(cut(scored(docs, target, **options)), percent, least_words)
