"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Arrow buffers are scanned as bytes: classes of bytes and prefix sums count words, capitals, symbols and code points of many
texts at once; distinct words come from hashes that are sorted within each text, equal neighbours being compared byte by
byte. What is left of a document are five bits. Documents with the same bits, part and labels are one row with a count, and
all 120 orders are worked out on these rows, 128 for each part at most.

The fifth filter looks for the same text under a smaller id: texts are known by 128-bit digests, the smallest id of each is
found by a partial aggregation, and meets the rows by digest and id, so that a text with many copies is spread out.

Null texts are empty: they fail on the number of words alone, and as copies of each other. A null id is not smaller or larger
than another: it fails no copy test and makes none fail. Rows that share id and text are no copies of each other. A null part
is the empty string. Labels of an id that has several count if any of them says so. Very long texts are scanned whole, a
piece at a time. Other columns, whatever their names, are not looked at. An empty table has an empty result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.buffers import buffer_map, classes, counts_between, gathered, pieces, words
from evenhand.llm.common import WHITE, col, cut, field

# The filters in the order of their bits, the symbols, and the limits.
FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 50, 65, 5

COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")
_WHITE, _CAPITAL, _SYMBOL = classes(WHITE), classes(bytes(range(65, 91))), classes(SYMBOLS)
_FOLLOWS = classes(bytes(range(0x80, 0xC0)))
_VALUES = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEPS = np.random.default_rng(73).integers(1, 2**63, 1024, dtype=np.uint64) | np.uint64(1)
#: Bits of a word's hash beside its text's number in a sort key; a longer word is hashed on its own.
HASH_BITS, LONG_WORD = 40, 1 << 16


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    short = np.flatnonzero(sizes <= LONG_WORD)
    for a, b in pieces(sizes[short]):
        own = short[a:b]
        letters, place = gathered(data, starts[own], sizes[own])
        out[own] = np.add.reduceat(_VALUES[letters] * _STEPS[place & 1023], np.cumsum(sizes[own]) - sizes[own])
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _unequal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pairs of spans of equal size whose bytes differ."""
    out = np.zeros(len(a), bool)
    for i, j in pieces(sizes):
        x, place = gathered(data, a[i:j], sizes[i:j])
        differs = x != data[np.repeat(b[i:j], sizes[i:j]) + place]
        if differs.any():
            out[i:j] = np.add.reduceat(differs.astype(np.int64), np.cumsum(sizes[i:j]) - sizes[i:j]) > 0
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Distinct words of each text, from the number of words of each and their spans in order."""
    out, text, sizes = per_text.copy(), np.repeat(np.arange(len(per_text)), per_text), ends - starts
    if not len(starts):
        return out
    hashes = word_hashes(data, starts, sizes)
    keys = (text.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes >> np.uint64(64 - HASH_BITS))
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    a, b = order[same], order[same + 1]
    wrong = sizes[a] != sizes[b]
    alike = np.flatnonzero(~wrong)
    wrong[alike] = _unequal(data, starts[a[alike]], starts[b[alike]], sizes[a[alike]])
    out -= np.bincount(text[a], minlength=len(out))
    for t in np.unique(text[a[wrong]]):  # words that share a hash: the words themselves decide
        own = np.flatnonzero(text == t)
        out[t] = len({data[starts[i] : ends[i]].tobytes() for i in own})
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text of a buffer."""
    starts, ends = words(~_WHITE[data], offsets)
    n_words = np.diff(np.searchsorted(starts, offsets))
    return [
        n_words,
        distinct_words(data, starts, ends, n_words),
        counts_between(_CAPITAL[data], offsets),
        counts_between(_SYMBOL[data], offsets),
        counts_between(~_FOLLOWS[data], offsets),
    ]


def _digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = memoryview(data)
    whole = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True))
    return np.frombuffer(whole, "<i8").reshape(-1, 2)


def measured(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, COUNTS of each whole text and its digest in two numbers, digest_a and digest_b."""

    def scan(data, offsets):
        digests = _digests(data, offsets)
        return [*measure(data, offsets), np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1])]

    return buffer_map(docs, text_col, list(keep), [field(n, "bigint") for n in (*COUNTS, "digest_a", "digest_b")], scan)


def fails_by_counts() -> Column:
    """Bits 0 to 3 of the filters that COUNTS decide."""
    tests = (
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("n_capitals") > MOST_CAPITALS_PERCENT * F.col("n_points"),
        F.col("n_symbols") > 0,
    )
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, fails (bits of the filters that a document fails), good, toxic and their number n."""
    flags = labels.where(col(id_col).isNotNull()).groupBy(col(id_col).alias("~id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("~g"), F.max((F.col("toxic") == 1).cast("int")).alias("~t"))
    rows = measured(docs, text_col, (id_col, part_col)).select(
        col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), fails_by_counts().alias("fails"), "digest_a", "digest_b"
    )
    rows = cut(rows)  # texts are scanned once; some 30 bytes are left of each
    first = rows.where("id IS NOT NULL").groupBy("digest_a", "digest_b").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    named = rows.join(first, ["digest_a", "digest_b", "id"], "left").join(flags, F.col("id") == F.col("~id"), "left")
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    marked = named.select(
        "part", (F.col("fails") + F.when(copy, 1 << 4).otherwise(0)).alias("fails"), (F.coalesce("~g", F.lit(0)) == 1).alias("good"), (F.coalesce("~t", F.lit(0)) == 1).alias("toxic")
    )
    return marked.groupBy("part", "fails", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of what ``masks`` gives.

    The 600 steps of all orders are a constant; each row of counts meets them inside its own task.
    """
    steps = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order):
            steps.append({"o": name, "s": step + 1, "b": 1 << i, "e": sum(1 << j for j in order[:step])})
    # the constant travels as one row of 600 entries
    constant = counts.sparkSession.createDataFrame([(steps,)], "steps array<struct<o:string,s:int,b:int,e:int>>")
    each = counts.crossJoin(F.broadcast(constant)).select("part", "fails", "good", "toxic", "n", F.explode("steps").alias("x"))
    fails, bit, earlier = F.col("fails"), F.col("x.b"), F.col("x.e")
    failing, untouched = fails.bitwiseAND(bit) != 0, fails.bitwiseAND(earlier) == 0
    removed = failing & untouched
    # a document that fails m filters is removed by each of them in 120 / m of the orders
    share = F.when(failing, F.col("n") * (F.lit(120) / F.bit_count(fails)).cast("long")).otherwise(0)
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step")).agg(
        total(untouched & ~failing).alias("kept"),
        total(removed).alias("removed"),
        total(failing & ~untouched).alias("redundant"),
        total(fails == bit).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    return interactions(masks(docs, labels, **names))
