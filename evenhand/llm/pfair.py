"""Mixing sources to target weights by Pfair scheduling.

The documents of each source are shuffled by a hash and cut into blocks. With integer weights a and A their sum, block j
(from 1) of a source may run from slot floor((j - 1) A / a) on and must have run by slot ceil(j A / a). Earliest deadline
first meets all of these, so at every slot each source is less than one block away from its share. The schedule repeats
after A slots: it is computed once for A slots, and every block finds its slot by arithmetic.

When a source has no block left, the others go on with their own weights in a new phase; there are as many phases as
sources at most, and nothing is dropped. Sources are few by contract (``MOST_SOURCES`` and ``MOST_SLOTS``, checked);
documents are not: ranks inside a source come from counts of hash ranges, so that no task holds a whole source.

A null source is a source by itself (an empty name shares it). Sources without a weight get ``default_weight``. Repeated
rows are separate documents, in any order among themselves; other ties go by hash, then by id. Texts travel as they are,
however long. Other columns stay; those named as the ones made here are replaced. An empty table has an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import col

#: Bounds on what the driver handles: sources, and slots of the repeating schedules of all phases together.
MOST_SOURCES, MOST_SLOTS = 2_000, 2_500_000
#: Rows of those schedules that are broadcast, of 64 bytes and a name each; more are joined by a shuffle.
BROADCAST_SLOTS = 100_000
#: Documents of one source that one group ranks, about: few, so that a large source is spread over many tasks.
RANKED = 500


def period(weights: dict[str, int]) -> list[str]:
    """The repeating schedule: earliest deadline first over the released blocks; ties go to the larger weight, then name."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    released: dict[int, list[str]] = {0: sorted(weights)}
    ready: list[tuple[int, int, str]] = []
    slots = []
    for slot in range(total):
        for s in released.pop(slot, ()):
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), -weights[s], s))
        _, _, s = heapq.heappop(ready)
        done[s] += 1
        slots.append(s)
        if done[s] < weights[s]:
            released.setdefault(max(slot + 1, done[s] * total // weights[s]), []).append(s)
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> pa.Table:
    """One row for each source, phase and number of a block in the period: s, first (block of the source in the phase), ran
    (blocks in it), slot0, period (slots), a (blocks in a period), k (number in the period) and place (its slot there)."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    left = {s: blocks[s] for s in names}
    first, start, slots = dict.fromkeys(left, 0), 0, 0
    parts: list[tuple[np.ndarray, ...]] = []
    while left:
        shrink = gcd(*(weights[s] for s in left))
        own = {s: weights[s] // shrink for s in left}
        slots += sum(own.values())
        if slots > MOST_SLOTS:
            raise ValueError(f"the schedules have more than {MOST_SLOTS} slots; use smaller weights or fewer sources")
        order = period(own)
        places: dict[str, list[int]] = {s: [] for s in left}
        for at, s in enumerate(order):
            places[s].append(at)
        # the phase ends with the slot at which some source runs out
        length = min((n - 1) // own[s] * len(order) + places[s][(n - 1) % own[s]] + 1 for s, n in left.items())
        full, rest = divmod(length, len(order))
        ran = {s: full * own[s] + bisect_left(places[s], rest) for s in left}
        going = [s for s in left if ran[s]]
        times = [own[s] for s in going]
        each = lambda values, times=times: np.repeat(np.array(values, np.int64), times)
        parts.append((
            each([bisect_left(names, s) for s in going]), each([first[s] for s in going]), each([ran[s] for s in going]), np.full(sum(times), start), np.full(sum(times), len(order)), each(times),
            np.concatenate([np.arange(n) for n in times]), np.concatenate([np.array(places[s]) for s in going]),
        ))
        for s in list(left):
            first[s] += ran[s]
            left[s] -= ran[s]
            if not left[s]:
                del left[s]
        start += length
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 8
    return pa.table([pa.array(names, pa.string()).take(pa.array(columns[0])), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["s", "first", "ran", "slot0", "period", "a", "k", "place"])


def ranked(docs: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """docs (s, h, ...) with ``rank`` (from 0 within the source s, in the order of the hash h).

    Hash ranges are counted first; a document's rank is the count before its range plus its rank inside. Counts are summed
    inside groups of ranges and over the groups, so that no window grows faster than the root of a source.
    """
    largest = max(sizes.values(), default=0)
    bits = min(32, max(0, (largest // RANKED).bit_length()))
    keyed = docs.withColumn("b", F.shiftrightunsigned(F.col("h"), 64 - bits).cast("long") if bits else F.lit(0).cast("long"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.shiftright("b", bits // 2))
    groups = counts.groupBy("s", "g").agg(F.sum("n").alias("t")).select("s", "g", F.coalesce(F.sum("t").over(earlier("s", "g")), F.lit(0)).alias("over"))
    starts = counts.withColumn("own", F.coalesce(F.sum("n").over(earlier("s", "g", "b")), F.lit(0))).join(groups, ["s", "g"]).select("s", "b", (F.col("own") + F.col("over")).alias("start"))
    inside = Window.partitionBy("s", "b").orderBy("h", "id")
    return keyed.withColumn("i", F.row_number().over(inside)).join(starts, ["s", "b"]).withColumn("rank", F.col("start") + F.col("i") - 1).drop("b", "i", "start")


def mixed(docs: DataFrame, weights: dict[str, int], block: int = 16, default_weight: int = 1, source_col: str = "source", id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """docs with ``mix_slot`` (of its block), ``mix_block`` (of its source) and ``mix_position`` inside the block.

    Ordered by (mix_slot, mix_position) the documents are the mixture. Columns of these names are replaced.
    """
    if block < 1 or default_weight < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("block and weights must be positive integers")
    spark = docs.sparkSession
    docs = docs.drop("mix_slot", "mix_block", "mix_position")
    names = docs.columns
    hashed = [id_col, *(n for n in names if n != id_col and docs.schema[n].dataType.typeName() != "map")]
    # the user's columns travel under numbers, so that no name of theirs meets one of ours
    rows = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(names)), F.coalesce(col(source_col).cast("string"), F.lit("")).alias("s"), F.xxhash64(*map(col, hashed), F.lit(seed)).alias("h"), col(id_col).alias("id"))
    sizes = {r["s"]: r["count"] for r in rows.groupBy("s").count().limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    own = {s: int(weights.get(s, default_weight)) for s in sizes}
    # metadata of sources alone, MOST_SLOTS rows at most; Spark broadcasts it if it is small
    made = phases(own, {s: -(-n // block) for s, n in sizes.items()})
    plan = spark.createDataFrame(made)
    plan = plan.select(*(F.col(c).alias(f"p_{c}") for c in plan.columns))
    spans = plan.where("p_k = 0").groupBy("p_s").agg(F.array_sort(F.collect_list(F.struct("p_first", "p_ran", "p_a"))).alias("spans"))
    rows = ranked(rows, sizes).withColumn("mix_block", F.floor(F.col("rank") / block)).withColumn("mix_position", (F.col("rank") % block).cast("int"))
    rows = rows.join(F.broadcast(spans), F.col("s") == F.col("p_s")).drop("p_s")  # one row for each source
    phase = F.filter(F.col("spans"), lambda p: (p["p_first"] <= F.col("mix_block")) & (F.col("mix_block") < p["p_first"] + p["p_ran"]))[0]
    rows = rows.withColumn("phase", phase).drop("spans")
    nth = F.col("mix_block") - F.col("phase.p_first")
    small = F.broadcast(plan) if made.num_rows <= BROADCAST_SLOTS else plan
    joined = rows.join(small, (F.col("s") == F.col("p_s")) & (F.col("phase.p_first") == F.col("p_first")) & (nth % F.col("phase.p_a") == F.col("p_k")))
    slot = F.col("p_slot0") + F.floor(nth / F.col("p_a")) * F.col("p_period") + F.col("p_place")
    return joined.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), slot.cast("long").alias("mix_slot"), "mix_block", "mix_position")


def in_order(mixture: DataFrame, partitions: int | None = None) -> DataFrame:
    """The mixture sorted by slot and position, split by ranges: written, its files follow each other in mixing order."""
    keys = ["mix_slot", "mix_position"]
    ranged = mixture.repartitionByRange(partitions, *keys) if partitions else mixture.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)

