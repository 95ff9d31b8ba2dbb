"""Suffix-array dedup: bytes covered by a string of L bytes that also starts elsewhere.

Comparing all suffixes of the corpus is more than is needed: two equal windows of L bytes have the same least k-gram hash.

1. Each document is cut into segments: runs of window starts whose windows share their least k-gram hash (the anchor). A
   segment is known by its anchor and a digest of its bytes.
2. Anchors that occur once in the corpus are done: none of their windows repeats. Where all segments of an anchor are equal, all repeat.
3. Of other anchors one copy of each distinct segment goes to a shard (anchors with many segments are spread over several).
   The shard sorts its suffixes by Larsson-Sadakane refinement in numpy, up to L bytes deep; Kasai's scheme, all segments in
   step, gives the common prefixes of neighbours, and those of L bytes or more are repeats.
4. Shards that share an anchor are merged: each sends the sorted keys of its distinct windows, cut by key range, and the
   merging task finds the keys of one shard in the runs of the others by binary search.
5. The repeated windows of a document come together with its text, which is cut once.

Whether a string starts once or more often is all that counts, so each task sends the segments of a text twice at most,
however many copies of it there are. What a task holds is bounded by the shard size and by the longest document.

A null text is empty and has nothing to remove; so has one shorter than L bytes. Very long texts are hashed part by part.
Repeated rows are documents of their own, each repeating the other; of equal strings none is spared. Other columns,
whatever their names, are not looked at. An empty table has an empty result. Texts are UTF-8; what remains of one need not
be.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import col, cut

#: Bytes of a repeated string, of an anchor's k-gram, window starts in a segment at most.
LENGTH, GRAM, LONGEST = 400, 32, 512
#: Bytes of text hashed at a time, and bytes of segments in a shard, about.
PART, SHARD = 1 << 20, 1 << 20
#: Distinct segments of one anchor beyond which they are spread over shards and merged.
SPREAD = 400
#: Keys of windows in a merging task, about.
MERGED = 500_000
#: Rows handled at a time in a task, and texts whose copies a task remembers at most.
ROWS_AT_ONCE, REMEMBERED = 64, 100_000

_TABLE = np.random.default_rng(51).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = np.random.default_rng(53).integers(0, 2**62, 8, dtype=np.uint64) * np.uint64(4) + np.uint64(3)


def gram_hashes(raw: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of all k-grams (k a power of two), by doubling."""
    h, n, step = _TABLE[raw], 1, 0
    while n < k:
        h = h[:-n] * _MULTIPLY[step] + h[n:]
        h ^= h >> np.uint64(29)
        n, step = 2 * n, step + 1
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w neighbours, from running minima of blocks forwards and backwards."""
    n = len(h) - w + 1
    pad = -len(h) % w
    box = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(box, axis=1).ravel()
    back = np.minimum.accumulate(box[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def near_twins(h: np.ndarray, least: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal k-grams that follow each other and are least in windows that overlap."""
    edge = np.zeros(w - 1, h.dtype)
    most = ~sliding_least(~np.concatenate([edge, least, edge]), w)  # of the least values of the windows that hold a k-gram
    at = np.flatnonzero(h == most)
    twins = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] <= w))
    return at[twins], at[twins + 1]


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Anchor, number of the text, first window start, window starts, whether its anchor occurs twice, and bytes of every
    segment."""
    joined = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    anchors, owners, starts, counts, twice, pieces = [], [], [], [], [], []
    if len(joined) >= length:
        w = length - GRAM + 1
        h = gram_hashes(np.frombuffer(joined, np.uint8))
        least = sliding_least(h, w)
        cuts = np.zeros(len(least) + 1, bool)
        cuts[0] = True
        cuts[1:-1] = least[1:] != least[:-1]
        cuts[begins[begins < len(cuts)]] = True
        at = np.flatnonzero(cuts[:-1])
        size = np.diff(np.r_[at, len(least)])
        parts = -(-size // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(at, parts) + nth * LONGEST
        last = np.minimum(first + LONGEST, np.repeat(at + size, parts))
        owner = np.searchsorted(begins, first, side="right") - 1
        last = np.minimum(last, (begins + sizes)[owner] - length + 1)
        fine = last > first
        first, last, owner = first[fine], last[fine], owner[fine]
        anchors, owners, starts, counts = least[first], owner, first - begins[owner], last - first
        one, other = near_twins(h, least, w)
        at = np.searchsorted(one, first)
        twice = np.r_[other, np.iinfo(np.int64).max][at] <= last + w - 2
        view = memoryview(joined)
        pieces = [view[a : b - 1 + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return np.asarray(anchors, np.uint64), np.asarray(owners, np.int64), np.asarray(starts, np.int64), np.asarray(counts, np.int64), np.asarray(twice, bool), pieces


def _raw(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _parts(raws: list[bytes], length: int):
    """Lists of (text number, offset, bytes) of about PART bytes; long texts are cut so that each window start is in one."""
    held, size = [], 0
    for i, raw in enumerate(raws):
        for at in range(0, max(1, len(raw) - length + 1), PART):
            piece = raw[at : at + PART + length - 1] if len(raw) > PART + length else raw
            held.append((i, at, piece))
            size += len(piece)
            if size >= PART:
                yield held
                held, size = [], 0
            if piece is raw:
                break
    if held:
        yield held


def occurrences(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """anchor, digest, tkey (digest of the text), at, n and twice of every segment of every text, of equal texts in a task
    from two."""

    def run(batches):
        seen: dict[bytes, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch, keys, raws = whole.slice(at, ROWS_AT_ONCE), [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    times = seen.get(key, 0)
                    if times < 2 and text:
                        if len(seen) >= REMEMBERED:
                            seen.clear()  # some copies are sent more than twice then
                        seen[key] = times + 1
                        keys.append(key)
                        raws.append(_raw(text))
                yield from emit(keys, raws)

    def emit(keys, raws):
        for held in _parts(raws, length):
            anchors, owners, starts, counts, twice, pieces = segments([p for _, _, p in held], length)
            digests = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces))
            offsets = np.array([o for _, o, _ in held], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(anchors.view(np.int64)), pa.array(digests.view(np.int64)),
                pa.array([keys[held[o][0]] for o in owners.tolist()], pa.binary()),
                pa.array((starts + offsets[owners]) if len(owners) else starts), pa.array(counts.astype(np.int32)), pa.array(twice),
            ], names=["anchor", "digest", "tkey", "at", "n", "twice"])

    return docs.select(text_key(text_col).alias("tkey"), col(text_col).alias("text")).mapInArrow(run, "anchor long, digest long, tkey binary, at long, n int, twice boolean")


def text_key(text_col: str):
    """128 bits that stand for the text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(col(text_col), F.lit("")).cast("binary"), 256)), 1, 16)


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first ``depth`` bytes (zeros beyond the end), and the rank of each start.

    Larsson-Sadakane: sort by 8 bytes, then sort the groups that are still equal by the ranks h places on, doubling h.
    Ranks are places of group heads; equal ranks mean equal first bytes. The last step reaches depth exactly.
    """
    n = len(raw)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = raw
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word <<= np.uint64(8)
        word |= padded[j : j + n]
    order = np.argsort(word, kind="stable").astype(np.int32)
    word = word[order]
    head = np.r_[True, word[1:] != word[:-1]] if n else np.zeros(0, bool)
    del word
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    h = 8
    while h < depth:
        step = min(h, depth - h)
        open_ = np.flatnonzero(~(head & np.r_[head[1:], True])).astype(np.int32)
        if not len(open_):
            break
        starts = order[open_]
        behind = starts + np.int32(step)
        next_ = np.where(behind < n, rank[np.minimum(behind, n - 1)] + np.int32(1), np.int32(0))
        key = rank[starts].astype(np.int64) * (n + 1) + next_
        by = np.argsort(key, kind="stable")
        starts, key = starts[by], key[by]
        order[open_] = starts
        fresh = np.r_[True, key[1:] != key[:-1]]
        head[open_] = fresh
        rank[starts] = np.maximum.accumulate(np.where(fresh, open_, np.int32(0)))
        h += step
    return order, rank


def common_prefixes(raw: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """For each place of ``order``, the bytes (at most depth) that it shares with the place before.

    Kasai's scheme for all segments in step: from one start to the next, a start whose neighbour moves along with it keeps
    all but one of its known bytes and compares only what follows.
    """
    n = len(raw)
    padded = np.zeros(n + depth + 16, np.uint8)
    padded[:n] = raw
    words = np.lib.stride_tricks.as_strided(padded, (n + depth + 8, 8), (1, 1))
    place = np.full(n, -1, np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    shared = np.zeros(len(order), np.int32)
    known, before = np.zeros(len(first), np.int64), np.full(len(first), -2, np.int64)
    for step in range(int(count.max()) if len(count) else 0):
        live = np.flatnonzero(count > step)
        p = first[live] + step
        at = place[p]
        q = np.where(at > 0, order[np.maximum(at - 1, 0)], -1).astype(np.int64)
        have = np.where((q == before[live] + 1) & (q >= 0), np.maximum(known[live] - 1, 0), 0)
        going = np.flatnonzero((q >= 0) & (have < depth))
        while len(going):
            a, b = p[going] + have[going], q[going] + have[going]
            same = words[a] == words[b]
            run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            have[going] += run
            going = going[(run == 8) & (have[going] < depth)]
        have = np.minimum(have, depth)
        shared[at] = np.where(q >= 0, have, 0)
        known[live], before[live] = have, q
    return shared


def _intervals(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
    return edge[0::2], edge[1::2]


#: Columns of the runs that spread anchors send.
LISTS = ("keys", "owners", "starts", "known", "anchors", "digests")


def repeats_in_shard(anchor: np.ndarray, digest: np.ndarray, copies: np.ndarray, spread: np.ndarray, pieces: list[bytes], length: int, ranges: int = 1) -> pd.DataFrame:
    """Rows of a shard's segments: intervals [a, b) of starts that repeat here or in an equal segment (kind 0), and of
    spread anchors a sorted run for each range of keys (kind 1, a is the range): the key of each distinct window, its
    segment (as a number of ``segments``), its start, and whether it repeats already."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    first = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    valid = np.zeros(len(raw), bool)
    for a, c in zip(first, count, strict=True):
        valid[a : a + c] = True
    order, rank = suffix_array(raw, length)
    order = order[valid[order]]
    shared = common_prefixes(raw, order, first, count, length)
    twin = shared >= length
    again = np.zeros(len(raw), bool)
    again[order] = twin | np.r_[twin[1:], False]
    # segments are kept apart by the bytes at their ends that begin no window
    a, b = _intervals(valid & (again | np.repeat(copies > 1, sizes)))
    own = np.searchsorted(first, a, side="right") - 1
    out = {"kind": np.zeros(len(a), np.int32), "anchor": anchor[own], "digest": digest[own], "a": a - first[own], "b": b - first[own]}
    runs: list[dict] = []
    if spread.any():
        owner = np.searchsorted(first, order, side="right") - 1
        lead = ~twin  # first of each class of equal windows
        known = again[order] | (copies[owner] > 1)
        chosen = np.flatnonzero(lead & spread[owner])
        view = memoryview(raw)
        keys = np.fromiter((xxhash.xxh3_64_intdigest(view[p : p + length], seed=9) for p in order[chosen].tolist()), np.uint64, len(chosen))
        by = np.argsort(keys, kind="stable")
        chosen, keys = chosen[by], keys[by]
        at = (keys.astype(np.float64) / (2.0**64 / ranges)).astype(np.int64)
        for r in np.unique(at):
            here = at == r
            own = owner[chosen[here]]
            used, number = np.unique(own, return_inverse=True)
            runs.append(dict(a=int(r), keys=keys[here].view(np.int64), owners=number.astype(np.int64), starts=order[chosen[here]] - first[own], known=known[chosen[here]], anchors=anchor[used], digests=digest[used]))
    one = pd.DataFrame({**out, **dict.fromkeys(LISTS)})
    if not runs:
        return one
    two = pd.DataFrame({"kind": np.ones(len(runs), np.int32), "anchor": 0, "digest": 0, "a": [r["a"] for r in runs], "b": 0, **{c: pd.Series([r[c] for r in runs], dtype=object) for c in LISTS}})
    return pd.concat([one.astype(dict.fromkeys(LISTS, object)), two])


def merged_runs(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted run of distinct keys, which of them another run has, by binary search."""
    found = [np.zeros(len(r), bool) for r in runs]
    everything = np.sort(np.concatenate(runs)) if runs else np.zeros(0)
    for own, mark in zip(runs, found, strict=True):
        mark[:] = np.searchsorted(everything, own, side="right") - np.searchsorted(everything, own, side="left") > 1
    return found


def repeated_starts(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """tkey, a, b: the window starts [a, b) of each distinct text whose windows also start elsewhere."""
    segs = cut(occurrences(docs, text_col, length))
    anchors = segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.max("twice").alias("twice"))
    # a segment whose anchor occurs twice in it may repeat itself
    anchors = anchors.where((F.col("all") > 1) | F.col("twice")).select("anchor", ((F.col("all") > 1) & (F.col("lo") == F.col("hi"))).alias("same"))
    shared = cut(segs.drop("twice").join(anchors, "anchor"))
    certain = shared.where("same").select("tkey", F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b"))
    open_ = shared.where(~F.col("same")).select("anchor", "digest", "tkey", "at", "n")
    distinct = cut(open_.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("tkey", "at", "n")).alias("l")).select("anchor", "digest", "copies", "l.tkey", "l.at", "l.n"))
    many = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("segments")).where(F.col("segments") > SPREAD)
    total = distinct.agg(F.sum(F.col("n") + length)).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    salt = F.when(F.col("segments").isNotNull(), F.pmod(F.xxhash64("digest"), F.ceil(F.col("segments") / SPREAD))).otherwise(F.lit(0))
    placed = distinct.join(many, "anchor", "left").select("tkey", F.struct("anchor", "digest", "copies", "at", "n", F.col("segments").isNotNull().alias("spread"), F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).alias("shard")).alias("s"))
    wanted = placed.groupBy("tkey").agg(F.collect_list("s").alias("wanted"))  # segments of one text

    # the bytes of those segments, from one copy of each text
    texts = docs.select(text_key(text_col).alias("tkey"), col(text_col).alias("text"))
    with_text = texts.join(wanted, "tkey")

    def fetch(batches):
        seen = set()  # copies of a text in this task give their segments once; the shard drops what is left
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                rows = []
                for key, text, wants in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if key in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(key)
                    raw = _raw(text)
                    rows += [(w["shard"], w["anchor"], w["digest"], w["copies"], w["spread"], raw[w["at"] : w["at"] + w["n"] - 1 + length]) for w in wants]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "anchor", "digest", "copies", "spread", "bytes"])

    pieces = with_text.select("tkey", "text", "wanted").mapInArrow(fetch, "shard long, anchor long, digest long, copies long, spread boolean, bytes binary")

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "digest"])
        return repeats_in_shard(*(pdf[c].to_numpy() for c in ("anchor", "digest", "copies")), pdf["spread"].to_numpy(bool), pdf["bytes"].tolist(), length, ranges)

    spread_keys = distinct.join(many, "anchor").agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-spread_keys // MERGED))
    kinds = "kind int, anchor long, digest long, a long, b long, keys array<long>, owners array<long>, starts array<long>, known array<boolean>, anchors array<long>, digests array<long>"
    found = cut(pieces.groupBy("shard").applyInPandas(shard, kinds))
    runs = found.where("kind = 1").select(F.col("a").alias("range"), "keys", "owners", "starts", "known", "anchors", "digests")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        hits = merged_runs([np.asarray(k).view(np.uint64) for k in pdf["keys"]])
        got: dict[str, list] = {"anchor": [], "digest": [], "a": [], "b": []}
        for hit, row in zip(hits, pdf.itertuples(), strict=True):
            new = hit & ~np.asarray(row.known, bool)
            owners, starts = np.asarray(row.owners)[new], np.asarray(row.starts)[new]
            by = np.lexsort((starts, owners))
            owners, starts = owners[by], starts[by]
            edge = np.flatnonzero(np.r_[True, (owners[1:] != owners[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(owners) else []
            for x, y in zip(edge, [*edge[1:], len(owners)], strict=False):
                for c, v in zip(got, (row.anchors[owners[x]], row.digests[owners[x]], starts[x], starts[y - 1] + 1), strict=True):
                    got[c].append(v)
        return pd.DataFrame({c: pd.Series(v, dtype="int64") for c, v in got.items()})

    crossed = runs.groupBy("range").applyInPandas(merge, "anchor long, digest long, a long, b long")
    local = found.where("kind = 0").select("anchor", "digest", "a", "b")
    verdicts = local.union(crossed)
    judged = open_.join(verdicts, ["anchor", "digest"]).select("tkey", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    return certain.union(judged)


def dedup(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, with_rest: bool = False) -> DataFrame:
    """The columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256, removed (array of [start, end) bytes), and with
    ``with_rest`` the remaining bytes as ``rest``."""
    spans = repeated_starts(docs, text_col, length).groupBy("tkey").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    rows = docs.select(text_key(text_col).alias("tkey"), *(col(c).alias(f"k{i}") for i, c in enumerate(keep)), col(text_col).alias("text")).join(spans, "tkey", "left")
    rows = rows.select(*(f"k{i}" for i in range(len(keep))), "text", "spans")
    n = len(keep)
    kinds = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:long,b:long>>" + ", rest binary" * with_rest
    schema = ", ".join([*(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(n)), kinds])

    def remove(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                out: list[list] = [[], [], [], [], [], []]
                for text, starts in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                    raw = _raw(text)
                    gone: list[list[int]] = []
                    for s in starts or ():
                        a, b = s["a"], s["b"] - 1 + length
                        if gone and a <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], b)
                        else:
                            gone.append([a, b])
                    edges = [0, *(e for g in gone for e in g), len(raw)]
                    rest = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if gone else raw
                    for o, v in zip(out, (len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), [{"a": a, "b": b} for a, b in gone], rest), strict=True):
                        o.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary())[: 5 + with_rest]
                arrays = [pa.array(o, t) for o, t in zip(out, types, strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], names=[*(f"k{i}" for i in range(n)), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", *["rest"] * with_rest])

    out = rows.mapInArrow(remove, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *out.columns[n:])
