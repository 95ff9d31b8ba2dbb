"""Line dedup, filter audit and importance resampling against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenhand.llm import audit, buffers, importance, linedup, queries

DOCS = "doc_id long, text string, source string"
WHITE = " \t\n\x0b\x0c\r"
LONG = "a line that is long enough"


def written(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- line dedup ----
def plain_lines(rows):
    """doc_id, n_lines, n_dropped and kept text of each row."""
    key = lambda line: line.strip(WHITE).translate({c: c + 32 for c in range(65, 91)})
    order = lambda d: (d is not None, d or 0)
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(order(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held[key(x)]) >= 3 and max(held[key(x)]) != order(doc))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    r = random.Random(5)
    lines = [LONG, f"  {LONG.upper()}\r", "short", "", "\x0bÉcole née à l'étranger\t", "école née à l'étranger", "x" * 19, "x" * 20, "é" * 19, "é" * 20, "K" * 20, "K" * 20, "only here, but twice", " " + LONG]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(None, LONG), (None, f"{LONG}\nother"), (7, rows[7][1]), (8, LONG), (-3, "x" * 20), (100, None), (101, ""), (102, "\n\n"), (2**40, f"{LONG}\n" * 5000), (50, f"{LONG}\n" * 3000 + "end")]
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines_by_plain_loops(spark, parts):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], DOCS).withColumns({c: F.lit(1) for c in ("id", "pos", "t", "keep", "~doc", "a", "n_lines")})
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = linedup.dedup(docs, texts=True).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    key = lambda x: (x[0] is not None, x[0] or 0, x[3])
    assert sorted(((g["doc_id"], g["n_lines"], g["n_dropped"], g["kept_text"]) for g in got), key=key) == sorted(plain_lines(rows), key=key)
    for g in got:
        assert g["kept_sha256"] == hashlib.sha256(g["kept_text"].encode()).hexdigest()


@pytest.mark.parametrize("seed", range(30))
def test_stream_of_ranges_in_any_partition_and_batch(seed):
    """A sorted run of hashes, cut into partitions and batches anywhere, loses the same lines."""
    r = random.Random(seed)
    rows = sorted({(h, 0, has, d * has, 0, p) for h, has, d, p in ((r.randrange(4), r.randrange(9) > 0, r.randrange(5), r.randrange(4)) for _ in range(r.randrange(1, 50)))}, key=lambda x: (x[0], -x[2], -x[3], x[5]))
    held = defaultdict(set)
    for h, _, has, d, _, _ in rows:
        held[h].add((has, d))
    want = {x for x in rows if len(held[x[0]]) >= 3 and max(held[x[0]]) != x[2:4]}
    cuts = sorted(r.sample(range(len(rows) + 1), min(len(rows), r.randrange(4))))
    goes, waits, told = set(), [], defaultdict(set)
    for part in (rows[a:b] for a, b in itertools.pairwise([0, *cuts, len(rows)])):
        state = linedup._Stream(3)
        found, at = [], 0
        while at < len(part):
            n = r.randrange(1, 8)
            found += state.batch(np.array(part[at : at + n], np.int64))
            at += n
        for kind, got in [*found, *state.close(True)]:
            for x in map(tuple, got.tolist()):
                if kind == linedup.GOES:
                    goes.add(x)
                elif kind == linedup.WAITS:
                    waits.append(x)
                else:
                    told[x[0]].add(x[2:4])
    goes |= {x for x in waits if len(told[x[0]]) >= 3 and max(told[x[0]]) != x[2:4]}
    assert goes == want


def test_line_bitmaps_round_trip():
    r = random.Random(1)
    for n in (1, 8, 9, 1000):
        gone = r.sample(range(n), n // 2)
        keep = linedup.unpacked(linedup.packed(n, gone), n)
        assert [i for i in range(n) if not keep[i]] == sorted(gone)


def test_line_dedup_of_nothing(spark):
    assert linedup.dedup(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        linedup.dropped(spark.createDataFrame([], DOCS), least_documents=1)


# ---- filter audit ----
def plain_fails(rows):
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search(r"[#$%&*|]", text), doc is not None and doc > first[text])
        yield "".join(x for x, t in zip("ABCDE", tests, strict=True) if t)


def plain_audit(rows, labels):
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    out, shapley = defaultdict(Counter), Counter()
    for (doc, _, source), fails in zip(rows, plain_fails(rows), strict=True):
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                c, failing = out[source or "", "".join(order), step], x in fails
                c["kept"] += not gone and not failing
                c["removed"] += not gone and failing
                c["redundant"] += gone and failing
                c["unique_fails"] += fails == x
                c["good_lost"] += not gone and failing and doc in good
                c["toxic_lost"] += not gone and failing and doc in toxic
                shapley[source or "", x] += not gone and failing
                gone |= failing
    return {k: {**c, "shapley": shapley[k[0], k[1][k[2] - 1]]} for k, c in out.items()}


def audit_rows():
    r = random.Random(9)
    words = ["the", "The", "THE", "cat", "été", "#", "ok|", "x" * 70_000, " ", "ABC", "b"]
    rows = [(i, "\n ".join(r.choice(words[: r.randrange(1, 12)]) if r.random() < 0.6 else f"w{r.randrange(300)}" for _ in range(r.choice((3, 49, 50, 51, 120)))), r.choice(("a", "b", None, ""))) for i in range(40)]
    rows += [(100 + i, rows[i % 3][1], "c") for i in range(9)] + [(0, rows[0][1], "a"), (None, rows[0][1], "a"), (None, "fresh", "a"), (200, None, "a"), (201, "", "b"), (202, " \t\r", "b"), (203, "\x1c\x85 w", "b")]
    return rows


LABELS = [(1, 1, None), (2, 0, 1), (2, 1, 1), (3, None, None), (None, 1, 1), (100, 1, 1), (999, 1, 0)]


def test_audit_by_plain_loops(spark, tmp_path):
    rows = audit_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("quality", "toxic", "part", "fails", "n", "digest_a", "id")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))
    found = queries.op12_filter_audit(spark, written(tmp_path, documents=docs, labels=labels)).collect()
    got = {(x["part"], x["filter_order"], x["step"]): {c: x[c] for c in x.asDict() if c not in ("part", "filter_order", "step")} for x in found}
    assert len(found) == len(got) == 600 * 4
    assert got == plain_audit(rows, LABELS)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], DOCS), none).collect() == []
    assert audit.audit(spark.createDataFrame([(1, None, None)], DOCS), none).count() == 600


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    texts = ["a b a c", "", "d", "b b e\ne", "aa bb aa"]
    data, offsets = buffers.text_bytes(pa.array(texts))
    monkeypatch.setattr(audit, "word_hashes", lambda data, starts, sizes: np.zeros(len(starts), np.uint64))
    assert audit.measure(data, offsets)[1].tolist() == [3, 0, 1, 2, 2]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_counts_of_pieces_and_chunks(monkeypatch, piece):
    monkeypatch.setattr(buffers, "PIECE", piece)
    monkeypatch.setattr(buffers, "CHUNK", 50)
    texts = [None, "", "Ab $c", "été Ünter", "x" * 300 + " Y", "  ", "a　b", None, "Z"]
    column = pa.concat_arrays([pa.array(["before"]), pa.array(texts)]).slice(1)
    got = [np.concatenate(x).tolist() for x in zip(*(audit.measure(d, o) for _, _, d, o in buffers.chunks(column)), strict=True)]
    want = [[len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts], None, [len(re.findall("[A-Z]", t or "")) for t in texts], [len(re.findall(r"[#$%&*|]", t or "")) for t in texts], [len(t or "") for t in texts]]
    want[1] = [len(set(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for t in texts]
    assert got == want


# ---- importance resampling ----
def plain_features(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(docs, target):
    s, t = (Counter(b for text in texts for b in plain_features(text)[1]) for texts in ([x[1] for x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for doc, text in docs:
        n, features = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, features))
        rows.append([doc, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], r[2]))
    for i, r in enumerate(enough[: len(enough) * 5 // 100]):
        r[5] = i + 1
    return [(r[0], *r[2:]) for r in rows]


def importance_rows():
    r = random.Random(4)
    words = ["Alpha", "beta", "gamma9", "École", "naïve", "日本", "x" * 65, "y" * 300, "don't", "a_b", "\x7f", "Z"]
    docs = [(i, r.choice((" ", "\n", ", ")).join(r.choice(words) for _ in range(r.choice((0, 1, 2, 3, 19, 20, 40))))) for i in range(400)]
    docs += [(None, docs[6][1]), (3, docs[3][1]), (3, docs[3][1]), (500, None), (501, ""), (502, "!!"), *((600 + i, " ".join(words * 3)) for i in range(200))]
    return docs, [" ".join(r.choice(words) for _ in range(30)) for _ in range(20)] + [None, ""]


def test_importance_by_plain_loops(spark, tmp_path, monkeypatch):
    docs, target = importance_rows()
    sf = written(tmp_path, documents=spark.createDataFrame([(*d, "s") for d in docs], DOCS).withColumns({c: F.lit(1) for c in ("id", "score", "rank", "n_words", "above")}), benchmark=spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    key = lambda x: (x[0] is not None, x[0] or 0, x[4] or 0, x[1])
    want = sorted(plain_resample(docs, target), key=key)
    assert sum(x[4] is not None for x in want) > 10
    assert sorted(map(tuple, queries.op11_importance_resampling(spark, sf).collect()), key=key) == want


def test_importance_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert importance.resample(none, none).collect() == []
    got = importance.resample(spark.createDataFrame([(1, "a b", None)], DOCS), none).collect()
    assert [(x["n_features"], x["rank"]) for x in got] == [(3, None)]


@pytest.mark.parametrize("most", [2, 5, 1 << 17])
def test_crc_of_runs_from_words(monkeypatch, most):
    monkeypatch.setattr(importance, "WORDS_AT_ONCE", most)
    texts = [" ".join("w" * n for n in (1, 64, 65, 66, 129, 131, 500, 3)), "", "one", "One TWO", "é" * 40 + " b c d"]
    data, offsets = buffers.text_bytes(pa.array(texts))
    starts, ends, before, last = importance._words(data, offsets)
    got = np.concatenate([found for _, found in importance.runs(data, starts, ends, last)], axis=1)
    for i, text in enumerate(texts):
        own = got[:, before[i] : before[i + 1]]
        assert sorted(own[own < importance.BUCKETS].tolist()) == sorted(plain_features(text)[1])


def test_ties_of_scores_go_by_id(spark):
    rows = spark.createDataFrame([(i % 50, 25, 1, 0, i // 100) for i in range(400)] + [(None, 25, 1, 0, 3), (900, 3, 1, 0, 9)], "id long, n_words long, n_features long, weight long, score long")
    got = importance.drawn(rows, percent=50).where("rank IS NOT NULL").orderBy("rank").collect()
    want = sorted(((-(i // 100), i % 50) for i in range(400)))
    want = sorted([*want, (-3, math.inf)])[:200]
    assert [(-g["score"], math.inf if g["id"] is None else g["id"]) for g in got] == want
    assert [g["rank"] for g in got] == list(range(1, 201))
