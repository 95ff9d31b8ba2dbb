"""The first pipeline stage, places in the mixture and clashing names, against plain versions."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenhand.llm import nbsvm, pfair

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    raw, out = (text or "").encode(), set()
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            key = n
            for b in raw[i : i + n]:
                key = (key * 0x01000193 + b) % 2**32
            out.add((key * 0x9E3779B1) % 2**32 >> 14)
    return sorted(out)


def plain_ratio(sets, y):
    counts = [[1.0] * (1 << 18), [1.0] * (1 << 18)]
    for s, label in zip(sets, y, strict=True):
        for g in s:
            counts[label][g] += 1
    return [math.log(a / sum_a) - math.log(b / sum_b) for sum_a, sum_b in [(sum(counts[1]), sum(counts[0]))] for a, b in zip(counts[1], counts[0], strict=True)]


def plain_score(text, model):
    g = grams(text)
    length = math.sqrt(sum(float(model.ratio[i]) ** 2 for i in g))
    margin = (sum(float(model.weights[i]) for i in g) / length if length else 0.0) + model.bias
    return 1 / (1 + math.exp(-min(30, max(-30, model.slope * margin + model.shift))))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(6)
    word = lambda good: r.choice(("river", "stone", "window", "letter") if good else ("$$$", "click", "WIN", "xx1"))
    rows = [(i, " ".join(word(i % 3 > 0 or r.random() < 0.3) for _ in range(r.randrange(5, 40))), "en", "s", 1) for i in range(160)]
    rows += [(3, rows[3][1], "en", "s", 1), (None, rows[4][1], None, None, None), (200, None, "en", "s", 1), (201, "", "en", "s", 1), (202, "é", "en", "s", 1), (203, "stone " * 300_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit(1), "id": F.lit("x"), "y": F.lit(2)})
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(4, 0), (None, 1), (6, None), (999, 1)], "doc_id long, quality int").withColumn("text", F.lit("label"))
    folder = str(tmp_path_factory.mktemp("corpus"))
    labels.write.parquet(f"{folder}/labels.parquet")
    return rows, docs, labels, folder


def test_classifier_by_plain_loops(spark, corpus):
    rows, docs, labels, folder = corpus
    model = nbsvm.fit(docs, labels)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    learned = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5]
    part = [i for n, i in enumerate(learned) if n % 4 != 3]
    assert model.ratio.tolist() == pytest.approx(plain_ratio([grams(texts[i]) for i in part], [int(i % 3 > 0 and i != 4) for i in part]), abs=1e-5)
    want = {r[1]: plain_score(r[1], model) for r in rows}
    for got in nbsvm.scored(docs, model, keep=("text",)).collect():
        assert got["score"] == pytest.approx(want[got["text"]], abs=1e-6)
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == corpus_pipeline.COLUMNS
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(map(tuple, kept.collect()), key=key) == sorted((r for r in rows if want[r[1]] >= 0.3), key=key)
    assert 0 < kept.count() < len(rows)


def test_quality_of_nothing(spark, corpus):
    assert corpus_pipeline.quality(spark, spark.createDataFrame([], DOCS), corpus[3]).collect() == []


def test_files_go_by_their_numbers(spark):
    r = random.Random(1)
    numbers = [*range(0, 3000, 7), *range(99_990, 100_020), 1_000_000, 10_000_000]
    sizes = [(f"part-{n:05d}-{r.randrange(10**6)}.c000.parquet", r.randrange(5)) for n in numbers]
    want, at = {}, 0
    for name, n in sizes:
        want[name] = at
        at += n
    r.shuffle(sizes)
    got = corpus_pipeline.file_starts(spark.createDataFrame(sizes, "file string, n long")).collect()
    assert {g["file"]: g["start"] for g in got} == want


def test_mixing_keeps_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr(pfair, "RANKED", 3)
    mine = ("~rank", "~s", "~h", "~b", "s", "h", "b", "rank", "c0", "p_s", "phase", "mix_block", "a.b", "id")
    rows = [(i, "xyz"[i % 3] if i % 5 else None) for i in range(200)]
    plain = spark.createDataFrame(rows, "doc_id long, source string")
    docs = plain.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in mine})
    got = pfair.mixed(docs, {"x": 3, "y": 2}, block=4).toPandas()
    assert got.columns.tolist() == ["doc_id", "source", *(c for c in mine if c != "mix_block"), "mix_slot", "mix_block", "mix_position"]
    for c in mine:
        if c != "mix_block":
            assert (got[c] == f"{c}:" + got["doc_id"].astype(str)).all()
    for _, own in got.fillna({"source": ""}).groupby("source"):
        place = np.sort(own["mix_block"] * 4 + own["mix_position"])
        assert place.tolist() == list(range(len(own)))
