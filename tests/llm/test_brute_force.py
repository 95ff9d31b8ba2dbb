"""Queries and stages against plain versions, on small fixtures with nulls, repeats, ties and clashing columns."""

import hashlib
import random
import re
from math import gcd

import duckdb
import numpy as np
import pytest

from evenhand.llm import crosspoly, lengths, minhash, nbsvm, pfair, queries, rules, secrets, suffix, windows

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def plain_spans(text):
    """The base kinds, letter by letter."""
    found, i = [], 0
    while i < len(text):
        word = next((k for k in KEYWORDS if text[i : i + len(k)].lower() == k and text[i : i + len(k)].isascii()), None)
        j = i + len(word) if word else None
        if word:
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] in (":", "=") and text[j : j + 1]:
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                k = j
                while k < len(text) and text[k] in VALUE:
                    k += 1
                if k > j:
                    if k - j >= 6:
                        found.append(("assign", i, k))
                    i = k
                    continue
        i += 1
    for kind, start, letters, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            k = i + len(start)
            while text.startswith(start, i) and k < len(text) and text[k] in letters:
                k += 1
            if k > i + len(start):
                if k - i >= least:
                    found.append((kind, i, k))
                i = k
            else:
                i += 1
    order = ("assign", "access", "hex")
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def test_secret_spans_by_letters(spark):
    r = random.Random(3)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "A1" * 9, "0af" * 9, "g", "é", "abc123", "x" * 7, "\n", "-", "ſecret", "toKen"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(1500)] + [None, "", "a" * 100_000, "token=" + "z" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("x", "x").selectExpr("*", "doc_id AS id", "'k' AS kind")
    for row in secrets.digest(secrets.scan(df)).collect():
        want = plain_spans(texts[row["doc_id"]] or "")
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), texts[row["doc_id"]]
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))


def test_near_dedup_equals_its_twin(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {tuple(r) for r in con.execute("SELECT doc_id, n_shingles, component_id, kept FROM (" + queries.NEAR_DEDUP_SQL + ")").fetchall()}
    got = queries.op5_minhash_near_dedup(spark, "/root/testdata/sf0.001")
    assert {tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()} == want


def naive_slots(weights, blocks):
    """(source, block) by slot: at each slot the released block with the earliest deadline."""
    left, first, slots = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        shrink = gcd(*(weights[s] for s in left))
        own, done, t, total = {s: weights[s] // shrink for s in left}, dict.fromkeys(left, 0), 0, sum(weights[s] // shrink for s in left)
        while all(done[s] < n for s, n in left.items()):
            ready = [s for s in left if done[s] * total // own[s] <= t]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // own[s]), -own[s], s))
            slots.append((s, first[s] + done[s]))
            done[s] += 1
            t += 1
            assert all(abs(done[x] - t * own[x] / total) < 1 for x in left)
        for s in list(left):
            first[s] += done[s]
            left[s] -= done[s]
            if not left[s]:
                del left[s]
    return slots


def test_mixture_follows_the_naive_schedule(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a"] * 6 + ["b", "b", "c", None, ""]), "x" * (i % 5)) for i in range(700)] + [(3, "a", "again"), (3, "a", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    weights = {"a": 4, "b": 3, "c": 2}
    got = pfair.mixed(docs, weights, block=5).toPandas()
    sizes = got.assign(s=got["source"].fillna("")).groupby("s").size().to_dict()
    want = naive_slots({s: weights.get(s, 1) for s in sizes}, {s: -(-n // 5) for s, n in sizes.items()})
    assert {(r.source or "", r.mix_block): r.mix_slot for r in got.itertuples()} == {x: i for i, x in enumerate(want)}
    assert len(got) == 702 and not got.duplicated(["mix_slot", "mix_position"]).any() and got["mix_position"].max() == 4


def test_many_sources():
    made = pfair.phases({f"s{i}": 1 for i in range(1000)}, {f"s{i}": i % 40 + 1 for i in range(1000)})
    assert made.num_rows < pfair.MOST_SLOTS and len(set(made["s"].to_pylist())) == 1000
    with pytest.raises(ValueError):
        pfair.phases({f"s{i}": 2000 + i for i in range(2000)}, {f"s{i}": 9 for i in range(2000)})


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    texts = [words(60, i) if i % 4 else " ".join(w + "###" for w in words(60, i).split()) for i in range(400)]
    rows = [(i, t, i, "x", i) for i, t in enumerate(texts)] + [(5, texts[5], 5, "x", 5), (None, None, None, None, None), (400, "", 1, "x", 1), (401, words(30_000, 9), 1, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, y string, f long").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), i) for i in range(400)] * 2 + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, id long")
    return docs, labels


def test_forest_rejects_what_the_plain_rules_pass(spark, labelled):
    r = random.Random(2)
    texts = [words(60, i) if i % 16 else " ".join(w + "#" * r.randint(1, 4) for w in words(60, i).split()) for i in range(800)]
    extra = labelled[0].where("doc_id >= 400 OR doc_id IS NULL").select("doc_id", "text", "id", "y")
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, id long, y string").unionByName(extra.withColumn("doc_id", extra["doc_id"] + 1000))
    labels = spark.createDataFrame([(i, int(i % 16 > 0), i) for i in range(800)], "doc_id long, quality int, id long")
    got = rules.judge(docs, labels).toPandas()
    assert len(got) == 803
    plain = got[(got["doc_id"] < 800) & ~got["base_failed"]]
    odd = plain["doc_id"] % 16 == 0
    assert odd.sum() == 50 and (~plain[odd]["kept"]).mean() > 0.9 and plain[~odd]["kept"].mean() > 0.97
    assert not got[got["base_failed"]]["kept"].any()


def test_rule_counts_by_brute_force(spark, labelled):
    texts = {r["doc_id"]: r["text"] or "" for r in labelled[0].collect()} | {900: "a b c d e f g h i\n\n\t\na b c d e f g h\n| $\n| $ \x0b", 901: "\x85 \u00a0 x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for row in rules.statistics(df).collect():
        text = texts[row["doc_id"]]
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert tuple(row[c] for c in rules.COUNTS) == (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_classifier_with_clashing_columns(labelled):
    got = nbsvm.classify(*labelled).toPandas()
    held = got[got["held_out"] & (got["doc_id"] < 400)]
    assert len(got) == 404 and got["score"].between(0, 1).all() and ((held["doc_id"] % 4 > 0) == (held["predicted"] == 1)).mean() > 0.95


def test_dual_coordinate_descent_meets_the_optimum():
    r = np.random.default_rng(6)
    ratio = r.normal(size=40)
    rows = [np.sort(r.choice(40, 12, replace=False)) for _ in range(60)]
    y = np.where(r.random(60) < 0.5, -1.0, 1.0)
    cost = np.full(60, 0.7)
    u, bias = nbsvm.dual_coordinate_descent(rows, ratio, y, cost, epochs=3000)
    x = np.zeros((60, 41))
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.linalg.norm(ratio[f])
        x[i, 40] = 1
    value = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    own = np.r_[u / ratio, bias]
    w = np.zeros(41)
    best = value(w)
    for t in range(1, 40_000):  # subgradient steps on the primal
        w -= (w - (cost * y * (y * (x @ w) < 1)) @ x) / t
        best = min(best, value(w))
    assert value(own) <= best * 1.001  # it stops at steps of a thousandth


def test_operators_leave_other_columns_alone(spark, labelled):
    docs = labelled[0].where("doc_id < 12 OR doc_id IS NULL").selectExpr("*", "1 AS tkey", "2 AS node", "3 AS a", "4 AS b", "5 AS spans", "6 AS n_tokens", "7 AS anchor", "8 AS `~q`")
    n = docs.count()
    for made in (suffix.dedup(docs), minhash.near_duplicates(docs), windows.duplicate_passages(docs), secrets.digest(secrets.scan(docs)), lengths.encoded_lengths(docs), pfair.mixed(docs, {})):
        assert made.count() == n
    points = spark.createDataFrame([(i, [1.0 + i, 2.0], 0, 0) for i in range(30)], "vec_id long, embedding array<double>, id long, `~q` int")
    assert crosspoly.search(points, points["vec_id"] % 20 == 0, k=3).count() == 6


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    import base64

    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline as pipe

    a, b = words(80, 1), words(80, 2)
    rows = [(3, b), (5, a), (5, b), (5, a), (9, ""), (10, None), (9, ""), (None, a), (11, words(40, 3) + " password=abcdef12"), (12, words(20, 4))]
    docs = spark.createDataFrame([(i, t, "en", f"src{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = pipe.near_dedup(spark, docs, "")
    assert sorted(((r["doc_id"] or -1, r["text"] or "") for r in left.collect())) == sorted([(3, b), (5, a), (9, ""), (9, ""), (10, ""), (11, rows[8][1]), (12, rows[9][1])])
    clean = pipe.redact(spark, left, "")
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"] or "") and "password=abcdef12" not in (r["text"] or "")
    mixture = pipe.mix(spark, clean, "")
    assert mixture.columns == pipe.COLUMNS and mixture.count() == 7
    mixture.write.parquet(str(tmp_path / "mix"))
    placed = pfair.mixed(clean, pipe.TARGETS).orderBy("mix_slot", "mix_position").select("doc_id", "text").collect()
    got = pipe.encode(spark, spark.read.parquet(str(tmp_path / "mix")), "").orderBy("position").collect()
    ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [r["position"] for r in got] == list(range(7)) and [r["doc_id"] for r in got] == [r["doc_id"] for r in placed]
    for r, want in zip(got, placed):
        ids = other.encode_ordinary(want["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert all(r["position"] is None for r in pipe.encode(spark, clean, "").collect())
    none = docs.limit(0)
    for stage in (pipe.near_dedup, pipe.redact, pipe.mix, pipe.encode):
        assert stage(spark, none, "").count() == 0
