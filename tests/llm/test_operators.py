import base64
import collections
import hashlib
import json
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from evenhand.llm import bpe, crosspoly, lengths, minhash, nbsvm, pfair, rules, secrets, suffix, windows

EMPTY = "doc_id long, text string, source string"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, shared = prose(200, 1), prose(120, 2)
    words = base.split()
    words[100] = "changed"
    texts = [base, base, " ".join(words), prose(150, 3) + " " + shared, shared + " " + prose(90, 4), None, "", "one two", prose(3000, 6), "ab" * 900, prose(100, 7)]
    rows = [(i, t, ["a", "b", None][i % 3], "x") for i, t in enumerate(texts)] + [(9, "ab" * 900, "a", "x"), (None, prose(60, 9), "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string")


def der(tag, body):
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body


def test_secrets():
    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([7] * 40)) for _ in range(8)))
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = ".".join((part(json.dumps({"alg": "HS256"}).encode()), part(b'{"sub":1}'), part(b"x" * 32)))
    fake = ".".join((part(b'{"typ":"no"}'), part(b'{"sub":1}'), "abcd"))
    text = f'é password: "abcdef" token=abc AKIA{"Z" * 16} {"0a" * 12} {token} {fake} {base64.b64encode(key).decode()} {key.hex()}'
    kinds = collections.Counter(k for _, _, k in secrets.find(text))
    assert kinds["assign"] == 1 and kinds["access"] == 1 and kinds["jwt"] == 1 and kinds["der"] == 2 and kinds["hex"] == 2
    assert secrets.find(None) == [] == secrets.find("")
    assert "abcdef" not in secrets.redacted(text) and not secrets.is_private_key_der(key[:-1])
    assert secrets.find('passwd="token":abcdefgh') == []


def test_rule_statistics():
    text = "a b c d e f g h i\n\na b c d e f g h z\nx # $\nx # $"
    got = dict(zip(rules.COUNTS, rules.measure(text)))
    words = text.split()
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    assert got == {"n_words": 24, "word_chars": 24, "n_symbols": 4, "n_dup_lines": 1, "n_repeat_words": len(covered)}
    assert rules.measure(None) == rules.measure("") == (0,) * len(rules.COUNTS)
    x = np.vstack([np.random.default_rng(0).normal(size=(300, 3)), [[9, 9, 9]]])
    score = rules.grow(x, 50, 128, 1).score(x)
    assert score.argmax() == 300


def test_rules_learn_from_all_labelled_documents(spark, monkeypatch):
    """Of 13,000 labelled documents all grow a tree or set the cut-off, which is that of the plain definition."""
    got = {}
    calibrate, forest = rules.calibrate, rules.forest
    monkeypatch.setattr(rules, "calibrate", lambda s, good, bad, most: got.setdefault("limit", (s, good, bad, calibrate(s, good, bad, most)))[3])
    monkeypatch.setattr(rules, "forest", lambda grown, e: got.setdefault("forest", forest(grown, e)))
    ids = spark.range(13_000)
    docs = ids.selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', pmod(xxhash64(id, i), 9973), if(id % 13 = 0 AND i % 3 = 0, '##', '')))) AS text")
    counts = rules.judge(docs, ids.selectExpr("id AS doc_id", "int(id % 13 > 0) AS quality")).groupBy("base_failed").count().collect()
    assert [tuple(c) for c in counts] == [(False, 13_000)]
    s, good, bad, limit = got["limit"]
    assert got["forest"].feature.shape[0] == 200 and 6_000 < good.sum() + bad.sum() < 7_000
    good, bad = np.repeat(s, good), np.repeat(s, bad)
    floor = np.quantile(good, 1 - 0.005, method="higher")
    tried = np.unique([*bad[bad > floor], np.nextafter(floor, 2)])
    assert limit == tried[np.argmax([(bad >= c).mean() - (good >= c).mean() for c in tried])]


def test_rules_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = rules.judge(docs, labels).toPandas()
    assert len(got) == 13 and (got["kept"] == ~got["base_failed"]).all()


def test_bpe_round_trip(docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.encoder(bpe.default_path(), bpe.default_pattern())
    for text in ["", "Hello  world\n\n 123", "aaaaaaaaaaaaaaaaaaaaaaa", "é漢字🙂 'll", "x" * 5000, "<|endoftext|>", "ab" * 3000, "   a"]:
        assert own.encode(text) == other.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
    for r in bpe.round_trip(docs, keep=("text",)).collect():
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_length_histogram(spark, docs):
    found = lengths.encoded_lengths(docs)
    n = sorted(r["n_tokens"] for r in found.collect())
    hist = lengths.histogram(found)
    for r in hist.collect():
        assert r["docs_ge"] == sum(x >= r["n_tokens"] for x in n) and r["truncated_tokens"] == sum(min(x, r["n_tokens"]) for x in n)
    for r in lengths.truncated_totals(hist, [0, 5, 300, 10**6]).collect():
        assert r["kept_tokens"] == sum(min(x, r["limit"]) for x in n) and r["longer_docs"] == sum(x > r["limit"] for x in n)
    assert lengths.quantiles(hist, [0.5]).first()["n_tokens"] == n[int(np.ceil(0.5 * len(n))) - 1]


def test_suffix_array_and_prefixes():
    raw = np.random.default_rng(2).integers(97, 99, 600).astype(np.uint8)
    order, _ = suffix.suffix_array(raw, 40)
    padded = raw.tobytes() + bytes(40)
    keys = [padded[i : i + 40] for i in order]
    assert keys == sorted(keys)
    shared = suffix.common_prefixes(raw, order, np.array([0]), np.array([600]), 40)
    for i in range(1, 600):
        a, b = (raw[j : j + 40].tobytes() for j in (order[i], order[i - 1]))
        assert shared[i] >= next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("spread", [2000, 1])
def test_suffix_dedup_against_brute_force(docs, monkeypatch, spread):
    monkeypatch.setattr(suffix, "SPREAD", spread)
    rows = [(r["text"] or "").encode() for r in docs.collect()]
    starts = collections.Counter(t[i : i + 400] for t in rows for i in range(len(t) - 399))
    want = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if starts[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want.append((len(t), int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    got = [(r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix.dedup(docs).collect()]
    assert sorted(got) == sorted(want)


def test_near_duplicates(docs):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got[0, 196] == got[1, 196] == got[2, 196] == 0
    assert got[5, 0] == 5 and got[6, 0] == 6 and got[7, 1] == 7 and got[10, 96] == 10


def test_links_across_by_brute_force():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.permutation(300)[: 300 - d]], r.integers(0, 2**62, d, dtype=np.uint64)])) for d in r.integers(5, 90, 30)]
    sketches = np.array([minhash.odd_sketch(minhash.samples(s)) for s in sets])
    found = minhash.links_across(list(range(30)), np.ones(30, bool), sketches, sets, minhash._most_differing(0.75), 75)
    up = list(range(30))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def classes(pairs):
        up[:] = range(30)
        for a, b in pairs:
            up[root(a)] = root(b)
        return {frozenset(i for i in range(30) if root(i) == c) for c in map(root, range(30))}

    every = [(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    assert classes(found) == classes(every)


def test_compact_windows(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in windows.duplicate_passages(docs).collect()}
    assert got[0, 200]["n_dup_words"] == 200 and got[2, 200]["n_dup_words"] >= 199
    assert got[3, 270]["n_dup_words"] in range(119, 124) and got[4, 210]["class_id"] == 3
    assert got[10, 100]["n_dup_words"] == got[6, 0]["n_dup_words"] == got[8, 3000]["n_dup_words"] == 0
    h = np.random.default_rng(4).integers(0, 2**62, 300, dtype=np.uint64)
    doc, centre, left, right, least = windows.compact_windows([h[:200], h[200:]], windows._SEEDS[0])
    mixed = minhash.mixed(h * windows._SEEDS[0]) | np.uint64(1)
    for d, part in ((0, mixed[:200]), (1, mixed[200:])):
        want = set()
        for c in range(len(part)):
            a = next((i + 1 for i in range(c - 1, -1, -1) if part[i] < part[c]), 0)
            b = next((i - 1 for i in range(c + 1, len(part)) if part[i] < part[c]), len(part) - 1)
            if b - a + 1 >= windows.TOKENS:
                want.add((c, a, b))
        assert {(int(c), int(x), int(y)) for e, c, x, y in zip(doc, centre, left, right) if e == d} == want


def test_frequent_windows_are_dealt_out(spark, monkeypatch):
    """A passage that 40 texts share is found in all of them, and they are one class, though its windows go to many parts."""
    passage = [f"shared{i}" for i in range(60)]
    own = lambda d, n: [f"own{d}x{i}" for i in range(n)]
    texts = [own(d, 20 + d) + passage + own(-d - 1, 30) for d in range(40)] + [own(d, 120) for d in range(40, 50)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(windows, "PART_OF_HASH", 4)
    met = windows.meeting(windows.windows(docs, "text").where("least is not null"))
    assert met.where("part is not null").select("part").distinct().count() > 1
    for r in windows.duplicate_passages(docs).collect():
        if r["doc_id"] < 40:
            assert r["class_id"] == 0 and r["n_partners"] > 0
            assert any(s["x"] <= 20 + r["doc_id"] and s["y"] >= 80 + r["doc_id"] for s in r["spans"])
        else:
            assert r["class_id"] == r["doc_id"] and r["n_dup_words"] == 0


@pytest.mark.parametrize("size", [54, 70, 84])
@pytest.mark.parametrize("change", [lambda w, i: w[:i] + ["added"] + w[i:], lambda w, i: w[:i] + w[i + 1 :], lambda w, i: w[:i] + ["so", "many", "more"] + w[i:]])
def test_passages_with_words_added_or_dropped(size, change):
    words = [f"w{i}" for i in range(size)]
    other = change(words, size // 2)
    before, after = [f"x{i}" for i in range(30)], [f"y{i}" for i in range(60)]
    a, b = (windows.tokens_of(" ".join(w)).astype(np.uint32).view(np.int32) for w in (before + words + after, after[::-1] + other + before[::-1]))
    for offset in (30, 30 + len(other) - size):
        for x, y, o in ((a, b, offset), (b, a, -offset)):
            own, found = windows.passages(x, y, [o])
            for spans, begin, n in ((own, 30 if x is a else 60, size if x is a else len(other)), (found, 60 if x is a else 30, len(other) if x is a else size)):
                assert len(spans) == 1 and spans[0][0] in range(begin - 12, begin + 1) and spans[0][1] in range(begin + n, begin + n + 13)


@pytest.mark.parametrize("part", [windows.PART_OF_HASH, 7])
def test_exact_repeats_that_go_on_from_a_common_start(spark, monkeypatch, part):
    monkeypatch.setattr(windows, "PART_OF_HASH", part)
    least = lambda text: [int(np.argmin(minhash.mixed(windows.tokens_of(text) * s) | np.uint64(1))) for s in windows._SEEDS]
    start = next(t for t in (prose(42, i) for i in range(700, 2000)) if max(least(t)) < 14)  # no half passage from there reaches the tail
    tails = [prose(8, 800 + i // 2) if i < 160 else "" for i in range(400)]
    texts = [f"{prose(20, 1000 + i)} {start} {tail} {prose(20, 2000 + i)}" for i, tail in enumerate(tails)]
    got = {r["doc_id"]: r for r in windows.duplicate_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    missed = [i for i in range(160) if not any(s["x"] <= 20 and s["y"] >= 70 for s in got[i]["spans"])]
    assert not missed and all(got[i]["class_id"] == got[i + 1]["class_id"] for i in range(0, 160, 2))


@pytest.mark.parametrize("part", [windows.PART_OF_HASH, 3])
def test_windows_are_grouped_in_one_shuffle(spark, monkeypatch, part):
    """Pairs and groups against plain loops over the windows; those of hashes beyond the limit are handed on whole."""
    monkeypatch.setattr(windows, "PART_OF_HASH", part)
    monkeypatch.setattr(windows, "ROWS_OF_GROUPS", 50)
    texts = [f"{prose(20 + i, i)} {prose(60, 500 + i // 3)} {prose(30, 100 + i)} {prose(60, 500 + i // 3) if i % 4 == 0 else ''}" for i in range(60)] * 2
    texts += [f"{prose(30, 300 + i)} {prose(60, 900)}" for i in range(20)]
    found = windows.windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "text")
    rows = {tuple(r) for r in found.where("least is not null").collect()}
    got = windows.groups(found).collect()
    often = {k for k in {r[0] for r in rows} if sum(r[0] == k for r in rows) > part}
    handed = {(r["least"], r["tkey"], r["place"], r["before"], r["after"], r["context"]) for r in got if r["kind"] == "window"}
    assert {r for r in rows if r[0] in often} <= handed and bool(handed) == (part == 3)
    met = {}
    for least, tkey, place, before, after, _ in rows - handed:
        for side, mark in ((0, before), (1, after)):
            if mark is not None:
                met.setdefault((least, side, mark), {}).setdefault(tkey, set()).add(place)
    met = [g for g in met.values() if len(g) > 1]
    plain = [g for g in met if len(g) <= windows.MOST_TEXTS and all(len(p) == 1 for p in g.values())]
    want = set()
    for g in plain:
        for a in g:
            for b in g:
                (x,), (y,) = g[a], g[b]
                if a < b and min(x >> 8 & 255, y >> 8 & 255) + min(x & 255, y & 255) + 1 >= windows.AGREEING:
                    want.add((a, b, (y >> 16) - (x >> 16)))
    assert {(r["least"], r["tkey"], r["place"]) for r in got if r["kind"] == "pair"} == want and (want or part == 3)
    left = {}
    for r in got:
        if r["kind"] == "group":
            left.setdefault((r["least"], r["texts"]), {})[r["tkey"]] = tuple(sorted(r["places"]))
    assert all(n == len(g) for (_, n), g in left.items())
    want = sorted(sorted((t, tuple(sorted(p))) for t, p in g.items()) for g in met if g not in plain)
    assert sorted(sorted(g.items()) for g in left.values()) == want
    assert {(r["tkey"], r["place"]) for r in got if r["kind"] == "size"} == {(r["tkey"], r["place"]) for r in found.where("least is null").collect()}


def test_groups_with_the_same_texts_and_places_are_met_once(spark):
    kinds = "key long, tkey long, places array<long>, context long, texts int"
    rows = spark.createDataFrame([(k, t, p, 0, 2) for k, g in enumerate(([(1, [5, 6]), (2, [7])], [(2, [7]), (1, [6, 5])], [(1, [5]), (2, [7])], [(1, [5, 6]), (3, [7])])) for t, p in g], kinds)
    left, known = windows.fresh(rows)
    assert {r["key"] for r in left.collect()} == {0, 2, 3} and left.count() == 6
    assert windows.fresh(rows.where("key = 1"), known)[0].isEmpty()


def test_strange_tokens_of_many_rows_at_once():
    draw = np.random.default_rng(12)
    side = windows.LONGEST - 1
    rows, want = [], []
    for i in range(300):
        a = draw.integers(-60, 60, draw.integers(1, 400)).astype(np.int32)
        b = np.r_[a[draw.integers(0, len(a)) :], a].astype(np.int32) if i % 2 else draw.integers(-60, 60, draw.integers(1, 400)).astype(np.int32)
        x, y = (draw.integers(0, len(t), 1 + (draw.random() < 0.2)) for t in (a, b))
        la, lb = max(0, x.min() - side), max(0, y.min() - side - windows.APART)
        rows.append((x << 16, a[la : x.max() + side + 1], y << 16, b[lb : y.max() + side + 1 + windows.APART], la, len(a), lb, len(b)))
        want.append(sorted(windows.strange_tokens(a, x, b, y).tolist()))
    lists = [(np.concatenate(c), np.r_[0, np.cumsum([len(v) for v in c])]) for c in list(zip(*rows, strict=True))[:4]]
    values, ends = windows.strange_lists(*lists, *(np.array(c) for c in list(zip(*rows, strict=True))[4:]))
    assert [sorted(values[m:n].tolist()) for m, n in zip(ends[:-1], ends[1:], strict=True)] == want and any(want)


def test_changed_passages_that_a_large_group_shares_in_twos(spark):
    """Two of many texts with a common start go on alike but for a word: the first and the last text of their group don't."""
    least = lambda text: [int(np.argmin(minhash.mixed(windows.tokens_of(text) * s) | np.uint64(1))) for s in windows._SEEDS]
    start = next(t for t in (prose(42, i) for i in range(700, 2000)) if max(least(t)) < 14)
    tails = [prose(12, 800 + i // 2).split() if i < 80 else [] for i in range(100)]
    for i in range(1, 80, 2):
        tails[i][2] = "changed"
    texts = [f"{prose(20, 1000 + i)} {start} {' '.join(tail)} {prose(20, 2000 + i)}" for i, tail in enumerate(tails)]
    got = {r["doc_id"]: r for r in windows.duplicate_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i]["class_id"] == got[i + 1]["class_id"] and got[i]["n_dup_words"] >= 50 for i in range(0, 80, 2)) >= 38


def test_near_copies_of_a_passage_are_compared_in_twos(spark, monkeypatch):
    """40 texts share a passage, each with other words changed: a hub would lack tokens in every round, so groups of nearly all of
    them would follow. All pairs are compared instead, and what each text has in common with any other is found."""
    monkeypatch.setattr(windows, "lacking", None)
    passage, r = prose(70, 77).split(), random.Random(3)
    texts = []
    for i in range(40):
        words = list(passage)
        for at in r.sample(range(70), 3):
            words[at] = f"changed{i}x{at}"
        texts.append(f"{prose(20 + i, 3000 + i)} {' '.join(words)} {prose(30, 4000 + i)}")
    got = {x["doc_id"]: {w for s in x["spans"] for w in range(s["x"], s["y"])} for x in windows.duplicate_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    tokens = [windows.tokens_of(t).astype(np.uint32).view(np.int32) for t in texts]
    want = {i: set() for i in range(40)}
    for i in range(40):
        for j in range(i):
            for k, spans in zip((i, j), windows.passages(tokens[i], tokens[j], [j - i]), strict=True):
                want[k] |= {w for x, y in spans for w in range(x, y)}
    assert sum(len(w) for w in want.values()) > 1000 and got == want


def test_pairs_of_a_cluster_are_dealt_out_together(spark, monkeypatch):
    monkeypatch.setattr(windows, "PAIRS", 100)
    rows = [(100 * c + i, 100 * c + j, [c]) for c in range(5) for j in range(20) for i in range(j)]
    got = windows.dealt_pairs(spark.createDataFrame(rows, "a long, b long, offsets array<int>")).collect()
    assert sorted((r["a"], r["b"], r["offsets"]) for r in got) == sorted(rows)
    assert len({(r["deal"], r["part"], r[c]) for r in got for c in "ab"}) <= 5 * 20 * 2 and len({(r["deal"], r["part"]) for r in got}) >= 4


def test_nearest_recall_and_exclusions(spark):
    x = np.random.default_rng(5).normal(size=(400, 16))
    x[20] = x[21]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    import pyspark.sql.functions as F

    got = crosspoly.search(df, F.col("vec_id") % 20 == 0, k=5).toPandas()
    hits = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:5]) & set(got[got["query_id"] == q]["vec_id"]))
    assert hits >= 0.9 * 100 and set(got["query_id"]) == set(range(0, 400, 20))


def test_ties_go_to_smaller_ids(spark):
    r = np.random.default_rng(12)
    x, ids = [], []
    for g in range(12):
        q = r.normal(size=16)
        q /= np.linalg.norm(q)
        x += [q, *(q * (1.5 + 0.01 * i) for i in range(10)), *[q * 1.2] * 40]
        ids += [100 * g, *range(100 * g + 60, 100 * g + 70), *r.permutation(np.arange(100 * g + 1, 100 * g + 41)).tolist()]
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    import pyspark.sql.functions as F

    got = crosspoly.search(df, F.col("vec_id") % 100 == 0, k=20).toPandas().sort_values(["query_id", "rank"])
    whole = 0
    for g in range(12):
        found = got[got["query_id"] == 100 * g]["vec_id"].tolist()
        copies = [i - 100 * g for i in found if 100 * g < i <= 100 * g + 40]
        assert copies in ([], list(range(1, 11)))  # equal vectors share their buckets
        whole += found == [*range(100 * g + 69, 100 * g + 59, -1), *range(100 * g + 1, 100 * g + 11)]
    assert whole >= 6


def test_classifier_held_out(spark):
    r = random.Random(8)
    texts = [(i, prose(60, i) if i % 3 else " ".join(w + "!!" for w in prose(60, i).upper().split())) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = nbsvm.classify(docs, labels).toPandas()
    held = got[got["held_out"]]
    assert len(held) > 20 and ((held["doc_id"] % 3 > 0) == (held["predicted"] == 1)).mean() > 0.95
    assert nbsvm.classify(docs, labels.limit(0)).where("score = 0.5").count() == 300 and r


def test_pfair_deviation():
    weights = {"a": 5, "b": 3, "c": 1, "d": 2}
    slots = pfair.period(weights) * 2
    for t in range(1, len(slots) + 1):
        for s, w in weights.items():
            assert abs(slots[:t].count(s) - t * w / 11) < 1


def test_mixture_is_whole(docs):
    got = pfair.mixed(docs, {"a": 3}, block=2).toPandas()
    assert len(got) == 13 and got[["mix_slot", "mix_position"]].drop_duplicates().shape[0] == 13
    assert sorted(got["mix_slot"].unique()) == list(range(got["mix_slot"].nunique()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for made in (secrets.digest(secrets.scan(none)), rules.judge(none, labels), lengths.histogram(lengths.encoded_lengths(none)), suffix.dedup(none), minhash.near_duplicates(none), windows.duplicate_passages(none), nbsvm.classify(none, labels), pfair.mixed(none, {}), bpe.round_trip(none)):
        assert made.count() == 0
    assert crosspoly.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), __import__("pyspark").sql.functions.lit(True)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    con = duckdb.connect()
    texts = con.execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchdf()
    assert len(got) and set(got["doc_id"]) <= set(texts["doc_id"]) and got["doc_id"].is_unique
    assert isinstance(got, pd.DataFrame)
