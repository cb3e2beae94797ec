"""ProbMinHash classes, fingerprints and their tables against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llmcases import ODD, make_docs, words  # noqa: F401

from loomwork.llm import probminhash, simhash


def sets(text, width=5):
    w = (text or "").encode().split()
    return Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)] if w else [])


def likeness(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in x if i in y)


def classes(rows, threshold=0.8):
    by = {}
    for i, t in rows:
        if i is not None:
            by.setdefault(i, []).append(sets(t))
    parent = {i: i for i in by}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    all_ = [(i, s) for i, l in by.items() for s in l if s]
    for a in range(len(all_)):
        for b in range(a):
            (i, x), (j, y) = all_[a], all_[b]
            if i != j and (x == y or not set(x).isdisjoint(y) and likeness(x, y) >= threshold):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: find(i) for i in by}


def near_rows():
    rng = random.Random(11)
    rows = []
    for group in range(12):
        base = words(120, group).split()
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 8, 20])):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((len(rows) * 2 + 1, " ".join(w)))
    return rows + [(900, "a b c"), (901, "a  b\nc"), (902, "a b d"), (903, "red red red red red red red"), (904, "red red red red red red red red")]


@pytest.mark.parametrize("rows", [near_rows(), [r for r in ODD if len(r[1] or "") < 9000]], ids=["near", "odd"])
def test_classes(make_docs, rows):
    got = probminhash.near_classes(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = classes(rows)
    assert {(r.doc_id, r.class_id) for r in got} == {(i, want.get(i)) for i, _ in rows}


@pytest.mark.parametrize("block", [1000, 7])
def test_a_large_family_loses_no_link(make_docs, monkeypatch, block):
    """Many texts near each other but not all near one, in one block and in many."""
    monkeypatch.setattr(probminhash, "BLOCK_DOCS", block)
    rng = random.Random(2)
    base = words(100, 5).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(100), rng.choice([1, 2, 3, 5])):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w + ["twice twice twice twice twice twice"] * (i % 7 == 0))))
    want = classes(rows)
    got = {r.doc_id: r.class_id for r in probminhash.near_classes(make_docs(rows)).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [probminhash.BROADCAST_DOCS, 0], ids=["sent", "shuffled"])
def test_one_document_of_several_texts(make_docs, monkeypatch, limit):
    """A doc_id with two texts joins the classes of both, wherever the first rows of these are."""
    monkeypatch.setattr(probminhash, "BROADCAST_DOCS", limit)
    a, b, c = (words(60, k) for k in (1, 2, 3))
    near = lambda t: " ".join(["edited", *t.split()[1:]])
    rows = [(1, b), (5, a), (5, b), (5, b), (7, a), (8, near(a)), (9, c), (3, near(c)), (5, None), (None, a), (11, ""), (12, "")]
    got = [(r.doc_id, r.class_id) for r in probminhash.near_classes(make_docs(rows)).collect()]
    want = {1: 1, 5: 1, 7: 1, 8: 1, 9: 3, 3: 3, None: None, 11: 11, 12: 12}
    assert sorted(got, key=str) == sorted(((i, want[i]) for i, _ in rows), key=str)
    assert classes(rows) == {i: w for i, w in want.items() if i is not None}


def test_hot_keys_are_joined_once(spark, monkeypatch):
    from loomwork.llm import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    left = spark.createDataFrame([(k, i) for k in range(9) for i in range(k)], "k long, i long")
    right = left.groupBy("k").count().where("k != 5")
    for keys in (10_000, 1):
        monkeypatch.setattr(skew, "HOT_KEYS", keys)
        got = skew.join_unique(left, right, ["k"], "count", 36).collect()
        assert sorted((r.k, r.i, r["count"]) for r in got) == [(k, i, k) for k in range(9) for i in range(k) if k != 5]


def test_empty(make_docs):
    assert probminhash.near_classes(make_docs([])).collect() == []


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + k) for k in range(1, 40)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r.node: r.least for r in probminhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_few_links_are_joined_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    path = rng.sample(range(1000, 2000), 1000)
    pairs = [(x, x) for x in (1, 2)] + list(zip(path[:-1], path[1:])) + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(5000 - k, 5000) for k in range(300)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5).localCheckpoint()
    spark.sparkContext.setJobGroup("few links", "")
    try:
        got = {r.node: r.least for r in probminhash.components(links, len(pairs)).collect()}
        # Written, and read for this test; each round of the contraction takes several.
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(path) - {1000} == {x for x, y in got.items() if y == 1000} and {got[5000 - k] for k in range(299)} == {5000 - 299}
    assert all(got.get(a, a) == got.get(b, b) for a, b in pairs) and all(y < x for x, y in got.items())
    assert probminhash.components(links.limit(0), 0).collect() == []
    assert {r.node: r.least for r in probminhash.components(links).collect()} == got  # by one task after a round
    monkeypatch.setattr(probminhash, "TASK_LINKS", 0)
    assert {r.node: r.least for r in probminhash.components(links, len(pairs)).collect()} == got


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    x, y = rng.integers(0, 4, 300) * 1.0, rng.integers(0, 4, 300) * 1.0
    m = 2048
    row = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    got = probminhash.sketch(row, np.concatenate([h[x > 0], h[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, m)
    order = np.argsort(h)
    exact = probminhash.similarity(*(a for v in (x, y) for a in (h[order][v[order] > 0], v[order][v[order] > 0])))
    assert abs(exact - likeness(Counter({k: v for k, v in zip(h.tolist(), x) if v}), Counter({k: v for k, v in zip(h.tolist(), y) if v}))) < 1e-9
    assert abs((got[0] == got[1]).mean() - exact) < 4 * (exact * (1 - exact) / m) ** 0.5
    alone = probminhash.sketch(np.zeros(1, int), h[:1], np.ones(1), 1, m)
    assert (alone == h[0]).all()


def fingerprint(spark, text):
    """Term by term in Python, with Spark's hash for single terms."""
    from pyspark.sql import functions as F

    w = (text or "").encode().split()
    terms = [tuple(w[max(0, k - 4) : k + 1]) for k in range(len(w))]
    if not terms:
        return "0" * 32
    rows = [([None] * (5 - len(t)) + [x.decode() for x in t],) for t in terms]
    h = spark.createDataFrame(rows, "t array<string>").select(F.xxhash64(*(F.get("t", i) for i in range(5))).alias("a")).select("a", F.xxhash64("a", F.lit(1)).alias("b")).collect()
    out = ""
    for name in "ab":
        bits = sum(1 << i for i in range(64) if 2 * sum((r[name] >> i) & 1 for r in h) > len(h))
        out += f"{bits:016x}"
    return out


@pytest.mark.parametrize("rows", [ODD[:-3] + [(20, words(40, 3)), (21, words(41, 3)), (1000, "one"), (10**15, "two words")], [(5, "only one text of five words")], []], ids=["odd", "one", "none"])
def test_fingerprints(spark, make_docs, rows):
    got = sorted(simhash.edited_fingerprints(make_docs(rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.edited_sha256))
    assert len(got) == len(rows)
    ids = [i for i, _ in rows]
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, []).append(r)
    texts = {t or "" for i, t in rows if ids.count(i) == 1}
    own = {i: t or "" for i, t in rows if ids.count(i) == 1}
    order = sorted(own)
    for k, i in enumerate(order):
        (r,) = prints[i]
        assert r.n_chars == len(own[i])
        if len(own[i]) < 1000:
            assert r.fingerprint == fingerprint(spark, own[i])
        after = order[(k + 1) % len(order)]
        if len(texts) == len(own) and all(ids.count(x) == 1 for x in ids):
            half = len(own[i]) // 2
            edited = own[i][: len(own[i]) - half] + own[after][:half]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            if len(edited) < 1000:
                assert r.edited_fingerprint == fingerprint(spark, edited)
            differ = bin(int(r.fingerprint, 16) ^ int(prints[after][0].fingerprint, 16)).count("1")
            assert r.near_next == 1 - differ / 128
    same = {r.fingerprint for r in got if r.doc_id == 5}
    assert len(same) <= 1


def test_next_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 4)
    rng = random.Random(1)
    ids = sorted(rng.sample(range(10**6), 150) + [10**17, -5, 10**17 + 1])
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(5)
    df = df.withColumn("bucket", simhash.ordered_buckets(df, "doc_id", 4))
    got = {r.doc_id: r.next_doc_id for r in simhash.following(df, ["doc_id"], ["doc_id"]).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(128), d)) for b in base for d in (1, 2, 3, 4, 9)]
    hexed = [f"{p:032x}" for p in prints]
    df = spark.createDataFrame([(h,) for h in hexed + hexed[:5] + [None]], "fingerprint string")
    got = {(r.query, r.fingerprint, r.distance) for r in simhash.near_fingerprints(df, df.limit(1000)).collect()}
    want = {(a, b, d) for a in set(hexed) for b in set(hexed) if (d := bin(int(a, 16) ^ int(b, 16)).count("1")) <= 3}
    assert got == want
