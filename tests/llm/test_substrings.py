"""Repeated substrings over words (factors) and bytes (transform) against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from llmcases import ODD, make_docs, words  # noqa: F401

from loomwork.llm import bwt, rlz, routing


def low(i):
    return -(1 << 63) if i is None else i


def brute(rows, length, units, join):
    first = {}
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - length + 1):
            key = tuple(u[k : k + length])
            first[key] = min(first.get(key, low(i)), low(i))
    out = []
    for i, t in rows:
        u = units(t)
        gone = set()
        for k in range(len(u) - length + 1):
            if first[tuple(u[k : k + length])] < low(i):
                gone.update(range(k, k + length))
        spans = sum(1 for k in gone if k - 1 not in gone)
        out.append((i, len(u), len(gone), spans, hashlib.sha256(join([x for k, x in enumerate(u) if k not in gone])).hexdigest()))
    return sorted(out, key=str)


def by_words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def mixed_rows():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)] + ["é", "ß", "the", "of"]
    base = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(base).split()
            k = rng.randint(0, 40)
            parts += [" ".join(b[k : k + rng.randint(5, 30)]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))]
        rows.append((i * 3, " ".join(parts)))
    return rows + [(500, rows[4][1]), (501, rows[4][1]), (2, rows[9][1])]


@pytest.mark.parametrize("rows", [mixed_rows(), ODD, []], ids=["mixed", "odd", "none"])
def test_words(make_docs, rows):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rlz.dedup_substrings(make_docs(rows)).collect()]
    want = [(a, b, c, e) for a, b, c, _, e in brute(rows, 13, by_words, b" ".join)]
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("rows", [mixed_rows(), ODD, []], ids=["mixed", "odd", "none"])
def test_bytes(make_docs, rows):
    got = [tuple(r)[:5] for r in bwt.dedup_bytes(make_docs(rows)).collect()]
    assert sorted(got, key=str) == brute(rows, 50, lambda t: list((t or "").encode()), bytes)


def test_other_columns_and_groups(spark, make_docs, monkeypatch):
    """Many small groups and columns that clash with inner names change nothing."""
    monkeypatch.setattr(routing, "GROUP_BYTES", 1)
    rows = mixed_rows()
    docs = make_docs(rows).selectExpr("doc_id", "text", "1 AS g", "2 AS th", "3 AS bucket").limit(1000)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rlz.dedup_substrings(docs).collect()]
    assert sorted(got, key=str) == [(a, b, c, e) for a, b, c, _, e in brute(rows, 13, by_words, b" ".join)]


@pytest.mark.parametrize("resolve", [bwt.resolve, rlz.parse])
@pytest.mark.parametrize("length", [3, 5, 8, 11])
def test_one_bucket(resolve, length):
    rng = np.random.default_rng(length)
    strings = [rng.integers(97, 99 + length // 4, rng.integers(length, 40)).astype(np.uint8) for _ in range(200)] + [np.full(36, 255, np.uint8)] * 2
    docs = rng.integers(0, 30, len(strings))
    first = {}
    for s, d in zip(strings, docs):
        for i in range(len(s) - length + 1):
            first[s[i : i + length].tobytes()] = min(first.get(s[i : i + length].tobytes(), 99), d)
    want = [(q, i) for q, (s, d) in enumerate(zip(strings, docs)) for i in range(len(s) - length + 1) if first[s[i : i + length].tobytes()] < d]
    flat = np.concatenate(strings)
    seg, a, b = resolve(flat if resolve is bwt.resolve else flat.astype(np.uint64), np.array([len(s) for s in strings]), docs, length)
    assert [(int(q), i) for q, x, y in zip(seg, a, b) for i in range(x, y + 1)] == want


def test_transform_is_that_of_sorted_suffixes(tmp_path):
    rng = np.random.default_rng(5)
    strings = [rng.integers(1, 4, rng.integers(0, 20)).astype(np.uint8) for _ in range(40)]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    got = bwt.build(np.concatenate(strings), offs, str(tmp_path))
    rows = sorted(([*(int(x) + 100 for x in s[i:]), k], int(s[i - 1]) if i else 0) for k, s in enumerate(strings) for i in range(len(s) + 1))
    assert got.tolist() == [x for _, x in rows]


@pytest.mark.parametrize("chunk", [1, 3, 50, 1 << 18])
def test_common_prefixes_of_neighbouring_rows(tmp_path, monkeypatch, chunk):
    """The files are read in chunks of any size; their prefixes are those of the sorted suffixes."""
    monkeypatch.setattr(bwt, "CHUNK", chunk)
    for sigma in (2, 3, 6):
        rng = np.random.default_rng(sigma)
        strings = [rng.integers(1, sigma, rng.integers(0, 30)).astype(np.uint8) for _ in range(25)] + [np.full(9, 1, np.uint8)] * 2
        offs = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        got, shared = bwt.transform(np.concatenate(strings), offs, str(tmp_path))
        rows = sorted(([*(int(x) + 100 for x in s[i:]), k], int(s[i - 1]) if i else 0) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert got.tolist() == [x for _, x in rows]
        common = [next((i for i, (x, y) in enumerate(zip(a[:-1], b[:-1])) if x != y), min(len(a), len(b)) - 1) for (a, _), (b, _) in zip(rows, rows[1:])]
        assert shared.tolist() == [0, *common]


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_whose_polynomial_hashes_collide(make_docs):
    """Two words that no polynomial modulo 2^64 tells apart are two words, in the anchors and to the end."""
    a, b = thue_morse(11)
    head = words(12, 4)
    got = {r.doc_id: r.n_removed for r in rlz.dedup_substrings(make_docs([(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {b}")])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_equal_hashes_are_told_apart_by_bytes():
    from loomwork.llm import kernel

    many = [*thue_morse(11), *(f"w{i % 90}" * (i % 23 + 1) for i in range(500)), "x" * 32, "x" * 33, "x" * 33]
    data = np.frombuffer(" ".join(many).encode(), np.uint8)
    starts, ends, _ = kernel.words(data, np.array([0, len(data)]))
    for h in (kernel.hashes(data, starts, ends), np.zeros(len(starts), np.uint64)):
        number = kernel.told_apart(data, starts, ends, h).tolist()
        assert len(set(zip(many, number))) == len(set(many)) == len(set(number))


def test_long_repeat_across_texts(make_docs):
    a, b, shared = words(200, 1), words(300, 2), words(60, 3)
    got = {r.doc_id: r for r in rlz.dedup_substrings(make_docs([(1, f"{a} {shared}"), (2, f"{b[:700]} {shared} {b[700:]}")])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 60 and "w3x" not in got[2].kept_text
