"""Decontamination, language and quality against plain versions written from their definitions."""

import math
import random
import re

import numpy as np
import pytest
from llmcases import make_docs, words  # noqa: F401

from loomwork.llm import decontaminate, langid, quality, simhash

# --- Decontamination: every diagonal of every pair of document and item, token by token. ---

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def plain_tokens(text):
    """(kind, text in lower case, opener) of each token; kinds: n number, N name, u unit, w word."""
    found = list(WORD.finditer(text))
    out, k = [], 0
    while k < len(found):
        m = found[k]
        last = k
        if m.group()[0].isdigit() and m.group()[0].isascii():
            while last + 1 < len(found) and found[last + 1].start() == found[last].end() + 1 and text[found[last].end()] in ",." and found[last + 1].group()[0].isascii() and found[last + 1].group()[0].isdigit():
                last += 1
        raw = text[m.start() : found[last].end()]
        low = raw.lower()
        opens = k == 0 or re.search(r"[\n!.:?]", text[found[k - 1].end() : m.start()]) is not None
        if raw[0].isdigit():
            kind = "n"
        elif out and out[-1][0] == "n" and low in decontaminate.UNITS:
            kind = "u"
        else:
            kind = "N" if raw[0].isupper() and not opens else "w"
        out.append((kind, low, kind == "w" and raw[0].isupper() and opens))
        k = last + 1
    return out


def brute(text, item):
    """The longest consistent match of two texts, as (tokens, slots, slots changed), or None."""
    a, b = plain_tokens(text), plain_tokens(item)
    width, least, best = min(8, len(b)), min(13, len(b)), None
    if len(b) < 3:
        return None
    name = lambda t: t[0] == "N" or t[2]
    for off in range(-len(b) + 1, len(a)):
        places = [p for p in range(max(0, off), min(len(a), off + len(b)))]
        pair = [(a[p], b[p - off]) for p in places]
        same = [x[1] == y[1] for x, y in pair]
        agree = [s or (x[0] == y[0] and y[0] in "nu") or (name(x) and name(y)) for s, (x, y) in zip(same, pair)]
        literal = [s and (y[0] in "wN") for s, (_, y) in zip(same, pair)]
        covered = [False] * len(pair)
        seeded = False
        for p in range(len(pair) - width + 1):
            if all(agree[p : p + width]) and (sum(literal[p : p + width]) >= min(4, width) or all(same[p : p + width])):
                covered[p : p + width] = [True] * width
                seeded = True
        if not seeded:
            continue
        p = 0
        while p < len(pair):
            if not covered[p]:
                p += 1
                continue
            end = p
            while end < len(pair) and covered[end]:
                end += 1
            # All stretches of the run in which each value of the item stands for one value.
            for left in range(p, end):
                seen = {}
                right = left
                while right < end:
                    x, y = pair[right]
                    if y[0] != "w" or y[2]:
                        key = ("N" if name(y) else y[0], y[1])
                        if seen.setdefault(key, x[1]) != x[1]:
                            break
                    right += 1
                if right - left >= least:
                    slots = [q for q in range(left, right) if pair[q][1][0] != "w" or (pair[q][1][2] and not same[q])]
                    found = (right - left, len(slots), sum(not same[q] for q in slots))
                    best = max(best or found, found)
            p = end
    return best


def leaky_corpus():
    rng = random.Random(12)
    names = ["Alice", "Bob", "Carol", "Dan", "Eve", "Élan"]
    shapes = [
        "{n} has {x} apples and {y} pears. How many fruits are in there?",
        "A farmer named {n} sells {x} kg of apples and then {n} buys {y} more boxes from her neighbour {m} for {z} dollars in the old market.",
        "In the year {x} the town of {n} had {y} houses, {z} of which were built by {m} before the great fire came and took them all.",
        "Sort {x}, {y}, {z} now",
        "Why do rivers bend so often near their mouths?",
    ]
    fill = lambda shape: shape.format(n=rng.choice(names), m=rng.choice(names), x=rng.randint(1, 9), y=rng.choice(["3", "4,000", "2.5"]), z=rng.randint(1, 9))
    items = [(k, fill(s)) for k, s in enumerate(shapes)] + [(9, words(40, 5)), (10, "it is"), (11, f"{words(12, 6)} {rng.randint(1, 9)} km then {words(12, 7)}")]
    docs = []
    for i in range(60):
        text = fill(rng.choice(shapes)) if i % 2 else rng.choice(items)[1]
        tokens = text.split(" ")
        if rng.random() < 0.4:
            k = rng.randrange(len(tokens))
            tokens[k] = rng.choice(["Zoe", "7", "word", tokens[k].upper()])
        text = " ".join(tokens)
        text = rng.choice([text, text, text.upper(), text.lower(), text.title()])
        docs.append((i, f"{words(rng.randint(0, 9), 100 + i)}{rng.choice(['. ', ' ', ': '])}{text} {words(rng.randint(0, 9), 200 + i)}"))
    return docs, items


@pytest.mark.parametrize("limit", [decontaminate.PROBE_CHARACTERS, 0], ids=["probed", "joined"])
def test_leaks_against_every_diagonal(spark, make_docs, monkeypatch, limit):
    """What windows find is what a walk over all diagonals finds, and of the same length."""
    monkeypatch.setattr(decontaminate, "PROBE_CHARACTERS", limit)
    monkeypatch.setattr(decontaminate, "KEY_DOCS", 5)
    docs, items = leaky_corpus()
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_slots, r.n_changed) for r in decontaminate.leaks(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k): found for i, t in docs for k, item in items if (found := brute(t, item))}
    # Slots on a part's edge may be told in more than one way at one length.
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 40
    clean = {r.doc_id for r in decontaminate.clean(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}


@pytest.mark.parametrize("limit", [decontaminate.PROBE_CHARACTERS, 0], ids=["probed", "joined"])
def test_planted_leaks(spark, make_docs, monkeypatch, limit):
    """One inconsistent slot before a long verbatim passage, names that open a sentence, and copies in capitals."""
    monkeypatch.setattr(decontaminate, "PROBE_CHARACTERS", limit)
    long = f"Alice went out and Alice came back with {words(70, 3)}"
    short = "Alice has 3 apples and 5 pears. How many fruits are in there?"
    items = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    docs = make_docs([(1, long.replace("Alice", "Carol", 1)), (2, short.replace("Alice", "Bob").replace("3", "4").replace("5", "9")), (3, short.upper()), (4, long.upper()), (5, words(90, 8)), (6, "When there are 3 apples and 5 pears, how many are left?")])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(1, 1), (2, 2), (3, 2), (4, 1)]


# --- Language: n-grams of characters by their definition. ---


def plain_cells(text):
    """The cell of every 1-, 2- and 3-gram of the folded characters."""
    points = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
    out = []
    for n in (1, 2, 3):
        for k in range(len(points) - n + 1):
            h = 0
            for p in points[k : k + n]:
                h = ((h ^ p) * 0x9E3779B1) % (1 << 32)
                # Orders are hashed from the shorter ones, each mixed once it is counted.
                h ^= h >> 15
            out.append(((h * 0x85EBCA77) % (1 << 32)) >> (32 - 15))
    return sorted(out)


@pytest.mark.parametrize("fold", [1, 4])
def test_languages_by_hand(make_docs, monkeypatch, fold):
    monkeypatch.setattr(langid, "MODEL_BYTES", 2 * langid.CELLS * 4 if fold == 1 else langid.CELLS * 4)
    rng = random.Random(3)
    letters = {"aa": "abcdé", "bb": "dexyzß Ж"}
    rows = [(i, "".join(rng.choices(letters[x := "ab"[i % 2] * 2] + " .1", k=rng.randint(1, 60))), x) for i in range(30)]
    model = langid.train(make_docs(rows))
    assert len(model.table) * fold == langid.CELLS
    counts = {x: np.full(langid.CELLS // fold, langid.SMOOTHING) for x in letters}
    for _, t, x in rows:
        for c in plain_cells(t):
            counts[x][c // fold] += 1
    for r in langid.predict(make_docs(rows), model).collect():
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        total = {x: math.log(0.5) + sum(math.log(counts[x][c // fold] / counts[x].sum()) for c in plain_cells(r.text)) for x in letters}
        best = max(total, key=total.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(v - total[best]) for v in total.values())) < 1e-4


# --- Quality: sizes by plain calls of zstandard. ---


def test_quality_scores_by_hand(spark, make_docs):
    import zstandard

    rng = random.Random(5)
    rows = [(i, words(rng.randint(20, 400), i) if i % 3 else " | ".join(words(rng.randint(20, 200), i).split())) for i in range(150)] + [(500, ""), (501, None)]
    docs = make_docs(rows)
    model = quality.train(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)], "doc_id long, quality int"))

    def size(dictionary, text):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(text[k : k + quality.CHUNK])) - 5 for k in range(0, len(text), quality.CHUNK))

    for r in quality.score(docs, model).collect():
        text = (r.text or "").encode()
        good, bad = (min(size(d, text) for d in kinds) for kinds in (model.good_kinds, model.bad_kinds))
        bare, n = len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False).compress(text)), len(text)
        d, share, log = (bad - good) / max(good, bad, 1), bare / max(n, 1), math.log1p(n)
        x = [1, d, min(good, bad) / max(n, 1), share, log, d * log, share * log, share**2, d * abs(d)]
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights))))))) < 1e-3


# --- Fingerprints near each other, over all rows. ---


def test_near_fingerprints_are_counted(spark, make_docs):
    rng = random.Random(7)
    base = words(400, 1).split()
    rows = []
    for i in range(0, 300, 5):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 40])):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (7, rows[0][1]), (None, rows[0][1]), (350, None), (400, "")]
    got = simhash.edited_fingerprints(make_docs(rows)).select("doc_id", "fingerprint", "n_near").collect()
    prints = [int(r.fingerprint, 16) for r in got]
    for r in got:
        near = sum(bin(p ^ int(r.fingerprint, 16)).count("1") <= 3 for p in prints)
        assert r.n_near == (near if r.doc_id is not None and r.doc_id % 50 == 0 else None)
    assert max(r.n_near or 0 for r in got) > 3
