"""Language and quality: held-out accuracy and odd input."""

import random

from llmcases import ODD, make_docs  # noqa: F401

from loomwork.llm import langid, quality

SYLLABLES = {"aa": "ka to mi ra su ne".split(), "bb": "ell oin ére urt ässe oo".split(), "cc": "штр жу ва ков лен".split()}


def text_in(lang, rng, n=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def lang_rows(n=240):
    rng = random.Random(1)
    return [(i, text_in(lang := rng.choice(sorted(SYLLABLES)), rng, rng.randint(3, 40)), lang) for i in range(n)]


def test_languages(make_docs):
    rows = lang_rows()
    docs = make_docs(rows)
    model = langid.train(docs.where("doc_id % 2 = 0"))
    got = langid.predict(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts(make_docs):
    model = langid.train(make_docs(lang_rows(60)))
    got = langid.predict(make_docs([*ODD, (70, "123 ... \U0001f600"), (71, "\U00010400\U00010428")]), model).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)


def test_nothing_learned(make_docs):
    model = langid.train(make_docs([(1, None, "aa"), (2, "text", None)]))
    assert [r.lang_pred for r in langid.predict(make_docs([(1, "abc")]), model).collect()] == ["und"]
    assert langid.predict(make_docs([]), model).collect() == []


def test_scores_match_a_plain_sum(make_docs):
    """Naive Bayes by hand over the same cells."""
    import numpy as np

    rows = lang_rows(40)
    model = langid.train(make_docs(rows))
    counts = {x: np.full(langid.CELLS, langid.SMOOTHING) for x in model.langs}
    docs = dict.fromkeys(model.langs, 0)

    def grams(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [c for cell, _ in langid.cells(*langid.characters(data, np.array([0, len(data)]))) for c in cell.tolist()]

    for _, text, lang in rows:
        docs[lang] += 1
        for c in grams(text):
            counts[lang][c] += 1
    for r in langid.predict(make_docs(rows[:5]), model).collect():
        total = {x: np.log(docs[x] / len(rows)) + sum(np.log(counts[x][c] / counts[x].sum()) for c in grams(r.text)) for x in model.langs}
        best = max(total, key=total.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(np.exp(v - total[best]) for v in total.values())) < 1e-4


def quality_rows(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = text_in("aa", rng, rng.randint(5, 80))
        if not good:
            text = " ".join(w + "%%%" for w in text.split()) if rng.random() < 0.5 else " ".join(w for w in text.split()[:8] for _ in range(12))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark, make_docs):
    rows, labels = quality_rows()
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(got[i], q) for i, q, _ in labels if i % 2]
    assert sum((s >= quality.KEEP) == bool(q) for s, q in held) / len(held) > 0.95
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(5), quality.train(docs.repartition(2), marks.where("doc_id % 2 = 0"))).collect()}
    assert again == got


def test_quality_of_odd_texts(spark, make_docs):
    rows, labels = quality_rows(80)
    schema = "doc_id long, quality int, toxic int"
    model = quality.train(make_docs(rows), spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], schema))
    got = quality.score(make_docs(ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    alone = quality.train(make_docs(rows), spark.createDataFrame([(1, 1, 0), (2, 1, 0)], schema))
    assert {r.score for r in quality.score(make_docs(ODD), alone).collect()} == {1.0}
    none = quality.train(make_docs([]), spark.createDataFrame([], schema))
    assert {r.score for r in quality.score(make_docs(ODD), none).collect()} == {0.5} and quality.score(make_docs([]), none).collect() == []


def test_quality_is_fitted_on_whole_texts(spark, make_docs):
    """Long texts that are alike up to SAMPLE_BYTES and beyond it good or bad."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(120):
        tail = text_in("aa", rng, 1500) if i % 3 else " ".join(w + "%%%" for w in text_in("aa", rng, 1000).split())
        rows.append((i, text_in("bb", rng, 2500)[: quality.SAMPLE_BYTES] + " " + tail))
        labels.append((i, int(i % 3 > 0), 0))
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= quality.KEEP) == bool(q) for i, q, _ in labels if i % 2)
    assert b"%%%" in model.bad


def test_pieces():
    text = bytes(range(256)) * 100
    assert quality._pieces(text[:8000]) == text[:8000]
    cut = quality._pieces(text)
    assert len(cut) == quality.SAMPLE_BYTES and cut[:1000] == text[:1000] and cut[-1000:] == text[-1000:]
