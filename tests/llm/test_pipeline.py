"""The five stages on a small corpus, each decision held against what was planted."""

import random

import pytest
from llmcases import make_docs, words  # noqa: F401


def corpus():
    rng = random.Random(5)
    good = lambda k: "\n".join(words(12, 100 * k + j) for j in range(rng.randint(3, 9)))
    rows = [(i, good(i)) for i in range(80)]
    rows += [(i, " ".join(f"{w}%%%" for w in words(60, i).split())) for i in range(80, 110)]  # bad
    w = words(150, 999).split()
    rows += [(200, " ".join(w)), (201, " ".join(["edited", *w[1:]])), (202, words(40, 7) + ". " + words(30, 555))]
    shared = "\n".join(f"shared line {k} {words(6, 4000 + k)}" for k in range(12))
    rows += [(300, f"{good(300)}\n{shared}"), (301, f"{good(301)}\n{shared}")]
    return [(i, t, "en", f"s{i % 3}") for i, t in rows]


def test_pipeline(spark, make_docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus()
    folder = str(tmp_path)
    docs = make_docs(rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 80 <= i < 110), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, words(30, 555))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, kept, folder).write.parquet(f"{folder}/{k}")
        kept = spark.read.parquet(f"{folder}/{k}")
        seen.append({r.doc_id: r for r in kept.collect()})
        if k < 4:
            assert kept.columns == docs.columns
    ids = [set(x) for x in seen]
    assert ids[0] == {i for i, *_ in rows if not 80 <= i < 110}
    assert ids[1] == ids[0] and "shared line 5" in seen[1][300].text and len(seen[1][301].text) < len(dict((r[0], r[1]) for r in rows)[301])
    assert all(r.n_chars == len(r.text) for r in seen[1].values())
    assert ids[2] == ids[1] - {201} and ids[3] == ids[2] - {202}
    mixed = kept.collect()
    assert {r.doc_id for r in mixed} <= ids[3] and max(r.copy for r in mixed) <= 3
    # Weights 5, 2, 1 by source; a target stops at three times its source.
    size = {s: sum(len(r.text.split()) for r in seen[3].values() if r.source == s) for s in ("s0", "s1", "s2")}
    taken = {s: sum(len(r.text.split()) for r in mixed if r.source == s) for s in size}
    total = sum(size.values())
    for s, w in zip(size, (5, 2, 1)):
        assert abs(taken[s] - total * w / 8) <= 0.05 * total
    assert pipeline.run(spark, folder).count() == len(mixed)
