"""Every operator and every stage on odd tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from llmcases import ODD, make_docs, words  # noqa: F401
from pyspark.sql import functions as F

from loomwork.llm import bwt, decontaminate, langid, linedup, mixing, probminhash, quality, rlz, simhash, warc

#: Names of columns inside the operators, and of their results.
CLASH = "__text __id __th __u __d row id th no_id copy copies size target score lang_pred h first times gone parts kept n n_lines bucket g bin rank last edge doc key".split()
LONG = "long " + words(150_000, 77) + "\n" + "line\n" * 3000
ROWS = [*ODD, (20, LONG), (21, LONG), (21, LONG), (22, "x" * 1_000_000)]


def clashing(docs):
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH if c not in docs.columns))


def trained(spark):
    rows = [(i, words(30, i)) for i in range(60)] + [(i, "%%% " * 40 + words(5, i)) for i in range(60, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return quality.train(docs, spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id long, quality int"))


def bench(spark):
    return spark.createDataFrame([(1, words(30, 555)), (None, None), (2, "")], "item_id long, text string")


OPERATORS = {
    "simhash": lambda spark, docs: simhash.edited_fingerprints(docs),
    "leaks": lambda spark, docs: decontaminate.leaks(docs, bench(spark)),
    "clean": lambda spark, docs: decontaminate.clean(docs, bench(spark)),
    "rlz": lambda spark, docs: rlz.dedup_substrings(docs),
    "lines": lambda spark, docs: linedup.dedup_lines(docs),
    "mix": lambda spark, docs: mixing.mix(docs),
    "near": lambda spark, docs: probminhash.near_classes(docs),
    "lang": lambda spark, docs: langid.predict(docs, langid.train(docs.select("text", "lang"))),
    "quality": lambda spark, docs: quality.score(docs, trained(spark)),
    "bwt": lambda spark, docs: bwt.dedup_bytes(docs),
}
#: Operators that keep the columns of docs, but for results of their own.
KEEPING = {"clean": (), "lines": ("n_lines", "n_lines_removed"), "mix": ("size", "source_size", "target", "copies"), "lang": ("lang_pred", "score"), "quality": ("score",)}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(spark, make_docs, name):
    docs = make_docs(ROWS)
    plain = OPERATORS[name](spark, docs).collect()
    odd = OPERATORS[name](spark, clashing(docs)).cache()
    assert len(plain) == (0 if name == "leaks" else len(ROWS))
    columns = [c for c in (plain[0].__fields__ if plain else odd.columns) if c not in ("lang", "source", "n_chars") or name not in KEEPING]
    assert sorted(str(tuple(r)) for r in odd.select(columns).collect()) == sorted(str(tuple(r[c] for c in columns)) for r in plain)
    if name in KEEPING:
        kept = [c for c in CLASH if c not in KEEPING[name]]
        assert all(odd.schema.names.count(c) == 1 for c in odd.columns)
        assert {tuple(r) for r in odd.select(kept).distinct().collect()} == {tuple(f"own {c}" for c in kept)}
    odd.unpersist()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_on_nothing(spark, make_docs, name):
    assert OPERATORS[name](spark, clashing(make_docs([]))).collect() == []
    null = make_docs([(None, None)])
    assert len(OPERATORS[name](spark, null).collect()) == (name != "leaks")


def test_archives_of_odd_pages(spark, tmp_path):
    big = "é" * 600_000
    rows = [(None, None, None), (None, "http://x", big), (1, "", ""), (1, "", ""), (2, "http://a b", big), (3, "http://c", big), (3, "http://c", big), (4, "http://d", "x" * 999), (5, "http://d", "x" * 999), (6, "http://e", "y" * 1000), (7, "http://e", "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("own").alias(c) for c in ("digest", "kept", "kept_id", "kept_url", "n", "value")))
    warc.write_archives(pages, str(tmp_path / "w"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()), key=str)
    refers = {(2, big): 3, (6, "y" * 1000): 7}
    assert got == sorted(((i, len((h or "").encode()), "revisit" if (i, h) in refers else "response", refers.get((i, h))) for i, _, h in rows), key=str)
    warc.write_archives(pages.where("false"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []


STAGES = ["quality_stage", "line_stage", "near_stage", "benchmark_stage", "mix_stage"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(9)] + [(None, 1, 0), (20, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    bench(spark).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, make_docs, folder, name):
    pipeline = pytest.importorskip("corpus_pipeline")
    stage = getattr(pipeline, name)
    docs = clashing(make_docs(ROWS))
    out = stage(spark, docs, folder)
    rows = out.collect()
    own = [c for c in CLASH if c != "copy"]
    assert out.columns == ([c for c in docs.columns if c != "copy"] + ["copy"] if name == "mix_stage" else docs.columns)
    assert {tuple(r[c] for c in own) for r in rows} <= {tuple(f"own {c}" for c in own)}
    assert stage(spark, clashing(make_docs([])), folder).collect() == []
    got = sorted(((r.doc_id, r.text) for r in rows), key=str)
    if name in ("line_stage", "benchmark_stage"):
        assert len(got) == len(ROWS)
    if name == "benchmark_stage":
        assert got == sorted(ROWS, key=str)
    if name == "near_stage":  # copies go, repeated rows are one, other texts under a kept id stay
        assert got == sorted([(i, t) for i, t in dict.fromkeys(ROWS) if i not in (5, 8, 21) and (i, t[:4] if t else t) != (10, "same")], key=str)


def test_near_stage_keeps_different_texts_of_one_id(spark, make_docs, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = (words(50, k) for k in (1, 2, 3))
    docs = make_docs([(1, a), (1, b), (1, b), (2, a), (3, c), (None, c), (None, c)])
    for limit in (pipeline.BROADCAST_IDS, 0):
        pipeline.BROADCAST_IDS, old = limit, pipeline.BROADCAST_IDS
        try:
            got = [(r.doc_id, r.text) for r in pipeline.near_stage(spark, docs, folder).collect()]
        finally:
            pipeline.BROADCAST_IDS = old
        assert sorted(got, key=str) == sorted([(2, a), (1, b), (3, c), (None, c), (None, c)], key=str)
