"""Line chunks and source mixing against brute force."""

import hashlib
import random

import duckdb
import pytest
from llmcases import ODD, make_docs, words  # noqa: F401
from pyspark.sql import functions as F

from loomwork.llm import linedup, mixing, queries


def chunked(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, now = [], []
    for k, x in enumerate(lines):
        now.append(x)
        if k == len(lines) - 1 or k and (h[k - 1] * 31 + h[k]) % linedup.DIVISOR == 0:
            out.append(now)
            now = []
    return out


def brute(rows):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept, gone = [], 0
        for k, c in enumerate(chunked(t)):
            text = "\n".join(c)
            if len(c) > 1 and seen.setdefault(text, (i, t, k)) != (i, t, k):
                gone += len(c)
            else:
                kept.append(text)
        out.append((i, "\n".join(kept) if gone else t, len(t.split("\n")), gone))
    return sorted(out, key=str)


def lined_rows():
    rng = random.Random(8)
    shared = [[f"shared {g} line {k}" for k in range(rng.randint(2, 9))] for g in range(6)]
    rows = []
    for i in range(50):
        lines = [f"own {i} {k} {rng.random()}" for k in range(rng.randint(0, 5))]
        for _ in range(rng.randint(0, 3)):
            lines += rng.choice(shared) + [f"gap {rng.random()}"]
        rows.append((i * 5, "\n".join(lines)))
    return rows + [(700, rows[3][1]), (700, rows[3][1]), (701, "\n \n\n"), (702, "\n \n\n"), (703, "x\n" * 3000)]


@pytest.mark.parametrize("rows", [lined_rows(), ODD, []], ids=["lines", "odd", "none"])
def test_lines(make_docs, rows):
    docs = make_docs(rows).withColumn("gone", F.lit("kept")).withColumn("n_lines", F.lit("replaced"))
    out = linedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "n_lines", "n_lines_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_lines_removed) for r in out.collect()), key=str)
    assert got == brute(rows)


def mix_rows():
    rng = random.Random(9)
    sources = ["a", "b", "c", "d", "é", None]
    return [(i, words(rng.randint(0, 60), i), "en", sources[min(5, int(rng.expovariate(0.7)))]) for i in range(400)] + [(7, words(9, 3), "en", "a"), (None, None, "en", "only empty")]


@pytest.mark.parametrize("rows", [mix_rows(), [(*r[:2], "en", "s") for r in ODD], []], ids=["mix", "odd", "none"])
def test_mix_against_sql(spark, make_docs, rows):
    docs = make_docs(rows)
    con = duckdb.connect()
    frame = docs.toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")).collect()
    again = mixing.mix(docs.repartition(7)).select("doc_id", "copies").collect()
    plain = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    unique = {i for i in (r[0] for r in rows) if [r[0] for r in rows].count(i) == 1}
    want = con.execute(queries.ORACLE_SQL["op5_pareto_mix"]).fetchall()
    assert sorted(plain(r) for r in got if r[0] in unique) == sorted(plain(r) for r in want if r[0] in unique)
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(docs).select("doc_id", "copies").collect()))


def test_favour_and_targets(make_docs):
    rows = [(i, words(10, i), "en", "ab"[i % 2]) for i in range(600)]
    out = mixing.mix(make_docs(rows), favour=F.when(F.col("doc_id") < 300, 3.0).otherwise(1.0)).toPandas()
    taken = out.assign(taken=out["size"] * out["copies"]).groupby("source")["taken"].sum()
    target = out.groupby("source")["target"].first()
    assert (abs(taken - target) <= 10).all() and abs(target.sum() - 6000) < 1e-6
    b = out[out.source == "b"]
    assert b[b.doc_id < 300].copies.mean() > 2 * b[b.doc_id >= 300].copies.mean()
