"""A training corpus in five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage works on all rows that the one before kept, and returns the
columns of documents; the last one repeats a document for each copy that the
mix takes of it and adds `copy`, 1 and up. Null and empty texts, very long
ones, repeated rows and empty tables go through all of them (what each stage
does to them is in its docstring); other columns, whatever their names, come
out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontaminate, langid, linedup, mixing, probminhash, quality
from loomwork.llm.session import cut, remove, shared_folder

#: Ids that go to every task at most; beyond it documents are shuffled to meet them.
BROADCAST_IDS = 1_000_000


def _held(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that a stage reads, and each row as it is, where no result can take the place of one of its columns."""
    return docs.select(F.struct(*docs.columns).alias("row"), *columns)


def _rows(held: DataFrame, docs: DataFrame, **new) -> DataFrame:
    return held.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the compression classifier, trained on the labels of docs, scores as good.

    Rows are judged by their text alone, null as empty: equal texts go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.held_out(F.col("doc_id"), 5, 0))
    # Columns go to Python and back once, under names that none of the result's can take the place of.
    names = ["text" if c.lower() == "text" else f"c{k}" for k, c in enumerate(docs.columns)]
    scored = quality.score(docs.toDF(*names), quality.train(docs, labels))
    return scored.where(F.col("score") >= quality.KEEP).select(*(F.col(own).alias(c) for own, c in zip(names, docs.columns, strict=True)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks of lines out; n_chars follows the text. Every row stays, null texts as they are; repeated rows stay equal."""
    out = linedup.dedup_lines(_held(docs, "doc_id", "text"))
    n_chars = {"n_chars": F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _rows(out, docs, text=F.col("text"), **n_chars)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, that with the smallest doc_id.

    Rows of a null doc_id are classes of their own and stay, as do wordless
    texts. Different texts under one doc_id are documents of their own, each
    judged by its text; they come after all others of their class. Of repeated
    rows one stays, with the least values in its other columns.
    """
    held = _held(docs, F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("key", F.col("id"))
    # Ids that have several texts, or one text in several rows: mostly none.
    texts = held.where("id is not null").groupBy("id", F.xxhash64("text").alias("th")).agg(F.count("*").alias("rows"))
    texts = cut(texts.groupBy("id").agg(F.count("*").alias("texts"), F.max("rows").alias("rows")).where("texts > 1 or rows > 1"), held.count())
    several = texts.where("texts > 1").select("id", F.lit(True).alias("several"))
    if several.limit(1).count():
        # Numbers above those of usual ids, told by id and text.
        own = F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        held = held.join(_sent(several), "id", "left").withColumn("key", F.when(F.col("several"), own).otherwise(F.col("id"))).drop("several")
    classes = cut(probminhash.near_classes(held.select(F.col("key").alias("doc_id"), "text")).where("doc_id != class_id").select(F.col("doc_id").alias("key")).distinct(), held.count())
    out = held.join(_sent(classes), "key", "left_anti")
    many = texts.where("rows > 1").select("id")
    if not many.limit(1).count():
        return _rows(out, docs)
    many, rest = _sent(many), [c for c in docs.columns if c not in ("doc_id", "text")]
    # Repeated rows are folded before they are shuffled.
    once = out.join(many, "id", "left_semi").groupBy(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).agg(F.min(F.struct(F.lit(0).alias("none"), *(F.col("row")[c].alias(c) for c in rest))).alias("rest"))
    once = once.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns))
    return _rows(out.join(many, "id", "left_anti"), docs).unionByName(once)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose text holds a passage of the benchmark, re-parameterised or not; null and empty texts hold none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample sources to their target weights; a row for each copy taken, numbered in `copy` (a column of that name is replaced).

    Texts without words count nothing towards a target; they are taken as others of their source and rank are.
    """
    taken = mixing.mix(_held(docs, "doc_id", "source", "text")).where("copies > 0")
    rows = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "copy"]
    return taken.select(*rows, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_stage), ("benchmark decontamination", benchmark_stage), ("mixing sources", mix_stage)]

#: Trained, hashed and iterated stages can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again; a stage's folder goes once the next is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last:
            remove(spark, last)
        last = folder
    return STAGES[-1][1](spark, docs, sf_dir)
