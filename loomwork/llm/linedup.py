"""Line dedup over content-defined chunks of lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut
from .skew import join_unique

#: A chunk ends behind a line where the rolling hash is divisible by this: its mean number of lines.
DIVISOR = 3


def line_hash(line: Column) -> Column:
    """32 bits of MD5, which other engines have too."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """The chunks of a text as an array of (first line, lines, text).

    The rolling hash at a line covers that line and the one before, so a
    boundary moves with its two lines wherever they stand in a document.
    """
    lines = F.split(text, "\n", -1)

    def cut_at(held: Column) -> Column:
        lines, hashes = held["lines"], held["hashes"]
        n = F.size(lines)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ((i > 1) & ((F.get(hashes, i - 2) * 31 + F.get(hashes, i - 1)) % divisor == 0)))
        return F.transform(ends, lambda end, k: _chunk(lines, F.when(k == 0, 0).otherwise(F.get(ends, k - 1)), end))

    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), F.transform(lines, line_hash).alias("hashes"))), cut_at), 0)


def _chunk(lines: Column, begin: Column, end: Column) -> Column:
    return F.struct((begin + 1).alias("first"), (end - begin).alias("n"), F.array_join(F.slice(lines, begin + 1, end - begin), "\n").alias("text"))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """docs (doc_id, text, ...) without repeated multi-line chunks; adds n_lines and n_lines_removed.

    Of the chunks of two lines or more that are equal byte for byte anywhere,
    the first stays: in the smallest doc_id, there the earliest. Blank lines
    are lines like others. A null text stays null with no lines, an empty one
    has one blank line; texts of any length are cut whole. A null doc_id comes
    before all others. Ties and equal rows are treated alike. Texts from which
    nothing is removed stay as they are; an empty table gives an empty one.
    Columns named like the two new ones are replaced; others may have any name.

    Hashes propose repeats and are written once; only the texts of proposed
    chunks are shuffled and grouped by their bytes. Frequent chunks are
    counted before any shuffle and joined back without one.
    """
    docs = docs.drop("n_lines", "n_lines_removed")
    key = ["no_id", "id", "th"]
    # A row's own columns stay in one struct, so that no inner name meets one of them.
    held = docs.select(F.struct(*docs.columns).alias("row"))
    held = held.select(F.col("row.doc_id").isNull().alias("no_id"), F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("row.text").alias("th"), "row")
    rows = held.select(*key, F.col("row.text").alias("text"))
    pieces = cut(rows.select(*key, F.posexplode(chunks(F.col("text"), divisor)).alias("no", "c")).where("c.n > 1").select(*key, "no", F.xxhash64("c.text").alias("h")))
    total = pieces.count()
    shared = pieces.groupBy("h").agg(F.count("*").alias("times")).where("times > 1")
    proposed = cut(join_unique(pieces, shared, ["h"], "times", total).select(*key, "no", "h"), total)
    wanted = proposed.groupBy(*key).agg(F.collect_set(F.struct("no", "h")).alias("wanted"))
    texts = rows.join(wanted, key).dropDuplicates(key).withColumn("parts", chunks(F.col("text"), divisor))
    texts = texts.select(*key, F.explode(F.transform("wanted", lambda w: F.struct(w["no"].alias("no"), w["h"].alias("h"), F.get("parts", w["no"])["text"].alias("text")))).alias("w"))
    # Grouping by the text itself is the comparison of bytes; the first occurrence of each text stays.
    place = F.struct((~F.col("no_id")).alias("with_id"), "id", "th", "no")
    kinds = cut(texts.groupBy("w.h", "w.text").agg(F.min(F.struct((~F.col("no_id")).alias("with_id"), "id", "th", F.col("w.no").alias("no"))).alias("first"), F.count("*").alias("times")).select("h", "first", "times"))
    by_hash = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max(F.struct("first", "times")).alias("only"))
    alone = by_hash.where("kinds = 1 and only.times > 1").select("h", "only.first", "only.times")
    gone = join_unique(proposed.distinct(), alone, ["h"], "times", total).where(place > F.col("first")).select(*key, "no")
    if by_hash.where("kinds > 1").limit(1).count():
        # Different texts with one hash, which the bytes told apart: their texts are joined themselves.
        mixed = texts.select(*key, "w.no", "w.h", "w.text").join(by_hash.where("kinds > 1").select("h"), "h", "left_semi")
        first = mixed.groupBy("text").agg(F.min(place).alias("first"))
        gone = gone.unionByName(mixed.join(first, "text").where(place > F.col("first")).select(*key, "no"))
    gone = gone.groupBy(*key).agg(F.sort_array(F.collect_set("no")).alias("gone"))
    out = held.join(gone, key, "left").withColumn("parts", F.when(F.col("gone").isNotNull(), chunks(F.col("row.text"), divisor)))
    out = out.withColumn("kept", F.filter("parts", lambda c, k: ~F.array_contains("gone", k)))
    count = lambda parts: F.aggregate(F.transform(parts, lambda c: c["n"]), F.lit(0), lambda a, b: a + b)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("kept", lambda c: c["text"]), "\n"))
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(count("parts") - count("kept"))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n", -1)))
    columns = [(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]
    return out.select(*columns, n_lines.cast("long").alias("n_lines"), n_gone.cast("long").alias("n_lines_removed"))
