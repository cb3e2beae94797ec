"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut
from .skew import HOT_KEYS, HOT_ROWS

#: A document is taken this often at most, and a source's target is this many times its size at most.
CAP = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Up to so many sources (some 200 bytes each) go to every task.
FEW_SOURCES = 50_000
#: Classes of rank that the running sums of a source are first taken over.
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Sources by code point, null last, get the weights in turn. Targets share
    the total size by weight; what is above the cap is shared again by weight
    among the rest until none is above. That is one level L with
    target = min(cap * size, L * weight), found by sorting sources by the
    level at which they reach their cap. One row per source is sorted.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")))
    full = (cap * F.col("source_size")).cast("double")
    order = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("room", F.sum("source_size").over(total) - F.coalesce(F.sum(full).over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("room") / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source that doesn't reach its cap at the level left for it fixes the level for all.
    rows = rows.withColumn("fixed", F.min(F.when(F.col("level") * F.col("weight") <= full, F.struct(full / F.col("weight"), F.col("level")))).over(total)["level"])
    return rows.withColumn("target", F.least(full, F.coalesce("fixed", F.lit(0.0)) * F.col("weight"))).drop("room", "level", "fixed")


def _by_source(rows: DataFrame, sources: DataFrame, few: bool, total: int) -> DataFrame:
    """rows with the columns of their source, for each of which `sources` has one row with its number of rows, `n`.

    If there are few sources all go to every task. Else those with many rows
    do, so that no task of the shuffle gets a whole large source.
    """
    by = ["no_source", "some_source"]
    if few:
        return rows.join(F.broadcast(sources.drop("n")), by)
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = sources.where(F.col("n") > least)
    warm = rows.join(F.broadcast(hot.drop("n")), by)
    cold = rows.join(F.broadcast(hot.select(*by)), by, "left_anti").join(sources.where(F.col("n") <= least).drop("n"), by)
    return warm.unionByName(cold)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, favour: Column | None = None, seed: str = "mix") -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target and copies.

    The expected number of copies of a document is target / source_size, times
    its `favour` relative to the mean of its source (1 unless given), at most
    `cap`. Its whole part is certain. The rest is an inclusion probability p:
    with a random number u, which depends on doc_id and seed alone, documents
    are ranked by (u / (1 - u)) / (p / (1 - p)), and the first are taken until
    the words of the source come as near its target as whole documents allow.

    Null and empty texts have size 0, long ones are counted whole, and a null
    source is a source of its own. Rows with one doc_id have one rank; ties of
    rank go by doc_id, null first, and repeated rows get one number of copies.
    An empty table gives an empty one. Columns of docs with the names of
    results are replaced; others may have any name.

    Only narrow rows are shuffled: where the ranked documents of a source
    stop is one row per source, which its documents are then held against.
    """
    new = ["size", "source_size", "target", "copies"]
    by = ["no_source", "some_source"]
    docs = docs.drop(*new)
    favour = F.lit(1.0) if favour is None else F.coalesce(favour.cast("double"), F.lit(0.0))
    # A row's own columns stay in one struct, so that no inner name meets one of them.
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    size = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    keys = [F.col("row.source").isNull().alias("no_source"), F.coalesce("row.source", F.lit("")).alias("some_source")]
    held = docs.select(F.struct(*docs.columns).alias("row"), favour.alias("favour"))
    held = held.select("row", *keys, F.col("row.doc_id").alias("doc"), size.alias("size"), u.alias("u"), "favour")
    rows = cut(held.drop("row"))
    total = rows.count()
    sources = rows.groupBy(*by).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("favour")).alias("favoured"), F.count("*").alias("n"))
    sources = targets(sources.withColumn("source", F.when(~F.col("no_source"), F.col("some_source"))), weights, cap)
    sources = cut(sources.select(*by, "n", "source_size", "target", F.when(F.col("favoured") > 0, F.col("target") / F.col("favoured")).otherwise(0.0).alias("rate")), total)
    few = sources.count() <= FEW_SOURCES
    expected = F.least(F.col("rate") * F.col("favour"), F.lit(float(cap)))

    def ranked(table: DataFrame) -> DataFrame:
        table = table.withColumns({"whole": F.floor(expected), "p": expected - F.floor(expected)})
        table = table.withColumn("rank", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        return table.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))

    narrow = ranked(_by_source(rows, sources, few, total))
    # Running sums in two steps: over at most BINS classes of each source, then inside the one class where the sum crosses.
    bins = narrow.groupBy(*by, "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("target"), F.count("*").alias("rows"))
    each = Window.partitionBy(*by)
    bins = bins.withColumn("left", F.col("target") - F.sum("sure").over(each)).where("bin is not null")
    bins = bins.withColumn("upto", F.sum("words").over(each.orderBy("bin")))
    crossing = bins.where("upto >= left").groupBy(*by).agg(F.min_by(F.struct(F.col("bin").alias("edge"), F.col("left").alias("room"), (F.col("upto") - F.col("words")).alias("under")), "bin").alias("c"))
    stops = cut(sources.select(*by, "n").join(crossing, by, "left").select(*by, "n", "c.*"), total)
    edge = _by_source(narrow.where("p > 0").select(*by, "doc", "size", "rank", "bin"), stops, few, total).where("bin = edge")
    running = F.col("under") + F.sum("size").over(Window.partitionBy(*by).orderBy("rank", "doc"))
    # Taken is what comes in order up to a last document; among rows that tie with it, those that are long enough.
    taken = edge.withColumn("running", running).where(F.col("running") - F.col("size") / 2 <= F.col("room"))
    last = taken.groupBy(*by).agg(F.max(F.struct("rank", "doc", (-F.col("size")).alias("less"))).alias("last"))
    level = sources.join(stops.select(*by, "edge"), by, "left").join(last, by, "left")
    out = ranked(_by_source(held, level, few, total))
    at, stop = F.struct("rank", "doc", (-F.col("size")).alias("less")), F.col("last")
    inside = F.coalesce((F.col("bin") == F.col("edge")) & (at <= stop), F.lit(False))
    more = (F.col("p") > 0) & ((F.col("bin") < F.coalesce("edge", F.lit(BINS + 1))) | inside)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns), "size", "source_size", "target", (F.col("whole") + more.cast("long")).alias("copies"))
