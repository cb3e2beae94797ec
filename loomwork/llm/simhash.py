"""Document fingerprints by SimHash and permuted block tables, in DataFrame operations only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut
from .skew import join_unique

BITS = 128
#: Words of a term: a run of five, or what there is of it at the start of a text.
TERM = 5
SPACES = r"[\x20\x09-\x0D]+"
#: Rows per bucket of the order by doc_id, and quantiles that the buckets follow.
BUCKET_ROWS, QUANTILES = 1024, 64
#: Bits in which near fingerprints differ at most, queries' share of doc_ids, and tasks that each key of a block table is split over.
RADIUS, EVERY, SALTS = 3, 50, 8
#: Eight counters of one byte in a long, for blocks of so many terms; then two of 32 bits.
_BYTES, BLOCK_TERMS = 0x0101010101010101, 127
_WHITE = " \t\n\x0b\x0c\r"


def _block_votes(h: Column, hashes: int) -> list[Column]:
    """Sums over up to 127 terms, so the sign is never reached: byte k of sum i counts the terms with bit 8k + i set."""
    return [F.sum(F.shiftrightunsigned(x, i).bitwiseAND(F.lit(_BYTES))).alias(f"v{j}_{i}") for j, x in enumerate([h, *(F.when(h.isNotNull(), F.xxhash64(h, F.lit(j))) for j in range(1, hashes))]) for i in range(8)]


def _votes(hashes: int) -> list[Column]:
    """Sums over blocks: the low half of sum (i, k) counts bit 8k + i, the high half bit 8(k + 1) + i."""
    byte = lambda c, k: F.shiftrightunsigned(F.col(c), 8 * k).bitwiseAND(F.lit(0xFF))
    return [F.sum(F.shiftleft(byte(f"v{j}_{i}", k + 1), 32).bitwiseOR(byte(f"v{j}_{i}", k))).alias(f"w{j}_{i}_{k}") for j in range(hashes) for i in range(8) for k in (0, 2, 4, 6)]


def _signed(total: Column, hashes: int) -> Column:
    """Hex digits of the fingerprint: a bit is set if more than half of all terms have it."""
    words = []
    for j in range(hashes):
        half = [F.lit(0).cast("long"), F.lit(0).cast("long")]
        for i in range(8):
            for k in (0, 2, 4, 6):
                both = F.col(f"w{j}_{i}_{k}")
                for count, bit in ((both.bitwiseAND(F.lit(0xFFFFFFFF)), 8 * k + i), (F.shiftrightunsigned(both, 32), 8 * (k + 1) + i)):
                    half[bit // 32] = half[bit // 32] + F.when(count * 2 > total, F.lit(1 << bit % 32)).otherwise(F.lit(0))
        words += [half[1], half[0]]
    return F.lower(F.concat(*(F.lpad(F.hex(x), 8, "0") for x in words)))


def fingerprints(rows: DataFrame, key: list[str], text: str, bits: int = BITS) -> DataFrame:
    """key and fingerprint of rows; the key must be unique, and no other column is kept.

    Every word is one term with the four before it, so each occurrence of a
    term adds to its weight. A text without words has the fingerprint 0. Rows
    that are already partitioned by a column of the key are not shuffled.
    """
    hashes = bits // 64
    plain = F.btrim(F.col(text), F.lit(_WHITE))
    words = F.when(plain != "", F.split(plain, SPACES))
    terms = rows.select(*key, words.alias("__words")).withColumn("__at", F.explode_outer(F.sequence(F.lit(0), F.size("__words") - 1)))
    h = F.xxhash64(*(F.get("__words", F.col("__at") - back) for back in reversed(range(TERM))))
    terms = terms.select(*key, F.floor(F.col("__at") / BLOCK_TERMS).alias("__block"), F.when(F.col("__at").isNotNull(), h).alias("__h"))
    blocks = terms.groupBy(*key, "__block").agg(F.count("__h").alias("__n"), *_block_votes(F.col("__h"), hashes))
    sums = blocks.fillna(0, [f"v{j}_{i}" for j in range(hashes) for i in range(8)]).groupBy(*key).agg(F.sum("__n").alias("__n"), *_votes(hashes))
    return sums.select(*key, _signed(F.col("__n"), hashes).alias("fingerprint"))


def _pieces(fingerprint: str, bits: int) -> list[Column]:
    return [F.conv(F.substring(fingerprint, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(bits // 32)]


def distance(a: str, b: str, bits: int = BITS) -> Column:
    """Bits in which two fingerprints differ."""
    total = F.lit(0)
    for x, y in zip(_pieces(a, bits), _pieces(b, bits), strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def likeness(a: str, b: str, bits: int = BITS) -> Column:
    return 1 - distance(a, b, bits) / F.lit(float(bits))


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None, bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """(query, fingerprint, distance) for all prints within the radius of each query (column fingerprint).

    Both are cut into `blocks` blocks of hex digits (radius + 1 unless given).
    A pair within the radius differs in at most `radius` blocks, so it agrees
    in all others, and for each choice of blocks that may differ there is a
    table keyed by the rest. Equal fingerprints are folded first, so copies
    make no pairs; the tables are joined by their keys, each key split over
    `salts` tasks. Null fingerprints are near nothing.
    """
    blocks = radius + 1 if blocks is None else blocks
    digits = bits // 4
    cuts = [digits * k // blocks for k in range(blocks + 1)]
    keys = F.array(*(F.xxhash64(F.lit(t), *(F.substring("fingerprint", cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in kept)) for t, kept in enumerate(combinations(range(blocks), blocks - radius))))
    tables = prints.select("fingerprint").where("fingerprint is not null").distinct().select("fingerprint", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)).alias("salt"), F.explode(keys).alias("key"))
    asked = queries.select("fingerprint").where("fingerprint is not null").distinct().select(F.col("fingerprint").alias("query"), F.explode(keys).alias("key")).select("query", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pairs = asked.join(tables, ["key", "salt"]).withColumn("distance", distance("query", "fingerprint", bits)).where(F.col("distance") <= radius)
    return pairs.select("query", "fingerprint", "distance").distinct()


def ordered_buckets(df: DataFrame, name: str, rows_per_bucket: int = BUCKET_ROWS) -> Column:
    """A bucket number that never falls as the column rises, with about so many rows each.

    Quantiles of the column (64 numbers) cut its range; within each part
    buckets are of equal width. Null is bucket -1.
    """
    n, marks = df.agg(F.count(name), F.percentile_approx(name, [k / QUANTILES for k in range(QUANTILES + 1)], 10_000)).first()
    if not n:
        return F.lit(-1).cast("long")
    marks = sorted(set(marks))
    parts = max(1, -(-n // (rows_per_bucket * max(1, len(marks) - 1))))

    def inside(k: int) -> Column:
        low, high = marks[k], marks[k + 1] if k + 1 < len(marks) else marks[k]
        share = F.floor((F.col(name).cast("double") - F.lit(float(low))) * parts / F.lit(float(max(1, high - low))))
        return F.least(F.greatest(share, F.lit(0)), F.lit(parts - 1)) + k * parts

    def choose(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return inside(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(name) < F.lit(marks[mid]), choose(lo, mid)).otherwise(choose(mid, hi))

    return F.coalesce(choose(0, len(marks)), F.lit(-1)).cast("long")


def following(rows: DataFrame, order: list, columns: list[str]) -> DataFrame:
    """rows with next_<column>: the values of the next row by (bucket, order), and of the first for the last row.

    Rows are partitioned by bucket; only the first row of each bucket goes to
    the one before, which two levels of bucket numbers find.
    """
    inside = Window.partitionBy("bucket").orderBy(*order)
    rows = rows.withColumns({"__rank": F.row_number().over(inside)} | {f"next_{c}": F.lead(F.struct(c)).over(inside) for c in columns})
    heads = rows.where("__rank = 1").select("bucket", *columns)
    numbers = heads.select("bucket", F.floor(F.col("bucket") / BUCKET_ROWS).alias("group"))
    numbers = numbers.withColumn("next", F.lead("bucket").over(Window.partitionBy("group").orderBy("bucket")))
    groups = numbers.groupBy("group").agg(F.min("bucket").alias("head"))
    every = Window.orderBy("group")
    groups = groups.withColumn("after", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    links = numbers.join(groups, "group").select(F.col("bucket").alias("before"), F.coalesce("next", "after").alias("bucket"))
    first = links.join(heads, "bucket").select(F.col("before").alias("bucket"), *(F.struct(F.col(c)).alias(f"first_{c}") for c in columns))
    return rows.join(first, "bucket", "left").withColumns({f"next_{c}": F.coalesce(f"next_{c}", f"first_{c}")[c] for c in columns}).drop("__rank", *(f"first_{c}" for c in columns))


KEY = ["no_id", "id", "th", "n"]


def linked(rows: DataFrame) -> DataFrame:
    """The distinct keys (no_id, id, th, n) of rows in their order, each with `times`, its number of rows, and the next key.

    Null ids come first, then ids rise; the texts of one id go by hash and
    length. The first key follows the last. Only keys are shuffled: those of
    an id that has many are split by their hash, and ids are ordered apart.
    """
    n = rows.count()
    own = cut(rows.groupBy(*KEY).agg(F.count("*").alias("times")), n)
    many = own.groupBy("no_id", "id").agg(F.count("*").alias("texts"))
    own = join_unique(own, many, ["no_id", "id"], "texts", n)
    parts = F.ceil(F.col("texts") / BUCKET_ROWS)
    own = own.withColumn("part", F.least(F.floor((F.col("th") / 2.0**64 + 0.5) * parts), parts - 1)).drop("texts")
    inside = Window.partitionBy("no_id", "id", "part").orderBy("th", "n")
    own = cut(own.withColumns({"place": F.row_number().over(inside), "after": F.lead(F.struct(*KEY)).over(inside)}), n)
    heads = own.where("place = 1").select("no_id", "id", "part", F.struct(*KEY).alias("head"))
    each = Window.partitionBy("no_id", "id").orderBy("part")
    heads = cut(heads.withColumns({"first": F.row_number().over(each) == 1, "later": F.lead("head").over(each)}), n)
    ids = heads.where("first").select("no_id", "id", "head").withColumn("doc", F.when(~F.col("no_id"), F.col("id")))
    ids = following(ids.withColumn("bucket", ordered_buckets(ids, "doc")), ["doc"], ["head"])
    ends = heads.where("later is null").select("no_id", "id", "part").join(ids.select("no_id", "id", "next_head"), ["no_id", "id"])
    ends = heads.where("later is not null").select("no_id", "id", "part", F.col("later").alias("next_head")).unionByName(ends)
    last = own.where("after is null").drop("after").join(ends, ["no_id", "id", "part"]).withColumnRenamed("next_head", "after")
    out = own.where("after is not null").select(*KEY, "times", "after").unionByName(last.select(*KEY, "times", "after")).withColumn("place", F.lit(1))
    return cut(out.select(*KEY, "times", F.col("place").alias("first"), *(F.col("after")[c].alias(f"next_{c}") for c in KEY)), n)


def edited_fingerprints(docs: DataFrame, bits: int = BITS, radius: int = RADIUS, every: int = EVERY) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts, and how many fingerprints are near.

    The edited text has its last floor(n_chars / 2) characters replaced by as
    many from the start of the next document by doc_id (all, if that has
    fewer; the first document follows the last). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next,
    the shares of equal bits with the edited and the next text, and n_near:
    for doc_ids divisible by `every` the number of rows of docs, itself among
    them, whose fingerprint differs in at most `radius` bits, found by block
    tables over all rows; null for others.

    Null text is empty; empty texts have the fingerprint 0; texts of any length
    are read whole. Null doc_ids come first; rows with one doc_id follow each
    other by hash of text, and of repeated rows each is followed by the next of
    them. One document alone is its own next. An empty table gives an empty
    one. Other columns, whatever their names, are ignored.

    Texts are shuffled once by (doc_id, hash), and of each what the one before
    it needs of its start; the order is made of keys alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("th"), F.char_length("text").alias("n"), "text")
    links = linked(rows)
    held = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("th")))
    half = F.floor(F.col("n") / 2).cast("int")
    # What each text has to send to the one before it. That the first copy sends is told by a column of the links, and not
    # by an equation: a test of the copy alone, or one more key, would part the shuffle of texts from that of the next join.
    asked = links.select(*(F.col(f"next_{c}").alias(c) for c in KEY), *(F.col(c).alias(f"to_{c}") for c in KEY), half.alias("half"), "first")
    starts = held.join(asked, KEY).where("copy <= first").select(*(F.col(f"to_{c}").alias(c) for c in KEY), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("start"))
    pairs = held.join(links.select(*KEY, "times"), KEY).join(starts, KEY)
    # A repeated row is followed by itself, but for the last of them.
    start = F.when(F.col("copy") < F.col("times"), F.substring(F.col("text"), F.lit(1), half)).otherwise(F.col("start"))
    pairs = pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - half), start))
    kept = [*KEY, "copy", "times", "edited_sha256"]
    pairs = pairs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = pairs.select(*kept, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x")).select(*kept, "x.which", "x.t")
    prints = fingerprints(both, [*kept, "which"], "t", bits)
    wide = cut(prints.groupBy(*kept).agg(F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint")))
    after = wide.where("copy = 1").select(*(F.col(c).alias(f"next_{c}") for c in KEY), F.col("fingerprint").alias("after"))
    after = links.join(after, [f"next_{c}" for c in KEY]).select(*KEY, "after")
    out = wide.join(after, KEY).withColumn("after", F.when(F.col("copy") < F.col("times"), F.col("fingerprint")).otherwise(F.col("after")))
    out = out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", bits).alias("near_edited"), likeness("fingerprint", "after", bits).alias("near_next"))
    return _counted(out, wide, radius, every, bits)


def _counted(out: DataFrame, wide: DataFrame, radius: int, every: int, bits: int) -> DataFrame:
    """out with n_near, for the rows whose doc_id is divisible by `every`."""
    is_query = ~F.col("no_id") & (F.col("id") % every == 0)
    prints = wide.groupBy("fingerprint").agg(F.count("*").alias("rows"), F.count(F.when(is_query, 1)).alias("asked"))
    prints = cut(prints, wide.count())
    queries = prints.where("asked > 0")
    near = near_fingerprints(prints, queries, radius, None, bits)
    near = near.join(prints.select("fingerprint", "rows"), "fingerprint").groupBy("query").agg(F.sum("rows").alias("n_near"))
    near = near.withColumnRenamed("query", "fingerprint").join(queries.select("fingerprint", "asked"), "fingerprint")
    asked = (F.col("doc_id") % every == 0) & F.col("doc_id").isNotNull()
    total = queries.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
    found = join_unique(out.where(asked), near, ["fingerprint"], "asked", total).select(*out.columns, "n_near")
    return found.unionByName(out.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
