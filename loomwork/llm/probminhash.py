"""Near-duplicates by ProbMinHash over weighted word shingles, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .session import cut, discard
from .skew import join_unique

BANDS, ROWS = 25, 5
#: Bits of a sort key that number the rows of a batch (a batch has 10,000 unless set otherwise).
ROW_BITS = 20
#: Documents and shingles of one block; larger families are compared block by block.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 1_500_000
#: Near documents, of some 40 bytes each, that go to every task at most; beyond it the texts are shuffled to meet them.
BROADCAST_DOCS = 1_000_000
#: Links, of 16 bytes each, that one task joins at most; beyond it they are contracted by shuffles until they are so few.
TASK_LINKS = 100_000
#: Cells of the matrices that a comparison holds at once.
CELLS = 4_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct word shingles of each row, sorted by row and hash.

    A row with fewer words than the width has one shingle of all its words.
    """
    starts, ends, first = kernel.words(data, offs)
    word = kernel.hashes(data, starts, ends)
    per_row = np.diff(first)
    many = np.maximum(0, per_row - width + 1)
    gram = kernel.Prefix(word).grams(width)
    few = np.flatnonzero((per_row > 0) & (many == 0))
    whole = kernel.Prefix(word).of(first[few], first[few + 1])
    h = np.concatenate([gram[kernel.spread(first[:-1], many)], whole])
    row = np.concatenate([np.repeat(np.arange(len(per_row)), many), few])
    # One sort for both: the row takes the high bits, and always as many, for
    # the hash of a shingle must not depend on the rows around it.
    bits = np.uint64(ROW_BITS)
    key = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key = key[at]
    return (key >> (np.uint64(64) - bits)).astype(np.int64), key << bits, np.diff(np.append(at, len(new)))


def sketch(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash signatures of n weighted sets, as an n by m array of element hashes.

    Every element is a Poisson process with its weight as rate; each arrival
    claims a random register, and the earliest arrival keeps it. An element
    stops as soon as its next arrival comes after all registers of its set
    have earlier ones. Arrivals are made in blocks that double; those past the
    stop change nothing, so the signature doesn't depend on the blocks.
    """
    time = np.full(n * m, np.inf)
    owner = np.zeros(n * m, np.uint64)
    now = np.zeros(len(h))
    made, block = 0, 1
    live = np.arange(len(h))
    while len(live):
        seed = h[live][:, None] + (np.arange(made, made + block, dtype=np.uint64) + np.uint64(1)) * _GOLDEN
        random = kernel.mix(seed)
        gaps = -np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        when = now[live][:, None] + np.cumsum(gaps, axis=1) / weight[live][:, None]
        register = (kernel.mix(random ^ _GOLDEN) % np.uint64(m)).astype(np.int64) + (row[live] * m)[:, None]
        np.minimum.at(time, register.ravel(), when.ravel())
        best = when == time[register]
        owner[register[best]] = np.broadcast_to(h[live][:, None], best.shape)[best]
        now[live] = when[:, -1]
        made, block = made + block, min(2 * block, 128)
        last = time.reshape(n, m).max(axis=1)
        live = live[now[live] < last[row[live]]]
    return owner.reshape(n, m)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets (sorted hashes, weights)."""
    keys = np.union1d(a, b)
    p, q = np.zeros(len(keys)), np.zeros(len(keys))
    p[np.searchsorted(keys, a)], q[np.searchsorted(keys, b)] = x, y
    common = (p > 0) & (q > 0)
    if not common.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = q / p
    order = np.argsort(ratio, kind="stable")
    ratio, p, q, common = ratio[order], p[order], q[order], common[order]
    upto = np.searchsorted(ratio, ratio[common], "right")
    low, high = np.cumsum(p), np.cumsum(q[::-1])[::-1]
    return float((1 / (low[upto - 1] / p[common] + np.append(high, 0)[upto] / q[common])).sum())


def sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = kernel.text_buffers(batch.column("text"))
            for i, j in kernel.slices(offs, 1 << 21):
                n = j - i
                row, h, count = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                first = np.searchsorted(row, np.arange(n + 1))
                signature = sketch(row, h, count.astype(np.float64), n, bands * rows)
                odd = np.arange(1, 2 * rows, 2, dtype=np.uint64) * _GOLDEN
                key = kernel.mix((signature.reshape(n, bands, rows) * odd).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _GOLDEN)
                # Equal weighted sets have equal contents, two 64-bit sums over all shingles.
                own = kernel.mix(h + count.astype(np.uint64) * _GOLDEN)
                sums = np.zeros((2, len(own) + 1), np.uint64)
                np.cumsum(own, out=sums[0, 1:])
                np.cumsum(kernel.mix(own ^ _GOLDEN), out=sums[1, 1:])
                sums = sums[:, first[1:]] - sums[:, first[:-1]]
                size = np.diff(first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(size, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], ["doc_id", "n_shingles", "own1", "own2", "bands"])

    return run


def sets(width: int, kept=("doc_id", "family", "blocks", "block")):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = kernel.text_buffers(batch.column("text"))
            for i, j in kernel.slices(offs, 1 << 21):
                row, h, count = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                first = np.searchsorted(row, np.arange(j - i + 1))
                pack = [h[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in kept), pa.array(pack, pa.binary())], [*kept, "set"])

    return run


def _unpack(blob) -> tuple[np.ndarray, np.ndarray]:
    n = blob.as_buffer().size // 12
    return np.frombuffer(blob.as_buffer(), np.uint64, n), np.frombuffer(blob.as_buffer(), np.uint32, n, 8 * n).astype(np.float64)


def block_links(ids: np.ndarray, sides: np.ndarray, packs: list, threshold: float) -> list[tuple[int, int]]:
    """Links that join all documents which links of the threshold or more join, as a forest.

    Documents of one side are not compared if there are two sides. With p for
    the weights of one set as shares of their sum, the similarity is at most
    the p of the shared shingles; a matrix product gives that for all pairs.
    If no shingle occurs twice, it also gives the similarity itself.
    """
    n = len(ids)
    sizes = np.array([len(h) for h, _ in packs])
    total = np.array([w.sum() for _, w in packs])
    doc = np.repeat(np.arange(n), sizes)
    _, place, times = np.unique(np.concatenate([h for h, _ in packs]), return_inverse=True, return_counts=True)
    weight = np.concatenate([w for _, w in packs])
    order = np.argsort(place, kind="stable")
    order = order[times[place[order]] > 1]
    column = np.cumsum(np.diff(place[order], prepend=-1) != 0) - 1
    shared = np.zeros((n, n), np.float64)
    step = max(64, CELLS // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        part = slice(*np.searchsorted(column, [lo, lo + step]))
        own, at = order[part], column[part] - lo
        has = np.zeros((n, int(at.max()) + 1), np.float32)
        share = np.zeros_like(has)
        has[doc[own], at] = 1
        share[doc[own], at] = weight[own]
        shared += share @ has.T
    bound = np.minimum(shared / total[:, None], (shared / total[:, None]).T)
    a, b = np.nonzero(np.triu(bound >= threshold - 1e-6, 1))
    if len(np.unique(sides)) > 1:
        cross = sides[a] != sides[b]
        a, b = a[cross], b[cross]
    plain = total == sizes
    exact = plain[a] & plain[b]
    known = shared[a, b] / (sizes[a] + sizes[b] - shared[a, b])
    keep = ~exact | (known >= threshold - 1e-9)
    # Sure links first: they join most, and what is joined needs no other test.
    a, b, exact = a[keep], b[keep], exact[keep]
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for k in np.argsort(~exact, kind="stable"):
        x, y = find(a[k]), find(b[k])
        if x != y and (exact[k] or similarity(*packs[a[k]], *packs[b[k]]) >= threshold):
            parent[max(x, y)] = min(x, y)
            out.append((int(ids[a[k]]), int(ids[b[k]])))
    return out


def links_of(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        family = np.asarray(table["family"])
        order = np.argsort(family, kind="stable")
        ids, sides = np.asarray(table["doc_id"]), np.asarray(table["block"])
        sets = table["set"].combine_chunks() if table["set"].num_chunks != 1 else table["set"].chunk(0)
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            own = own[np.argsort(ids[own])]
            out += block_links(ids[own], sides[own], [_unpack(sets[int(k)]) for k in own], threshold)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def join_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least) of all links (a, b) of the batches, as `components` has them: each root hangs under the least that a link shows it, until all links are inside a tree."""
    got = [(np.asarray(batch.column(0)), np.asarray(batch.column(1))) for batch in batches if batch.num_rows]
    if not got:
        return
    a, b = (np.concatenate(x) for x in zip(*got, strict=True))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    while True:
        x, y = root[ends[: len(a)]], root[ends[len(a) :]]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], ["node", "least"])


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Every node of links (a, b) with the least node it is joined to: (node, least).

    Alternating star contraction until the links are stars: every node that has
    a link has one, to a node that has none. The links are written out after
    each round (in few files, if they are `rows` at most), those of the round
    before deleted, and only one row of them comes to the driver. Rows are two
    numbers; the centre of a large star is split by the engine's skew join.
    As soon as TASK_LINKS links at most are known to be left, one task joins
    them all at once, without a shuffle.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    if rows is not None and rows <= TASK_LINKS:
        return cut(links.coalesce(1).mapInArrow(join_links, "node long, least long"), rows)
    links = links.distinct()
    old = None
    while True:
        # Small stars leave every node with links to smaller ones under the least of these.
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        small = links.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a != b").distinct()
        # Large stars hang the larger neighbours of a node under its least neighbour.
        both = small.union(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        links = cut(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), rows)
        if old is not None:
            discard(old)
        old, left = links, links.count()
        if left <= TASK_LINKS:
            out = components(links, left)
            discard(links)
            return out
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionAll(links.select("b", F.lit(0)).distinct())
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("ends")).where("up > 0 and ends > 1").limit(1).count():
            return links.select(F.col("a").alias("node"), F.col("b").alias("least"))


def near_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and class_id of each row of docs (doc_id, text; other columns, whatever their names, are ignored).

    Two documents are linked if the probability Jaccard similarity of their
    word shingles, weighted by how often they occur, is at least the
    threshold and one of 25 bands of 5 registers agrees (at 0.8, all but one
    pair in 20,000; documents of a class are usually joined by many). The
    class is the connected part, named by its smallest doc_id. Documents with
    equal weighted shingles are folded first, so copies cost one row each;
    the rest is compared inside the families that bands join, in blocks of
    bounded size, each document once against each block of its family.

    Null, empty and wordless texts are in a class of their own; texts of any
    length are read whole. Rows with one doc_id, repeated or of different
    texts, are one document, near whatever one of its texts is near; a null
    doc_id has the class null. An empty table gives an empty one.
    """
    own = ["own1", "own2", "n_shingles"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = cut(rows.mapInArrow(sketches(width, BANDS, ROWS), "doc_id long, n_shingles long, own1 long, own2 long, bands array<long>"))
    named = table.where("doc_id is not null and n_shingles > 0")
    n = named.count()
    groups = cut(named.groupBy(*own).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), n)
    # The head of a group is its first row by doc_id; the bands of equal sets are equal.
    heads = cut(named.join(groups.select(*own, F.col("first").alias("doc_id")), [*own, "doc_id"], "left_semi").select("doc_id", "n_shingles", "bands"), n)
    spots = heads.select("doc_id", F.explode("bands").alias("spot")).distinct()
    hubs = spots.groupBy("spot").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top"), F.count("*").alias("docs")).where("hub < top").drop("top")
    shared = cut(join_unique(spots, hubs, ["spot"], "docs", BANDS * n).select("doc_id", "hub").distinct(), BANDS * n)
    # A family is what shared bands join: no link leaves it.
    families = components(shared.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")), shared.count())
    near = shared.select("doc_id").distinct().join(families, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("least", "doc_id").alias("family"))
    sized = near = cut(near.join(heads.groupBy("doc_id").agg(F.max("n_shingles").alias("n")), "doc_id"), n)
    blocks = near.groupBy("family").agg(F.count("*").alias("docs"), F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    near = cut(join_unique(near, blocks, ["family"], "docs", n).select("doc_id", "family", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block")), n)
    for old in (shared, heads, sized):
        discard(old)
    n_near = near.count()
    packs = max(1, n_near // BLOCK_DOCS)
    packed = rows.join(F.broadcast(near) if n_near <= BROADCAST_DOCS else near, "doc_id").mapInArrow(sets(width), "doc_id long, family long, blocks long, block long, set binary")
    # Each pair of blocks of a family meets in one group; families of one block share groups.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    meets = packed.select("doc_id", "family", "blocks", "block", "set", other.alias("other"))
    meets = meets.select("doc_id", "family", "block", "set", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other"))).alias("meeting"))
    links = meets.groupBy("meeting").applyInArrow(links_of(threshold), "a long, b long")
    same = _one_document(named, groups, own, n)
    links = cut(links if same is None else links.unionByName(same), n)
    parts = components(links, links.count())
    discard(near)
    classes = groups.join(parts, groups["first"] == parts.node, "left").select(*own, "copies", F.coalesce("least", "first").alias("class_id"))
    # A doc_id that several rows have names one document, whose groups are linked.
    classes = join_unique(named.select("doc_id", *own), classes, own, "copies", n).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    several = table.select("doc_id", "n_shingles").where("doc_id is not null")
    per_id = several.groupBy("doc_id").agg(F.count("*").alias("rows")).join(classes, "doc_id", "left").select("doc_id", "rows", F.coalesce("class_id", "doc_id").alias("class_id"))
    # The two joins hold their inputs several times each: cut between them, plans stay small.
    total = table.count()
    out = join_unique(several, cut(per_id, total), ["doc_id"], "rows", total).select("doc_id", "n_shingles", "class_id")
    return out.unionByName(table.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class_id")))


def _one_document(named: DataFrame, groups: DataFrame, own: list[str], n: int) -> DataFrame | None:
    """Links (a, b) between the heads of all groups that one doc_id has rows in; None if no doc_id has two rows."""
    many = cut(named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1"), n)
    if not many.limit(1).count():
        return None
    told = cut(join_unique(named.select("doc_id", *own), many, ["doc_id"], "rows", n).select("doc_id", *own).distinct(), n)
    heads = cut(join_unique(told, groups, own, "copies", n).select("doc_id", "first").distinct(), n)
    least = heads.groupBy("doc_id").agg(F.min("first").alias("least"), F.max("first").alias("top"), F.count("*").alias("groups")).where("least < top")
    return join_unique(heads, least, ["doc_id"], "groups", n).select(F.col("first").alias("a"), F.col("least").alias("b"))
