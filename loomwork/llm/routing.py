"""Find repeated windows of a corpus by routing short segments, not texts.

A window is `length` successive units (words or bytes) of one text. Its
anchor is the least hash of its `gram`-unit runs, so equal windows have equal
anchors. Successive windows with one anchor make a segment. The steps are

1. texts are dealt once into groups of a few MB by a hash of the row, and
   each group sends the distinct anchors it holds, packed, to buckets;
2. a bucket answers each group which of its anchors another group has too;
3. groups send the segments with such anchors (or with anchors that several of
   their own documents share) to the bucket of the anchor, equal segments
   of a group once, under their smallest doc_id: this keeps a
   passage that a third of all documents hold down to one row per group;
4. a bucket indexes its segments and answers each group which windows also
   start in a smaller doc_id (`resolve`, given by the operator);
5. groups apply the answers to their texts (`finish`, given by the operator).

Every figure that grows with the data is the number of groups and buckets:
the size of each stays the same. The driver collects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Bytes of text per group.
GROUP_BYTES = 6_000_000
#: Windows of one segment at most; keeps runs of junk from making long segments.
LONGEST_RUN = 36
NULL_ID = -(1 << 63)

PACKED = "bucket int, g int, single binary, multi binary"
KNOWN = "g int, anchors binary"
SEGMENTS = "bucket int, g int, content binary, lens binary, docs binary, occ_seg binary, occ_doc binary, occ_start binary, done_doc binary, done_start binary, done_end binary"
RANGES = "g int, doc binary, start binary, end binary"


def input_bytes(df: DataFrame) -> int:
    """Bytes of all texts: one pass over the column."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0])


class Units:
    """Texts as one flat sequence of units (hashes of words, or bytes) with offsets per row."""

    def __init__(self, texts, by_word: bool):
        self.data, offs = kernel.text_buffers(texts)
        self.by_word = by_word
        if by_word:
            self.size, parts, counts, edges = 8, [], [], []
            for i, j in kernel.slices(offs):
                own, at = self.data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, first = kernel.words(own, at)
                parts.append(kernel.hashes(own, starts, ends))
                edges.append(np.stack([starts, ends]) + offs[i])
                counts.append(np.diff(first))
            self.flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            self.starts, self.ends = np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.int64)
            self.offs = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, np.int64)
            self.values = self.flat
        else:
            self.size, self.flat, self.offs = 1, self.data, offs
            self.values = None

    def exact(self) -> np.ndarray:
        """The units as values that are equal only where their bytes are."""
        return kernel.told_apart(self.data, self.starts, self.ends, self.flat) if self.by_word else self.flat

    def content(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes of runs of units, one after the other; each run of words ends with a space."""
        if not self.by_word:
            return self.flat[kernel.spread(start, size)]
        if not len(start):
            return np.empty(0, np.uint8)
        begin, lens = self.starts[start], self.ends[start + size - 1] - self.starts[start]
        out = np.full(int((lens + 1).sum()), 0x20, np.uint8)
        out[kernel.spread(np.cumsum(lens + 1) - lens - 1, lens)] = self.data[kernel.spread(begin, lens)]
        return out

    def prefix(self, i: int, j: int) -> kernel.Prefix:
        own = self.flat[self.offs[i] : self.offs[j]]
        return kernel.Prefix(kernel.BYTE[own] if self.values is None else own)

    def segments(self, length: int, gram: int):
        """Row ranges with, for each, the segments: start, windows, anchor, row and hash of content."""
        for i, j in kernel.slices(self.offs, (1 << 20) // self.size):
            at = self.offs[i : j + 1] - self.offs[i]
            pre = self.prefix(i, j)
            least = kernel.window_min(pre.grams(gram), length - gram + 1)
            per_row = np.maximum(0, np.diff(at) - length + 1)
            where = kernel.spread(at[:-1], per_row)
            if not len(where):
                continue
            anchor = least[where]
            new = np.ones(len(where), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            new[(np.cumsum(per_row) - per_row)[per_row > 0]] = True
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(where)))
            if count.max() > LONGEST_RUN:
                parts = -(-count // LONGEST_RUN)
                step = kernel.spread(np.zeros(len(parts), np.int64), parts) * LONGEST_RUN
                count = np.minimum(np.repeat(count, parts) - step, LONGEST_RUN)
                first = np.repeat(first, parts) + step
            start = where[first]
            row = np.searchsorted(at, start, "right") - 1 + i
            yield start + self.offs[i], count, anchor[first], row, pre.of(start, start + count + (length - 1))


def ordered(table: pa.Table) -> pa.Table:
    """Rows of a group in an order that any rerun has: by doc_id and hash of text."""
    ids = np.asarray(table["doc_id"].fill_null(NULL_ID))
    return table.take(pa.array(np.lexsort((np.asarray(table["th"]), ids))))


def send_anchors(by_word: bool, length: int, gram: int, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        ids = np.asarray(table["doc_id"].fill_null(NULL_ID))
        anchors, docs = [], []
        for _, _, anchor, row, _ in Units(table["text"], by_word).segments(length, gram):
            anchors.append(anchor)
            docs.append(ids[row])
        out = {"bucket": [], "g": [], "single": [], "multi": []}
        if anchors:
            anchors, docs = np.concatenate(anchors), np.concatenate(docs)
            order = np.argsort(anchors)
            anchors, docs = anchors[order], docs[order]
            new = np.ones(len(anchors), bool)
            new[1:] = anchors[1:] != anchors[:-1]
            first = np.flatnonzero(new)
            several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            anchors = anchors[first]
            bucket = (anchors % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            anchors, several, bucket = anchors[order], several[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for b, a, s in zip(bucket[np.concatenate([[0], cuts])], np.split(anchors, cuts), np.split(several, cuts), strict=True):
                out["bucket"].append(int(b))
                out["g"].append(g)
                out["single"].append(a[~s].tobytes())
                out["multi"].append(a[s].tobytes())
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "g": pa.array(out["g"], pa.int32()), "single": pa.array(out["single"], pa.binary()), "multi": pa.array(out["multi"], pa.binary())})

    return run


def answer_anchors(table: pa.Table) -> pa.Table:
    parts, groups = [], []
    for name in ("single", "multi"):
        for g, blob in zip(table["g"].to_pylist(), table[name], strict=True):
            got = np.frombuffer(blob.as_buffer(), np.uint64)
            parts.append(got)
            groups.append(np.full(len(got), g, np.int32))
    anchors, groups = np.concatenate(parts), np.concatenate(groups)
    if len(anchors):
        order = np.argsort(anchors)
        anchors, groups = anchors[order], groups[order]
        same = anchors[1:] == anchors[:-1]
        shared = np.zeros(len(anchors), bool)
        shared[1:] |= same
        shared[:-1] |= same
        anchors, groups = anchors[shared], groups[shared]
    if not len(anchors):
        return pa.table({"g": pa.array([], pa.int32()), "anchors": pa.array([], pa.binary())})
    order = np.argsort(groups, kind="stable")
    anchors, groups = anchors[order], groups[order]
    cuts = np.flatnonzero(np.diff(groups)) + 1
    return pa.table({"g": pa.array(groups[np.concatenate([[0], cuts])], pa.int32()), "anchors": pa.array([x.tobytes() for x in np.split(anchors, cuts)], pa.binary())})


def _blobs(column) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in column]) if len(column) else np.empty(0, np.uint64)


def packed(flat: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(flat.tobytes())


def unpacked(data) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def received(contents: list[np.ndarray], by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """The units of all contents: as values that are equal only where their bytes are, and as anchors are made of them."""
    data = np.concatenate(contents)
    if not by_word:
        return data, data
    starts, ends, _ = kernel.words(data, np.array([0, len(data)]))
    h = kernel.hashes(data, starts, ends)
    return kernel.mix(kernel.told_apart(data, starts, ends, h).astype(np.uint64)), h


def send_segments(by_word: bool, length: int, gram: int, n_buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        out = {x: [] for x in names}
        if len(table):
            table = ordered(table)
            g = table["g"][0].as_py()
            ids = np.asarray(table["doc_id"].fill_null(NULL_ID))
            units = Units(table["text"], by_word)
            got = [*units.segments(length, gram)]
            known = np.unique(_blobs(answers["anchors"]))
        else:
            got = []
        if got:
            start, count, anchor, row, content = (np.concatenate(x) for x in zip(*got, strict=True))
            docs = ids[row]
            order = np.argsort(anchor)
            new = np.ones(len(order), bool)
            new[1:] = anchor[order][1:] != anchor[order][:-1]
            first = np.flatnonzero(new)
            several = np.minimum.reduceat(docs[order], first) != np.maximum.reduceat(docs[order], first)
            wanted = np.union1d(known, anchor[order][first][several])
            keep = np.flatnonzero(np.isin(anchor, wanted))
            start, count, anchor, row, content, docs = (x[keep] for x in (start, count, anchor, row, content, docs))
        if got and len(start):
            size = count + (length - 1)
            # Equal segments together, the smallest doc_id first.
            order = np.lexsort((start, docs, content))
            start, count, anchor, row, content, docs, size = (x[order] for x in (start, count, anchor, row, content, docs, size))
            new = np.ones(len(start), bool)
            new[1:] = (content[1:] != content[:-1]) | (size[1:] != size[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            # Hashes only propose: what differs from the head of its class stands alone.
            rest = np.flatnonzero(~new)
            if len(rest):
                exact = units.exact()
                a, b = exact[kernel.spread(start[rest], size[rest])], exact[kernel.spread(start[head[rest]], size[rest])]
                differs = np.add.reduceat((a != b).astype(np.int64), np.cumsum(size[rest]) - size[rest]) > 0
                new[rest[differs]] = True
                head[rest[differs]] = rest[differs]
            done = ~new & (docs > docs[head])
            bucket = (anchor % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            at = start - units.offs[row]
            for own in np.split(order, cuts):
                segs, gone, occ = own[new[own]], own[done[own]], own[~done[own]]
                place = np.zeros(len(start), np.int64)
                place[segs] = np.arange(len(segs))
                out["bucket"].append(int(bucket[own[0]]))
                out["g"].append(g)
                out["content"].append(packed(units.content(start[segs], size[segs])))
                for name, x, t in (("lens", size[segs], np.uint16), ("docs", docs[segs], np.int64), ("occ_seg", place[head[occ]], np.uint32), ("occ_doc", row[occ], np.uint32), ("occ_start", at[occ], np.uint32), ("done_doc", row[gone], np.uint32), ("done_start", at[gone], np.uint32), ("done_end", at[gone] + size[gone], np.uint32)):
                    out[name].append(x.astype(t).tobytes())
        return pa.table({x: pa.array(out[x], pa.int32() if x in ("bucket", "g") else pa.binary()) for x in names})

    return run


def fold(flat: np.ndarray, lens: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string the first of those equal to it, by doc_id, and whether that one's doc_id is smaller."""
    start = np.cumsum(lens) - lens
    key = kernel.Prefix(kernel.BYTE[flat] if flat.dtype == np.uint8 else flat).of(start, start + lens)
    order = np.lexsort((docs, lens, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (lens[order][1:] != lens[order][:-1])
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    rest = np.flatnonzero(head != np.arange(len(head)))
    if len(rest):
        # Hashes only propose: what differs from its head stands alone.
        differs = flat[kernel.spread(start[rest], lens[rest])] != flat[kernel.spread(start[head[rest]], lens[rest])]
        differs = np.add.reduceat(differs.astype(np.int64), np.cumsum(lens[rest]) - lens[rest]) > 0
        head[rest[differs]] = rest[differs]
    return head, docs[head] < docs


def partnered(flat: np.ndarray, start: np.ndarray, lens: np.ndarray, gram: int) -> np.ndarray:
    """Whether another string of the set has the same anchor: without one, no window can be shared."""
    if not len(start):
        return np.empty(0, bool)
    own = flat[kernel.spread(start, lens)]
    grams = kernel.Prefix(kernel.BYTE[own] if flat.dtype == np.uint8 else own).grams(gram)
    at, many = np.cumsum(lens) - lens, lens - gram + 1
    anchor = np.minimum.reduceat(grams[kernel.spread(at, many)], np.cumsum(many) - many)
    _, back, count = np.unique(anchor, return_inverse=True, return_counts=True)
    return count[back] > 1


def answer_segments(by_word: bool, length: int, gram: int, resolve: Callable):
    def run(table: pa.Table) -> pa.Table:
        parts = {name: [np.frombuffer(x.as_buffer(), t) for x in table[name]] for name, t in (("lens", np.uint16), ("docs", np.int64))}
        flat, hashed = received([unpacked(x.as_buffer()) for x in table["content"]], by_word)
        lens, docs = (np.concatenate(parts[x]) for x in ("lens", "docs"))
        lens = lens.astype(np.int64)
        head, copy = fold(flat, lens, docs)
        at = np.cumsum(lens) - lens
        own = np.flatnonzero(head == np.arange(len(lens)))
        own = own[partnered(hashed, at[own], lens[own], gram)]
        own_seg, own_first, own_last = resolve(flat[kernel.spread(at[own], lens[own])], lens[own], docs[own], length)
        # What holds for a string holds for its copies; a copy in a later document is a repeat as a whole.
        place = np.full(len(lens), -1, np.int64)
        place[own] = np.arange(len(own))
        like = np.flatnonzero(~copy)
        like = like[place[head[like]] >= 0]
        a, b = np.searchsorted(own_seg, place[head[like]]), np.searchsorted(own_seg, place[head[like]], "right")
        which, whole = kernel.spread(a, b - a), np.flatnonzero(copy)
        seg = np.concatenate([np.repeat(like, b - a), whole])
        first = np.concatenate([own_first[which], np.zeros(len(whole), np.int64)])
        last = np.concatenate([own_last[which], lens[whole] - length])
        order = np.argsort(seg, kind="stable")
        seg, first, last = seg[order], first[order], last[order]
        n_segs = np.array([len(x) for x in parts["lens"]])
        base = np.cumsum(n_segs) - n_segs
        lo = np.searchsorted(seg, base)
        hi = np.searchsorted(seg, base + n_segs)
        out = {"g": [], "doc": [], "start": [], "end": []}
        for r, g in enumerate(table["g"].to_pylist()):
            of = lambda name: np.frombuffer(table[name][r].as_buffer(), np.uint32).astype(np.int64)  # noqa: E731, B023
            own_seg, own_first, own_last = seg[lo[r] : hi[r]] - base[r], first[lo[r] : hi[r]], last[lo[r] : hi[r]]
            occ = of("occ_seg")
            a, b = np.searchsorted(own_seg, occ), np.searchsorted(own_seg, occ, "right")
            hit, which = np.repeat(np.arange(len(occ)), b - a), kernel.spread(a, b - a)
            doc = np.concatenate([of("occ_doc")[hit], of("done_doc")])
            start = np.concatenate([of("occ_start")[hit] + own_first[which], of("done_start")])
            end = np.concatenate([of("occ_start")[hit] + own_last[which] + length, of("done_end")])
            if len(doc):
                out["g"].append(g)
                for name, x in (("doc", doc), ("start", start), ("end", end)):
                    out[name].append(x.astype(np.uint32).tobytes())
        return pa.table({"g": pa.array(out["g"], pa.int32())} | {x: pa.array(out[x], pa.binary()) for x in ("doc", "start", "end")})

    return run


def repeated(docs: DataFrame, by_word: bool, length: int, gram: int, resolve: Callable, finish: Callable, schema: str) -> DataFrame:
    """Rows of `finish(table, units, offsets, covered)` for each group of docs (doc_id, text).

    resolve(flat, lens, docs, length) gives, sorted by segment, runs of windows
    (segment, first, last start) that also start in a smaller doc_id.
    """
    n_groups = max(8, -(-input_bytes(docs) // GROUP_BYTES))
    few, many = max(8, -(-n_groups // 4)), n_groups
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.select(F.pmod(F.hash("doc_id", "th"), F.lit(n_groups)).alias("g"), "doc_id", "th", "text")
    known = rows.groupBy("g").applyInArrow(send_anchors(by_word, length, gram, few), PACKED).groupBy("bucket").applyInArrow(answer_anchors, KNOWN)
    segments = rows.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(send_segments(by_word, length, gram, many), SEGMENTS)
    ranges = segments.groupBy("bucket").applyInArrow(answer_segments(by_word, length, gram, resolve), RANGES)

    def last(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return None
        table = ordered(table)
        units = Units(table["text"], by_word)
        doc, start, end = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in answers[name]] or [np.empty(0, np.uint32)]).astype(np.int64) for name in ("doc", "start", "end"))
        return finish(table, units.offs, kernel.cover(int(units.offs[-1]), units.offs[doc] + start, units.offs[doc] + end))

    empty = finish(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), np.zeros(1, np.int64), np.empty(0, bool))
    return rows.groupBy("g").cogroup(ranges.groupBy("g")).applyInArrow(lambda t, a: empty if (got := last(t, a)) is None else got, schema)
