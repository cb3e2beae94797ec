"""Benchmark decontamination by template canonicalisation.

A template replaces what a re-parameterised question changes (numbers, names,
units) by typed placeholders. Windows of templates are joined by hash; the
slots then have to be consistent: within a match a benchmark value always
stands for one document value. Different benchmark values may become the same
document value. Where slots contradict each other, each consistent part is a
match of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .session import cut, with_text
from .skew import HOT_KEYS, HOT_ROWS

#: Tokens of a window, literal ones it needs unless all its tokens are equal, and tokens a match must span (or the whole item, if shorter).
WINDOW, LITERALS, SPAN = 8, 4, 13
#: Tokens of the windows that lead to passages in capitals, and literal ones among them.
SEED, SEED_LITERALS = 4, 3
#: A benchmark of at most so many characters (about 10 times as many bytes in memory) is probed by each task; beyond it windows are joined.
PROBE_CHARACTERS = 1 << 21
#: Documents of one window that a task of that join gets at most, about.
KEY_DOCS = 20_000
UNITS = "mm cm m km inch inches ft feet yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros pound pounds usd eur percent degree degrees c f k w kw v hz".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters of UTF-8 text."""
    out = data.copy()
    out[_UPPER[data]] += 32
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[second] += 32
    return out


_UNIT_HASH: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _UNIT_HASH:
        data, offs = kernel.text_buffers(pa.array(UNITS))
        _UNIT_HASH.append(np.sort(kernel.hashes(data, offs[:-1], offs[1:])))
    return _UNIT_HASH[0]


def templates(data: np.ndarray, offs: np.ndarray):
    """Per token the value of its template and the hash of its own text, and the token offsets of the rows."""
    return tokens(data, offs)[:3]


def tokens(data: np.ndarray, offs: np.ndarray):
    """As `templates`, and last which tokens are capitalised words that start a sentence: names, maybe.

    Tokens are runs of letters and digits in lower case. Tokens that begin with
    a digit are numbers, several joined by , or . are one (1,000.5); a unit is a listed word right after a
    number; a name is a capitalised word that doesn't start a sentence. In a
    number, the value is the text from its first to its last digit group.
    """
    starts, ends = kernel.runs(_TOKEN[data], offs)
    low = lowered(data)
    own = kernel.hashes(low, starts, ends)
    row = np.searchsorted(offs, starts, "right") - 1
    number = _DIGIT[data[starts]]
    first = np.ones(len(starts), bool)
    first[1:] = row[1:] != row[:-1]
    # A sentence starts with the row or after one of .!?: or a line end.
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = first.copy()
    opens[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    second = np.minimum(starts + 1, len(data) - 1)
    upper = _UPPER[data[starts]] | ((data[starts] == 0xC3) & (data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97))
    # Tokens of one number: only , or . between them.
    joined = np.zeros(len(starts), bool)
    near = np.flatnonzero(number[1:] & number[:-1] & ~first[1:] & (starts[1:] == ends[:-1] + 1)) + 1
    joined[near] = np.isin(data[ends[near - 1]], (44, 46))
    keep = ~joined
    last = np.append(np.flatnonzero(keep)[1:], len(starts)) - 1
    value = own[keep]
    many = last > np.flatnonzero(keep)
    if many.any():
        value[many] = kernel.hashes(low, starts[keep][many], ends[last[many]])
    number, first, opens, upper, row = number[keep], first[keep], opens[keep], upper[keep], row[keep]
    after = np.zeros(len(value), bool)
    after[1:] = number[:-1] & ~first[1:]
    unit = after & np.isin(value, _unit_hashes())
    name = upper & ~opens & ~number & ~unit
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, np.uint64(0))))
    return kind, value, np.searchsorted(row, np.arange(len(offs))), upper & opens & ~number & ~unit


def windows(kind: np.ndarray, value: np.ndarray, first: np.ndarray, width: int, opener: np.ndarray):
    """Hash, place and row of each window, once for each way to read its slots.

    All slots open; these and the capitalised words that open a sentence, which
    may be names; and names as literal words (for copies in other letter case,
    where capitals tell no names), each if enough tokens are literal then; and
    with the values of all slots, however many they are. Ways that say the
    same of a window come once.
    """
    many = np.maximum(0, np.diff(first) - width + 1)
    at = kernel.spread(first[:-1], many)
    row = np.repeat(np.arange(len(many)), many)
    nameless = np.where(kind == NAME, np.uint64(0), kind)
    wide = np.where(opener, NAME, kind)

    def count(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return sums[at + width] - sums[at]

    enough = min(LITERALS, width)
    ways = [(kind, count(kind == 0) >= enough), (wide, (count(opener) > 0) & (count(wide == 0) >= enough)), (nameless, (count(kind == NAME) > 0) & (count(nameless == 0) >= enough)), (np.zeros_like(kind), count(nameless > 0) > 0)]
    found = []
    for slots, use in ways:
        gram = kernel.Prefix(np.where(slots > 0, kernel.mix(slots), value)).grams(width)
        found.append((gram[at[use]], at[use], row[use]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def seeds(kind: np.ndarray, value: np.ndarray, first: np.ndarray, opener: np.ndarray | None = None):
    """Hash, place and row of windows of SEED tokens, names literal.

    They find passages whose capitals tell no names, and whose names are
    others: there no longer window may be without a name. Of documents (with
    `opener`) only windows in capitals are taken.
    """
    many = np.maximum(0, np.diff(first) - SEED + 1)
    at = kernel.spread(first[:-1], many)
    row = np.repeat(np.arange(len(many)), many)
    slots = np.where(kind == NAME, np.uint64(0), kind)

    def count(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return sums[at + SEED] - sums[at]

    open_slots = count(slots > 0)
    use = open_slots <= SEED - SEED_LITERALS
    if opener is not None:
        use &= count((kind == NAME) | opener) + open_slots == SEED
    gram = kernel.Prefix(np.where(slots > 0, kernel.mix(slots), value)).grams(SEED)
    return gram[at[use]], at[use], row[use]


class Items:
    """The templates of benchmark items, and an index of their windows."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        data, offs = kernel.text_buffers(pa.array(texts, pa.string()))
        self.kind, self.value, self.first, self.opener = tokens(data, offs)
        size = np.diff(self.first)
        parts = []
        for width in sorted({min(WINDOW, int(n)) for n in size if n >= 3}):
            h, at, row = windows(self.kind, self.value, self.first, width, self.opener)
            right = np.minimum(size[row], WINDOW) == width
            parts.append((np.full(right.sum(), width), h[right], at[right], row[right]))
        self.width, self.hash, self.at, self.row = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4
        order = np.lexsort((self.hash, self.width))
        self.width, self.hash, self.at, self.row = (x[order] for x in (self.width, self.hash, self.at, self.row))
        found = seeds(self.kind, self.value, self.first)
        self.seeds = [x[np.argsort(found[0], kind="stable")] for x in found]

    def hits(self, kind: np.ndarray, value: np.ndarray, first: np.ndarray, opener: np.ndarray):
        """(row, place, item, place in item) of all windows whose templates agree."""
        found = []
        for width in np.unique(self.width):
            lo, hi = np.searchsorted(self.width, [width, width + 1])
            known = self.hash[lo:hi].astype(np.uint64)
            h, at, row = windows(kind, value, first, int(width), opener)
            a = np.searchsorted(known, h)
            some = np.flatnonzero(known[np.minimum(a, len(known) - 1)] == h)
            a, b = a[some], np.searchsorted(known, h[some], "right")
            which, hit = kernel.spread(a, b - a) + lo, np.repeat(some, b - a)
            found.append((row[hit], at[hit], self.row[which], self.at[which]))
        h, at, row = seeds(kind, value, first, opener)
        a, b = np.searchsorted(self.seeds[0], h), np.searchsorted(self.seeds[0], h, "right")
        which, hit = kernel.spread(a, b - a), np.repeat(np.arange(len(h)), b - a)
        found.append((row[hit], at[hit], self.seeds[2][which], self.seeds[1][which]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4

    def matches(self, kind: np.ndarray, value: np.ndarray, first: np.ndarray, opener: np.ndarray):
        """(row, item, tokens matched, slots, slots changed) for pairs with a long consistent match."""
        row, at, item, there = self.hits(kind, value, first, opener)
        # Each diagonal with a hit, as far as both texts go.
        row, item, off = np.unique(np.stack([row, item, there - at]), axis=1)
        lo, hi = np.maximum(first[row], self.first[item] - off), np.minimum(first[row + 1], self.first[item + 1] - off)
        whole = self.first[item + 1] - self.first[item]
        best: dict[tuple, tuple] = {}
        for i in np.flatnonzero(hi - lo >= np.minimum(SPAN, whole)):
            a, b = slice(lo[i], hi[i]), slice(lo[i] + off[i], hi[i] + off[i])
            for found in _parts(kind[a], value[a], opener[a], self.kind[b], self.value[b], self.opener[b], min(WINDOW, int(whole[i])), min(SPAN, int(whole[i]))):
                key = (int(row[i]), int(item[i]))
                best[key] = max(best.get(key, ()), found)
        return [(*k, *v) for k, v in sorted(best.items())]


def _parts(kind: np.ndarray, value: np.ndarray, opener: np.ndarray, item_kind: np.ndarray, item_value: np.ndarray, item_opener: np.ndarray, width: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(tokens, slots, slots changed) of the consistent matches of two equally long runs of tokens, document and item.

    Tokens agree if they are equal or slots of one type; what is a slot is told
    by the item. A capitalised word that opens a sentence agrees with names and
    its like, and is a slot if it is another word than the item's. Windows of
    agreeing tokens that overlap make one match, if enough words of each are
    equal or all its tokens.
    """
    same = value == item_value
    plain = item_kind
    kind, item_kind = np.where(opener, NAME, kind), np.where(item_opener, NAME, item_kind)
    sums = np.zeros((3, len(same) + 1), np.int64)
    np.cumsum([same | ((item_kind > 0) & (kind == item_kind)), same & ((item_kind == 0) | (item_kind == NAME)), same], axis=1, out=sums[:, 1:])
    agree, words, equal = sums[:, width:] - sums[:, :-width]
    at = np.flatnonzero((agree == width) & ((words >= min(LITERALS, width)) | (equal == width)))
    for begin, end in zip(*kernel.runs(kernel.cover(len(same), at, at + width), np.array([0, len(same)])), strict=True):
        # A part ends before the slot that gives an item's value another value than before, and the next begins behind the earlier one.
        slots = begin + np.flatnonzero(item_kind[begin:end] > 0)
        seen: dict[tuple, tuple] = {}
        left, parts = begin, []
        for p, t, x, y in zip(slots.tolist(), item_kind[slots].tolist(), item_value[slots].tolist(), value[slots].tolist(), strict=True):
            before, where = seen.get((t, x), (y, p))
            seen[t, x] = y, p
            if before != y and where >= left:
                parts.append((left, p))
                left = where + 1
        for left, right in [*parts, (left, end)]:
            if right - left >= least:
                inside = slots[(slots >= left) & (slots < right) & ((plain[slots] > 0) | ~same[slots])]
                yield int(right - left), len(inside), int((~same[inside]).sum())


def _probe(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = make()
        for batch in batches:
            data, offs = kernel.text_buffers(batch.column("text"))
            ids = batch.column("doc_id")
            out = []
            for i, j in kernel.slices(offs):
                out += [(ids[i + r].as_py(), items.ids[k], *rest) for r, k, *rest in items.matches(*tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(5)], ["doc_id", "item_id", "n_matched", "n_slots", "n_changed"])

    return run


SCHEMA = "doc_id long, item_id long, n_matched long, n_slots long, n_changed long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of docs (doc_id, text) and benchmark items (item_id, text) that share a passage.

    A passage is a run of windows of 8 tokens, 13 tokens long in all or the
    whole item if that is shorter (3 tokens at least), with equal templates
    and consistent slots. Letter case is of no account to words that are equal,
    be they names or not. A window needs 4 literal words (all, if it has fewer
    than 4 tokens) or equal values in all slots: passages of little else than
    numbers, names and units are found as copies, not re-parameterised. A
    passage with a slot that contradicts another is cut
    into its longest consistent parts, of which each has to be as long as that. Returns doc_id, item_id, n_matched (tokens of the
    longest), n_slots in it and n_changed of these. Null texts match nothing;
    repeated rows give repeated pairs of which one is returned; null ids are
    returned as they are.

    A benchmark of at most PROBE_CHARACTERS is probed from memory; for a larger
    one the windows are joined by a shuffle, with the same result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if total <= PROBE_CHARACTERS:
        rows = sorted(((r.item_id, r.text) for r in bench.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        found = docs.mapInArrow(_probe(lambda: Items([x for x, _ in shared.value], [t for _, t in shared.value])), SCHEMA)
    else:
        found = _joined(docs, bench)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "n_slots", "n_changed")).alias("x")).select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that share no passage with an item of the benchmark, in the sense of `leaks`.

    Each row is judged by its own text, read whole: of several texts under one
    doc_id only those go that hold a passage. Null and empty texts stay, and so
    do repeated rows of clean texts; an empty table or benchmark takes nothing
    away. Other columns may have any name.
    """
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    if bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] > PROBE_CHARACTERS:
        # Texts are judged by their hash, which no column of docs can be confused with inside a struct.
        rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("th", F.xxhash64(F.col("row.text").cast("string")))
        bad = cut(_joined(rows.select(F.col("th").alias("doc_id"), F.col("row.text").cast("string").alias("text")), bench).select(F.col("doc_id").alias("th")).distinct())
        # Texts that many documents share are held against it without a shuffle.
        least = max(HOT_ROWS, -(-rows.count() // HOT_KEYS))
        hot = rows.groupBy("th").count().where(F.col("count") > least).join(bad.withColumn("bad", F.lit(True)), "th", "left").select("th", "bad")
        warm = rows.join(F.broadcast(hot), "th").where("bad is null").select("row")
        cold = rows.join(F.broadcast(hot.select("th")), "th", "left_anti").join(bad, "th", "left_anti").select("row")
        return warm.unionByName(cold).select(*(F.col("row")[c].alias(c) for c in docs.columns))
    texts = sorted(r.text for r in bench.collect())
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([0] * len(shared.value), shared.value)
        for batch in batches:
            data, offs = kernel.text_buffers(batch.column(place))
            keep = np.ones(batch.num_rows, bool)
            for i, j in kernel.slices(offs):
                keep[[i + r for r, *_ in items.matches(*tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))]] = False
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(kept.columns[:own], names=kept.schema.names[:own])

    own = len(docs.columns)
    rows, place = with_text(docs)
    return rows.mapInArrow(run, docs.schema)


def _keys(who: str, distinct: bool):
    """Rows (key, who) of windows; documents send those of every width an item can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = kernel.text_buffers(batch.column("text"))
            ids = np.asarray(batch.column(who))
            for i, j in kernel.slices(offs):
                kind, value, first, opener = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                size = np.diff(first)
                for width in range(3, WINDOW + 1):
                    h, _, row = windows(kind, value, first, width, opener)
                    if not distinct:  # an item has windows of one width
                        right = np.minimum(size[row], WINDOW) == width
                        h, row = h[right], row[right]
                    key = kernel.mix(h + np.uint64(width)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[i + row])], ["key", who])
                h, _, row = seeds(kind, value, first, opener if distinct else None)
                yield pa.RecordBatch.from_arrays([pa.array(kernel.mix(h + np.uint64(1 << 32)).view(np.int64)), pa.array(ids[i + row])], ["key", who])

    return run


def _joined(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The way for a benchmark of any size: a shuffled join of window hashes, then the texts of the pairs it proposes.

    A window that many documents have (KEY_DOCS or more) is spread over tasks
    by document, and its items are sent to each of these.
    """
    docs, bench = docs.withColumn("d", F.xxhash64("doc_id", "text")), bench.withColumn("b", F.xxhash64("item_id", "text"))
    right = cut(bench.select("b", "text").mapInArrow(_keys("b", False), "key long, b long").distinct())
    left = docs.select("d", "text").mapInArrow(_keys("d", True), "key long, d long")
    left = cut(left.join(right.select("key").distinct(), "key", "left_semi").distinct())
    spread = left.groupBy("key").agg(F.ceil(F.count("*") / KEY_DOCS).alias("parts"))
    right = right.join(spread, "key").select("key", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts")
    many = F.broadcast(spread.where("parts > 1"))
    left = left.join(many, "key", "left").select("key", "d", F.pmod(F.xxhash64("d"), F.coalesce("parts", F.lit(1))).alias("part"))
    pairs = left.join(right.drop("parts"), ["key", "part"]).select("d", "b").distinct()
    pairs = pairs.join(docs.dropDuplicates(["d"]).select("d", "doc_id", "text"), "d").join(bench.select("b", "item_id", F.col("text").alias("item")), "b").select("doc_id", "text", "item_id", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, item_id, item in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data, offs = kernel.text_buffers(pa.array([text], pa.string()))
                out += [(doc_id, item_id, *rest) for _, _, *rest in Items([item_id], [item]).matches(*tokens(data, offs))]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(5)], ["doc_id", "item_id", "n_matched", "n_slots", "n_changed"])

    return pairs.mapInArrow(run, SCHEMA)

