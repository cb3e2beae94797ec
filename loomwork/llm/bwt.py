"""Substring dedup over bytes by a column-wise built collection BWT with common prefixes.

The routing module turns the corpus into buckets of short strings in which
every repeat lies whole. For each bucket the Burrows-Wheeler transform of the
collection is built a column at a time: round j puts the j-th symbol from the
right of every string into the transform, and beside it the length of the
prefix that its suffix shares with the row before. Both are files, read
forward in chunks: one pass finds the rows and common prefixes of what is new,
a second writes the files of the next round. Runs of rows with long common
prefixes are the repeats.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel, rlz, routing

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
#: Rows of a file that are in memory at a time.
CHUNK = 1 << 18


def range_min(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of x[left..right], both ends included, for each pair."""
    out = np.empty(len(left), x.dtype)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    long = np.flatnonzero(level > 6)
    np.minimum(level, 6, out=level)
    table = x
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[left[own]], table[right[own] - (1 << k) + 1])
        if k < 6:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    if len(long):
        # Between the first and the last 64 places, whole blocks of 64.
        blocks = x[: len(x) // 64 * 64].reshape(-1, 64).min(axis=1)
        first, last = (left[long] + 63) // 64, (right[long] + 1) // 64 - 1
        some = np.flatnonzero(first <= last)
        first, last, long = first[some], last[some], long[some]
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in range(int(level.max(initial=-1)) + 1):
            own = np.flatnonzero(level == k)
            out[long[own]] = np.minimum(out[long[own]], np.minimum(blocks[first[own]], blocks[last[own] - (1 << k) + 1]))
            blocks = np.minimum(blocks[: -(1 << k)], blocks[1 << k :])
    return out


class _Files:
    """The transform and its common prefixes as two files, and the two of the next round."""

    def __init__(self, stack: ExitStack, folder: str, symbol: np.dtype, prefix: np.dtype):
        self.held = [[stack.enter_context(open(os.path.join(folder, f"{name}{i}"), "w+b", 0)) for name in ("bwt", "lcp")] for i in (0, 1)]
        self.kinds, self.now = (symbol, prefix), 0

    def start(self, symbols: np.ndarray) -> None:
        symbols.tofile(self.held[0][0])
        np.zeros(len(symbols), self.kinds[1]).tofile(self.held[0][1])

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, symbols, common prefixes), forward through both files."""
        a, b = self.held[self.now]
        a.seek(0)
        b.seek(0)
        at = 0
        while len(x := np.fromfile(a, self.kinds[0], CHUNK)):
            yield at, x, np.fromfile(b, self.kinds[1], CHUNK)
            at += len(x)

    def rewrite(self, parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> None:
        a, b = self.held[1 - self.now]
        for x in (a, b):
            x.seek(0)
            x.truncate()
        for x, y in parts:
            x.tofile(a)
            y.tofile(b)
        self.now = 1 - self.now


def transform(symbols: np.ndarray, offs: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The BWT of strings of symbols >= 1, and for each row the common prefix of its suffix and that of the row before.

    String k ends with its own mark, the k-th smallest symbol; a row that
    stands before a whole string holds 0. The k-th c in the transform stands
    before the suffix whose row is the k-th of those that begin with c, and
    two neighbours among these share one symbol more than all rows between
    their places now. So a round reads, for each new suffix and for the one
    behind it, the least common prefix since the symbol came last.
    """
    n, lens = len(offs) - 1, np.diff(offs)
    sigma = int(symbols.max(initial=0)) + 1
    longest = int(lens.max(initial=0))
    last = np.zeros(n, symbols.dtype)
    some = lens > 0
    last[some] = symbols[offs[1:][some] - 1]
    with ExitStack() as stack:
        files = _Files(stack, folder, symbols.dtype, np.min_scalar_type(longest + 1))
        files.start(last)
        at = who = np.flatnonzero(some)
        counts = np.bincount(last, minlength=sigma)
        for j in range(1, longest + 1):
            new, after = _ranked(files, at, n, counts)
            order = np.argsort(new[0], kind="stable")
            row, shared, who = new[0][order], new[1][order], who[new[2][order]]
            head = np.zeros(len(who), symbols.dtype)
            more = lens[who] > j
            head[more] = symbols[offs[1:][who[more]] - j - 1]
            order = np.argsort(after[0], kind="stable")
            files.rewrite(_merged(files, int(counts.sum()), row, head, shared, after[0][order], after[1][order]))
            counts += np.bincount(head, minlength=sigma)
            at, who = row[more], who[more]
        parts = [(x, y) for _, x, y in files.chunks()]
    if not parts:
        return last, np.zeros(0, files.kinds[1])
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _ranked(files: _Files, at: np.ndarray, n: int, counts: np.ndarray):
    """One pass: (row, common prefix, number in `at`) of each new suffix, and (row, common prefix) of those behind one."""
    sigma = len(counts)
    first = np.cumsum(counts) - counts - counts[0] + n
    seen, least, pending = np.zeros(sigma, np.int64), np.zeros(sigma, np.int64), np.zeros(sigma, bool)
    new, after = [], []
    for begin, symbol, shared in files.chunks():
        size = len(symbol)
        lo, hi = np.searchsorted(at, [begin, begin + size])
        active = np.zeros(size, bool)
        active[at[lo:hi] - begin] = True
        order = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[order]
        start = np.searchsorted(sorted_symbol, np.arange(sigma + 1))
        start, count = start[:-1], np.diff(start)
        # New suffixes, and those behind one among the suffixes that begin with the same symbol.
        here = active[order]
        k = np.flatnonzero(here)
        behind = k[k + 1 < size] + 1
        behind = behind[sorted_symbol[behind] == sorted_symbol[behind - 1]]
        asked = here.copy()
        asked[behind] = True
        asked[start[pending & (count > 0)]] = True
        k = np.flatnonzero(asked)
        c, place = sorted_symbol[k], order[k]
        opening = k == start[c]
        # Asked with them for each symbol: the least common prefix behind its last place, for the next chunk.
        has = np.flatnonzero(count)
        latest = order[start[has] + count[has] - 1]
        inner = latest + 1 < size
        value = range_min(shared, np.concatenate([np.where(opening, 0, order[np.maximum(k - 1, 0)] + 1), latest[inner] + 1]), np.concatenate([place, np.full(int(inner.sum()), size - 1)])).astype(np.int64)
        value, carried = value[: len(k)], value[len(k) :]
        value = np.where(opening, np.minimum(value, least[c]), value) + 1
        rank = seen[c] + k - start[c]
        value[rank == 0] = 0
        row = first[c] + rank
        own = here[k]
        new.append((row[own], value[own], lo + np.searchsorted(at[lo:hi], place[own] + begin)))
        after.append((row[~own], value[~own]))
        # What the next chunk has to know of each symbol: that prefix, and whether its last place was that of a new suffix.
        least = np.minimum(least, int(shared.min()))
        least[has], pending[has] = 1 << 40, active[latest]
        least[has[inner]] = carried
        seen += count
    return tuple(np.concatenate(x) for x in zip(*new, strict=True)), tuple(np.concatenate(x) for x in zip(*after, strict=True))


def _merged(files: _Files, total: int, row: np.ndarray, head: np.ndarray, shared: np.ndarray, row_after: np.ndarray, shared_after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The other pass: the old rows in order with the new ones between, and common prefixes that those change."""
    before = row - np.arange(len(row))
    done = 0
    for begin, x, y in files.chunks():
        until = int(np.searchsorted(before, begin + len(x))) if begin + len(x) < total else len(row)
        into = before[done:until] - begin
        x, y = np.insert(x, into, head[done:until]), np.insert(y, into, shared[done:until])
        a, b = np.searchsorted(row_after, [begin + done, begin + done + len(x)])
        y[row_after[a:b] - begin - done] = shared_after[a:b]
        done = until
        yield x, y


def build(symbols: np.ndarray, offs: np.ndarray, folder: str) -> np.ndarray:
    """The transform alone."""
    return transform(symbols, offs, folder)[0]


def suffix_rows(bwt: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Row of each suffix: entry [j, k] for the j last symbols of string k; -1 if there is none."""
    step = np.empty(len(bwt), np.int32)
    step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    out = np.full((int(lens.max(initial=0)) + 1, len(lens)), -1, np.int32)
    out[0] = np.arange(len(lens))
    for j in range(1, len(out)):
        who = np.flatnonzero(lens >= j)
        out[j, who] = step[out[j - 1, who]]
    return out


def resolve(flat: np.ndarray, lens: np.ndarray, docs: np.ndarray, length: int):
    """Runs of windows that start in a smaller doc_id as well."""
    offs = np.concatenate([[0], np.cumsum(lens)])
    used = np.zeros(256, bool)
    used[flat] = True
    code = np.cumsum(used)
    symbols = code.astype(np.uint16 if used.all() else np.uint8)[flat]
    # The task's own folder: it goes with the task, and a task that is done again makes its own.
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = transform(symbols, offs, folder)
    rows = suffix_rows(bwt, lens)
    n_windows = np.maximum(0, lens - length + 1)
    seg = np.repeat(np.arange(len(lens)), n_windows)
    if not len(seg):
        return (np.empty(0, np.int64),) * 3
    where = kernel.spread(offs[:-1], n_windows)
    # Rows whose common prefixes are long enough all along begin with the same `length` symbols.
    group = np.cumsum(lcp < length)
    order = np.full(len(bwt), -1, np.int32)
    order[rows[offs[1:][seg] - where, seg]] = np.arange(len(seg), dtype=np.int32)
    group, order = group[order >= 0], order[order >= 0]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[seg[order]], first)[np.cumsum(new) - 1]
    hit = np.zeros(len(seg), bool)
    hit[order] = least < docs[seg[order]]
    return rlz.hit_runs(hit, n_windows)


def finish(table: pa.Table, offs: np.ndarray, covered: np.ndarray) -> pa.Table:
    data, _ = kernel.text_buffers(table["text"])
    gone = np.concatenate([[0], np.cumsum(covered)])
    removed = gone[offs[1:]] - gone[offs[:-1]]
    starts, _ = kernel.runs(covered, offs)
    spans = np.diff(np.searchsorted(starts, offs))
    kept = [data[a:b].tobytes() if not r else data[a:b][~covered[a:b]].tobytes() for a, b, r in zip(offs[:-1], offs[1:], removed, strict=True)]
    sha = [hashlib.sha256(x).hexdigest() for x in kept]
    return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(offs)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())})


def dedup_bytes(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove the bytes covered by a `length`-byte string that starts in a smaller doc_id too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary:
    what stays may not be UTF-8), a row for each row of docs (doc_id, text;
    other columns, whatever their names, are ignored). Null text is empty; an
    empty table gives an empty one; texts of any length are read whole. A null
    doc_id counts as smaller than any other. Rows with one doc_id never remove
    each other's bytes, so of tied copies under one id all stay; repeated rows
    get equal results.
    """
    return routing.repeated(docs, False, length, min(22, length), resolve, finish, SCHEMA)
