"""Substring dedup by relative Lempel-Ziv parsing over words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel, routing

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


class Index:
    """The reference: for each distinct run of `length` words its place in the smallest doc_id."""

    def __init__(self, flat: np.ndarray, key: np.ndarray, where: np.ndarray, seg: np.ndarray, docs: np.ndarray, length: int):
        order = np.lexsort((docs[seg], key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        first = order[new]
        self.flat, self.steps = flat, np.arange(length)
        self.key, self.at, self.seg, self.doc = key[first], where[first], seg[first], docs[seg[first]]

    def find(self, key: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For runs (hash, place, doc_id) the entry of an earlier document that has the same words, or -1."""
        entry = np.searchsorted(self.key, key)
        out = np.full(len(entry), -1, np.int64)
        some = np.flatnonzero(self.doc[entry] < doc)
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            # The index proposes by hash; the words decide.
            same = (self.flat[at[part][:, None] + self.steps] == self.flat[self.at[entry[part]][:, None] + self.steps]).all(axis=1)
            out[part[same]] = entry[part[same]]
        return out


def parse(flat: np.ndarray, lens: np.ndarray, docs: np.ndarray, length: int):
    """Factor every segment greedily against the segments of smaller doc_ids.

    All segments are parsed in step. At its place a segment looks the run of
    `length` words that starts there up in the index of the reference block;
    if an earlier document has it, the factor is extended for as long as both
    agree, and the parse goes on behind it; else one word is a literal.
    Duplicate spans are the factors, and at their ends the runs that cross
    into what follows, each looked up by itself: a repeat that a greedy factor
    cuts is found there.
    """
    offs = np.concatenate([[0], np.cumsum(lens)])
    n_windows = np.maximum(0, lens - length + 1)
    first_window = np.cumsum(n_windows) - n_windows
    where = kernel.spread(offs[:-1], n_windows)
    if not len(where):
        return (np.empty(0, np.int64),) * 3
    seg = np.repeat(np.arange(len(lens)), n_windows)
    key = kernel.Prefix(flat).grams(length)[where]
    index = Index(flat, key, where, seg, docs, length)
    end = offs[1:]
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    place = np.zeros(len(lens), np.int64)
    active = np.flatnonzero(n_windows > 0)
    while len(active):
        window = first_window[active] + place[active]
        entry = index.find(key[window], where[window], docs[active])
        found = entry >= 0
        place[active[~found]] += 1
        who, window, entry = active[found], window[found], entry[found]
        here, there = where[window] + length, index.at[entry] + length
        stop, stop_there = end[who], end[index.seg[entry]]
        size = np.full(len(who), length, np.int64)
        going = np.arange(len(who))
        while len(going):
            ok = (here[going] < stop[going]) & (there[going] < stop_there[going])
            going = going[ok]
            going = going[flat[here[going]] == flat[there[going]]]
            here[going] += 1
            there[going] += 1
            size[going] += 1
        behind = window + size - length + 1
        spans.append((window, behind))
        left = first_window[who] + n_windows[who]
        check = kernel.spread(behind, np.clip(left - behind, 0, length - 1))
        check = check[index.find(key[check], where[check], docs[seg[check]]) >= 0]
        spans.append((check, check + 1))
        place[who] += size
        active = active[place[active] < n_windows[active]]
    return hit_runs(kernel.cover(len(where), *(np.concatenate(x) for x in zip(*spans, strict=True))), n_windows)


def hit_runs(hit: np.ndarray, n_windows: np.ndarray):
    """Runs of marked windows as (segment, first, last), sorted by segment."""
    offs = np.concatenate([[0], np.cumsum(n_windows)])
    starts, ends = kernel.runs(hit, np.unique(offs))
    seg = np.searchsorted(offs, starts, "right") - 1
    return seg, starts - offs[seg], ends - 1 - offs[seg]


def finish(table: pa.Table, offs: np.ndarray, covered: np.ndarray) -> pa.Table:
    gone = np.concatenate([[0], np.cumsum(covered)])
    removed = gone[offs[1:]] - gone[offs[:-1]]
    sha, kept = [], []
    for i, text in enumerate(table["text"]):
        own = text.as_buffer().to_pybytes().split() if text.is_valid else []
        if removed[i]:
            own = [own[k] for k in np.flatnonzero(~covered[offs[i] : offs[i + 1]])]
        own = b" ".join(own)
        kept.append(own)
        sha.append(hashlib.sha256(own).hexdigest())
    return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(np.diff(offs)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string(), safe=False)})


def dedup_substrings(docs: DataFrame, length: int = 13) -> DataFrame:
    """Remove the words covered by a `length`-word run that starts in a smaller doc_id too.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept_text, a row for
    each row of docs (doc_id, text; other columns, whatever their names, are
    ignored). Null and empty texts have no words, and an empty table gives an
    empty one; texts of any length and words of any length are read whole, and
    their bytes are compared. A null doc_id counts as smaller than any other.
    Rows with one doc_id never remove each other's words, so of tied copies
    under one id all stay; repeated rows get equal results.
    """
    return routing.repeated(docs, True, length, min(5, length), parse, finish, SCHEMA)
