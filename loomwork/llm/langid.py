"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .session import with_text

#: Cells of the hash table, characters per n-gram, and the pseudo-count of a cell.
CELLS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: Bytes of a model's matrix at most: beyond 2,048 languages its cells are added up by pairs, fours and so on.
MODEL_BYTES = 1 << 28
#: Pieces in which the counts of a language are summed.
PIECES = 8
UNKNOWN = "und"


@cache
def _folded() -> np.ndarray:
    """Lower case of each letter of the basic plane, a space for everything else."""
    return np.array([0x20 if not chr(i).isalpha() else ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32)


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and their offsets per row."""
    text = data.tobytes().decode("utf-8", "surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    if at[-1] != len(points):  # not UTF-8 throughout: count row by row
        at = np.concatenate([[0], np.cumsum([len(data[a:b].tobytes().decode("utf-8", "surrogateescape")) for a, b in zip(offs[:-1], offs[1:], strict=True)])])
        points = np.concatenate([np.frombuffer(data[a:b].tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32) for a, b in zip(offs[:-1], offs[1:], strict=True)])
    low = points < 1 << 16
    if low.all():
        return _folded()[points], at
    # Beyond the basic plane: letters as they are, told apart by their own table.
    high, back = np.unique(points[~low], return_inverse=True)
    out = np.empty(len(points), np.uint32)
    out[low] = _folded()[points[low]]
    out[~low] = np.array([ord(c.lower()) if (c := chr(x)).isalpha() and len(c.lower()) == 1 else 0x20 for x in high.tolist()], np.uint32)[back]
    return out, at


def cells(points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the cells of all n-grams and their offsets per row: the high bits of a hash, so that neighbours can be added up."""
    many = np.diff(at)
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x9E3779B1)
        if n not in ORDERS:
            continue
        h ^= h >> np.uint32(15)
        per_row = np.maximum(0, many - n + 1)
        inside = np.ones(len(h), bool)
        ends = at[1:]
        for back in range(1, n):
            cut = ends - back
            cut = cut[(cut >= at[:-1]) & (cut < len(h))]
            inside[cut] = False
        cell = (h[inside] * np.uint32(0x85EBCA77)) >> np.uint32(32 - CELLS.bit_length() + 1)
        yield cell.astype(np.int32), np.concatenate([[0], np.cumsum(per_row)])


def learned(batches: Iterator[pa.RecordBatch], fold: int = 1) -> Iterator[pa.RecordBatch]:
    """n-gram counts (over `fold` neighbouring cells) and row counts by language, summed over a partition."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offs = kernel.text_buffers(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for i, j in kernel.slices(offs):
            for lang in langs[i:j]:
                counts.setdefault(lang, np.zeros(CELLS // fold + 1, np.int64))[-1] += 1
            names = sorted(set(langs[i:j]))
            which = np.searchsorted(names, langs[i:j])
            for cell, at in cells(*characters(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])):
                own = np.bincount(cell // fold + np.repeat(which * (CELLS // fold), np.diff(at)), minlength=len(names) * CELLS // fold).reshape(-1, CELLS // fold)
                for name, x in zip(names, own, strict=True):
                    counts[name][:-1] += x
    rows = [(lang, p, zlib.compress(x.tobytes(), 1)) for lang, all_ in counts.items() for p, x in enumerate(np.array_split(all_, PIECES))]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())], ["lang", "piece", "counts"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the pieces that one partition of a language and piece holds."""
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for lang, piece, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            x = np.frombuffer(zlib.decompress(blob), np.int64)
            total[lang, piece] = total[lang, piece] + x if (lang, piece) in total else x
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["lang", "piece", "counts"])


@dataclass
class Model:
    langs: list[str]
    #: log P(cell | language), cells by languages, and log P(language).
    table: np.ndarray
    prior: np.ndarray


def train(rows: DataFrame) -> Model:
    """A model of rows (text, lang); those without a text or lang teach nothing.

    The driver gets one row of counts per language and piece, and the matrix
    that is broadcast has MODEL_BYTES bytes at most however many languages
    there are: their number is counted first, and fewer cells are kept of each
    if they are many. Repeated rows count each time; texts are read whole.
    """
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    fold = 1
    if (n := rows.select("lang").distinct().count()) * CELLS * 4 > MODEL_BYTES:
        fold = 1 << (n * CELLS * 4 // MODEL_BYTES).bit_length()

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return learned(batches, fold)

    parts = rows.mapInArrow(fewer, "lang string, piece int, counts binary").repartition("lang", "piece").mapInArrow(summed, "lang string, piece int, counts binary").collect()
    langs = sorted({r.lang for r in parts})
    counts = {lang: np.concatenate([np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64) for r in sorted(parts, key=lambda r: r.piece) if r.lang == lang]) for lang in langs}
    if not langs:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros(0))
    grams = np.array([counts[x][:-1] for x in langs], float) + SMOOTHING
    docs = np.array([counts[x][-1] for x in langs], float)
    return Model(langs, np.ascontiguousarray(np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)), np.log(docs / docs.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, the probability of that language.

    Null and empty texts and texts without a letter get `und` and 0, as all do
    if the model has learned nothing. Ties go to the first language by name.
    Texts are read whole, however long; equal texts get equal results, repeated
    rows stay rows, an empty table gives an empty one. Columns `lang_pred` and
    `score` of docs are replaced; other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        fold = CELLS // len(model.table)
        for batch in batches:
            data, offs = kernel.text_buffers(batch.column(place))
            best, score = [], []
            for i, j in kernel.slices(offs):
                points, at = characters(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                letters = np.concatenate([[0], np.cumsum(points != 0x20)])[at]
                some = np.diff(letters) > 0
                total = np.tile(model.prior, (j - i, 1))
                for cell, cut in cells(points, at):
                    cell, filled = cell // fold, np.flatnonzero(np.diff(cut))
                    for x in range(len(model.langs)) if len(filled) else ():
                        total[filled, x] += np.add.reduceat(model.table[:, x][cell], cut[filled], dtype=np.float64)
                if model.langs:
                    top = total.argmax(axis=1)
                    weight = np.exp(total - total.max(axis=1, keepdims=True))
                    best.append(np.where(some, np.array(model.langs, object)[top], UNKNOWN))
                    score.append(np.where(some, 1 / weight.sum(axis=1), 0.0))
                else:
                    best.append(np.full(j - i, UNKNOWN, object))
                    score.append(np.zeros(j - i))
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(np.concatenate(best) if best else [], pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], [*batch.schema.names[:own], "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    own = len(kept.columns)
    texts, place = with_text(kept)
    return texts.mapInArrow(run, schema)


def held_out(column, parts: int, which: int):
    """crc32 of the column as text, modulo parts, is `which`; null counts as held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts == which, F.lit(True))


__all__ = ["Model", "held_out", "predict", "train"]
