"""Quality by compression: whether dictionaries of good or of bad texts make a text smaller.

Each class has several zstandard dictionaries, for kinds of text (languages,
sorts of junk) that one dictionary would blur. A text is compressed in short
pieces, all of them, so that it can't make up for a wrong dictionary by its own
beginning. The normalised difference between the best dictionary of either
class carries the score; what the text's own redundancy and length add to it
is calibrated by logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .session import with_text

LEVEL = 3
#: Documents with this score or more are kept.
KEEP = 0.3
#: Dictionaries of a class, bytes of each, and bytes of the pieces that texts are compressed in.
KINDS, DICTIONARY_BYTES, CHUNK = 6, 16_384, 512
#: Texts that kinds are told from, bytes of each, and rounds of telling them.
KIND_DOCS, KIND_BYTES, ROUNDS = 1000, 2000, 3
#: Bytes that each frame adds to its content.
_FRAME = 5
#: Labelled documents of each class that the model is fitted on at most, and bytes of each that dictionaries are made from.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 8000
#: Longer texts give so many pieces to the dictionaries, spread evenly from the first byte to the last.
PIECES = 8


@dataclass
class Model:
    good_kinds: list[bytes]
    bad_kinds: list[bytes]
    weights: np.ndarray
    #: The score where nothing can be told: the share of good documents in training.
    base: float

    @property
    def good(self) -> bytes:
        """The dictionaries of good texts, one behind the other."""
        return b"".join(self.good_kinds)

    @property
    def bad(self) -> bytes:
        return b"".join(self.bad_kinds)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def _dictionaries(samples: list[bytes], kinds: int = KINDS) -> list[bytes]:
    """Dictionaries of a class: texts go to the one that makes them smallest, and each is trained again on its own.

    The first kinds are begun by texts that those before make least smaller.
    Kinds are told from KIND_DOCS texts; all samples go to one of them in the end.
    """
    short = [_pieces(x, KIND_BYTES) for x in samples]
    some = [x for x in short[:KIND_DOCS] if len(x) >= 200]
    if len(some) < 8 * kinds:
        return [_dictionary(samples)]
    sizes, seed = [], 0
    for _ in range(kinds):
        c = _compressor(some[seed])
        sizes.append([len(c.compress(x)) / len(x) for x in some])
        seed = int(np.min(sizes, axis=0).argmax())
    who = np.argmin(sizes, axis=0)
    for _ in range(ROUNDS):
        held = [_dictionary(own) for k in range(kinds) if (own := [x for x, w in zip(some, who, strict=True) if w == k])]
        who = _nearest(held, some)
    who = _nearest(held, short)
    return [_dictionary(own) for k in range(len(held)) if (own := [x for x, w in zip(samples, who, strict=True) if w == k])]


def _nearest(dictionaries: list[bytes], texts: list[bytes]) -> np.ndarray:
    return np.argmin([[len(c.compress(x)) for x in texts] for c in map(_compressor, dictionaries)], axis=0)


class Sizes:
    """Compressed sizes under the dictionaries of each class, in pieces, and of the whole text under none."""

    def __init__(self, good: list[bytes], bad: list[bytes]):
        self.by = [[_compressor(x) for x in own] for own in (good, bad)]
        self.bare = _compressor(b"")

    def features(self, texts: list[bytes]) -> np.ndarray:
        """1, normalised difference of sizes, size under both as a share of the text, log length, and products."""
        n = np.array([len(x) for x in texts], float)
        sizes = np.zeros((2, len(texts)))
        for i, text in enumerate(texts):
            pieces = [text[at : at + CHUNK] for at in range(0, len(text), CHUNK)]
            for k, own in enumerate(self.by):
                sizes[k, i] = min(sum(len(c.compress(x)) for x in pieces) for c in own) - _FRAME * len(pieces)
        good, bad = sizes
        bare = np.array([len(self.bare.compress(x)) for x in texts], float)
        length = np.maximum(n, 1)
        d = (bad - good) / np.maximum(np.maximum(good, bad), 1)
        return np.stack([np.ones(len(n)), d, np.minimum(good, bad) / length, bare / length, np.log1p(n), d * np.log1p(n), (bare / length) * np.log1p(n), (bare / length) ** 2, d * np.abs(d)], axis=1)


def _pieces(text: bytes, most: int = 0) -> bytes:
    """The text, or SAMPLE_BYTES bytes of it (or as many as told) in PIECES pieces."""
    most = most or SAMPLE_BYTES
    if len(text) <= most:
        return text
    size = most // PIECES
    return b"".join(text[at : at + size] for at in ((len(text) - size) * k // (PIECES - 1) for k in range(PIECES)))


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = pa.array([_pieces(x.as_buffer().to_pybytes()) for x in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], cut], batch.schema.names)


def _measure(make):
    """Rows (doc_id, quality, h, x): the features of whole texts under the dictionaries of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries, half = make()
        sizes = [Sizes(*d) for d in dictionaries]
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            x = [sizes[1 - half[key]].features([text.as_buffer().to_pybytes()])[0].tolist() for key, text in zip(keys, batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "h", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * s[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most SAMPLE_DOCS rows of each class of labels (doc_id, quality), least hashes of doc_id first.

    Dictionaries are built from one half of the sample and weights from the
    other, then the other way round, so that sizes to calibrate on come from
    texts no dictionary has seen; the final dictionaries use the whole sample.
    Of a text longer than SAMPLE_BYTES the dictionaries are given pieces from
    all over it; weights are fitted on whole texts, whose features are computed
    on the executors. Equal rows are in one half. Labels of null doc_ids, or
    other than 0 and 1, teach nothing; neither do documents with no text.
    Several rows of one doc_id teach each their text.
    """
    pick = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    ids = pick.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).unionAll(pick.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS))
    n_good, n_bad = (pick.where(f"quality = {q}").count() for q in (1, 0))
    base = n_good / (n_good + n_bad) if n_good + n_bad else 0.5
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    texts = texts.where("text != ''").select("doc_id", "quality", F.xxhash64("text").alias("h"), "text")
    key = "doc_id long, quality int, h long"
    rows = sorted((r.doc_id, r.quality, r.h, bytes(r.text)) for r in texts.mapInArrow(_shorten, f"{key}, text binary").collect())
    if len({q for _, q, _, _ in rows}) < 2 or len(rows) < 8:
        return Model([], [], np.zeros(0), base)
    half: dict[tuple, int] = {}
    for q in (0, 1):
        half |= {k: n % 2 for n, k in enumerate(sorted({r[:3] for r in rows if r[1] == q}))}
    by = {q: [t for _, k, _, t in rows if k == q] for q in (0, 1)}
    dictionaries = [tuple(_dictionaries([r[3] for r in rows if r[1] == q and half[r[:3]] == part]) for q in (1, 0)) for part in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast((dictionaries, half))
    measured = sorted((r.doc_id, r.quality, r.h, r.x) for r in texts.mapInArrow(_measure(lambda: shared.value), f"{key}, x array<double>").collect())
    x, y = np.array([r[3] for r in measured]), np.array([float(r[1]) for r in measured])
    weights = _logistic(x, y)
    # The sample has other shares than the labels: move the intercept to theirs.
    share = y.mean()
    if 0 < base < 1 and 0 < share < 1:
        weights[0] += np.log(base / (1 - base)) - np.log(share / (1 - share))
    return Model(_dictionaries(by[1]), _dictionaries(by[0]), weights, base)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, 0 to 1: how likely label 1 is, from whole texts.

    Null and empty texts have features like others (a null text is empty), long
    ones are compressed whole; equal texts have equal scores, and repeated rows
    stay rows. If the labels had one class or none, every score is the share of
    label 1 in them (0.5 if there were none). An empty table gives an empty
    one. A column `score` of docs is replaced; other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sizes = Sizes(model.good_kinds, model.bad_kinds) if len(model.weights) else None
        for batch in batches:
            got = np.full(batch.num_rows, model.base)
            if sizes:
                data, offs = kernel.text_buffers(batch.column(place))
                for i, j in kernel.slices(offs):
                    texts = [data[a:b].tobytes() for a, b in zip(offs[i:j], offs[i + 1 : j + 1], strict=True)]
                    got[i:j] = 1 / (1 + np.exp(-np.clip(sizes.features(texts) @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(got, pa.float64())], [*batch.schema.names[:own], "score"])

    kept = docs.drop("score")
    own = len(kept.columns)
    rows, place = with_text(kept)
    return rows.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))
