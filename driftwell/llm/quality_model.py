"""A quality classifier by naive-Bayes support vectors.

Features are indicators of word n-grams (one and two words), of the same n-grams over word
shapes, and of repetition (a word like the one before; the share of distinct words).  They are hashed to ``SLOTS`` slots, scaled by
the log-count ratio of the two classes, and divided by the root of their number; a linear hinge loss is fitted
by dual coordinate descent, and a logistic curve on a part left out of the fit turns margins into scores.

The fit uses a bounded sample, at most ``SAMPLE_DOCS`` labelled documents picked by a hash of the id; the
weights are ``SLOTS`` numbers whatever the input.  The driver holds a document's slots as a list or, if that is longer, as a bitmap of
``SLOTS`` bits, so 128 MB at most.  Every text is scored whole, however long.

Defined results: null and empty texts have the feature "no words" only; a doc_id with labels that contradict each other
evenly, or null labels only, is not learned from; of several texts of one id the one with the smallest list of slots is, so a fit can be repeated;
without labels of both classes every score is 0.5; repeated rows score alike; an empty table gives an empty table; input
columns named like a result (in any case) are replaced, all others come back whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, mix, multipliers, positional, sql_name

SLOTS = 1 << 18
SAMPLE_DOCS = 4000
COST, EPOCHS = 1.0, 12
THRESHOLD = 0.3
_M = multipliers(6, 31)
_SHAPE = bytes(0x41 if 65 <= c <= 90 else 0x61 if 97 <= c <= 122 or c >= 128 else 0x30 if 48 <= c <= 57 else c for c in range(256))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(sql_name(id_col)).cast("string")) % 5 == 0, F.lit(False))


def _shape(word: bytes) -> bytes:
    """Its classes of characters, runs shortened to two."""
    out = bytearray()
    for c in word.translate(_SHAPE):
        if out[-2:] != bytes((c, c)):
            out.append(c)
    return bytes(out)


class Features:
    """Slots of a text; caches of words are bounded."""

    def __init__(self) -> None:
        self.hash, self.shapes = WordHash(), {}
        self.shape_hash = WordHash()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.split() if text else []
        n = len(words)
        if not n:
            return np.zeros(1, np.int64)
        if len(self.shapes) > WordHash.LIMIT:
            self.shapes.clear()
        shapes = self.shapes
        for w in set(words):
            if w not in shapes:
                shapes[w] = _shape(w)
        h = self.hash(words)
        s = self.shape_hash(list(map(shapes.__getitem__, words)))
        same = int(round(10 * float((h[1:] == h[:-1]).mean()))) if n > 1 else 0
        distinct = int(10 * len(np.unique(h)) / n)
        marks = np.array([1 + same, 20 + distinct, 40 + min(n.bit_length(), 20)], np.uint64)
        parts = [h * _M[0], h[:-1] * _M[1] + mix(h[1:] * _M[2]), s * _M[3], s[:-1] * _M[4] + mix(s[1:] * _M[5]), mix(marks)]
        return np.unique(mix(np.concatenate(parts)) % np.uint64(SLOTS)).astype(np.int64)


def _stored(slots: np.ndarray) -> bytes:
    """A list of slots, or a bitmap where that is shorter; the length tells them apart."""
    if 4 * len(slots) < SLOTS // 8:
        return slots.astype("<i4").tobytes()
    bits = np.zeros(SLOTS, bool)
    bits[slots] = True
    return np.packbits(bits).tobytes()


class Rows:
    """The slots of the sample's documents, unpacked one at a time."""

    def __init__(self, stored: list[bytes]):
        self.stored = stored

    def __len__(self) -> int:
        return len(self.stored)

    def __getitem__(self, i: int) -> np.ndarray:
        data = self.stored[i]
        return np.frombuffer(data, "<i4") if len(data) < SLOTS // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def descend(rows: Rows | list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is a feature that is always 1."""
    w, bias = np.zeros(len(ratio)), 0.0
    value = lambda r: ratio[r] / np.sqrt(len(r))
    norm = np.array([float(v @ v) + 1.0 for v in (value(rows[i]) for i in range(len(rows)))])
    balance = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * cost
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            r = rows[i]
            v = value(r)
            slope = y[i] * (float(w[r] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), balance[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[r] += step * v
                bias += step
    return w * ratio, bias


def _curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's steps with smoothed targets."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        q = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def learn(rows: Rows | list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by slot and a bias; a text's score is the logistic of bias + sum of weights / root of features."""
    if good.all() or not good.any():
        return np.zeros(SLOTS, np.float32), 0.0
    aside = np.arange(len(rows)) % 5 == 4
    if not (good[aside].any() and not good[aside].all() and good[~aside].any() and not good[~aside].all()):
        aside = np.zeros(len(rows), bool)
    use = np.flatnonzero(~aside)
    y = np.where(good[use], 1.0, -1.0)
    p, q = np.ones(SLOTS), np.ones(SLOTS)
    for i in use:
        (p if good[i] else q)[rows[i]] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    w, bias = descend(Rows([rows.stored[i] for i in use]) if isinstance(rows, Rows) else [rows[i] for i in use], y, ratio)
    calibrate = np.flatnonzero(aside) if aside.any() else use
    margin = np.array([w[rows[i]].sum() / np.sqrt(len(rows[i])) + bias for i in calibrate])
    a, b = _curve(margin, good[calibrate])
    return (a * w).astype(np.float32), float(a * bias + b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Learns from the labelled rows of ``docs`` as given."""
    given, known = positional(docs), positional(labels)
    marks = known.frame.select(known[id_col].alias("_id"), known[label_col].cast("double").alias("y")).dropna()
    marks = marks.groupBy("_id").agg(F.avg("y").alias("y")).filter("y <> 0.5")
    ids = given.frame.select(given[id_col].alias("_id")).distinct()
    marks = marks.join(ids.hint("merge"), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    held = given.frame.select(given[id_col].alias("_id"), given[text_col].cast("binary").alias("_text"))
    # the broadcast side has at most sample_docs rows of two numbers
    picked = held.join(F.broadcast(marks), "_id").select("_id", "y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            slots = [_stored(of(x.as_py())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(slots, pa.binary())], names=["id", "y", "slots"])

    rows = picked.mapInArrow(run, "id string, y double, slots binary").groupBy("id").agg(F.min("y").alias("y"), F.min("slots").alias("slots")).toArrow()
    order = np.argsort(np.array([hash_of(x) for x in rows.column("id").to_pylist()], np.uint64), kind="stable")
    slots = rows.column("slots").to_pylist()
    good = np.asarray(rows.column("y").to_numpy()) > 0.5
    return learn(Rows([slots[i] for i in order]), good[order])


def hash_of(x: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with score and predicted."""
    rows = positional(docs, ["score", "predicted"], [text_col])
    src = rows.frame.select(rows.row(), rows[text_col].cast("binary").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        w, bias = shared.value
        for batch in batches:
            margin = np.empty(batch.num_rows)
            for i, x in enumerate(batch.column(1)):
                slots = of(x.as_py())
                margin[i] = w[slots].sum(dtype=np.float64) / np.sqrt(len(slots)) + bias
            score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["_row", "score", "predicted"])

    return rows.back(src.mapInArrow(run, src.select("_row").schema.add("score", "double").add("predicted", "integer")), "score", "predicted")
