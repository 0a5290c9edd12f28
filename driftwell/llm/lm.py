"""Language-model scores by deleted interpolation.

A token's probability given the ``ORDER`` - 1 before it mixes maximum-likelihood estimates of every order: that of the trigram with what
bigram, word and one over V + 1 give, that of the bigram with the rest, and so on.  The weight of an order depends on how often its context was
seen (buckets by powers of two) and is learned by expectation-maximisation on held-out counts: each training n-gram is left out of the counts
that predict it (the deleted estimate), lower orders before higher ones.

Counts cover every training document.  Passes over packed chunks: (1) a chunk's distinct n-grams with
their counts go out by ranges of the key space, and the totals come back in the chunk's order (``exchange``); (2) each chunk writes its tokens' totals
of every order; (3) for each order a histogram of (context bucket, estimate, estimate of the lower orders), of bounded size whatever the input, with
the sums of both estimates, feeds EM on the driver; (4) each chunk scores its documents.  A word that a third of all text uses is
one key per chunk, so no task is hot.  Words are told apart by 64 bits, longer n-grams by 40 beyond their range.

Defined results: a null or empty text is its end token alone; a null id counts as training; repeated rows count as often as
they stand there; very long texts are one chunk and scored whole; with no training token the base score has N = V = 0 and the model gives
1 / (V + 1) = 1; columns named like a result (in any case) are replaced, all others come back whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import WordHash, ipc, mix, multipliers, pack, positional, release, stash, unpack

ORDER = 3
#: Context counts 0, 1, 2-3, 4-7, ... share weights.
BUCKETS = 20
#: Estimates are counted by so many steps of a power of ten for EM; the cell 0 is "not seen".  A cell has the sums of what it counts.
STEPS, CELLS = 20, 320
EM_ROUNDS = 60
#: Text whose keys make a range.
BUCKET_BYTES = 12 << 20
_B = multipliers(2, 21)
_END = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0xD1B54A32D192ED03)


def is_held_out(ids: list) -> np.ndarray:
    """crc32 of the id as text, modulo 7, is 2."""
    return np.array([x is not None and zlib.crc32(str(x).encode()) % 7 == 2 for x in ids], bool)


class _Chunk:
    """The tokens of a chunk's documents, end to end, and for each order its distinct n-grams and the number of each token's."""

    def __init__(self, table: pa.Table, order: int):
        self.held = is_held_out(table.column("id").to_pylist())
        one = WordHash()
        docs = [one(x.as_py().lower().split()) if x.is_valid else np.zeros(0, np.uint64) for x in table.column("text")]
        self.n = np.array([len(d) + 1 for d in docs], np.int64)
        ends = np.cumsum(self.n)
        tokens = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        rest = np.ones(len(tokens), bool)
        rest[ends - 1] = False
        tokens[~rest] = _END
        if len(docs):
            tokens[rest] = np.concatenate(docs)
        self.train = np.repeat(~self.held, self.n)
        self.keys, self.which = [], []
        grams, last = tokens, mix(tokens * _B[1])
        for k in range(order):
            if k:
                before = np.empty_like(grams)
                before[1:] = grams[:-1]
                before[ends - self.n] = _START
                grams = mix(before * _B[0] + last)
            keys, which = np.unique(grams, return_inverse=True)
            self.keys.append(keys)
            self.which.append(which)

    def counts(self) -> list[np.ndarray]:
        """Training counts of the chunk's n-grams, by order."""
        return [np.bincount(which[self.train], minlength=len(keys)) for keys, which in zip(self.keys, self.which, strict=True)]


class Counts(exchange.Question):
    """Totals of keys; kind is the order less one."""

    def pack(self, keys, values, width, kind):
        keys = exchange.pack_keys(keys, 8 if kind == 0 else width)
        return len(keys).to_bytes(4, "little") + keys + exchange.pack_numbers(values)

    def unpack(self, data, width, kind):
        n = int.from_bytes(data[:4], "little")
        return exchange.unpack_keys(data[4 : 4 + n], 8 if kind == 0 else width), exchange.unpack_numbers(data[4 + n :])

    def merge(self, parts):
        keys, place = exchange.merged_keys(parts)
        return keys, np.bincount(place, np.concatenate([v for _, v in parts]), len(keys)).astype(np.int64), place

    def whole(self, values):
        return values

    def pack_answers(self, answers):
        return exchange.pack_numbers(answers)

    def unpack_answers(self, data, n):
        return exchange.unpack_numbers(data) if n else np.zeros(0, np.int64)


COUNTS = Counts()


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c.astype(np.float64))[1], BUCKETS - 1)


def _cells(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-np.log10(p) * STEPS), 0, CELLS - 2) + 1, 0).astype(np.int64)


def _contexts(totals: list[np.ndarray], n: np.ndarray, tokens: int) -> list[np.ndarray]:
    """For each order the count of each token's context: all tokens, the word before, the two before; at a start the training documents."""
    first = np.cumsum(n) - n
    out = [np.full(len(totals[0]), tokens, np.int64)]
    for lower in totals[:-1]:
        before = np.empty_like(lower)
        before[1:] = lower[:-1]
        before[first] = totals[0][first + n - 1]  # every document has one end token
        out.append(before)
    return out


def estimates(totals: list[np.ndarray], contexts: list[np.ndarray], v: int, weights: list[np.ndarray], deleted: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the context, own estimate, probability by the lower orders) of the next order above those with ``weights``.

    With all orders weighted, the last is the probability.  ``deleted``: 1 leaves the token itself out of the counts.
    """
    p = np.full(len(totals[0]), 1.0 / (v + 1))
    for k, (c, seen) in enumerate(zip(totals, contexts, strict=True)):
        c, seen = np.maximum(c - deleted, 0), np.maximum(seen - deleted, 0)
        bucket, own = context_bucket(seen), c / np.maximum(seen, 1)
        if k == len(weights):
            return bucket, own, p
        share = weights[k][bucket]
        p = share * own + (1 - share) * p
    return bucket, own, p


def learn(bucket: np.ndarray, own: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The own estimate's weight in each bucket, by EM over cells with their mean estimates; 0 where the context was never seen."""
    weights = np.full(BUCKETS, 0.5)
    weights[0] = 0.0
    total = np.bincount(bucket, counts, BUCKETS)
    for _ in range(EM_ROUNDS):
        mine, rest = weights[bucket] * own, (1 - weights[bucket]) * lower
        got = np.bincount(bucket, counts * mine / np.maximum(mine + rest, 1e-300), BUCKETS)
        # a little always stays for what was not seen
        weights = np.minimum(np.where(total > 0, got / np.maximum(total, 1), weights), 1 - 1e-6)
        weights[0] = 0.0
    return weights


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, bucket_bytes: int = BUCKET_BYTES, fan_bits: int | None = None) -> DataFrame:
    """``docs`` without the text, with held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    made = {"held_out": "boolean", "n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    rows = positional(docs, list(made), [text_col])
    src = rows.frame.select(rows.row(), rows[id_col].cast("string").alias("id"), rows[text_col].alias("text"))
    packed = pack(src, "text")
    found = packed.agg(F.count("*"), F.sum("n_bytes")).first()
    plan = exchange.Plan(found[0], found[1] or 0, bucket_bytes, fan_bits)
    chunks = packed.select("chunk", "data")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = _Chunk(unpack(data.as_py()), order)
                for kind, (keys, n) in enumerate(zip(c.keys, c.counts(), strict=True)):
                    sent = list(exchange.sent(COUNTS, plan, kind, keys, n))
                    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in sent], pa.int64()), pa.array([chunk] * len(sent), pa.int64()), pa.array([d for _, d in sent], pa.binary())], names=["range", "member", "data"])

    def words(kind: int, keys: np.ndarray, values: np.ndarray) -> tuple[int, int]:
        """Of the whole words: how many there are in training, and how many tokens."""
        return (int((values > 0).sum()), int(values.sum())) if kind == 0 else (0, 0)

    row = "range long, member long, data binary"
    one = stash(exchange.answered(chunks.mapInArrow(counted, row), COUNTS, plan, "v long, tokens long", words), "counts")
    size = one.agg(F.sum("v"), F.sum("tokens")).first()
    v, tokens = size[0] or 0, size[1] or 0
    release(docs.sparkSession)  # the shuffle files of the counts, before the next pass writes its own

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's rows without their texts, its documents' lengths and its tokens' totals by order."""
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                table = unpack(data.as_py())
                c, answers = _Chunk(table, order), exchange.answer_map(batch, "answers0", i)
                empty = [np.zeros(len(k), np.int64) for k in c.keys]
                totals = [exchange.received(COUNTS, plan, kind, k, e, answers)[which] for kind, (k, e, which) in enumerate(zip(c.keys, empty, c.which, strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ipc(table.select(["_row"]))], pa.binary()), pa.array([exchange.pack_numbers(c.n)], pa.binary()),
                     pa.array([np.packbits(c.held).tobytes()], pa.binary()), pa.array([[exchange.pack_numbers(t) for t in totals]], pa.list_(pa.binary()))],
                    names=["rows", "n", "held", "totals"],
                )

    kept = stash(exchange.joined(chunks, one.select("range", "member", "data")).mapInArrow(told, "rows binary, n binary, held binary, totals array<binary>"), "totals")

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for rows_of, n, held, totals in zip(*(batch.column(c) for c in ("rows", "n", "held", "totals")), strict=True):
            n = exchange.unpack_numbers(n.as_py())
            held = np.unpackbits(np.frombuffer(held.as_py(), np.uint8), count=len(n)).astype(bool)
            totals = [exchange.unpack_numbers(t) for t in totals.as_py()]
            yield rows_of, n, held, totals, _contexts(totals, n, tokens)

    weights: list[np.ndarray] = []
    for _ in range(order):
        so_far = list(weights)

        def histogram(batches: Iterator[pa.RecordBatch], so_far=so_far) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, n, held, totals, contexts in each(batch):
                    train = np.repeat(~held, n)
                    bucket, own, lower = (x[train] for x in estimates(totals, contexts, v, so_far, deleted=1))
                    cells, at, times = np.unique((bucket * CELLS + _cells(own)) * CELLS + _cells(lower), return_inverse=True, return_counts=True)
                    sums = [np.bincount(at, x, len(cells)) for x in (own, lower)]
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(times, pa.int64()), *(pa.array(x, pa.float64()) for x in sums)], names=["cell", "n", "own", "lower"])

        cells = kept.mapInArrow(histogram, "cell long, n long, own double, lower double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "own", "lower")]).orderBy("cell").toArrow()
        n = cells.column("n").to_numpy().astype(np.float64)
        weights.append(learn(cells.column("cell").to_numpy() // (CELLS * CELLS), cells.column("own").to_numpy() / np.maximum(n, 1), cells.column("lower").to_numpy() / np.maximum(n, 1), n))
    release(docs.sparkSession)

    schema = src.select("_row").schema
    for k, t in made.items():
        schema = schema.add(k, t)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_of, n, held, totals, contexts in each(batch):
                p = estimates(totals, contexts, v, weights)[2] if tokens else np.full(len(totals[0]), 1.0 / (v + 1))
                m, doc = len(n), np.repeat(np.arange(len(n)), n)
                base = np.bincount(doc, np.log10((totals[0] + 1.0) / (tokens + v + 1.0)), m)
                known = np.bincount(doc, totals[0] > 0, m).astype(np.int64)
                score = np.bincount(doc, np.log10(p), m)
                made_now = [pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(m, tokens, np.int64)), pa.array(base), pa.array(score)]
                yield from pa.table([unpack(rows_of.as_py()).column("_row").combine_chunks(), *made_now], names=["_row", *made]).to_batches()

    return rows.back(kept.mapInArrow(scores, schema), *made)
