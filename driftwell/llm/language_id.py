"""Language identification, words first, then shorter and shorter character n-grams.

A known word scores by its log frequency in each language.  An unseen word is read as
n-grams of five characters (its ends marked); if none is known, of four, and so on down to one.

The model is fitted on a bounded sample: about ``SAMPLE_DOCS`` labelled documents of each language, picked by
a hash of their id, give counts.  All words and n-grams of the sample stay, so the model's size is bounded by the sample's.  A column with more than
``MOST_LANGUAGES`` distinct labels is refused, as it is no language column.  Every text is scored whole, however long.

Defined results: a null text or one without a letter is ``und`` with score 0; with no labelled document everything is ``und``;
ties go to the alphabetically first language; repeated rows score alike; an empty table gives an empty table;
input columns named like a result (in any case) are replaced, all others come back whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positional, sql_name

SAMPLE_DOCS = 2500
MOST_LANGUAGES = 500
LONGEST = 5
PRIOR = 0.5
_word = regex.compile(r"\p{L}+").findall


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(sql_name(id_col)).cast("string")) % 4 == 2, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counts(labelled: DataFrame) -> DataFrame:
    """(lang, kind, gram, n): kind 0 words, else the n-gram's length; each task counts its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = Counter(_word((text.as_py() or "").lower()))
                found.setdefault((lang, 0), Counter()).update(words)
                for n in range(1, LONGEST + 1):
                    into = found.setdefault((lang, n), Counter())
                    for w, times in words.items():
                        for g in grams(w, n):
                            into[g] += times
        for (lang, kind), counter in found.items():
            items = list(counter.items())
            for at in range(0, len(items), 20000):
                part = items[at : at + 20000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([kind] * len(part), pa.int32()), pa.array([g for g, _ in part]), pa.array([n for _, n in part], pa.int64())],
                    names=["lang", "kind", "gram", "n"],
                )

    rows = labelled.mapInArrow(run, "lang string, kind int, gram string, n long")
    return rows.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies: for each kind a number for each gram, and a row of ``scores`` by that number, one column per language."""

    CACHE = 1 << 17

    def __init__(self, langs: list[str], grams: list[list[str]], scores: list[np.ndarray]):
        self.langs, self.grams, self.scores = langs, grams, scores
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)), np.float32)
        self.place = [{g: n for n, g in enumerate(some)} for some in grams]

    def __reduce__(self):
        return Model, (self.langs, self.grams, self.scores)

    def _row(self, word: str) -> np.ndarray:
        if (known := self.place[0].get(word)) is not None:
            return self.scores[0][known]
        for n in range(LONGEST, 0, -1):
            place = self.place[n]
            found = [r for g in grams(word, n) if (r := place.get(g)) is not None]
            if found:
                return self.scores[n][found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _word(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        if not len(self.rows) or len(self.cache) > self.CACHE:
            self.cache, self.rows = {}, np.zeros((4096, len(self.langs)), np.float32)
        cache = self.cache
        for w in set(words):
            if w not in cache:
                k = cache[w] = len(cache)
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[k] = self._row(w)
        total = self.rows[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        total -= total.max()
        share = np.exp(total)
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from ``docs`` as given; rows without text or language are left out."""
    given = positional(docs)
    src = given.frame.select(given[text_col].alias("text"), given[lang_col].cast("string").alias("lang"), F.xxhash64(given[id_col]).alias("h")).filter("lang IS NOT NULL AND text IS NOT NULL")
    share = src.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.count("*")).alias("share"))
    found = share.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    langs = sorted(r["lang"] for r in found)
    if not langs:
        return Model([], [], [])
    # at most MOST_LANGUAGES rows
    some = src.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1_000_003)) < (F.col("share") * 1_000_003).cast("long"))
    kept = _counts(some.select("text", "lang").repartition(16)).toArrow()
    number = {x: i for i, x in enumerate(langs)}
    kinds, of = kept.column("kind").to_numpy(), np.array([number[x] for x in kept.column("lang").to_pylist()], np.int64)
    n = kept.column("n").to_numpy()
    names, scores = [], []
    for kind in range(LONGEST + 1):
        at = np.flatnonzero(kinds == kind)
        some = kept.column("gram").take(pa.array(at)).combine_chunks().dictionary_encode()
        table = np.full((len(some.dictionary), len(langs)), PRIOR)
        np.add.at(table, (some.indices.to_numpy(), of[at]), n[at])
        names.append(some.dictionary.to_pylist())
        scores.append(np.log(table / table.sum(axis=0)).astype(np.float32) if len(table) else table.astype(np.float32))
    return Model(langs, names, scores)


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score."""
    rows = positional(docs, ["lang_pred", "score"], [text_col])
    src = rows.frame.select(rows.row(), rows[text_col].alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            out = [of.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["_row", "lang_pred", "score"])

    return rows.back(src.mapInArrow(run, src.select("_row").schema.add("lang_pred", "string").add("score", "double")), "lang_pred", "score")
