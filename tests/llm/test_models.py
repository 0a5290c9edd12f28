"""The fitted models: held-out accuracy on the tables, defined results for odd inputs."""

import math
import os
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from driftwell.llm import language_id, queries, quality_model

DIR = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


def test_quality_on_held_out_labels(spark):
    out = queries.op4_quality_model(spark, DIR)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = out.cache()
    assert rows.count() == docs.count() and rows.filter("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.3 AS INT)").count() == 0
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality").dropna()
    judged = rows.filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = judged[judged["quality"] == 1]["score"], judged[judged["quality"] == 0]["score"]
    wins = sum((good > b).sum() + 0.5 * (good == b).sum() for b in bad)
    assert len(good) and len(bad) and wins / (len(good) * len(bad)) > 0.85
    assert judged["predicted"].eq(judged["quality"]).mean() > 0.8
    rows.unpersist()


def test_quality_without_labels_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a b c", 9), (4, "word " * 30000, 9), (4, "word " * 30000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    out = quality_model.scored(docs, model)
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(None, 0.5, 1), (1, 0.5, 1), (2, 0.5, 1), (4, 0.5, 1), (4, 0.5, 1)]
    assert quality_model.scored(docs.limit(0), model).count() == 0


def test_quality_learns_a_plain_difference(spark):
    rows = [(i, "a clean sentence about rivers and hills" if i % 2 else "buy buy now now $$$ click", i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_model.fit(docs, docs.select("doc_id", "quality"))
    out = {r.doc_id: r.score for r in quality_model.scored(docs, model).collect()}
    assert min(s for i, s in out.items() if i % 2) > max(s for i, s in out.items() if not i % 2)


def test_contradicting_and_null_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None)], "doc_id long, quality int")
    _, bias = quality_model.fit(docs, labels)
    assert bias == 0.0


def test_language_on_held_out_documents(spark):
    out = queries.op7_language_id(spark, DIR)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    joined = out.join(docs.select("doc_id", "lang", "text"), "doc_id").cache()
    assert joined.count() == docs.count()
    told = joined.filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert told.filter("lang = lang_pred").count() > 0.9 * told.count() > 0
    assert joined.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert joined.filter(F.col("text").isNull() | ~F.col("text").rlike(r"\p{L}")).filter("lang_pred <> 'und'").count() == 0
    joined.unpersist()


@pytest.fixture(scope="module")
def model(spark):
    rows = [(1, "the cat sits on the mat", "en"), (2, "die Katze sitzt auf der Matte", "de"), (3, None, "en"), (4, "no language", None)]
    return language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_backs_off_to_characters(model):
    assert model.predict("the mat")[0] == "en" and model.predict("Katze")[0] == "de"
    assert model.predict("Matten")[0] == "de"  # unseen: read by its n-grams
    assert model.predict("12 !?") == ("und", 0.0) and model.predict(None) == ("und", 0.0) and model.predict("") == ("und", 0.0)
    label, score = model.predict("漢字")
    assert label == "de" and score == 0.5  # nothing known: a tie, which goes to the first


def test_language_against_plain_python(spark):
    """The same counts and backoff, a text at a time."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    learned = docs.filter(~language_id.held_out())
    counts, langs = [{} for _ in range(6)], sorted({r.lang for r in learned.collect() if r.lang and r.text is not None})
    for row in learned.collect():
        for word in regex.findall(r"\p{L}+", (row.text or "").lower()) if row.lang else []:
            marked = f"<{word}>"
            pieces = [[word], list(word), *[[marked[i : i + n] for i in range(len(marked) - n + 1)] for n in range(2, 6)]]
            for kind, some in enumerate(pieces):
                for g in some:
                    counts[kind].setdefault(g, Counter())[row.lang] += 1
    totals = [{x: sum(c[x] + 0.5 for c in of.values()) for x in langs} for of in counts]
    score = lambda kind, g, x: math.log((counts[kind][g][x] + 0.5) / totals[kind][x])

    def told(text):
        words = regex.findall(r"\p{L}+", (text or "").lower())
        if not words:
            return "und"
        sums = dict.fromkeys(langs, 0.0)
        for word, times in Counter(words).items():
            if word in counts[0]:
                found = [(0, word)]
            else:
                marked, found = f"<{word}>", []
                for n in range(5, 0, -1):
                    some = list(word) if n == 1 else [marked[i : i + n] for i in range(len(marked) - n + 1)]
                    found = [(n, g) for g in some if g in counts[n]]
                    if found:
                        break
            for x in langs:
                sums[x] += times * sum(score(k, g, x) for k, g in found) / max(1, len(found))
        return max(langs, key=lambda x: (sums[x], -langs.index(x)))

    got = {r.doc_id: r.lang_pred for r in language_id.predicted(docs.select("doc_id", "text"), language_id.fit(learned)).collect()}
    assert got == {r.doc_id: told(r.text) for r in docs.collect()}


def test_quality_fit_and_score_against_plain_python():
    rng = np.random.default_rng(1)
    good = rng.random(60) < 0.5
    rows = [np.unique(rng.integers(0, 400, rng.integers(5, 60)) + (200 if g else 0)) for g in good]
    p, q = np.ones(quality_model.SLOTS), np.ones(quality_model.SLOTS)
    use = [i for i in range(60) if i % 5 != 4]
    for i in use:
        for slot in rows[i]:
            (p if good[i] else q)[slot] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    # the dual problem's optimum, found by many more passes over dense rows
    x = np.array([[ratio[s] / math.sqrt(len(rows[i])) if s in set(rows[i].tolist()) else 0.0 for s in range(700)] + [1.0] for i in use])
    y = np.where(good[use], 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    for _ in range(2000):
        for i in range(len(y)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / (x[i] @ x[i]), 0.0), cost[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    for form in ([rows[i] for i in use], quality_model.Rows([quality_model._stored(rows[i]) for i in use])):
        weights, bias = quality_model.descend(form, y, ratio, epochs=2000)
        margins = [weights[rows[i]].sum() / math.sqrt(len(rows[i])) + bias for i in use]
        assert np.allclose(margins, x @ w, atol=1e-3)


def test_slots_are_stored_whole():
    rng = np.random.default_rng(2)
    for size in (1, 100, 8191, 8192, 200_000):
        slots = np.unique(rng.integers(0, quality_model.SLOTS, size))
        assert (quality_model.Rows([quality_model._stored(slots)])[0] == slots).all()


def test_clashing_names_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "the cat", 1, 2, "en"), (1, "die Katze und der Hund", 1, 2, "de"), (2, "a dog", 3, 4, "en")], "doc_id long, text string, _row int, _TEXT_ int, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    one, two = quality_model.fit(docs, labels), quality_model.fit(docs.orderBy(F.desc("text")), labels)
    assert (one[0] == two[0]).all() and one[1] == two[1]
    assert quality_model.scored(docs, one).columns == ["doc_id", "_row", "_TEXT_", "lang", "score", "predicted"]
    assert language_id.predicted(docs, language_id.fit(docs)).columns == ["doc_id", "_row", "_TEXT_", "lang", "lang_pred", "score"]


def test_language_column_of_something_else(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        language_id.fit(docs)


def test_language_of_odd_tables(spark, model):
    docs = spark.createDataFrame([(None, "the cat", 1), (2, None, 2), (2, "die Matte", 3), (2, "die Matte", 3)], "doc_id long, text string, score int")
    out = language_id.predicted(docs, model)
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out.collect()) == [(0, "en"), (2, "de"), (2, "de"), (2, "und")]
    assert language_id.predicted(docs.limit(0), model).count() == 0
    empty = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.predict("the cat") == ("und", 0.0)
