from driftwell.llm import quality_rules

from .test_pipeline import quality


def test_nulls_blanks_repeats_and_extra_columns(spark):
    good = "The cat and the dog sat on a mat with the old red hat that was in the way of it"
    rows = [(1, good, 4), (1, good, 4), (2, None, 4), (3, "", 4), (4, " \n\t", 4), (5, "a b c d e " * 4, 4), (6, "x", 4), (None, good.replace(" ", "## "), 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = [(r.doc_id, r.kept) for r in quality_rules.judged(docs).collect()]
    assert sorted(got, key=str) == sorted([(d, quality(t or "")) for d, t, _ in rows], key=str)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, good, 4)] * 2
    assert quality_rules.judged(docs.limit(0)).count() == 0


def test_windows(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a b c d e", "a b c d", "a b c d e f a b c d e g", "p q r s t u p q r s t u p q r s t u"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measured(docs).collect()}
    assert got == {0: 10, 1: 6, 2: 0, 3: 0, 4: 10, 5: 18}


def test_very_long_text_and_plan(spark):
    long = " ".join(f"w{i % 700}" for i in range(50000))
    out = quality_rules.judged(spark.createDataFrame([(1, long)], "doc_id long, text string"))
    assert out.first().n_repeat_words == 50000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
