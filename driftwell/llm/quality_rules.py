"""Quality rules: a threshold table compiled into one Spark projection; no user functions, no shuffle.

``measured`` adds the measures, ``judged`` the verdict.  The table ``RULES`` holds
(name, SQL over the measures, lowest, highest); a document is kept if each measure
lies within its bounds (null: not judged).

Defined results: a null text has no words and fails the base rule; an empty text too.
Ties do not occur, repeated rows are judged each for itself, very long texts are measured whole, an empty table gives an empty
table.  Columns of the input that bear the name of a measure (in any case) are replaced by it; all others come back whatever their names.

Windows of five words are compared by their 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, positional

GAP_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
STOP_WORDS = (
    "the and of to in a is was that with for on as by at from this are "
    "der die das und in den von zu mit ist im für auf dem ein eine nicht sich auch "
    "le la les de des du et en un une que est pour dans par sur au pas qui "
    "el los las y del que un una por con para se su no es"
).split()

#: name, measure, lowest, highest
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean word length", "word_chars / n_words", 2.0, 15.0),
    ("symbols to words", "n_symbols / n_words", None, 0.25),
    ("stop words", "n_stop_words / n_words", 0.02, None),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.5),
    ("lines with bullets", "n_bullet_lines / n_lines", None, 0.9),
]


def _next(array: str, k: int) -> Column:
    return F.slice(array, F.lit(k + 1), F.greatest(F.size(array) - k, F.lit(0)))


def _with_windows(df: DataFrame) -> DataFrame:
    """``_h``: the hash of each window of five words of ``_w``, from hashes of one, two and four."""
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("_h1", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_h2", F.zip_with("_h1", _next("_h1", 1), pair))
    df = df.withColumn("_h4", F.zip_with("_h2", _next("_h2", 2), pair))
    df = df.withColumn("_h", F.zip_with("_h4", _next("_h1", 4), pair)).drop("_h1", "_h2", "_h4")
    # zip_with pads to the longer side: cut the padded tail
    n = F.size("_w")
    return df.withColumn("_h", F.when(n >= WINDOW, F.slice("_h", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))).otherwise(F.array().cast("array<bigint>")))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bullet_lines", "n_stop_words")


def _measured(step: DataFrame) -> DataFrame:
    """``step`` (_row, _t) with the measures in place of the text."""
    step = step.withColumn("_w", F.split(F.btrim("_t", F.lit(GAP_CHARS)), WORD_GAP))
    step = step.withColumn("_w", F.when(F.element_at("_w", 1) == "", F.array().cast("array<string>")).otherwise(F.col("_w")))
    step = step.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(GAP_CHARS))) > 0))
    step = _with_windows(step)
    # Words that some twice-seen window covers: sort (hash, start), keep the starts that share their hash
    # with a neighbour, add up the words each adds.  Only documents with a repeat at all take this path.
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_s", F.when(repeated, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    m = F.size("_s")
    one = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(one, F.slice("_s", F.lit(1), F.greatest(m - 1, F.lit(0))))
    after = F.concat(F.slice("_s", F.lit(2), F.greatest(m - 1, F.lit(0))), one)
    trio = F.arrays_zip(F.col("_s").alias("x"), before.alias("b"), after.alias("a"))
    twice = F.filter(trio, lambda t: (t["x"]["h"] == t["b"]["h"]) | (t["x"]["h"] == t["a"]["h"]))
    starts = F.sort_array(F.transform(twice, lambda t: t["x"]["i"]))
    step = step.withColumn("_d", F.when(m > 0, starts).otherwise(F.array().cast("array<int>")))
    follow = F.concat(F.slice("_d", F.lit(2), F.greatest(F.size("_d") - 1, F.lit(0))), F.array(F.lit(1 << 30)))
    cover = F.aggregate(F.zip_with("_d", follow, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
    words, lines = F.col("_w"), F.col("_l")
    stop = sorted({x for w in STOP_WORDS for x in (w, w.capitalize())})
    return step.select("_row", *[x.alias(k) for k, x in {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit("[" + SYMBOLS + "]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.size("_d") > 0, cover).otherwise(F.lit(0)).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•|]"))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda x: x.isin(stop))).cast("long"),
    }.items()])


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns in ``MEASURES``."""
    rows = positional(docs, MEASURES)
    return rows.back(_measured(rows.frame.select(rows.row(), F.coalesce(rows[text_col], F.lit("")).alias("_t"))), *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def verdict(rules=None) -> Column:
    """True if no rule speaks against the document; a measure without a value (no words, no lines) is not judged."""
    good = F.lit(True)
    for _, measure, low, high in RULES if rules is None else rules:
        x = F.expr(measure.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)"))
        if low is not None:
            good = good & F.coalesce(x >= low, F.lit(True))
        if high is not None:
            good = good & F.coalesce(x <= high, F.lit(True))
    return good


def judged(docs: DataFrame, text_col: str = "text", rules=None) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    made = (*MEASURES, "base_failed", "kept")
    rows = positional(docs, made)
    return rows.back(_judged(rows.frame.select(rows.row(), F.coalesce(rows[text_col], F.lit("")).alias("_t")), rules), *made)


def _judged(step: DataFrame, rules=None) -> DataFrame:
    out = _measured(step).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, text_col: str = "text", rules=None) -> DataFrame:
    """The rows that pass, with the columns of the input."""
    rows = positional(docs)
    out = _judged(rows.frame.select(rows.row(), F.coalesce(rows[text_col], F.lit("")).alias("_t")), rules)
    # a filter on ``kept`` would be pushed below the projections and repeat their expressions at each use; a generator is not
    return rows.back(out.select(F.inline(F.when(F.col("kept"), F.array(F.struct("_row"))))))
