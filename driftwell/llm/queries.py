"""The queries ``opN_<name>`` with production parameters, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embeddings, language_id, lm, packing, pii, quality_model, quality_rules, simhash, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers as public

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encoded(docs, vocabulary or public.path("byte_bpe_50k.tiktoken"), public.PATTERN, keep_ids=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs.filter(~quality_model.held_out()), _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = quality_model.scored(docs, model)
    return out.select("doc_id", quality_model.held_out().alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    out = language_id.predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, pii.session_key(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_quality_rules": op5_quality_rules,
    "op8_byte_bpe": op8_byte_bpe,
    "op2_simhash": op2_simhash,
    "op3_substrings": op3_substrings,
    "op10_lm_scores": op10_lm_scores,
    "op4_quality_model": op4_quality_model,
    "op7_language_id": op7_language_id,
    "op1_pii": op1_pii,
    "op9_packing": op9_packing,
    "op6_embeddings": op6_embeddings,
}

_STOP = ", ".join(f"'{x}'" for x in sorted({x for w in quality_rules.STOP_WORDS for x in (w, w.capitalize())}))

SQL: dict[str, str] = {
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
      FROM (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM e WHERE len(w) >= 5))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(0, 5) AS o(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT e.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•|]'))) AS n_bullet_lines,
        len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words
      FROM e LEFT JOIN r ON e.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2.0 AND 15.0, true)
         AND coalesce(n_symbols / n_words <= 0.25, true) AND coalesce(n_stop_words / n_words >= 0.02, true)
         AND coalesce(n_dup_lines / n_lines <= 0.5, true) AND coalesce(n_bullet_lines / n_lines <= 0.9, true) AS kept
FROM b""",
    "op3_substrings": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
gone AS (SELECT DISTINCT g.doc_id, g.i + o.k AS at FROM g JOIN f ON g.g = f.g AND f.low < g.doc_id, range(0, 13) AS o(k)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.at) FILTER (WHERE gone.at IS NULL) AS t, count(gone.at) AS n FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.at = gone.at GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op6_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
o AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a JOIN o b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.id""",
}
