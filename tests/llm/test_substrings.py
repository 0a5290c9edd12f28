import random

from driftwell.llm import common, exchange, substrings

from .brute import substrings as brute


def run(docs):
    return sorted(map(tuple, substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_cover_reaches_every_pair_of_positions():
    p, cover = substrings.PERIOD, substrings.COVER
    assert all(any((i + d) % p in cover and (j + d) % p in cover for d in range(p)) for i in range(p) for j in range(p))


def test_documents_against_every_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = run(docs)
    assert got == sorted(brute([tuple(r) for r in docs.collect()]), key=str)
    assert any(r[2] for r in got)


def test_small_alphabet_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(common.pack, "__defaults__", ("text", 400))
    rng = random.Random(2)
    rows = [(rng.randrange(60), " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for _ in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(docs) == sorted(brute(rows), key=str)
    for bits in (1, 2):  # several levels of groups
        out = substrings.remove_repeats(docs, fan_bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(rows), key=str)


def test_text_ids_the_largest_id_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [("b", long), ("a", long), ("B", "x " + long), (None, long)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, text string, _row int, RANK int")
    out = substrings.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "_row", "RANK", "n_words", "n_removed", "kept_sha256"]
    # by the bytes of the ids: B, a, b
    assert sorted((r.doc_id or "", r.n_removed) for r in out.collect()) == [("", 0), ("B", 0), ("a", 30), ("b", 30)]
    rows = [(2**63 - 1, long), (5, long), (None, long)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute(rows), key=str)


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, "y " + " ".join(words[30_000:30_100])), (3, " ".join(words[::-1]))]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute(rows), key=str)


def test_rows_grow_with_the_bytes():
    """Rows that a level sends number a fixed fan for each chunk, whatever the input; keys are told apart by as many bits at every size."""
    chunk = substrings.pack.__defaults__[1]
    for chunks, levels in ((1, 1), (256, 1), (257, 2), (65536, 2), (65537, 3), (16_000_000, 3), (17_000_000, 4)):
        plan = exchange.Plan(chunks, chunks * chunk, substrings.BUCKET_BYTES)
        assert len(plan.groups) == levels and 1 << plan.bits <= 256 and plan.groups[-1] == 1
        assert [plan.width(n) for n in range(levels)] == [exchange.KEY_BYTES + levels - 1 - n for n in range(levels)]


def test_rows_sent_at_several_depths(spark, monkeypatch):
    """Measured: rows of the first level for each chunk stay below the fan as the number of chunks doubles."""
    monkeypatch.setattr(common.pack, "__defaults__", ("text", 3000))
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    per_chunk = []
    for n in (100, 200, 400):
        docs = spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string").coalesce(1)
        seen = []
        monkeypatch.setattr(substrings, "stash", lambda df, tag, seen=seen: seen.append(common.stash(df, tag)) or seen[-1])
        nodes = []
        monkeypatch.setattr(exchange, "stash", lambda df, tag, nodes=nodes: nodes.append((tag, common.stash(df, tag))) or nodes[-1][1])
        substrings.remove_repeats(docs, fan_bits=4)
        sent = next(df for tag, df in nodes if tag == "exchange-nodes").selectExpr("sum(size(members))").first()[0]
        chunks = -(-n * 1200 // 3000)
        per_chunk.append(sent / chunks)
    assert max(per_chunk) <= 16 * 1.5 and max(per_chunk) < 1.5 * min(per_chunk)


def test_nulls_blanks_repeats_and_extra_columns(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(2, long, "x"), (1, long + " tail\there", None), (2, long, "x"), (3, None, "y"), (4, " \n ", None), (None, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    assert run(docs) == sorted(brute([r[:2] for r in rows]), key=str)
    texts = {(r.doc_id, r.text) for r in substrings.remove_repeats(docs).collect()}
    assert (2, "") in texts and (None, long) in texts and (1, long + " tail\there") in texts and (3, None) in texts
    assert run(docs.limit(0)) == []
