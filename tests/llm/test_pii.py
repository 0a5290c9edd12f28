import hashlib
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from driftwell.llm import pii

KEY = "k1"


def feistel(kind, l, r, a, b):
    for i in range(pii.ROUNDS):
        h = int(hashlib.sha256(f"{KEY}|{kind}|{a}|{b}|{i}|{r if i % 2 == 0 else l}|{KEY}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            l = (l + h % a) % a
        else:
            r = (r + h % b) % b
    return l, r


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def fill(m, digits):
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), m)


def brute(m):
    d = re.sub(r"\D", "", m)
    if "@" in m:
        return hashlib.sha256(f"{KEY}|email|{m.lower()}|{KEY}".encode()).hexdigest()[:16] + "@example.org"
    if "(" in m or re.fullmatch(r"\d{3}-\d{3}-\d{4}", m):
        l, r = feistel("phone", int(d[-10:-5]), int(d[-5:]), 10**5, 10**5)
        return fill(m, d[:-10] + f"{l:05}{r:05}")
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", m):
        o = [int(x) for x in m.split(".")]
        l, r = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{l >> 8}.{l & 255}.{r >> 8}.{r & 255}"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return m
        l, r = feistel("ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{l + (2 if l >= 665 else 1):03}-{r // 9999 + 1:02}-{r % 9999 + 1:04}"
    if len(m) == 10:
        y, mo, dd = (m[:4], m[5:7], m[8:]) if m[4] == "-" else (m[6:], m[3:5], m[:2]) if "." in m else (m[6:], m[:2], m[3:5])
        try:
            n = (date(int(y), int(mo), int(dd)) - date(1800, 1, 1)).days
        except ValueError:
            return m
        if not 0 <= n < 189 * 773:
            return m
        l, r = feistel("date", n // 773, n % 773, 189, 773)
        t = date(1800, 1, 1) + timedelta(l * 773 + r)
        return t.isoformat() if m[4] == "-" else t.strftime("%d.%m.%Y") if "." in m else t.strftime("%m/%d/%Y")
    if not luhn(d):
        return m
    low = (len(d) - 1) // 2
    high = len(d) - 1 - low
    l, r = feistel("card", int(d[:high]), int(d[high : high + low]), 10**high, 10**low)
    body = f"{l:0{high}}{r:0{low}}"
    return fill(m, next(body + c for c in "0123456789" if luhn(body + c)))


def expected(text):
    found = re.findall(pii.PATTERN, text or "")
    new = [brute(m) for m in found]
    return None if text is None else re.sub(pii.PATTERN, lambda m: brute(m.group()), text), sum(a != b for a, b in zip(found, new))


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_private) for r in pii.pseudonymised(docs, KEY).orderBy("doc_id").collect()]


TEXTS = [
    None, "", "no numbers here", "card 4111111111111111, again 4111 1111 1111 1111; amex 3782-822463-10005!", "bad 4111111111111112",
    "+1 (212) 555-0199 and (212) 555-0199 and 212-555-0199", "ip 192.168.0.1. version 1.2.3.4.5 256.1.1.1 10.0.0.255",
    "ssn 123-45-6789 666-45-6789 000-12-3456 899-99-9999", "born 1984-02-29, 29.02.1985, 31.12.1999 and 12/25/2001 or 13/25/2001, 1799-12-31",
    "Mail Und.34@Mail7.Example.com### und.34@mail7.example.com.", "x" * 50000 + " 4111111111111111 " + "9" * 30000, "7536784127813050 4845168114407329", "7 @ 8",
]


def test_against_plain_python(spark):
    assert run(spark, TEXTS) == [expected(t) for t in TEXTS]


def test_documents_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.text, r.n_private) for r in pii.pseudonymised(docs, KEY).collect()}
    assert got == {r.doc_id: expected(r.text) for r in docs.collect()} and any(n for _, n in got.values())


def test_formats_hold_and_values_stay_apart(spark):
    rng = random.Random(2)
    cards = set()
    while len(cards) < 300:
        body = str(rng.randrange(10**15)).zfill(15)
        cards.add(next(body + c for c in "0123456789" if luhn(body + c)))
    cards = sorted(cards)
    got = [t for t, _ in run(spark, cards)]
    assert all(re.fullmatch(r"\d{16}", t) and luhn(t) for t in got) and len(set(got)) == 300 and not set(got) & set(cards)


def test_small_domain_is_permuted(spark):
    pairs = spark.range(15 * 7).select((F.col("id") / 7).cast("long").alias("l"), (F.col("id") % 7).alias("r"))
    out = pairs.select(pii.permuted("k", "t", F.col("l"), F.col("r"), F.lit(15), F.lit(7)).alias("x")).distinct()
    assert out.count() == 105


def test_extra_columns_and_native_plan(spark):
    docs = spark.createDataFrame([(1, "4111111111111111", "s", 3)], "doc_id long, text string, source string, n_private int")
    out = pii.pseudonymised(docs, KEY)
    assert out.columns == ["doc_id", "text", "source", "n_private"] and out.first().n_private == 1
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert pii.pseudonymised(docs.limit(0), KEY).count() == 0
