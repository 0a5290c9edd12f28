r"""Format-preserving pseudonyms for personal numbers, dates and addresses; Spark SQL only, no shuffle.

A number that passes its validation is permuted within its format by a keyed Feistel network over two
coordinates (l, r) of sizes a and b; rounds add to l and to r in turn a keyed hash of the other, modulo the size.  That
is a bijection for any a and b, so equal values get equal pseudonyms in all documents and different values different ones.

kind    validated by                                  permuted
card    13-19 digits, Luhn                            all but the last digit, which is computed anew
phone   (ddd) ddd-dddd or ddd-ddd-dddd                the ten digits; a country code stays
ip      four octets of 0-255                          the 32 bits
ssn     ddd-dd-dddd; no 000, 666, 9xx; no 00; no 0000 the valid numbers
date    a day of 1800-2199, y-m-d, d.m.y or m/d/y     the days of 400 years
email   local@domain                                  replaced: a keyed digest @ ``EMAIL_DOMAIN`` (no number to permute)

What fails its validation stays as it is.  Letters, separators and the rest of the text never change.

The key is a secret of the caller's: ``pseudonymised`` takes it as a parameter and has no default.  It stands in the plan as a literal, so a
cluster that shows plans to others should cover it (``spark.sql.redaction.string.regex``).

Defined results: a null text stays null with no find; an empty one stays empty; very long texts are rewritten whole; repeated rows give equal
results; overlaps go to the leftmost match, ties to the order in ``PATTERN``; an empty table gives an empty table; an input column
``n_private`` (in any case) is replaced, all others come back whatever their names.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positional

ROUNDS = 10
EMAIL_DOMAIN = "example.org"
KEY_SETTING = "driftwell.pii.key"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3} ?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])|(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
}
PATTERN = "|".join(FORMS.values())
SSN_AREAS, SSN_REST = 898, 99 * 9999
DAYS_A, DAYS_B, FIRST_DAY = 189, 773, "1800-01-01"


def _digest(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts], F.lit(key)), 256)


def permuted(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r), the Feistel image of (left, right) in [0, a) x [0, b)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(at: Column, i: Column) -> Column:
        even = i % 2 == 0
        hashed = F.conv(F.substring(_digest(key, kind, a, b, i, F.when(even, at["r"]).otherwise(at["l"])), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(even, (at["l"] + hashed % a) % a).otherwise(at["l"]).alias("l"),
            F.when(even, at["r"]).otherwise((at["r"] + hashed % b) % b).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn_sum(digits: Column, odd_doubled: Column) -> Column:
    """Sum of the digits, every second one doubled and cast out; ``odd_doubled``: 1 if the first is doubled, else 0."""
    chars = F.split(digits, "(?<=.)(?=.)")
    values = F.transform(chars, lambda c, i: F.when((i + odd_doubled) % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _filled(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("p"))

    def put(at: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(at["s"], F.when(digit, F.substr(digits, at["p"], F.lit(1))).otherwise(c)).alias("s"), F.when(digit, at["p"] + 1).otherwise(at["p"]).alias("p"))

    return F.aggregate(F.split(m, "(?<=.)(?=.)"), start, put)["s"]


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _card(key: str, m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)
    low = F.floor((n - 1) / 2).cast("int")
    high = n - 1 - low
    image = permuted(key, "card", F.substr(d, F.lit(1), high).cast("long"), F.substr(d, high + 1, low).cast("long"), _ten(high), _ten(low))
    body = F.concat(_pad(image["l"], high), _pad(image["r"], low))
    # the digit before the check digit is doubled, then every second one to its left
    check = ((10 - _luhn_sum(body, F.when(n % 2 == 0, 1).otherwise(0)) % 10) % 10).cast("string")
    valid = _luhn_sum(d, F.when(n % 2 == 0, 1).otherwise(0)) % 10 == 0
    return F.when(valid, _filled(m, F.concat(body, check))).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    d = _digits(m)
    last = F.substr(d, F.length(d) - 9, F.lit(10))
    image = permuted(key, "phone", F.substring(last, 1, 5).cast("long"), F.substring(last, 6, 5).cast("long"), F.lit(100000), F.lit(100000))
    return _filled(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _pad(image["l"], 5), _pad(image["r"], 5)))


def _ip(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    image = permuted(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    return F.concat_ws(".", F.shiftright(image["l"], 8), image["l"] % 256, F.shiftright(image["r"], 8), image["r"] % 256)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    image = permuted(key, "ssn", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(SSN_AREAS), F.lit(SSN_REST))
    new = image["l"] + F.when(image["l"] >= 665, 2).otherwise(1)
    return F.when(valid, F.concat_ws("-", _pad(new, 3), _pad(F.floor(image["r"] / 9999) + 1, 2), _pad(image["r"] % 9999 + 1, 4))).otherwise(m)


def _date(key: str, m: Column) -> Column:
    style = F.when(m.rlike("^[0-9]{4}"), "yyyy-MM-dd").when(F.contains(m, F.lit(".")), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    iso = F.when(style == "yyyy-MM-dd", m).when(style == "dd.MM.yyyy", F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    iso = iso.otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    first = F.lit(FIRST_DAY).cast("date")
    day = F.datediff(iso.try_cast("date"), first)
    image = permuted(key, "date", F.floor(day / DAYS_B), day % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B))
    new = F.date_add(first, (image["l"] * DAYS_B + image["r"]).cast("int")).cast("string")
    y, mo, d = F.substring(new, 1, 4), F.substring(new, 6, 2), F.substring(new, 9, 2)
    out = F.when(style == "yyyy-MM-dd", new).when(style == "dd.MM.yyyy", F.concat_ws(".", d, mo, y)).otherwise(F.concat_ws("/", mo, d, y))
    return F.when((day >= 0) & (day < DAYS_A * DAYS_B), out).otherwise(m)


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of one match of ``PATTERN``; the match itself if it fails its validation."""
    return (
        F.when(F.contains(m, F.lit("@")), F.concat(F.substring(_digest(key, "email", F.lower(m)), 1, 16), F.lit("@" + EMAIL_DOMAIN)))
        .when(m.rlike(r"\(") | m.rlike(r"^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), _phone(key, m))
        .when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), _ip(key, m))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(key, m))
        .when(F.length(m) == 10, _date(key, m))
        .otherwise(_card(key, m))
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten and ``n_private`` (long), the number of values replaced."""
    if not key:
        raise ValueError("pseudonyms need a key")
    rows = positional(docs, ["n_private"])
    at = rows.place(text_col)
    text = F.col("text")
    step = rows.frame.select(rows.row(), rows[text_col].alias("text"))
    step = step.withColumn("found", F.when(text.rlike("[0-9]|@"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    step = step.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(key, m))))
    parts = F.split(text, PATTERN, -1)
    spliced = F.concat(parts[0], F.array_join(F.zip_with("new", F.slice(parts, F.lit(2), F.size("new")), lambda m, p: F.concat(m, p)), ""))
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    step = step.withColumn("n_private", F.when(F.col("new").isNotNull(), changed).otherwise(0).cast("long"))
    out = F.when(F.col("n_private") > 0, spliced).otherwise(text)
    return step.select(*[(out if n == at else F.col("_row")[f"c{n}"]).alias(rows.names[n]) for n in rows.kept], "n_private")


@lru_cache(maxsize=1)
def _own_key(application: str) -> str:
    return secrets.token_hex(32)


def session_key(docs: DataFrame) -> str:
    """The key that the session holds under ``driftwell.pii.key``.

    Where it holds none, a random one that is kept for the application and nowhere else: values stay linked within it, and nobody can undo
    the pseudonyms, but another application gives other ones.
    """
    spark = docs.sparkSession
    return spark.conf.get(KEY_SETTING, None) or _own_key(spark.sparkContext.applicationId)
