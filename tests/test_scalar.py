"""Boundary cases of cleaning, typing, rounding and keys."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelake.functions import keys
from tidelake.functions import scalar as S


def values(spark, texts, expression, dtype="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {dtype}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_clean_string(spark):
    texts = [" a\n\t ", "\r\nb c\x0b", "", "  \t", None, "d"]
    assert values(spark, texts, S.clean_string("t")) == ["a", "b c", None, None, None, "d"]


def test_parse_timestamp_and_numbers(spark):
    stamps = values(spark, ["2018-01-02 03:04:05", " ", "x", None], S.parse_timestamp("t"))
    assert stamps == [datetime(2018, 1, 2, 3, 4, 5), None, None, None]
    assert values(spark, ["7", " 8 ", "1.5", "n/a"], S.to_number("t", "bigint")) == [7, 8, None, None]


def test_consent_rejects_other_spellings(spark):
    texts = ["True", " YES", "1", "false", "No", "0", "t", "y", "", None]
    expected = [True, True, True, False, False, False, None, None, None, None]
    assert values(spark, texts, S.consent("t")) == expected


def test_fractional_days_keeps_sign(spark):
    df = spark.sql(
        "select timestamp'2020-01-02 00:00:00' a, timestamp'2020-01-01 12:00:00.9' b"
    )
    row = df.select(S.fractional_days_between("a", "b"), S.fractional_days_between("b", "a")).first()
    assert row[0] == pytest.approx(-43199 / 86400) and row[1] == pytest.approx(43199 / 86400)


@pytest.mark.parametrize(
    "top, bottom, expected",
    [("10.05", 2, 5.03), ("0.01", 2, 0.01), ("10.04", 3, 3.35), ("5.00", 0, 0.0), ("-10.05", 2, -5.03)],
)
def test_rounded_ratio_half_up(spark, top, bottom, expected):
    df = spark.sql(f"select cast('{top}' as decimal(18,2)) a, {bottom} b")
    assert df.select(S.rounded_ratio(F.col("a"), F.col("b"))).first()[0] == expected


def test_pseudonyms_follow_the_digest(spark):
    token = hashlib.sha256(b"synthetic-customer-contact-v1|email|42").hexdigest()[:24]
    number = int.from_bytes(
        hashlib.sha256(b"synthetic-customer-contact-v1|phone|42").digest()[:8], "big"
    )
    assert values(spark, ["42"], keys.pseudonym_email("t")) == [f"{token}@synthetic-example.com"]
    assert values(spark, ["42"], keys.pseudonym_phone("t")) == [f"+3538{number % 10**10:010d}"]


def test_record_and_composite_keys(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    row = df.select(keys.record_key("x", "y"), keys.composite_key("x", "y")).first()
    assert row[0] == hashlib.sha256(b"a|").hexdigest() and row[1] is None


def test_email_and_phone_predicates_match_the_plain_patterns(spark):
    """Against the backtracking patterns, in Python."""
    import random
    import re

    email = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
    phone = re.compile(r"(?<!\d)(?:\+?\d[\s().-]*){8,}(?!\d)")
    draw = random.Random(3)
    texts = ["éa@b.com", "é.a@b.com", "..@b.co", "x@y.c", "a@b.com.é", "éa.b@c.org", ""]
    texts += ["".join(draw.choice("ab.@%é c1") for _ in range(14)) for _ in range(3000)]
    texts += ["".join(draw.choice("0123+ ()-x") for _ in range(16)) for _ in range(2000)]
    found_email = values(spark, texts, keys.looks_like_email("t"))
    found_phone = values(spark, texts, keys.looks_like_phone("t"))
    assert [t for t, f in zip(texts, found_email) if f != bool(email.search(t))] == []
    assert [t for t, f in zip(texts, found_phone) if f != bool(phone.search(t))] == []


def test_patterns_stay_linear_on_long_runs(spark):
    texts = ["a." * 60000, "1" * 60000, "9 " * 60000, "a." * 60000 + "@"]
    assert values(spark, texts, keys.looks_like_phone("t")) == [False, True, True, False]
    assert values(spark, texts, keys.looks_like_email("t")) == [False, False, False, False]


def test_masking_matches_the_plain_patterns(spark):
    import random
    import re

    from tidelake.operators.remediation import mask_pii

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    phone = re.compile(r"\+?\d(?:[\s().-]*\+?\d){7,}")
    draw = random.Random(4)
    texts = ["a@b.com.x@d.org", "+353 (1) 234-5678 now", "1" * 50000]
    texts += ["".join(draw.choice("ab.@1 +") for _ in range(20)) for _ in range(3000)]
    expected = [phone.sub("[phone]", email.sub("[email]", t)) for t in texts]
    assert values(spark, texts, mask_pii("t")) == expected


def test_identifier(spark):
    assert values(spark, ["a b/c", "--", "x."], S.identifier("t")) == ["a-b-c", None, "x."]


def test_typing_takes_only_full_dates_and_plain_numbers(spark):
    texts = ["10:30:00", "T10:30", "2018", "2018-01", "2018-01-02", " 2018-01-02 03:04:05 ", "x"]
    found = values(spark, texts, S.parse_timestamp("t"))
    assert [f is not None for f in found] == [False] * 4 + [True, True, False]
    texts = ["1d", "1f", "0x1p3", "NaN", "Infinity", "1e400", "1.5", "-2", "+.5e1", "1."]
    found = values(spark, texts, S.to_number("t", "double"))
    assert found == [None] * 6 + [1.5, -2.0, 5.0, 1.0]


def test_money_beyond_its_type_is_null(spark):
    df = spark.createDataFrame([(1e300,), (2.5,), (None,)], "v double")
    got = [r[0] for r in df.select(S.money("v")).collect()]
    assert got[0] is None and float(got[1]) == 2.5 and got[2] is None
