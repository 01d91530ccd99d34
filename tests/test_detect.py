import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veil.errors import PolicyError
from veil.functions import codecs, finders
from veil.operators import detect
from veil.operators.values import VALUE_PATTERNS, Keywords, Patterns

VALUES = ["john@x.org", "JOHN.D+t@mail.co.uk", "no at", "(212) 555-1234", "+1-212-555-1234", "123-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000", "4111111111111111", "378282246310005",
          "192.168.1.1", "256.1.1.1", "fe80::1", "1:2:3:4:5:6:7:8", "12345678-1234-1234-1234-123456789abc", "http://x.org/a?b=1", "", "plain", "x@y.zz\n", "x@y.zz\r\n", "１２３-45-6789"]


def test_value_types_as_python(column):
    want = [next((k for k, p, _ in VALUE_PATTERNS if re.match(p, v)), None) for v in VALUES]
    assert column(VALUES, Patterns().value_type) == want


def test_names():
    p = Patterns()
    assert [p.name_type(n) for n in ("E-Mail", "first name", "hotel", "zip", "x", "ip_address")] == ["email", "name", "phone", "zip", None, "address"]
    assert [Patterns(strict_names=True).name_type(n) for n in ("first_name", "ip_address")] == ["first_name", "ip_address"]


def test_custom_pattern(column, spark):
    p = Patterns().with_pattern("badge", r"^B-\d{3}$")
    assert column(["B-123", "B-12"], p.value_type) == ["badge", None] and "badge" in p.supported() and p.confidence("badge") == 0.8
    assert detect.detect_value(spark, "a@b.cc") == {"value": {"type": "email", "confidence": 1.0}}


def test_detect_methods(spark):
    df = spark.createDataFrame([("a@x.org", "x", 5, "n"), ("b@x.org", "y", 6, None)], "mail string, user_name string, salary long, other string")
    found = {r["field"]: r["type"] for r in detect.detect(df, "regex").collect()}
    assert found == {"mail": "email", "user_name": "name"}
    both = {r["field"]: r["type"] for r in detect.detect(df).collect()}
    assert both["mail"] == "email" and both["user_name"] == "name"
    with pytest.raises(PolicyError):
        detect.detect(df, "guess")


def test_heuristics_of_a_sample(spark):
    df = spark.createDataFrame([(f"{i:032x}", "same") for i in range(40)], "token string, state string")
    got = detect.by_heuristics(df)
    assert set(got["token"]["detected_by"]) >= {"high_uniqueness", "consistent_format"} and got["token"]["type"] == "unknown" or got["token"]["type"] == "identifier"
    assert got["state"]["confidence"] == 0.9 and got["state"]["sample_size"] == 40
    assert Keywords().score("user_email") == 0.7 and Keywords().adding("x", "badge").score("badge") == 0.9


def test_entropy(column):
    values = ["", "aaaa", "abcd", "héllo wörld", "漢字😀"]
    want = [-sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values()) if v else 0.0 for v in values]
    assert column(values, detect.entropy) == pytest.approx(want)


def test_csv_columns(spark):
    df = spark.createDataFrame([("", "x", "q"), ("plain", "y", "w"), ("a@b.cc", "z", "e")], "a string, city string, c string")
    assert detect.csv_columns(df) == {"a": "email", "city": "city"}


def test_finders(column):
    text = "mail a.b@x.org, 212-555-1234 or (212) 555-1234 or +1 212 555 1234; 123-45-6789; 4111-1111-1111-1111; 10.0.0.1"
    assert column([text, "nothing"], finders.find_emails) == [["a.b@x.org"], []]
    assert column([text], finders.find_phones) == [["(212) 555-1234", "+1 212 555 1234", "212-555-1234"]]
    assert column([text], finders.find_ssns) == [["123-45-6789"]]
    assert column([text], lambda c: finders.find_cards(c, True)) == [["4111-1111-1111-1111"]]
    assert column([text], finders.redacted)[0].startswith("mail [EMAIL], [PHONE] or [PHONE] or [PHONE]; [SSN]; [CARD]; [IP]")


def test_luhn_as_python(column):
    rng = random.Random(5)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randint(1, 19))) for _ in range(300)] + ["", "12a", "4111111111111111"]

    def ok(n):
        d = [int(c) for c in reversed(n)] if n.isdigit() else None
        return bool(d) and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0

    assert column(numbers, codecs.luhn) == [ok(n) for n in numbers]


def test_digits_of_any_script(column):
    """Texts without ASCII digits are searched too."""
    for zero in ("\u0660", "\uff10"):
        other = lambda t, zero=zero: "".join(chr(ord(zero) + int(c)) if c.isdigit() else c for c in t)
        phone, ssn = other("212-555-1234"), other("123-45-6789")
        assert column([f"call {phone}"], finders.find_phones) == [[phone]]
        assert column([f"is {ssn}"], finders.find_ssns) == [[ssn]]
        assert column([f"call {phone} or {ssn}"], finders.redacted) == ["call [PHONE] or [SSN]"]


@pytest.mark.parametrize("rows", [None, 12_000])
def test_first_values_of_late_columns(spark, rows):
    """A column whose values start after 10,000 rows is scored from its first values."""
    alike = F.when(F.col("id") >= 11_000, F.concat(F.lit("zz"), (F.col("id") % 3).cast("string"))).otherwise(F.when(F.col("id") % 2 == 0, "").otherwise(None))
    df = spark.range(12_500).select("id", alike.alias("late"), F.lit("a").alias("always"))
    got = detect.by_heuristics(df, Keywords(threshold=0.5), order=["id"], rows=rows)
    assert got["late"]["detected_by"] == ["consistent_format"] and got["late"]["sample_size"] == (rows or 12_500)
