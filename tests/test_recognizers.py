"""Recognizers against tables of cases and against a plain Python reading of their shapes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.operators import recognizers, spans
from maskwright.operators.recognizers import REGISTRY, Recognizer, Registry


def found(spark, texts, only=None, recognizers_=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    out = rows.select("n", "text", recognizers.detect(F.col("text"), recognizers_ or REGISTRY.build(only)).alias("s")).orderBy("n").collect()
    for r in out:
        for s in r.s:
            assert r.text[s.start : s.end] == s.text
        assert all(a.end <= b.start for a, b in zip(r.s, r.s[1:], strict=False))
    return [[(s.text, s.label) for s in r.s] for r in out]


CASES = {
    "phone": [
        ("Call + 91 44 28316074 now", ["+ 91 44 28316074"]),
        ("+91 80 3174 2265 and +91-40-23918847", ["+91 80 3174 2265", "+91-40-23918847"]),
        ("+ 91 (33) 7046 1928; 044-71936620.", ["+ 91 (33) 7046 1928", "044-71936620"]),
        ("₹ 2,718.31 million, L70214KA1986PLC203957, page 63, 12,345,678 shares, 2023-24", []),
    ],
    "ssn": [("SSN 219-36-8047 or 219 36 8047", ["219-36-8047", "219 36 8047"]), ("000-12-3456 666-12-3456 900-12-3456 219-00-4567 219-36-0000 219-36 8047 219-368-047 x219-36-8047", [])],
    "credit_card": [
        ("pay 4111 1111 1111 1111, 4111111111111111 or 4111-1111-1111-1111.", ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"]),
        ("4111 1111 1111 1112; 4111 1111-1111 1111; +4111111111111111; 4000 1234 5678 9017 12", []),
    ],
    "ip": [("host 192.168.0.1 and 10.0.0.255.", ["192.168.0.1", "10.0.0.255"]), ("256.1.1.1 1.2.3.4.5 01.2.3.4 1.2.3", [])],
    "dob": [
        ("Date of Birth: 23/11/1964; DOB - 1.2.90; born on 3rd March 1970; birth date: March 3, 1970", ["23/11/1964", "1.2.90", "3rd March 1970", "March 3, 1970"]),
        ("Agreement dated 07/05/1998 and the year ended March 31, 2023", []),
        ("stubborn 07/05/1998 xdob 07/05/1998 " + "y" * 47 + "xdob 1/1/2000", ["07/05/1998"]),
        ("Date of Birth: 23/11/1964 and agreement of 15/09/1999", ["23/11/1964"]),
    ],
    "email": [("Mail a.b@x.co.in, not @ or a@b.", ["a.b@x.co.in"])],
    "city": [("From PUNE to Navi Mumbai via Mumbai.", ["PUNE", "Navi Mumbai", "Mumbai"]), ("Punekar, Suparna", [])],
    "postal_code": [("Chakan Road, Khed 410 501, India and 411001.", ["410 501", "411001"]), ("It sold 410501 units", []), ("Plot 1,410501 and 4105012", [])],
    "company": [
        ("Acme Technologies Limited and our Foo & Bar Private Limited; Big\tCorp LLP", ["Acme Technologies Limited", "Foo & Bar Private Limited", "Big\tCorp LLP"]),
        ("formerly The Zed Works Ltd. and", ["Zed Works Ltd"]),
        ("National Stock Exchange Limited; Bank Limited; Tower House Limited; India Limited; acme limited", []),
    ],
    "website": [
        ("See www.acme.com, https://acme.co/path?x=1; http://a.b/c) or www.ac me.com", ["www.acme.com", "https://acme.co/path?x=1", "http://a.b/c", "www.ac"]),
        ("me@www.acme.com", []),
    ],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    got = found(spark, [t for t, _ in CASES[name]], [name])
    assert [[v for v, _ in g] for g in got] == [want for _, want in CASES[name]]


# The shapes, as Python reads them.
PLAIN = {
    "credit_card": r"(?<![\d-])(?:\d[ -]?){12,18}\d(?!\d)",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}([- ])(?!00)\d{2}\1(?!0000)\d{4}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "phone": r"(?<![\d.])(?:\+\s?\d{1,3}[\s./-]?(?:\(\d{1,5}\)|\d{1,5})(?:[\s./-]?\d{2,10}){1,3}|0\d{2,4}[\s./-]\d{6,8})(?!\d)",
    "website": r"(?i)(?:https?://|www\.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:/[^\s,;)\]]*)?",
}


def test_random_texts_match_the_shapes(spark):
    rng = random.Random(11)
    parts = list("0123456789" * 3 + "+-(). /@aé😀٣_") + ["219-36-8047", "+91 20 ", "1.2.3.4", "a@b.co", "www.", "https://x", "4111111111111111", " 022-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1_500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for name, shape in PLAIN.items():
        got = {r.n: [(s.start, s.text) for s in r.s or []] for r in rows.select("n", F.when(F.col("text").rlike(next(x for x in REGISTRY.build([name])).guard), spans.find(F.col("text"), REGISTRY.build([name])[0].pattern)).alias("s")).collect()}
        for n, text in enumerate(texts):
            assert got[n] == [(m.start(), m[0]) for m in re.finditer(shape, text)], (name, text)


def test_all_kinds_in_one_line(spark):
    text = "SSN 219-36-8047, card 4111 1111 1111 1111, IP 10.1.2.3, DOB: 01/02/1980, a@b.com, +91 44 2831 6074, www.x.com, Pune 411 001 Road, Acme Works Limited"
    (got,) = found(spark, [text])
    assert {k for _, k in got} == {"SSN", "CREDIT_CARD", "IP_ADDRESS", "DATE_OF_BIRTH", "EMAIL", "PHONE", "URL", "LOCATION", "ORGANIZATION"}


def test_null_and_blank(spark):
    assert found(spark, ["", "   "]) == [[], []]
    row = spark.createDataFrame([(None,)], "text string").select(recognizers.detect(F.col("text"), REGISTRY.build()).alias("s")).first()
    assert row.s == []


def greedy(spans_):
    kept = []
    for s in sorted(spans_, key=lambda s: (-s[4], -s[3], s[0] - s[1], s[0], s[5])):
        if all(not (s[0] < k[1] and k[0] < s[1]) for k in kept):
            kept.append(s)
    return sorted(kept)


def test_resolution_is_greedy(spark):
    rng = random.Random(5)
    rows = []
    for n in range(400):
        made = []
        for k in range(rng.randint(0, 9)):
            start = rng.randint(0, 20)
            made.append((start, start + rng.randint(0, 8), rng.choice([0.5, 1.0]), rng.choice([1, 2]), k))
        rows.append((n, made))
    data = spark.createDataFrame([(n, [(a, b, "t", "L", "r", s, p, k) for a, b, s, p, k in m]) for n, m in rows], f"n int, s array<{spans.SPAN}>")
    got = {r.n: [(s.start, s.end, s.ord) for s in r.s] for r in data.select("n", spans.resolve(F.col("s")).alias("s")).collect()}
    for n, m in rows:
        want = greedy([(a, b, "t", s, p, k) for a, b, s, p, k in m])
        assert sorted(got[n]) == sorted((w[0], w[1], w[5]) for w in want)


def test_registry():
    registry = Registry(recognizers.defaults())
    assert [r.name for r in registry.build()] == sorted(registry.names()) and len(registry.names()) == 10
    assert [r.name for r in registry.build(["ip", "email"], ["ip", "unknown"])] == ["email"]
    with pytest.raises(KeyError):
        registry.build(["nothing"])
    with pytest.raises(ValueError):
        registry.register(Recognizer("ip", "IP_ADDRESS", 1, "x"))
    with pytest.raises(ValueError):
        registry.register(Recognizer("", "X", 1, "x"))


def test_a_new_kind_needs_no_change_to_the_engine(spark):
    badge = Recognizer("badge", "BADGE", 99, r"\bB-\d{4}\b", validate=lambda text, s: ~F.endswith(s["text"], F.lit("0")))
    assert found(spark, ["B-1234 and B-1230, a@b.co"], recognizers_=[badge, *REGISTRY.build(["email"])]) == [[("B-1234", "BADGE"), ("a@b.co", "EMAIL")]]


def test_minimum_score(spark):
    rows = spark.createDataFrame([("DOB 1/1/1980 a@b.co",)], "text string")
    (row,) = rows.select(recognizers.detect(F.col("text"), REGISTRY.build(), 0.95).alias("s")).collect()
    assert [s.label for s in row.s] == ["EMAIL"]
