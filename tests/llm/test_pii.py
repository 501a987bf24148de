import hashlib
import re

import pytest

from maskwright.llm import pii
from tests.llm.cases import ROWS, awkward, empty

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, shape in SHAPES.items():
        for m in re.finditer(shape, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(rows, texts):
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in want) for k in SHAPES]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_base_against_plain_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = pii.personal_data(docs).collect()
    assert len(got) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 30
    check(got, texts)


def test_hard_texts(spark):
    texts = [
        "a@b.co%x@y.z, <me.you@sub.dom.example.org>; @@ a@b a@.c x@-.-",
        "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.002.003.0004 0000000000000001.2.3.4 99999999999999999999.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 41111111111111111111 378282246310005 6011000990139424",
        "+1 (212) 555-0100 +49.30.1234567- +1 +12345678 ++4412345678 +1234567890123456",
        "é😀 +1 (212) 555-0100 😀 a@b.cd",
        "0" * 30_000 + " " + "1-" * 9_000 + "2",
        "a@" + "b." * 20_000 + "c",
        "x" * 60_000 + "@",
        "1." * 20_000 + "1",
        "+" + "1 " * 20_000,
        "\u0001 4\u00011 4111 1111 1111 1111",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(pii.personal_data(docs).collect(), texts)


def test_awkward_rows(spark):
    got = pii.personal_data(awkward(spark)).collect()
    assert len(got) == len(ROWS) and pii.personal_data(empty(spark)).count() == 0
    check(got, dict(ROWS))
    out = pii.redacted(awkward(spark))
    assert out.columns == awkward(spark).columns and out.count() == len(ROWS)
    assert pii.redacted(empty(spark)).count() == 0


def test_contexts_discover(spark):
    """Identifiers of no fixed shape are found in the contexts of those that have one, and only there."""
    rows = [(k, f"Please call me at +1 (212) 555-01{k:02d} after the lunch hour number {k}") for k in range(20)]
    rows += [(100 + k, f"Please call me at 555-02{k:02d} after the lunch hour") for k in range(5)]
    rows += [(200 + k, f"the invoice 2024{k:04d} was paid in full") for k in range(20)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k in range(5):
        assert got[100 + k].spans == "phone:18:26" and got[100 + k].n_phone == 0
        assert got[100 + k].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(got[200 + k].spans == "" for k in range(20))
    assert all(got[k].spans == f"phone:18:35" for k in range(20))


@pytest.mark.parametrize("text, want", [("no data", "no data"), ("mail a@b.cd now", "mail [EMAIL] now"), ("é😀 +1 (212) 555-0100, 1.2.3.4", "é😀 [PHONE], [IP]"), (None, None)])
def test_redaction(spark, text, want):
    out = pii.redacted(spark.createDataFrame([(1, text, "x", 3)], "doc_id bigint, text string, spans string, n_chars bigint")).first()
    assert out.text == want and out.spans == "x"
    assert out.n_chars == (3 if text == want else len(want))


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii.spots(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
