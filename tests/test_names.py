"""Word predicates, entities, names seen again, identities and substitutes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import checks, surrogates, words
from maskwright.operators import entities, gazetteer, identity, policies, spans
from maskwright.plans import redact


def column(spark, values, expression):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, text string")
    return [r.x for r in rows.select("n", expression(F.col("text")).alias("x")).orderBy("n").collect()]


def test_word_predicates(spark):
    assert column(spark, ["“Acme” (Foo-Bar)/baz.", "a – b", ""], words.words_of) == [["acme", "foo", "bar", "baz"], ["a", "–", "b"], []]
    assert column(spark, ["Equity Shares", "x Offer", "Equity Acme", "", "q"], words.all_jargon) == [True, True, False, False, False]
    assert column(spark, ["Acme Ltd.", "Ltd Acme", "", "Acme Limited,"], words.has_company_suffix) == [True, False, False, True]
    assert column(spark, ["Bandra Complex", "complexity", "Plot 5"], words.has_place_word) == [True, False, True]
    assert column(spark, ["Bank Limited", "Acme Bank", ""], words.all_generic) == [True, False, False]
    assert column(spark, ["SEBI", "the Supreme Court of X", "process", "co", "Acme", ""], words.is_institution) == [True, True, True, False, False, False]
    assert column(spark, ["a1", "a²", "a", "٣"], words.has_digit) == [True, True, False, True]
    got = column(spark, ["Vasundra Kelar Website", "Offer Girija", "Equity Shares", "A  B", ""], words.strip_jargon_edges)
    assert [tuple(g) if g else None for g in got] == [(0, 14), (6, 12), None, (0, 4), None]


def spotted(spark, text, found):
    kind = "array<struct<start: int, end: int, label: string>>"
    rows = spark.createDataFrame([(text, [(text.index(v), text.index(v) + len(v), k) for v, k in found])], f"text string, e {kind}")
    (row,) = rows.withColumn("e", entities.prepared(F.col("text"), F.col("e"))).select("text", spans.resolve(entities.candidates(F.col("e"))).alias("s")).collect()
    assert all(text[s.start : s.end] == s.text for s in row.s)
    return {(s.text, s.label, s.score) for s in row.s}


def test_entity_rules(spark):
    text = "The Tarun Mehra Website, India; Girish Vora/ Debojit Mondal; Acme Foods Limited, Riverton Business Centre and Offer Price at N.A or Wagholi, SEBI"
    got = spotted(
        spark, text,
        [("The Tarun Mehra Website,", "PERSON"), ("India", "LOCATION"), ("Girish Vora/ Debojit Mondal", "ORGANIZATION"), ("Acme Foods Limited", "PERSON"), ("Riverton Business Centre", "ORGANIZATION"), ("Offer Price", "PERSON"), ("N.A", "LOCATION"), ("Wagholi", "LOCATION"), ("SEBI", "ORGANIZATION")],
    )
    assert {(v, k) for v, k, _ in got} == {("Tarun Mehra", "PERSON"), ("Girish Vora", "PERSON"), ("Debojit Mondal", "PERSON"), ("Acme Foods Limited", "ORGANIZATION"), ("Riverton Business Centre", "LOCATION"), ("Wagholi", "LOCATION")}
    assert ("Riverton Business Centre", "LOCATION", 0.6) in got and ("Girish Vora", "PERSON", 0.75) in got


def test_heuristic_entities(spark):
    (got,) = column(spark, ["yesterday Tarun Mehra met Acme Foods Limited in Bandra Kurla Complex"], entities.heuristic)
    assert [(e.start, e.label) for e in got] == [(10, "PERSON"), (26, "ORGANIZATION"), (48, "LOCATION")]


def test_long_runs(spark):
    """Very long runs of any shape neither overflow nor hang."""
    texts = ["The " * 30_000, "A." * 30_000 + " Limited", "1 " * 30_000, "x" * 60_000 + "@", "a@" + "b." * 20_000 + "c", "www." + "a." * 20_000, "+" + "1 " * 20_000, "1." * 20_000, "((" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    done = redact.with_placeholders(redact.detected(redact.blocks_of(docs), entities=True))
    assert done.count() == len(texts)
    assert redact.statistics(done).first().characters == sum(map(len, texts))


def mentions(spark, names, texts, label="PERSON"):
    known = gazetteer.known_names(spark.createDataFrame([("d", label, n) for n in names], "scope string, label string, name string"))
    blocks = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "scope string, block_idx int, text string")
    got = {r.block_idx: r.found for r in gazetteer.matched(blocks, known).collect()}
    return [sorted((s.start, s.end, s.text) for s in got.get(k, [])) for k in range(len(texts))]


def test_names_are_found_again(spark):
    names = ["Tarun Mohini Desai", "Mohini Desai", "Ann Lee", "Single", " Ann  Lee ", "J. (Jo) Smith", "李 小龙"]
    texts = ["TARUN  mohini\tDesai, and Mohini Desai", "Joann Leeson met ann lee.", "Single J. (Jo) Smith J. Jo Smith", "Tarun Mohini Desaiy", "见李 小龙了", ""]
    got = mentions(spark, names, texts)
    assert [[t for _, _, t in g] for g in got] == [["TARUN  mohini\tDesai", "Mohini Desai"], ["ann lee"], ["J. (Jo) Smith"], [], ["李 小龙"], []]
    assert got[1] == [(17, 24, "ann lee")]


def test_random_mentions(spark):
    rng = random.Random(4)
    names = list({" ".join(rng.choice(["Al", "Bo", "Ca", "Al-x", "D."]) for _ in range(rng.randint(2, 3))) for _ in range(12)})
    texts = ["".join(rng.choice(["al", "Bo", "ca", "AL-X", "d.", " ", " ", "  ", "x", ","]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    pattern = re.compile("(?<![A-Za-z])(?:" + "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in sorted(names, key=lambda n: (-len(n), n))) + ")(?![A-Za-z])", re.IGNORECASE)
    assert mentions(spark, names, texts) == [[(m.start(), m.end(), m[0]) for m in pattern.finditer(t)] for t in texts]


def test_known_names_are_linked_in_one_join(spark):
    rng = random.Random(8)
    for _ in range(3):
        names = [" ".join(rng.sample(["Ann", "Bob", "Cy", "Dee", "Eve"], rng.randint(1, 4))) for _ in range(12)] + ["x", "12"]
        got = {tuple(r.signature): tuple(r.root) for r in identity.primed(spark.createDataFrame([("d", n) for n in names], "scope string, name string")).collect()}
        links, want = identity.Links(), {}
        signature = lambda n: frozenset(w.lower() for w in re.findall("[A-Za-z]+", n) if len(w) > 1)
        for n in sorted(set(names), key=lambda n: (-len(signature(n)), n)):
            if signature(n):
                want[tuple(sorted(signature(n)))] = tuple(links.resolve(signature(n), n).split())
        assert got == want


def roots(spark, values, known=()):
    rows = spark.createDataFrame([("d", k, v, n, 0) for n, (k, v) in enumerate(values)], "scope string, label string, text string, block_idx int, start int")
    names = spark.createDataFrame([("d", n) for n in known], "scope string, name string")
    return {r.text: r.root for r in identity.linked(rows.repartition(3), names).collect()}


def test_people_and_their_addresses_are_one(spark):
    got = roots(spark, [("PERSON", "Nisha Gokal"), ("EMAIL", "nisha.gokal@gmail.com"), ("EMAIL", "12@x.co")])
    assert got["Nisha Gokal"] == got["nisha.gokal@gmail.com"] and got["12@x.co"] == "12@x.co"
    got = roots(spark, [("EMAIL", "mohini.desai@x.co"), ("PERSON", "Mohini Desai")], ["Tarun Mohini Desai", "Mohini Sekaran Desai"])
    assert got["mohini.desai@x.co"] == got["Mohini Desai"] == "desai mohini"
    got = roots(spark, [("EMAIL", "mohini.desai@x.co")], ["Tarun Mohini Desai"])
    assert got["mohini.desai@x.co"] == "desai mohini tarun"


def test_people_are_counted(spark):
    rows = [("d", "PERSON", v, n, 0) for n, v in enumerate(["Ann Lee", "ANN LEE", "Bob Ray", "ann.lee"])]
    values = spark.createDataFrame(rows, "scope string, label string, text string, block_idx int, start int")
    assert [tuple(r) for r in identity.how_many(identity.linked(values)).collect()] == [("d", 2)]


def test_substitutes_keep_the_shape(spark):
    shapes = {
        ("PHONE", "+ 91 20 4505 3237"): r"\+ 91 \d\d \d{4} \d{4}",
        ("PHONE", "044-71936620"): r"\d{3}-\d{8}",
        ("LOCATION", "410 501"): r"[1-9]\d\d \d{3}",
        ("LOCATION", "PUNE"): r"[A-Z ]+",
        ("DATE_OF_BIRTH", "14/08/1985"): r"[0-2]\d/[01]\d/(19|20)\d\d",
        ("DATE_OF_BIRTH", "1.2.90"): r"\d{1,2}\.\d{1,2}\.\d\d",
        ("DATE_OF_BIRTH", "March 3, 1970"): r"[A-Z][a-z]+ \d{1,2}, (19|20)\d\d",
        ("DATE_OF_BIRTH", "3rd March 1970"): r"\d{1,2} [A-Z][a-z]+ (19|20)\d\d",
        ("SSN", "123 45 6789"): r"\d{3} \d\d \d{4}",
        ("CREDIT_CARD", "4111 1111 1111 1111"): r"4\d{3}( \d{4}){3}",
        ("CREDIT_CARD", "4111111111111111"): r"4\d{15}",
        ("IP_ADDRESS", "10.0.0.1"): r"\d{1,3}(\.\d{1,3}){3}",
        ("URL", "https://www.acme.com/x"): r"https://www\.[a-z]+\.[a-z]+",
        ("URL", "www.acme.com"): r"www\.[a-z]+\.[a-z]+",
        ("ORGANIZATION", "acme limited"): r"[a-z ]+",
        ("BADGE", "x"): r"\[BADGE\]",
    }
    rows = spark.createDataFrame(list(shapes), "label string, text string")
    got = {(r.label, r.text): r.x for r in rows.select("label", "text", surrogates.substitutes(F.col("label"), F.col("text")).alias("x")).collect()}
    for key, shape in shapes.items():
        assert re.fullmatch(shape, got[key]), (key, got[key])
    assert surrogates.phone("+ 91 44 28316074").replace(" ", "") == surrogates.phone("+91-44-2831 6074").replace(" ", "").replace("-", "")
    cards = [surrogates.card(str(n)) for n in range(200)]
    assert all(column(spark, cards, checks.luhn)) and not any(column(spark, [c[:-1] + str((int(c[-1]) + 1) % 10) for c in cards], checks.luhn))
    assert [surrogates.check_digit(d) for d in ("411111111111111", "37828224631000")] == [1, 5]


def test_seeds_and_cases(spark):
    import hashlib

    values = ["a", "", "éß", "Tarun"]
    assert column(spark, values, checks.seed) == [int(hashlib.sha256(v.encode()).hexdigest()[:12], 16) for v in values]
    assert column(spark, ["ABC", "abc", "Abc", "12", "A1"], lambda c: checks.match_case(c, F.lit("John Doe"))) == ["JOHN DOE", "john doe", "John Doe", "John Doe", "JOHN DOE"]


DOCS = [("a", "Nisha Gokal wrote from nisha.gokal@gmail.com.\nplease call Nisha Gokal on +91 44 2831 6074"), ("b", "NISHA GOKAL, and again nisha.gokal@gmail.com"), ("c", None), ("d", ""), ("e", "Nothing here\n\nat all")]


def test_worked_example(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    blocks, mapping = redact.redact(docs)
    made = {(r.scope, r.label, r.original): r.replacement for r in mapping.collect()}
    name, mail = made["a", "PERSON", "Nisha Gokal"], made["a", "EMAIL", "nisha.gokal@gmail.com"]
    assert mail == ".".join(name.lower().split()) + "@example.com" and made["b", "EMAIL", "nisha.gokal@gmail.com"] == mail
    assert made["b", "PERSON", "NISHA GOKAL"] == name.upper()
    out = {r.scope: r for r in redact.joined_up(blocks).collect()}
    assert out["a"].redacted_text.startswith(f"{name} wrote from {mail}.\nplease call {name} on +91") and out["a"].n_replacements == 4
    assert "Nisha" not in out["a"].redacted_text and out["e"].redacted_text == "Nothing here\n\nat all" and out["c"].redacted_text is None
    again = {r.scope: r.redacted_text for r in redact.joined_up(redact.redact(docs.repartition(7))[0]).collect()}
    assert again == {k: r.redacted_text for k, r in out.items()}


def test_numbers_and_markers(spark):
    docs = spark.createDataFrame([("a", "b@x.co a@x.co\nb@x.co +91 44 2831 6074")], "doc_id string, text string")
    for name, want in (("numbered", "[EMAIL_1] [EMAIL_2]\n[EMAIL_1] [PHONE_1]"), ("placeholder", "[EMAIL] [EMAIL]\n[EMAIL] [PHONE]")):
        blocks, _ = redact.redact(docs, name, entities=False)
        assert redact.joined_up(blocks).first().redacted_text == want
        assert [tuple(r) for r in redact.by_label(blocks).orderBy("label").collect()] == [("EMAIL", 3), ("PHONE", 1)]
    with pytest.raises(KeyError):
        policies.policy("none")
    with pytest.raises(KeyError):
        redact.transform("none", redact.blocks_of(docs))


def test_statistics(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    done = redact.with_placeholders(redact.detected(redact.blocks_of(docs), ["email"]))
    stats = redact.statistics(done).first()
    assert tuple(stats) == (7, 5, sum(len(t.replace("\n", "")) for _, t in DOCS if t), 2)
    assert {r.category: r.n for r in redact.by_category(done).collect()}["EMAIL"] == 2 and redact.by_category(done).count() == 10
    mapping = redact.mapping_of(done, "placeholder")
    assert redact.searched(mapping, "EMAIL", "GMAIL").count() == 2 and redact.searched(mapping, "PHONE").count() == 0
    kept = redact.passed_through(redact.blocks_of(docs))
    assert {r.scope: r.redacted_text for r in redact.joined_up(kept).collect()} == dict(DOCS)


def test_documents_that_share_an_id_stay_apart(spark):
    """Repeated and null ids, equal texts and null texts: a row each, with its own offsets."""
    rows = [(1, "xx the first line\nmail a@b.co here"), (1, "another document c@d.co."), (1, "another document c@d.co."), (None, "no id e@f.co"), (None, None), (2, None), (2, ""), (3, "x\ny g@h.co")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    want = sorted(((i, None if t is None else re.sub(r"\w+@\w+\.co", "[EMAIL]", t), (t or "").count("@")) for i, t in rows), key=str)
    for passes in (1, 2):
        blocks, mapping = redact.redact(docs, "placeholder", passes=passes, only=["email"], entities=passes == 2)
        assert sorted(map(tuple, redact.joined_up(blocks).collect()), key=str) == want
        assert {(r.scope, r.original) for r in mapping.collect()} == {(1, "a@b.co"), (1, "c@d.co"), (None, "e@f.co"), (3, "g@h.co")}
    done = redact.with_placeholders(redact.detected(redact.blocks_of(docs, by_line=False), ["email"]))
    assert sorted(map(tuple, redact.joined_up(done).collect()), key=str) == want


def test_many_matches_in_one_text(spark):
    """Finding, settling and writing grow with the matches, not with their square."""
    text = " ".join(f"u{n}@x.co" for n in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    done = redact.with_placeholders(redact.detected(redact.blocks_of(docs), ["email"]))
    row = redact.joined_up(done).first()
    assert row.n_replacements == 100_000 and row.redacted_text == " ".join(["[EMAIL]"] * 100_000)
