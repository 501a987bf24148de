"""Work over a whole corpus as one scope: numbers, identities, names, overlaps, each against a plain program."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.operators import gazetteer, identity, policies, ranking, scoring
from maskwright.plans import redact


def test_numbers_are_those_of_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "x", "x", "y"]), n, f"t{rng.randint(0, 3)}") for n in range(900)]
    rows += [("hot", "x", n, "t") for n in range(3000)] + [(f"s{n}", "z", n, "t") for n in range(300)]
    data = spark.createDataFrame(rows, "g string, h string, at int, text string")
    got = ranking.numbered(data, ["g", "h"], ["at", "text"])
    assert got.columns == ["g", "h", "at", "text", "n"]
    seen, want = {}, []
    for g, h, at, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2], r[3])):
        seen[g, h] = seen.get((g, h), 0) + 1
        want.append((g, h, at, text, seen[g, h]))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert ranking.numbered(data.limit(0), ["g", "h"], ["at"]).count() == 0


def test_one_group_over_all_ranges(spark):
    data = spark.range(5000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 5003).alias("at"))
    got = ranking.numbered(data, ["g"], ["at"]).collect()
    assert [r.n for r in sorted(got, key=lambda r: r["at"])] == list(range(1, 5001))


def replayed(values, known):
    """Roots by the registry, one value after the other."""
    sign = lambda t: frozenset(w.lower() for w in re.findall("[A-Za-z]+", t) if len(w) > 1)
    out = {}
    for scope in {v[0] for v in values}:
        links = identity.Links()
        for name in sorted({n for s, n in known if s == scope}, key=lambda n: (-len(sign(n)), n)):
            links.resolve(sign(name), name)
        first = {}
        for s, label, text, doc, block, start in values:
            if s == scope:
                place = (doc, block, start)
                first[label, text] = min(first.get((label, text), place), place)
        for (label, text), _ in sorted(first.items(), key=lambda x: (x[1], x[0][0], x[0][1])):
            out[scope, label, text] = links.resolve(sign(text.split("@")[0] if label == "EMAIL" else text), text)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_identities_in_the_order_of_reading(spark, seed):
    rng = random.Random(seed)
    pool = ["Ann", "Bob", "Cy", "Dee", "Eve", "Flo", "Gus", "Hal", "Ida"]

    def name(longest):
        return " ".join(rng.sample(pool, rng.randint(1, longest)))

    values = []
    for n in range(260):
        mail = rng.random() < 0.4
        text = name(3 if n % 9 else 9)
        text = f"{text.replace(' ', '.').lower()}@x.co" if mail else rng.choice([text, text.upper(), "12", "x"])
        values.append((rng.choice(["c", "d", None]), "EMAIL" if mail else "PERSON", text, rng.randint(0, 40), rng.randint(0, 3), n))
    known = [(rng.choice(["c", "d"]), name(8)) for _ in range(12)] if seed else []
    rows = spark.createDataFrame(values, "scope string, label string, text string, doc int, block_idx int, start int")
    names = spark.createDataFrame(known, "scope string, name string") if known else None
    got = {(r.scope, r.label, r.text): r.root for r in identity.linked(policies.distinct_values(rows), names).collect()}
    assert got == replayed(values, known)


def test_a_long_chain_of_followers(spark):
    """Names that shrink and grow by one word, each the only relative of the next: the chain is halved in every round."""
    words = [f"w{chr(97 + k)}" for k in range(14)]
    values = [("s", "PERSON", " ".join(words[: k + 1]), "d", k, 0) for k in range(14)]
    rows = spark.createDataFrame(values, "scope string, label string, text string, doc string, block_idx int, start int")
    got = {(r.scope, r.label, r.text): r.root for r in identity.linked(rows).collect()}
    assert got == replayed(values, [])


def mentions(found):
    return sorted((r.block_idx, [(s.start, s.end, s.text, s.label) for s in r.found]) for r in found.collect())


def test_tries_find_what_the_join_finds(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(gazetteer, "TRIE", 60)
    names = list({" ".join(rng.choice(["Al", "Bo", "Ca", "Al-x", "D.", "Él", "李"]) for _ in range(rng.randint(2, 3))) for _ in range(40)})
    named = spark.createDataFrame([("corpus", rng.choice(["PERSON", "ORGANIZATION"]), n) for n in names], "scope string, label string, name string")
    texts = ["".join(rng.choice(["al", "Bo", "ca", "AL-X", "d.", "ÉL", "él", "李", " ", " ", " \t", "x", ",", "é"]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    blocks = spark.createDataFrame([("corpus", "d", k, t) for k, t in enumerate([*texts, None])], "scope string, doc string, block_idx int, text string")
    known = gazetteer.known_names(named)
    got = mentions(gazetteer.matched(blocks, known))
    assert got == mentions(gazetteer.matched_by_words(blocks, known)) and len(got) > 20
    assert gazetteer.matched(blocks, known.limit(0)).count() == 0


def test_many_names_in_one_corpus(spark):
    """A hundred thousand names over some blocks, without a key that all of them share."""
    names = spark.range(100_000).select(F.lit("corpus").alias("scope"), F.lit("PERSON").alias("label"), F.concat(F.lit("Nam"), F.col("id"), F.lit(" Fam"), F.col("id") % 977).alias("name"))
    blocks = spark.range(400).select(F.lit("corpus").alias("scope"), F.lit(1).alias("doc"), F.col("id").cast("int").alias("block_idx"), F.concat(F.lit("Saw nam"), F.col("id") * 240, F.lit("  FAM"), F.col("id") * 240 % 977, F.lit(" there")).alias("text"))
    rows = gazetteer.matched(blocks, names).collect()
    assert len(rows) == 400 and all([s.text for s in r.found] == [f"nam{r.block_idx * 240}  FAM{r.block_idx * 240 % 977}"] for r in rows)


def spans_of(rng, n, blocks):
    return [(rng.choice("st"), rng.randint(0, blocks), k, a, a + rng.choice([0, 1, 5, 70, 200]), rng.choice(["P", "E"])) for k in range(n) for a in [rng.randint(0, 300)]]


SPANS = "set string, block_idx int, ord int, start int, end int, label string"


def test_overlaps_by_bins(spark):
    rng = random.Random(7)
    a, b = spans_of(rng, 150, 4), spans_of(rng, 150, 4)
    a += a[:5]
    left, right = spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS)
    for typed in (True, False):
        meets = lambda x, y: x[:2] == y[:2] and x[3] < y[4] and y[3] < x[4] and (not typed or x[5] == y[5])  # noqa: E731, B023
        got = sorted(map(tuple, scoring.touched(left, right, typed).collect()))
        assert got == sorted(x for x in a if any(meets(x, y) for y in b))
        assert sorted(map(tuple, scoring.untouched(left, right, typed).collect())) == sorted(x for x in a if not any(meets(x, y) for y in b))
        used_e, used_p, want = set(), set(), []
        for x, y in sorted(((x, y) for x in set(a) for y in b if meets(x, y)), key=lambda p: (p[0][:2], p[0][2], p[1][2])):
            if (*x[:2], x[2]) not in used_e and (*y[:2], y[2]) not in used_p:
                used_e.add((*x[:2], x[2]))
                used_p.add((*y[:2], y[2]))
                want.append((*x[:2], x[2], y[2], x[5]))
        assert sorted(map(tuple, scoring.paired(left, right, typed).collect())) == sorted(want)


def test_many_spans_in_one_block(spark):
    """100,000 spans of one block, each of which overlaps its like and the next one."""
    made = lambda shift: spark.range(100_000).select(F.lit("s").alias("set"), F.lit(1).alias("block_idx"), F.col("id").cast("int").alias("ord"), (F.col("id") * 10 + shift).cast("int").alias("start"), (F.col("id") * 10 + shift + 6).cast("int").alias("end"), F.lit("P").alias("label"))
    a, b = made(0), made(5)
    assert scoring.touched(a, b, True).count() == 100_000 and scoring.untouched(a, b, True).count() == 0
    assert scoring.paired(a, b, True).filter("e_ord = p_ord").count() == 100_000


def test_mentions_start_over(spark):
    notes = [("s", 1, k, "P", v) for k, v in enumerate(["aa", "aa", "aa", "b.", "zz", "", r"\E", "aa"])]
    blocks = spark.createDataFrame([("s", 1, r"aaaa b. \E b.")], "set string, block_idx int, text string")
    got = {(r.ord): (r.start, r.end) for r in scoring.expected_spans(spark.createDataFrame(notes, "set string, block_idx int, ord int, label string, text string"), blocks).collect()}
    assert got == {0: (0, 2), 1: (2, 4), 2: (0, 2), 3: (5, 7), 4: (-1, 1), 5: (0, 0), 6: (8, 10), 7: (2, 4)}


def test_a_corpus_shares_its_people(spark):
    docs = spark.createDataFrame([(1, "Tarun Desai wrote to Mohini Rao.\nHis mail is tarun.desai@x.co."), (2, "TARUN DESAI and tarun.desai@x.co again."), (3, None), (2, "MOHINI RAO left.")], "doc_id int, text string")
    blocks, mapping = redact.redact(docs, "numbered", scope="corpus")
    by = {r.original: r.replacement for r in mapping.filter("label = 'PERSON'").collect()}
    assert by["Tarun Desai"] == "[PERSON_1]" and by["Mohini Rao"] == "[PERSON_2]" and by["MOHINI RAO"] == "[PERSON_3]"  # first of two values at one place
    texts = sorted((r.doc, r.redacted_text or "") for r in redact.joined_up(blocks).collect())
    assert texts == [(1, "[PERSON_1] wrote to [PERSON_2].\nHis mail is [EMAIL_1]."), (2, "[PERSON_3] left."), (2, "[PERSON_4] and [EMAIL_1] again."), (3, "")]
    blocks, mapping = redact.redact(docs, "fake", scope="corpus")
    by = {r.original: r.replacement for r in mapping.collect()}
    assert by["TARUN DESAI"] == by["Tarun Desai"].upper() and by["tarun.desai@x.co"] == by["Tarun Desai"].lower().replace(" ", ".") + "@example.com"
    with pytest.raises(ValueError):
        redact.blocks_of(docs, scope="page")
