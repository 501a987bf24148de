"""The rounds of discovery, replayed with sets and dictionaries."""

import math
import random
import re
from collections import defaultdict

from maskwright.llm import pii
from tests.llm.test_pii import plain

BREAK = " \t\n\v\f\r\"'=<>|,;"
GROUP = r"[(]?[0-9]{1,6}(?:[.-][0-9]{1,6})*[)]?"


def tokens(text):
    """Runs of short groups of digits, else whole tokens with a digit or an at sign, trimmed."""
    out, at = [], 0
    while at < len(text):
        if text[at] in BREAK:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] not in BREAK:
            end += 1
        run = re.match(rf"{GROUP}(?: {GROUP})+(?![^{re.escape(BREAK)}:.!?])", text[at:])
        if run:
            end = at + run.end()
        if run or re.search("[0-9@]", text[at:end]):
            a, b = at, end
            while a < b and not text[a].isalnum():
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if a < b:
                out.append((a, b))
        at = end
    return out


def shape(value):
    if re.fullmatch("[0-9a-f]{16,}", value) and re.search("[0-9]", value) and re.search("[a-f]", value):
        return f"hex{len(value)}"
    return re.sub("[^\\W\\d_]+", "a", re.sub(r"\d", "0", value))


def patterns(text, start, end):
    words = lambda side: re.findall("(?:[^\\W_])+|[=:#]", re.sub(r"\d", "0", side.lower()))
    before, after, of = words(text[max(0, start - 80) : start]), words(text[end : end + 80]), shape(text[start:end].lower())
    found = {("##", of)}
    if before:
        found.add(("#<", before[-1], of))
    if len(before) > 1:
        found.add(("<<", before[-2], before[-1]))
    if before and after:
        found.add(("<>", before[-1], after[0]))
    if len(after) > 1:
        found.add((">>", after[0], after[1]))
    return found


def replayed(texts):
    """Spans of each text as the query lists them."""
    spots = []
    for n, text in enumerate(texts):
        base = plain(text)
        spots += [(n, a, b, k) for k, a, b in base]
        for a, b in tokens(text):
            if not any(a < y and x < b for _, x, y in base):
                value = text[a:b].lower()
                random_ = re.fullmatch("[a-z0-9+/_-]{16,}", value) and re.search("[0-9]", value) and re.search("[a-z]", value)
                named = re.search(r"(token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*[\"']?$", text[max(0, a - 80) : a].lower())
                spots.append((n, a, b, "secret" if random_ and named else None))
    value = lambda s: texts[s[0]][s[1] : s[2]].lower()
    picks, seeds = defaultdict(set), defaultdict(set)
    for s in spots:
        for p in patterns(texts[s[0]], s[1], s[2]):
            picks[p].add(value(s))
        if s[3]:
            seeds[value(s)].add(s[3])
    known, accepted = {(v, k): 1.0 for v, kinds in seeds.items() for k in kinds}, {}
    before = -1
    while len(accepted) > before:  # until a round adds nothing
        before = len(accepted)
        score = defaultdict(float)
        for values in picks.values():
            for k in pii.KINDS:
                mass = round(sum(known.get((v, k), 0) for v in values), 6)
                if mass >= pii.LEAST_KNOWN and mass >= pii.LEAST_SHARE * len(values):
                    for v in values:
                        if v not in seeds:
                            score[v, k] += mass / len(values) * math.log2(mass)
        accepted = {vk: round(s, 6) for vk, s in score.items() if round(s, 6) >= pii.LEAST_SCORE}
        known = {(v, k): 1.0 for v, kinds in seeds.items() for k in kinds} | {vk: 1 - math.exp(-s) for vk, s in accepted.items()}
    kind = {v: min(kinds, key=pii.KINDS.index) for v, kinds in seeds.items()}
    for (v, k), s in sorted(accepted.items(), key=lambda x: (x[1], -pii.KINDS.index(x[0][1]))):
        kind[v] = k
    out = [set() for _ in texts]
    for s in spots:
        if k := s[3] or kind.get(value(s)):
            out[s[0]].add((pii.KINDS.index(k), s[1], s[2]))
    return [",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(x)) for x in out]


def same(spark, texts):
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = replayed(texts)
    assert [got[n].spans for n in range(len(texts))] == want
    return sum(r.n_found for r in got.values())


def luhn(rng, fits):
    digits = [rng.randrange(10) for _ in range(15)]
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits))
    last = -total % 10
    return "".join(map(str, digits)) + str(last if fits else (last + rng.randrange(1, 10)) % 10)


def written(seed):
    """Texts with numbers that pass and fail their check, named and unnamed secrets, and numbers that are nothing."""
    rng = random.Random(seed)
    word = lambda: rng.choice("amber birch cedar delta ember frost grove heron".split())
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = []
    for n in range(120):
        made = rng.choice([
            lambda: luhn(rng, True), lambda: luhn(rng, False), lambda: f'token = "{hexed()}"', lambda: f'api_key: {hexed().upper()}', lambda: f'token = "short-{rng.randrange(1000)}"', hexed,
            lambda: f"call me at +1 ({rng.randrange(1000):03}) 555-{rng.randrange(10000):04} today", lambda: f"call me at 555-{rng.randrange(10000):04} today", lambda: f"call me at 020 7946 {rng.randrange(10000):04} today",
            lambda: f"write to {word()}.{rng.randrange(100)}@mail.example.com soon", lambda: f"write to {word()}{rng.randrange(100)}@localhost soon", lambda: f"invoice {rng.randrange(10**6)} of {rng.randrange(1990, 2030)}", lambda: f"{luhn(rng, True)} {luhn(rng, True)}",
            lambda: f"at 10.{rng.randrange(256)}.0.{rng.randrange(300)}",
        ])()
        texts.append(f"{word()} {word()} {made} {word()}, {word()}.")
    return texts


def test_rounds(spark):
    for seed in range(2):
        assert same(spark, written(seed)) > 20


def test_rounds_over_the_documents(spark):
    """What the contexts add to the fixed shapes is what was planted: card numbers without a valid check digit, and secrets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text or "" for r in docs.orderBy("doc_id").select("text").collect()]
    assert same(spark, texts) > 20
    want, got = set(), set()
    for n, (text, spans) in enumerate(zip(texts, replayed(texts), strict=True)):
        want |= {(n, m.start(), m.end()) for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", text)}
        want |= {(n, m.start(1), m.end(1)) for m in re.finditer('(?i)token = "([0-9a-f]{40})"', text)}
        base = {(a, b) for _, a, b in plain(text)}
        want -= {(n, a, b) for a, b in base}
        got |= {(n, a, b) for _, a, b in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)) if (a, b) not in base}
    assert len(want & got) >= 0.9 * len(want) > 10 and len(want & got) >= 0.9 * len(got)


def test_many_matches_in_one_text(spark):
    """The work grows with the matches, not with their square."""
    text = " ".join(f"u{n}@mail.example.com" if n % 2 else f"{n:08}" for n in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = pii.personal_data(docs).first()
    assert row.n_email == 50_000
    assert pii.redacted(docs).first().text.count("[EMAIL]") == 50_000
