"""Named entities: where they come from, and the rules that filter them.

Entities are an input: ``ARRAY<STRUCT<start, end, label>>`` for each block, from
any model, with the labels PERSON, ORGANIZATION and LOCATION. ``heuristic`` is
a stand-in for a model: runs of capitalised words, labelled by their words.
Its recall is unmeasured. The rules below work on either.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import words
from maskwright.operators import spans
from maskwright.operators.recognizers import ORDER_STEP

#: Edge punctuation of an entity, as the inside of a character class.
EDGE = " \\t\\n\\r\"'“”‘’(),;:./-"
#: Names as capitalised words in a row, in Java's syntax; possessive, so that long runs need no stack.
CAPITALISED = r"(?U)(?<![\w])[\p{Lu}][\w.'’-]*(?:[ \t]+(?:[\p{Lu}][\w.'’-]*+|&|of(?=[ \t]+\p{Lu})))++"
PRIORITY = {"PERSON": 45, "ORGANIZATION": 40, "LOCATION": 35}
NAMES = {"PERSON": "person", "ORGANIZATION": "organization", "LOCATION": "location"}


def heuristic(text: Column, v: words.Vocabulary = words.DEFAULT) -> Column:
    """Entities of a text by capital letters alone."""
    found = F.when(text.rlike(r"\p{Lu}"), spans.find(text, CAPITALISED))

    def labelled(s: Column) -> Column:
        label = lambda w: F.when(words.suffixed(w, v), "ORGANIZATION").when(words.placed(w, v), "LOCATION").otherwise("PERSON")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.transform(F.array(words.words_of(s["text"])), label)[0].alias("label"))

    return F.coalesce(F.transform(found, labelled), F.expr("cast(array() as array<struct<start: int, end: int, label: string>>)"))


def trimmed(text: Column, entities: Column) -> Column:
    """Entities without edge punctuation and a leading article, of two characters or more; overlong ends are cut."""

    def trim(e: Column) -> Column:
        raw = F.substring(text, e["start"] + 1, e["end"] - e["start"])
        lead = F.length(F.regexp_extract(raw, f"^[{EDGE}]*+(?i:the )?", 0))
        bare = F.length(F.regexp_extract(raw, f"^[{EDGE}]*+", 0))
        core = F.regexp_replace(F.substring(raw, bare + 1, F.length(raw)), f"[{EDGE}]+$", "")
        value = F.substring(core, lead - bare + 1, F.length(core))
        return F.struct((e["start"] + lead).alias("start"), (e["start"] + lead + F.length(value)).alias("end"), value.alias("text"), e["label"].alias("label"))

    return F.filter(F.transform(F.coalesce(entities, F.expr("cast(array() as array<struct<start: int, end: int, label: string>>)")), trim), lambda e: F.length(e["text"]) >= 2)


def _upper_initial(word: Column) -> Column:
    return word.rlike(r"^[\p{Lu}\p{Lt}]")


def _geo(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit("."), F.lit(""))


def _judged(e: Column) -> Column:
    """An entity with its tokens and words, which all rules share."""
    return e.withField("tokens", words.tokens(e["text"])).withField("words", words.words_of(e["text"]))


def keeps_person(e: Column, v: words.Vocabulary = words.DEFAULT) -> Column:
    """Two words or more that begin with a letter, all capitalised; no digit, company suffix or place word."""
    named = F.filter(e["tokens"], lambda w: w.rlike(r"^\p{L}"))
    return ~words.has_digit(e["text"]) & ~words.suffixed(e["words"], v) & ~words.placed(e["words"], v) & (F.size(named) >= 2) & F.forall(named, _upper_initial)


def skips_organization(e: Column, v: words.Vocabulary = words.DEFAULT) -> Column:
    return words.institutional(e["words"], v) | words.placed(e["words"], v) | F.array_contains(words.listed(v.geo_keep), _geo(e["text"]))


def keeps_organization(e: Column, v: words.Vocabulary = words.DEFAULT) -> Column:
    big = F.filter(e["tokens"], lambda w: (F.length(w) > 1) & _upper_initial(w))
    return ~words.generic_only(e["words"], v) & (words.suffixed(e["words"], v) | (F.size(big) >= 2))


def keeps_location(e: Column, v: words.Vocabulary = words.DEFAULT) -> Column:
    known = F.array_contains(words.listed(v.geo_keep + v.not_a_place), _geo(e["text"]))
    return ~known & ~words.with_jargon(e["words"], v) & (F.length(e["text"]) >= 3) & _upper_initial(e["text"])


def _split_pairs(entities: Column, v: words.Vocabulary) -> Column:
    """Names of two people or more in one entity, joined by a slash."""

    def parts(e: Column) -> Column:
        pieces = F.split(e["text"], "/")
        starts = F.aggregate(pieces, F.array(F.lit(0)), lambda made, p: F.concat(made, F.array(F.element_at(made, -1) + F.length(p) + 1)))

        def named(p: Column, k: Column) -> Column:
            lead = F.length(F.regexp_extract(p, r"(?U)^\s*", 0))
            bare = F.regexp_replace(p, r"(?U)^\s+|\s+$", "")
            begin = e["start"] + F.element_at(starts, k + 1) + lead
            return F.struct(begin.alias("start"), (begin + F.length(bare)).alias("end"), bare.alias("text"), F.lit("PERSON").alias("label"))

        good = F.filter(F.transform(F.transform(pieces, named), _judged), lambda s: (s["text"] != "") & keeps_person(s, v) & (F.size(F.split(s["text"], r"(?U)\s+")) >= 2))
        return F.filter(good, lambda s: F.size(good) >= 2)

    return F.flatten(F.transform(F.filter(entities, lambda e: F.contains(e["text"], F.lit("/"))), parts))


def _accepted(entities: Column, label: str, v: words.Vocabulary) -> Column:
    skip = {"PERSON": lambda e: F.lit(False), "ORGANIZATION": lambda e: skips_organization(e, v), "LOCATION": lambda e: words.institutional(e["words"], v)}[label]
    keep = {"PERSON": keeps_person, "ORGANIZATION": keeps_organization, "LOCATION": keeps_location}[label]
    least = 1 if label == "LOCATION" else 2
    own = F.filter(entities, lambda e: (e["label"] == label) & ~skip(e))

    def edged(e: Column) -> Column:
        cut = lambda edge: F.struct(
            (e["start"] + edge["start"]).alias("start"), (e["start"] + edge["end"]).alias("end"), F.substring(e["text"], edge["start"] + 1, edge["end"] - edge["start"]).alias("text"), e["label"].alias("label")
        )
        return F.transform(F.filter(F.array(words.strip_jargon_edges(e["text"], v)), lambda edge: edge.isNotNull()), cut)

    cut = F.transform(F.flatten(F.transform(own, edged)), _judged)
    return F.filter(cut, lambda e: (F.size(e["tokens"]) >= least) & ~words.jargon_only(e["words"], v) & keep(e, v))


def prepared(text: Column, entities: Column) -> Column:
    """Entities as ``candidates`` takes them: trimmed, with their words. Keep it as a column of its own."""
    return F.transform(trimmed(text, entities), _judged)


def candidates(found: Column, v: words.Vocabulary = words.DEFAULT, position: int = 100) -> Column:
    """Spans from prepared entities: each label's own, people joined by a slash, companies filed as people, places filed as either."""
    companies = F.filter(found, lambda e: (e["label"] == "PERSON") & words.suffixed(e["words"], v) & ~words.jargon_only(e["words"], v))
    places = F.filter(found, lambda e: (e["label"] != "LOCATION") & words.placed(e["words"], v) & ~words.with_jargon(e["words"], v))
    groups = (
        ("LOCATION", 0.7, _accepted(found, "LOCATION", v)),
        ("LOCATION", 0.6, places),
        ("ORGANIZATION", 0.7, _accepted(found, "ORGANIZATION", v)),
        ("ORGANIZATION", 0.7, companies),
        ("PERSON", 0.8, _accepted(found, "PERSON", v)),
        ("PERSON", 0.75, _split_pairs(found, v)),
    )

    def made(k: int, label: str, score: float, entities_: Column) -> Column:
        return F.transform(
            entities_,
            lambda e, n: F.struct(
                e["start"].alias("start"),
                e["end"].alias("end"),
                e["text"].alias("text"),
                F.lit(label).alias("label"),
                F.lit(NAMES[label]).alias("recognizer"),
                F.lit(score).alias("score"),
                F.lit(PRIORITY[label]).alias("priority"),
                (F.lit((position + k) * ORDER_STEP).cast("bigint") + n).alias("ord"),
            ),
        )

    return F.when(F.size(found) > 0, F.concat(*(made(k, *g) for k, g in enumerate(groups)))).otherwise(spans.empty())
