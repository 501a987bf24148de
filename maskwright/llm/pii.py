"""Personal data: fixed shapes, and what contexts learned from them discover.

Everything here is DataFrame work on the JVM. The seeds are the fixed shapes
(email, ip, card, phone) and secrets: random values of which the text itself
says that they are a token, key or password. What stands around a seed and how
its characters follow each other make lexical patterns; other tokens with a
digit or an at sign are instances of unknown kind. Patterns and instances form
a bipartite graph, whose scores are refined in rounds: a pattern is worth the
share of known instances among all that it picks out, times the logarithm of
their number, and an instance is as likely as the sum of the patterns that pick
it out. Instances that reach the threshold are known in the next round, so they
bring in patterns of their own, and are spans at the end. After Riloff and
Jones, "Learning Dictionaries by Multi-Level Bootstrapping" (1999).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import cut, let, matches, overlapping, running, spliced, stretches
from maskwright.llm.common import salted_join, shared_checkpoint, unused

#: The kinds of the fixed shapes, and the one whose seeds the text names.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SECRET, OTHER = len(BASE), len(KINDS)
#: Possessive where the shape leaves no choice, so that long runs need neither stack nor backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BLANK = r"\x20\x09-\x0D"
#: What ends a token besides white space.
BREAK = rf"{BLANK}\"'=<>|,;"
#: A short group of digits of a number that is written in groups.
GROUP = r"[(]?[0-9]{1,6}+(?:[.-][0-9]{1,6}+)*+[)]?"
#: Instances: runs of short groups of digits, and tokens with a digit or an at sign.
TOKEN = rf"(?<![^{BREAK}])(?:{GROUP}(?:\x20{GROUP})++(?![^{BREAK}:.!?])|(?=[^{BREAK}0-9@]*+[0-9@])[^{BREAK}]++)"
#: What names a secret, and how random a secret looks, in lower case.
NAMED = r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[\x20\t]*[=:][\x20\t]*[\"']?$"
RANDOM = r"^(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])[a-z0-9+/_-]{16,}$"
#: Characters of context on each side; values longer than LONGEST are known by their hash; rounds at most, after which something is wrong.
CONTEXT, LONGEST, ROUNDS = 80, 64, 100
#: Known instances and their share of all that a pattern needs, and the score that an instance needs.
LEAST_KNOWN, LEAST_SHARE, LEAST_SCORE = 3, 0.4, 2.0

SPOT = "struct<kind: int, start: int, end: int, value: string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    from_right = F.split(F.reverse(digits), "")

    def weighed(d: Column, k: Column) -> Column:
        doubled = d.cast("int") * (1 + k % 2)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    luhn = F.aggregate(F.transform(from_right, weighed), F.lit(0), lambda a, x: a + x) % 10
    return F.when(F.length(digits).between(16, 19), luhn == 0).otherwise(False)


def _spot(kind: Column, start: Column, end: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))


def _none() -> Column:
    return F.expr(f"cast(array() as array<{SPOT}>)")


def base_spans(text: Column) -> Column:
    """Array of ``(kind, start, end, value)`` of the fixed shapes, by kind as in KINDS, then by start."""
    shapes = (
        (F.contains(text, F.lit("@")), EMAIL, None),
        (text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), IP, _is_ip),
        (text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), CARD, _is_card),
        (text.rlike(r"\+[0-9]"), PHONE, lambda v: F.length(_digits(v)).between(8, 15)),
    )

    def of_kind(kind: int, guard: Column, pattern: str, valid: Callable[[Column], Column] | None) -> Column:
        found = matches(text, pattern, "value")
        found = F.filter(found, lambda s: valid(s["value"])) if valid else found
        return F.coalesce(F.when(guard, F.transform(found, lambda s: _spot(F.lit(kind), s["start"], s["end"], s["value"]))), _none())

    return F.concat(*(of_kind(kind, *shape) for kind, shape in enumerate(shapes)))


def _free(tokens: Column, base: Column) -> Column:
    """The tokens that touch no base span: in one order, with the furthest end before and the next start after."""

    def kept(every: Column) -> Column:
        base_of = lambda s: s["kind"] < OTHER
        end = running(F.transform(every, lambda s: F.when(base_of(s), s["end"]).otherwise(0)), 0, "greatest")
        far = 2**31 - 1
        start = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(base_of(s), s["start"]).otherwise(far))), far, "least"))
        both = F.zip_with(F.zip_with(every, end, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), start, lambda x, n: F.struct(x["s"].alias("s"), x["e"].alias("e"), n.alias("n")))
        free = F.filter(both, lambda x: ~base_of(x["s"]) & (x["s"]["start"] >= x["e"]) & (x["s"]["end"] <= x["n"]))
        return F.transform(free, lambda x: _spot(x["s"]["kind"], x["s"]["start"], x["s"]["end"], x["s"]["value"]))

    def ordered(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(F.array_sort(F.transform(F.concat(base, tokens), ordered)), kept))


def other_tokens(text: Column, base: Column) -> Column:
    """Instances that touch no base span, without the signs at their ends."""

    def trimmed(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], r"^[^\p{L}\p{N}]*+", 0))
        core = F.regexp_replace(s["value"], r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", "")
        return _spot(F.lit(OTHER), s["start"] + lead, s["start"] + lead + F.length(core), core)

    tokens = F.filter(F.transform(matches(text, TOKEN, "value"), trimmed), lambda s: s["end"] > s["start"])
    return let(F.coalesce(F.when(text.rlike("[0-9@]"), tokens), _none()), lambda found: let(base, lambda b: _free(found, b)))


def spots_of(text: Column) -> Column:
    """Array of a text's spots: base spans, secrets that the text names, and instances, each with its patterns.

    The value of an instance is in lower case, or its hash if it is long.
    """

    def with_patterns(parts: Column, s: Column) -> Column:
        left, right = cut(parts, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"]), cut(parts, s["end"], s["end"] + CONTEXT)
        low = F.lower(s["value"])
        named = (s["kind"] == OTHER) & low.rlike(RANDOM) & F.lower(left).rlike(NAMED)
        key = F.when(F.length(low) > LONGEST, F.sha2(low.cast("binary"), 256)).otherwise(low)
        return F.struct(F.when(named, SECRET).otherwise(s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), key.alias("value"), _patterns(left, right, low).alias("patterns"))

    def placed(found: Column) -> Column:
        return let(stretches(text), lambda parts: F.transform(found, lambda s: with_patterns(parts, s)))

    whole = let(base_spans(text), lambda base: F.concat(base, other_tokens(text, base)))
    return F.coalesce(F.when(text.rlike("[0-9@]"), let(whole, lambda found: F.when(F.size(found) > 0, placed(found)))), F.expr("cast(array() as array<struct<kind: int, start: int, end: int, value: string, patterns: array<bigint>>>)"))


def _shape(value: Column) -> Column:
    """How the characters of a value in lower case follow each other; runs of letters are as one, digits are not."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\p{N}", "0"), r"\p{L}++", "a")
    mixed = value.rlike("^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}$")
    return F.when(mixed, F.concat(F.lit("hex"), F.length(value).cast("string"))).otherwise(plain)


def _patterns(left: Column, right: Column, value: Column) -> Column:
    """Hashes of the patterns of a spot; digits are alike in words.

    Two words before, one on each side, two words after, the shape of the
    value, and the shape with the word before.
    """
    words = lambda side: F.regexp_extract_all(F.regexp_replace(F.lower(side), r"\p{N}", "0"), F.lit(r"[\p{L}\p{M}\p{N}]+|[=:#]"), F.lit(0))

    def of(name: str, *parts: Column) -> Column:
        return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.xxhash64(F.lit(name), *parts))

    def made(before: Column, after: Column, shape: Column) -> Column:
        b1, b2 = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2))
        a1, a2 = F.try_element_at(after, F.lit(1)), F.try_element_at(after, F.lit(2))
        return F.array_compact(F.array(of("<<", b2, b1), of("<>", b1, a1), of(">>", a1, a2), of("##", shape), of("#<", b1, shape)))

    return let(words(left), lambda before: let(words(right), lambda after: let(_shape(value), lambda shape: made(before, after, shape))))


def spots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, spots)`` for each row: the hash of its text and its spots."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))
    return slim.select("doc_id", "h", spots_of(F.col("t")).alias("spots"))


def discovered(found: DataFrame) -> DataFrame:
    """``(value, kind)`` of the instances of unknown kind that the rounds accept, and of the seeds.

    Rounds go on until one accepts no value of a kind that the round before did
    not: what is known only grows, and so do all scores, so there is an end.

    A value that is a seed at one place is known wherever else it stands.

    Scores are over distinct pairs of pattern and value, so copies of a text
    add nothing. Patterns that pick out fewer values than LEAST_KNOWN can never
    count and go before any round. Both directions of a round are pre-aggregated
    sums, and their joins are salted: a shape or a value may be in a third of
    all pairs.
    """
    pairs = shared_checkpoint(found.select(F.explode("spots").alias("s")).select("s.value", "s.kind", F.explode("s.patterns").alias("pattern")).distinct())
    edges = pairs.select("pattern", "value").distinct()
    often = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("picked")).filter(F.col("picked") >= LEAST_KNOWN)
    edges = shared_checkpoint(salted_join(edges, often, "pattern", F.col("value")))
    seeds = pairs.filter(F.col("kind") < OTHER).select("value", "kind", F.lit(1.0).alias("known")).distinct()
    known, accepted = seeds, -1
    for _ in range(ROUNDS):
        worth = salted_join(edges, known, "value", F.col("pattern")).groupBy("pattern", "kind").agg(F.round(F.sum("known"), 6).alias("mass"), F.max("picked").alias("picked"))
        worth = worth.filter((F.col("mass") >= LEAST_KNOWN) & (F.col("mass") >= LEAST_SHARE * F.col("picked")))
        worth = worth.select("pattern", "kind", (F.col("mass") / F.col("picked") * F.log2("mass")).alias("worth"))
        likely = salted_join(edges.select("pattern", "value"), worth, "pattern", F.col("value")).groupBy("value", "kind").agg(F.round(F.sum("worth"), 6).alias("score"))
        likely = shared_checkpoint(likely.filter(F.col("score") >= LEAST_SCORE).join(seeds.select("value").distinct(), "value", "left_anti"))
        known = seeds.unionByName(likely.select("value", "kind", (1 - F.exp(-F.col("score"))).alias("known")))
        before, accepted = accepted, likely.count()
        if accepted <= max(before, 0):
            break
    else:
        raise RuntimeError(f"values are still accepted after {ROUNDS} rounds")
    best = likely.groupBy("value").agg(F.max(F.struct("score", -F.col("kind"), "kind")).alias("b"))
    return best.select("value", F.col("b.kind").alias("kind")).unionByName(seeds.groupBy("value").agg(F.min("kind").alias("kind")))


BARE = "array<struct<kind: int, start: int, end: int>>"


def _bare(spots_: Column, low: int, high: int) -> Column:
    return F.transform(F.filter(spots_, lambda s: s["kind"].between(low, high)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def all_spans(found: DataFrame) -> DataFrame:
    """``(doc_id, h, base, spans)``: arrays of ``(kind, start, end)``, the second with secrets and what was discovered.

    Only rows with an instance meet the accepted values; the others are not shuffled.
    """
    has = F.exists("spots", lambda s: s["kind"] == OTHER)
    some = found.filter(has)
    others = some.select("doc_id", "h", F.explode(F.filter("spots", lambda s: s["kind"] == OTHER)).alias("s")).select("doc_id", "h", "s.start", "s.end", "s.value")
    new = salted_join(others, discovered(found), "value", F.col("h")).groupBy("doc_id", "h").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))
    new = new.select(F.xxhash64("doc_id", "h").alias("k"), F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h"), "new")
    # Repeats of one row are dealt by where they lie in the checkpoint, as nothing else tells them apart.
    met = salted_join(some.withColumn("k", F.xxhash64("doc_id", "h")), new, "k", F.spark_partition_id(), "left")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_h"))
    met = met.select("doc_id", "h", "spots", F.coalesce(F.when(same, F.col("new")), F.expr(f"cast(array() as {BARE})")).alias("new"))
    rows = met.unionByName(found.filter(~has).select("doc_id", "h", "spots", F.expr(f"cast(array() as {BARE})").alias("new")))
    return rows.select("doc_id", "h", _bare(F.col("spots"), 0, SECRET - 1).alias("base"), F.array_sort(F.concat(_bare(F.col("spots"), 0, SECRET), "new")).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the count of base spans of each kind, ``base_sha256``, ``spans``, ``n_found``.

    ``spans`` lists ``kind:start:end`` by kind as in KINDS, then by start, in
    code points, with named secrets and the spans that contexts discovered;
    ``n_found`` counts these; ``base_sha256`` is of the same list of base spans
    alone. A null text is empty and has no span. Repeated rows have the same
    spans each; ids of any type, nulls among them, stay as they are; an empty
    table gives an empty table; other columns, whatever their names, are not
    read.
    """
    rows = all_spans(shared_checkpoint(spots(docs, id_col, text_col)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    hashed = F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", *map(count, range(len(BASE))), hashed, _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_found"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with each span replaced by its kind in brackets.

    Overlapping spans become one, named after the first. A column with the
    length of the text, if there is one, follows the text. Null texts stay
    null, repeated rows stay repeated, an empty table stays empty, and columns
    of any other name are carried along. Rows without a spot pass by the join.
    """
    spans = all_spans(shared_checkpoint(spots(docs, id_col, text_col))).filter(F.size("spans") > 0).groupBy("doc_id", "h").agg(F.first("spans").alias("s"))
    a, b, c, k, out, here = unused(docs.columns, 6)
    spans = spans.select(F.xxhash64("doc_id", "h").alias(k), F.col("doc_id").alias(a), F.col("h").alias(b), F.col("s").alias(c))
    text, hashed = F.col(f"`{text_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # The same test as in spots_of: what it turns down has no span.
    may = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    marked = docs.filter(may).withColumn(here, F.spark_partition_id()).withColumn(k, F.xxhash64(F.col(f"`{id_col}`"), hashed))
    met = salted_join(marked, spans, k, F.struct(F.col(k), F.col(here)), "left")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(a)) & (hashed == F.col(b))
    # Of spans by start, those that begin before the furthest end of the ones before are part of one of these.
    by_start = F.array_sort(F.transform(F.when(same, F.col(c)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*(F.lit(f"[{n.upper()}]") for n in KINDS))
    folded = spliced(text, merged(by_start), lambda s: F.element_at(names, s["kind"] + 1))
    met = met.withColumn(out, F.when(same, folded).otherwise(text))
    changes = [met[f"`{n}`"] for n in docs.columns]
    for at, name in enumerate(docs.columns):
        if name == text_col:
            changes[at] = F.col(out).alias(name)
        elif name == length_col:
            changes[at] = F.when(same, F.length(out).cast(docs.schema[name].dataType)).otherwise(F.col(f"`{name}`")).alias(name)
    return met.select(*changes).unionByName(docs.filter(~may))


def merged(by_start: Column) -> Column:
    """Disjoint spans from spans by start: each run of overlapping ones is one, of the first one's kind."""
    return F.transform(overlapping(by_start), lambda run: F.struct(run[0]["start"].alias("start"), F.array_max(F.transform(run, lambda s: s["end"])).alias("end"), run[0]["kind"].alias("kind")))
