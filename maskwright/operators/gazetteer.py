"""Names that are known already, found again wherever they stand.

A name is bounded by anything but an ASCII letter, case does not matter, and a
space in it is any white space; of mentions that overlap the leftmost stays,
and of those at one place the longest. There are two ways to the same mentions.
In documents with names of their own, names and blocks meet by an equi-join on
the longest word of the name, and one pattern of a block's few names finds
them. Where a whole corpus shares its names, these are dealt into tries of
bounded size, which are broadcast and walked once over each block, whatever the
number of names (Aho and Corasick, 1975); beyond so many tries the join serves
here too.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import arrays
from maskwright.operators import spans
from maskwright.operators.recognizers import ORDER_STEP

PRIORITY, SCORE = 50, 0.9
POSITION = {"PERSON": 200, "ORGANIZATION": 201}
#: Characters of the names in one trie (some 100,000 names, 100 MB in a worker), and tries at most before the join takes over.
TRIE, TRIES = 2_000_000, 4
#: White space as the pattern language has it.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def known_names(named: DataFrame, min_tokens: int = 2) -> DataFrame:
    """Distinct ``(scope, label, name)`` with enough words, of rows with these columns."""
    bare = F.regexp_replace("name", r"(?U)^\s+|\s+$", "")
    return named.select("scope", "label", bare.alias("name")).filter(F.size(F.split("name", r"(?U)\s+")) >= min_tokens).distinct()


def keys_of(blocks: DataFrame) -> list[str]:
    """The columns that name a block: its scope, the document in a scope of many, the row where ids may repeat, and its place."""
    return [c for c in ("scope", "doc", "row", "block_idx") if c in blocks.columns]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which nulls are equal; the right side's keys go."""
    of = {k: f"__of_{k}" for k in keys}
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in of.items()))
    joined = left.join(right.withColumnsRenamed(of), same, how)
    return joined.drop(*of.values())


def matched(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """The keys of blocks and ``found``, the mentions of names in them; blocks without one are left out.

    ``blocks`` has ``scope``, ``block_idx``, ``text`` and perhaps ``row`` and
    ``doc``; ``names`` is as ``known_names`` makes it. Blocks that are equal in
    all keys have the same text and give one row; a null text has no mention.
    """
    return matched_by_tries(blocks, names) if "doc" in blocks.columns else matched_by_words(blocks, names)


def matched_by_words(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """``matched`` by a join on words.

    Words meet names without the text of their block, which joins once, when
    its names are known. A name without an ASCII letter is tried on each block
    of its scope.
    """
    keys = keys_of(blocks)
    longest = F.element_at(F.array_sort(F.transform(_words(F.col("name")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    keyed = names.withColumn("key", F.coalesce(F.when(F.col("name").rlike("[A-Za-z]"), longest), F.lit("")))
    # A corpus is one scope, in which no block can be left out for its scope.
    asked = blocks if "doc" in blocks.columns else null_safe(blocks, names.select("scope").distinct(), ["scope"], "left_semi")
    asked = asked.select(*keys, F.explode(F.array_append(F.array_distinct(_words(F.col("text"))), F.lit(""))).alias("key"))
    met = null_safe(asked, keyed, ["scope", "key"]).groupBy(*keys).agg(F.collect_set(F.struct("label", "name")).alias("names"))
    once = null_safe(blocks.select(*keys, "text").dropDuplicates(keys), met, keys)

    def of_label(label: str) -> Column:
        # Case-insensitive containment of the words, before any pattern is made.
        there = arrays.let(F.lower("text"), lambda low: F.filter("names", lambda n: (n["label"] == label) & F.forall(_words(n["name"]), lambda w: F.contains(low, w))))
        escaped = lambda n: F.regexp_replace(F.regexp_replace(n["name"], r"([\\.\[\]{}()*+?^$|&#-])", r"\\$1"), " ", r"\\s+")
        parts = F.array_sort(F.transform(there, lambda n: F.struct((-F.length(n["name"])).alias("n"), n["name"].alias("name"), escaped(n).alias("part"))))
        joined = F.array_join(F.transform(parts, lambda p: p["part"]), "|")
        pattern = F.concat(F.lit(r"(?U)(?iu)(?<![A-Za-z])(?:"), joined, F.lit(")(?![A-Za-z])"))

        found = arrays.let(there, lambda t: F.when(F.size(t) > 0, _spans(arrays.matches(F.col("text"), pattern), label)))
        return F.coalesce(found, spans.empty())

    found = once.select(*keys, F.concat(*map(of_label, POSITION)).alias("found"))
    return found.filter(F.size("found") > 0)


def _spans(mentions: Column, label: str) -> Column:
    """Spans of mentions ``(start, end, text)`` of one label."""
    fields = f"'label', '{label}', 'recognizer', 'gazetteer:{label.lower()}', 'score', {SCORE}D, 'priority', {PRIORITY}, 'ord', {POSITION[label] * ORDER_STEP}L + m.end"
    return arrays.applied(f"transform(a.found, m -> named_struct('start', m.start, 'end', m.end, 'text', m.text, {fields}))", found=mentions)


@lru_cache(maxsize=4096)
def _folded_sign(sign: str) -> str:
    small = sign.upper().lower() if len(sign.upper()) == 1 else sign.lower()
    return small if len(small) == 1 else sign


def folded(text: str) -> tuple[str, list[int] | None]:
    """A text in one case with single spaces for white space, and the place of each of its characters in the text (None: its own)."""
    small = text.lower() if text.isascii() else "".join(map(_folded_sign, text))
    if not any(len(m[0]) > 1 for m in BLANKS.finditer(small)):
        return BLANKS.sub(" ", small), None
    places, parts, at = [], [], 0
    for m in BLANKS.finditer(small):
        parts += [small[at : m.start()], " "]
        places += [*range(at, m.start()), m.start()]
        at = m.end()
    return "".join([*parts, small[at:]]), [*places, *range(at, len(small) + 1)]


class Trie:
    """An automaton over characters that finds all of its names in a text."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        labels: dict[str, set[str]] = {}
        for label, name in names:
            labels.setdefault(folded(name)[0], set()).add(label)
        for name, of in labels.items():
            if name:
                self.automaton.add_word(name, (len(name), sorted(of)))
        self.automaton.make_automaton()

    def mentions(self, text: str | None) -> list[dict]:
        if not text or not len(self.automaton):
            return []
        small, places = folded(text)
        out = []
        for last, (size, labels) in self.automaton.iter(small):
            start, end = last + 1 - size, last + 1
            if (start and _letter(small[start - 1])) or (end < len(small) and _letter(small[end])):
                continue
            # White space before the next character belongs to no name: an end is one past the last character.
            a, b = (start, end) if places is None else (places[start], places[last] + 1)
            out += [{"start": a, "end": b, "label": label} for label in labels]
        return out


def _letter(sign: str) -> bool:
    return sign.isascii() and sign.isalpha()


_built: dict[str, Trie] = {}


def _trie_of(names: Broadcast) -> Trie:
    """A Python worker builds the trie of a broadcast ``(key, names)`` once, and keeps those of one call of ``matched_by_tries``."""
    key, listed = names.value
    if key not in _built:
        if len(_built) >= TRIES:
            _built.clear()
        _built[key] = Trie(listed)
    return _built[key]


MENTIONS = "array<struct<start: int, end: int, label: string>>"


def _walk(names: Broadcast) -> Callable[[Column], Column]:
    """A function that walks the trie of these names over texts."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))

    @F.arrow_udf(MENTIONS)
    def mentions(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = _trie_of(names)
        for part in column:
            yield pa.array([trie.mentions(t) for t in part.to_pylist()], kind)

    return mentions


def matched_by_tries(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """``matched`` where all blocks share all names: by tries of at most TRIE characters, each broadcast and walked over the blocks.

    The size of the names is looked up first. Names are dealt to tries by
    hash, and what several of them find in a block is settled together.
    """
    keys, spark = keys_of(blocks), blocks.sparkSession
    named = names.select("label", "name").distinct()
    size = named.agg(F.sum(F.length("name"))).first()[0] or 0
    tries = -(-size // TRIE)
    if tries > TRIES:
        return matched_by_words(blocks, names)
    kind = MENTIONS
    found = []
    for k in range(tries):
        own = named.filter(F.pmod(F.xxhash64("name"), F.lit(tries)) == k).collect()
        found.append(_walk(spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in own])))(F.col("text")))
    every = F.concat(*found) if found else F.expr(f"cast(array() as {kind})")
    rows = blocks.select(*keys, "text", every.alias("every")).filter(F.size("every") > 0).dropDuplicates(keys)

    def of_label(label: str) -> Column:
        own = f"filter(a.every, m -> m.label = '{label}')"
        ordered = f"array_sort(transform(array_distinct({own}), m -> named_struct('a', m.start, 'b', -m.end)))"
        first = arrays.gathered(ordered, "0", lambda s, y: f"if({y}.a >= {s}, -{y}.b, {s})", lambda s, y: f"named_struct('start', {y}.a, 'end', -{y}.b)", "cast(array() as array<struct<start: int, end: int>>)", lambda s, y: f"{y}.a >= {s}")
        text = arrays.cut_sql("a.parts", "m.start", "m.end")
        return _spans(arrays.applied(f"transform({first}, m -> named_struct('start', m.start, 'end', m.end, 'text', {text}))", every=F.col("every"), parts=arrays.stretches(F.col("text"))), label)

    return rows.select(*keys, F.concat(*map(of_label, POSITION)).alias("found")).filter(F.size("found") > 0)


def with_names(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """``blocks`` with the spans of names added to column ``cands`` and ``spans`` settled anew."""
    keys = keys_of(blocks)
    found = matched(blocks.select(*keys, "text"), names)
    joined = null_safe(blocks, found, keys, "left").withColumn("cands", F.concat("cands", F.coalesce("found", spans.empty()))).drop("found")
    return joined.withColumn("spans", spans.resolve(F.col("cands")))
