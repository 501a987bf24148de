"""One identity for each person, found again by name or by email address.

People are known by signature, the set of their name's words. When names are
registered largest first, a short form belongs to a longer name exactly if one
registered signature contains it; that is a self-join, without iteration. What
comes later (addresses, names that were not registered) depends on the order
of reading: a signature follows the only one of those registered before it
that contains it, or else that it contains. Which ones these are is a join over
subsets and a comparison of places, and whom they follow in turn is found by
doubling, so a scope can be a whole corpus and no task has all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.checks import seed, signature
from maskwright.operators.gazetteer import null_safe
from maskwright.operators.shared import shared_checkpoint

# Substitutes for names, chosen by the seed of a person.
FIRST = (
    "Adrian Alice Amelia Andrew Anna Anthony Arthur Beatrice Benjamin Bernard Bridget Carla Catherine Charles Claire Clara Colin Daniel David Diana "
    "Dominic Edith Edward Eleanor Elias Emma Eric Esther Felix Fiona Frances Frank George Grace Hannah Harold Helen Henry Hugo Irene Isabel Ivan Jack "
    "James Jane Jasper Joan Joel Julia Karen Keith Laura Leonard Lewis Linda Lucas Lucy Marcus Margaret Martin Mary Maurice Miriam Nadia Nathan Nina "
    "Noah Nora Oliver Olivia Oscar Patricia Paul Peter Philip Rachel Ralph Rebecca Robert Rosa Ruth Samuel Sarah Simon Sophie Stella Stephen Susan "
    "Theodore Thomas Ursula Victor Violet Walter Wendy William"
).split()
LAST = (
    "Abbott Adams Allen Archer Atkins Bailey Baker Barnes Bennett Bishop Blake Bolton Bowen Bradley Brooks Burton Carter Chandler Clarke Coleman Cooper "
    "Crawford Curtis Dalton Dawson Dixon Doyle Drake Dunn Eaton Elliott Ellis Emerson Farmer Fields Finch Fisher Fletcher Foster Fowler Gardner Gibson "
    "Gilbert Goodwin Graham Grant Griffin Hale Hammond Harding Harper Hayes Holland Hooper Howard Hudson Hunter Jarvis Jennings Keller Kemp Lambert "
    "Lawson Leigh Lloyd Marsh Mason Mercer Miles Mitchell Morton Nash Newman Norris Osborne Palmer Parsons Payne Pearson Porter Potter Preston Quinn "
    "Ramsey Reeves Rhodes Sawyer Shelton Slater Spencer Sutton Talbot Turner Vaughn Wade Walsh Warner Webster Whitaker York"
).split()


def _chosen(names: list[str], root, slot: str):
    return F.element_at(F.array(*map(F.lit, names)), (seed(F.concat(root, F.lit(f"#{slot}"))) % len(names) + 1).cast("int"))


def identities(people: DataFrame, domain: str = "example.com") -> DataFrame:
    """``people`` with ``first, last, full, email``, made from column ``root``."""
    out = people.withColumn("first", _chosen(FIRST, F.col("root"), "first")).withColumn("last", _chosen(LAST, F.col("root"), "last"))
    out = out.withColumn("full", F.concat_ws(" ", "first", "last"))
    return out.withColumn("email", F.lower(F.concat("first", F.lit("."), "last", F.lit(f"@{domain}"))))


def primed(names: DataFrame) -> DataFrame:
    """``(scope, signature, root)`` of the distinct signatures of ``names(scope, name)``, registered largest first.

    The root is the only signature of the scope that contains this one, else
    the signature itself. Pairs meet over their words, so none is tried against
    a stranger; names without a word have no signature and no row.
    """
    of = names.select("scope", signature(F.col("name")).alias("signature")).filter(F.size("signature") > 0).distinct()
    large = of.select("scope", F.col("signature").alias("whole"), F.explode("signature").alias("word"))
    # A signature looks for its relatives under its rarest word: a common first name is no key of many.
    often = large.groupBy("scope", "word").agg(F.count(F.lit(1)).alias("n"))
    each = of.select("scope", "signature", F.explode("signature").alias("word")).join(often, ["scope", "word"])
    small = each.groupBy("scope", "signature").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    inside = (F.size("whole") > F.size("signature")) & (F.size(F.array_except("signature", "whole")) == 0)
    one = small.join(large, ["scope", "word"]).filter(inside).groupBy("scope", "signature").agg(F.count(F.lit(1)).alias("n"), F.first("whole").alias("whole")).filter("n = 1")
    return of.join(one.select("scope", "signature", "whole"), ["scope", "signature"], "left").select("scope", "signature", F.coalesce("whole", "signature").alias("root"))


def how_many(linked_values: DataFrame) -> DataFrame:
    """``(scope, identities)``: distinct people of each scope, of rows with a root."""
    return linked_values.groupBy("scope").agg(F.count_distinct("root").alias("identities"))


class Links:
    """The registry of one scope as a program over values in order; ``linked`` gives its results for any number of values."""

    def __init__(self) -> None:
        self.root: dict[frozenset[str], str] = {}
        self.by_word: dict[str, set[frozenset[str]]] = {}

    def resolve(self, words: frozenset[str], source: str) -> str:
        """The root of a signature: its own, that of its only relative, or itself; without a word the source stands alone."""
        if not words:
            return source
        if words not in self.root:
            near = set().union(*(self.by_word.get(w, set()) for w in words))
            relatives = [s for s in near if words < s] or [s for s in near if s < words]
            self.root[words] = self.root[relatives[0]] if len(relatives) == 1 else " ".join(sorted(words))
            for w in words:
                self.by_word.setdefault(w, set()).add(words)
        return self.root[words]


#: Words of a name up to which all its subsets are looked up (at most 62); longer names are met by the rarest word of shorter ones.
SUBSETS = 6
#: Columns that say where a value first stands, in order of reading.
PLACE = ("doc", "block_idx", "start")


def place_of(rows: DataFrame) -> list[str]:
    return [c for c in PLACE if c in rows.columns]


def _related(nodes: DataFrame) -> DataFrame:
    """``(scope, small, large, t_small, t_large)``: pairs of signatures of a scope, one of which contains the other."""
    k = F.size("signature")
    chosen = "transform(sequence(1, shiftleft(1, size(signature)) - 2), m -> array_join(filter(signature, (w, i) -> (m & shiftleft(1, i)) <> 0), ' '))"
    large = nodes.select("scope", "signature", F.col("key").alias("large"), F.col("t").alias("t_large"))
    few = large.filter(k.between(2, SUBSETS)).select("scope", "large", "t_large", F.explode(F.expr(chosen)).alias("key"))
    small = nodes.select("scope", "key", F.col("t").alias("t_small"))
    met = null_safe(few, small, ["scope", "key"]).select("scope", F.col("key").alias("small"), "large", "t_small", "t_large")
    many = large.filter(k > SUBSETS)
    words = many.select("scope", F.explode("signature").alias("word")).groupBy("scope", "word").agg(F.count(F.lit(1)).alias("n"))
    # Each shorter name under the rarest of its words among the long names; a word that no long name has rules it out.
    each = nodes.select("scope", "signature", "key", "t", F.explode("signature").alias("word"))
    rare = null_safe(each, words, ["scope", "word"], "left").groupBy("scope", "key").agg(F.min_by(F.struct("word", "signature", "t"), F.struct(F.coalesce("n", F.lit(0)), "word")).alias("r"), F.count_if(F.col("n").isNull()).alias("strange"))
    rare = rare.filter("strange = 0").select("scope", F.col("key").alias("small"), F.col("r.word").alias("word"), F.col("r.signature").alias("inner"), F.col("r.t").alias("t_small"))
    pairs = null_safe(rare, many.select("scope", "large", "t_large", F.col("signature").alias("outer"), F.explode("signature").alias("word")), ["scope", "word"])
    pairs = pairs.filter((F.size("outer") > F.size("inner")) & (F.size(F.array_except("inner", "outer")) == 0))
    return met.unionByName(pairs.select("scope", "small", "large", "t_small", "t_large"))


def _followed(nodes: DataFrame) -> DataFrame:
    """``(scope, key, root)`` of the signatures that follow another, at the end of the chain."""
    pairs = _related(nodes)
    above = pairs.filter("t_large < t_small").select("scope", F.col("small").alias("key"), F.lit(True).alias("up"), F.col("large").alias("other"))
    below = pairs.filter("t_small < t_large").select("scope", F.col("large").alias("key"), F.lit(False).alias("up"), F.col("small").alias("other"))
    of = lambda up: (F.count_if(F.col("up") == up), F.max(F.when(F.col("up") == up, F.col("other"))))
    (n_up, up), (n_down, down) = of(True), of(False)
    first = above.unionByName(below).groupBy("scope", "key").agg(n_up.alias("n_up"), up.alias("above"), n_down.alias("n_down"), down.alias("below"))
    follows = F.when(F.col("n_up") == 1, F.col("above")).when((F.col("n_up") == 0) & (F.col("n_down") == 1), F.col("below"))
    links = shared_checkpoint(first.select("scope", "key", follows.alias("root")).filter("root is not null"))
    # Each follows an earlier one, so there is no circle, and chains halve from round to round.
    while True:
        ahead = links.select("scope", F.col("key").alias("root"), F.col("root").alias("further"))
        met = null_safe(links, ahead, ["scope", "root"], "left")
        links = shared_checkpoint(met.select("scope", "key", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            return links.drop("moved")


def linked(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(scope, text, label, root)`` of distinct PERSON and EMAIL values.

    ``values`` has ``scope, label, text`` and the place where a value first
    stands: ``block_idx, start``, in a scope of many documents ``doc`` before
    them. ``known(scope, name)`` is registered before, largest first. Values
    are registered in the order of reading. A value without a word stands
    alone; a null scope is one scope; an empty table gives no row.
    """
    source = F.when(F.col("label") == "EMAIL", F.substring_index("text", "@", 1)).otherwise(F.col("text"))
    place = place_of(values)
    order = lambda later, size, at, label, text: F.struct(F.lit(later).alias("later"), size.alias("size"), *(c.alias(n) for n, c in zip(place, at)), label.alias("label"), text.alias("text"))
    key = F.array_join("signature", " ").alias("key")
    own = values.filter(F.col("label").isin("PERSON", "EMAIL")).select("scope", "label", "text", signature(source).alias("signature"), order(True, F.lit(0), [F.col(c) for c in place], F.col("label"), F.col("text")).alias("t")).select("*", key)
    rows = own.select("scope", "signature", "key", "t")
    if known is not None:
        named = known.select("scope", F.col("name").alias("text"), signature(F.col("name")).alias("signature"))
        nowhere = [F.lit(None).cast(values.schema[c].dataType) for c in place]
        rows = rows.unionByName(named.select("scope", "signature", key, order(False, -F.size("signature"), nowhere, F.lit(""), F.col("text")).alias("t")))
    nodes = shared_checkpoint(rows.filter("key != ''").groupBy("scope", "key").agg(F.first("signature").alias("signature"), F.min("t").alias("t")))
    met = null_safe(own.select("scope", "text", "label", "key"), _followed(nodes), ["scope", "key"], "left")
    return met.select("scope", "text", "label", F.when(F.col("key") == "", F.col("text")).otherwise(F.coalesce("root", "key")).alias("root"))
