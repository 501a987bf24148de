"""Filter interaction audit: what each filter takes in each order, from coalitions.

A set of filters removes the documents that fail at least one of them: the
removal game. Documents are counted by the set of filters that they fail, 32
cells for each part, and everything else is arithmetic on these cells. The
potential of a coalition (Hart and Mas-Colell, 1989) follows from those of the
coalitions with one filter less, ``P(S) = (v(S) + sum of P(S without i)) / |S|``,
and a filter's Shapley value is the grand coalition's potential minus that
without the filter. What a filter removes at a step of an order is the
difference between two coalitions.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import applied
from maskwright.llm.common import group_join, salted_join, shared_checkpoint

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Orders of the five filters; potentials are kept as so many times their value, which is a whole number.
N_ORDERS = len(ORDERS)
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 1, 2, 4 and 8."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = applied("named_struct('all', size(a.w), 'distinct', size(array_distinct(a.w)))", w=words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bit = lambda test, value: F.when(test, value).otherwise(0)
    of_words = F.transform(F.array(n), lambda x: bit(x["all"] < 50, 1) + bit(F.lit(100) * x["distinct"] < F.lit(65) * x["all"], 2))[0]
    return of_words + bit(F.lit(100) * capitals.cast("bigint") > F.lit(5) * F.length(text), 4) + bit(text.rlike("[#$%&*|]"), 8)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents, good ones and toxic ones by part and by the filters that they fail.

    Filter E looks for the same text under a smaller id in the whole table: by
    the hash of the text, with rows of hot texts left where they are. Labels
    meet counts of (id, part, mask), not documents.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"))
    slim = shared_checkpoint(slim)
    texts = slim.groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    met = group_join(slim, texts, "h", "size")
    judged = met.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("mask"))
    counted = judged.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).filter("good + toxic > 0")
    # Labels are as many as documents: Spark sees the size of their file, not that each is repeated for a salted join, and would broadcast them.
    rows = salted_join(counted, known.hint("merge"), "id", F.struct("part", "mask"), "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def games(counted: DataFrame) -> DataFrame:
    """``(part, fails, v_n, v_good, v_toxic, potential)``: arrays over the 32 coalitions, for each part.

    ``fails`` counts documents by the exact set of filters that they fail;
    ``v_`` those that a coalition removes; ``potential`` is times N_ORDERS.
    """
    exact = lambda c: f"aggregate(a.cells, 0L, (s, c) -> s + if(c.mask = k, c.{c}, 0L))"
    removed = lambda c: f"aggregate(a.cells, 0L, (s, c) -> s + if((c.mask & k) <> 0, c.{c}, 0L))"
    over = lambda body: applied(f"transform(sequence(0, 31), k -> {body})", cells=F.col("cells"))
    # At most 32 cells meet for each part.
    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    rows = rows.select("part", over(exact("n")).alias("fails"), *(over(removed(c)).alias(f"v_{c}") for c in COUNTS))
    without = "aggregate(filter(sequence(0, 4), i -> (k & shiftleft(1, i)) <> 0), 0L, (s, i) -> s + p[k ^ shiftleft(1, i)])"
    potential = f"aggregate(sequence(1, 31), array(0L), (p, k) -> concat(p, array(({N_ORDERS} * a.v[k] + {without}) div bit_count(k))))"
    return rows.withColumn("potential", applied(potential, v=F.col("v_n")))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (``source``), order of the filters and step: what the step's filter keeps, removes and loses.

    ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``; ``shapley`` is the sum over all 120
    orders of what the filter removes. A null text is empty, a null source the
    part with the empty name. A null id has no smaller one and is none. Repeated
    rows count each, a label counts for all rows of its id, and an id with
    several labels has each that one of them gives. An empty table gives no row,
    other columns are not read.
    """
    orders = F.explode(F.array(*map(F.lit, ORDERS)))
    steps = games(cells(docs, labels)).select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = lambda letter: f"shiftleft(1, instr('{FILTERS}', {letter}) - 1)"
    before = f"aggregate(sequence(1, step), 0, (s, k) -> s + if(k < step, {place('substring(filter_order, k, 1)')}, 0))"
    steps = steps.withColumn("before", F.expr(before)).withColumn("own", F.expr(place("substring(filter_order, step, 1)")))
    at = lambda array, where: f"{array}[{where}]"
    taken = lambda c: f"{at(f'v_{c}', 'before + own')} - {at(f'v_{c}', 'before')}"
    out = {
        "kept": f"{at('v_n', '31')} + {at('fails', '0')} - {at('v_n', 'before + own')}",
        "removed": taken("n"),
        "redundant": f"{at('v_n', 'own')} - ({taken('n')})",
        "unique_fails": at("fails", "own"),
        "good_lost": taken("good"),
        "toxic_lost": taken("toxic"),
        "shapley": f"{at('potential', '31')} - {at('potential', '31 - own')}",
    }
    return steps.select("part", "filter_order", "step", *(F.expr(e).alias(c) for c, e in out.items()))
