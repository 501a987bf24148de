"""Scores of predicted spans against annotations.

``expected`` and ``predicted`` are rows ``(set, block_idx, ord, start, end,
label)``. One span may cover several and be covered by several; ``strict``
pairs them greedily, one to one, in order.

Spans meet over bins of BIN code points of their block: each is filed under all
bins that it reaches into, so a block with many spans is many small keys and
not one that all of them share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import arrays

KEY = ["set", "block_idx"]
#: Code points of a bin.
BIN = 64


def occurrences(text: Column, value: Column) -> Column:
    """How often a value stands in a text, without overlap."""
    return F.when(value == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)).cast("int"))


def expected_spans(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Annotations ``(set, block_idx, ord, label, text)`` with their places in the blocks.

    The n-th mention of a value is its n-th occurrence (from left to right,
    without overlap); when these run out they start over; a value that the
    block lacks starts at -1, and the empty value at 0. The places of a value
    are found once for all its mentions.
    """
    texts = blocks.select("set", "block_idx", F.col("text").alias("block"))
    listed = annotations.groupBy(*KEY, "text").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("items")).join(texts, KEY)
    literal = F.concat(F.lit(r"\Q"), F.replace("text", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    places = F.when((F.col("text") != "") & F.contains("block", "text"), F.transform(arrays.matches(F.col("block"), literal), lambda m: m["start"]))
    each = listed.select(*KEY, "text", F.coalesce(places, F.array(F.when(F.col("text") == "", 0).otherwise(-1))).alias("places"), F.posexplode("items").alias("n", "item"))
    start = F.get("places", F.pmod(F.col("n"), F.size("places"))).cast("int")
    return each.select(*KEY, "item.ord", "item.label", "text", start.alias("start"), (start + F.length("text")).alias("end"))


def _filed(rows: DataFrame) -> DataFrame:
    """``rows`` under each bin that a span reaches into; an empty span is filed where it stands."""
    bin_of = lambda at: F.floor(at / BIN).cast("int")
    return rows.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.greatest(F.col("end") - 1, "start")))))


def _met(a: DataFrame, b: DataFrame, typed: bool) -> tuple[DataFrame, DataFrame, Column]:
    a, b = _filed(a).alias("a"), _filed(b).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*KEY, "bin", *(["label"] if typed else []))]
    return a, b, reduce(lambda x, y: x & y, same, (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))


def _of(a: DataFrame, b: DataFrame, typed: bool, how: str) -> DataFrame:
    """Rows of ``a`` that are, or are not, among those that overlap a row of ``b``: equal rows have the same answer."""
    left, right, on = _met(a, b, typed)
    hits = left.join(right, on, "left_semi").select(*(F.col(f"a.`{c}`").alias(f"__{c}") for c in a.columns)).distinct()
    return a.join(hits, reduce(lambda x, y: x & y, (F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`")) for c in a.columns)), how)


def touched(a: DataFrame, b: DataFrame, typed: bool) -> DataFrame:
    """Rows of ``a`` that overlap a row of ``b`` (of the same label)."""
    return _of(a, b, typed, "left_semi")


def untouched(a: DataFrame, b: DataFrame, typed: bool) -> DataFrame:
    return _of(a, b, typed, "left_anti")


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each block, in order, whose two spans are free when their turn comes."""
    block, used_e, used_p = None, set(), set()
    for batch in batches:
        keep = []
        for k, (s, i, e, p) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            if (s, i) != block:
                block, used_e, used_p = (s, i), set(), set()
            if e not in used_e and p not in used_p:
                used_e.add(e)
                used_p.add(p)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64()))


def paired(expected: DataFrame, predicted: DataFrame, typed: bool) -> DataFrame:
    """Greedy one-to-one pairs ``(set, block_idx, e_ord, p_ord, label)``: each expected span, in order, takes the first free one that it overlaps.

    The pairs of a block are walked in order as a stream, with what is taken in
    sets: linear in the pairs, however many a block has.
    """
    a, b, on = _met(expected, predicted, typed)
    # A pair is met in the bin of its later start, and in no other.
    once = F.col("a.bin") == F.floor(F.greatest("a.start", "b.start") / BIN)
    pairs = a.join(b, on & once).select(F.col("a.set").alias("set"), F.col("a.block_idx").alias("block_idx"), F.col("a.ord").alias("e_ord"), F.col("b.ord").alias("p_ord"), F.col("a.label").alias("label"))
    return pairs.repartition(*KEY).sortWithinPartitions(*KEY, "e_ord", "p_ord", "label").mapInArrow(_taken, pairs.schema)


def _ratio(top: Column, below: Column) -> Column:
    return F.when(below > 0, top / below).otherwise(0.0)


def counted(expected: DataFrame, predicted: DataFrame, typed: bool = True, strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``(label, covered, matched, false_positives, false_negatives)`` by label of the span that is counted, and by ``by`` (``set``)."""
    keys = [*by, "label"]
    n = lambda rows, name: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    if strict:
        pairs = paired(expected, predicted, typed)
        covered = n(pairs, "covered")
        hit = predicted.join(pairs.select(*KEY, F.col("p_ord").alias("ord")), [*KEY, "ord"], "left_semi")
    else:
        covered = n(touched(expected, predicted, typed), "covered")
        hit = touched(predicted, expected, typed)
    counts = ("expected", "predicted", "covered", "matched")
    rows = reduce(lambda x, y: x.join(y, keys, "full"), (n(expected, "expected"), n(predicted, "predicted"), covered, n(hit, "matched"))).na.fill(0, list(counts))
    return rows.select(*keys, "covered", "matched", (F.col("predicted") - F.col("matched")).alias("false_positives"), (F.col("expected") - F.col("covered")).alias("false_negatives"))


def scored(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by label and in total (label ``ALL``), with precision, recall, F1 and accuracy; zero where undefined."""
    sums = [F.sum(c).alias(c) for c in ("covered", "matched", "false_positives", "false_negatives")]
    if by:
        rows = counts.unionByName(counts.groupBy(*by).agg(*sums).withColumn("label", F.lit("ALL")))
    else:
        rows = counts.rollup("label").agg(*sums).withColumn("label", F.coalesce("label", F.lit("ALL")))
    found, wanted = F.col("matched") + F.col("false_positives"), F.col("covered") + F.col("false_negatives")
    p, r = _ratio(F.col("matched"), found), _ratio(F.col("covered"), wanted)
    # Of all spans, annotated and predicted, those that something on the other side accounts for.
    measures = {"precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r), "accuracy": _ratio(F.col("covered") + F.col("matched"), wanted + found)}
    return rows.select(*by, "label", "covered", "matched", "false_positives", "false_negatives", *(F.round(m, 4).alias(k) for k, m in measures.items()))


def results(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """``(set, part, block_idx, start, json)``: the result object of each set, its measures in one row and each error in a row of its own.

    The row of part ``measures`` has ``typed``, counts and measures by label,
    and ``overall`` and ``untyped``, the measures over all labels, with labels
    that must agree and with any; its place is null. The rows of ``missed`` and
    ``false_positives`` are the items ``[block, label, text]`` of these lists,
    from spans with a column ``text``; place, then label and text order them. A
    set can have most spans of a corpus as errors, so they never meet in a row.
    """
    by = ("set",)
    typed, untyped = (scored(counted(expected, predicted, t, by=by), by) for t in (True, False))
    counts = F.struct("covered", "matched", F.col("false_positives").alias("fp"), F.col("false_negatives").alias("fn"), "precision", "recall", "f1")
    measures = F.struct("precision", "recall", "f1", "accuracy")
    named = typed.filter("label != 'ALL'").groupBy("set").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", counts.alias("counts"))))).alias("typed"))
    whole = lambda rows, name: rows.filter("label = 'ALL'").select("set", measures.alias(name))
    rows = named.join(whole(typed, "overall"), "set", "left").join(whole(untyped, "untyped"), "set", "left")
    item = F.array(F.col("block_idx").cast("string"), "label", "text")
    errors = lambda a, b, name: untouched(a, b, True).select("set", F.lit(name).alias("part"), "block_idx", "start", F.to_json(item).alias("json"))
    missed, spurious = errors(expected, predicted, "missed"), errors(predicted, expected, "false_positives")
    place = [F.lit(None).cast(missed.schema[c].dataType).alias(c) for c in ("block_idx", "start")]
    heads = rows.select("set", F.lit("measures").alias("part"), *place, F.to_json(F.struct("typed", "overall", "untyped")).alias("json"))
    return heads.unionByName(missed).unionByName(spurious)


def invalid(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Values annotated more often than they stand in their block, with both counts."""
    asked = annotations.groupBy(*KEY, "text").agg(F.count(F.lit(1)).alias("annotated"))
    texts = blocks.select("set", "block_idx", F.col("text").alias("block"))
    there = asked.join(texts, KEY, "left").withColumn("present", F.coalesce(occurrences(F.col("block"), F.col("text")), F.lit(0)))
    return there.filter("annotated > present").select(*KEY, "text", "annotated", "present")
