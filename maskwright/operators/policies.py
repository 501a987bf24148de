"""Replacement policies: from distinct values to what stands for them.

A mapping is ``(scope, label, original, replacement)``, one row for each
distinct value of a scope: each value is substituted once and joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.checks import match_case
from maskwright.functions.surrogates import substitutes
from maskwright.operators import identity, ranking

Policy = Callable[[DataFrame, DataFrame | None], DataFrame]


def distinct_values(detections: DataFrame) -> DataFrame:
    """``(scope, label, text, block_idx, start)``: each value with the place where it first stands; in a scope of many documents ``doc`` too."""
    place = identity.place_of(detections)
    first = detections.groupBy("scope", "label", "text").agg(F.min(F.struct(*place)).alias("f"))
    return first.select("scope", "label", "text", *(f"f.{c}" for c in place))


def marker(label: Column, template: str = "[{label}]") -> Column:
    before, _, after = template.partition("{label}")
    return F.concat(F.lit(before), label, F.lit(after))


def placeholder(template: str = "[{label}]") -> Policy:
    """The label in brackets, or in another template."""

    def of(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
        return values.select("scope", "label", F.col("text").alias("original"), marker(F.col("label"), template).alias("replacement"))

    return of


def numbered() -> Policy:
    """``[LABEL_n]``, n by first appearance in the scope.

    A document's values are few and a window numbers them; in a scope of many
    documents they are numbered over ranges, as a label may have most of them.
    """

    def of(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
        place = [*identity.place_of(values), "text"]
        if "doc" in values.columns:
            rows = ranking.numbered(values, ["scope", "label"], place)
        else:
            rows = values.withColumn("n", F.row_number().over(Window.partitionBy("scope", "label").orderBy(*place)))
        return rows.select("scope", "label", F.col("text").alias("original"), F.concat(F.lit("["), "label", F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("replacement"))

    return of


def fake(domain: str = "example.com") -> Policy:
    """Believable substitutes of the same shape; a person and their address share one identity."""

    def of(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
        people = identity.identities(identity.linked(values, known), domain)
        named = F.when(F.col("label") == "EMAIL", F.col("email")).otherwise(match_case(F.col("text"), F.col("full")))
        people = people.select("scope", "label", F.col("text").alias("original"), named.alias("replacement"))
        rest = values.filter(~F.col("label").isin("PERSON", "EMAIL"))
        rest = rest.select("scope", "label", F.col("text").alias("original"), substitutes(F.col("label"), F.col("text")).alias("replacement"))
        return people.unionByName(rest)

    return of


POLICIES: dict[str, Callable[[], Policy]] = {"fake": fake, "placeholder": placeholder, "numbered": numbered}


def policy(name: str) -> Policy:
    """A policy by name; KeyError for an unknown one."""
    return POLICIES[name]()
