"""From documents to redacted documents: blocks, detection, mapping, writing back, statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import words
from maskwright.operators import entities as entity_rules
from maskwright.operators import gazetteer, recognizers, spans
from maskwright.operators.policies import distinct_values, marker, policy
from maskwright.operators.shared import shared_checkpoint

#: Labels and the names under which a summary shows them.
CATEGORIES = {
    "PERSON": "PERSON",
    "EMAIL": "EMAIL",
    "PHONE": "PHONE",
    "ORGANIZATION": "COMPANY",
    "LOCATION": "ADDRESS",
    "URL": "WEBSITE",
    "SSN": "SSN",
    "CREDIT_CARD": "CREDIT_CARD",
    "DATE_OF_BIRTH": "DOB",
    "IP_ADDRESS": "IP_ADDRESS",
}


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_line: bool = True, scope: str = "document") -> DataFrame:
    """``(scope, row, block_idx, location, text)``: a block for each line of a text, or for each text.

    ``scope`` is ``document``, where each id has names and identities of its
    own, or ``corpus``, where all documents share them: there the scope is one
    constant and the id is in ``doc``, which comes first in the order of
    reading. ``row`` is the hash of the whole text, which tells apart documents
    that share an id, null ids among them. A null text is one block without a
    text.
    """
    if scope not in ("document", "corpus"):
        raise ValueError(f"no scope {scope!r}: document or corpus")
    text, of = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    own = [of.alias("scope")] if scope == "document" else [F.lit("corpus").alias("scope"), of.alias("doc")]
    names = ["scope", "row"] if scope == "document" else ["scope", "doc", "row"]
    rows = docs.select(*own, F.xxhash64(text).alias("row"), text.alias("text"))
    if not by_line:
        return rows.select(*names, F.lit(0).alias("block_idx"), F.lit("body").alias("location"), "text")
    lines = rows.select(*names, F.posexplode_outer(F.split("text", "\n")).alias("block_idx", "text"))
    return lines.select(*names, F.coalesce("block_idx", F.lit(0)).alias("block_idx"), F.lit("body").alias("location"), "text")


def without_headers(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~F.startswith("location", F.lit("section[")))


def detected(blocks: DataFrame, only: Iterable[str] | None = None, exclude: Iterable[str] = (), min_score: float = 0.0, entities: str | bool = False, v: words.Vocabulary = words.DEFAULT) -> DataFrame:
    """``blocks`` with ``cands``, all candidates, and ``spans``, those that win. Blank blocks have none.

    ``entities`` names a column of entities from a model, or is true for the
    heuristic; then people, organizations and locations are found too.
    """
    found = recognizers.candidates(F.col("text"), recognizers.REGISTRY.build(only, exclude))
    if entities:
        source = F.col(entities) if isinstance(entities, str) else entity_rules.heuristic(F.col("text"), v)
        blocks = blocks.withColumn("__entities", entity_rules.prepared(F.col("text"), source))
        found = F.concat(found, entity_rules.candidates(F.col("__entities"), v))
    found = F.when(F.col("text").rlike(r"(?U)\S"), F.filter(found, lambda s: s["score"] >= min_score)).otherwise(spans.empty())
    return blocks.withColumn("cands", found).drop("__entities").withColumn("spans", spans.resolve(F.col("cands")))


def _rows(blocks: DataFrame) -> DataFrame:
    """A row for each span. The outer form keeps the optimizer from testing, and so making, the spans twice."""
    return blocks.select(*gazetteer.keys_of(blocks), F.inline_outer("spans")).filter(F.col("start").isNotNull())


def names_in(blocks: DataFrame) -> DataFrame:
    """Names of people and organizations that detection found, as the second pass takes them."""
    found = _rows(blocks).filter(F.col("label").isin("PERSON", "ORGANIZATION"))
    return gazetteer.known_names(found.select("scope", "label", F.col("text").alias("name")))


def two_pass(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detected blocks with every mention of the names that the first pass found, and these names."""
    names = names_in(blocks)
    return gazetteer.with_names(blocks, names), names


def detections_of(blocks: DataFrame) -> DataFrame:
    """``(scope, block_idx, start, end, text, label, recognizer, score, priority)``, one row for each span."""
    return _rows(blocks).drop("ord", "row")


def mapping_of(blocks: DataFrame, policy_name: str = "fake", names: DataFrame | None = None) -> DataFrame:
    """``(scope, label, original, replacement)`` of a detected table."""
    known = names.filter(F.col("label") == "PERSON").select("scope", "name") if names is not None else None
    return policy(policy_name)(distinct_values(detections_of(blocks)), known)


def with_placeholders(blocks: DataFrame, template: str = "[{label}]") -> DataFrame:
    """Detected blocks with ``landed`` and ``redacted`` under the placeholder policy: no join, no shuffle."""
    made = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), marker(s["label"], template).alias("text"), s["label"].alias("label")))
    return _written(blocks.withColumn("made", made))


def replaced(blocks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Detected blocks with ``landed`` and ``redacted`` under any mapping; a substitute equal to its original is no replacement.

    Blocks that are equal in all keys have the same text, and each is kept.
    """
    keys = gazetteer.keys_of(blocks)
    found = _rows(blocks).withColumnRenamed("text", "original")
    joined = gazetteer.null_safe(found, mapping, ["scope", "label", "original"]).filter(F.col("replacement") != F.col("original"))
    made = joined.groupBy(*keys).agg(F.collect_set(F.struct("start", "end", F.col("replacement").alias("text"), "label")).alias("made"))
    return _written(gazetteer.null_safe(blocks, made, keys, "left").withColumn("made", F.coalesce("made", spans.empty(spans.REPLACEMENT))))


def _written(blocks: DataFrame) -> DataFrame:
    landed = spans.resolve_replacements(F.col("made"), F.length("text"))
    out = blocks.withColumn("landed", landed).drop("made")
    return out.withColumn("redacted", F.when(F.size("landed") > 0, spans.splice(F.col("text"), F.col("landed"))).otherwise(F.col("text")))


def passed_through(blocks: DataFrame) -> DataFrame:
    """Blocks as they are, in the shape of redacted ones."""
    return blocks.withColumn("landed", spans.empty(spans.REPLACEMENT)).withColumn("redacted", F.col("text"))


def joined_up(blocks: DataFrame) -> DataFrame:
    """``(scope, redacted_text, n_replacements)``, in a scope of many documents ``doc`` for ``scope``: a row for each document from redacted blocks, lines in order.

    Documents that share an id are told apart by their text, and those that
    share both are written once and repeated. A null text stays null.
    """
    keys = [k for k in gazetteer.keys_of(blocks) if k != "block_idx"]
    lines = F.array_sort(F.collect_set(F.struct("block_idx", "redacted", F.size("landed").alias("n"))))
    grouped = blocks.groupBy(*keys).agg(lines.alias("lines"), F.count_if(F.col("block_idx") == 0).alias("copies"))
    text = F.when(F.element_at("lines", 1)["redacted"].isNotNull(), F.array_join(F.transform("lines", lambda x: x["redacted"]), "\n"))
    each = F.explode(F.array_repeat(F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]), F.greatest(F.col("copies").cast("int"), F.lit(1))))
    return grouped.select("doc" if "doc" in keys else "scope", text.alias("redacted_text"), each.alias("n_replacements"))


def statistics(blocks: DataFrame) -> DataFrame:
    """One row: blocks with a text, blocks that are not blank, characters before editing, replacements that landed."""
    return blocks.agg(
        F.count("text").alias("blocks"),
        F.count_if(F.col("text").rlike(r"(?U)\S")).alias("non_empty_blocks"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("characters"),
        F.coalesce(F.sum(F.size("landed")), F.lit(0)).cast("bigint").alias("replacements"),
    )


def by_label(blocks: DataFrame) -> DataFrame:
    """Replacements that landed, by label."""
    return blocks.select(F.explode_outer("landed").alias("r")).filter(F.col("r").isNotNull()).groupBy(F.col("r.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def by_category(blocks: DataFrame) -> DataFrame:
    """The same for every category, zero where there is none."""
    spark = blocks.sparkSession
    every = spark.createDataFrame([(k, c, n) for n, (k, c) in enumerate(CATEGORIES.items())], "label string, category string, position int")
    return every.join(by_label(blocks), "label", "left").select("category", "position", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def transform(name: str, blocks: DataFrame, **options) -> tuple[DataFrame, DataFrame | None]:
    """Blocks under a transform by name, ``redact`` or ``passthrough``, and its mapping; KeyError for another name."""
    return {"redact": redacted_blocks, "passthrough": lambda b, **_: (passed_through(b), None)}[name](blocks, **options)


def redacted_blocks(blocks: DataFrame, policy_name: str = "fake", passes: int = 2, only: Iterable[str] | None = None, exclude: Iterable[str] = (), entities: str | bool = True) -> tuple[DataFrame, DataFrame]:
    """Blocks, redacted, and the mapping. Pass 2 looks again for the names that pass 1 found.

    What a pass finds is read by names, mapping and writing, so it is written
    once to the shared folder and not found anew by each of them.
    """
    found, names = shared_checkpoint(detected(blocks, only, exclude, entities=entities)), None
    if passes > 1:
        names = shared_checkpoint(names_in(found))
        found = shared_checkpoint(gazetteer.with_names(found, names))
    mapping = shared_checkpoint(mapping_of(found, policy_name, names))
    return replaced(found, mapping), mapping


def redact(docs: DataFrame, policy_name: str = "fake", id_col: str = "doc_id", text_col: str = "text", by_line: bool = True, passes: int = 2, only: Iterable[str] | None = None, exclude: Iterable[str] = (), entities: str | bool = True, scope: str = "document") -> tuple[DataFrame, DataFrame]:
    """Redacted blocks and the mapping. The mapping undoes the redaction: keep it apart.

    ``scope`` is ``document`` or ``corpus``, see ``blocks_of``: in a corpus one
    person has one identity, and a number counts over all documents.
    """
    return redacted_blocks(blocks_of(docs, id_col, text_col, by_line, scope), policy_name, passes, only, exclude, entities)


def searched(mapping: DataFrame, label: str = "ALL", query: str = "") -> DataFrame:
    """Mapping rows of a label (or all) that hold the query, whatever its case, by label and original."""
    rows = mapping if label == "ALL" else mapping.filter(F.col("label") == label)
    if query:
        rows = rows.filter(F.contains(F.lower("original"), F.lit(query.lower())) | F.contains(F.lower("replacement"), F.lit(query.lower())))
    return rows.orderBy("label", "original")
