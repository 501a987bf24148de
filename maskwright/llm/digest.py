"""Quartile bucket digests of texts, and their bounded difference.

Every window of five bytes gives six triplets; each is hashed into one of
``BUCKETS`` counters. A counter is coded by the quarter of all counters in which
it lies, and the digest is a length code, two quartile ratios and those codes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import spread

BUCKETS = 256
#: Places in the window of the three bytes of each triplet.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: Unrelated codes differ by 5/4 on average; so large a difference, or a larger one, is no likeness.
FARTHEST = BUCKETS * 5 // 4
CHUNK = 1 << 20


def _tables() -> list[np.ndarray]:
    """One permutation of the byte values for each place in a triplet, by a fixed rule."""
    def ordered(place: int) -> list[int]:
        return sorted(range(256), key=lambda byte: hashlib.sha256(bytes([place, byte])).digest())

    return [np.array(ordered(place), np.uint8) for place in range(3)]


TABLES = _tables()


def counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the triplets of all windows."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data), 1), CHUNK):
        part = np.frombuffer(data[max(at - 4, 0) : at + CHUNK], np.uint8)
        seen = min(at, 4)  # bytes that belong to the part before
        a, b, c = (t[part] for t in TABLES)
        for k, (x, y, z) in enumerate(TRIPLETS):
            first = max(seen - z, 0)
            n = len(part) - z - first
            if n > 0:
                mixed = a[first + x : first + x + n] ^ b[first + y : first + y + n] ^ c[first + z : first + z + n]
                total += np.bincount(mixed ^ np.uint8(43 * k), minlength=BUCKETS)
    return total


def digest(text: str) -> np.ndarray:
    """Length code, two quartile ratios, then a code of 0 to 3 for each bucket."""
    data = text.encode()
    hits = counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(hits)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    codes = (hits > q1).astype(np.uint8) + (hits > q2) + (hits > q3)
    ratios = [min(15, 16 * q // q3) if q3 else 0 for q in (q1, q2)]
    return np.array([min(255, int(8 * math.log2(len(data) + 1))), *ratios, *codes], np.uint8)


def written(d: np.ndarray) -> str:
    """A digest as hexadecimal text."""
    four = d[3:].reshape(-1, 4)
    return bytes([d[0], int(d[1]) << 4 | int(d[2])]).hex() + (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes().hex()


def read(text: str) -> np.ndarray:
    """The digest that ``written`` wrote."""
    data = bytes.fromhex(text)
    body = np.frombuffer(data[2:], np.uint8)
    return np.concatenate([[data[0], data[1] >> 4, data[1] & 15], np.stack([body >> s & 3 for s in (6, 4, 2, 0)], axis=1).ravel()]).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, down to 0: one less the bounded difference score."""
    apart = np.abs(a.astype(np.int16) - b)
    # A length of half or twice as much counts as eight codes; small changes of length and ratio count nothing.
    score = int(apart[3:].sum()) + max(0, int(apart[0]) - 1) + max(0, int(apart[1]) - 1) + max(0, int(apart[2]) - 1)
    return 1 - min(score, FARTHEST) / FARTHEST


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
ROWS = 512


def _compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the next one of its section; guests close a section and give no row."""
    before, rows = None, []
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)
    for part in parts:
        for doc, text, guest in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
            own = before[2] if before and before[1] == text else digest(text)
            if before:
                (last, told, print_), cut = before, len(before[1]) // 4
                edited = told[: len(told) - cut] + text[:cut]
                other = digest(edited)
                rows.append((last, len(told), hashlib.sha256(edited.encode()).hexdigest(), written(print_), written(other), likeness(print_, other), likeness(print_, own)))
            before = None if guest else (doc, text, own)
            if len(rows) >= ROWS:
                yield made()
                rows = []
    if rows:
        yield made()


def _parts(placed: DataFrame, stats: list, share: int) -> DataFrame:
    """Sections of one id with far more than their share of rows, cut into parts by the hash of the text.

    Parts are even ranges of the hash; a hash with more rows than a share has
    a part of its own, dealt by the partition that its rows come from: these
    rows repeat id and text, so any of them may follow any other.
    """
    spark = placed.sparkSession
    hot = {r["section"]: r["n"] for r in stats if r["low"] == r["high"] and r["n"] > 2 * share}
    if not hot:
        return placed.withColumns({"part": F.lit(0), "deal": F.lit(0)})
    # More rows than a share each: no more hashes than there are shares.
    repeated = placed.filter(F.col("section").isin(*hot)).groupBy("section", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share).collect()
    rows = []
    for section, n in hot.items():
        own = {r["h"]: -(-r["n"] // share) for r in repeated if r["section"] == section}
        even = -(-n // share)
        cuts = {(k << 64) // even - (1 << 63) for k in range(1, even)} | {h + d for h in own for d in (0, 1) if h + d < 1 << 63}
        rows.append((section, sorted(cuts), own))
    known = spark.createDataFrame(rows, "section int, cuts array<bigint>, own map<bigint, bigint>")
    met = placed.join(F.broadcast(known), "section", "left")
    part = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("h"))))
    deal = F.pmod(F.spark_partition_id(), F.try_element_at("own", F.col("h"))).cast("int")
    return met.withColumns({"part": part, "deal": F.coalesce(deal, F.lit(0))}).drop("cuts", "own")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of each text and of its edited text, whose end is the start of the next document.

    The columns are those of ``RESULT``. Ids are cast to bigint; the order is by
    id, nulls last, then by the XXH64 of the text; the last row is followed by
    the first. A null text is empty. Repeated rows follow one another. A table
    of one row compares it with itself; an empty table gives an empty table.
    Texts under three bytes have no triplet. Other columns are not read.

    Documents are dealt to sections of the id range, bounded by quantiles, and
    an id with more than its share of rows to parts by the hash of the text;
    each also gets, as a guest, the first document of the one after it, so a
    single shuffle of the texts puts every text beside its successor. Ids beyond
    53 bits that no double tells apart share a section.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    many = 4 * spread(spark)
    ids = slim.select(F.col("doc_id").cast("double").alias("at"))
    cuts = ids.approxQuantile("at", [k / many for k in range(1, many)], 0.1 / many)
    # An id that is a quantile twice has more than a share: it is a section of its own.
    alone = {a + 1 for a, b in zip(cuts, cuts[1:], strict=False) if a == b}
    splits = [-math.inf, *sorted({*cuts, *alone}), math.inf]
    splits = splits if len(splits) > 2 else [-math.inf, 0.0, math.inf]
    cutter = Bucketizer(splits=splits, inputCol="at", outputCol="section", handleInvalid="keep")
    placed = cutter.transform(slim.withColumn("at", F.col("doc_id").cast("double"))).drop("at").withColumn("section", F.coalesce(F.col("section").cast("int"), F.lit(len(splits))))
    # One row for each section: as many as there are sections, whatever the corpus.
    stats = placed.groupBy("section").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    if not stats:
        return spark.createDataFrame([], RESULT)
    placed = _parts(placed, stats, max(1, sum(r["n"] for r in stats) // many))
    hot = {r["section"] for r in stats if r["low"] == r["high"]}
    first = [(r["section"], 0, 0, r["low"], None) for r in stats if r["section"] not in hot]
    # Of sections of one id, one row for each of their parts.
    first += [tuple(r) for r in placed.filter(F.col("section").isin(*hot)).groupBy("section", "part", "deal").agg(F.min("doc_id"), F.min("h")).collect()]
    first.sort(key=lambda x: x[:3])
    after = [(*own, k, (k - 1) % len(first)) for k, own in enumerate(first)]
    heads = F.broadcast(spark.createDataFrame(after, "section int, part int, deal int, low bigint, low_h bigint, place int, goes int"))
    met = placed.join(heads, ["section", "part", "deal"])
    guests = met.filter(F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("low_h").isNull() | (F.col("h") == F.col("low_h"))))
    guests = guests.groupBy("goes").agg(F.min(F.struct("h", "text", "doc_id")).alias("row"))
    guests = guests.select("row.doc_id", "row.text", "row.h", F.lit(True).alias("guest"), F.col("goes").alias("place"))
    rows = met.select("doc_id", "text", "h", F.lit(False).alias("guest"), "place").unionAll(guests)
    sections = rows.repartition(spread(spark), "place").sortWithinPartitions("place", "guest", F.asc_nulls_last("doc_id"), "h", "text")
    return sections.select("doc_id", "text", "guest").mapInArrow(_compared, RESULT)
