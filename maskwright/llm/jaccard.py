"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles, for the pipeline.

Each distinct set of shingles has a SimHash, and BK-trees over shards of bit
blocks join the fingerprints within RADIUS bits to groups (``simhash``). Most
pairs at the threshold are further apart than any radius that such trees can
search at size, so MinHash bands propose the rest: a set is filed under BANDS
keys of WIDTH minima, and a pair at the threshold misses every band once in
10,000 times ((1 - 0.8 ** 5) ** 24); bands whose members are all in one SimHash
group have nothing to add. Sets of a group or a band are then compared shingle
by shingle, and only a similarity that reaches the threshold links them. Keys
with the same members ask once; a key that too many share is dealt over pairs
of sub-shards, so no link is lost and no task holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import group_join, salted_join, shared_checkpoint, spread, texts
from maskwright.llm.components import components
from maskwright.llm.simhash import _roots, classes, folded, only_first

SHINGLE, LEAST = 5, 0.8
#: Bits that two fingerprints of a SimHash link may differ in.
RADIUS = 5
BANDS, WIDTH = 24, 5
SHARD = 256
#: Rows of a batch, and shingles whose minima are taken at a time.
ROWS, CHUNK = 256, 4096
_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * WIDTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, (BANDS * WIDTH, 1), np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, a text without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    size = min(SHINGLE, len(words))
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(words) - size + 1))


def _signed(value: int) -> int:
    return value - (value >> 63 << 64)


def _bands(grams: np.ndarray) -> list[int]:
    """The band keys of a set of shingles."""
    if not len(grams):
        return []
    low = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), CHUNK):
        np.minimum(low, (FACTORS * grams[None, at : at + CHUNK] + TERMS).min(axis=1), out=low)
    return [_signed(xxhash.xxh64_intdigest(low[k * WIDTH : (k + 1) * WIDTH].tobytes(), k)) for k in range(BANDS)]


def _filed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, ROWS):
            rows = part.slice(at, ROWS)
            sets = [shingles(t) for t in texts(rows.column(2))]
            sids = pa.array([_signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), sids, pa.array([_signed(folded(s)) for s in sets], pa.int64()), pa.array(map(_bands, sets), pa.list_(pa.int64()))], ["doc_id", "h", "sid", "fp", "keys"])


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, ROWS):
            rows = part.slice(at, ROWS)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([shingles(t).tobytes() for t in texts(rows.column(1))], pa.binary())], ["sid", "grams"])


def _similar(sets: list[np.ndarray], least: float, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indexes of the sets (none empty), the first of them asking, whose Jaccard similarity is at least ``least``."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    every, number = np.unique(np.concatenate(sets), return_inverse=True)
    inside = np.zeros(len(every), bool)
    for i in asking:
        own = sets[i]
        mine = number[starts[i] : starts[i] + len(own)]
        inside[mine] = True
        shared = np.add.reduceat(inside[number].view(np.uint8), starts, dtype=np.int64)
        inside[mine] = False
        near = np.flatnonzero(shared >= least * (sizes + len(own) - shared) - 1e-9)
        yield np.full(len(near), i), near


#: What a comparison reads, and gives: links, or with a key a member that its hub's group has not reached.
READ, GIVEN = ("shard", "sid", "grams", "key", "hub", "asks"), "a bigint, b bigint, key bigint"


def _compare(least: float):
    """Per partition, sorted by shard: link each set to its shard's first one that it reaches."""

    def linked(key: int | None, hub: int, rows: list[tuple[int, bytes, bool]]) -> pa.RecordBatch:
        value = np.array([r[0] for r in rows], np.int64)
        sets = [np.frombuffer(r[1], np.uint64) for r in rows]
        root = _roots(len(rows), _similar(sets, least, np.flatnonzero([r[2] for r in rows])))
        keep = np.flatnonzero(root != np.arange(len(rows)))
        far = value[root != root[np.flatnonzero(value == hub)[0]]] if key is not None else value[:0]
        keys = pa.array([None] * len(keep) + [key] * len(far), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([value[keep], far])), pa.array(np.concatenate([value[root[keep]], far])), keys], ["a", "b", "key"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of, rows = None, (None, 0), []
        for part in parts:
            for shard, sid, grams, key, hub, asks in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if shard != at and rows:
                    yield linked(*of, rows)
                    rows = []
                at, of = shard, (key, hub)
                rows.append((sid, grams, asks))
        if rows:
            yield linked(*of, rows)

    return run


def _grouped(sets: DataFrame, radius: int) -> DataFrame:
    """``(sid, keys, group)``: the sets that have shingles, by SimHash groups; the last key of a set is that of its group."""
    prints = sets.filter(F.size("keys") > 0).select(F.col("sid").alias("doc_id"), "fp")
    named = group_join(prints, classes(prints, radius), "fp", "size").select(F.col("doc_id").alias("sid"), F.col("component_id").alias("group"))
    return sets.select("sid", "keys").join(named, "sid").select("sid", F.concat("keys", F.array(_group_key("group"))).alias("keys"), "group")


def _group_key(group: str) -> Column:
    return F.xxhash64(group, F.lit("simhash"))


def _members(slim: DataFrame, size: int) -> DataFrame:
    """``(key, sid, hub, parts, own)``: the sets that share a key, its hub, its sub-shards and the one each set is in.

    A key whose sets are all in one SimHash group (column ``group``, if there
    is one) is left out, unless it is the key of that group: all its pairs meet there.
    """
    group = F.col("group" if "group" in slim.columns else "sid")
    filed = slim.select("sid", group.alias("group"), F.explode("keys").alias("key")).distinct()
    each = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("members"), F.min("sid").alias("hub"), F.min("group").alias("low"), F.max("group").alias("high")
    shared = filed.groupBy("key").agg(*each).filter((F.col("n") > 1) & ((F.col("low") != F.col("high")) | (F.col("key") == _group_key("low"))))
    filed = filed.drop("group")
    shared = shared.groupBy("n", "members", "hub").agg(F.min("key").alias("key"))
    parts = F.ceil(F.col("n") / F.lit(size)).cast("int").alias("parts")
    return salted_join(filed, shared.select("key", "hub", parts), "key", F.col("sid")).withColumn("own", _dealt("sid", "parts"))


def _dealt(sid: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(sid, F.lit(1)), F.col(parts)).cast("int")


def _own_shards(members: DataFrame) -> DataFrame:
    """Each member in its own sub-shard, hubs in all of theirs; the key stands where there is more than one."""
    part = F.when(F.col("sid") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    placed = members.select("sid", "grams", "key", "hub", "parts", F.explode(part).alias("part"))
    return placed.select("sid", "grams", "hub", F.xxhash64("key", "part").alias("shard"), F.when(F.col("parts") > 1, F.col("key")).alias("key"), F.lit(True).alias("asks"))


def _other_shards(members: DataFrame) -> DataFrame:
    """Those that ``far`` marks meet, in ``lots`` of their own, the members of each other sub-shard."""
    stay = F.transform(F.sequence(F.lit(0), F.col("lots") - 1), lambda lot: F.struct(F.col("own").alias("part"), lot.alias("lot"), F.lit(False).alias("asks")))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda part: part != F.col("own"))
    go = F.transform(others, lambda part: F.struct(part.alias("part"), _dealt("sid", "lots").alias("lot"), F.lit(True).alias("asks")))
    placed = members.select("sid", "key", "hub", "grams", F.explode(F.when(F.col("far"), F.concat(stay, go)).otherwise(stay)).alias("at"))
    return placed.select("sid", "grams", "hub", F.xxhash64("key", "at.part", "at.lot").alias("shard"), F.lit(None).cast("bigint").alias("key"), "at.asks")


def _links(rows: DataFrame, first: DataFrame, members: DataFrame, least: float, size: int) -> DataFrame:
    """Links ``(a, b)`` that join the same sets as all similar pairs of those that share a key."""

    def with_sets(some: DataFrame) -> DataFrame:
        asked = first.join(some.select("sid").distinct(), "sid").select("sid", F.col("first.doc_id").alias("of_id"), F.col("first.h").alias("of_h"))
        met = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h"))).select("sid", "t")
        return some.join(met.mapInArrow(_sets, "sid bigint, grams binary").dropDuplicates(["sid"]), "sid")

    def compared(shards: DataFrame) -> DataFrame:
        shards = shards.select(*READ).repartition(spread(rows.sparkSession), "shard").sortWithinPartitions("shard", "sid")
        return shards.mapInArrow(_compare(least), GIVEN).distinct()

    met = shared_checkpoint(compared(_own_shards(with_sets(members))))
    links, far = met.filter("key is null").select("a", "b"), met.filter("key is not null").select("key", F.col("a").alias("sid"), F.lit(True).alias("far"))
    if far.isEmpty():
        return links
    lots = far.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("lots"))
    some = salted_join(members.filter("parts > 1"), lots, "key", F.col("sid")).join(far, ["key", "sid"], "left").withColumn("far", F.coalesce("far", F.lit(False)))
    return links.unionAll(compared(_other_shards(with_sets(shared_checkpoint(some)))).select("a", "b")).distinct()


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, shard: int = SHARD, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each group of near duplicates.

    Groups are the components over pairs whose sets of five-word shingles have
    a Jaccard similarity of at least ``least``, proposed by SimHash groups
    (links of at most ``radius`` bits) and by MinHash bands. The row with the smallest id
    stays, a null id last. Texts without words, nulls among them, are copies of
    each other. Of rows that repeat id and text one stays; an empty table stays
    empty; columns of any name, and nulls in them, are carried along.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    slim = rows.mapInArrow(_filed, f"doc_id {kind}, h bigint, sid bigint, fp bigint, keys array<bigint>")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "h")).alias("first")
    first = shared_checkpoint(slim.groupBy("sid").agg(smallest, F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    members = shared_checkpoint(_members(_grouped(first, radius), shard))
    roots = components(_links(rows, first, members, least, shard))
    named = first.join(roots, F.col("sid") == F.col("vertex"), "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first"))
    return only_first(docs, named.select("first"), id_col, text_col)
