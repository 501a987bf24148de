"""SimHash near-duplicates: fingerprints, BK-trees over shards, components.

``fingerprints`` gives each text 64 bits. ``near_links`` finds, among distinct
fingerprints, everything within the radius: two fingerprints that differ in at
most ``radius`` bits agree on all but ``radius`` of their bit blocks, so each
fingerprint is filed under every choice of that many blocks. The filed ones are
dealt to shards by their keys, and a key that too many share to several shards
of its own. Each shard is built once into BK-trees, one for each key, children
keyed by their Hamming distance to the parent. The trees are broadcast while
all of them are below a bound, and go to the tasks of their shard beyond it;
each filed fingerprint searches the tree of its key in every shard that has a
part of it, and follows only the edges within the radius. So no link is lost
and no task holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import batches, group_join, salted_join, shared_checkpoint, unused
from maskwright.llm.components import components

SHINGLE = 4
RADIUS = 4
#: Members of a shard, and of all shards whose trees are broadcast (a member takes 32 bytes).
SHARD, BROADCAST = 4096, 1 << 18
#: Shingles hashed at a time, and pairs of a search looked at in one step.
CHUNK = 1 << 16
FRONTIER = 1 << 20


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one whole text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    ones, many = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, many, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        hashed = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)), _seeds())
        ones += _ones(np.fromiter(hashed, dtype="<u8", count=len(part) - size + 1))
    return _majority(ones, many)


def folded(hashes: np.ndarray) -> int:
    """64-bit SimHash of the hashes of shingles; 0 of none."""
    return _majority(sum((_ones(hashes[at : at + CHUNK]) for at in range(0, len(hashes), CHUNK)), np.zeros(64, np.int64)), len(hashes))


def _ones(hashes: np.ndarray) -> np.ndarray:
    grid = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(grid, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, many: int) -> int:
    return int(np.packbits(2 * ones > many, bitorder="little").view("<u8")[0])


def _seeds() -> Iterator[int]:
    while True:
        yield 42


def fingerprints(text: Column) -> Column:
    """Signed 64-bit fingerprint of a text column; null is the empty text."""

    @F.arrow_udf("bigint")
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches(column):
            yield pa.array(np.array([fingerprint(t) for t in part], np.uint64).view(np.int64))

    return of.asNondeterministic()(text)


class BKForest:
    """A BK-tree for each key of a shard, built and searched level by level.

    ``keys`` must be sorted. A key's first member is the root of its tree;
    members at the same distance from a node share its edge of that length, the
    first of them becomes the child and the rest go on below it.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.values, n = values, len(values)
        first = np.r_[True, keys[1:] != keys[:-1]] if n else np.zeros(0, bool)
        self.roots = np.flatnonzero(first)
        self.keys = keys[self.roots]
        root = self.roots[np.cumsum(first) - 1]
        parents, lengths, kids = [], [], []
        left, node = np.flatnonzero(~first), root[~first]
        while len(left):
            away = np.bitwise_count(values[left] ^ values[node]).astype(np.int64)
            order = np.argsort(node * 128 + away, kind="stable")
            left, node, away = left[order], node[order], away[order]
            head = np.r_[True, (node[1:] != node[:-1]) | (away[1:] != away[:-1])]
            parents.append(node[head]), lengths.append(away[head]), kids.append(left[head])
            node = left[head][np.cumsum(head) - 1]
            left, node = left[~head], node[~head]
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        edge, self.kid = joined(parents) * 128 + joined(lengths), joined(kids)
        order = np.argsort(edge, kind="stable")
        self.edge, self.kid = edge[order], self.kid[order]

    def written(self) -> list[bytes]:
        """The arrays, as a row of the table of trees."""
        return [x.tobytes() for x in (self.values, self.keys, self.roots.astype("<i4"), self.edge, self.kid.astype("<i4"))]

    @classmethod
    def read(cls, row: list[bytes]) -> BKForest:
        forest = cls.__new__(cls)
        values, keys, roots, edge, kid = row
        forest.values, forest.keys, forest.roots = np.frombuffer(values, "<u8"), np.frombuffer(keys, "<i8"), np.frombuffer(roots, "<i4").astype(np.int64)
        forest.edge, forest.kid = np.frombuffer(edge, "<i8"), np.frombuffer(kid, "<i4").astype(np.int64)
        return forest

    def within(self, keys: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place among the asked values, member of the tree of its key) at most ``radius`` bits apart."""
        at = np.searchsorted(self.keys, keys)
        there = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else np.zeros(0, np.int64)
        for low in range(0, len(there), CHUNK):
            some = there[low : low + CHUNK]
            yield from self._from(some, self.roots[at[some]], asked, radius)

    def _from(self, some: np.ndarray, roots: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        work = [(some, roots)]
        while work:
            query, node = work.pop()
            away = np.bitwise_count(asked[query] ^ self.values[node]).astype(np.int64)
            near = away <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.edge, node * 128 + np.maximum(away - radius, 0), "left")
            count = np.searchsorted(self.edge, node * 128 + away + radius, "right") - low
            # Long frontiers are cut, and the rest waits: memory stays bounded by the shard.
            ends = np.cumsum(count)
            cuts = [0, *np.searchsorted(ends, np.arange(FRONTIER, ends[-1] if len(ends) else 0, FRONTIER)), len(count)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if total := int(count[a:b].sum()):
                    step = np.arange(total) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
                    work.append((np.repeat(query[a:b], count[a:b]), self.kid[np.repeat(low[a:b], count[a:b]) + step]))


def _roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches over the links."""
    root = np.arange(n)
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


MEMBERS = "array<struct<key: bigint, fp: bigint>>"
TREES = ("values", "keys", "roots", "edge", "kid")


def _sharing(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(shard, hot, members)`` with sorted members ``(key, fp)``: those whose key another one has; all of a part of a hot key."""
    for part in parts:
        for at in range(part.num_rows):
            members = part.column(2)[at].values
            keys = members.field("key").to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.r_[False, same] | np.r_[same, False] | part.column(1)[at].as_py()
            if keep.any():
                some = members.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, 1), part.column(1).slice(at, 1), pa.ListArray.from_arrays([0, len(some)], some)], ["shard", "hot", "members"])


def _planted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(shard, members)`` with sorted members ``(key, fp)`` as rows of the table of trees."""
    for part in parts:
        for at in range(part.num_rows):
            members = part.column(1)[at].values.flatten()
            forest = BKForest(members[0].to_numpy(), members[1].to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([part.column(0).slice(at, 1), *(pa.array([x], pa.binary()) for x in forest.written())], ["shard", *TREES])


def _search(radius: int):
    """Rows ``(asked, trees)``: link each member that was asked for to the smallest one that it reaches in the trees."""

    def linked(asked: pa.StructArray, row: list[bytes]) -> pa.RecordBatch:
        forest = BKForest.read(row)
        keys, prints = (c.to_numpy() for c in asked.flatten())
        # The members of both sides, each once: two of one fingerprint are one.
        value, place = np.unique(np.concatenate([prints, forest.values.view(np.int64)]), return_inverse=True)
        own, there = place[: len(prints)], place[len(prints) :]
        root = _roots(len(value), ((own[a], there[b]) for a, b in forest.within(keys, prints.view(np.uint64), radius)))
        keep = root != np.arange(len(value))
        return pa.RecordBatch.from_arrays([pa.array(value[keep]), pa.array(value[root[keep]])], ["a", "b"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                yield linked(part.column(0)[at].values, [c[at].as_py() for c in part.columns[1:]])

    return run


def blocks_for(many: int, radius: int) -> int:
    """Bit blocks, so that the blocks of a key have at least as many bits as the count of fingerprints."""
    blocks = radius + 2
    while 64 * (blocks - radius) // blocks < many.bit_length() and blocks < radius + 6:
        blocks += 1
    return blocks


def _filed(radius: int, blocks: int) -> Column:
    """The keys of column ``fp``: one for each choice of blocks that may agree."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for k, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask).cast("bigint")), F.lit(k)))
    return F.array(*keys)


def near_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, broadcast: int = BROADCAST) -> DataFrame:
    """Links ``(a, b)`` that join the same fingerprints of ``distinct(fp)`` as all pairs within the radius.

    They are a spanning forest of what meets in a shard, not all pairs of it: a
    group of m near copies gives at most m - 1 links a key and shard, and its
    components are exact. A key with more members than a shard has parts; a
    member of part s searches the trees of its own and each later part. All
    filed rows go to the shards, so what moves is in proportion to the count of
    fingerprints; there, those that are alone with their key drop out.
    """
    if not 0 <= radius < 16:
        raise ValueError("radius must be from 0 to 15")
    count = distinct.count()
    blocks = blocks_for(count, radius)
    filed = distinct.select("fp", F.explode(_filed(radius, blocks)).alias("key"))
    crowded = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard)
    hot = shared_checkpoint(crowded.select("key", F.ceil(F.col("n") / F.lit(shard)).cast("int").alias("parts")))
    # A hot key has more than a shard of the filed rows, so there are few; only they are met, and all filed rows go on.
    dealt = filed.join(F.broadcast(hot), "key", "left") if hot.count() <= broadcast else salted_join(filed, hot, "key", F.col("fp"), "left")
    # The other keys lie together in one of so many shards.
    shards = count * comb(blocks, radius) // shard + 1
    of = lambda part: F.when(F.col("parts") == 1, F.xxhash64(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(shards)))).otherwise(F.xxhash64("key", part, F.lit(3)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    placed = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own)
    each = F.sort_array(F.collect_list(F.struct("key", "fp")))
    gathered = placed.groupBy(of(F.col("own")).alias("shard"), (F.col("parts") > 1).alias("hot")).agg(each.alias("members"))
    gathered = shared_checkpoint(gathered.mapInArrow(_sharing, f"shard bigint, hot boolean, members {MEMBERS}"))
    trees = gathered.select("shard", "members").mapInArrow(_planted, ", ".join(["shard bigint", *(f"{x} binary" for x in TREES)]))
    later = placed.filter("parts > 1").select("key", "fp", "own", "parts", F.explode(F.sequence("own", F.col("parts") - 1)).alias("part"))
    asked = later.groupBy(of(F.col("part")).alias("shard"), "own").agg(each.alias("asked")).select("shard", "asked")
    asked = gathered.filter("not hot").select("shard", F.col("members").alias("asked")).unionAll(asked)
    many = gathered.agg(F.sum(F.size("members"))).first()[0] or 0
    met = asked.join(F.broadcast(trees) if many <= broadcast else trees, "shard")
    return met.select("asked", *TREES).mapInArrow(_search(radius), "a bigint, b bigint").distinct()


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, component_id, size)`` for the distinct fingerprints of ``prints(doc_id, fp)``, each with the count of its rows.

    ``component_id`` is the smallest doc_id that is reachable over links of at
    most ``radius`` bits; a null doc_id is never smallest unless all are null.
    """
    distinct = shared_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size")))
    roots = components(near_links(distinct.select("fp"), radius))
    inside = roots.select(F.col("vertex").alias("fp"), "root").unionAll(roots.select(F.col("root").alias("fp"), "root").distinct())
    inside = distinct.join(inside, "fp")
    named = inside.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = salted_join(inside.select("fp", "root"), named, "root", F.col("fp")).select("fp", "component_id")
    return shared_checkpoint(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), "size"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint (16 hex digits), component_id``.

    Null and empty texts, and those of white space only, have fingerprint zero
    and are linked like any other. Texts with fewer than four words have their
    whole word sequence as the one shingle. Repeated rows each get a row. An
    empty table gives an empty table. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp"))
    slim = shared_checkpoint(slim)
    return group_join(slim, classes(slim, radius), "fp", "size").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each component.

    The row with the smallest id stays; among rows that share that id, the one
    with the smallest text hash, and of exact repeats one. Rows with a null id
    come last in that order.
    """
    id_, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    slim = shared_checkpoint(docs.select(id_.alias("doc_id"), F.xxhash64(text).alias("h"), fingerprints(F.col(text_col)).alias("fp")))
    of = group_join(slim, classes(slim.select("doc_id", "fp"), radius), "fp", "size")
    first = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "h")).alias("first"))
    return only_first(docs, first, id_col, text_col)


def only_first(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``first(first.doc_id, first.h)`` names by id and text hash; of exact repeats one.

    Texts are shuffled once, by both, and met there. Before that, each task of
    the scan leaves one of its repeats (a limit of the window), so a row that
    makes up a third of the table is sent once by each task.
    """
    key, number = unused(docs.columns, 2)
    hashed = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    marked = docs.withColumn(key, F.struct(F.col(f"`{id_col}`").alias("doc_id"), hashed.alias("h")))
    once = marked.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(number) == 1)
    named = first.select(F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h")).alias(key)).distinct()
    return once.join(named, key, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
