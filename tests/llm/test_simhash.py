import random

import numpy as np
import pytest
import xxhash

from maskwright.llm import simhash
from maskwright.llm.components import components
from tests.llm.cases import ROWS, awkward, empty


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                group[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(prints):
        low.setdefault(find(k), []).append(i)
    name = {r: min((i for i in ids if i is not None), default=None) for r, ids in low.items()}
    return sorted(((i, f"{f:016x}", name[find(k)]) for k, (i, f) in enumerate(prints)), key=str)


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == plain_components(rows)


def test_awkward_rows(spark):
    got = sorted(map(tuple, simhash.near_duplicates(awkward(spark)).collect()), key=str)
    assert got == plain_components(ROWS)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("shard, broadcast", [(2, 0), (2, 1 << 18), (16, 0), (1000, 1 << 18)])
def test_links_of_dense_groups(spark, shard, broadcast):
    """Chains and clouds of fingerprints: neither sub-sharding nor trees that are not broadcast lose a link."""
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(50)}
    for seed in list(values)[:6]:
        at = seed
        for _ in range(40):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                at ^= 1 << b
            values.add(at)
    values = sorted(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), shard=shard, broadcast=broadcast)
    root = {r.vertex: r.root for r in components(links).collect()}
    got = {}
    for v in signed:
        got.setdefault(root.get(v, v), set()).add(v)
    group = {v: {v} for v in signed}
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4 and group[signed[i]] is not group[signed[j]]:
                merged = group[signed[i]] | group[signed[j]]
                for v in merged:
                    group[v] = merged
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in group.values()}


def test_only_hot_keys_are_repeated(spark, monkeypatch):
    """Two fingerprints that share a key by chance make no row of a join: what is met are keys with more members than a shard."""
    rng, met = random.Random(13), []
    values = [rng.getrandbits(63) for _ in range(100)]
    values += [v ^ 0b1011111 for v in values] + [k << 20 for k in range(1, 40)]
    prints = spark.createDataFrame([(v,) for v in values], "fp bigint")
    join = simhash.salted_join
    monkeypatch.setattr(simhash, "salted_join", lambda rows, few, *a, **b: met.append((rows.count(), few.count())) or join(rows, few, *a, **b))
    root = {r.vertex: r.root for r in components(simhash.near_links(prints, shard=16, broadcast=0)).collect()}
    ((filed, keys),) = met
    assert filed == 15 * len(values) and 0 < keys <= filed / 16
    assert len({root.get(v, v) for v in values}) == len(plain_classes(values, 4))


def plain_classes(values, radius):
    groups = []
    for v in values:
        near = [g for g in groups if any(((v ^ w) & (1 << 64) - 1).bit_count() <= radius for w in g)]
        groups = [g for g in groups if g not in near] + [set().union({v}, *near)]
    return groups


@pytest.mark.parametrize("radius", [0, 3, 5])
def test_other_radii_and_many_blocks(spark, radius):
    """The count of blocks grows with the fingerprints; every choice of them proposes all links."""
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for v in values]
    signed = sorted({int(np.uint64(v).astype(np.int64)) for v in values})
    assert [simhash.blocks_for(n, 4) for n in (10, 1 << 20, 1 << 26, 1 << 30, 1 << 40)] == [6, 6, 7, 8, 10]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), radius)
    root = {r.vertex: r.root for r in components(links).collect()}
    near = {(a, b) for a in signed for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert all(root.get(a, a) == root.get(b, b) for a, b in near)
    assert len({root.get(v, v) for v in signed}) == len(plain_classes(signed, radius))


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.vertex: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_one_row_of_each_component_stays(spark):
    kept = simhash.keep_representatives(awkward(spark))
    assert kept.columns == awkward(spark).columns
    low = {c for _, _, c in plain_components(ROWS)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(low, key=str)
    assert simhash.keep_representatives(empty(spark)).count() == 0
