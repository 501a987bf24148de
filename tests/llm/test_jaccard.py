import random

import pytest
import xxhash
from pyspark.sql import functions as F

from maskwright.llm import jaccard
from maskwright.llm.common import shared_checkpoint
from tests.llm.cases import awkward, empty

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows, least=0.8):
    """Smallest id of each component over all pairs."""
    group, sets = list(range(len(rows))), [grams(t) for _, t in rows]

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted(low.values())


def edited(rng):
    """Texts with copies at many similarities: single words, the end or the start replaced."""
    rows = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows.append(words)
        for cut in (0.02, 0.05, 0.08, 0.1, 0.12, 0.2):
            n = int(len(words) * cut)
            rows.append(words[:-n] + [f"x{rng.randrange(5000)}" for _ in range(n)])
        spots = set(rng.sample(range(len(words)), max(1, len(words) // 60)))
        rows.append([f"y{k}" if k in spots else w for k, w in enumerate(words)])
    texts = [(k, " ".join(w)) for k, w in enumerate(rows)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("shard", [3, 256])
def test_against_all_pairs(spark, shard):
    rows = edited(random.Random(3))
    got = jaccard.keep_distinct(spark.createDataFrame(rows, "doc_id bigint, text string"), shard=shard)
    want = plain_kept(rows)
    assert sorted(r.doc_id for r in got.collect()) == want and 30 < len(want) < len(rows)


def test_the_stage_drops_near_copies_that_simhash_keeps(spark):
    """One tenth of the words is other: similarity 0.8 and more, far beyond four bits."""
    rng, rows = random.Random(5), []
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:182] + [f"x{j}" for j in range(18)]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()) == [2 * k for k in range(20)]


def components_of(n, near):
    """The sets of indexes that all pairs for which ``near`` holds connect."""
    groups = []
    for k in range(n):
        met = [g for g in groups if any(near(k, j) for j in g)]
        groups = [g for g in groups if g not in met] + [set().union({k}, *met)]
    return groups


def plain_print(words):
    hashes = [xxhash.xxh64_intdigest(" ".join(g)) for g in grams(words)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("shard", [3, 256])
def test_simhash_groups_propose_and_jaccard_decides(spark, monkeypatch, shard):
    """Without any band, sets of one group of fingerprints within five bits are linked if they are similar, and no others."""
    rows, seen = edited(random.Random(3)), []
    words = [f"w{k}" for k in range(20)]
    rows += [(1000, " ".join(words)), (1001, " ".join(words[:16] + ["a8", "b8", "c8"]))]
    texts = [t for _, t in rows]
    prints, sets, members = [plain_print(t) for t in texts], [grams(t) for t in texts], jaccard._members

    def similar(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    def without_bands(slim, size):
        seen.extend(slim.select("sid", "group").collect())
        return members(slim.withColumn("keys", F.slice("keys", -1, 1)), size)

    monkeypatch.setattr(jaccard, "_members", without_bands)
    kept = sorted(r.doc_id for r in jaccard.keep_distinct(spark.createDataFrame(rows, "doc_id bigint, text string"), shard=shard).collect())
    groups = components_of(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 5)
    sizes = {}
    for r in seen:
        sizes[r.group] = sizes.get(r.group, 0) + 1
    assert sorted(sizes.values()) == sorted(len({frozenset(sets[k]) for k in g}) for g in groups)
    same = {k: n for n, g in enumerate(groups) for k in g}
    assert kept == sorted(min(rows[k][0] for k in g) for g in components_of(len(rows), lambda a, b: same[a] == same[b] and similar(a, b)))
    assert len(kept) < len(rows) and any(not similar(a, b) for g in groups for a in g for b in g)


def test_a_band_within_one_simhash_group_asks_nothing(spark):
    sets = [(1, [10, 11, jaccard_key(spark, 1)], 1), (2, [10, 11, jaccard_key(spark, 1)], 1), (3, [11, jaccard_key(spark, 3)], 3)]
    got = jaccard._members(spark.createDataFrame(sets, "sid bigint, keys array<bigint>, group bigint"), 256).collect()
    assert sorted((r.key, r.sid) for r in got) == sorted([(11, 1), (11, 2), (11, 3), (sets[0][1][2], 1), (sets[0][1][2], 2)])


def jaccard_key(spark, group):
    return spark.createDataFrame([(group,)], "g bigint").select(jaccard._group_key("g")).first()[0]


def test_near_copies_cost_in_proportion_to_their_number(spark, monkeypatch):
    """Members of a group that all resemble their hub are in one sub-shard each; none goes on."""
    rng, sent = random.Random(7), []
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(k, " ".join([*words[:-1], f"end{k}"])) for k in range(120)]
    own, other = jaccard._own_shards, jaccard._other_shards
    monkeypatch.setattr(jaccard, "_own_shards", lambda m: sent.append((own(m).count(), m.count(), m.filter("sid = hub").count(), m.agg(F.max("parts")).first()[0])) or own(m))
    monkeypatch.setattr(jaccard, "_other_shards", lambda m: sent.append("others") or other(m))
    kept = jaccard.keep_distinct(spark.createDataFrame(rows, "doc_id bigint, text string"), shard=10)
    assert [r.doc_id for r in kept.collect()] == [0]
    ((rows_sent, members, hubs, parts),) = sent
    assert parts > 1 and rows_sent <= members + hubs * (parts - 1)


def test_members_of_a_hot_key_that_its_hub_does_not_reach(spark):
    """All texts share a key; the groups in it are of their own words."""
    rng, rows = random.Random(11), []
    for group in range(12):
        own = [f"g{group}x{rng.randrange(5000)}" for _ in range(80)]
        rows += [(10 * group + k, " ".join(own[:-k] + [f"e{group}_{k}"] * k if k else own)) for k in range(6)]
    members = spark.createDataFrame([(1, k) for k in range(72)], "key bigint, sid bigint")
    first = spark.createDataFrame([(k, (False, i, 0)) for k, (i, _) in enumerate(rows)], "sid bigint, first struct<null_id: boolean, doc_id: bigint, h: bigint>")
    texts = spark.createDataFrame([(i, 0, t) for i, t in rows], "doc_id bigint, h bigint, t string")
    filed = members.select("sid", F.array("key").alias("keys"))
    for size in (4, 7, 1000):
        found = jaccard._links(texts, first, shared_checkpoint(jaccard._members(filed, size)), 0.8, size).collect()
        group = list(range(72))

        def find(x, group=group):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in found:
            group[find(a)] = find(b)
        got = {}
        for k, (i, _) in enumerate(rows):
            got.setdefault(find(k), []).append(i)
        assert sorted(min(ids) for ids in got.values()) == plain_kept(rows), size


def test_awkward_rows(spark):
    kept = jaccard.keep_distinct(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(["1", "3", "6", "7", "8", "9", "10", "11", "None"])
    assert jaccard.keep_distinct(empty(spark)).count() == 0
