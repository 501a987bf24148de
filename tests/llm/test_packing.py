import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskwright.llm import packing
from tests.llm.cases import ROWS, awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_pieces(rows):
    t, out = Tokenizer.from_file(PATH), []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            out.append((i, k, at, len(cut), zlib.crc32(cut.tobytes())))
    return sorted(out, key=str)


def check_layout(rows):
    """Each sequence is filled from 0 without a gap, and holds at most its capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def best_fit(lengths, capacity=2048):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = packing.pack(docs, PATH).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_pieces(rows)
    assert check_layout(got) == best_fit([r.length for r in got])


def test_awkward_rows(spark):
    got = packing.pack(awkward(spark), PATH).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_pieces(ROWS)
    check_layout(got)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_ids_of_random_texts():
    """Scripts, marks, special tokens and odd blanks: the same ids as the library's on the whole text."""
    rng, known, t = random.Random(1), packing.WordIds(PATH), Tokenizer.from_file(PATH)
    alphabet = [chr(c) for c in range(256)] + list("abcABC 's 't 'LL \n\n  ") * 6 + ["œ", "’", "İ", "Σ", "ς", "é", "e\u0301", "\u0301", "中", "<|endoftext|>", "<|", "😀", "٣", "ﬁ", "\u2003", "\u0345"]
    for _ in range(6_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert known.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_ids_on_request(spark):
    rows = packing.pack(awkward(spark), PATH, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_fill_as_few_sequences_as_best_fit(spark, seed):
    """Sequential best fit, longest first, over the same lengths: ties, one length for many, only short and only long ones."""
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    mixed = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, 1 + capacity // 5) for _ in range(rng.randint(1, 400))]
    lengths = [mixed, [*mixed, *[capacity // 3] * 300], [1 + n // 9 for n in mixed], [capacity - n // 4 for n in mixed]][seed % 4]
    rows = packing.placed(spark.createDataFrame(list(enumerate(lengths)), "id bigint, size bigint"), capacity).collect()
    assert sorted(r.id for r in rows) == list(range(len(lengths))) and all(r.size == lengths[r.id] for r in rows)
    used = defaultdict(int)
    for r in rows:
        used[r.sequence] += r.size
    assert max(used.values()) <= capacity and len(used) <= best_fit(lengths, capacity)


def plain_match(pieces, gaps):
    """A stack of gaps from the largest on: each piece takes the smallest gap that holds it and is left."""
    stack, out = [], []
    for size, _, id_ in sorted([(-g, 0, k) for k, g in gaps] + [(-p, 1, k) for k, p in pieces]):
        if not _:
            stack.append((id_, -size))
        else:
            out.append((-size, stack.pop()[1] if stack else None))
    return sorted(out, key=str)


def test_one_sweep(spark):
    """Each piece gets its successor among the gaps, with ranges cut anywhere."""
    rng = random.Random(5)
    for most in (6, 60):
        pieces, gaps = [(k, rng.randint(1, most)) for k in range(300)], [(k, rng.randint(1, most)) for k in range(200)]
        got = packing._matched(spark.createDataFrame(pieces, "id bigint, size bigint"), spark.createDataFrame(gaps, "sequence bigint, gap bigint"), most)
        held, rows = dict(gaps), got.collect()
        taken = [r.sequence for r in rows if r.sequence is not None]
        assert len(set(taken)) == len(taken)
        assert sorted(((r.size, held.get(r.sequence)) for r in rows), key=str) == plain_match(pieces, gaps)


def test_other_tokenizer_files(spark):
    """A file with other rules is left to the library."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    known, t = packing.WordIds(path), Tokenizer.from_file(path)
    assert not known.by_words and packing.WordIds(PATH).by_words
    for text in ("", "A b", "Don't  stop\n2024", "é 中"):
        assert known.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
