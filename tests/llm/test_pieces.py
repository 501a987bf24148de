import random
import struct

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from maskwright.llm import pieces
from tests.llm.cases import ROWS, awkward, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def check(library, text, ids, spans, decoded):
    want = library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == library.decode(want)
    source, spans = text.encode(), np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()
    proto = library.encode(text, return_type="proto").pieces
    body = spans[1:-1]
    assert [b for b, _ in body[:1]] == [0] * len(body[:1])
    assert all(b == e for (_, b), (e, _) in zip(body, body[1:], strict=False)), "pieces cover the text without gaps"
    assert not body or body[-1][1] == len(source)
    for (b, e), p in zip(body, proto, strict=True):
        if p.piece.startswith("<0x"):
            continue  # the library gives the bytes of a character that is cut no place of their own
        assert (b, e) == (p.begin, p.end), (p, text[:50])


def test_against_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = pieces.encoded(docs, PATH).collect()
    assert len(got) == len(text)
    for r in got:
        check(library, text[r.doc_id], r.ids, r.spans, r.decoded)
        assert r.n_tokens == len(r.ids) // 4


def test_awkward_rows(spark, library):
    got = pieces.encoded(awkward(spark), PATH).collect()
    texts = {i: t or "" for i, t in ROWS}
    for r in got:
        check(library, texts[r.doc_id], r.ids, r.spans, r.decoded)
    assert len(got) == len(ROWS) and pieces.encoded(empty(spark), PATH).count() == 0


def test_random_texts(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "CUT", 7)
    rng = random.Random(3)
    alphabet = "aabcdeé ß  \n\t▁.,'1😀ſ中́\x00<s>"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        ids, spans = model.encode(text)
        check(library, text, ids.astype("<u4").tobytes(), spans.astype("<u4").tobytes(), model.decode(ids))
        projected = model._projected(text) if text else (ids, spans)
        assert (projected[0] == ids).all() and [s for s, i in zip(projected[1].tolist(), ids, strict=True) if not 3 <= i < 259] == [s for s, i in zip(spans.tolist(), ids, strict=True) if not 3 <= i < 259]


def test_decode_of_any_ids(library, model):
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.choice([1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 12))]
        want = library.decode(ids)
        got = model.decode(np.array(ids, np.int64))
        if "�" not in want:
            assert got == want, ids


def trie(keys: dict[bytes, bytes]) -> bytes:
    """A compiled character map, laid out by brute force."""
    strings, at = b"", {}
    for k, v in keys.items():
        at[k] = len(strings)
        strings += v + b"\0"
    units, used = [0] * (1 << 16), {0}

    def place(node: int, prefix: bytes) -> None:
        labels = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        base = next(b for b in range(1, 1 << 15) if all((b ^ x) not in used for x in [*labels, *([0] if leaf else [])]) and (b ^ node) < 1 << 21)
        units[node] |= (base ^ node) << 10
        if leaf:
            units[node] |= 256
            units[base] = at[prefix] | 1 << 31
            used.add(base)
        used.update(base ^ x for x in labels)
        for x in labels:
            units[base ^ x] = x
        for x in labels:
            place(base ^ x, prefix + bytes([x]))

    place(0, b"")
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + strings


def test_character_map(tmp_path):
    """A model with rules of its own: the library and the operator agree, longest rule first."""
    rules = {"ﬁ": "fi", "A": "a", "é": "e", "é": "e", "\t": " ", "ab": "X", "abc": "YZ", "½": "1/2", "​": ""}
    blob = trie({k.encode(): v.encode() for k, v in rules.items()})
    top = [(n, v) for n, v in pieces._fields(open(PATH, "rb").read()) if n != 3]
    spec = pieces._message(1, b"own") + pieces._message(2, blob)
    for flags in (b"\x18\x01\x20\x00\x28\x01", b"\x18\x01\x20\x01\x28\x01", b"\x18\x00\x20\x01\x28\x01"):
        path = tmp_path / f"{flags.hex()}.model"
        path.write_bytes(b"".join(pieces._message(n, v) for n, v in top) + pieces._message(3, spec + flags))
        library, model = SentencePieceProcessor(model_file=str(path)), pieces.PieceModel(str(path))
        rng = random.Random(5)
        for text in ["ﬁn abcab Aé½ x", "", "  two  blanks ", *("".join(rng.choice(["ﬁ", "A", "é", "e", "́", " ", "\t", "a", "b", "c", "½", "z"]) for _ in range(12)) for _ in range(300))]:
            ids, spans = model.encode(text)
            assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), (flags, text)
            assert (spans[1:, 0] >= spans[:-1, 0]).all() and spans.max(initial=0) <= len(text.encode())
    found = pieces.CharMap(blob)
    assert found.longest(b"abcd", 0) == (b"YZ", 3) and found.longest(b"abx", 0) == (b"X", 2) and found.longest(b"xyz", 0) is None
