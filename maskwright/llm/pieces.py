"""Offset-preserving encoding and decoding with a compiled piece model.

The normaliser reads the model's own compiled character map: at each byte the
longest key that matches is replaced, and every normalised byte remembers the
source byte that it came from. The library's segmenter then sees normalised
text only, with its own normaliser switched off, and each piece is projected
through that record to a span of bytes of the original text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import texts

BLANK = "▁"
#: Rows in a batch of results, and characters that the segmenter sees at a time.
ROWS, CUT = 64, 50_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def _message(number: int, body: bytes) -> bytes:
    size, head = len(body), b""
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return bytes([number << 3 | 2]) + head + bytes([size]) + body


class CharMap:
    """Longest-prefix lookup in a compiled character map (a double-array trie and its strings)."""

    def __init__(self, blob: bytes) -> None:
        self.units: np.ndarray | list[int] = []
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units, self.strings = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that starts at ``at``, and that key's length."""
        if not self.units:
            return None
        units, found = self.units, None
        offset = lambda unit: unit >> 10 << ((unit & 512) >> 6)
        node = offset(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != text[k]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = self.strings[start : self.strings.index(0, start)], k - at + 1
        return found


class PieceModel:
    """A piece model: its normaliser, its segmenter and its table for decoding."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        data = open(path, "rb").read()
        top = list(_fields(data))
        spec = dict(_fields(next((v for n, v in top if n == 3), b"")))
        self.map = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        # The same model with a normaliser that leaves text as it is.
        plain = _message(3, _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00")
        self.segmenter = SentencePieceProcessor(model_proto=b"".join(_message(n, v) for n, v in top if n != 3) + plain)
        rows = [dict(_fields(v)) for n, v in top if n == 1]
        names = [r[1].decode() for r in rows]
        kinds = [r.get(3, 1) for r in rows]
        # Kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte.
        self.sizes = [1 if k == 6 else len(n.encode()) for n, k in zip(names, kinds, strict=True)]
        self.unknown = next((i for i, k in enumerate(kinds) if k == 2), -1)
        self.table = [b"" if k == 3 else bytes([int(n[1:-1], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else n.replace(BLANK, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.begin, self.end = self.segmenter.bos_id(), self.segmenter.eos_id()
        self.bytes_of = np.array(self.sizes, np.int64)
        #: Bytes of the source of each piece, if each of its blanks is a space there.
        self.source_of = self.bytes_of - 2 * np.array([n.count(BLANK) if k != 6 else 0 for n, k in zip(names, kinds, strict=True)], np.int64)
        # Long texts may be cut before a blank where no piece reaches over one.
        apart = not any(re.search(f"[^{BLANK}]{BLANK}", n) for n, k in zip(names, kinds, strict=True) if k in (1, 4))
        self.direct = apart and not self.map.units and self.escape and not self.squeeze

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and for their end the source byte."""
        source, out, origin = text.encode(), bytearray(), []
        blank = BLANK.encode() if self.escape else b" "
        at, parts = 0, []
        while at < len(source):
            if hit := self.map.longest(source, at):
                parts.append((hit[0], at, hit[1]))
            else:
                lead = source[at]
                parts.append((source[at : at + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)], at, 0))
            at += parts[-1][2] or len(parts[-1][0])
        if self.squeeze:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
        last = parts[0][1] if parts else 0
        if parts and self.prefix:
            out += blank
            origin += [last] * len(blank)
        spaced = self.squeeze
        for new, start, _ in parts:
            for byte in new:
                if byte == 32 and self.squeeze and spaced:
                    continue
                spaced = byte == 32
                made = blank if byte == 32 else bytes([byte])
                out += made
                origin += [start] * len(made)
            last = start
        end = len(source)
        if self.squeeze:
            while out.endswith(blank) and len(out) > len(blank) * self.prefix:
                end = origin[-1]
                del out[-len(blank) :], origin[-len(blank) :]
        # A byte of a longer character or key starts where that starts; plain characters keep each byte.
        return bytes(out), np.array([*origin, end], np.int64)

    def _segments(self, escaped: str) -> Iterator[str]:
        """Stretches of some CUT characters that begin with a run of blanks."""
        at = 0
        while at < len(escaped):
            end = escaped.find(BLANK, at + CUT)
            while end > 0 and escaped[end - 1] == BLANK:
                end -= 1
            end = len(escaped) if end <= at else end
            yield escaped[at:end]
            at = end

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the begin and end ids, and a row (begin, end) of source bytes for each."""
        size = len(text.encode())
        if not text:
            ids, spans = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        elif self.direct and BLANK not in text:
            escaped = BLANK * self.prefix + text.replace(" ", BLANK)
            ids = np.concatenate([np.asarray(self.segmenter.encode(s), np.int64) for s in self._segments(escaped)])
            ends = np.cumsum(self.source_of[ids])
            if not len(ends) or self.unknown in ids or ends[-1] - self.prefix != size:
                return self._projected(text)
            ends -= self.prefix  # the added blank is no byte of the source
            spans = np.stack([np.append(0, ends[:-1]), ends], axis=1)
        else:
            return self._projected(text)
        return self._edged(ids, spans, size)

    def _projected(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same by the record that the normaliser makes of each byte."""
        normal, origin = self.normalise(text)
        ids = np.asarray(self.segmenter.encode(normal.decode()), np.int64)
        sizes = self.bytes_of[ids]
        if self.unknown in ids:
            sizes = np.array([p.end - p.begin for p in self.segmenter.encode(normal.decode(), return_type="proto").pieces], np.int64)
        ends = np.cumsum(sizes)
        return self._edged(ids, np.stack([origin[ends - sizes], origin[ends]], axis=1), len(text.encode()))

    def _edged(self, ids: np.ndarray, spans: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[self.begin], ids, [self.end]]), np.concatenate([[[0, 0]], spans, [[size, size]]])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding adds in front goes, and bytes that are no UTF-8 become U+FFFD each."""
        data = b"".join(map(self.table.__getitem__, ids.tolist()))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="surrogateescape").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@lru_cache(maxsize=1)
def known_model(path: str) -> PieceModel:
    """One for each Python worker, which serves many tasks."""
    return PieceModel(path)


def _encoder(model_path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known_model(model_path)
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                rows, n, ids, spans, decoded = part.slice(at, ROWS), [], [], [], []
                for text in texts(rows.column(1)):
                    found, where = model.encode(text)
                    n.append(len(found))
                    ids.append(found.astype("<u4").tobytes())
                    spans.append(where.astype("<u4").tobytes())
                    decoded.append(model.decode(found))
                columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(spans, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "spans", "decoded"])

    return run


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids, spans, decoded``.

    ``ids`` holds little-endian unsigned 32-bit integers with the begin and end
    ids, ``spans`` two such integers for each id, its begin and end in bytes of
    the original text, and ``decoded`` the text that the ids give. A null or
    empty text has the begin and end ids alone. Repeated rows each get a row;
    an empty table gives an empty table; other columns are not read. Results
    leave a task in batches of ROWS, whatever came in with one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoder(model_path), f"doc_id {kind}, n_tokens bigint, ids binary, spans binary, decoded string")
