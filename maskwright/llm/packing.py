"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Lengths fall into bands, and the bands are placed from the longest on. In a
round, pieces and gaps are sorted by size together, over ranges of sizes (a few
thousand of them are one range), and a sweep from the largest on gives each piece its successor: the smallest gap that
holds it and that no piece before it has. Read as brackets, a gap opens and a
piece closes: running sums give each its depth, and a piece takes the last gap
of its depth, so conflicts for a gap are settled by rank. Then the gaps are
updated, and the next round follows. What finds no gap opens new sequences. The
driver sees how many pieces are left and the longest of them, nothing else.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from maskwright.llm.common import batches, shared_checkpoint

CAPACITY = 2048
#: Bands of lengths end at these parts of the capacity; rounds of a band.
BANDS, ROUNDS = (1, 2, 3, 4, 6, 8, 12, 24, 72), 2
#: Pieces and gaps up to which a sweep is one range.
FEW = 50_000
#: Words whose ids a Python worker remembers.
REMEMBERED = 250_000
#: Words, contractions, digits and runs of other signs of texts in Latin-1, whose superscripts and fractions are numbers.
WORDS = re.compile(r"[^\W\d_²³¹¼½¾]+|'s|'t|'re|'ve|'m|'ll|'d|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
#: Special tokens, and separators that only Python takes for white space.
UNSURE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


#: Every sign of Latin-1 beside letters, digits, blanks, marks and itself, and the contractions.
PROBES = tuple(t for c in map(chr, range(256)) for t in (f"a{c}b", f"A1{c}{c}2", f" {c} ", f"'s{c}.")) + tuple(f"It{q}{end}X don{q}{end} {q}{end}" for q in ("'", "''") for end in ("s", "t", "re", "ve", "m", "ll", "d", "LL", "x")) + ("The Quick  brown\n\nfox, 123 4567!? --__ end",)


def plain(text: str) -> bool:
    """Whether the library's rules and those of WORDS cannot differ on a text."""
    if any(sign in text for sign in UNSURE):
        return False
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordIds(dict):
    """Ids, as little-endian bytes, of each word of lower-case text.

    The tokenizer lower-cases, drops white space and cuts text into words,
    single digits and runs of other signs, which it encodes each on its own; so
    a text's ids are those of its words in order. Texts in which its rules and
    these could differ go to the library whole. ``__missing__`` fills the gaps:
    what was asked for lately is kept, in two generations of bounded size.
    """

    by_words = True

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        # How the byte-level step writes each byte of a word.
        split = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        shown = {byte: split(chr(byte).encode("latin-1").decode()) for byte in range(128)}
        self.signs = {byte: s[0][0] for byte, s in shown.items()}
        for byte in range(128, 256):
            pair = bytes([195, byte]) if byte < 192 else bytes([byte, 128])
            if 194 <= byte < 224 or byte < 192:
                self.signs[byte] = split(pair.decode())[0][0][byte < 192]
        # Another tokenizer file, with other rules than those of WORDS, is left to the library.
        self.by_words = all(self.ids(p) == self.whole(p) for p in PROBES if plain(p))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            signs = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.signs)
            found = np.array([t.id for t in self.model.tokenize(signs)], "<u4").tobytes()
        if len(word) <= 100:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if not self.by_words:
            return self.whole(text)
        if plain(text):
            return b"".join(map(self.__getitem__, WORDS.findall(text.lower())))
        return b"".join(map(self.stretch, text.replace("\n", " ").split(" ")))

    def stretch(self, stretch: str) -> bytes:
        """Ids of what stands between blanks and newlines, over which nothing reaches."""
        if plain(stretch):
            return b"".join(map(self.__getitem__, WORDS.findall(stretch.lower())))
        found = self.others.get(stretch)
        if found is None:
            found = self.whole(stretch)
            if len(stretch) <= 100:
                if len(self.others) >= REMEMBERED:
                    self.others.clear()
                self.others[stretch] = found
        return found


@lru_cache(maxsize=1)
def known_words(path: str) -> WordIds:
    """One for each Python worker, which serves many tasks."""
    return WordIds(path)


PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(text: Column, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> Column:
    """Array of a text's pieces: ids and one end id 0, cut every ``capacity``."""
    made = f"array<struct<{PIECE.replace(' ', ': ')}{', ids: binary' if with_ids else ''}>>".replace(",:", ",")
    kind = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    @F.arrow_udf(made)
    def of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, width = known_words(tokenizer_path), 4 * capacity
        for part in batches(column):
            rows = []
            for text_ in part:
                data = known.ids(text_) + bytes(4)
                cut = [data[at : at + width] for at in range(0, len(data), width)]
                rows.append([(k, k * capacity, len(c) // 4, zlib.crc32(c), *([c] if with_ids else [])) for k, c in enumerate(cut)])
            flat = list(zip(*(p for row in rows for p in row), strict=True)) or [[] for _ in kind]
            values = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat, kind, strict=True)], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)

    return of.asNondeterministic()(text)


SWEPT = "part int, at bigint, s bigint, low bigint, sum bigint, open boolean, size bigint, id bigint"


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition, in order: for each row its place, the depth before it, the least depth so far, and the sizes before it."""
    part, at, s, low, sizes = TaskContext.get().partitionId(), 0, 0, 0, 0
    for rows in parts:
        n, opens, size = rows.num_rows, rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy()
        if not n:
            continue
        depth = s + np.cumsum(np.where(opens, 1, -1))
        before = np.r_[s, depth[:-1]]
        least = np.minimum(np.minimum.accumulate(before), low)
        total = sizes + np.cumsum(size) - size
        made = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(before), pa.array(least), pa.array(total)]
        yield pa.RecordBatch.from_arrays([*made, *rows.columns], [f.split()[0] for f in SWEPT.split(", ")])
        at, s, low, sizes = at + n, int(depth[-1]), min(int(least[-1]), int(depth[-1])), int(total[-1] + size[-1])


def _swept(rows: DataFrame, few: bool) -> DataFrame:
    """``rows(open, size, id)`` from the largest on, gaps before pieces, with what ``_scan`` gives over the whole table.

    Rows are dealt by ranges of their order, in which the hash of the id splits
    a size that many share; each partition is scanned on its own, and then
    shifted by the sums of those before it, of which there is one row each. At
    most FEW rows are one range, which needs no shift.
    """
    order = [F.col("size").desc(), F.col("open").desc(), F.xxhash64("id"), F.col("id")]
    rows = rows.select("open", "size", "id")
    if few:
        return rows.repartition(1).sortWithinPartitions(*order).mapInArrow(_scan, SWEPT)
    local = shared_checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan, SWEPT))
    step = F.when(F.col("open"), 1).otherwise(-1)
    each = local.groupBy("part").agg(F.sum(step).alias("step"), F.min(F.least("low", F.col("s") + step)).alias("least"), F.sum("size").alias("sizes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("part", "least", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("step", "sizes")))
    each = each.select("part", "step_before", "sizes_before", F.coalesce(F.least(F.min(F.col("least") + F.col("step_before")).over(before), F.lit(0)), F.lit(0)).alias("least_before"))
    met = local.join(F.broadcast(each), "part")  # a row for each partition of the shuffle
    depth = F.col("s") + F.col("step_before")
    return met.select("part", "at", depth.alias("s"), F.least(F.col("low") + F.col("step_before"), "least_before").alias("low"), (F.col("sum") + F.col("sizes_before")).alias("sum"), "open", "size", "id")


def _noted(df: DataFrame, **of: Column) -> tuple[DataFrame, dict]:
    """A checkpoint of ``df``, and numbers about its rows that the same job gives."""
    seen = Observation()
    kept = shared_checkpoint(df.observe(seen, *(c.alias(k) for k, c in of.items())))
    return kept, seen.get


def _matched(pieces: DataFrame, gaps: DataFrame, longest: int, few: bool = False) -> DataFrame:
    """``(id, size, sequence, rank)``: the pieces, each with the gap that it takes, or null and how many before it took none.

    A gap that holds several of the longest pieces offers a part to each. Of
    one depth, gaps and pieces take turns; at one size all gaps come before all
    pieces, so a depth has at most twice as many rows as there are sizes.
    """
    many = F.greatest(F.floor(F.col("gap") / longest), F.lit(1)).cast("int")
    offers = gaps.select(F.lit(True).alias("open"), F.floor(F.col("gap") / many).alias("size"), F.explode(F.array_repeat("sequence", many)).alias("id"))
    rows = _swept(offers.unionByName(pieces.select(F.lit(False).alias("open"), "size", "id")), few)
    lone = ~F.col("open") & (F.col("s") <= F.col("low"))
    level = rows.select("part", "at", "open", "size", "id", F.when(F.col("open"), F.col("s") + 1).otherwise(F.col("s")).alias("level"), lone.alias("lone"), (-F.col("low")).alias("rank"))
    # A piece that takes none stands alone at the start of its depth, and before no piece of it.
    last = F.lag(F.col("id")).over(Window.partitionBy("level").orderBy("part", "at"))
    return level.withColumn("sequence", F.when(~F.col("lone"), last)).filter(~F.col("open")).select("id", "size", "sequence", "rank")


def _opened(pieces: DataFrame, longest: int, capacity: int, few: bool) -> DataFrame:
    """``(id, size, sequence)``: runs of pieces from the longest on, each run in a sequence of its own.

    Long pieces go as many to a sequence as fit of their length; of short ones
    a run ends where one more of the longest might not fit. A sequence has the
    id of one of its pieces.
    """
    long = 8 * longest > capacity
    if not long or "rank" not in pieces.columns:
        pieces = _swept(pieces.select(F.lit(False).alias("open"), "size", "id"), few).withColumn("rank", -F.col("s"))
    if long:
        rows = pieces.withColumn("fit", F.floor(F.lit(capacity) / F.col("size")))
        first = rows.groupBy("fit").agg(F.min("rank").alias("first"))  # a row for each count that fits, and these are at most twelve
        run = F.struct("fit", F.floor((F.col("rank") - F.col("first")) / F.col("fit")).alias("run"))
        rows = rows.join(F.broadcast(first), "fit")
    else:
        rows, run = pieces, F.floor(F.col("sum") / (capacity - longest + 1))
    return rows.select("id", "size", F.min("id").over(Window.partitionBy(run)).alias("sequence"))


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(id, size, sequence)`` of ``pieces(id, size)``, whose ids are unique and sizes 1 to ``capacity``, in rounds of best fit."""
    made: list[DataFrame] = []
    edges = sorted({0, *(capacity // b for b in BANDS)}, reverse=True)
    band = reduce(lambda c, low: F.when(F.col("size") > low, low).otherwise(c), reversed(edges), F.lit(0))
    # Two numbers for each band, whatever the corpus.
    held = {r["band"]: (r["many"], r["longest"]) for r in pieces.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("many"), F.max("size").alias("longest")).collect()}
    sequences = filled = 0
    none = F.col("sequence").isNull()
    for high, low in zip(edges, edges[1:], strict=False):
        left = pieces.filter(F.col("size").between(low + 1, high))
        many, longest = held.get(low, (0, 0))
        # Where the gaps that half a sequence leaves hold no two pieces of the band, another round finds nothing.
        rounds = ROUNDS if 2 * (low + 1) <= capacity // 2 else 1
        for turn in range(rounds + 1):
            if not many:
                break
            if turn == rounds or not made:
                rows, kept = _opened(left, longest, capacity, many <= FEW), ["id", "size", "sequence"]
            else:
                # Gaps are updated by what has been placed since: a sum over the tables of the rounds.
                gaps = reduce(DataFrame.unionByName, made).groupBy("sequence").agg((capacity - F.sum("size")).alias("gap")).filter(F.col("gap") > low)
                # A gap offers no more parts than the longest of the pieces fits into it.
                few = many + sequences + (sequences * capacity - filled) // longest <= FEW
                rows, kept = _matched(left, gaps, longest, few), ["id", "size", "sequence", "rank"]
            # A sequence has the id of the piece that opened it.
            counts = {"many": F.count_if(none), "longest": F.max(F.when(none, F.col("size"))), "opened": F.count_if(F.col("id") == F.col("sequence")), "filled": F.sum(F.when(~none, F.col("size")))}
            rows, seen = _noted(rows.select(*kept), **counts)
            made.append(rows.filter(~none).select("id", "size", "sequence"))
            left, many, longest = rows.filter(none).drop("sequence"), seen["many"], seen["longest"]
            sequences, filled = sequences + seen["opened"], filled + (seen["filled"] or 0)
    return reduce(DataFrame.unionByName, made) if made else pieces.select("id", "size", F.col("id").alias("sequence")).limit(0)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece of the end id alone. Only documents
    longer than ``capacity`` are cut. Repeated rows are packed each on its own;
    ids of any type, nulls among them, stay as they are. An empty table gives
    an empty table. Other columns, whatever their names, are not read.
    ``with_ids`` adds the ids of each piece as little-endian unsigned 32-bit
    integers. Full pieces are sequences by themselves and take no part in the
    rounds.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), pieces_of(F.col(text_col), tokenizer_path, capacity, with_ids).alias("cut"))
    pieces = shared_checkpoint(cut.select("doc_id", F.inline("cut")).withColumn("id", F.monotonically_increasing_id()))
    short = pieces.filter(F.col("length") < capacity)
    rows = placed(short.select("id", F.col("length").alias("size")), capacity)
    # A sequence holds at most as many pieces as its capacity has tokens.
    inside = Window.partitionBy("sequence").orderBy(F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("id", F.col("sequence").alias("sequence_id"), F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("bigint").alias("offset"))
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("id"), "offset": F.lit(0).cast("bigint")})
    every = full.unionByName(short.join(rows, "id"))
    return every.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
