"""Conversation structure repair: weighted CYK parsing of role sequences.

A repaired conversation reads ``(s?(ua)+)?`` in role initials. The repair
grammar is in Chomsky normal form: a nonterminal ``pq`` spans the rows that
take the reader of that language from state p to q, each rule is ``pq -> pr
rq``, and the terminals are the edits of one row. A span's cell has for each
nonterminal the least (cost, audit), closed under insertion; cells are combined
bottom-up by span length. As the language is regular, every split of a span
gives the same cell, so one split, in the middle, stands for all, and spans
double in length from level to level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from maskwright.llm import turns
from maskwright.llm.common import salted_join, shared_checkpoint

#: States: nothing read, a system row read, a user row read, an assistant row read.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What an inserted or changed row becomes, by the state before it.
TURN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What a row is for the grammar: it must go; its initial, in capitals if it is truncated; another initial is "x".
GONE = "-"
#: A row is blank without such a character; it is truncated if the last one is none of these.
SOLID, ENDS = r"[^\x20\x09-\x0D]", ".!?"

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, at: tuple[int, int], value: tuple[int, str]) -> None:
    if at not in cell or value < cell[at]:
        cell[at] = value


def joined(a: Cell, b: Cell) -> Cell:
    """The cell of two neighbouring spans by the rules ``pq -> pr rq``."""
    out: Cell = {}
    for (p, r), (cost, audit) in a.items():
        for q in range(4):
            if (more := b.get((r, q))) is not None:
                _least(out, (p, q), (cost + more[0], audit + more[1]))
    return out


def inserted() -> Cell:
    """The insertion closure: what inserted rows alone do, from no row to a whole round of the states."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    for p in range(4):
        at, n = p, 0
        while n < 3:
            at, n = STEPS[at, TURN[at][0]], n + 1
            _least(cell, (p, at), (INSERT * n, "I" * n))
    return cell


CLOSURE = inserted()


def terminal(kind: str) -> Cell:
    """The cell of one row, with insertions before it."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != GONE:
        more, initial = TRUNCATED * kind.isupper(), kind.lower()
        for p in range(4):
            if (p, initial) in STEPS:
                _least(cell, (p, STEPS[p, initial]), (KEEP + more, "K"))
            _least(cell, (p, STEPS[p, TURN[p][0]]), (REROLE + more, "R"))
    return joined(CLOSURE, cell)


@lru_cache(maxsize=1 << 15)
def _short(kinds: str) -> Cell:
    return _cell(kinds)


def _cell(kinds: str) -> Cell:
    if len(kinds) == 1:
        return terminal(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return joined(cell_of(kinds[:half]), cell_of(kinds[half:]))


def cell_of(kinds: str) -> Cell:
    """The cell of a span of one row or more; those of short spans are remembered."""
    return _short(kinds) if len(kinds) <= 8 else _cell(kinds)


def best(cell: Cell | None) -> tuple[int, str]:
    """The least (cost, audit) of a conversation with this cell, None for one without rows."""
    whole = joined(cell, CLOSURE) if cell else CLOSURE
    return min(whole[START, q] for q in ACCEPTED if (START, q) in whole)


def edited(rows: list[tuple[str, str, str]], letters: str, state: int = START) -> list[dict]:
    """Rows ``(role, text, kind)`` under the letters of an audit, from a state on."""
    out, left = [], iter(rows)
    for letter in letters:
        role, text, kind = ("", "", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        role = role if letter == "K" else TURN[state]
        out.append({"role": role, "text": text})
        state = STEPS[state, kind.lower() if letter == "K" else TURN[state][0]]
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` after the damage of the query: chosen by a checksum of ``conv_id:turn``.

    Nulls are one space. Of twenty, 0 drops the row (``gone``: it stays only
    to name its conversation), 1 empties the text, 2 takes its full stops, 3
    repeats the row, 4 makes it a user's.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20).alias("by"))
    text = F.when(F.col("by").isin(0, 1), "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("by") == 0, "").when(F.col("by") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", F.when(F.col("by") != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), (F.col("by") == 0).alias("gone"), "by")
    return rows.withColumn("again", F.explode(F.when(F.col("by") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("by", "again")


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``times``, ``fault`` of the first copy (blank, duplicate, truncated or none).

    Later copies of a row are duplicates, or blank. A text that its role said
    at an earlier turn of the conversation is found by the first turn of each
    (conversation, role, text), not by a window, which would put all its rows
    in one task.
    """
    rows = turns.counted(rows)
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    keyed = rows.withColumn("said", F.when(~F.col("gone"), F.sha2(said.cast("binary"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    firsts = keyed.filter("said is not null").groupBy("said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = salted_join(keyed, firsts, "said", F.col("turn"), "left")
    tail = F.regexp_extract("text", rf"({SOLID})[\x20\x09-\x0D]*+\z", 1)
    fault = F.when(~F.col("text").rlike(SOLID), "blank").when(place > F.col("first"), "duplicate").when(~F.contains(F.lit(ENDS), tail), "truncated").otherwise("none")
    return met.select("conv_id", "turn", "role", "text", "gone", "times", fault.alias("fault"))


def _expanded(piece: list[dict]) -> Iterator[tuple[str, str, str, str, object]]:
    """``(role, text, kind, fault, turn)`` of each row of a piece."""
    for row in piece:
        if row["gone"]:
            continue
        role, fault = row["role"], row["fault"]
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        kind = GONE if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial
        yield role, row["text"], kind, fault, row["turn"]
        for _ in range(row["times"] - 1):
            yield role, row["text"], GONE, "blank" if fault == "blank" else "duplicate", row["turn"]


NOTES = "low bigint, high bigint, n_turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, n bigint"
LEGAL = ("su", "ua", "au")


def _noted(rows: list[tuple]) -> dict:
    """Counts of a piece, with what its neighbours need of it."""
    places = [r[4] for r in rows if r[4] is not None]
    initials = [r[0][:1] for r in rows]
    faults = [r[3] for r in rows]
    return {
        "low": min(places, default=None), "high": max(places, default=None), "n_turns": len(set(places)), "n": len(rows),
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
    }


def _summed(notes: list[dict]) -> dict:
    """Counts of a conversation from those of its pieces, in order."""
    notes = [n for n in notes if n["n"]] or notes[:1]
    out = {k: sum(n[k] for n in notes) for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(notes, notes[1:]))
    dated = [n for n in notes if n["n_turns"]]
    distinct = sum(n["n_turns"] for n in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    return out | {"gaps": dated[-1]["high"] - dated[0]["low"] + 1 - distinct if dated else 0}


COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
TURNS = "array<struct<role: string, text: string>>"


def _alone(row: dict) -> dict:
    rows = list(_expanded(row["turns"]))
    cost, audit = best(cell_of("".join(r[2] for r in rows)) if rows else None)
    return {k: row[k] for k in ("conv_id", "part", "seq")} | _summed([_noted(rows)]) | {"cost": cost, "audit": audit, "turns": edited([r[:3] for r in rows], audit)}


def _facts(row: dict) -> dict:
    rows = list(_expanded(row["turns"]))
    cell = cell_of("".join(r[2] for r in rows)) if rows else {}
    values = [cell.get((p, q)) for p in range(4) for q in range(4)]
    return {k: row[k] for k in ("conv_id", "part", "seq")} | _noted(rows) | {"costs": [v and v[0] for v in values], "audits": [v and v[1] for v in values]}


def _merged(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Verdicts from the cells of pieces, combined by doubling spans, and the letters and the state for each piece."""
    for of, rows in turns.grouped(batches):
        notes = list(rows)
        cells = [{(k // 4, k % 4): (c, a) for k, (c, a) in enumerate(zip(n["costs"], n["audits"])) if c is not None} for n in notes]
        spans = [c for c in cells if c]
        while len(spans) > 1:
            spans = [joined(*pair) if len(pair) > 1 else pair[0] for pair in (spans[k : k + 2] for k in range(0, len(spans), 2))]
        cost, audit = best(spans[0] if spans else None)
        parts, at, state = [], 0, START
        for k, (note, cell) in enumerate(zip(notes, cells)):
            end, left = at, note["n"]
            while left:
                left -= audit[end] != "I"
                end += 1
            entered = state
            if cell:
                # From one state, the letters of a piece lead to one state only.
                state = next(q for q in range(4) if (entered, q) in cell and cell[entered, q][1] == audit[at:end])
            last = k + 1 == len(notes)
            parts.append({"part": note["part"], "seq": note["seq"], "state": entered, "letters": audit[at:] if last else audit[at:end]})
            at = end
        yield pa.RecordBatch.from_pylist([{"conv_id": of, **_summed(notes), "cost": cost, "audit": audit, "parts": parts}], schema=schema)


def _applied(row: dict) -> dict:
    rows = [r[:3] for r in _expanded(row["turns"])]
    return {k: row[k] for k in ("conv_id", "part", "seq")} | {"turns": edited(rows, row["letters"], row["state"])}


def _schemas(df: DataFrame, more: str) -> tuple[str, pa.Schema]:
    kind = df.schema["conv_id"].dataType
    text = f"conv_id {kind.simpleString()}, {more}"
    fields = df.sparkSession.createDataFrame([], text).schema
    return text, pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts of whole conversations, of those in pieces, and the repaired turns of the latter.

    ``rows`` is as ``judged`` makes it. The first has ``(conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, turns)``, one row for each
    conversation; the second the same without ``turns``, which are in the
    third, ``(conv_id, part, seq, turns)``, in the order of ``(part, seq)``.
    The audit of a conversation is one text and meets in one task, its rows
    don't.
    """
    alone, rest = turns.pieces(rows)
    key = "part int, seq int"
    text, arrow = _schemas(rows, f"{key}, {COUNTS}, turns {TURNS}")
    whole = alone.mapInArrow(turns.by_batch(_alone, arrow), text)
    text, arrow = _schemas(rows, f"{key}, {NOTES}, costs array<bigint>, audits array<string>")
    facts = rest.mapInArrow(turns.by_batch(_facts, arrow), text)
    text, arrow = _schemas(rows, f"{COUNTS}, parts array<struct<part: int, seq: int, state: int, letters: string>>")
    merged = shared_checkpoint(turns.in_order(facts).mapInArrow(partial(_merged, schema=arrow), text))
    letters = merged.select(F.inline("parts"))
    text, arrow = _schemas(rows, f"{key}, turns {TURNS}")
    parts = rest.join(letters, ["part", "seq"]).select("conv_id", "part", "seq", "turns", "state", "letters").mapInArrow(turns.by_batch(_applied, arrow), text)
    return whole.drop("part", "seq"), merged.drop("parts"), parts


def _lines(row: dict) -> list[str]:
    return [f"{t['role']}:{t['text']}" for t in row["turns"]]


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for of, rows in turns.grouped(batches):
        made, begun = hashlib.sha256(), False
        for row in rows:
            for line in _lines(row):
                made.update((b"\n" if begun else b"") + line.encode())
                begun = True
        yield pa.RecordBatch.from_pylist([{"hashed_id": of, "repaired_sha256": made.hexdigest()}], schema=schema)


def digested(whole: DataFrame, verdicts: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each conversation with ``repaired_sha256``, the hash of its turns ``role:text`` joined by newlines.

    Pieces are hashed one after the other as a stream, in the task of their conversation.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    done = whole.withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("turns")
    kind = parts.schema["conv_id"].dataType
    arrow = pa.schema([pa.field("hashed_id", to_arrow_type(kind)), pa.field("repaired_sha256", pa.string())])
    hashed = turns.in_order(parts).mapInArrow(partial(_hashed, schema=arrow), f"hashed_id {kind.simpleString()}, repaired_sha256 string")
    return done.unionByName(verdicts.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id"))).drop("hashed_id"))


def audited(conversations: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``(conv_id, turn, role, text)``: its faults, the cheapest repair and its hash.

    The rows are damaged first, as the query asks. Turns are in the order of
    ``turn`` (nulls first), then role, then text. Nulls in role or text are one
    space, a null id is one conversation, repeated rows are repeats of a turn,
    an empty role keeps no place in the language, an empty table gives an empty
    table and other columns are not read. Texts of any length travel whole.
    """
    return digested(*repaired(judged(damaged(conversations))))
