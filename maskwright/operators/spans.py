"""Spans in text columns: finding them, settling overlaps, writing replacements back.

A span is ``STRUCT<start, end, text, label, recognizer, score, priority, ord>``,
half-open and in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import arrays

SPAN = "struct<start: int, end: int, text: string, label: string, recognizer: string, score: double, priority: int, ord: bigint>"
REPLACEMENT = "struct<start: int, end: int, text: string, label: string>"


def empty(kind: str = SPAN) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def find(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, text)`` of all leftmost matches; null in a null text.

    No sentinel is put into the text, and code points are counted as Spark
    counts them.
    """
    return arrays.matches(text, pattern)


#: In the order in which candidates win: priority, score, length, place, order of finding.
_RANKED = "array_sort(transform(run, s -> named_struct('k1', -s.priority, 'k2', -s.score, 'k3', s.start - s.end, 'start', s.start, 'k5', s.ord, 'end', s.end, 's', s)))"
_FREE = "exists(kept, o -> o.start < x.s.end and x.s.start < o.end)"
_WON = f"if(size(run) = 1, run, aggregate({_RANKED}, slice(run, 1, 0), (kept, x) -> if({_FREE}, kept, concat(kept, array(x.s)))))"


def resolve(spans: Column) -> Column:
    """The spans that win: by priority, score, length, place and order of finding, each beats all that it overlaps.

    Greedy and sequential, as a candidate that only a beaten one overlaps
    stays. Spans of different runs of overlapping ones never meet, so the fold
    is over one run at a time: the work grows with the spans, and with the
    square of the longest run.
    """
    won = arrays.applied(f"flatten(transform(a.runs, run -> {_WON}))", runs=arrays.overlapping(F.array_sort(spans)))
    return F.array_sort(F.coalesce(won, empty()))


def resolve_replacements(replacements: Column, length: Column) -> Column:
    """Replacements that land: clamped to the text, not empty, by start then longest first, none reaching into one before."""
    bound = lambda x: f"greatest(0, least({x}, a.size))"
    clamped = f"transform(a.rs, r -> named_struct('start', {bound('r.start')}, 'end', {bound('r.end')}, 'text', r.text, 'label', r.label))"
    ordered = f"array_sort(transform(filter({clamped}, r -> r.end > r.start), r -> named_struct('a', r.start, 'b', -r.end, 'r', r)))"
    lands = lambda s, y: f"{y}.a >= {s}"
    landed = arrays.gathered(ordered, "0", lambda s, y: f"if({lands(s, y)}, {y}.r.end, {s})", lambda s, y: f"{y}.r", f"cast(array() as array<{REPLACEMENT}>)", lands)
    return F.coalesce(arrays.applied(landed, rs=replacements, size=length), empty(REPLACEMENT))


def splice(text: Column, replacements: Column) -> Column:
    """The text with landed replacements (in order, disjoint) written in."""
    return arrays.spliced(text, replacements, lambda r: r["text"])


def _counts(marks: str, others: str) -> str:
    """SQL of how many of ``others`` come before each of ``marks``, both arrays of ``(at, kind, i, one)``; marks have ``one = 0`` and their number in ``i``."""
    before = arrays.gathered(f"array_sort(concat({marks}, {others}))", "0", lambda s, y: f"{s} + {y}.one", lambda s, y: f"named_struct('i', {y}.i, 'n', {s})", "cast(array() as array<struct<i: int, n: int>>)")
    return f"transform(filter({before}, c -> c.i >= 0), c -> c.n)"


def splice_runs(runs: Column, replacements: Column) -> Column:
    """The same over an array of runs: new text goes to the first run that a replacement touches, later ones keep their tails.

    The replacements that touch a run are one slice of them: from the first
    that ends after the run begins to the last that starts before it ends. Both
    places are running counts over runs and replacements in one order.
    """
    mark = lambda at, kind: f"named_struct('at', {at}, 'kind', {kind}, 'i', i, 'one', 0)"
    other = lambda at, kind: f"transform(a.rs, r -> named_struct('at', r.{at}, 'kind', {kind}, 'i', -1, 'one', 1))"
    lows = arrays.applied(arrays.gathered("transform(a.runs, r -> length(r))", "0", lambda s, y: f"{s} + {y}", lambda s, y: s, "cast(array() as array<int>)"), runs=runs)
    first = _counts(f"transform(a.lows, (l, i) -> {mark('l', 1)})", other("end", 0))
    last = _counts(f"transform(a.lows, (l, i) -> {mark('l + length(a.runs[i])', 0)})", other("start", 1))
    placed = arrays.applied(f"named_struct('runs', a.runs, 'rs', a.rs, 'lows', a.lows, 'first', {first}, 'last', {last})", runs=runs, rs=replacements, lows=lows)
    before, until = "concat(array(x.low), transform(x.mine, r -> least(r.end, x.high)))", "concat(transform(x.mine, r -> greatest(r.start, x.low)), array(x.high))"
    news = "concat(transform(x.mine, r -> if(r.start >= x.low, r.text, '')), array(''))"
    kept = f"zip_with({before}, {until}, (f, t) -> {arrays.cut_sql('x.parts', 'f - x.low', 't - x.low')})"
    mine = "slice(a.p.rs, a.p.first[i] + 1, a.p.last[i] - a.p.first[i])"
    run = f"named_struct('low', a.p.lows[i], 'high', a.p.lows[i] + length(r), 'parts', regexp_extract_all(r, r'(?s).{{1,{arrays.STRETCH}}}', 0), 'mine', {mine})"
    return arrays.applied(f"transform(a.p.runs, (r, i) -> transform(array({run}), x -> array_join(zip_with({kept}, {news}, (k, n) -> concat(k, n)), ''))[0])", p=placed)
