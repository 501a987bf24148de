"""Array expressions whose work grows with the array, not with its square.

The folds are SQL lambdas: a plan with many of them is built in a fraction of
the time that it takes to build each node from Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a slice of an array; code points of a chunk of a text.
SLICE, STRETCH = 64, 4096
#: The last character of a text that is no white space, as SQL of a text.
LAST = r"substring(regexp_replace({0}, r'(?U)(?<!\s)\s++$', ''), -1, 1)"

Sql = Callable[[str, str], str]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body and lambdas in it name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def applied(body: str, **args: Column) -> Column:
    """The SQL ``body`` over columns, which it names ``a.<name>`` and which are computed once."""
    given = F.struct(*(c.alias(n) for n, c in args.items()))
    return F.call_function("transform", F.array(given), F.expr(f"a -> {body}"))[0]


def gathered(xs: str, zero: str, step: Sql, make: Sql, none: str, keep: Sql | None = None) -> str:
    """SQL of a fold that gathers ``make(state, x)`` of each element for which ``keep(state, x)`` holds, with the state before it.

    The state is one scalar. A fold copies its accumulator, arrays in it
    included, at each step, so no array may grow in it with the elements. A
    first fold, with the state alone in the inner accumulator, walks the slices
    and leaves the state before each (a few numbers, copied once in SLICE
    steps); then each slice is gathered from its own state. ``none`` is an
    empty array of what is made; the result of a null array is null.
    """
    sliced = f"case when v is null then null when size(v) = 0 then slice(array(v), 1, 0) else transform(sequence(0, cast((size(v) - 1) div {SLICE} as int)), k -> slice(v, k * {SLICE} + 1, {SLICE})) end"
    states = f"aggregate(ps, named_struct('s', {zero}, 'made', slice(array({zero}), 1, 0)), (b, p) -> named_struct('s', aggregate(p, b.s, (s, y) -> {step('s', 'y')}), 'made', concat(b.made, array(b.s))), b -> b.made)"
    one = f"concat(b.made, array({make('b.s', 'y')}))"
    grown = f"if({keep('b.s', 'y')}, {one}, b.made)" if keep else one
    small = f"aggregate(p, named_struct('s', at, 'made', {none}), (b, y) -> named_struct('s', {step('b.s', 'y')}, 'made', {grown}), b -> b.made)"
    return f"transform(array({xs}), v -> transform(array({sliced}), ps -> flatten(zip_with(ps, {states}, (p, at) -> {small})))[0])[0]"


def _running(xs: str, zero: str, combine: str) -> str:
    return gathered(xs, zero, lambda s, y: f"{combine}({s}, {y})", lambda s, y: s, f"slice(array({zero}), 1, 0)")


def running(values: Column, zero: int, combine: str) -> Column:
    """For each whole number the fold of those before it under a SQL function of two, such as ``greatest``."""
    return applied(_running("a.xs", str(zero), combine), xs=values)


def matches(text: Column, pattern: str | Column, value: str = "text", before: str | None = None) -> Column:
    """Array of ``(start, end, value)`` of all leftmost matches, in code points; null in a null text.

    The matches and the pieces between them come from the same pattern, so
    that running sums of their lengths are the offsets. ``before`` names a
    further field: the last character before a match that is no white space,
    empty if there is none. It is looked for in the piece before the match and
    then in the match before it.
    """
    extra = f", '{before}', y.seen" if before else ""
    # Paired before the fold: what stands inside a lambda is computed anew for each element.
    seen = f", 'seen', {LAST.format('b')}" if before else ""
    pairs = f"zip_with(split(a.t, a.p, -1), a.hits, (b, h) -> named_struct('gap', length(b), 'n', length(h), 'v', h{seen}))"
    if before:
        ends = f"concat(array(''), transform(a.hits, h -> {LAST.format('h')}))"
        pairs = f"zip_with({pairs}, {ends}, (y, e) -> named_struct('gap', y.gap, 'n', y.n, 'v', y.v, 'seen', if(y.seen = '', e, y.seen)))"
    make = lambda s, y: f"named_struct('start', {s} + {y}.gap, 'end', {s} + {y}.gap + {y}.n, '{value}', {y}.v{extra})"
    kind = f"array<struct<start: int, end: int, {value}: string{f', {before}: string' if before else ''}>>"
    found = gathered(f"filter({pairs}, y -> y.v is not null)", "0", lambda s, y: f"{s} + {y}.gap + {y}.n", make, f"cast(array() as {kind})")
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return applied(found, t=text, p=pattern, hits=F.regexp_extract_all(text, pattern, F.lit(0)))


def stretches(text: Column) -> Column:
    """The text in stretches of STRETCH code points, for ``cut``: a substring of a whole text walks to its place."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def cut_sql(parts: str, low: str, high: str) -> str:
    begin = f"greatest({low} - k * {STRETCH}, 0)"
    inside = f"substring(get({parts}, k), {begin} + 1, least({high} - k * {STRETCH}, {STRETCH}) - {begin})"
    within = f"sequence(cast({low} div {STRETCH} as int), cast(({high} - 1) div {STRETCH} as int))"
    return f"if({high} > {low}, array_join(transform({within}, k -> {inside}), ''), '')"


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` out of its stretches, which should be a value of ``let``."""
    return applied(cut_sql("a.parts", "a.low", "a.high"), parts=parts, low=start, high=end)


def spliced(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """The text with ``new`` of each span (by start, disjoint) in its place, as one join of pieces."""
    before, until = "concat(array(0), transform(a.spans, s -> s.end))", "concat(transform(a.spans, s -> s.start), array(length(a.t)))"
    kept = f"zip_with({before}, {until}, (low, high) -> {cut_sql('a.parts', 'low', 'high')})"
    joined = applied(f"array_join(zip_with({kept}, concat(a.news, array('')), (k, n) -> concat(k, n)), '')", t=text, parts=stretches(text), spans=spans, news=F.transform(spans, new))
    return F.when(F.size(spans) == 0, text).otherwise(joined)


def overlapping(by_start: Column) -> Column:
    """The runs of spans, given by start, that overlap one another directly or over others.

    A span opens a run where it starts at or after the furthest end before it:
    a running maximum gives the places where runs open, and each run is one
    slice.
    """
    furthest = _running("transform(a.found, s -> s.end)", "0", "greatest")
    opens = f"zip_with(a.found, {furthest}, (s, far) -> s.start >= far)"
    places = f"filter(transform({opens}, (o, k) -> if(o or k = 0, k, null)), k -> k is not null)"
    ends = "concat(slice(at, 2, size(at)), array(size(a.found)))"
    runs = f"transform(array({places}), at -> zip_with(at, {ends}, (low, high) -> slice(a.found, low + 1, high - low)))[0]"
    return applied(f"if(size(a.found) > 0, {runs}, slice(array(a.found), 1, 0))", found=by_start)
