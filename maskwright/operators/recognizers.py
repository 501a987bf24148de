"""Recognizers: what to look for, as data; how, as column expressions.

A recognizer is a pattern with a validator over columns. New ones are
registered without a change to the engine. A match that its validator rejects
is consumed all the same: it is not tried again at another length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import arrays, words
from maskwright.functions.checks import digits, luhn, octets
from maskwright.operators import spans

#: Room for the matches of one recognizer in the order of finding.
ORDER_STEP = 1_000_000

# The shapes that count, in Java's syntax; (?U) makes classes and word boundaries follow Unicode.
CREDIT_CARD = r"(?U)(?<![\d-])(?:\d[ -]?){12,18}\d(?!\d)"
SSN = r"(?U)\b(?!000|666|9\d{2})\d{3}([- ])(?!00)\d{2}\1(?!0000)\d{4}\b"
IP = r"(?U)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = r"(?U)(?<![\d.])(?:\+\s?\d{1,3}[\s./-]?(?:\(\d{1,5}\)|\d{1,5})(?:[\s./-]?\d{2,10}){1,3}|0\d{2,4}[\s./-]\d{6,8})(?!\d)"
POSTAL_CODE = r"(?U)(?<![\d,.])[1-9]\d{2}\s?\d{3}(?!\d)"
WEBSITE = r"(?U)(?i)(?:https?://|www\.)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*+(?:/[^\s,;)\]]*)?"
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE = rf"(?U)(?i)\b(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}|{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH},?\s+\d{{4}})"
BIRTH = r"(?U)(?i)(?:date\s+of\s+birth|\bd\.?o\.?b\b\.?|born(?:\s+on)?|birth\s*date)[^A-Za-z0-9]{0,12}$"
COMPANY = r"(?U)\b(?:(?:[A-Z][\w.'’-]*|&)[ \t]+){1,5}(?i:private[ \t]+)?(?i:limited|ltd\.?|llp|plc|inc\.?|corporation)\b"

Validator = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Recognizer:
    """``pattern`` finds; ``validate(text, span)`` keeps; ``adjust(text, span)`` may move the ends.

    ``context``, if there is one, must match in the ``window`` characters before
    a match. ``guard`` is a cheap test that any text with a match passes. A
    span that a validator gets has the last character before it that is no
    white space in ``before``, if ``looks_back`` asks for it. ``void`` names
    groups of the pattern that are empty in a match that is kept: a group that
    holds a neighbour rejects a match, which stays consumed, where a pattern
    that looks around would try another length or place.
    """

    name: str
    label: str
    priority: int
    pattern: str
    score: float = 1.0
    guard: str | None = None
    validate: Validator | None = None
    adjust: Validator | None = None
    context: str | None = None
    window: int = 50
    looks_back: bool = False
    void: tuple[int, ...] = ()

    def find(self, text: Column, position: int = 0) -> Column:
        """Array of spans of one recognizer."""
        found = F.when(text.rlike(self.guard or self.pattern), arrays.matches(text, self.pattern, before="before" if self.looks_back else None))
        order = arrays.applied("transform(a.found, (s, k) -> named_struct('start', s.start, 'end', s.end, 'text', s.text, 'n', k%s))" % (", 'before', s.before" if self.looks_back else ""), found=found)
        if self.void:
            groups = {f"g{g}": F.when(text.rlike(self.guard or self.pattern), F.regexp_extract_all(text, F.lit(self.pattern), F.lit(g))) for g in self.void}
            order = arrays.applied(f"filter(a.found, s -> {' and '.join(f"a.{g}[s.n] = ''" for g in groups)})", found=order, **groups)
        if self.context:
            unjudged = order
            order = F.when(F.size(unjudged) > 0, arrays.let(arrays.stretches(text), lambda parts: F.filter(unjudged, lambda s: self._cued(parts, s))))
        if self.validate:
            order = F.filter(order, lambda s: self.validate(text, s))
        if self.adjust:
            order = F.transform(order, lambda s: self.adjust(text, s))
        made = arrays.applied(
            "transform(a.found, s -> named_struct('start', s.start, 'end', s.end, 'text', s.text, 'label', a.label, 'recognizer', a.name, 'score', a.score, 'priority', a.priority, 'ord', a.first + s.n))",
            found=order, label=F.lit(self.label), name=F.lit(self.name), score=F.lit(float(self.score)), priority=F.lit(self.priority), first=F.lit(position * ORDER_STEP).cast("bigint"),
        )
        return F.coalesce(made, spans.empty())

    def _cued(self, parts: Column, s: Column) -> Column:
        # One more character on the left lets a word boundary at the window's edge see what stands there.
        low = F.greatest(s["start"] - self.window, F.lit(0))
        seen = F.greatest(low - 1, F.lit(0))
        before = arrays.cut(parts, seen, s["start"])
        # Two constant patterns, each compiled once.
        return F.when(low > 0, before.rlike(f"^(?s:.)(?s:.*?){self.context}")).otherwise(before.rlike(f"^(?s:.*?){self.context}"))


def _card(text: Column, s: Column) -> Column:
    d = digits(s["text"])
    marks = F.array_distinct(F.filter(F.split(F.regexp_replace(s["text"], r"(?U)\d", ""), ""), lambda m: m != ""))
    return (s["before"] != "+") & F.length(d).between(13, 19) & (F.size(marks) <= 1) & luhn(d)


def defaults(v: words.Vocabulary = words.DEFAULT) -> tuple[Recognizer, ...]:
    """The built-in recognizers over a vocabulary."""

    def company(text: Column, s: Column) -> Column:
        kept = words.listed((*v.geo_keep, "private", "limited", "ltd"))
        judged = lambda w: ~words.generic_only(w, v) & ~words.institutional(w, v) & ~words.placed(w, v) & (F.size(F.array_except(w, kept)) > 0)
        return F.exists(F.array(words.words_of(s["text"])), judged)  # the words are made once

    def without_lead(text: Column, s: Column) -> Column:
        # Lead words go while a space follows; what stands before a tab stays.
        lead = F.regexp_extract(s["text"], rf"^(?:(?i:{'|'.join(v.leads)}) +)+", 0)
        return F.struct((s["start"] + F.length(lead)).alias("start"), s["end"].alias("end"), F.substring(s["text"], F.length(lead) + 1, F.length(s["text"])).alias("text"), s["n"].alias("n"))

    city = "|".join(sorted(v.cities, key=lambda c: (-len(c), c)))
    return (
        Recognizer("city", "LOCATION", 60, rf"(?i)(?<![A-Za-z])(?:{city})(?![A-Za-z])"),
        Recognizer("company", "ORGANIZATION", 55, COMPANY, guard="(?i)limited|ltd|llp|plc|inc|corporation", validate=company, adjust=without_lead),
        Recognizer("credit_card", "CREDIT_CARD", 95, CREDIT_CARD, guard=r"(?U)(?:\d[ -]?){12}\d", validate=_card, looks_back=True),
        Recognizer("dob", "DATE_OF_BIRTH", 60, DATE, score=0.9, guard=r"(?i)birth|born|d\.?o\.?b", context=BIRTH),
        Recognizer("email", "EMAIL", 80, EMAIL, guard="@"),
        Recognizer("ip", "IP_ADDRESS", 85, IP, guard=r"(?U)\d\.\d{1,3}\.\d{1,3}\.\d", validate=lambda text, s: octets(s["text"])),
        Recognizer("phone", "PHONE", 70, PHONE, guard=r"(?U)[+0]\s?\d", validate=lambda text, s: F.length(digits(s["text"])).between(9, 15)),
        Recognizer("postal_code", "LOCATION", 65, POSTAL_CODE, guard=r"(?U)[1-9]\d{2}\s?\d{3}", validate=lambda text, s: F.arrays_overlap(words.words_of(text), words.listed(v.postal_cues))),
        Recognizer("ssn", "SSN", 90, SSN, guard=r"(?U)\d{3}[- ]\d{2}[- ]\d{4}"),
        Recognizer("website", "URL", 75, WEBSITE, guard=r"(?i)https?://|www\.", validate=lambda text, s: s["before"] != "@", looks_back=True),
    )


class Registry:
    """Recognizers by name; an engine is built from a selection of them."""

    def __init__(self, recognizers: Iterable[Recognizer] = ()) -> None:
        self._by_name: dict[str, Recognizer] = {}
        for r in recognizers:
            self.register(r)

    def register(self, recognizer: Recognizer) -> Recognizer:
        if not recognizer.name:
            raise ValueError("a recognizer needs a name")
        if recognizer.name in self._by_name:
            raise ValueError(f"a recognizer named {recognizer.name!r} is already registered")
        self._by_name[recognizer.name] = recognizer
        return recognizer

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def build(self, only: Iterable[str] | None = None, exclude: Iterable[str] = ()) -> list[Recognizer]:
        """Recognizers by name: those of ``only`` (all if it is empty) without ``exclude``; unknown names in ``only`` raise KeyError."""
        chosen = set(only or self._by_name)
        if unknown := chosen - self._by_name.keys():
            raise KeyError(f"unknown recognizers: {', '.join(sorted(unknown))}")
        return [self._by_name[n] for n in sorted(chosen - set(exclude))]


REGISTRY = Registry(defaults())


def register(recognizer: Recognizer) -> Recognizer:
    """Add a recognizer to those that engines are built from."""
    return REGISTRY.register(recognizer)


def with_priority(recognizer: Recognizer, priority: int) -> Recognizer:
    return replace(recognizer, priority=priority)


def candidates(text: Column, recognizers: Iterable[Recognizer]) -> Column:
    """All spans of all recognizers, in the order in which ties are settled."""
    found = [r.find(text, k) for k, r in enumerate(recognizers)]
    return F.when(text.isNull(), spans.empty()).otherwise(F.concat(*found)) if found else spans.empty()


def detect(text: Column, recognizers: Iterable[Recognizer], min_score: float = 0.0) -> Column:
    """The spans that win among those that reach the score; none in a null text."""
    return spans.resolve(F.filter(candidates(text, recognizers), lambda s: s["score"] >= min_score))
