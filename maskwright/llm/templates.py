"""A small template language for conversations, compiled to Python closures.

``{{ expression }}`` writes, ``{% if %} {% elif %} {% else %} {% endif %}``
choose, ``{% set name = expression %}`` binds, ``{% for turn in turns %} ...
{% endfor %}`` walks the turns, ``{% generation %} ... {% endgeneration %}``
marks what a model is to learn, ``{# #}`` is a comment; a minus sign at a tag's
inner edge takes the white space beside it. Expressions have strings, whole
numbers, true, false, none, names, fields of ``turn`` and ``loop``, filters
behind ``|``, ``~`` (joins texts), ``+ - * %``, comparisons, ``in``, ``not``,
``and``, ``or`` and a conditional ``a if b else c``.

The language is a sandbox: names are those of the template, fields are looked
up in dictionaries and never in Python objects, filters are a fixed set, and
there is no call, no import and no loop but that over the turns. That loop
stands once, at the top, so a conversation can be rendered piece by piece.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

TAG = re.compile(r"\{\{-?|\{%-?|\{#-?")
CLOSE = {"{{": "}}", "{%": "%}", "{#": "#}"}
TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>|~+*%().,-]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
WORDS = {"true": True, "false": False, "none": None}
RESERVED = {*WORDS, "and", "or", "not", "in", "if", "else"}
BINARY = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "+": operator.add, "-": operator.sub, "*": operator.mul, "%": operator.mod, "~": lambda a, b: written(a) + written(b), "in": lambda a, b: a in b}
#: Nested expressions and blocks at most, and the longest text that an expression may make beside the ones it is given.
DEPTH, LONGEST = 50, 1 << 20


class TemplateError(ValueError):
    """A template that does not parse, or that asks for what the sandbox does not give."""


def written(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


# The syntax tree.
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Filter:
    of: object
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    sign: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    sign: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Choice:
    test: object
    then: object
    other: object


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Write:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # of (test, body)


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    """A parser of one expression by precedence."""

    LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "%"))

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in words

    def take(self, *words: str) -> str | None:
        if not self.peek(*words):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"{word!r} is missing")

    def name(self) -> str:
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name" or word in RESERVED:
            raise TemplateError(f"a name is missing before {word!r}")
        self.at += 1
        return word

    def whole(self) -> object:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is out of place")
        return tree

    def choice(self) -> object:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        tree = self.logic("or")
        if self.take("if"):
            test = self.logic("or")
            self.need("else")
            tree = Choice(test, tree, self.choice())
        self.depth -= 1
        return tree

    def logic(self, sign: str) -> object:
        below = (lambda: self.logic("and")) if sign == "or" else self.negated
        tree = below()
        while self.take(sign):
            tree = Logic(sign, tree, below())
        return tree

    def negated(self) -> object:
        turned = 0
        while self.take("not"):
            turned += 1
        tree = self.binary(0)
        return tree if not turned else Not(tree) if turned % 2 else Not(Not(tree))

    def binary(self, level: int) -> object:
        if level == len(self.LEVELS):
            return self.filtered()
        tree = self.binary(level + 1)
        while True:
            if "not in" in self.LEVELS[level] and self.peek("not"):
                self.at += 1
                self.need("in")
                tree = Not(Binary("in", tree, self.binary(level + 1)))
            elif sign := self.take(*self.LEVELS[level]):
                tree = Binary(sign, tree, self.binary(level + 1))
            else:
                return tree

    def filtered(self) -> object:
        tree = self.atom()
        while True:
            if self.take("."):
                tree = Field(tree, self.name())
            elif self.take("|"):
                name, args = self.name(), []
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.choice())
                        if not self.peek(")"):
                            self.need(",")
                tree = Filter(tree, name, tuple(args))
            else:
                return tree

    def atom(self) -> object:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "text":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), word[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return Const(int(word))
        if kind == "name" and word in WORDS:
            self.at += 1
            return Const(WORDS[word])
        return Name(self.name())


def _pieces(source: str) -> Iterable[tuple[str, str]]:
    """``("text", ...)``, ``("{{", inside)`` and ``("{%", inside)`` in order, white space at minus signs taken."""
    at, strip = 0, False
    while True:
        m = TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not m:
            return
        kind = m[0][:2]
        # A quoted closing sign does not end a tag.
        end = re.compile(r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|(?!%s).)*?(-?)%s" % ((re.escape(CLOSE[kind]),) * 2) if kind != "{#" else r".*?(-?)#\}", re.S).match(source, m.end())
        if not end:
            raise TemplateError(f"{m[0]!r} is not closed")
        if kind != "{#":
            yield kind, source[m.end() : end.start(1)]
        at, strip = end.end(), bool(end[1])


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    tags = list(_pieces(source))
    at = 0

    def body(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        nonlocal at
        if depth > DEPTH:
            raise TemplateError("nested too deeply")
        nodes = []
        while at < len(tags):
            kind, inside = tags[at]
            at += 1
            if kind == "text":
                nodes.append(Text(inside))
            elif kind == "{{":
                nodes.append(Write(_Expression(inside).whole()))
            else:
                word, _, rest = inside.strip().partition(" ")
                if word in ends:
                    return tuple(nodes), f"{word} {rest}".strip()
                nodes.append(block(word, rest.strip(), depth))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), ""

    def block(word: str, rest: str, depth: int) -> object:
        if word == "if":
            branches, test = [], _Expression(rest).whole()
            while True:
                inside, end = body(("elif", "else", "endif"), depth + 1)
                branches.append((test, inside))
                if end == "endif":
                    return If(tuple(branches))
                if end == "else":
                    inside, _ = body(("endif",), depth + 1)
                    return If((*branches, (Const(True), inside)))
                test = _Expression(end.removeprefix("elif")).whole()
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+turns", rest)
            if not m or depth:
                raise TemplateError("the one loop is over turns, at the top")
            return For(m[1], body(("endfor",), depth + 1)[0])
        if word == "generation" and not rest:
            return Generation(body(("endgeneration",), depth + 1)[0])
        if word == "set":
            name, equals, value = rest.partition("=")
            if not equals or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()) or name.strip() in RESERVED:
                raise TemplateError(f"cannot set {rest!r}")
            return Set(name.strip(), _Expression(value).whole())
        raise TemplateError(f"{word!r} is no tag, or out of place")

    return body((), 0)[0]


FILTERS: dict[str, Callable] = {
    "trim": lambda v: written(v).strip(),
    "upper": lambda v: written(v).upper(),
    "lower": lambda v: written(v).lower(),
    "length": lambda v: len(written(v)),
    "default": lambda v, other="": other if v is None else v,
    "replace": lambda v, old, new: written(v).replace(written(old), written(new)),
}


def folded(tree: object, filters: dict[str, Callable]) -> object:
    """The tree with constant parts computed; branches that cannot be taken go, neighbouring texts become one."""

    def whole(nodes: tuple) -> tuple:
        out: list = []
        for node in nodes:
            node = folded(node, filters)
            if isinstance(node, Write) and isinstance(node.value, Const):
                node = Text(written(node.value.value))
            for part in node if isinstance(node, tuple) else (node,):
                if isinstance(part, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + part.value)
                elif not isinstance(part, Text) or part.value:
                    out.append(part)
        return tuple(out)

    def known(f: Callable, *args: object) -> object:
        try:
            value = f(*(a.value for a in args))
        except (TypeError, ZeroDivisionError) as wrong:
            raise TemplateError(str(wrong)) from wrong
        if isinstance(value, str) and len(value) > LONGEST:
            raise TemplateError("a constant grows too long")
        return Const(value)

    match tree:
        case tuple():
            return whole(tree)
        case Write(value):
            return Write(folded(value, filters))
        case Set(name, value):
            return Set(name, folded(value, filters))
        case For(name, body):
            return For(name, whole(body))
        case Generation(body):
            return Generation(whole(body))
        case If(branches):
            left = []
            for test, body in branches:
                test = folded(test, filters)
                if isinstance(test, Const) and not test.value:
                    continue
                left.append((test, whole(body)))
                if isinstance(test, Const):
                    break
            return () if not left else left[0][1] if isinstance(left[0][0], Const) else If(tuple(left))
        case Field(of, name):
            return Field(folded(of, filters), name)
        case Filter(of, name, args):
            if name not in filters:
                raise TemplateError(f"no filter {name!r}")
            of, args = folded(of, filters), tuple(folded(a, filters) for a in args)
            return known(filters[name], of, *args) if all(isinstance(a, Const) for a in (of, *args)) else Filter(of, name, args)
        case Binary(sign, left, right):
            left, right = folded(left, filters), folded(right, filters)
            return known(BINARY[sign], left, right) if isinstance(left, Const) and isinstance(right, Const) else Binary(sign, left, right)
        case Logic(sign, left, right):
            left, right = folded(left, filters), folded(right, filters)
            if isinstance(left, Const):
                return right if bool(left.value) == (sign == "and") else left
            return Logic(sign, left, right)
        case Not(of):
            of = folded(of, filters)
            return Const(not of.value) if isinstance(of, Const) else Not(of)
        case Choice(test, then, other):
            test, then, other = folded(test, filters), folded(then, filters), folded(other, filters)
            return (then if test.value else other) if isinstance(test, Const) else Choice(test, then, other)
    return tree


Scope = dict[str, object]


class Output:
    """Text that grows, with the spans that generation blocks mark."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length, self.spans = 0, []

    def write(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.length += len(text)


def _value(tree: object, filters: dict[str, Callable]) -> Callable[[Scope], object]:
    match tree:
        case Const(value):
            return lambda scope: value
        case Name(name):
            def named(scope: Scope) -> object:
                if name not in scope:
                    raise TemplateError(f"no name {name!r}")
                return scope[name]
            return named
        case Field(of, name):
            inner = _value(of, filters)

            def field(scope: Scope) -> object:
                value = inner(scope)
                if not isinstance(value, dict) or name not in value:
                    raise TemplateError(f"no field {name!r}")
                return value[name]
            return field
        case Filter(of, name, args):
            inner, more, f = _value(of, filters), [_value(a, filters) for a in args], filters[name]
            return (lambda scope: f(inner(scope))) if not more else (lambda scope: f(inner(scope), *(a(scope) for a in more)))
        case Binary(sign, left, right):
            f, a, b = BINARY[sign], _value(left, filters), _value(right, filters)
            return lambda scope: f(a(scope), b(scope))
        case Logic(sign, left, right):
            a, b = _value(left, filters), _value(right, filters)
            return (lambda scope: a(scope) and b(scope)) if sign == "and" else (lambda scope: a(scope) or b(scope))
        case Not(of):
            inner = _value(of, filters)
            return lambda scope: not inner(scope)
        case Choice(test, then, other):
            t, a, b = _value(test, filters), _value(then, filters), _value(other, filters)
            return lambda scope: a(scope) if t(scope) else b(scope)
    raise TemplateError(f"no expression: {tree!r}")


Step = Callable[[Scope, Output], None]


def _steps(nodes: tuple, filters: dict[str, Callable]) -> Step:
    steps = [_step(n, filters) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: Scope, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: object, filters: dict[str, Callable]) -> Step:
    match node:
        case Text(text):
            return lambda scope, out: out.write(text)
        case Write(tree):
            value = _value(tree, filters)
            return lambda scope, out: out.write(written(value(scope)))
        case Set(name, tree):
            bound = _value(tree, filters)
            return lambda scope, out: scope.__setitem__(name, bound(scope))
        case If(branches):
            made = [(_value(t, filters), _steps(b, filters)) for t, b in branches]

            def choose(scope: Scope, out: Output) -> None:
                for test, body in made:
                    if test(scope):
                        return body(scope, out)
            return choose
        case Generation(body):
            inside = _steps(body, filters)

            def marked(scope: Scope, out: Output) -> None:
                begin = out.length
                inside(scope, out)
                out.spans.append((begin, out.length))
            return marked
    raise TemplateError(f"no step: {node!r}")


@dataclass(frozen=True)
class Template:
    """Closures of what stands before the loop, of one turn, and of what stands after it."""

    before: Step
    turn: Step
    after: Step
    name: str

    def render(self, turns: Iterable[dict], index: int = 0, first: bool = True, last: bool = True, previous: str | None = None, following: str | None = None, scope: Scope | None = None) -> tuple[str, list[tuple[int, int]]]:
        """The text of turns and its marked spans, in code points.

        A piece of a conversation has the ``index`` of its first turn, whether
        it is the ``first`` or ``last`` piece, and the roles on either side.
        ``scope`` gives further names. In the loop, ``loop`` has index (from 0),
        first, last, previous and following, the last two being roles. What
        ``set`` binds in the loop lasts for its turn.
        """
        out, outer = Output(), dict(scope or {})
        if first:
            self.before(outer, out)
        listed = list(turns)
        for k, turn in enumerate(listed):
            loop = {
                "index": index + k, "first": first and k == 0, "last": last and k + 1 == len(listed),
                "previous": listed[k - 1]["role"] if k else previous, "following": listed[k + 1]["role"] if k + 1 < len(listed) else following,
            }
            self.turn({**outer, self.name: turn, "loop": loop}, out)
        if last:
            self.after(outer, out)
        return "".join(out.parts), out.spans


def compiled(source: str, filters: dict[str, Callable] | None = None) -> Template:
    """A template from its source. ``filters`` adds to FILTERS. What is set before the loop holds for a whole conversation only if it is constant."""
    every = FILTERS | (filters or {})
    tree = folded(parse(source), every)
    loops = [k for k, n in enumerate(tree) if isinstance(n, For)]
    if len(loops) > 1:
        raise TemplateError("one loop over turns at most")
    at = loops[0] if loops else len(tree)
    loop = tree[at] if loops else For("turn", ())
    if any(isinstance(n, Set) for n in tree):
        raise TemplateError("set stands inside the loop")
    return Template(_steps(tree[:at], every), _steps(loop.body, every), _steps(tree[at + 1 :], every), loop.name)
