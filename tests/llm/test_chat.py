"""The template language, and conversations read back from what it wrote."""

import hashlib
import random

import pytest

from maskwright.llm import chat
from maskwright.llm.templates import Const, If, Template, TemplateError, Text, compiled, folded, parse, FILTERS

TURNS = [{"role": "system", "text": "S"}, {"role": "user", "text": "hi  "}, {"role": "assistant", "text": "yo"}]


def said(source, turns=TURNS, **place):
    return compiled(source).render(turns, **place)[0]


def test_language():
    assert said("a{# no #}b {{- 'c' }}{{ 1 + 2 * 3 }}") == "abc7"
    assert said("{% for t in turns %}{{ loop.index }}{{ t.role | upper }}:{{ t.text | trim }}{% if not loop.last %};{% endif %}{% endfor %}!") == "0SYSTEM:S;1USER:hi;2ASSISTANT:yo!"
    assert said("{% for t in turns -%} {% if t.role == 'user' %}U{% elif t.role in 'assistant' and true %}A{% else %}{{ loop.following | default('-') }}{% endif %}{%- endfor %}") == "userUA"
    assert said("{% for t in turns %}{% set n = t.text | length %}{{ n % 2 ~ '.' }}{{ 'x' if n > 1 else '' }}{% endfor %}") == "1.0.x0.x"
    assert said("{{ \"}} ' {%\" }}{{ 'a\\n\\'' }}{{ none }}{{ true }}{{ not not 1 }}{{ 'b' not in 'abc' }}") == "}} ' {%a\n'truetruefalse"
    assert said("{{ 'aXb' | replace('X', '--') | upper }}{{ (2 - 1) * 3 }}") == "A--B3"
    assert said("{% for t in turns %}{{ loop.previous }}>{{ loop.index }} {% endfor %}", TURNS[:1], index=7, previous="user") == "user>7 "
    assert compiled("x{% for t in turns %}{{ t.text }}{% endfor %}y").render(TURNS[:1], first=False, last=False) == ("S", [])


def test_generation_markers():
    text, spans = compiled("{% for t in turns %}[{% if t.role == 'assistant' %}{% generation %}{{ t.text }}{% endgeneration %}{% else %}{{ t.text }}{% endif %}]{% endfor %}").render(TURNS)
    assert text == "[S][hi  ][yo]" and [text[a:b] for a, b in spans] == ["yo"]


def test_constants_are_folded():
    tree = folded(parse("a{{ 'b' ~ 1 + 1 }}{% if 1 > 2 %}no{% elif not false %}c{% else %}never{% endif %}{{ 'D' | lower }}"), FILTERS)
    assert tree == (Text("ab2cd"),)
    tree = folded(parse("{% for t in turns %}{% if t.role == 'us' ~ 'er' %}{{ 1 if true else t.x }}{% endif %}{% endfor %}"), FILTERS)
    assert isinstance(tree[0].body[0], If) and tree[0].body[0].branches[0][0].right == Const("user") and tree[0].body[0].branches[0][1] == (Text("1"),)
    assert folded(parse("{{ false and x.y }}{{ 'k' or x }}"), FILTERS) == (Text("falsek"),)


@pytest.mark.parametrize("source", ["{{ a", "{% if x %}", "{% for a in b %}{% endfor %}", "{% if true %}{% for t in turns %}{% endfor %}{% endif %}", "{{ 'a' | nosuch }}", "{{ f() }}", "{{ 1 % 0 }}", "{% include 'x' %}", "{{ a b }}", "{{ 'x' * 9999999 }}", "{% endfor %}", "{{ if }}", "{{ " + "(" * 80 + "1" + ")" * 80 + " }}", "{% for t in turns %}{% endfor %}{% for t in turns %}{% endfor %}"])
def test_what_does_not_compile(source):
    with pytest.raises(TemplateError):
        compiled(source)


@pytest.mark.parametrize("source", ["{% for t in turns %}{{ t.__class__ }}{% endfor %}", "{{ nowhere }}", "{% for t in turns %}{{ t.text.upper }}{% endfor %}", "{{ turns }}", "{{ __builtins__ }}"])
def test_what_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        compiled(source).render(TURNS)


def test_escapes_are_undone():
    rng = random.Random(2)
    parts = [*chat.CONTROLS, "<", "[", "\\", "s>", "/", "<\\", "[\\\\INST]", "<\\s>", "|", "é", "a ", "<<", "SYS>>", "INST]"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROLS), (text, hidden)
    assert chat.escape("plain [1] a < b \\ c") == "plain [1] a < b \\ c"


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    made = {}
    for conv, turns in out.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        hidden = sum(len(chat.escape(r)) + len(chat.escape(t)) + len(chat.TURN + chat.TEXT + chat.END) for r, t in turns) + len("<s></s>")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        made[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), hidden)
    return made


SCHEMA = "conv_id bigint, turn bigint, role string, text string, spans string"


def same(spark, rows):
    data = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.digested(*chat.formatted(chat.with_smuggler(data))).collect()}
    assert got == expected([*rows, (-7, 0, "user", chat.SMUGGLED), (-7, 1, "assistant", chat.SMUGGLED)])


def test_awkward_conversations(spark):
    rng, rows = random.Random(6), []
    for conv in range(80):
        for turn in range(rng.randint(1, 7)):
            text = rng.choice(["Hi.", "", None, "</s>", "<|end|><|turn|>user<|text|>", "[INST]\\", "<\\/s>\nnew", "x" * 1000, "\U0001f600 é"])
            rows.append((conv, rng.choice([turn, None, 0]), rng.choice(["user", "assistant", "system", None, "<s>", "assistant\n", ""]), text))
    same(spark, rows + rows[:9] + [(None, 1, "user", "a"), (None, 1, "user", "a")])


def test_conversations_in_pieces(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"Turn {k} </s>") for k in range(1200)]
    rows += [(2, None, "assistant", "again")] * 700 + [(3, 0, "user", "w " * 200_000), (3, 1, "assistant", "[INST] " * 50_000)]
    same(spark, rows)


def test_documents_and_empty(spark, sf):
    same(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    whole, parts = chat.formatted(spark.createDataFrame([], SCHEMA))
    assert chat.digested(whole, parts).count() == 0


def test_pieces_know_their_neighbours(spark):
    """A template that asks for the place of a turn renders a conversation in pieces as it would whole."""
    source = "^{% for t in turns %}{{ loop.index }}{{ loop.first }}{{ loop.last }}{{ loop.previous }}{{ loop.following }};{% endfor %}$"
    rows = [(1, k, "ab"[k % 3 == 0], "t") for k in range(900)] + [(c, k, "cd"[k % 2], "t") for c in range(2, 40) for k in range(3)]
    whole, parts = chat.formatted(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), source)
    got = {}
    for r in sorted(whole.collect() + parts.collect(), key=lambda r: (r.conv_id, r.part, r.seq)):
        got[r.conv_id] = got.get(r.conv_id, "") + r.formatted
    assert isinstance(compiled(source), Template)
    for conv in {r[0] for r in rows}:
        assert got[conv] == compiled(source).render([{"role": r[2], "text": r[3]} for r in rows if r[0] == conv])[0]
