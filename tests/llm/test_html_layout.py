import random
import re
from html.parser import HTMLParser

import pytest

from maskwright.llm.html_layout import extracted, visible_text

CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>One<p>Two<br>three</p>four", "One\n\nTwo\nthree\n\nfour"),
    ("<div>a</div><div>b <b>c</b>\n d</div>", "a\nb c d"),
    ("<ul><li>a<li>b<ol start=3><li>x</li><li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
    ("<table><tr><th>Name<th>N<tr><td>Anna<td>1<tr><td>Bo</td><td>22</table>", "Name  N\nAnna  1\nBo    22"),
    ("<head><title>T</title><style>p{}</style></head><body><script>var a='<p>no</p>';</script>yes", "yes"),
    ("<p hidden>no</p><p style='color:red; display: none'>no</p><p class=hidden>yes</p><div style=visibility:hidden>no</div>", "yes"),
    ("<!-- no --><!doctype html><template>no</template><noscript>no</noscript>yes <span hidden>no</span>too", "yes too"),
    ("<pre>a\n  b</pre><hr>c", "a\n  b\n\nc"),
    ("<dl><dt>t<dd>d1<dd>d2</dl><blockquote>q</blockquote>", "t\n  d1\n  d2\n\n  q"),
    ("1 < 2 <3 & <a href='x>y'>z</a></nothing></p>", "1 < 2 <3 & z"),
    ('<a href="open>text', "text"),
    ("<td>loose</td><tr><td>x", None),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        b\nin  ner"),
    ("<b>" * 5000 + "deep" + "<div>" * 3000 + "er", "deep\ner"),
]


@pytest.mark.parametrize("source, want", [c for c in CASES if c[1] is not None])
def test_layout(source, want):
    got = visible_text(source)
    assert re.sub(r"\n+", "\n", got) == re.sub(r"\n+", "\n", want) if "<table><tr><td>a<table>" in source else got == want


def test_columns_line_up():
    got = visible_text("<table><tr><td colspan=2>head</td><td>z</td></tr><tr><td>aaaa<td>bb<td>c<tr><td>x<br>y<td>q</table>").split("\n")
    assert got == ["head      z", "aaaa  bb  c", "x     q", "y"]


class Words(HTMLParser):
    """Every word outside what is never shown, by another parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_all_visible_words_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = extracted(pages).collect()
    assert len(got) == len(source)
    for r in got:
        other = Words()
        other.feed(source[r.page_id])
        assert re.sub(r"\s|(?m:^- )", "", r.text) == re.sub(r"\s", "", "".join(other.out))


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "<p>a" * 20_000, None), (3, "word " * 50_000, ""), (4, "<" * 30_000, ""), (5, '<a b="' * 3_000, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    got = extracted(pages, ("page_id",)).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id in (1, 2)] == ["", "", ""]
    assert extracted(pages.limit(0), ("page_id",)).count() == 0


BESIDE = [
    ("<table><tr><td>A</td><form><td>B</td></form></tr></table>", "A  B"),
    ("<form><table><tr><td>A</td><form><td>B</td></form></tr><tr><td>C</table></form>after", "A  B\nC\nafter"),
    ("<table><tr><td>A</td><div>B</div></tr></table>", "B\nA"),
    ("<table><tr>stray<td>A</td></tr><tr><td>B</td>text</tr></table>", "stray\ntext\nA\nB"),
    ("<table><tbody><tr><td>A</td>x</tr></tbody></table>", "x\nA"),
    ("<tbody><td>A<td>B</tbody>", "A  B"),
    ('<p class="hidden md:block">a</p><p title="hidden gem">b</p><p style="color:red" data-x="display:none">c</p>', "a\n\nb\n\nc"),
    ('<p data-style="display:none">a</p><p style="--display:none">b</p><p style="display:none;display:block">c</p>', "a\n\nb\n\nc"),
    ("<p HIDDEN=''>no</p><p hidden=until-found>no</p><p STYLE='Display : NONE !important; display:block'>no</p><p style=display&#58;none>no</p>yes", "yes"),
    ('<dialog title="an open one">no</dialog><dialog open>yes</dialog>', "yes"),
    ("<table><tr><td data-colspan=3>a<td>b<tr><td>c<td>d</table><ol data-start=5><li>x</ol>", "a  b\nc  d\n\n1. x"),
    ('<p>a <svg width="9"/>b</p>c<math/>d<svg><path d="x"/><style/><g/></svg>e', "a b\n\ncde"),
    ("a<svg width=9/>no</svg>b<svg viewBox='0 0'/ >", "ab"),
    ("<table><td colspan='2'>wide<tr><td>a<td>b</table><div/>c", "wide\na  b\n\nc"),
]


@pytest.mark.parametrize("source, want", BESIDE)
def test_nothing_that_shows_is_lost(source, want):
    assert visible_text(source) == want


def test_tall_and_wide_cells():
    page = "<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td colspan=2>D<td>E</table>"
    assert visible_text(page) == "A  B\n   C\nD     E"
    assert visible_text("<table><tr><th rowspan=0>k<td>1<tr><td>2<tr><td>3</table>") == "k  1\n   2\n   3"
    assert visible_text("<table><tr><td colspan=999>a<td>b<tr><td>c<td>d</table>") == "a     b\nc  d"
    assert visible_text("<table><tr><td colspan=99999999999999999999>a<tr><td>b<td rowspan=x>c</table>") == "a\nb  c"
    assert visible_text("<table><tr><td>中文<td>x<tr><td>ab<td>y<tr><td>é<td>z</table>") == "中文  x\nab    y\né     z"


def test_numbers_of_lists_have_no_cap():
    assert visible_text("<ol start=12345678><li>a<li>b</ol>") == "12345678. a\n12345679. b"
    assert visible_text("<ol start=-3><li>a</ol>") == "-3. a"


def test_drawn_text_and_closed_details():
    assert visible_text("<p>x <svg><title>t</title><desc>no</desc><defs><text>no</text></defs><text>one</text><text>two</text></svg> y</p>") == "x one two y"
    assert visible_text("<p><math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math></p>") == "a+b"
    page = "<details{}><summary>S</summary>body <b>bold</b><summary>second</summary><p>more</details><p>after"
    assert visible_text(page.format("")) == "S\n\nafter"
    assert visible_text(page.format(" open")) == "S\nbody bold\nsecond\n\nmore\n\nafter"


def test_visibility_can_be_turned_on_again():
    assert visible_text('<div style="visibility:hidden">no<span style="visibility:visible">yes</span></div>') == "yes"
    assert visible_text('<div style="display:none">no<span style="display:inline;visibility:visible">no</span></div>') == ""
    assert visible_text("<div style=visibility:collapse>a<p>b<p style='visibility: VISIBLE'>c</div>d") == "c\nd"


def test_style_sheets():
    page = "<style>.x, p#one{display:none} /* .y{display:none} */ .v{visibility:hidden} @media print{.z{display:none}} div > .w{display:none}</style>"
    assert visible_text(page + "<p class=x>a</p><p class='y x'>b</p><p id=one>c</p><div id=one>d</div><p class=y>e</p><p class=v>f <b style=visibility:visible>g</b></p><p class=z>h</p><p class=w>i</p>").split() == list("deghi")
    assert visible_text("<style>p{display:none}.on{display:block}#no{display:none}</style><p>a<p class=on>b<p class=on id=no>c<p style='display:block'>d").split() == ["b", "d"]
    assert visible_text("<style>p{display:none !important}</style><p style='display:block'>a</p>b").split() == ["b"]
    assert visible_text("<script>'<style>p{display:none}</style>'</script><!--<style>p{display:none}</style>--><p>a").split() == ["a"]


def test_buttons_show_their_value():
    assert visible_text("<form>Name <input name=q value=no> <input type=submit value='Go on'><input type=hidden value=no><input type=RESET value=x&amp;y></form>") == "Name Go on x&y"
    assert visible_text("<input type=button value=a hidden><p style=visibility:hidden><input type=button value=b><input type=button value=c style=visibility:visible>") == "c"


def test_against_a_walk_of_the_tree():
    """Words of random trees that a plain walk sees, whatever the elements, rules and attributes."""
    rng = random.Random(11)
    rules = {"gone": ("display", "none"), "unseen": ("visibility", "hidden"), "seen": ("visibility", "visible")}
    sheet = "<style>" + "".join(f".{c}{{{k}:{v}}}" for c, (k, v) in rules.items()) + "</style>"
    for _ in range(300):
        n, want = [0], []

        def tree(depth, hidden, unseen):
            out = []
            for _ in range(rng.randint(1, 4)):
                n[0] += 1
                if depth == 4 or rng.random() < 0.4:
                    out.append(f" w{n[0]} ")
                    if not hidden and not unseen:
                        want.append(f"w{n[0]}")
                    continue
                tag, kind = rng.choice(["div", "span", "b", "section", "ul"]), rng.choice(["", "", "", "hidden", "style", *rules])
                attribute, gone, dim = "", hidden, unseen
                if kind == "hidden":
                    attribute, gone = " hidden", True
                elif kind:
                    name, value = rng.choice(list(rules.values())) if kind == "style" else rules[kind]
                    attribute = f' style="color:red;{name}: {value}"' if kind == "style" else f" class='a {kind}'"
                    gone, dim = hidden or value == "none", {"hidden": True, "visible": False}.get(value, unseen)
                out.append(f"<{tag}{attribute}>{tree(depth + 1, gone, dim)}</{tag}>")
            return "".join(out)

        source = tree(0, False, False)
        assert visible_text(sheet + source).replace("- ", "").split() == want, source
