"""Rendered text of small pages, and markup that is broken, hidden or deep."""

import random
import time

import pytest

from tidemark.llm.html_text import TreeBuilder, page_text, visible_text

CASES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name   | N\nlonger | 1"),
    ("<table><td>a<td>b<tr><td colspan=2>wide cell</table>x", "a | b\nwide cell\n\nx"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("<script>var t='</p>'</script><style>p{}</style>x<!-- y -->", "x"),
    ('<p hidden>a</p><p style="color:red; DISPLAY:none">b</p><p style="visibility: hidden">c</p>d', "d"),
    ("x<template>t</template><noscript>n</noscript><textarea>v</textarea>y", "x\nv\ny"),
    ("<b>a<p>b</b>c &amp; &lt;d&gt; &eacute; &#8364; &bogus;", "a\n\nbc & <d> é € &bogus;"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n    d1\n    d2"),
    ("<blockquote>q<p>r</blockquote>", "> q\n\n> r"),
    ("a   b\n\tc <b> d</b>", "a b c d"),
    ("<title>t</title><h1>H</h1>text", "H\n\ntext"),
    ("<html><head><meta charset=x><p>body starts", "body starts"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in | ner | out"),
    ("<li>loose", "- loose"),
    ("", ""),
    ("plain", "plain"),
    ("</p></div></table><p>x", "x"),
    ("<select><optgroup label=g><option>a<option>b</select><datalist><option>c</datalist>", "g\na\nb"),
    ("<input value=v> <input type=submit value=Go> <input type=hidden value=h> <input type=password value=p>", "v Go"),
    ("<svg>q<defs><text>d</text></defs><text>t</text></svg><map>m</map>", "t\nm"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b><p>c</div>", "b"),
    ("<details>x<summary>s</summary>y</details><details open><summary>s</summary>y</details>", "s\ns\ny"),
    ("<p hidden style='display:block'>x<dialog>y</dialog><dialog open>z</dialog>", "x\n\nz"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td colspan=2>f</table>", "a | b | c\nd |   | e\nf"),
    ("<ruby>漢<rp>(</rp><rt>kan</rt></ruby>", "漢(kan)"),
    ("<ruby>漢<rp>(<rt>kan<rp>)</ruby>z", "漢(kan)z"),
    ("<ol reversed><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n6. c"),
    ("<style>.x{display:none}/*.k{*/ #i,b.z{visibility:hidden}@media print{p{display:none}}body{display:none}</style>"
     "<p class='y x'>1<p id=i>2<p class=k>3<b class=z>4</b><i class=z>5</i>", "35"),
    ("<style media=print>p{display:none}</style><style>p{display:none}.s{display:block}</style><p>a<p class=s>b", "b"),
    ("a<!-- > b", "a"),
    ("a<p title='x", "a"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_rendered(html, text):
    assert page_text(html) == text


def test_deep_and_broken_markup():
    assert page_text("<div>" * 50_000 + "x") == "x"
    assert page_text("<b>" * 20_000 + "x" + "</b>" * 20_000) == "x"
    for broken in ("<", "<p", "<a href='", "<!--", "<![CDATA[", "<table><li><td></ul></tr>", "</", "&#", "<li></dd></blockquote></pre>x</li>"):
        page_text(broken)


def random_tree(rng, depth=0, seen=True):
    """Markup and, by plain recursion, the words of it that show, each block on lines of its own."""
    html, lines = [], [[]]
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice("tttbisgvd") if depth < 5 else "t"
        if kind == "t":
            word = f"w{rng.randrange(10**6)}"
            html.append(f" {word} ")
            if seen:
                lines[-1].append(word)
            continue
        inner, found = random_tree(rng, depth + 1, seen if kind in "bis" else kind == "v")
        if kind in "bd":
            style = " style='display:none'" if kind == "d" else ""
            html.append(f"<div{style}>{inner}</div>")
            if kind == "b":
                lines += [*found, []]
            continue
        mark = {"i": "<i>", "s": "<span class=q>", "g": "<span style='visibility:hidden'>", "v": "<b style='visibility:visible'>"}[kind]
        html.append(mark + inner + {"<i>": "</i>", "<b ": "</b>"}.get(mark[:3], "</span>"))
        lines[-1] = lines[-1] + found[0]
        lines += found[1:]
    return "".join(html), lines


def test_random_trees_match_plain_recursion():
    rng = random.Random(0)
    for _ in range(1_500):
        html, lines = random_tree(rng)
        assert page_text(html) == "\n".join(" ".join(x) for x in lines if x), html


def slow_close(tags):
    """Open elements after a run of start and end tags of inline elements, by scanning."""
    stack = []
    for tag in tags:
        if not tag.startswith("/"):
            stack.append(tag)
        elif tag[1:] in stack:
            at = len(stack) - 1 - stack[::-1].index(tag[1:])
            stack = stack[:at] + ([t for t in stack[at + 1 :]] if "div" in stack[at + 1 :] and tag != "/div" else [])
    return stack


def test_open_elements_match_a_scan():
    rng = random.Random(1)
    for _ in range(2_000):
        tags = [rng.choice(("b", "i", "u", "div", "/b", "/i", "/u", "/div")) for _ in range(rng.randrange(1, 25))]
        builder = TreeBuilder()
        builder.feed("x" + "".join(f"<{t}>" for t in tags))
        assert [n.tag for n in builder.stack if not n.ended][2:] == slow_close(tags), tags


BAD = [
    ("<span>" * 60_000, "<p>", ""), ("<b>" * 100_000, "</i>", ""), ("<p><button>" + "<span>" * 60_000, "<p>", ""),
    ("", "<table><tr><td>x", ""), ("", "<blockquote>x", ""), ("<table>", "<td colspan=1000>", ""), ("", "<!--", ""),
    ("<table><tr>" + "<td rowspan=65534>x" * 10_000, "<tr><td>x", ""), ("", "<a ", ""), ("", "<!-- >", ""), ("", "&#", ""),
    ("", "<b><div></b>x", ""), ("<style>", "{", ""), ("<style>", "/*", ""), ("<style>", ".a{display:none}", "</style><p class=a>x"),
    ("<p style='", "display:", "'>"), ("", "</a ", ""), ("", "<?", ""), ("", "<![CDATA[", ""), ("<script>", "</", ""), ("<a", " ", ""),
    ("<table><tr><td>" + "w" * 300_000 + "<td>y", "<tr><td>a<td>b", ""),
]


@pytest.mark.parametrize("pre,unit,post", BAD)
def test_bad_patterns_take_linear_time(pre, unit, post):
    took = []
    for size in (100_000, 400_000):
        start = time.process_time()
        page_text(pre + unit * (size // len(unit)) + post)
        took.append(time.process_time() - start)
    assert took[1] < 2 or took[1] < 8 * took[0]


def test_rows(spark):
    rows = [(1, "<p>a", "clash"), (2, None, "x"), (3, "", "x"), (1, "<p>a", "y"), (None, "b", "z")]
    got = visible_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "b", 1), (1, "a", 1), (1, "a", 1), (2, "", 0), (3, "", 0)]
    assert visible_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
