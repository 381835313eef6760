"""The parsers on small inputs, without a session."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillspark.kernels import bloom, chunker, frontmatter, html, jslit, jsstr, xml


def md(source, limit=None):
    return html.to_markdown(source, limit)[0]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<h1>A</h1><p>b <b>c</b> <i>d</i></p>", "# A\n\nb **c** *d*"),
        ("<p>a<br>b</p>", "a\nb"),
        ("<p>a</p><hr><p>b</p>", "a\n\n---\n\nb"),
        ('<a href="/x">go</a>', "[go](/x)"),
        ("<a>go</a>", "go"),
        ('<a href="/x"> </a>', ""),
        ('<img src="/i.png">', "[image](/i.png)"),
        ('<img alt="Pic" src="/i.png"/>', "[Pic](/i.png)"),
        ("<img alt=x>", ""),
        ("<p>use <code>a`b</code></p>", "use `a\\`b`"),
        ('<pre><code class="x language-ts">a\n  b\n\n</code></pre>', "```ts\na\n  b\n```"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n>\n>\n> b"),
        ("<ul><li>a</li>x<p>no</p><li>b</li></ul>", "- a\n- b"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", "- a\n\n  - b"),
        ("<li>bare</li>", "bare"),
        ("<nav>n</nav><p>a</p><footer>f</footer><noscript>s</noscript>", "a"),
        ("<body>x<main>m<article>a<header>h</header></article></main></body>", "a"),
        ("<script>if (a < b) { '<p>x</p>' }</script><p>a</p>", "a"),
        ("<p>a &lt; &amp; &#x2014; &#8212; &unknown; &NBSP;b</p>", "a < & — — &unknown; b"),
        ("a < b", "a < b"),
        ("<p>a<p>b</p></i></p>c", "a\n\nb\n\nc"),
        ("<!-- x --><!doctype html><?p?><![CDATA[<raw>]]>", "<raw>"),
        ('<p title="a>b">c</p>', 'b">c'),
        ("<p>a</p", "a"),
        ("", ""),
    ],
)
def test_html(source, expected):
    assert md(source) == expected


def test_html_limit_counts_units():
    assert html.to_markdown("<p>ab\U0001f600cd</p>", 4) == ("ab\U0001f600", True, 4)
    assert html.to_markdown("<p>abc</p>", 0) == ("", True, 0)
    assert html.to_markdown("<p>abc</p>") == ("abc", False, 3)


def test_html_deep_nesting_needs_no_recursion():
    assert md("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"


def test_xml_nodes_and_selection():
    table = xml.nodes('﻿<?xml version="1.0"?><!DOCTYPE a><a x="1 &lt; 2"><b>t<![CDATA[<&amp;>]]></b><!-- c --><c.d/><b n=\'2\'/></a> tail')
    assert [(n.name, n.parent, n.depth, n.ord) for n in table] == [("a", -1, 0, 0), ("b", 0, 1, 0), ("c.d", 0, 1, 1), ("b", 0, 1, 2)]
    assert table[0].attrs == {"x": "1 < 2"} and table[1].text == "t<&>"
    names = lambda s: [n.node for n in xml.select(table, s)]
    assert names("/") == [0] and names("") == [0]
    assert names("/a") == [0] and names("a/b") == [1, 3] and names("/a/b[2]") == [3]
    assert names("//b") == [1, 3] and names("//a") == [] and names("/a/*") == [1, 2, 3]
    assert names("/a/c.d") == [] and names("/x") == [] and names("/a/b[9]") == []


@pytest.mark.parametrize("bad", ["", "text", "<a>", "<a></b>", "<a><b></a>", "<?x", "<a", "<!-- x", "<a><![CDATA[x</a>"])
def test_xml_rejects(bad):
    with pytest.raises(ValueError):
        xml.nodes(bad)


@pytest.mark.parametrize(
    ("literal", "value"),
    [
        ("[1, -2.5, 0x1F, 1e3,]", [1, -2.5, 31, 1000]),
        ("{ a: 'x', \"b\": null, c: undefined, d: true }", {"a": "x", "b": None, "c": None, "d": True}),
        (r"'a\n\x41B\u{1F600}\'\q'", "a\nAB\U0001f600'q"),
        ("`a\\`b\\$`", "a`b$"),
        ("/* c */ [ // d\n {k: [[]]} ].concat(x)", [{"k": [[]]}]),
        ("'a\\\nb'", "ab"),
    ],
)
def test_js_literals(literal, value):
    text, error, _ = jslit.export_json(f"let y = 1;\nexport const X = {literal};", "X")
    assert error is None and json.loads(text) == value


@pytest.mark.parametrize(
    ("literal", "at"),
    [("foo()", 0), ("[...a]", 1), ("{[a]: 1}", 1), ("`${a}`", 1), ("'a", 0), ("[1 2]", 3), ("{a 1}", 3), ("{1: 2}", 1), ("", 0), ("'a\nb'", 0)],
)
def test_js_rejections(literal, at):
    head = "export const X = "
    text, error, position = jslit.export_json(head + literal, "X")
    assert text is None and error and position == len(head) + at


def test_js_missing_export():
    assert jslit.export_json("export const Y: number = 1", "Y")[2] == 0
    assert jslit.export_json("// export const Z = 1", "Z")[0] is None


def test_frontmatter():
    text = "---\r\ntitle: \"A: b\"\n# note\nn: -1.5\ne: 1e3\nflag: true\nx:\nn: 2\nno colon\n---\nbody"
    fields, body = frontmatter.split(text)
    assert fields == {"title": "A: b", "n": 2, "e": "1e3", "flag": True, "x": ""} and body == "body"
    assert frontmatter.split("--- no\n---\n")[0] == {}


def test_fences_are_masked():
    text = "# A\n```\n# no\n```\n~~~x\n# no\n```\n# no\n~~~\n## B\n```\n# open"
    assert chunker.heading_offsets(text) == [0, text.index("## B")]
    assert chunker.heading_offsets("#\n\nText") == [0]
    assert chunker.heading_offsets("x\n#\n\nText") == [0, 2]


def test_heading_paths():
    text = "# A\n\n## B\n\n#### C\n\n## D\n\nx"
    outline = chunker.Outline(text)
    assert outline.at(0) == [] and outline.at(1) == ["# A"]
    assert outline.at(len(text)) == ["# A", "## D"]
    assert outline.at(text.index("## D")) == ["# A", "## B", "#### C"]


def test_chunks_compat_stalls_and_clean_does_not():
    text = "Body sentence. " * 400
    compat = chunker.chunks(text, "d", mode="compat")
    clean = chunker.chunks(text, "d", mode="clean")
    assert len(compat) == 6000 - 3200 - 100 * 4 or len(compat) > len(clean)
    assert len(clean) == 3
    assert [c.ordinal for c in clean] == [0, 1, 2]


def test_chunks_of_nothing():
    (only,) = chunker.chunks("", "d")
    (blank,) = chunker.chunks(" \n ", "d")
    assert only.text == blank.text == "" and only.id == blank.id and only.token_count == 0


def test_chunk_options():
    for size, overlap in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            chunker.chunks("x", "d", size, overlap)


@given(st.text(alphabet="ab. \n#é\U0001f600", max_size=600), st.integers(5, 40), st.integers(0, 4))
def test_clean_chunks_cover_the_text(text, size, overlap):
    found = chunker.chunks(text, "d", size, overlap)
    ends = [c.end for c in found]
    assert ends == sorted(set(ends)) and (not text or ends[-1] == jsstr.length(text))
    assert all(b.start <= a.end for a, b in zip(found, found[1:]))
    assert all(c.end - c.start <= size * 4 for c in found)


def test_bloom():
    sized = bloom.Bloom(100_000, 0.01)
    assert 115_000 < len(sized.store) < 125_000 and 6 <= sized.hashes <= 8
    assert bloom.fnv1a("") == 0x811C9DC5 and bloom.fnv1a("a") == 0xE40C292C
    assert bloom.djb2("a") == 5381 * 33 + 97
    small = bloom.Bloom(1000, 0.01)
    for i in range(1000):
        small.add(f"k{i}")
    assert all(f"k{i}" in small for i in range(1000))
    assert sum(f"x{i}" in small for i in range(5000)) < 150
    assert small.popcount() > 0
    with pytest.raises(ValueError):
        bloom.Bloom(0, 0.1)


@given(st.text(max_size=50))
def test_units_round_trip(text):
    clean = text.encode("utf-8", "ignore").decode()
    assert jsstr.text_of(jsstr.units(clean)) == clean
    assert len(jsstr.units(clean)) == jsstr.length(clean)
