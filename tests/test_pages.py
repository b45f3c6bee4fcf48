"""The tag tokeniser: written expectations, broken and hostile pages, the standard library's parser as a second opinion."""

import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_engine.functions import pages as P

MARKDOWN = [
    ("<h2>A <b>b</b></h2><p>one<p>two", "## A **b**\n\none\n\ntwo"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<ol><li><p>a</p><p>b</p></li><li>c</ol>after", "1. a\n\n   b\n2. c\n\nafter"),
    ("<ul><li>a</ul><p>p</p><ul><li>b</ul>", "- a\n\np\n\n- b"),
    ("<blockquote><p>q<blockquote>r</blockquote></blockquote>s", "> q\n>\n> > r\n\ns"),
    ("<ul><li><blockquote>q</blockquote></ul>", "- > q"),
    ("<pre><code class='x language-py'>a\n  <b>b</b> &lt;\n\n</code></pre>", "```py\na\n  b <\n```"),
    ("<pre>```</pre>", "````\n```\n````"),
    ("<table><tr><th>A<th>B|<tr><td>1<td><i>2</i><tr><td>3</table>", "| A | B\\| |\n| --- | --- |\n| 1 | *2* |\n| 3 |"),
    ("<table><tr><td>o<table><tr><td>i<td>j</table>p</table>x", "| o i j p |\n| --- |\n\nx"),
    ("<a href='/u v'>t <b>x</b></a> <a>n</a> <a href=/w></a>", "[t **x**](/u%20v) n"),
    ('<a href="a(b)">t</a><img src=i.png alt=" al  t "><img>', "[t](<a(b)>)![al t](i.png)"),
    ("a<br>b<hr>c", "a  \nb\n\n---\n\nc"),
    ("<code>a`b</code> <code>`</code> <b> x </b>y<i></i>", "``a`b`` `` ` `` **x** y"),
    ("<p><b>open<p>next", "**open**\n\nnext"),
    ("<head><title>t</title></head><body>b", "b"),
    ("</ul></li>a</b></table><li>b", "a\n\n- b"),
    ("<script>a<b</script>x<style>p{}", "x"),
    ("a<!-- c > -->b<!-- d", "ab"),
    ("<p title='a>b' x=\"</p>\">t", "t"),
    ("1 < 2 &amp; 3 &lt; 4 &#x41;&#66; &nbsp;x", "1 < 2 & 3 < 4 AB x"),
    ("", ""),
    (None, ""),
    ("<a href='x", ""),
]


@pytest.mark.parametrize("html,want", MARKDOWN)
def test_markdown(html, want):
    assert P.markdown_of(html) == want


@pytest.mark.parametrize("html,want", [
    ("<title>T</title><p>a\n b<br>c</p><div>d<span>e</span></div>f", "T\na b\nc\nde\nf"),
    ("<pre>x\n  y</pre>", "x\ny"),
    (None, ""),
    ("<ul><li>a</li> <li>b</ul>", "a\nb"),
])
def test_text(html, want):
    assert P.text_of(html) == want


HOSTILE = {
    "unclosed tags": "<a ", "nested": "<div>", "lists": "<ul><li>", "quoted": '<a x="', "bold": "<b>x", "mixed marks": "<b><i>", "raw": "<script>",
    "comments": "<!--", "ampersands": "&", "signs": "<", "quotes": "<blockquote>x", "tables": "<table><tr><td>", "rows": "<tr><td>x",
    "stray ends": "<p></div></ul>", "attributes": "<p a=", "one tag": "=''", "items": "<li>", "ticks": "<code>`", "preformatted": "<pre>x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_linear(name):
    """A page of a megabyte takes seconds whatever it repeats."""
    piece = HOSTILE[name]
    html = ("<a " if name == "one tag" else "<table>" if name == "rows" else "") + piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    P.markdown_of(html)
    P.text_of(html)
    assert time.perf_counter() - start < 20


def test_output_is_linear_in_depth():
    page = ("<blockquote>" * 200 + "x") * 300
    assert len(P.markdown_of(page)) < 4 * P.DEPTH * len(page)


class Text(HTMLParser):
    """Text by the standard library's parser, for pages without scripts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

    def handle_data(self, data):
        self.out.append(data)

    def handle_starttag(self, tag, attrs):
        if tag in P.BLOCKS or tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in P.BLOCKS or tag == "br":
            self.out.append("\n")


PIECES = st.lists(st.sampled_from(["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</li>", "</ul>", "x", "word two",
                                   " ", "&amp;", "&eacute;", "<br>", "<br/>", "<!-- c -->", "<table>", "<tr>", "<td>", "</td>", "</table>",
                                   '<a href="?q=1&amp;r=2">', "</a>", "<blockquote>", "</blockquote>", "<ol start='7'>", "</ol>", "1 < 2 "]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_text_as_the_standard_parser(pieces):
    html = "".join(pieces)
    parser = Text()
    parser.feed(html)
    parser.close()
    lines = (re.sub("[ \n]+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    assert P.text_of(html) == "\n".join(x for x in lines if x)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_markdown_keeps_the_words(pieces):
    """Whatever the tags, the words of the text are those of the Markdown (text between table cells aside)."""
    html = "".join(x for x in pieces if not x.startswith(("<table", "</table", "<tr", "<td", "</td", "<a", "1 <")))

    def words(text):
        return re.findall(r"[a-zé]+", text)

    assert words(P.markdown_of(html).replace("*", "")) == words(P.text_of(html))


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "<p>a</p>"), (3, "")], "page_id long, html string")
    got = df.select("page_id", P.page_text("html").alias("t"), P.page_markdown(df["html"]).alias("m")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "", ""), (2, "a", "a"), (3, "", "")]


def test_rule_chain_is_bound_once(spark):
    """The rules for text and Markdown appear once in their plans."""
    from corpus_engine.functions import html as H

    df = spark.createDataFrame([(1, "<p>&#65;</p>")], "page_id long, html string")
    for plan in (H.with_text(df), df.select(H.html_to_markdown("html").alias("m"))):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("<script") == 1
        assert plan.collect()[0][-1] == "A"
