"""Layout of pages: implied tags, visibility, spacing, lists and tables; edge cases; words against a plain reading."""

import re
from html import unescape

import pytest

from fleetlens.llm import html_render
from fleetlens.llm.html_render import visible_text

CASES = [
    (None, ""), ("", ""), ("  \n ", ""), ("plain &amp; &lt;text&gt;", "plain & <text>"),
    ("a  b\n c", "a b c"), ("one <b>two</b>three", "one twothree"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"), ("<h1>T</h1>x", "T\n\nx"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=9><li>a<li>b<li value=3>c</ol>", "9. a\n10. b\n3. c"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table>", "Name   Qty\napple  3"),
    ("<table><tr><td>a<td rowspan=2>tall<td>b<tr><td>longer<td>c</table>", "a       tall  b\nlonger        c"),
    ("<table><tr><td colspan=2>wide cell<td>z<tr><td>1<td>2<td>3</table>", "wide cell  z\n1  2       3"),
    ("<table><caption>C</caption><tfoot><tr><td>f</tfoot><tbody><tr><td>b</tbody></table>", "C\nb\nf"),
    ("<table>lost<tr><td>a</table>", "lost\n\na"), ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"),
    ("<head><title>no</title></head><body>yes", "yes"), ("<title>no</title>yes", "yes"),
    ("<script>var a = '<p>no</p>'</script>yes<style>no</style><!-- no --><template>no</template>", "yes"),
    ("<p hidden>no</p><p style='DISPLAY : none'>no</p>yes", "yes"),
    ("<div style='visibility:hidden'>no <i style='visibility:visible'>yes</i></div>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("<textarea>a < b</textarea>", "a < b"),
    ("<p>a</p></p></div></b>b", "a\n\nb"), ("a < b", "a < b"), ("<a href='unclosed", ""), ("x<!-- open", "x"), ("<script>open", ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<ul><li>" * 400 + "deep", None),
    ("<table><tr><td colspan=99999999 rowspan=-4>a<td>b</table>", None), ("<b " + "x=" * 5000 + ">t", "t"),
]


CASES += [
    ("<table><tr><td style='visibility:inherit'>a<td style='content-visibility:auto'>b</table>", "a  b"),
    ("<ul><li style='visibility: inherit'>a<li style='visibility:unset'>b<li style='visibility:hidden'>no</ul>", "- a\n- b"),
    ("<div style='visibility:collapse'>no<table><tr style='visibility:visible'><td>yes</table></div>", "yes"),
    ("x <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>no</annotation></math>", "x a+b"),
    ("a<svg><title>no</title><defs><text>no</text></defs><rect/><g>no<text x=1>two <tspan>words</tspan></text></g></svg>b", "a\ntwo words\nb"),
    ("a<svg><path d=x /></svg>b<br/>c", "ab\nc"),
    ("<style>.x{display:none} #y , b.z {visibility:hidden}</style><p class='w x'>no<p id=y>no<p>a <b class=z>no</b><i class=z>b</i>", "a b"),
    ("<style>p{display:none} p.on{display:block}</style><p>no<p class=on>yes", "yes"),
    ("<style>/* .x{ */ .x{display:none!important} .x{display:block}</style><p class=x style='display:block'>no</p>yes", "yes"),
    ("<style>@media print { p { display:none } } @import 'x'; .q{display:none} div p{display:none}</style><div><p>yes<p class=q>no</div>", "yes"),
    ("<style>.x{display:none}</style><p class=x style='display:inline'>yes<p hidden style='display:block'>too", "yes\n\ntoo"),
    ("<style>.x{display:none", ""), ("<style>@media x {.x{</style><p class=x>yes", "yes"),
    ("<div>" * 200 + "<p style='display:none'>no</p><table><tr><td>c1<td>c2</table>" + "</div>" * 200, "c1  c2"),
    ("<div>" * 2000 + "<p style='display:none'>no</p>yes", "yes"), ("<b>" * 50_000 + "</i>" * 50_000 + "<li>" * 2000 + "deep", None),
    ("<table><tr><td>" + "long words " * 10 + "<td>x<tr><td>a<td>y</table>",
     "long words long words long words long words long words long  x\nwords long words long words long words long words\na" + " " * 60 + "y"),
    ("<table><tr><td>" + "long words " * 10 + "</table>", " ".join(["long words"] * 10)),
    ("<table><tr><td>" + "w" * 100 + "<td>x<tr><td>a<td>y</table>", "w" * 100 + "  x\na" + " " * 61 + "y"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_layout(html, text):
    found = visible_text(html)
    assert found == text if text is not None else found.split()


def test_wide_characters_keep_columns():
    assert visible_text("<table><tr><td>漢字<td>x<tr><td>ab<td>y</table>") == "漢字  x\nab    y"


def test_pages_keep_all_visible_words(spark, data_dir):
    pages = spark.read.parquet(f"{data_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_render.extract(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        plain = re.sub(r"(?is)<head.*?</head>|<!--.*?-->|<(script|style)\b.*?</\1>", "", r["html"])
        words = unescape(re.sub(r"<(/?)(p|li|ul|div|h1|nav|article|footer|br|body|html|td|tr|table|section)\b[^>]*>", " ", plain))
        words = re.sub(r"<[^>]*>", "", words).split()
        assert [w for w in found[r["page_id"]].split() if w != "-"] == [w for w in words if w != "-"]


def test_edge_rows(spark):
    rows = [(1, None, "u", "x"), (2, "", "u", "x"), (2, "", "u", "x"), (None, "<p>a", "u", "x"), (4, "<p>" + "word " * 200_000, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, url string, text string")
    found = sorted((r["page_id"] or 0, r["n_lines"], r["n_words"]) for r in html_render.extract(pages).collect())
    assert found == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (2, 0, 0), (4, 1, 200_000)]
    assert html_render.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html, text", [
    ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
    ("<table><form><tr><td>a</td></tr><tr><td>b</td></tr></form></table>", "a\nb"),
    ("<table><tbody><form><td>a<form>c</form></td></tbody></table>", "a\nc"),
    ("<table><tr><form>text<td>a</td></form></tr></table>", "text\n\na"),
    ("<form><table><tr><td>a</td></tr></table>b</form>c", "a\n\nb\nc"),
    ("a<xmp>  <b>x</b> &amp;\n y</xmp>b", "a\n\n  <b>x</b> &amp;\n y\n\nb"),
    ("<table><tr><xmp>x</xmp><td>a</td></tr></table>", "x\n\na"),
    ("<xmp>not closed <i>", "not closed <i>"),
])
def test_forms_in_tables_and_plain_text_keep_their_text(html, text):
    assert html_render.visible_text(html) == text
