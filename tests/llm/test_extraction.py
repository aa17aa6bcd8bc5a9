"""HTML extraction against pages whose article is known, and against a plain reading of the given tables."""

import html
import re

import pytest

from evidora.llm import extraction

PROSE = "The committee said on Monday that it would look into the matter and that the results of the study are to be published by the end of the year."
MORE = "It is not known how many of the patients had been treated before, but the authors write that most of them were in good health at the time."
GERMAN = "Der Ausschuss hat am Montag gesagt, dass er sich mit der Sache befassen wird und dass die Ergebnisse der Studie bis zum Ende des Jahres vorliegen."
LINKS = "".join(f'<li><a href="/{i}">Some page that is about item {i}</a></li>' for i in range(8))


def page(body, head="<title>T</title><style>p{}</style><script>var a='</p>';</script>", lang="en"):
    return f'<!DOCTYPE html><html lang="{lang}"><head>{head}</head><body>{body}</body></html>'


CASES = [
    # what stands around, by tag, class, id or role
    (page(f"<header><h1>Site</h1><p>{PROSE}</p></header><nav><ul>{LINKS}</ul></nav><article><h1>Title</h1><p>{PROSE}</p></article><footer><p>{MORE}</p></footer>"), f"Title {PROSE}"),
    (page(f'<div class="cookie-notice"><p>{MORE}</p></div><div id="sideBar"><p>{MORE}</p></div><main><h2>Title</h2><p>{PROSE}</p></main><div role="contentinfo">{MORE}</div>'), f"Title {PROSE}"),
    (page(f'<article><h1>A</h1><p>{PROSE}</p><div class="ad-slot"><p>{MORE}</p></div><p>{MORE}</p><section id="comments"><article class="comment"><p>{PROSE}</p></article></section></article>'), f"A {PROSE} {MORE}"),
    (page(f"<form><label>Name</label><input><p>{MORE}</p><button>Go</button></form><article><p>{PROSE}</p></article><aside>{MORE}</aside>"), PROSE),
    (page(f'<div class="no-sidebar has-comments"><article><p>{PROSE}</p></article></div>'), PROSE),
    (page(f'<div class="hidden-xs col"><p>{PROSE}</p></div><div class="visually-hidden"><p>{MORE}</p></div><p hidden>{MORE}</p><div style="display: none">{MORE}</div>'), PROSE),
    # no article element: length, links and function words decide
    (page(f'<div><ul>{LINKS}</ul></div><div class="x1"><h1>Title</h1><p>By somebody</p><p>{PROSE}</p><p>So be it.</p><p>{MORE}</p></div><div>© 2024 Some company</div>'), f"Title By somebody {PROSE} So be it. {MORE}"),
    (page(f"<div><ul>{LINKS}</ul></div><div><p>{GERMAN}</p></div><div>Impressum</div><table><tr><td>{LINKS}</td></tr></table>", lang="de"), GERMAN),
    (page(f"<p>{GERMAN}</p>", lang="en"), GERMAN),
    # inline markup parts no words, block markup and br do; white space, references and comments
    (page(f"<article><p>f<b>o</b>o&nbsp;&amp;amp;\n\t b<!-- no -->ar<br>{PROSE} &eacute;&#233;&#xe9; &lt;b&gt; &unknown; &amp</p></article>"), f"foo &amp; bar {PROSE} ééé <b> &unknown; &"),
    (page(f"<article><table><tr><td>one<td>two<tr><td>three</table><p>{PROSE}<ul><li>x<li>y</ul><pre>a = b[1]\n  c</pre></article>"), f"one two three {PROSE} x y a = b[1] c"),
    # unclosed and cut off
    (f"<nav><ul><li><a href='/'>Home<article><h1>Title<p><b>{PROSE}<br><p>{MORE}</p><p>Cut o", f"Title {PROSE} {MORE} Cut o"),
    (f"<form action='x'><div><main><p>{PROSE}</p></main></div></form>", PROSE),
    (f"<article><p>{PROSE}</p><script>if (a < b) {{ '<p>no</p>' ", PROSE),
    (f"<head><title>T</title><p>{PROSE}</p>", PROSE),
    # articles of short blocks only, pages without any, a language without a list
    (page(f"<nav>{LINKS}</nav><article><h1>One</h1><p>two</p></article><footer>F</footer>"), "One two"),
    (page("<article>" + "<p>この文書は日本語で書かれており、区切りの空白がない。長い段落でも単語の一覧にはない。それでも本文として残る必要がある文章である。</p>" + "</article>"), "この文書は日本語で書かれており、区切りの空白がない。長い段落でも単語の一覧にはない。それでも本文として残る必要がある文章である。"),
    (page(f"<nav><p>{PROSE}</p></nav><div class='ad'>{MORE}</div>"), ""),
    ("plain text, no markup", "plain text, no markup"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("given, expected", CASES)
def test_pages(given, expected):
    assert extraction.main_text(given) == expected


def test_every_language():
    for lang, words in extraction.STOP_WORDS.items():
        w = words.split()
        prose = " ".join(f"{w[i % len(w)]} xyzq{i} abcde" for i in range(12))
        assert extraction.main_text(page(f"<div>{LINKS}</div><div>{prose}</div><div>Menu</div>", lang=lang)).startswith(prose)


def test_deep_and_long():
    deep = "<div>" * 20_000 + f"<p>{PROSE}</p>" + "</div>" * 20_000
    assert extraction.main_text(deep) == PROSE
    many = "<article>" + f"<p>{PROSE}</p><p>Yes.</p>" * 20_000 + "</article>"
    assert extraction.main_text(many) == " ".join([PROSE, "Yes."] * 20_000)


def plain(page):
    """The given tables' pages have one article, of headings, paragraphs and bold text."""
    text = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page)[1]
    text = re.sub(r"<[^>]*>", "", re.sub(r"<(?:/?p|/?h\d|br)>", " ", text))
    return " ".join(html.unescape(text).split())


def test_query_by_brute_force(spark, sf_dir):
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in extraction.query(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert got == {r["page_id"]: (r["url"], plain(r["html"]), len(plain(r["html"]))) for r in rows} and len(got) == len(rows)


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, `_text` int, `a.b` string"
    rows = [(1, None, None, "t", 1, 2, "p"), (1, "u", "", None, None, None, None), (None, "u", f"<p>{PROSE}</p>", "t", 1, 2, "p"), (2, "u", "<p>x</p>", "t", 1, 2, None)]
    df = spark.createDataFrame(rows, schema)
    out = extraction.extracted(df, most=10)
    assert out.columns == ["page_id", "url", "text", "n_chars", "_text", "a.b", "__text", "_n_chars"]
    got = {(r[0], r[2], r[5], r[6], r[7]) for r in out.collect()}
    assert got == {(1, "t", "p", "", 0), (1, None, None, "", 0), (None, "t", "p", PROSE, len(PROSE)), (2, "t", None, "x", 1)} and out.count() == 4
    assert extraction.extracted(df.limit(0)).count() == 0
    assert [r.asDict() for r in extraction.extracted(df.select("html").where("page_id = 2")).collect()] == [{"text": "x", "n_chars": 1}]
