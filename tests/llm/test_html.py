"""Main text of pages: the given pages, layouts without an article, and broken markup."""

import html as entities
import re
import time

from trustweave.llm import html_text, queries

SF = "/root/testdata/sf0.01"


def test_whole_articles_of_the_given_pages(spark):
    out = {r.page_id: r for r in queries.op9_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = r.html[r.html.index("<article>"):r.html.index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert out[r.page_id].text == "\n".join(b for b in blocks if b) and out[r.page_id].n_chars == len(out[r.page_id].text)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site, the best.</h1></header>
<div class="menu"><a href=1>Home, sweet</a><a href=2>News</a></div>%s
<div id="cookie-notice">We use cookies, as all do. Accept, please.</div><form>Search: <input></form><aside>See also, this and that.</aside>
<section class="comments"><p>First! I think, therefore, I comment. At length, too.</p></section><div hidden>Not shown, ever.</div>
<div role="contentinfo">All rights, reserved.</div><script>if (a < b) document.write("<p>no</p>")</script></body></html>"""
BODY = "<h2>A title</h2><p>One paragraph, with <b>bold</b> &amp; <a href=x>linked</a> words.<p>Another&nbsp;one:\n it is longer, has commas, and ends.<ul><li>an item, listed<li>a second item, listed</ul>"
TEXT = "A title\nOne paragraph, with bold & linked words.\nAnother one: it is longer, has commas, and ends.\nan item, listed\na second item, listed"


def test_article_and_plain_layouts():
    assert html_text.main_text(PAGE % f"<article>{BODY}<footer>By me, today.</footer></article>") == TEXT
    assert html_text.main_text(PAGE % f"<main><div>{BODY}</div><article class='comment'>Hi, all.</article></main>") == TEXT
    assert html_text.main_text(PAGE % f"<div><div>{BODY}</div></div>") == TEXT


def test_broken_markup_and_defined_cases(spark):
    cases = {"": "", None: "", "plain": "plain", "<p>a<p>b": "a\nb", "<article>x<script>y<z": "x", "<article><!-- x": "", "a < b & c": "a < b & c", "<article>a<br>b</article>": "a b", "</div></p>x": "x"}
    for source, text in cases.items():
        assert html_text.main_text(source) == text, source
    began = time.time()
    for source in ('<a href="' * 20000, "<" * 200000, "<div>" * 50000 + "x" + "</p>" * 50000, "<article>" + "<p>word, and word." * 20000):
        html_text.main_text(source)
    assert time.time() - began < 20
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>q", "t")], "page_id long, url string, html string, text string")
    out = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "q", 1), (1, "", 0), (1, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


LONG = "".join(f"<p>Paragraph {k} of the story, which goes on for a while, says this, and ends; no more of it is told here. Then, after some time, it is taken up again, by others, who tell the rest.</p>" for k in range(8))
LINKS = "".join(f"<li><a href={k}>Another story, number {k}, with a long title</a></li>" for k in range(12))


def test_the_ratio_chooses_on_pages_with_an_article():
    told = "\n".join(re.findall("<p>(.*?)</p>", LONG))
    # a teaser beside the text in a plain element
    teaser = "<article><a href=1>Read on</a></article>"
    for page in (f"{teaser}<div>{LONG}</div>", f"<div>{LONG}</div>{teaser}", f"<div>{LONG}</div><main>{teaser}</main>"):
        assert html_text.main_text(PAGE % page) == told
    # text beside an article of equal weight is kept, too
    assert html_text.main_text(PAGE % f"<article>{LONG}</article><div>{LONG}</div>") == f"{told}\n{told}"
    # lists of links without a name, and crumbs, within the content element
    for tag in ("main", "article"):
        assert html_text.main_text(PAGE % f"<{tag}><div>{LONG}</div><ul>{LINKS}</ul></{tag}>") == told
        assert html_text.main_text(PAGE % f"<{tag}><div>{LONG}</div>{'<div>Top</div><div>Up</div>' * 6}</{tag}>") == told
        # short items of its text stay
        items = "<ul>" + "<li>an item, short" * 9 + "</ul>"
        assert html_text.main_text(PAGE % f"<{tag}><h2>A title</h2>{LONG}{items}</{tag}>") == f"A title\n{told}" + "\nan item, short" * 9


WHOLE = [
    ("<h2>What you need</h2><ul><li>salt<li>two eggs<li>milk</ul>", ["What you need", "salt", "two eggs", "milk"]),
    ("<table><tr><th>Year<th>Sum<tr><td>1999<td>7<tr><td>2001<td>12</table>", ["Year", "Sum", "1999", "7", "2001", "12"]),
    ("<pre>x = 1\ny = x + 2</pre>", ["x = 1 y = x + 2"]),
    ("<h3>Sources</h3><ol><li>Doe 1999, <a href=1>On bread</a><li>Roe 2001, <a href=2>On milk</a></ol>", ["Sources", "Doe 1999, On bread", "Roe 2001, On milk"]),
    ("<dl><dt>Yeast<dd>makes it rise</dl><figure><figcaption>Bread</figcaption></figure><blockquote>Eat!</blockquote>", ["Yeast", "makes it rise", "Bread", "Eat!"]),
]


def test_lists_tables_code_and_sources_stay():
    told = re.findall("<p>(.*?)</p>", LONG)
    for part, lines in WHOLE:
        for page in (f"<article>{LONG}{part}</article>", f"<main><div>{LONG}</div>{part}</main>", f"<div><div>{LONG}{part}</div></div>"):
            assert html_text.main_text(PAGE % page) == "\n".join([*told, *lines]), page
        assert html_text.main_text(PAGE % f"<article>{part}{LONG}</article>") == "\n".join([*lines, *told])
