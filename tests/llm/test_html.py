import html as h
import re

import pytest

from terralith.llm import html

CASES = {
    "": "",
    "plain  text\n only": "plain text only",
    "<p>a &lt; b &amp;amp; c&nbsp; d</p><p>second <b>bold</b>text<br>more</p>": "a < b &amp; c d\nsecond boldtext more",
    "<nav>menu</nav><article><h1>T</h1><p>One.<p>Two <a href='>x'>link</a></article><footer>f</footer>": "T\nOne.\nTwo link",
    "<article><p>A</p><div class='ad'>buy</div><div>x</div><form>f</form><aside>s</aside><p>B</p><section id=comments><p>nice</p></section></article>": "A\nx\nB",
    "<div class='page has-sidebar'><header>H</header><main><header><h1>T</h1></header><p>Body</p></main><div class=sidebar>s</div></div>": "T\nBody",
    "<article>small</article><article><p>larger one here</p></article>": "small\nlarger one here",
    "<main><h1>T</h1><p>lead</p><article><p>text</p></article></main>": "T\nlead\ntext",
    "<main><p>a</p><p class=related-work>b</p><div class='notice-period'>c</div><div class='comment-list'>d</div><div class='ad slot-2'>e</div><p>f</p></main>": "a\nb\nc\nf",
    "<main><p>a</p><div id=disqus_thread>b</div><div class='cookieConsent'>c</div><div class='has-sidebar'>d</div><ins class='adsbygoogle'>e</ins><div class='SocialShare2'>f</div></main>": "a\nd",
    "<h1>Title</h1><div>By A. Writer</div><p>" + "Real text. " * 20 + "</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>The end.</p><div>Copyright 2020 all rights</div>":
        "Title\nBy A. Writer\n" + ("Real text. " * 20).strip() + "\nThe end.",
    "<div>Site name</div><div>Slogan</div><div>Search</div><p>" + "Real text. " * 20 + "</p><p>" + "More text. " * 20 + "</p><div>a</div><div>b</div><div>c</div><div>d</div>":
        "Slogan\nSearch\n" + ("Real text. " * 20).strip() + "\n" + ("More text. " * 20).strip() + "\na\nb",
    "<script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><article>yes<!-- open": "yes",
    "<div class=cookie-notice>We use cookies on this site, as every site does, so please agree to all of it now.</div><p>" + "Real text. " * 20 + "</p>": ("Real text. " * 20).strip(),
    "<ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>" + "Real text. " * 20 + "</p>": ("Real text. " * 20).strip(),
    "<article><p>one</p><nav><p>a</p><p>b</p><p>c</p><p>d</p></nav><p>two</p></article>": "one\ntwo",
    "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>": "a\nb\nc\nd",
    "<article><p class=notice>sale<p>kept</article>": "kept",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert html.extract(page) == CASES[page]


def slow(page):
    """The article of the generated pages, by cutting at its own tags."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    out = []
    for block in re.split(r"</?(?:p|h1)>", body):
        t = " ".join(h.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", block)).split())
        if t:
            out.append(t)
    return "\n".join(out)


def test_query_against_brute_force(spark):
    got = {r.page_id: r for r in html.op5_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == slow(r.html) and got[r.page_id].url == r.url
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, "u", "<" * 3000 + "<a \"" * 2000, "y")], "page_id long, url string, html string, text string")
    got = html.extract_pages(df).collect()
    assert [r.text for r in got if r.page_id == 1] == ["", ""] and len(got) == 3
    assert html.extract_pages(df.filter("page_id > 5")).count() == 0


def test_windows_decide(monkeypatch):
    """Without the window sums, short lines far from any text would be kept."""
    page = "".join(f"<div>item {i}</div>" for i in range(8)) + "<p>" + "Real text. " * 30 + "</p>" + "".join(f"<div>entry {i}</div>" for i in range(8))
    kept = html.extract(page)
    assert "item 0" not in kept and "entry 7" not in kept and "Real text." in kept
    monkeypatch.setattr(html, "_extent", lambda weight: (0, len(weight)))
    assert "item 0" in html.extract(page)


def test_text_beside_a_marked_article():
    page = "<div>" + "x" * 300 + "</div><article><p>short</p></article><div>" + "y" * 1170 + "</div>"
    assert html.extract(page) == "short"
    teaser = "<article><p>Read more</p></article>" + "<p>" + "Real text. " * 20 + "</p>" + "<p>" + "More text. " * 20 + "</p>"
    assert html.extract(teaser).split("\n")[1:] == [("Real text. " * 20).strip(), ("More text. " * 20).strip()]


@pytest.mark.parametrize("line", ["The baker fills the oven with cookies and bread.", "\u00a9 2020 Smith proved this copyright theorem.", "Our newsletter of 1901 said so."])
def test_words_do_not_drop_a_line_of_the_text(line):
    real = "<p>" + "Real text. " * 20 + "</p>"
    assert line in html.extract(real + f"<p>{line}</p>" + real).split("\n")
    assert line not in html.extract(real + real + f"<div>{line}</div>")


def test_deep_and_long_pages():
    import time

    began = time.time()
    assert html.extract("<div>" * 20000 + "</b>" * 20000 + "deep") == "deep"
    assert html.extract("<article>" + "<p>word word</p>" * 50000 + "</article>").count("\n") == 49999
    assert time.time() - began < 20
