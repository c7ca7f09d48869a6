"""Main text: the ratios decide, no text of an article is lost, odd tables."""

import html
import re

import pytest

from tessera.llm import html_main, queries

SF = "/root/testdata/sf0.01"
PROSE = "One sentence, with a clause; then another one. A third follows, and it is longer than the others."


def article(inner, head="article"):
    return (f"<html><body><nav><a href=/>Home</a> <a href=/a>About us</a></nav><{head}><h1>Title</h1><p>{PROSE}</p>{inner}"
            f"<p>{PROSE}</p></{head.split()[0]}><footer>Foot, note.</footer></body></html>")


def kept(page):
    return html_main.main_text(page).split("\n\n")


def neutral(page):
    """The same page without any tag or class that names its role."""
    page = page.replace("</article>", "").replace("<footer>", "</article><footer>")
    return re.sub(r"<(/?)(?:nav|article|footer)\b", r"<\1div", page).replace('class="ad"', 'class="x"')


def expected(page):
    body = re.search(r"(?s)<article>(.*?)(</article>|<footer>|$)", page)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def given(spark):
    return [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def test_ratios_choose_the_article_without_names(spark):
    """No name helps; very short articles are no longer than their surroundings."""
    pages = [p for p in given(spark) if len(expected(p)) > 1500]
    assert len(pages) > 100
    for p in pages:
        assert html_main.main_text(neutral(p)) == expected(p)


def test_results_rest_on_the_ratios(spark, monkeypatch):
    pages = given(spark)
    assert [html_main.main_text(p) for p in pages] == [expected(p) for p in pages]
    monkeypatch.setattr(html_main, "content_paths", lambda found: {b[0] for b in found})
    other = sum(html_main.main_text(p) != expected(p) for p in pages)
    assert other > 0.9 * len(pages)


@pytest.mark.parametrize("head", ["article", "div class=k"])
@pytest.mark.parametrize("inner, parts", [
    ("<ul><li><a href=1>First source</a></li><li><a href=2>Second &amp; last</a></li></ul>", ["First source", "Second & last"]),
    ("<p><a href=1>All of this\nis a link &amp; more &copy; text</a></p>", ["All of this is a link & more © text"]),
    ("<p>Let <math><mi>x</mi> <mo>&lt;</mo> <mn>3</mn></math> hold.</p>", ["Let x < 3 hold."]),
    ("<p><label>A label</label> in text.</p>", ["A label in text."]),
    ("<fieldset><p>Held by a fieldset.</p></fieldset>", ["Held by a fieldset."]),
    ("<section class=related-work><p>Earlier work, in short.</p></section>", ["Earlier work, in short."]),
    ("<pre><code>x = 1 <span class=comment># one</span></code></pre>", ["x = 1 # one"]),
    ("<h2 class=section-header>Part two</h2>", ["Part two"]),
    ("<div><p>Short.</p><p>Shorter.</p></div>", ["Short.", "Shorter."]),
])
def test_text_of_the_article_stays(inner, parts, head):
    assert kept(article(inner, head)) == ["Title", PROSE, *parts, PROSE]


def test_second_section_outside_the_paths():
    page = f"<body><div class=w><div class=a><p>{PROSE * 5}</p></div><div class=b><p>Short one.</p></div></div></body>"
    assert kept(page) == [PROSE * 5, "Short one."]


@pytest.mark.parametrize("inner", [
    "<div class=sidebar><p>Side, bar.</p></div>", "<aside>Beside, it.</aside>", "<form><label>Name</label><p>Fill in, please.</p></form>",
    "<div class='ad banner'>Buy, now.</div>", "<div class=cookie-notice><p>We use, some.</p></div>", "<p hidden>Unseen, text.</p>",
    "<section id=comments><p>I agree, fully. And so on, at length.</p></section>", "<script>var a = '<p>';</script><style>p{}</style>",
    "<p style='display: none'>Unseen.</p>", "<!-- <p>Old, text.</p> -->"])
def test_other_parts_go(inner):
    assert kept(article(inner)) == kept(article(inner, "div class=k")) == ["Title", PROSE, PROSE]


def test_pages_without_an_article():
    assert html_main.main_text("<body><nav>a b</nav><footer>Foot, note.</footer></body>") == ""
    assert html_main.main_text("<p>only") == "only"
    assert html_main.main_text("a < b &amp; c") == "a < b & c"


def test_long_page():
    page = article("".join(f"<p>{PROSE} {i}</p>" for i in range(20_000)))
    assert len(kept(page)) == 20_003


def test_deep_page():
    assert html_main.main_text("<div>" * 3000 + f"<p>{PROSE}</p>") == PROSE


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text long, n_chars string"
    page = article("")
    rows = [(1, "u", page, 9, "x"), (1, "u", page, 9, "x"), (None, None, page, None, None), (2, "v", None, 1, "y"), (3, None, "", 1, "y")]
    text = f"Title\n\n{PROSE}\n\n{PROSE}"
    got = sorted((tuple(r) for r in html_main.extract(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, text, len(text)), (2, "v", "", 0), (3, None, "", 0)], key=repr)
    none = html_main.extract(spark.createDataFrame([], schema))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]
