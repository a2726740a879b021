"""Main text of hand-written pages, of the given ones against a plain reading of their article, and the scan against all stretches."""

import html
import random
import re

import duckdb
import numpy as np
import pytest

from winnow.llm.html_text import KINDS, LINKED, N_KINDS, Page, extracted, fitted, learned, op12_html_text

PAGES = "/root/testdata/sf0.001/pages.parquet"
LONG = "Some words of an article that go on for quite a while, so that they weigh more than a few tags do."


def plain(page):
    """The article element's text, for pages of paragraphs only."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    lines = re.sub("<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", re.sub("</?(?:p|h1)>", "\n", inner.replace("\n", " "))).split("\n")
    return "\n".join(x for x in (" ".join(html.unescape(t).split()) for t in lines) if x)


@pytest.fixture(scope="module")
def given():
    return duckdb.sql(f"select page_id, url, html from '{PAGES}' order by page_id").fetchall()


@pytest.fixture(scope="module")
def scores(given):
    pages = [Page(h) for i, _, h in given if i % 2]
    return learned([(np.array(p.kinds), np.array(p.counts), *p.marked()) for p in pages])


def text_of(page, scores):
    p = Page(page)
    return p.text(*p.region(scores))


def test_pages_that_were_not_learned_from(given, scores):
    rest = [h for i, _, h in given if not i % 2]
    assert len(rest) > 20 and [text_of(h, scores) for h in rest] == [plain(h) for h in rest]


@pytest.mark.parametrize(
    "inner, expected",
    [
        (f"<article><h1>Title</h1><p>{LONG}</p><aside>Aside</aside><form>Form<input value=x></form><p>More &amp; more&nbsp;of\n it</p></article>", f"Title\n{LONG}\nMore & more of it"),
        (f"<nav>Menu {LONG}</nav><header>Header {LONG}</header><article><p>{LONG}</p></article><footer>Footer {LONG}</footer>", LONG),
        (f"<article><p>{LONG}</p></article><section id='comments'><article class=comment><p>{LONG}</p></article></section>", LONG),
        (f"<article><p>{LONG}</p><div class='article-comments'><div><p>Reader</p></div>{LONG}</div><p>End.</p></article>", f"{LONG}\nEnd."),
        (f"<div class='has-sidebar content'><article><p>{LONG}</p></article></div><div class=sidebar>{LONG}</div>", LONG),
        (f"<div class='cookieNotice'>{LONG}</div><article><p>{LONG} &lt;b&gt; &#233;&#x41; &am</p></article>", f"{LONG} <b> éA &am"),
        (f"<article><p>{LONG}<script>var t = '</p><p>no'; if (a<b) x()</script><style>p{{}}</style><!-- no <p> --> on</p></article>", f"{LONG} on"),
        (f"<article><p>one<br>two<p>three <b>four<p class=ad>Advert<p>{LONG}</article>", f"one two\nthree four\n{LONG}"),
        (f"<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>{LONG}<pre>x\n  y</pre></article>", f"a\nb\nc d\ne\n{LONG}\nx y"),
        (f"<article><p>{LONG}</p><nav>never closed<p>{LONG}</article>", LONG),
        (f"<article><header><h2>Head</h2></header><p>{LONG}</p><span class=ad>buy <span>now</span></span><p>{LONG}</p></article>", f"Head\n{LONG}\n{LONG}"),
        (f'<ARTICLE ID="a>b"><P TITLE=\'<p>\'>{LONG}</P></ARTICLE>', LONG),
    ],
)
def test_hand_written_pages(scores, inner, expected):
    assert text_of(f"<!DOCTYPE html><html><head><title>T</title></head><body>{inner}</body></html>", scores) == expected


def test_pages_without_marks_and_without_words(scores):
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(30)) + "</ul>"
    page = f"<body><div>{menu}</div><div><p>{LONG}</p><p>{LONG}</p></div><div>{menu}</div></body>"
    assert text_of(page, scores) == text_of(page, learned([])) == f"{LONG}\n{LONG}"
    for empty in ("", "<html></html>", "<nav>x</nav>", "<p", "   ", "<!-- open", "<script>x"):
        assert text_of(empty, scores) == ""
    assert text_of("plain text, no tag", scores) == "plain text, no tag"


def test_any_page_is_read_in_time(scores):
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<a href='x", '"', "'", ">", "<", "</", "<b>", "</i>", "<nav>", "</article>", "<article>", "<td>", "word ", "&am", "\n", "<li>", "<!--", "-->", "<script>", "</script>", "é"]
    for _ in range(300):
        p = Page("".join(rng.choices(bits, k=60)))
        assert p.text(*p.region(scores)).count("\n\n") == 0
    for page in ("<b>" * 60_000 + LONG, "<a x='" * 60_000, "<div>" * 60_000 + LONG, "<span class=ad></p>" * 60_000, "<p>word " * 60_000, "&" * 200_000):
        text_of(page, scores)


def test_the_scan_finds_the_best_stretch():
    rng = np.random.default_rng(1)
    for _ in range(60):
        scores = np.where(np.arange(N_KINDS) <= LINKED, 1.0, -rng.integers(1, 6, N_KINDS)) * 1.0
        p = Page("")
        p.kinds, p.counts = rng.integers(0, 6, 30).tolist(), rng.integers(1, 4, 30).tolist()
        x = scores[p.kinds] * p.counts
        best = max([0.0] + [x[a:b].sum() for a in range(30) for b in range(a + 1, 31)])
        a, b = p.region(scores)
        assert x[a:b].sum() == best


def test_learning_moves_scores_until_the_marked_stretch_is_best():
    p, h2, div = KINDS["p"], KINDS["h2"], KINDS["div"]
    pages = [(np.array([0, div, 0, p, 0, div, 0]), np.array([4, 1, 20, 1, 15, 1, n]), 2, 5) for n in (3, 6, 9)] + [(np.array([0, h2, 0]), np.array([9, 1, 9]), 0, 3)]
    scores = learned(pages)
    for kinds, counts, a, b in pages:
        x = Page("")
        x.kinds, x.counts = kinds, counts
        assert x.region(scores) == (a, b)
    assert (scores[: LINKED + 1] > 0).all() and (scores[LINKED + 1 :] < 0).all()


def test_op12_with_nulls_repeated_rows_and_clashing_names(spark, given, tmp_path):
    rows = [*given, (None, None, None), (900, "u", ""), (901, None, f"<p>{LONG * 3000}</p>"), given[0]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = op12_html_text(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = {(r.page_id, r.url): (r.text, r.n_chars, 1) for r in got.collect()}
    expected = {(i, u): plain(h) for i, u, h in given} | {(None, None): "", (900, "u"): "", (901, None): LONG * 3000}
    assert got == {k: (t, len(t), 1) for k, t in expected.items()}
    assert op12_html_text(spark, str(tmp_path)).count() == len(rows)
    none = df.limit(0)
    assert extracted(none, fitted(none)).count() == 0
