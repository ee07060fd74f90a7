"""Main text of pages annotated by hand, with names the operator doesn't know, and of the given pages by their own structure."""

import html
import re

import pytest

from signalloom.llm import html_text

LONG, MORE, LAST = ("The river rose again on Monday and the lower town was under water by noon. " * 4).strip(), ("Nobody had expected it so soon after the last one, said the mayor, and most had left. " * 3).strip(), "It will fall by Friday."


def join(*parts):
    return " ".join(parts)


PAGES = {
    "names nobody knows": (f'<div class="zz1"><a href="/">Start</a> <a href="/b">Berichte</a></div><div class="zz2"><h1>Water in town</h1><p>{LONG}</p><p>{MORE}</p><p>{LAST}</p></div><div class="zz3">Made by us.</div>', join("Water in town", LONG, MORE, LAST)),
    "an article that has a sidebar": (f'<div class="article has-sidebar"><h1>Water</h1><p>{LONG}</p><p>{MORE}</p></div><div class="rightcol"><p>Please note our new opening hours on all days.</p></div>', join("Water", LONG, MORE)),
    "an advert between paragraphs": (f'<article><h1>Water</h1><p>{LONG}</p><p class="advert">Buy new boots now.</p><p>{MORE}</p></article>', join("Water", LONG, MORE)),
    "a link around a block": (f'<a href="/x"><div>Read all the other stories of this week here</div></a><div><p>{LONG}</p><p>{MORE}</p></div>', join(LONG, MORE)),
    "a table for layout": (f'<table><tr><td><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td><h2>Water in town</h2>{LONG}<p>{MORE}</td></tr></table>', join("Water in town", LONG, MORE)),
    "links in running text": (f'<div><p>{LONG} <a href="/m">See the map.</a> {MORE}</p><p>{LONG}</p></div><div><ul><li><a href=1>First other story</a><li><a href=2>Second other story</a></ul></div>', join(LONG, "See the map.", MORE, LONG)),
    "readers' comments": (f'<article><h1>Water</h1><p>{LONG}</p><p>{MORE}</p><section class="comments"><p>So sorry to hear that, all the best to you.</p><p>Same here last year.</p></section></article>', join("Water", LONG, MORE)),
    "forms, scripts and styles": (f'<main><p>{LONG}</p><form><label>Your mail</label><button>Send it</button></form><script>var a="<p>no</p>"</script><style>p{{x:y}}</style><p>{MORE}</p></main>', join(LONG, MORE)),
    "no markup": (LONG, LONG),
    "references": (f"<div><p>{LONG} &amp; Caf&eacute;&nbsp;&#8211; &#x41;</p><p>{MORE}</p></div>", join(LONG, "& Café – A", MORE)),
    "nothing but links": ("<nav><a>One</a><a>Two</a></nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_annotated(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want


def asked(tree, x):
    """The features that a block's verdict goes through."""
    while isinstance(tree, tuple):
        yield html_text.FEATURES[tree[0]]
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]


def test_words_and_links_of_neighbours_decide(spark):
    """The tree asks for words and links first, and for anything else only where they leave doubt: most blocks of the given pages and of pages without known names or elements are decided by them alone."""
    tree = html_text.default_tree()
    given = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(100).collect()]
    for pages, share in ((given, 0.7), ([re.sub("article|main|nav|form|aside|footer|section", "div", p) for p, _ in PAGES.values()], 0.5)):
        paths = [list(asked(tree, x)) for p in pages for _, x in html_text.described(p)]
        assert all(p[0] in html_text.DENSITY for p in paths)
        assert sum(set(p) <= set(html_text.DENSITY) for p in paths) / len(paths) > share
    plain = [page.replace("advert", "zz9") for page, _ in PAGES.values()]
    assert sum(bool(html_text.main_text(p)) for p in plain) >= len(plain) - 1


REMARKS = ("I think that this is really sad and I am sorry for all the people there. " * 10).strip()
KEPT = {
    "a style that hides nothing": f'<article style="overflow:hidden"><p>{LONG}</p></article>',
    "a name with hidden in it": f'<div class="content hidden-print-no"><p>{LONG}</p><p>{MORE}</p></div>',
    "an attribute with hidden in its name": f"<article data-hidden-count=3><p>{LONG}</p></article>",
    "an article before longer remarks": f"<div><p>{LONG}</p><p>{MORE}</p></div><div><p>{REMARKS}</p></div>",
    "a list of links in an article": f"<article><p>{LONG}</p><ul><li><a>Paper on rivers and towns</a><li><a>Paper on rain in spring</a></ul><p>{MORE}</p></article>",
    "a list of links in an unknown element": f"<div class=q8><p>{LONG}</p><ul><li><a>Paper on rivers and towns</a><li><a>Paper on rain in spring</a></ul><p>{MORE}</p></div>",
}


@pytest.mark.parametrize("name", KEPT)
def test_nothing_is_lost(name):
    got = html_text.main_text(KEPT[name])
    assert LONG in got and ("Paper" in KEPT[name]) == ("Paper on rivers and towns Paper on rain in spring" in got)


@pytest.mark.parametrize("hides", ["<p hidden>", '<p style="color:red; display : none">', '<p aria-hidden="true">', "<div hidden><p>", "<span hidden>", '<b><i style="display:none">'])
def test_hidden_text_is_left_out(hides):
    end = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", hides)))
    assert html_text.main_text(f"<article><p>{LONG}</p>{hides}Secret <b>words</b> here.{end}<p>{MORE}</p></article>") == join(LONG, MORE)


def test_broken_markup():
    assert html_text.main_text(f"<p>{LONG} 3 < 5 <b title=it's>and {MORE}") == join(LONG, "3 < 5 and", MORE)
    assert html_text.main_text(f"<div><p>{LONG}</section></p><script <p>{MORE}</p></div>") == join(LONG, MORE)
    assert html_text.main_text(f"<p>{LONG}<!-- {MORE}") == LONG
    assert html_text.main_text(f"<p>{LONG}<SCRIPT>var x = '<p>';</Script ><p>{MORE}") == join(LONG, MORE)


def test_time_grows_with_length_alone():
    """A megabyte of what once took quadratic time."""
    import time

    unit = "<p>word word word</p>"
    began = time.process_time()
    html_text.main_text(f"<div>{unit * 50_000}</div>")
    usual = time.process_time() - began
    for piece in ("<div><p>word</p>", "<script ", '<a "', "<a b='", "<!--", "<", "<div>x</section>", "<p class='", "<p = ", "<textarea>", "</div>"):
        began = time.process_time()
        html_text.main_text(piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 5 * usual + 2, piece


def test_given_pages(spark):
    rows = html_text.op6_html_text(spark, "/root/testdata/sf0.01").collect()
    source = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in rows:
        m = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)[^>]*>", "\n", m[1]))).split())
        assert r.text == want and r.n_chars == len(want)
