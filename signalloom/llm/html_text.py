"""Main text of HTML pages from flat text blocks.

A page is cut into flat blocks of text at block-level tags, in one pass whose time grows with the page's length alone. A block is described by its words and link density, by
those of the blocks before and after it, and by those of all its neighbours in the same container; a decision tree, trained on the labelled blocks of the small pages below, keeps or drops it.
The tree is grown on words and links first. Only where these leave doubt may it ask how a block ends, whether it is a heading, which of HTML's own sections it lies in, and for
one hint from names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import Step, append_columns

#: Elements of HTML by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table tr td th figure blockquote fieldset dialog details menu select button template svg object canvas".split())
ASIDE = frozenset("nav header footer aside form dialog menu select button template svg object canvas fieldset".split())
#: Containers whose blocks are neighbours of those around them.
LISTS = frozenset("ul ol dl figure blockquote details tr".split())
#: Elements whose content isn't markup, and those without content.
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names (of class, id and role) that hint at what an element holds: one weak feature among others.
HINT_AGAINST = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header comment comments reply replies cookie cookies consent notice alert popup modal newsletter signup login share social related pager pagination".split())
HINT_FOR = frozenset("article articles content post entry story main body text".split())

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Attributes up to the end of a tag; a quote only quotes behind an equals sign. Never tried twice, so linear.
_ATTRIBUTES = re.compile(r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]*+)))?+""")
_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^a-z]+")

DENSITY = ("words", "links", "words_before", "links_before", "words_after", "links_after", "words_around", "links_around")
FEATURES = (*DENSITY, "in_article", "in_aside", "hint", "ends_sentence", "heading")
#: Labelled pages, one a line, annotated by hand: +12. is a text of 12 words and a full stop that belongs to the article, -12 one that doesn't.
LABELLED = """
<nav><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul></nav><div class=ad>-8.</div><article><h1>+9</h1><p>+45.<p>+80.<p>+3.<p>+30.</article><footer>-9.</footer>
<nav><a>-1</a><a>-1</a></nav><div class=ad>-12.</div><article><h1>+4</h1><p>+3.</article><footer>-14.</footer>
<nav><ul><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-5.</div><article><h1>+12</h1><p><b>+70.</b><br><p>+8.<p>+1.</article><footer>-6</footer>
<div><a>-1</a> <a>-1</a> <a>-2</a></div><div><div><h1>+7</h1><p>+60.<p>+35.<p>+12.</div></div><div>-15.</div><div><a>-2</a> <a>-3</a></div>
<div><a>-1</a></div><div><a>-2</a></div><div class=x1><p>+90.<p>+40 <a>+5</a> +20.<p>+6.<p>+75.</div><div class=x2><a>-6</a><a>-5</a></div><div>-7.</div>
<table><tr><td><a>-2</a><br><a>-2</a><br><a>-3</a></td><td><h2>+5</h2>+120.<p>+60.<p>+25.</td><td>-18.<br><a>-3</a></td></tr></table>
<table><tr><td><a>-1</a></td><td><a>-1</a></td></tr><tr><td>+70.<br>+50.<br>+9.</td></tr><tr><td>-5</td></tr></table>
<div class=article><h1>+6</h1><div><p>+50.<p>+44.</div><ul><li>+5<li>+7<li>+4</ul><p>+33.</div><div class=sidebar><h3>-2</h3><p>-20.</p><a>-4</a></div>
<main><h1>+8</h1><p>+3 <a>+1</a><p>+66.<blockquote>+30.</blockquote><figure><figcaption>+9.</figcaption></figure><p>+52.</main><aside><h2>-2</h2><p>-40.<p>-22.</aside>
<main><p>+100.<div class=ad>-11.</div><p>+80.<form><label>-3</label><button>-2</button></form><p>+60.</main>
<article><h1>+5</h1><p>+40.<p class=advert>-9.</p><p>+70.<section class=comments><h2>-1</h2><p>-14.<p>-35.<p>-6.</section></article>
<article><header><h1>+7</h1><p>+4</header><p>+55.<h2>+3</h2><p>+48.<h2>+2</h2><p>+36.<footer>-5 <a>-2</a></footer></article>
<header><p>-6</p><a>-1</a></header><div id=content><h1>+6</h1><p>+58.<p>+47.<ol><li>+12.<li>+15.<li>+9.</ol></div><footer><p>-20.<p>-12.</footer>
<div role=banner>-4</div><div class=c9><h2>+6</h2><p>+62.<p>+18.<p>+77.</div><div class=c8><h4>-2</h4><p>-16.</div><div class=c7><h4>-2</h4><ul><li><a>-5</a><li><a>-6</a><li><a>-4</a></ul></div>
<div class=notice>-22.</div><div><p>+85.<p>+64.<p>+5.<p>+91.</div><div><p>-13.</p></div>
<p>+40.<p>+55.<p>+20.<p>+70.
<h1>+5</h1><p>+30.<p>+45.<hr><a>-3</a> <a>-2</a> <a>-4</a>
<div><a>-2</a><a>-3</a></div><p>+80.<p>+15 <a>+4</a> +30.<p>+50.<p><a>-4</a></p></div>
<div class="article has-sidebar"><h1>+6</h1><p>+40.<p>+30.<p>+25.</div><div class=rightcol><p>-25.</p><p><a>-5</a></p></div>
<div><div><div><p>-3</p></div><div><h1>+9</h1><div><p>+66.<p>+71.</div><div><p>+42.</div></div></div></div><div><ul><li><a>-2</a><li><a>-2</a></ul></div><div>-10</div>
<nav><a>-1</a></nav><article><p>+2.</article><footer>-3</footer>
<nav><a>-2</a><a>-2</a></nav><div class=ad>-9.</div><article><h1>+1</h1><p>+1</article><footer>-10.</footer>
<div><p>+120 <a>+3</a> +40.<p>+35.<p>+50.</div><div><p>-8 <a>-6</a></p><p>-5 <a>-4</a></p><p>-6 <a>-7</a></p></div>
<div class=post><h2>+7</h2><p>+52.<p>+38.<div class=share><a>-1</a><a>-1</a></div></div><div class=comments><p>-30.<p>-45.<p>-8.</div>
<div class=post><h2>+5</h2><p>+22.<p>+61.</div><div class=newsletter><p>-12.</p><form>-2</form></div><div class=related><a>-8</a><a>-7</a></div>
<div><h3>-2</h3><a>-3</a><a>-3</a></div><div><p>+44.<pre>+30</pre><p>+28.<table><tr><td>+2<td>+3</tr><tr><td>+1<td>+2</tr></table><p>+60.</div>
<aside><p>-60.<p>-40.</aside><article><h1>+4</h1><p>+20.</article>
<div class=cookie>-30. <a>-2</a></div><div class=q1><h1>+8</h1><p>+35.<p>+48.</div><div class=q2>-6.</div>
<article><h1>+10</h1><p>+75.</article><div class=ad>-13.</div><footer>-5</footer>
<nav><a>-1</a></nav><article><h1>+5</h1><p>+40.<p>+31.</article>
<div><a>-2</a></div><div><h1>+4</h1><p>+50.<p>+9.</div>
<div class=x3><p>+60.<p>+22.<p>+12.</div>
<article><h1>+6</h1><p>+33.<p class=advert>-8.<p>+28.<p>+4.</article>
<div><p>+45 <a>+6</a><p>+70.<p>+26.<p>+17.</div>
<nav><ul><li><a>-1</a></ul></nav><div>-10.</div><article><h1>+8</h1><p>+200.<p>+90.</article><div>-18.</div>
<nav><ul><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-13.</div><article><h1>+8</h1><p>+5.</article><footer>-9.</footer>
<nav><ul><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-9.</div><article><h1>+8.</h1><p>+12.<p>+6.</article><footer>-11.</footer>
<nav><a>-1</a><a>-1</a></nav><div class=ad>-11.</div><article><h1>+6</h1><p><b>+6</b></article><footer>-8.</footer>
<nav><a>-1</a><a>-1</a></nav><div class=ad>-7.</div><article><h1>+9</h1><p>+16.</article><footer>-12.</footer>
<nav><ul><li><a>-1</a></ul></nav><div class=ad>-14.</div><article><h1>+7.</h1><p>+7.<p>+11.<p>+9</article><footer>-7.</footer>
<nav><ul><li><a>-1</a></ul></nav><div class=notice>-26.</div><article><h1>+3</h1><p>+20.</article><footer>-16.</footer>
<nav><ul><li><a>-1</a></ul></nav><div class=ad>-10.</div><article><h1>+8</h1><p>+4<br>+9<br>+8.</article><section class=comments><p>-25.<p>-4.</section><footer>-9.</footer>
<article><h1>+6</h1><p>+60.<ul><li><a>+5</a><li><a>+4</a><li><a>+7</a></ul><p>+40.</article><footer>-8.</footer>
<div><a>-1</a><a>-2</a></div><div class=c3><p>+70.<ul><li><a>+5</a><li><a>+6</a><li><a>+4</a></ul><p>+50.</div><div class=c4><ul><li><a>-5</a><li><a>-4</a><li><a>-6</a></ul></div>
<div class=k2><h1>+5</h1><p>+90.<p>+55.<h2>+3</h2><ul><li><a>+6</a><li><a>+5</a></ul></div><div class=k3>-12.</div>
<main><p>+40.<ol><li><a>+7</a> +3<li><a>+5</a><li><a>+8</a> +4.</ol><p>+75.</main><aside><ul><li><a>-4</a><li><a>-3</a></ul></aside>
+300.
+60.<br>+40.<br>+25.
+35.
<p>+70.
<main><p>+60.</p><form><label>-3</label><input><button>-2</button></form><p>+44.</p></main>
<div class=m1><p>+64.</p><form><label>-2</label><button>-1</button></form><p>+48.</p></div>
<article><h1>+2</h1><p>+60.<p>+48.<section class=comments><p>-11.<p>-5.</section></article>
<article><h1>+4</h1><p>+90.<p>+66.<div class=comments><p>-60.<p>-35.<p>-41.</div></article>
<div class=zz1><a>-1</a> <a>-1</a></div><div class=zz2><h1>+3</h1><p>+60.<p>+50.<p>+5.</div><div class=zz3>-3.</div>
<div class=n1><a>-2</a> <a>-1</a></div><div class=n2><h1>+7</h1><p>+140.<p>+90.<p>+4.<p>+66.</div><div class=n3>-4.</div>
<div class=w1><h1>+6</h1><p>+50.</div><div class=w2><p>+72.<p>+38.</div><div class=w3><p>+55.</div><div class=w4>-9 <a>-3</a></div>
<nav>-2</nav><div class=v1><p>+120.</div><div class=v2><p>+160.</div>
<header><h1>-3</h1><p>-9.</header><article><h1>+7</h1><p>+31.<figure><figcaption>+8</figcaption></figure><p>+9.</article><aside><h3>-3</h3><p>-48.<p>-30.</aside>
<dialog><p>-24.<p>-31.</dialog><article><p>+18.<p>+23.</article><form><p>-20.</form>
<nav><ul><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-4.</div><article><h1>+10</h1><p>+12.</article><footer>-8.</footer>
<nav><a>-1</a><a>-2</a></nav><article><h1>+5</h1><p>+14.<p>+3.</article><div class=notice><p>-12.<p>-9.</div>
<div class=ad>-21.</div><article><p>+15.<p>+11.</article><aside><p>-13.<p>-10.</aside>
<article><h1>+9</h1><p>+21.</article><div class=comments><p>-16.<p>-14.</div><footer><p>-10.<p>-14.</footer>
<form><p>-11.<p>-12.</form><article><p>+34.</article><div class=cookie>-33.</div>
"""
_MARK = re.compile(r"([+-])(\d+)(\.?)")
#: Levels of the tree that ask for words and links alone, and the fewest labelled blocks such a question leaves on a side.
DEPTH, LEAST = 5, 16


# --- the tree -------------------------------------------------------------------------------------------------------


def _best_split(rows: list[list[float]], features: Sequence[int], least: int) -> tuple[float, int, float] | None:
    """(impurity, feature, threshold) of the split with the least Gini impurity, if one is below that of the whole."""
    ones = sum(r[-1] for r in rows)
    best = None
    for f in features:
        order = sorted(rows, key=lambda r: r[f])
        left = 0.0
        for i in range(1, len(order)):
            left += order[i - 1][-1]
            if order[i - 1][f] == order[i][f] or i < least or len(order) - i < least:
                continue
            p, q = left / i, (ones - left) / (len(order) - i)
            impurity = i * p * (1 - p) + (len(order) - i) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (order[i - 1][f] + order[i][f]) / 2)
    return best


def fit_tree(rows: list[list[float]], depth: int = DEPTH, least: int = LEAST):
    """CART with Gini impurity: (feature, threshold, below or equal, above), or the share of 1 at a leaf.

    ``depth`` levels split by words and links alone, into parts of at least ``least`` blocks. What is mixed below is split by the other features, and what they can't tell apart by words and links again.
    """
    ones = sum(r[-1] for r in rows)
    if ones in (0, len(rows)):
        return ones / len(rows)
    density = range(len(DENSITY))
    best = _best_split(rows, density, least) if depth > 0 else None
    best = best or _best_split(rows, range(len(DENSITY), len(FEATURES)), 1) or _best_split(rows, density, 2)
    if best is None:
        return ones / len(rows)
    _, f, cut = best
    return f, cut, fit_tree([r for r in rows if r[f] <= cut], depth - 1, least), fit_tree([r for r in rows if r[f] > cut], depth - 1, least)


def labelled_table() -> list[list[float]]:
    """The features of the labelled blocks, then 1 for the article and 0 for the rest."""
    table = []
    for line in LABELLED.strip().split("\n"):
        page = _MARK.sub(lambda m: " ".join(["yes" if m[1] == "+" else "no"] * int(m[2])) + m[3], line)
        table += [[*x, float("yes" in text.replace(".", "").split())] for text, x in described(page)]
    return table


@cache
def default_tree():
    return fit_tree(labelled_table())


def predict(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


# --- blocks ---------------------------------------------------------------------------------------------------------


def tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, tag in lower case, whether it is an end tag, attributes) one after the other; the last one has no tag.

    Comments, declarations and what raw elements hold come as a tag without a name or aren't returned. What isn't closed ends with the next tag or the page.
    """
    start = at = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            tag, closes, attributes = "!", False, ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            tag, closes, attributes = "!", False, ""
        elif name := _NAME.match(page, at + 1):
            end = _ATTRIBUTES.match(page, name.end()).end()
            tag, closes, attributes = name[2].lower(), bool(name[1]), page[name.end() : end]
            if end < len(page) and page[end] == ">":
                end += 1
                if tag in RAW and not closes:
                    done = _END[tag].search(page, end)
                    end = done.end() if done else len(page)
        else:  # a lone <
            at += 1
            continue
        yield page[start:at], tag, closes, attributes
        start = at = end
    yield page[start:], "", False, ""


def _about(attributes: str) -> tuple[int, bool]:
    """(hint, hidden) of an element: 1 for the article, -1 against it, 0 for neither or both names.

    A name counts by its last part (site-footer), unless it says what the element has (has-sidebar). Hidden is what has the attribute, ``aria-hidden="true"`` or ``display: none``.
    """
    if not attributes or attributes.isspace():
        return 0, False
    found, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            for name in value.lower().split():
                parts = [x for x in _PARTS.split(name) if x]
                if parts and parts[0] not in ("has", "with", "no"):
                    found.add(parts[-1])
        hidden = hidden or key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and bool(_NONE.search(value)))
    return bool(found & HINT_FOR) - bool(found & HINT_AGAINST), hidden


def blocks(page: str) -> list[tuple[str, list[float], int]]:
    """The text blocks of a page: text, [words, links, in_article, in_aside, hint, ends_sentence, heading], and the number of the container whose blocks are neighbours.

    Hidden text isn't there. Each open container knows what lies around it, so nothing is looked up in the stack.
    """
    found: list[tuple[str, list[float], int]] = []
    parts: list[str] = []
    #: tag, neighbours' number, nearest hint, inside an article, inside an aside, hidden
    stack: list[tuple[str, int, int, bool, bool, bool]] = [("", 0, 0, False, False, False)]
    opened: dict[str, int] = {}
    link = linked = made = own = 0
    heading = mute = False
    unseen: list[str] = []  # hidden inline elements that are open

    def flush() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            _, around, near, article, aside, _ = stack[-1]
            found.append((" ".join(words), [float(len(words)), min(1.0, linked / len(words)), float(article), float(aside), float(own or near), float(words[-1][-1] in ".!?…:\"”'"), float(heading)], around))
        parts.clear()
        linked = 0

    for text, tag, closes, attributes in tags(page):
        if text and not (mute or unseen or stack[-1][5]):
            text = html.unescape(text)
            parts.append(text)
            if link:
                linked += len(text.split())
        if tag == "!":
            continue
        if tag == "a":  # a link may hold blocks; it ends at its end tag, at the next link or with the container around it
            link = 0 if closes else len(stack)
        if tag in INLINE:
            if closes:
                if unseen and unseen[-1] == tag:
                    unseen.pop()
            elif tag not in VOID and (unseen and unseen[-1] == tag or _about(attributes)[1]):
                unseen.append(tag)
            continue
        flush()
        own, mute = 0, False
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading = not closes
        if tag in CONTAINERS:
            heading = False
            unseen.clear()
            if not closes and not attributes.endswith("/"):
                _, around, near, article, aside, hidden = stack[-1]
                hint, hides = _about(attributes)
                if tag not in LISTS:
                    made += 1
                    around = made
                if tag not in ("html", "body") and hint:
                    near = hint
                # the header of an article is its heading
                aside = aside or (tag in ASIDE and not (tag == "header" and article))
                stack.append((tag, around, near, article or tag in ("article", "main"), aside, hidden or hides))
                opened[tag] = opened.get(tag, 0) + 1
            elif closes and opened.get(tag):
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                if link > len(stack):
                    link = 0
        elif not closes and tag:
            own, mute = _about(attributes)
    return found


def described(page: str) -> list[tuple[str, list[float]]]:
    """The blocks of a page with all ``FEATURES``; ``around`` are the unlinked words and the link density of all blocks of the same container."""
    own = blocks(page)
    words: dict[int, float] = {}
    links: dict[int, float] = {}
    for _, x, c in own:
        words[c], links[c] = words.get(c, 0.0) + x[0], links.get(c, 0.0) + x[0] * x[1]
    out = []
    for k, (text, x, c) in enumerate(own):
        before, after = own[k - 1][1] if k else (0.0, 0.0), own[k + 1][1] if k + 1 < len(own) else (0.0, 0.0)
        out.append((text, [x[0], x[1], before[0], before[1], after[0], after[1], words[c] - links[c], links[c] / words[c], *x[2:]]))
    return out


def main_text(page: str | None, tree=None) -> str:
    """The article's blocks in page order, joined by one space. Null and empty pages give an empty text."""
    tree = default_tree() if tree is None else tree
    return " ".join([text for text, x in described(page or "") if predict(tree, x) >= 0.5])


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``: the main text of the whole page, empty if none; a column of that name is replaced.

    Null and empty pages give an empty text; repeated rows are read one by one, and an empty table gives an empty one. Broken markup is read as far as it goes: a tag without an end is ended by the next
    one or the page; an end tag without a start is skipped.
    """

    def start():
        tree = default_tree()

        def step(column):
            return [pa.array([main_text(x.as_py(), tree) for x in column], pa.string())]

        return step

    return append_columns(pages, Step([html_col], [T.StructField(out_col, T.StringType())], start))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).drop("html")
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
