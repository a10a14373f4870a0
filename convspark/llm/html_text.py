"""Main-text extraction: flat text blocks, neighbours' word counts and link densities, a decision tree.

A page is read as a flat list of text blocks (block-level tags end a block).  Each block has a
few shallow features: words and link density of itself and of its two neighbours, and the
kind of element that holds it (article, navigation or other boilerplate, by tag or class).  A
decision tree trained on the small labelled table below says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# fixed values: element kinds of HTML
RAW = {"script", "style", "noscript", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
MUTE = {"svg", "math", "select", "object", "canvas", "template"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
         "hr", "html", "label", "legend", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
         "td", "tfoot", "th", "thead", "tr", "ul", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BAD_TAGS = {"nav", "footer", "aside", "form", "button", "fieldset", "dialog", "label", "legend", "option"}
GOOD_TAGS = {"article", "main"}
KIN = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",),
       "td": ("td", "th"), "th": ("td", "th")}
# the elements that hold a page or its text are not named for what is bad
HOLDERS = {"html", "body", "main", "article"}
# a name says what an element is if all its words are among these, and one of them is not neutral
BAD_WORDS = re.compile(
    r"ads?|advert\w*|banners?|promos?|promotions?|sponsor\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|widgets?|footer|foot|"
    r"masthead|topbar|comments?|respond|reply|replies|disqus|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|"
    r"newsletters?|subscribe|subscription|signup|login|shares?|sharing|social|related|recommend\w*|more|tags?|pagination|pagers?|toolbars?|skip")
GOOD_WORDS = re.compile("article|post|entry|content|story|main|prose")
NEUTRAL = re.compile(r"list|lists|box|boxes|wrap|wrapper|container|area|section|item|items|left|right|top|bottom|primary|secondary|"
                     r"buttons?|bars?|block|blocks|inner|outer|forms?|links?|icons?|media|posts?|articles?|stories|body|text|col|row|"
                     r"group|panel|holder|header|site|page|unit|slot|message|policy|thread|area|\d+|[a-z]")
WORDS_OF_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

MARK = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
DISPLAY_NONE = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")

# the small labelled table: pages as (1 = main text, html) pieces
LABELLED = (
    ((0, "<body><nav><a href=/>Home</a> <a href=/news>News</a> <a href=/about>About us</a></nav>"),
     (0, "<header class=masthead><p>The daily paper of record since long ago</p></header>"),
     (1, "<article><h1>Rain over the valley</h1>"),
     (1, "<p>It rained for three days and the river rose by a metre, but the old bridge held and nobody was hurt.</p>"),
     (1, "<p>Short.</p>"),
     (1, "<p>The mayor said that <a href=/w>the works</a> would start in spring if the money could be found by then.</p></article>"),
     (0, "<section id=comments><h3>Comments</h3><p>I was there and the bridge did move, whatever the mayor and the paper may say.</p></section>"),
     (0, "<footer><p>Copyright the daily paper, all rights reserved, printed in the valley</p></footer></body>")),
    ((0, "<div class=ad>Buy two and pay for one only this week in every shop of ours in town</div>"),
     (1, "<main><h2>How to prune a pear tree</h2><p>Wait for a dry day in late winter, take a clean saw and look at the tree for a while.</p>"),
     (1, "<ul><li>Cut dead wood first</li><li>Then cut what crosses</li></ul>"),
     (1, "<blockquote>Less is more, as the gardeners say</blockquote></main>"),
     (0, "<aside><h4>Read next</h4><p>Five more things that you can do in the garden before the spring comes round again</p></aside>"),
     (0, "<form><label>Your name</label><p>Sign up here to get our letter once a week, free of charge and without any adverts</p></form>")),
    ((0, "<div><a href=a>One</a><a href=b>Two</a><a href=c>Three</a></div>"),
     (0, "<div>Log in</div>"),
     (1, "<div><p>A page without any helpful tag still has long runs of words that are not links, and those are the text.</p>"),
     (1, "<p>Neighbours help: a long block next to a long block is most often a part of the same story as well.</p>"),
     (1, "<p>And so it goes on until the last of the paragraphs has been read, which is this one right here.</p></div>"),
     (0, "<div><a href=x>Older stories from last week and from the week before</a> <a href=y>Newer stories and the latest ones</a></div>"),
     (0, "<div>Contact</div>")),
    ((0, "<div id=cookie-notice><p>We use cookies to make this site better for you and for the people who pay us for it</p></div>"),
     (1, "<div class=post-content><p>The bakery opens at six</p><p>Bread, <b>rolls</b> and cake are sold until noon or until nothing is left.</p>"),
     (1, "<table><tr><td>Rye</td><td>3.20</td></tr></table></div>"),
     (0, "<div class=sidebar><p>Popular this month: ten breads that you have to try before you move to another town</p></div>"),
     (0, "<div class=related-posts><p>The mill opens again after the fire of last year, says the miller of the mill</p></div>")),
    ((1, "<article><header><h1>The long walk home</h1><p>By a walker who took the road along the coast last year</p></header>"),
     (1, "<p>The road is long and the night is cold, but there is a light in the window at the end of it.</p>"),
     (0, "<div class=ad><p>Boots for every road and for every purse, now in the shop next to the old station in town</p></div>"),
     (1, "<p>Bring water.</p>"),
     (0, "<div class='share-buttons'><a href=x>Share this story with a friend</a> <a href=y>Send it by mail</a></div>"),
     (1, "<p>In the morning the sea lies to the left and the hills to the right until one comes to the gate of the town.</p>"),
     (0, "<aside>You may also like the tale of the ferry that left on time and of the man who did not take it</aside>"),
     (0, "<form><p>Write to us and tell us of your own walk, we read all letters and print some of them each month</p></form>"),
     (0, "<div class=comments><div class=comment><p>I walked it twice and never saw the sea, so I wonder which road was meant in this story</p></div>"),
     (0, "<div class=comment><p>Lovely.</p></div></div></article>"),
     (0, "<footer><p>All stories belong to those who wrote them and may be printed elsewhere with their leave, as long as the name "
         "of the paper is given with them and no word is changed by the printer</p></footer>")),
    ((0, "<body class='has-sidebar no-cookies'><nav><a href=/>Home</a> <a href=/farm>Farm</a></nav>"),
     (1, "<article class='post tag-news category-social'><h1>The ferry came back</h1>"),
     (1, "<p>After two weeks in the yard the ferry took its first cars over the sound at six in the morning.</p>"),
     (1, "<p>The captain waved.</p></article>"),
     (0, "<div class='sidebar has-widgets'><p>Ten more ferries that you have to see before the summer is over and the rain comes back</p></div>"),
     (0, "<footer><p>Printed by the sound, all rights reserved by those who wrote and drew what is in it</p></footer></body>")),
    ((0, "<nav class=menu><p>A long line of words in a menu is still a menu, even if none of the words in it is a link to a page</p></nav>"),
     (1, "<div><p>Plain text that stands alone can be long enough to be seen for what it is, the main text of a page.</p></div>"),
     (0, "<div>Top</div>"),
     (0, "<div role=alert><p>This site will be down for work on Sunday night from ten until the work is done, please plan for it</p></div>")),
    ((0, "<div><a href=1>Storm over the coast leaves many homes without light</a> <a href=2>Town hall to be painted blue, "
         "says the mayor after a long night of talks</a> <a href=3>Ferry late again</a></div>"),
     (1, "<h1>What the miller said</h1>"),
     (1, "<p>The miller said that the mill would turn again before the first snow, and that flour would be cheap by the new year.</p>"),
     (1, "<p>He smiled.</p>"),
     (1, "<p>Then he went back in and shut the door, and the wheel began to turn as if it had never stood still at all.</p>"),
     (0, "<div>Print</div>"),
     (0, "<div><a href=4>Ten mills that you should see before they close for good</a> <a href=5>Why bread is dear and what can be "
         "done about it this winter</a></div>"),
     (0, "<div>Sign in</div>")),
    ((1, "<p>We opened the shop in May with two tables, one oven and no idea of how much bread a street can eat.</p>"),
     (1, "<p>By June we had learnt it, and a third baker came to help us through the long and warm nights.</p>"),
     (1, "<p>Few slept.</p>"),
     (1, "<p>When the summer was over we counted what was left in the till and found that it was enough to go on.</p>")),
    ((0, "<p>Menu</p><p>Prices</p><p>Find us here</p>"),
     (1, "<p>The house stands at the end of the lane and has done so for three hundred years, give or take a few.</p>"),
     (1, "<h2>Rooms</h2>"),
     (1, "<p>There are six rooms with a view of the river, and two that look out on the yard and the old barn behind it.</p>"),
     (0, "<p>Book now</p><p>Terms</p><p>Privacy</p>")),
    ((0, "<p><a href=a>Back to the list of all the stories that we have printed so far in this long and wet year</a></p>"),
     (1, "<p>A clock without hands still ticks, and so did the old man who kept it in the tower above the square.</p>"),
     (1, "<p>He had wound it each night since he was a boy, and his father had done so before him for forty years.</p>"),
     (0, "<p><a href=b>Next story: what the cat saw from the roof on the night when the bells rang without a cause</a></p>"),
     (0, "<p>Page two</p>")),
    ((0, "<p>Home</p><p>Shop</p>"),
     (0, "<p><a href=c>All offers of the week at one glance</a> or <a href=d>only those that are near your town</a></p>"),
     (1, "<p>Oil the chain once a month, or once a week in winter when there is salt on the roads you ride on.</p>"),
     (1, "<p>Wipe it dry.</p>"),
     (1, "<p>Then turn the wheel by hand and listen: a good chain makes no more noise than a cat on a carpet does.</p>"),
     (0, "<p>Print this</p><p>Log out</p>")),
    ((0, "<div><p>Welcome back, dear reader, this page was made for you with care by a small team in a house by the sea</p></div>"),
     (1, "<article><h2>A word on tea</h2><p>Tea wants water that has just boiled and a pot that was warm before.</p></article>"),
     (0, "<div><p>You have read three of the five free stories of this month, after which you will have to pay for more</p></div>")),
    # a page of teasers: the elements are called articles, but hold links
    ((0, "<main><article class=teaser><a href=1>The river has gone back to its bed and the fields are dry again</a></article>"),
     (0, "<article class=teaser><a href=2>Mayor wants a new bridge, and wants it before the next winter comes</a></article>"),
     (0, "<article class=teaser><a href=3>Old mill sold</a></article>"),
     (0, "<article class=teaser><a href=4>What the ferry man saw when he looked up from his tea last night</a></article>"),
     (1, "<article><p>This week the editor walked along the river from the spring to the sea and met nine people and two dogs.</p>"),
     (1, "<p>All of them had something to say about the weather, and most of what they said was true at the time.</p></article>"),
     (0, "<article class=teaser><a href=5>Ten walks for a wet day, and one for a day without any rain</a></article></main>")),
    ((1, "<article><h1>The keeper of the clock</h1><p>He wound it each night for forty years, and never once was it late.</p>"),
     (1, "<p>When he died the clock stood still, or so they say in the town and in all the villages around it.</p>"),
     (0, "<ul><li><a href=1>More about clocks and those who keep them in good order</a></li>"),
     (0, "<li><a href=2>More about the town, its square and its tower</a></li>"),
     (0, "<li><a href=3>All stories by this writer</a></li></ul></article>")),
    # no helpful tag: short lines among short lines and links are no text, between long ones they are
    ((0, "<div>Friday edition, late city final</div><div>Weather: mild, some rain</div><div><a href=1>Front page</a> <a href=2>Sports page</a></div>"),
     (1, "<div>The council met for six hours on Thursday and agreed on one thing only, which is to meet again on Monday next.</div>"),
     (1, "<div>It was a long night.</div>"),
     (1, "<div>Three members left before the vote on the new school, and two of them did so without a word to the chair.</div>"),
     (1, "<div>The chair did not mind.</div>"),
     (1, "<div>On Monday the vote will be held first, the chair said, and the doors will be shut until it has been counted.</div>"),
     (0, "<div><a href=3>Back to the front page</a></div><div>Call us day or night</div><div>We are here for you</div>"),
     (0, "<div><a href=4>Terms that you agree to</a> <a href=5>Data that we keep</a></div><div>Made in the valley</div>")),
    ((0, "<p>Your town, your paper, since 1911</p><p>Number 88 of this year</p><p>Price: two coins</p>"),
     (1, "<p>A cow has been found on the roof of the old town hall this morning.</p>"),
     (1, "<p>The fire brigade came with a ladder that was too short for the square.</p>"),
     (1, "<p>The cow ate hay.</p>"),
     (1, "<p>By nightfall it had walked down by the inner stairs, which nobody had shut.</p>"),
     (0, "<p>Read it first with us</p><p>Ring the shop for more</p><p>Open from eight to noon</p><p>Closed on feast days</p>")),
    # long runs of words are no text where they are a comment, a notice or a legal footer
    ((1, "<article><h2>Why the lamps went out</h2><p>A swan had flown into the wires by the mill, and the whole of the upper town was dark.</p></article>"),
     (0, "<div class=comments><p>I live right beside the mill and can tell you that the swan was not hurt at all, it sat in my yard for an hour, "
         "drank from the bucket that I had put out for the dog, looked at me as if all of this had been my own fault, and then walked off "
         "down the lane to the river as though nothing had happened, which I suppose is true enough for a swan.</p></div>"),
     (0, "<div class=notice><p>We and the nine hundred partners whom we trust as much as ourselves would like to keep a few small files in your "
         "browser so that we can show you things that you have looked at before and did not buy, and if you say no we will ask you "
         "again each time that you turn the page, so you may as well say yes now and be done with it.</p></div>"),
     (0, "<footer><p>Nothing on this page may be copied, kept, read aloud or hung up in a public place without our leave in writing, which "
         "we give freely to schools and to those who ask nicely, and never to those who do not ask at all, and all names in our "
         "stories are made up unless they belong to someone who has agreed to be named in them.</p></footer>")),
    ((0, "<div>Tuesday, the third of the month, with rain in the north and some sun in the south until the late afternoon</div>"),
     (0, "<div>Our paper is free for all, and it will stay so as long as enough of you give what they can each year</div>"),
     (1, "<main><p>The bell was cast in one night.</p><p>It took forty men to lift it, and one to ring it.</p></main>"),
     (0, "<div>Made with love and a good deal of coffee in a small town on a wide river, by people who read a lot</div>"),
     (0, "<div>Up</div>")),
)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_good", "in_bad", "page_good")


class Block:
    __slots__ = ("text", "words", "linked", "good", "bad", "at")

    def __init__(self, text, words, linked, good, bad, at):
        self.text, self.words, self.linked, self.good, self.bad, self.at = text, words, linked, good, bad, at


def _kind(label: str) -> tuple[bool, bool]:
    """Whether the class, id and role names say boilerplate, and whether they say main text."""
    bad = good = False
    for name in label.split():
        words = [w.lower() for w in WORDS_OF_NAME.findall(name)]
        told = [w for w in words if BAD_WORDS.fullmatch(w)]
        bad |= bool(told) and all(w in told or NEUTRAL.fullmatch(w) for w in words)
        good |= any(GOOD_WORDS.fullmatch(w) for w in words)
    return bad, good and not bad


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, titles and hidden elements give none.

    One pass, linear in the page: a tag's attributes are read one by one (quotes count after ``=`` only), end
    tags without an open element are known by a count, and searches up the open elements look at blocks
    alone.  Tags need not be closed: an end tag closes the nearest open element of its name, and a ``p``,
    ``li``, ``dt``, ``dd``, ``option`` or table cell ends where the next one of its kind begins.  What an unclosed
    ``svg``, ``math``, ``select``, ``object``, ``canvas`` or ``template`` would hide is kept; an unclosed comment, script
    or tag hides the rest of the page, as in browsers.
    """
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = []  # element, +1 good, +1 bad, +1 mute
    held: list[int] = []  # where in the stack blocks are
    opened: dict[str, int] = {}
    last_end: dict[str, int] = {}
    good = bad = mute = 0
    in_link = False
    cdata_ends = True
    buf: list[str] = []
    linked: list[str] = []
    began, pos, n = 0, 0, len(page)

    def flush() -> None:
        if buf:
            text = SPACE.sub(" ", "".join(buf)).strip()
            buf.clear()
            if text:
                words = text.count(" ") + 1
                link_words = len(" ".join(linked).split())
                out.append(Block(text, words, min(1.0, link_words / words), good > 0, bad > 0, began))
            linked.clear()

    def close(k: int) -> None:
        nonlocal good, bad, mute, in_link
        for name, g, b, m in stack[k:]:
            good -= g
            bad -= b
            mute -= m
            opened[name] -= 1
            in_link &= name != "a"
        del stack[k:]
        while held and held[-1] >= k:
            held.pop()

    def nearest(name: str) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                return k
        return -1

    while pos < n:
        m = MARK.search(page, pos)
        stop = m.start() if m else n
        if stop > pos and not mute:
            raw = page[pos:stop]
            text = html.unescape(raw) if "&" in raw else raw
            if not buf:
                began = pos
            buf.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        pos = m.end()
        if m[1]:
            end = pos if page.startswith((">", "->"), pos) else page.find("-->", pos)
            pos = n if end < 0 else page.find(">", end) + 1
            continue
        if m[2] or m[3]:
            end = page.find("]]>", pos) if m[2] and cdata_ends else -1
            cdata_ends &= not m[2] or end >= 0
            end = page.find(">", pos if end < 0 else end)
            pos = n if end < 0 else end + 1
            continue
        name, label, hidden, href = m[5].lower(), "", False, False
        while pos < n:
            if page[pos] == ">":
                pos += 1
                break
            t = ATTRIBUTE.match(page, pos)
            if not t:  # white space or slashes up to the end of the page
                pos = n
                break
            pos = t.end()
            if t[1]:
                break
            key = t[2].lower()
            if key in ("class", "id", "role"):
                label += " " + (t[3] or t[4] or (t[5] or "").strip("\"'"))
            elif key == "href":
                href = True
            elif key == "hidden" or key == "style" and DISPLAY_NONE.search(t[3] or t[4] or t[5] or ""):
                hidden = True
        else:
            break
        if page[pos - 1] != ">":
            break  # the page ends inside a tag
        if m[4]:
            if name in BLOCK and not mute:
                flush()
            if opened.get(name):
                close(nearest(name))
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, pos)
            pos = end.start() if end else n
            continue
        if mute and name in BLOCK and name != "option":  # a block ends a drawing, a formula and a choice
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][3]:
                    if stack[k][0] in ("svg", "math", "select"):
                        close(k)
                    break
        if name in VOID:
            if name == "hr":
                flush()
            elif not mute:
                buf.append(" ")
                if len(buf) == 1:
                    began = stop
            continue
        if name in MUTE:
            if name not in last_end:
                ends = re.finditer(f"</{name}(?=[\\s/>])", page, re.I)
                last_end[name] = max((x.start() for x in ends), default=-1)
            if last_end[name] < pos or page[pos - 2] == "/":
                continue
        if name in BLOCK and not mute:
            flush()
        if held and name in BLOCK and name != "option" and stack[held[-1]][0] == "option":
            close(held[-1])
        kin = KIN.get(name)
        if kin and any(opened.get(x) for x in kin):
            for k in reversed(held):
                if stack[k][0] in kin:
                    close(k)
                    break
                if stack[k][0] != "p":
                    break
        g, b = int(name in GOOD_TAGS), int(name in BAD_TAGS or hidden)
        if label:
            named_bad, named_good = _kind(label)
            b |= name not in HOLDERS and named_bad
            g |= named_good and not b
        if name == "header" and not good:
            b = 1
        if name == "a":
            in_link = href
        good += g
        bad += b
        mute += name in MUTE
        if name in BLOCK:
            held.append(len(stack))
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, g, b, int(name in MUTE)))
    flush()
    return out


def features(bs: list[Block]) -> np.ndarray:
    own = np.array([[b.words, b.linked] for b in bs], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    return np.hstack([own, np.vstack([none, own])[:-1], np.vstack([own, none])[1:],
                      np.array([[b.good, b.bad] for b in bs], float).reshape(-1, 2),
                      np.full((len(bs), 1), float(any(b.good for b in bs)))])


LEAST = 3


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A binary decision tree by Gini impurity: ``(feature, bound, left, right)`` or a label.
    No side of a split has fewer than ``LEAST`` rows."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        vals = np.unique(x[:, f])
        for bound in (vals[1:] + vals[:-1]) / 2:
            left = x[:, f] <= bound
            if min(left.sum(), (~left).sum()) < LEAST:
                continue
            gini = sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in (y[left], y[~left]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(bound), left)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, bound, left = best
    low, high = grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)
    return low if low == high and isinstance(low, int) else (f, bound, low, high)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), bool(tree))
    f, bound, low, high = tree
    left = x[:, f] <= bound
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(low, x[left]), classify(high, x[~left])
    return out


@lru_cache(maxsize=1)
def trained():
    """The tree of the labelled table; a page as a whole gives the neighbours of its pieces."""
    xs, ys = [], []
    for pieces in LABELLED:
        bs = blocks("".join(h for _, h in pieces))
        ends = np.cumsum([len(h) for _, h in pieces])
        ys += [pieces[int(np.searchsorted(ends, b.at, side="right"))][0] for b in bs]
        xs.append(features(bs))
    return grow(np.vstack(xs), np.array(ys))


def main_text(page: str) -> str:
    bs = blocks(page)
    if not bs:
        return ""
    keep = classify(trained(), features(bs))
    return "\n".join([b.text for b, k in zip(bs, keep) if k])


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The columns of ``pages`` but the html (and any column called ``out_col``), plus the main text.

    Null and empty html give an empty text; a page is read whole, whatever its length.
    """
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = pages.select(*keep).schema.add(out_col, "string")

    def run(batches):
        for b in batches:
            texts = [main_text(p) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return pages.select(*keep, text_or_empty(html_col).alias("__html")).mapInArrow(run, schema)
