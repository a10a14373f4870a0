from convspark.llm.html_text import LABELLED, blocks, extract_text, main_text
from convspark.llm.queries import op5_html_text

from ..conftest import SF_SMALL


def test_labelled_table_is_learnt():
    right = total = 0
    for pieces in LABELLED:
        page = "".join(h for _, h in pieces)
        want = [b.text for b in blocks(page) if pieces[[b.at < e for e in _ends(pieces)].index(True)][0]]
        got = main_text(page).split("\n")
        total += len(blocks(page))
        right += len(blocks(page)) - len(set(want) ^ set(got))
    assert right >= 0.95 * total


def _ends(pieces):
    out, at = [], 0
    for _, h in pieces:
        at += len(h)
        out.append(at)
    return out


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-banner"><p>We use cookies on this page for one reason or for another, so please say yes</p></div>
<article><h1>Caf&eacute; &amp; bar</h1><!-- <p>hidden</p> --><p>First  <b>bold
</b>line<br>goes&nbsp;on.<p>Second, <a href="x>y">linked</a>.</p><ul><li>one<li>two</ul>
<form><p>Type here and press the button when you are done with it all</p><textarea>t</textarea></form>
<div class="comments"><p>I liked this a lot and would read it again if I had the time.</p></div></article>
<aside><p>Other things that you might want to read when you are done with this one here</p></aside><footer>&copy; x</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "Café & bar\nFirst bold line goes on.\nSecond, linked.\none\ntwo"


def test_plain_page_without_helpful_tags():
    page = ("<div><a href=1>Home</a> <a href=2>News</a></div><p>" + "Words and more words make a long line of text. " * 4
            + "</p><p>Short one.</p><p>" + "Again a long line of text that is not a link. " * 4 + "</p><div>Print</div>")
    lines = main_text(page).split("\n")
    assert len(lines) == 3 and lines[1] == "Short one."


def test_odd_pages():
    for page in ("", "<", "<p", "<!--", "<script>", "</p></p>", "a & b", "<p>&#0;&#x110000;&bogus;</p>", "<a" * 50, "<p>" * 3000, "İ<script>x</script>"):
        assert isinstance(main_text(page), str)
    assert main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash", 1), (2, None, None, "c", 2), (2, "u", "", "c", 3), (None, "u", PAGE, "c", 4)],
                               "page_id long, url string, html string, text string, words int")
    out = extract_text(df)
    assert out.columns == ["page_id", "url", "words", "text"]
    assert [r["text"] for r in out.orderBy("words").collect()] == [main_text(PAGE), "", "", main_text(PAGE)]
    assert extract_text(df.limit(0)).collect() == []


def test_whole_table(spark):
    rows = op5_html_text(spark, SF_SMALL).collect()
    assert rows and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    assert not any("©" in r["text"] or "track(" in r["text"] for r in rows)


def test_states_and_names_of_holders_are_not_boilerplate():
    text = "<h1>Rain</h1><p>It rained for three days and the river rose by a metre, but the old bridge held.</p><p>Short.</p>"
    want = "Rain\nIt rained for three days and the river rose by a metre, but the old bridge held.\nShort."
    for page in (f"<body class='has-sidebar'><article>{text}</article></body>", f"<article class='post tag-news'>{text}</article>",
                 f"<main id=main class='side nav-open'>{text}</main>", f"<div class='content no-comments'>{text}</div>"):
        assert main_text(page) == want
    for label in ("sidebar has-widgets", "cookie-notice", "tags"):
        assert main_text(f"<article>{text}<div class='{label}'><p>Other things that you might want to read when you are done</p></div></article>") == want


LONG = "It rained for three days and the river rose by a metre, but the old bridge held."


def test_names_inside_longer_names_mean_nothing():
    text = f"<h1>Rain</h1><p>{LONG}</p><p>Short.</p>"
    want = f"Rain\n{LONG}\nShort."
    for label in ("side-by-side", "social-history", "alert-systems", "relatedness", "menu-planning article", "sharing-economy story"):
        assert main_text(f"<div class='{label}'><article>{text}</article></div>") == want
    for label in ("cookie-notice", "cookieNotice", "share-buttons", "related_posts", "sidebar-left", "ad-slot-3", "comments"):
        assert main_text(f"<article>{text}<div id={label}><p>{LONG}</p></div></article>") == want


def test_attributes_and_unclosed_elements():
    for page in (f"<article><p title=don't>{LONG}</p></article>", f"<article><p title='a > b' data-x=\"<p>\">{LONG}</p></article>",
                 f"<article><svg><path d=1><p>{LONG}</p></article>", f"<article><object><p>{LONG}</p></article>",
                 f"<article><canvas><p>{LONG}", f"<article><math><p>{LONG}</p>", f"<article><select><option>no<p>{LONG}",
                 f"<article><a name=x><p>{LONG}</article>", f"<article><svg><title>no</title><text>no</text></svg><p>{LONG}</p>",
                 f"<article><template><p>no</p></template><p>{LONG}<![CDATA[no]]></p>", f"<article><p>{LONG}</p><p title='no",
                 f"<article><p a=\"b>{LONG}</p></article>".replace('a="b', "a=b"), f"<article><p hidden>no</p><p style='display : none'>no</p><p>{LONG}"):
        assert [b.text for b in blocks(page)] in ([LONG], ["no", LONG], ["no", "no", LONG]), page
        assert main_text(page) == LONG, page


def test_hostile_pages_are_linear():
    import time
    n = 200_000
    pages = ["<a " * n, "<i>" * n + "</b>" * n, "<a b=\"" * n, "<ul><li><div>" + "<b>" * n + "<li></li>" * n, "<![CDATA[>" * n, "<svg>" * n,
             "<!-- " * n, "<a " + " " * n, "<div>" * n + "x" + "</div>" * n, "<p title=don't>x</p>" * n, "</p>" * n, "<" * n, "&" * n,
             "<object>" * n + "</object>", "<script>" * n, "<p>" + "word " * (10 * n)]
    for page in pages:
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 2 + len(page) / 400_000, page[:30]


class _Reader(__import__("html.parser").parser.HTMLParser):
    """Blocks of well-formed pages by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.buf, self.links, self.path = [], "", "", []

    def cut(self):
        text = " ".join(self.buf.split())
        if text:
            words = len(text.split())
            self.out.append((text, words, min(1.0, len(self.links.split()) / words)))
        self.buf = self.links = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "li", "ul", "article", "h1", "td", "tr", "table"):
            self.cut()
        if tag == "br":
            self.buf += " "
        else:
            self.path.append(tag)

    def handle_endtag(self, tag):
        if tag in ("p", "div", "li", "ul", "article", "h1", "td", "tr", "table"):
            self.cut()
        self.path.pop()

    def handle_data(self, data):
        if "script" not in self.path:
            self.buf += data
            if "a" in self.path:
                self.links += " " + data


def _grown(rng, depth=0):
    if depth > 3 or rng.random() < 0.3:
        return " ".join(rng.choice(["word", "a&amp;b", "&eacute;t&eacute;", "x", "1 &lt; 2", "<br>", "<b>bold</b>", "<a href='q>r'>link me</a>",
                                    "<!-- <p>no --> ", "<script>if (a<b) c('<p>')</script>"]) for _ in range(rng.randint(1, 6)))
    tag = rng.choice(["p", "div", "ul", "article", "h1", "table"])
    inner = "" if tag in ("p", "h1") else "".join(_grown(rng, depth + 1) for _ in range(rng.randint(1, 3)))
    if tag in ("p", "h1"):
        inner = _grown(rng, 9)
    if tag == "ul":
        inner = "".join(f"<li class=\"k{k}\">{_grown(rng, 9)}</li>\n" for k in range(2))
    if tag == "table":
        inner = "<tr>" + "".join(f"<td>{_grown(rng, 9)}</td>" for _ in range(2)) + "</tr>"
    return f"<{tag}>{inner}</{tag}>"


def test_blocks_are_those_of_the_standard_parser():
    import random
    rng = random.Random(11)
    for _ in range(300):
        page = "<div>" + "".join(_grown(rng) for _ in range(rng.randint(1, 5))) + "</div>"
        r = _Reader()
        r.feed(page)
        r.close()
        r.cut()
        assert [(b.text, b.words, round(b.linked, 9)) for b in blocks(page)] == [(t, w, round(x, 9)) for t, w, x in r.out], page


# pages that the tree has not seen: (1 = main text, html) pieces
HELD_OUT = (
    # div soup without a name, with link lists
    ((0, "<div><a href=1>Home</a> | <a href=2>Recipes</a> | <a href=3>Contact</a></div>"),
     (1, "<div>Soak the beans overnight in cold water, then drain them and put them in a pot with an onion and two cloves.</div>"),
     (1, "<div>Salt comes last.</div>"),
     (1, "<div>Cook them slowly until they are soft, which takes an hour and a half if they are fresh and much longer if not.</div>"),
     (0, "<div><a href=4>More soups for cold days</a> <a href=5>More beans for every taste and purse</a></div><div>Print recipe</div>")),
    # an article among named boilerplate
    ((0, "<div id=topbar><p>Free delivery on all orders above twenty coins until the end of the month, terms apply as ever</p></div>"),
     (1, "<div class=entry-content><h1>Notes on glue</h1><p>Hide glue is warm, brown and forgiving; it lets go when you ask it to.</p><p>It smells.</p></div>"),
     (0, "<div class='widget recent-posts'><ul><li><a href=1>Notes on nails</a></li><li><a href=2>Notes on saws</a></li></ul></div>"),
     (0, "<div class=newsletter-signup><p>Get one note a week by mail, never more than one, and leave whenever you have had enough of them</p></div>")),
    # a page of links around one lead
    ((0, "<ul><li><a href=1>Rates fall again</a></li><li><a href=2>Harvest is late</a></li><li><a href=3>Two ships collide in fog</a></li></ul>"),
     (1, "<main><p>The committee published its report on the bridge this morning, four years after the first hearing was held in the town hall.</p>"),
     (1, "<p>It has nine hundred pages and one map.</p></main>"),
     (0, "<section class=comments><p>Four years for one map, and they say that the state has no sense of humour left in it these days</p></section>"),
     (0, "<footer><p>Bridge Gazette, founded by ferrymen</p></footer>")),
)


def test_held_out_pages():
    right = total = 0
    for pieces in HELD_OUT:
        page = "".join(h for _, h in pieces)
        keep = set(main_text(page).split("\n"))
        for b in blocks(page):
            want = pieces[[b.at < e for e in _ends(pieces)].index(True)][0]
            right += (b.text in keep) == bool(want)
            total += 1
    assert right >= 0.9 * total


def test_neighbours_decide_without_names():
    lines, long = ["Open day and night"], LONG + " The miller said so, and so did the man who sold the bread."

    def page(xs):
        return "".join(f"<div>{x}</div>" for x in xs)
    assert main_text(page([long, lines[0], long])).split("\n")[1] == lines[0]  # between long blocks
    assert lines[0] not in main_text(page([long, long, "Prices", lines[0], "Prices"]))  # among short ones
    assert main_text(page([f"<a href=x>{long}</a>", long, long])) == f"{long}\n{long}"  # a link is none
