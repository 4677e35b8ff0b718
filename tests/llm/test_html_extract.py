import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from ledgerfold.llm import html_extract
from ledgerfold.llm._common import table

from ledgerfold.llm.html_extract import extract_pages, main_text

GOOD = "The quick brown fox was in the house and it is very nice, and that is all of it for the rest of the day."

CASES = [
    (f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{GOOD}</p></article><footer>&copy; x</footer>", f"Title\n\n{GOOD}"),
    (f"<article><p><b>One.<br><p>{GOOD}</article>", f"One.\n\n{GOOD}"),
    ("<article><p>a &amp; b &lt;i&gt; caf&eacute; &#233; &amp</p></article>", "a & b <i> café é &"),
    ('<head><title>t</title><script>var t="</p><p>x";</script><style>p{}</style></head><article>a <!-- <p>no</p> --> b\n\t c</article>', "a b c"),
    (f"<article><p>{GOOD}</p><div class='ad'>Buy now</div><form><p>sign</p><input></form><aside>x</aside><p>End.</p></article>", f"{GOOD}\n\nEnd."),
    (f"<article><p>{GOOD}</p><section id='comments'><p>{GOOD}</p></section></article>", GOOD),
    (f"<div class='cookie-notice'>{GOOD}</div><div class='post-content'><h2>T</h2><p>{GOOD}</div><div class=sidebar><p>{GOOD}</div>", f"T\n\n{GOOD}"),
    (f"<body><div><a href=1>Home</a> | <a href=2>News</a></div><h1>Big news</h1><p>{GOOD}</p><p>Yes.</p><p>{GOOD}</p><p>&copy; 2020 Foo</p>", f"Big news\n\n{GOOD}\n\nYes.\n\n{GOOD}"),
    (f"<article><p class=ad>Buy<p>{GOOD}</article>", GOOD),
    (f"<article><p title='a>b'>{GOOD}</p></article>", GOOD),
    (f"<article><p>{GOOD}", GOOD),
    ("", ""),
    ("<nav>only menus</nav>", ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_cases(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "small",
    ["<div class='text-center'>By Ann</div>", "<div class='post-title'>By Ann</div>", "<div class='entry-meta'>By Ann</div>", "<article>By Ann</article>"],
)
def test_small_good_element_leaves_the_rest_of_the_page(small):
    other = "<div><a href=1>One</a> | <a href=2>Two</a> | <a href=3>Three</a></div>"
    assert main_text(f"<body>{small}<div class='copy'><p>{GOOD}</p><p>{GOOD}</p></div>{other}</body>") == f"By Ann\n\n{GOOD}\n\n{GOOD}"


LINKED = [
    f"<h1><a href=1>Title</a></h1><p>{GOOD}</p>",
    f"<p>{GOOD}</p><p><a href=1>{GOOD}</a></p><p><a href=2>Short link</a></p><p>{GOOD}</p>",
    f"<p>{GOOD}</p><h2>References</h2><ol>" + "".join(f"<li><a href={i}>{GOOD if i % 2 else 'A title'}</a></li>" for i in range(9)) + "</ol>",
    "<p><a href=1>The whole of it</a></p>",
]


@pytest.mark.parametrize("body", LINKED)
def test_links_of_an_article_stay(body):
    text = re.sub(r"\n+", "\n\n", re.sub("<[^>]*>", "\n", body)).strip()
    around = "<div><a href=1>Home</a> | <a href=2>News</a></div>"
    assert main_text(f"<body>{around}<article>{body}</article>{around}</body>") == text


LONG = "".join(f"<p>{GOOD}</p>" for _ in range(4))
WHOLE = "\n\n".join([GOOD] * 4)
MENU = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul>"
SKIPS = [
    (f"<body><form action='x.aspx'><input type=hidden><nav>{MENU}</nav><div>{LONG}</div></form></body>", WHOLE),
    (f"<body><form><div class=ad>Buy</div><article>{LONG}</article><footer>x</footer></form></body>", WHOLE),
    (f"<article>{LONG}<form><p>{GOOD}</p></form></article>", WHOLE),
    *[(f"<body><div id=wrap><{tag}>{MENU}<article>{LONG}</article></div></body>", WHOLE) for tag in ("nav", "form", "aside", "div class='ad'", "header")],
    *[(f"<body><{tag}>{MENU}<main>{LONG}</main><footer>x</footer></body>", WHOLE) for tag in ("nav", "aside", "div class='ad'")],
    *[(f"<body><{tag}>{MENU}<div class='post-content'>{LONG}</div></body>", WHOLE) for tag in ("nav", "form", "aside")],
    *[(f"<body><div id=top><{tag}>{MENU}</div><div class='copy'>{LONG}</div></body>", WHOLE) for tag in ("nav", "aside", "form")],
    (f"<body><div id=wrap><nav>{MENU}{LONG}</div></body>", WHOLE),
    (f"<html><head><meta charset=utf-8><title>t</title><body><div>{LONG}</div></body></html>", WHOLE),
    (f"<article>{LONG}</article><section id='comments'><article class='comment'><p>{GOOD}</p></article></section>", WHOLE),
    (f"<article>{LONG}</article><aside><article><p>{GOOD}</p></article></aside>", WHOLE),
    (f"<article>{LONG}</article><section id='comments'><p>{GOOD}</p><p>{GOOD}", WHOLE),
    (f"<article>{LONG}</article><footer>{LONG}", WHOLE),
    (f"<div class='content'><div class='ad'><div>Buy</div></div>{LONG}</div><div class='ad'>{GOOD}</div>", WHOLE),
]


@pytest.mark.parametrize("page, text", SKIPS)
def test_what_ends_a_skip(page, text):
    assert main_text(page) == text


def test_many_skips_are_linear():
    for tag in ("<nav>", "<form>", "<div class=ad>", "<div><aside>", "<form></form>", "<nav></div>", "<section class=content><nav>"):
        assert main_text(tag * 20000 + f"<article><p>{GOOD}</p></article>") == GOOD


def test_many_unclosed_and_long():
    assert main_text("<div>" * 5000 + GOOD) == GOOD
    assert main_text("<article>" + f"<p>{GOOD}</p>" * 3000 + "</article>").count("\n\n") == 2999
    assert isinstance(main_text("<" * 3000 + "a" * 3000 + "<a href='" * 300), str)


NAMED = [
    (f"<p title=5\">{GOOD}</p><p class=\"x\">{GOOD}</p>", f"{GOOD}\n\n{GOOD}"),
    (f"<p title=it's>{GOOD}</p><p>{GOOD}</p><p title='x>y' id = \"a>b\">{GOOD}</p>", f"{GOOD}\n\n{GOOD}\n\n{GOOD}"),
    (f"<article><div class='share-prices-today'><p>{GOOD}</p></div></article>", GOOD),
    (f"<article><section class='tags legal'><p>{GOOD}</p></section></article>", GOOD),
    (f"<article><p>{GOOD}</p><div class='share'>Share this</div><div class='tags'><a href=1>x</a></div><p>{GOOD}</p></article>", f"{GOOD}\n\n{GOOD}"),
    (f"<article><p>{GOOD}</p></article><div class='notice'><p>{LONG}</p></div><div class='article-comments'>{LONG}</div><div id='mobile-menu'>{LONG}</div>", GOOD),
    (f"<article><p>{GOOD}</p></article><div class='right-sidebar2 teaser'>{LONG}</div><div class='google-ads'>{LONG}</div>", GOOD),
    (f"<article><h1>Title</h1><p>Zwqx zrtp.</p><p>{GOOD}</p><p>{'Zwqx zrtp qqq. ' * 20}</p></article>", f"Title\n\nZwqx zrtp.\n\n{GOOD}\n\n{('Zwqx zrtp qqq. ' * 20).strip()}"),
]


@pytest.mark.parametrize("page, text", NAMED)
def test_quotes_and_names(page, text):
    assert main_text(page) == text


class Plain(HTMLParser):
    """Blocks of simple pages: (text, characters in links, whether in an article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.texts, self.linked, self.link, self.inside = [], [], 0, False, 0

    def close_block(self):
        text = " ".join("".join(self.texts).split())
        if text:
            self.blocks.append((text, self.linked, self.inside > 0))
        self.texts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        self.close_block()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
            return
        self.close_block()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.texts.append(data)
        if self.link:
            self.linked += len(" ".join(data.split()))


def brute_text(page):
    """The two passes, from their description; at most one article a page."""
    parser = Plain()
    parser.feed(page)
    parser.close_block()
    labels = []
    for text, linked, inside in parser.blocks:
        words = re.findall(r"[^\W\d_]+", text)
        stops = sum(w.lower() in html_extract.STOP_WORDS for w in words) / max(1, len(words))
        links, label = linked / len(text), None
        if inside:
            label = "good" if links <= 0.8 and len(text) >= 70 and stops >= 0.06 else None
        elif links > 0.4 or (len(text) < 70 and linked):
            label = "bad"
        elif len(text) >= 70:
            label = "good" if stops >= 0.25 or (stops >= 0.12 and len(text) >= 200) else "bad" if stops < 0.12 else None
        labels.append(label)
    if not any(labels):
        return "\n\n".join(b[0] for b in parser.blocks)
    in_article = any(lab == "good" for lab, b in zip(labels, parser.blocks, strict=True) if b[2]) or "good" not in labels
    out = []
    for i, (text, _, inside) in enumerate(parser.blocks):
        label = labels[i]
        if label is None and inside and in_article:
            label = "good"
        elif label is None:
            before = next(((i - j, labels[j]) for j in range(i - 1, -1, -1) if labels[j]), (i + 1, "bad"))
            after = next(((j - i, labels[j]) for j in range(i + 1, len(labels)) if labels[j]), (len(labels) - i, "bad"))
            if before[1] == after[1]:
                label = before[1]
            elif before[0] == after[0]:
                label = "good" if inside or len(text) >= 35 else before[1]
            else:
                label = min(before, after)[1]
        if label == "good":
            out.append(text)
    return "\n\n".join(out)


def test_against_brute_force():
    rng = random.Random(5)
    words = "the of and in is zwqx brmf trade harbour vessel kwx une les der".split()

    def block():
        text = " ".join(rng.choice(words[: rng.choice((5, 14, 14))] if rng.random() < 0.7 else words[5:10]) for _ in range(rng.choice((2, 6, 12, 18, 30, 60))))
        kind = rng.random()
        return f"<p><a href=x>{text}</a></p>" if kind < 0.15 else f"<p>{text} <a href=x>more text</a></p>" if kind < 0.3 else f"<div>{text}</div>" if kind < 0.6 else f"<p>{text}</p>"

    for _ in range(600):
        parts = [block() for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.5:
            a, b = sorted((rng.randrange(len(parts) + 1), rng.randrange(len(parts) + 1)))
            parts[a:b] = ["<article>", *parts[a:b], "</article>"]
        page = "<body>" + "".join(parts) + "</body>"
        assert main_text(page) == brute_text(page), page


def test_both_passes_decide_blocks(spark):
    """On the driver's pages density decides most blocks, and neighbours the rest."""
    passes = Counter()
    for page in table(spark, "/root/testdata/sf0.01", "pages").collect():
        blocks = html_extract.blocks_of(page.html)
        html_extract.classify(blocks)
        passes.update("second" if b.label == html_extract.OPEN else "first" for b in blocks)
    share = passes["first"] / passes.total()
    assert 0.4 < share < 0.9, passes


def test_frame(spark):
    rows = [(1, "u", CASES[0][0], "x", 7), (1, "u", CASES[0][0], "x", 7), (2, None, None, "x", 7), (None, "v", "", "x", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = extract_pages(pages).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == sorted([("1", CASES[0][1], len(CASES[0][1]))] * 2 + [("2", "", 0), ("None", "", 0)])
    assert extract_pages(pages.where("false")).collect() == []
