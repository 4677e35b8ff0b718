"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. What can't be the article whatever it
says (``nav``, ``footer``, ``form``, scripts, elements whose class or id is made of
words such as "cookie notice" or "comments" alone) is left out beforehand. The first
pass classifies each block that remains by link density, stop-word density and
length. The page's own elements only weigh in: the bounds are lower within ``article``,
``main`` and the like, where a block without stop words stays open instead of bad,
and higher where a class has one such word among others. Blocks too short to tell
stay open; in the second pass they take the label of the nearest decided neighbours.
Good blocks make the text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from heapq import heappop, heappush

from pyspark.sql import DataFrame

from ledgerfold.llm._common import map_rows

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*?)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")

_RAW = frozenset("script style noscript template svg math iframe object canvas textarea title audio video select xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROPPED = frozenset("nav footer aside form menu button dialog head search label input fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An excluded one of these ends at the next block-level tag if nothing closes it.
_SHORT_LIVED = frozenset("head p li dt dd option h1 h2 h3 h4 h5 h6 label button td th tr".split())
#: What ends an element in it that nothing else closes, and what may hold an article.
_ENCLOSING = _BLOCK - frozenset("html body p".split())
_HOLDERS = frozenset("article main div section td".split())
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
#: Words of class and id names that tell what is no article.
_BAD_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox promo promoted promotion sponsor sponsored banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login nav navbar navigation "
    "navi topnav menu menus submenu breadcrumb breadcrumbs crumbs pagination pager footer foot masthead topbar toolbar sidebar aside widget widgets related "
    "recommended recommendations social share sharing sharebar comment comments commentlist disqus respond reply replies reactions "
    "discussion feedback search copyright legal disclaimer skip hidden tags trending outbrain taboola paywall".split()
)
#: Those that mean one thing in any company.
_SURE_NAME = frozenset(
    "nav navbar navigation navi topnav submenu breadcrumb breadcrumbs crumbs pagination pager masthead topbar toolbar sidebar comments commentlist disqus "
    "outbrain taboola adsense adbox newsletter gdpr popup modal signup signin login".split()
)
#: Those that an article can be about: alone in an article they only weigh.
_TOPIC_NAME = frozenset("share sharing social tags legal search copyright discussion feedback trending disclaimer promotion".split())
#: Words beside bad ones that leave the meaning of a name as it is.
_FILLER_NAME = frozenset(
    "area bar blog block body bottom box btn button buttons c col column container cta div el fixed form global group header heading hd icon icons id in info inline inner item items "
    "js l large law layout left link links list m md medium mid middle mobile module msg message n news number page panel placeholder policy posts primary r reader readers region right row secondary sec section "
    "site size slot sm small sticky strip t the thread title top ul unit user users view wp wrap wrapper x xs zone google".split()
)
_LAYOUT_NAME = frozenset("sidebar header menu nav banner notice widget footer search aside share social tags hidden related ad ads".split())
_GOOD_NAME = frozenset("content article articlebody post entry main story maincontent bodytext text prose".split())

STOP_WORDS = frozenset(
    (
        "the of and to in is it for that with on as was are be this by from at or an not have has but his her they we you he she i a "
        "which were been their its will would can could there what when who had do if all one about into than then so no more also "
        "le la les de des du un une et en est que qui dans pour par sur pas au aux avec ce se sa son ses il elle ne plus ou nous vous "
        "der die das und ist in zu den dem des mit von nicht ein eine einen als auch auf für im sich dass es er sie wir an bei nach wie "
        "el los las del y que en un una con por para es se su sus lo al como más o no le ha sin sobre este esta entre"
    ).split()
)
_NOTICE = re.compile(
    r"©|\(c\)\s*\d{4}|all rights reserved|copyright \d|(?:we|this (?:web)?site) uses? cookies|accept (?:all )?cookies|privacy policy"
    r"|terms of (?:use|service)|sign up for|subscribe to|advertisement",
    re.IGNORECASE,
)
_LETTERS = re.compile(r"[^\W\d_]+")

LOW_CHARS, HIGH_CHARS = 70, 200
LOW_STOPS, HIGH_STOPS = 0.12, 0.25
MAX_LINKS = 0.4
#: In an element that holds an article.
INSIDE_STOPS, INSIDE_LINKS = 0.06, 0.8
GOOD, BAD, OPEN, DOUBTFUL = 1, 0, -1, -2


class Block:
    """``inside`` numbers the outermost good element around the block, 0 for none; ``doubt`` tells of a doubtful one."""

    __slots__ = ("doubt", "inside", "kind", "label", "linked", "text")

    def __init__(self, text: str, linked: int, inside: int, kind: str, doubt: bool = False):
        self.text, self.linked, self.inside, self.kind, self.doubt, self.label = text, linked, inside, kind, doubt, OPEN


def _evidence(tag: str, attributes: str, in_article: bool, forms: bool = False) -> int:
    """BAD for an element to leave out, GOOD for one that holds the article, DOUBTFUL for one whose name speaks against it, else OPEN."""
    if tag in _DROPPED and not (forms and tag == "form"):
        return BAD
    if tag == "header":
        return OPEN if in_article else BAD
    names: set[str] = set()
    plain = False  # some token of a class or id says nothing else
    for m in _NAMES.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for token in value.split():
                own = set(_WORDS.findall(token))
                names |= own
                wrong = own & _BAD_NAME
                alone = bool(wrong) and own - wrong <= _FILLER_NAME | _GOOD_NAME and not (in_article and wrong <= _TOPIC_NAME)
                plain = plain or alone or not own.isdisjoint(_SURE_NAME)
        elif name == "role":
            if value in _BAD_ROLE:
                return BAD
            if value in ("main", "article"):
                names.add("main")
        elif (name == "hidden" and not m[2]) or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return BAD
    if tag in ("html", "body"):
        return OPEN
    good = names & _GOOD_NAME
    bad = names & _BAD_NAME
    if bad and not (good and bad <= _LAYOUT_NAME) and not (tag in ("article", "main") and bad <= _LAYOUT_NAME):
        return BAD if plain else DOUBTFUL
    if names & {"header", "heading"} and not good and not in_article and tag not in _HEADING:
        return BAD
    return GOOD if tag in ("article", "main") or (good and tag in ("div", "section", "td")) else OPEN


def _tokens(page: str) -> list[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of all tags; no name for comments and for raw elements, whole."""
    tokens = []
    at, n = 0, len(page)
    while m := _TOKEN.search(page, at):
        at = m.end()
        closing, tag, attributes = bool(m[1]), (m[2] or "").lower(), m[3] or ""
        if tag in _RAW and not closing:
            tag = ""
            if not (attributes.endswith("/") and m[2].lower() in ("svg", "math")):
                end = re.compile(rf"</{m[2]}\s*[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else (n if m[2].lower() in ("script", "style", "textarea", "title") else at)
        tokens.append((m.start(), at, closing, tag, attributes))
        if at >= n:
            break
    return tokens


class _Page:
    """A page's tags, and where each element ends."""

    def __init__(self, page: str):
        self.page, self.tokens = page, _tokens(page)
        self.good: list[int] | None = None
        #: Index of the own closing tag of each opening one.
        self.ends: dict[int, int] = {}
        opened: dict[str, list[int]] = {}
        for i, (_, _, closing, tag, attributes) in enumerate(self.tokens):
            if not closing:
                if tag and tag not in _VOID and not attributes.endswith("/"):
                    opened.setdefault(tag, []).append(i)
            elif opened.get(tag):
                self.ends[opened[tag].pop()] = i

    def next_good(self, i: int) -> int:
        """Index of the first tag after ``i`` of an element that holds an article."""
        if self.good is None:
            self.good = [k for k, t in enumerate(self.tokens) if t[3] in _HOLDERS and not t[2] and _evidence(t[3], t[4], False) == GOOD]
        at = bisect_right(self.good, i)
        return self.good[at] if at < len(self.good) else len(self.tokens)

    def skip(self, i: int, around: int | None, article: bool) -> tuple[int, bool]:
        """Where the skip of the excluded element of tag ``i`` ends, and whether that tag belongs to it.

        ``around`` is where the innermost enclosing element ends, ``article`` whether
        a long text of an article came before.
        """
        end = self.ends.get(i)
        if end is not None and (around is None or end < around):
            return end, True
        stop = len(self.tokens) if around is None else around
        good = self.next_good(i)
        if good < stop:
            return good, False
        # Never closed: what it would take with it is left out only if that can't be the article.
        length = (self.tokens[stop][0] if stop < len(self.tokens) else len(self.page)) - self.tokens[i][1]
        if not article and (around is None or 2 * length > len(self.page)):
            stop = next((k for k in range(i + 1, stop) if self.tokens[k][3] in _BLOCK), stop)
        return stop, False


def _cut(page: _Page, forms: bool = False, articles_end: bool = False) -> tuple[list[Block], set[str]]:
    """Blocks outside of elements that are left out, and the names of forms and articles among these.

    With ``forms``, a form is left out by its names only; with ``articles_end``, an
    article ends any skip, as ``main`` always does.
    """
    blocks: list[Block] = []
    missed: set[str] = set()
    texts: list[str] = []
    linked = breaks = 0
    link = 0
    short_lived = False
    skip_to, own_end = -1, False  # the tag that ends a skip, and whether it belongs to what is skipped
    around: list[int] = []  # ends of the open elements, as a heap
    doubtful = -1  # where the last of the open doubtful elements ends
    inside: list[int] = []  # ends of the open elements that hold an article, none beyond those before it
    articles = held = 0  # outermost ones so far, and the length of their text
    kind = ""

    def close() -> None:
        nonlocal linked, breaks, held
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            texts.clear()
            if text:
                blocks.append(Block(text, linked, articles if inside else 0, kind, at_tag <= doubtful))
                held += len(text) if inside else 0
        linked = breaks = 0

    def take(piece: str) -> None:
        nonlocal linked, breaks
        texts.append(piece)
        if link:
            linked += len(" ".join(html.unescape(piece).split()))
        if breaks and piece.strip():
            breaks = 0

    at = at_tag = 0
    for i, (start, end, closing, tag, attributes) in enumerate(page.tokens):
        at_tag = i
        while inside and inside[-1] < i:
            inside.pop()
        if start > at and i > skip_to:
            take(page.page[at:start])
        at = end
        if not tag:
            continue
        if i < skip_to:
            if not closing and tag in ("article", "main") and (articles_end or tag == "main") and _evidence(tag, attributes, False) == GOOD:
                skip_to = -1
            elif short_lived and tag in _BLOCK:
                skip_to = -1
            else:
                if not closing and tag in ("article", "main"):
                    missed.add("article")
                continue
        elif i == skip_to:
            skip_to = -1
            if own_end:
                continue
        if tag in _BLOCK:
            close()
            kind = "" if closing else tag
        elif tag == "br":
            breaks += 1
            texts.append(" ")
            if breaks > 1:
                close()
        if tag == "a":
            link = 0 if closing else 1
        if closing:
            while inside and inside[-1] <= i:
                inside.pop()
            continue
        if tag in _VOID or attributes.endswith("/"):
            continue
        sign = _evidence(tag, attributes, bool(inside), forms)
        if sign == BAD:
            close()
            while around and around[0] <= i:
                heappop(around)
            short_lived, link = tag in _SHORT_LIVED, 0
            if short_lived:
                own_end = i in page.ends
                skip_to = page.ends.get(i, len(page.tokens))
            else:
                skip_to, own_end = page.skip(i, around[0] if around else None, held >= HIGH_CHARS)
            if tag == "form":
                missed.add("form")
        elif sign == DOUBTFUL:
            doubtful = max(doubtful, page.ends.get(i, -1))
        elif sign == GOOD:
            articles += not inside
            last = page.ends.get(i, len(page.tokens))
            inside.append(min(last, inside[-1]) if inside else last)
        if tag in _ENCLOSING and i in page.ends:
            heappush(around, page.ends[i])
    if at < len(page.page) and skip_to < 0:
        take(page.page[at:])
    close()
    return blocks, missed


def _weight(blocks: list[Block]) -> int:
    classify(blocks)
    return sum(len(b.text) for b in blocks if b.label == GOOD)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks outside of elements that are left out.

    A form that holds most of the page's good text isn't left out, nor is the only
    article, in whatever it lies.
    """
    parsed = _Page(page)
    blocks, missed = _cut(parsed)
    forms = False
    if "form" in missed:
        opened, among = _cut(parsed, forms=True)
        if _weight(opened) > 2 * _weight(blocks):
            blocks, missed, forms = opened, among, True
    if "article" in missed and not any(b.inside for b in blocks):
        blocks, _ = _cut(parsed, forms, articles_end=True)
    return blocks


def stop_density(text: str) -> float:
    words = _LETTERS.findall(text)
    return sum(w.lower() in STOP_WORDS for w in words) / max(1, len(words))


def classify(blocks: list[Block]) -> None:
    """The first pass: good or bad where link density, stop words and length tell, open elsewhere."""
    for b in blocks:
        links, size = min(1.0, b.linked / len(b.text)), len(b.text)
        if b.doubt:
            # Only what reads as an article is one, in spite of its name.
            least = LOW_STOPS if b.inside else HIGH_STOPS
            b.label = GOOD if links <= MAX_LINKS and size >= (LOW_CHARS if b.inside else HIGH_CHARS) and stop_density(b.text) >= least else BAD
        elif b.inside:
            b.label = GOOD if links <= INSIDE_LINKS and size >= LOW_CHARS and stop_density(b.text) >= INSIDE_STOPS else OPEN
        elif links > MAX_LINKS or (size < HIGH_CHARS and _NOTICE.search(b.text)):
            b.label = BAD
        elif size < LOW_CHARS:
            b.label = BAD if links > 0 else OPEN
        else:
            stops = stop_density(b.text)
            if stops >= HIGH_STOPS or (stops >= LOW_STOPS and size >= HIGH_CHARS):
                b.label = GOOD
            else:
                b.label = OPEN if stops >= LOW_STOPS else BAD


def inherit(blocks: list[Block]) -> None:
    """The second pass: open blocks take the label of the nearest decided ones; a heading that of what follows.

    An open block of an article that has good ones looks at no others, so that a
    list of links at its edge isn't lost to what is around the article; where nothing
    of the page is good, it stays.
    """
    n = len(blocks)
    none = all(b.label != GOOD for b in blocks)
    articles = {b.inside: GOOD for b in blocks if b.inside and (none or b.label == GOOD)}
    before, after = [(-1, BAD)] * n, [(n, BAD)] * n
    last = (-1, BAD)
    for i, b in enumerate(blocks):
        before[i] = last
        if b.label != OPEN:
            last = (i, b.label)
    last = (n, BAD)
    for i in range(n - 1, -1, -1):
        after[i] = last
        if blocks[i].label != OPEN:
            last = (i, blocks[i].label)
    decided = []
    for i, b in enumerate(blocks):
        if b.label != OPEN:
            decided.append(b.label)
        elif b.inside in articles:
            decided.append(articles[b.inside])
        elif before[i][1] == after[i][1] or b.kind in _HEADING:
            decided.append(after[i][1])
        else:
            near = before[i] if i - before[i][0] <= after[i][0] - i else after[i]
            tie = i - before[i][0] == after[i][0] - i
            decided.append(GOOD if tie and (b.inside or len(b.text) >= LOW_CHARS // 2) else near[1])
    for b, label in zip(blocks, decided, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    if all(b.label == OPEN for b in blocks):
        return "\n\n".join(b.text for b in blocks)
    inherit(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == GOOD)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``.

    A null or empty page has an empty text, as does one without any article. Pages of any
    length are read whole, in time that grows with their length. An open block as
    near to a good neighbour as to a bad one is good in an element that holds an article and from half of
    LOW_CHARS on, else it has the label of the one before it. Rows are independent, repeated ones included, and further
    columns are ignored.
    """

    def start():
        def row(page_id, url, page):
            text = main_text(page)
            yield page_id, url, text, len(text)

        return row

    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", start)
