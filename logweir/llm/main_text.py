"""Main text of web pages by two passes over their blocks.

The first pass decides each block by its density of stop words, its length, the share of it that is link
text, and the parts of the page that it stands in. Short blocks that this leaves open then take the label of
the nearest decided neighbours.
"""

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import arrow_map, batches_of, rows_of

GOOD, BAD, OPEN = 1, -1, 0
#: Share of link text from which a block is a list of links; in an article, and elsewhere.
LINKS_IN_ARTICLE, LINKS = 0.6, 0.33
#: Characters below which a block is short, and from which it is long.
SHORT, LONG = 70, 200
#: Shares of stop words that make a long block text, and a middling one.
STOPS_LOW, STOPS_HIGH = 0.2, 0.3
#: Share of a page's unlinked text that makes a marked article the whole of it, and an unknown language its own.
MOST = 0.5
#: Share of words that sell which makes a block without stop words an advert.
ADVERT = 0.2
#: Share of stop words that makes any but a short block text in an article; a long one below it is none.
STOPS_IN_ARTICLE = 0.05

# Common words of four languages, elements of HTML, names that page parts usually bear.
STOP_WORDS = frozenset("""
a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was we were which will with you
der die das den dem des ein eine einer und oder aber auch auf aus bei bin bist durch er es für ich im in ist mit nach nicht sich sie sind so um von vor war was wie wir zu zum zur als an dass
le la les un une des du de et ou mais au aux avec ce ces cette dans elle en est il ils je ne nous on par pas plus pour qu que qui sa se ses son sont sur vous
el los las una unos del al y o pero con como cuando donde ella ellos era es esta este fue ha hay la lo más me mi muy no nos para por porque que se ser si sin sobre su sus también te un ya
""".split())
ADVERT_WORDS = frozenset("""
buy cheap cheapest discount discounts voucher vouchers coupon coupons sale offer offers deal deals free shipping order now today premium subscribe click here save limited price prices shop online
cookies consent accept privacy policy settings newsletter
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
head header hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul
""".split())
CONTAINERS = frozenset("""
a article aside body button details dialog div dl fieldset figure footer form head header html label li main menu nav ol search section span table ul
""".split())
DROPPED = frozenset("aside button dialog footer form head menu nav search".split())
RAW = "script|style|noscript|template|svg|iframe|textarea|select|title|object|canvas|audio|video|noframes|noembed|xmp|math"
BAD_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert alerts sidebar
menu menus nav navbar navigation breadcrumb breadcrumbs share sharing social comment comments commentlist disqus replies reply respond footer related recommended recommendations subscribe
subscription newsletter signup login popup modal overlay widget widgets toolbar pagination pager skip masthead copyright toc hidden
""".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
GOOD_NAMES = frozenset("article content post entry story main maincontent articlebody postbody".split())

_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?--!?>|.*\Z)|<({RAW})\b[^>]*>(?:.*?</\1\s*[^>]*>|.*\Z)|<(/?)([a-z][^\s/>]*)"
    r"""((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[/!?a-z][^>]*(?:>|\Z)""", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[^\W\d_]+")


class Block:
    """One block: pieces of its text, how much of it is in links, and where it stands."""

    __slots__ = ("pieces", "linked", "dropped", "article", "main", "named", "heading", "card")

    def __init__(self, dropped: bool, article: bool, main: bool, named: bool, heading: bool):
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.dropped, self.article, self.main, self.named, self.heading = dropped, article, main, named, heading
        self.card = False  # inside a link that holds whole blocks


def _names(attributes: str) -> tuple[bool, bool]:
    """Whether an element's names tell of page furniture (or it is hidden), and whether of content."""
    bad = good = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            parts = [p for p in _PARTS.split(value) if p]
            bad |= not BAD_NAMES.isdisjoint(parts)
            good |= not GOOD_NAMES.isdisjoint(parts)
        elif name == "role":
            bad |= value in BAD_ROLES
            good |= value in ("main", "article")
        elif name == "style":
            bad |= bool(_HIDDEN.search(value))
        else:
            bad |= name == "hidden" or value == "true"
    return bad, good


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # element, dropped, article, main, named
    own = Block(False, False, False, False, False)
    breaks, links, at = 0, 0, 0
    wraps, said, depth = False, False, 0  # of the open link: holds blocks, has text, elements around it

    def close(heading: bool = False) -> None:
        nonlocal own, breaks
        if own.pieces:
            found.append(own)
        state = stack[-1][1:] if stack else (False, False, False, False)
        own, breaks = Block(*state, heading), 0

    def text(raw: str) -> None:
        nonlocal breaks, said
        if raw and not raw.isspace():
            own.pieces.append(raw)
            if links:
                own.linked.append(raw)
                own.card, said = own.card or wraps, True
            breaks = 0
        elif raw and own.pieces:
            own.pieces.append(" ")

    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            if m.group(1) and own.pieces:
                own.pieces.append(" ")
            continue
        tag = tag.lower()
        if m.group(2):
            if tag == "a":
                links = max(0, links - 1)
            if tag in CONTAINERS and any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
                links = 0 if len(stack) < depth else links  # a link ends with what holds it
                close() if tag in BLOCKS or tag == "span" else None
            elif tag in BLOCKS:
                close()
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                close()
            elif own.pieces:
                own.pieces.append(" ")
            continue
        if stack and stack[-1][0] == "head" and tag not in VOID:
            stack.pop()
            close()
        if tag == "a":
            links, wraps, said, depth = 1, False, False, len(stack)
            continue
        if tag in CONTAINERS and not m.group(4).endswith("/"):
            above = stack[-1] if stack else ("", False, False, False, False)
            bad, good = _names(m.group(4)) if m.group(4) else (False, False)
            if tag in ("html", "body", "main") or tag == "article" and not above[2]:
                bad = False
            if tag == "span" and not bad:
                continue
            furniture = bad or tag in DROPPED or tag == "header" and not (above[2] or above[3])
            stack.append((tag, above[1] or furniture, above[2] or tag == "article", above[3] or tag == "main", above[4] or good and not bad))
            if tag in BLOCKS:  # a link whose text has begun ends here, one around the block goes on
                wraps, links = wraps or not said, links if wraps or not said else 0
            close()
        elif tag in BLOCKS:
            wraps = wraps or bool(links) and not said
            close(tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
    text(page[at:])
    close()
    return found


def _clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def stop_share(text: str) -> float:
    """Share of stop words among the words of a block."""
    own = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in own) / max(1, len(own))


def sells(text: str) -> bool:
    """An advert or a notice by its words: hardly a stop word, and many that sell or ask for consent."""
    own = _WORDS.findall(text.lower())
    return len(own) > 0 and stop_share(text) < STOPS_IN_ARTICLE and sum(w in ADVERT_WORDS for w in own) >= ADVERT * len(own)


def label(text: str, linked: int, chosen: bool, heading: bool, card: bool = False, foreign: bool = False) -> int:
    """First pass: text, furniture or open. ``chosen`` says that the block is in the part of the page that is
    marked as its article, where more links and fewer stop words will do; ``card`` that a link holds the whole block;
    ``foreign`` that the page is in a language whose stop words are not known."""
    if card:
        return OPEN if heading else BAD
    share = linked / max(1, len(text))
    if share > (LINKS_IN_ARTICLE if chosen else LINKS):
        return OPEN if chosen and len(text) < SHORT else BAD
    if heading:
        return OPEN
    if len(text) < SHORT:
        return BAD if linked and not chosen else OPEN
    stops = stop_share(text)
    if foreign and not linked and stops < STOPS_LOW and not sells(text):
        return GOOD if chosen or len(text) >= LONG else OPEN
    if chosen:
        return GOOD if stops >= STOPS_IN_ARTICLE else BAD if len(text) >= LONG else OPEN
    if stops >= STOPS_HIGH or stops >= STOPS_LOW and len(text) >= LONG:
        return GOOD
    return OPEN if stops >= STOPS_LOW else BAD


def settled(labels: list[int], tie: int, headings: list[bool] | None = None) -> list[int]:
    """Second pass: open blocks take the label of the nearer decided neighbour, headings that of the one
    after them, and ``tie`` where two unlike ones are equally near or none is there."""
    n = len(labels)
    before, after = [(n, 0)] * n, [(n, 0)] * n
    last = (-n - 1, 0)
    for i, own in enumerate(labels):
        last = (i, own) if own else last
        before[i] = (i - last[0], last[1])
    last = (2 * n + 1, 0)
    for i in range(n - 1, -1, -1):
        last = (i, labels[i]) if labels[i] else last
        after[i] = (last[0] - i, last[1])
    out = []
    for own, (d, one), (e, two), heading in zip(labels, before, after, headings or [False] * n, strict=True):
        nearer = two if heading and two else (one if d < e else two if e < d else one if one == two else tie) if one and two else one or two or tie
        out.append(own or nearer)
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks one to a line; empty for a null page or one without an article."""
    if not page:
        return ""
    texts, found = [], []
    for b in blocks(page):
        text = _clean(b.pieces)
        if text:
            texts.append(text)
            found.append(b)
    usable = [b for b in found if not b.dropped]
    kind = next((k for k in ("article", "main", "named") if any(getattr(b, k) for b in usable)), None)
    chosen = [kind is not None and not b.dropped and getattr(b, kind) for b in found]
    linked = [len(_clean(b.linked)) if b.linked else 0 for b in found]
    plain = [0 if n or b.dropped else len(t) for b, t, n in zip(found, texts, linked, strict=True)]
    whole, held = sum(plain), sum(n for n, inside in zip(plain, chosen, strict=True) if inside)
    holds = held > 0 and held >= MOST * whole
    told = [(n, stop_share(t)) for n, t in zip(plain, texts, strict=True) if n >= SHORT and not sells(t)]
    foreign = sum(n for n, stops in told if stops < STOPS_LOW) > MOST * sum(n for n, _ in told)
    labels = []
    for b, text, n, inside in zip(found, texts, linked, chosen, strict=True):
        labels.append(BAD if b.dropped else label(text, n, inside, b.heading, b.card, foreign))
    if kind and GOOD not in labels:  # only short blocks, or only linked ones
        labels = [GOOD if inside and not b.card and n <= LINKS_IN_ARTICLE * len(text) else own
                  for b, text, n, inside, own in zip(found, texts, linked, chosen, labels, strict=True)]
    final = [BAD] * len(found)
    for inside in (True, False):  # open blocks follow neighbours on their own side of the article's bounds
        at = [i for i, own in enumerate(chosen) if own == inside]
        own = [labels[i] for i in at]
        tie = GOOD if inside or kind is None and not any(own) else BAD
        for i, one in zip(at, settled(own, tie, [found[i].heading for i in at]), strict=True):
            final[i] = one
    if holds:  # the marked article is the page's text: of it only links and adverts can be furniture, the rest is around it
        final = [(one if n or sells(t) else GOOD) if inside else BAD
                 for one, t, n, inside in zip(final, texts, linked, chosen, strict=True)]
    return "\n".join(t for t, own in zip(texts, final, strict=True) if own == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    One pass without a shuffle. A null html is an empty page; page_id and url may be null, and repeated rows
    are pages each. Broken markup is read as browsers do in the main: open elements end with what holds
    them, an open comment, script or tag goes to the end of the page.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for page_id, url, page in rows_of(batches, "page_id", "url", "html"):
                text = main_text(page)
                yield page_id, url, text, len(text)

        yield from batches_of(rows(), schema)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(own, read, "page_id long, url string, text string, n_chars long")
