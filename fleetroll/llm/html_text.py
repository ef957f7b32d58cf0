"""Main text of web pages by two passes over their blocks.

The first pass classifies blocks by stop-word density, length, link density and the part of the page they stand in. The second
pass settles what is ambiguous (short blocks, headings, texts of middling density): they inherit the label of the nearest
decided blocks of their part of the page. Parts are an article or main element, a menu, a footer and so on.

The stop words are English, French, German and Spanish. Where no block of a page is prose by them, length and share of link text
decide instead. An element named after an article excludes the rest of the page only if prose stands in such an element, or
longer blocks do and no prose stands elsewhere.

Null html has no blocks, so its text is empty. Malformed html is read as far as it goes: end tags that fit nothing are skipped,
elements left open end with their parent, an unfinished comment or script runs to the end, a tag with over 200 quoted attributes
ends at its first ``>``. Time grows with the length of a page, whatever it holds. Rows that repeat are extracted one
by one; rows are never joined, so null or repeated page ids do no harm. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common words of the languages the rules know, and names that tell what an element holds.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be because been but by can could do for from had has have he her his i if in
    into is it its more no not of on one or other our out she so some than that the their them then there these they this to
    up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui mais me même mes mon
    ne nos notre nous on ont ou par pas plus pour qu que qui sa sans se ses si son sont sur ta te tes tu un une vous
    als am an auch auf aus bei bis da das dass dem den der des die doch du ein eine einem einen einer eines er es für hat
    ich ihr im ist ja kann mit nach nicht noch nur oder sehr sich sie sind so über um und uns unter vom von vor war was wenn
    wie wird wir zu zum zur
    al algo como con cual cuando del desde donde el ella ellos entre era es esta este fue ha hasta la las lo los mas más mi
    muy nada no nos o para pero por porque que qué se sin sobre su sus también te tiene todo tu uno y ya""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike
    strong sub sup time tt u var""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
OUTSIDE = frozenset(
    """head nav aside footer form button select dialog menu noscript template svg object canvas audio video fieldset
    datalist math applet""".split()
)
OUTSIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner sidebar
    menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended
    recommendations widget toolbar comment comments commentlist respond disqus discussion reply replies copyright disclaimer
    pagination pager searchbox skip skiplink hidden aside outbrain taboola paywall""".split()
)
CONTENT_NAMES = frozenset("article articlebody content maincontent post postbody entry story storybody main".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "dialog": -1, "alert": -1,
         "main": 1, "article": 1}

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+){0,200}+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
#: What still is markup where no ``>`` follows any more: it runs to the end.
UNENDED = re.compile(r"<!--|<!\[CDATA\[|<[!?]")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LETTERS = re.compile(r"[^\W\d_]+")

#: Shares of stop words from which a block is prose, or may be; share of link text from which it is a menu.
DENSE, FAIRLY_DENSE, LINKED = 0.32, 0.30, 0.5
#: Share of link text up to which a long block may be prose where no block has enough stop words.
FEW_LINKS = 0.2
#: Code points: below the first a block is short, from the second on a dense one is prose on its own.
SHORT, LONG = 70, 200

BLOCKS = "array<struct<text: string, kept: boolean, first: string>>"


def _zone(tag: str, attributes: str, inside: int) -> int:
    """-1 where an element is not the article, 1 where it is one, 0 where it says nothing."""
    names: set[str] = set()
    zone = 0
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for word in value.replace("_", "-").split():
                parts = [x.lower() for x in NAME.findall(word)]
                names.update(parts)
                names.add("".join(parts))
        elif key == "role":
            zone = ROLES.get(value.strip().lower(), zone)
        elif key == "style":
            zone = -1 if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else zone
        elif key == "hidden" or value.strip().lower() == "true":
            zone = -1
    if tag in ("html", "body"):
        return 0
    if tag in OUTSIDE or names & OUTSIDE_NAMES or zone < 0:
        return -1
    if (tag == "header" or "header" in names) and inside != 1:
        return -1
    return 1 if tag in CONTENT or zone > 0 or names & CONTENT_NAMES else 0


class _Open:
    """The open elements, with what the rules ask of them at hand, so that no tag walks through all of them."""

    def __init__(self):
        self.stack: list[tuple[str, int, int]] = []  # tag, zone, part
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # by tag
        self.containers: list[int] = []  # places of what is no inline element
        self.outside = 0  # elements outside the article, but for forms

    def push(self, tag: str, zone: int, part: int) -> None:
        self.places[tag].append(len(self.stack))
        if tag not in INLINE:
            self.containers.append(len(self.stack))
        self.outside += zone < 0 and tag != "form"
        self.stack.append((tag, zone, part))

    def close(self, tag: str) -> bool:
        """Closes the innermost element of that tag with all inside it; False where none is open."""
        if not self.places[tag]:
            return False
        down_to = self.places[tag][-1]
        while len(self.stack) > down_to:
            name, zone, _ = self.stack.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.containers.pop()
            self.outside -= zone < 0 and name != "form"
        return True

    def beside(self, tag: str) -> bool:
        """An element of that tag is open, and no container stands between."""
        places = self.places[tag]
        return bool(places) and places[-1] >= (self.containers[-1] if self.containers else 0)

    def top(self) -> tuple[int, int]:
        """Zone and part."""
        return self.stack[-1][1:] if self.stack else (0, 0)


def _blocks(html: str) -> list[tuple[str, int, int, bool, float]]:
    """(text, zone, part, heading, share of link text) of every block with text, in page order."""
    elements = _Open()
    zone, part, parts, links = 0, 0, 0, 0
    pieces: list[str] = []
    linked: list[str] = []
    found: list[tuple[str, int, int, bool, float]] = []
    heading = False

    def end_block() -> None:
        nonlocal heading
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            inside = len(" ".join(unescape("".join(linked)).split()))
            found.append((text, zone, part, heading, inside / len(text)))
        pieces.clear(), linked.clear()
        heading = False

    at, size, last = 0, len(html), html.rfind(">")
    while at < size:
        m = (TOKEN if at <= last else UNENDED).search(html, at)
        text = html[at : m.start() if m else size]
        if text:
            pieces.append(text)
            if links:
                linked.append(text)
        if not m or at > last:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            end_block()
        if closing:
            if elements.close(tag):
                zone, part = elements.top()
                links = len(elements.places["a"])
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at) if at <= last else None
                at = end.end() if end else size
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in ("p", "li", "a", "option", "tr", "td", "th", "dt", "dd") and elements.beside(tag):
            elements.close(tag)  # these end an open one of their kind
            zone, part = elements.top()
            links = len(elements.places["a"])
        own = _zone(tag, attributes, zone)
        if zone < 0 and not (own > 0 and tag in CONTENT and not elements.outside):
            own = 0  # what stands outside the article stays outside, but for an article in a page-wide form
        if own and own != zone:
            zone, parts = own, parts + 1
            part = parts
        elements.push(tag, zone, part)
        links += tag == "a"
        heading = heading or tag in HEADINGS
    end_block()
    return found


GOOD, BAD, MAYBE, SMALL = "good", "bad", "maybe", "short"


def _first_pass(text: str, zone: int, heading: bool, link_share: float) -> str:
    if zone < 0 or link_share > LINKED:
        return BAD
    words = LETTERS.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if heading or len(text) < SHORT:
        return SMALL if zone > 0 or not link_share else BAD
    if zone == 0 and "\xa9" in text:
        return BAD
    if density >= DENSE:
        return GOOD if len(text) >= LONG else MAYBE
    return MAYBE if density >= FAIRLY_DENSE or zone > 0 else BAD


def _by_length(label: str, block: tuple[str, int, int, bool, float]) -> str:
    """The label of a block on a page without known stop words."""
    text, zone, _, heading, link_share = block
    if zone < 0 or heading or len(text) < SHORT or link_share > FEW_LINKS or zone == 0 and "\xa9" in text:
        return label
    return GOOD if len(text) >= LONG else MAYBE


def main_blocks(html: str | None) -> list[dict]:
    """All blocks of a page with their verdicts."""
    found = _blocks(html) if html else []
    first = [_first_pass(t, zone, h, share) for t, zone, _, h, share in found]
    if GOOD not in first:  # no prose in a known language: length and links have to tell
        first = [_by_length(label, b) for label, b in zip(first, found)]
    inside, rest = ({label for label, b in zip(first, found) if (b[1] > 0) == named} for named in (True, False))
    if GOOD in inside or MAYBE in inside and GOOD not in rest:  # the page names its article: the rest of it is not
        first = [label if b[1] else BAD for label, b in zip(first, found)]
        found = [(t, zone or -1, part, h, share) for t, zone, part, h, share in found]
    kept = [label == GOOD for label in first]
    decided = [k for k, label in enumerate(first) if label in (GOOD, BAD)]
    before: int | None = None
    after = iter(decided)
    following = next(after, None)
    for k, label in enumerate(first):
        while following is not None and following < k:
            following = next(after, None)
        if label in (GOOD, BAD):
            before = k
            continue
        same = [n for n in (before, following) if n is not None and found[n][2] == found[k][2]]
        zone = found[k][1]
        if not same:
            kept[k] = zone > 0 or label == MAYBE
        elif len({first[n] for n in same}) == 1:
            kept[k] = first[same[0]] == GOOD
        elif label == MAYBE or zone > 0:
            kept[k] = True
        else:
            nearest = min(same, key=lambda n: (abs(n - k), n < k))
            kept[k] = first[nearest] == GOOD
    return [{"text": b[0], "kept": keep, "first": label} for b, keep, label in zip(found, kept, first)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and ``blocks``: every block's text, whether it belongs to the main text, its label after the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("kept", pa.bool_()), ("first", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                blocks = pa.array([main_blocks(h) for h in some.column("html").to_pylist()], kind)
                yield pa.record_batch([some.column("page_id"), some.column("url"), blocks], ["page_id", "url", "blocks"])

    columns = [F.col("page_id").cast("bigint").alias("page_id"), *[F.col(c).cast("string").alias(c) for c in ("url", "html")]]
    return pages.select(*columns).mapInArrow(run, f"page_id bigint, url string, blocks {BLOCKS}")


def main_text(blocks: Column | str) -> Column:
    """The kept blocks in page order with one space between."""
    kept = F.filter(blocks, lambda b: b["kept"])
    return F.array_join(F.transform(kept, lambda b: b["text"]), " ")
