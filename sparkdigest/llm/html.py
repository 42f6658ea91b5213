"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkdigest.llm.common import pick, small

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
a about after all also an and are as at be because been but by can could did do for from had has have he her his how i if in
into is it its more most no not of on one or other our she so some than that the their them then there these they this to was
we were what when which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat hatte
ich ihr im in ist ja kann mit nach nicht noch nur ob oder sein sich sie sind so über um und uns unter von vor war was wenn wer wie
wir zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou où par pas
plus pour qu que qui sa se ses si son sont sur tu un une vous
al algo como con cuando de del desde donde dos el ella ellos en entre era es esta este esto fue ha hay la las le les lo los más me
mi muy no nos o para pero por porque que se ser si sin sobre su sus también un una uno y ya yo
""".split()
)
# Length in characters, density of stop words, share of characters in links.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
LINKS_MAX = 0.2
# A page's language counts as unknown if fewer of its words are stop words. Its own frequent words take their place then: those
# that make up this share of all and occur this often; blocks need the lower densities of them. Pages of fewer words have none.
UNKNOWN, OWN_SHARE, OWN_COUNT = 0.22, 0.012, 3
OWN_LOW, OWN_HIGH, OWN_WORDS = 0.10, 0.15, 200
# Elements.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "head")
NOT_CONTENT = frozenset(["nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset"])
CONTROLS = frozenset(["button", "select", "textarea", "datalist", "output", "progress", "meter"])
SECTIONS = frozenset(["article", "main", "section", "aside", "header", "footer", "h1"])
ARTICLE = frozenset(["article", "main"])
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong
sub sup time tt u var wbr input""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role names of what is no content.
NOT_CONTENT_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies
disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted
related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo
search""".split()
)
COMMENT_NAMES = frozenset(["comment", "comments", "reply", "replies", "disqus"])
# Words that say that such a name speaks of something else: what the element has, or a part of the content.
OTHER_NAMES = frozenset(["has", "with", "without", "no", "article", "content", "entry", "post", "story", "body", "main", "page", "layout", "wrapper", "container"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]*+))?+|\"[^\"]*+\"|'[^']*+'")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A stretch of text between block tags: its text, characters in links, and where it stands."""

    text: str
    links: int
    place: tuple[int, ...]
    article: bool
    heading: bool


#: What an element's name or attributes say against its content: nothing, that it is never shown, that it is a part beside the
#: content, that its class, id or role sounds so, or that readers wrote it.
SAYS_NOTHING, HIDDEN, BESIDE, NAMED, READERS = range(5)


def _said(tag: str, attrs: str, in_article: bool) -> int:
    """What an element says against its content."""
    told = BESIDE if tag in NOT_CONTENT and not (tag == "header" and in_article) else SAYS_NOTHING
    if not attrs or tag in ("html", "body"):
        return told
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return HIDDEN
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HIDDEN
        if key in ("class", "id", "role"):
            for name in value.split():
                words = {n.lower() for n in _NAME.findall(name)}
                if words & COMMENT_NAMES and not words & OTHER_NAMES - {"post", "entry", "article"}:
                    told = max(told, READERS)
                elif tag not in ARTICLE and words & NOT_CONTENT_NAMES and not words & OTHER_NAMES:
                    told = max(told, NAMED)
    return told


def blocks(page: str) -> tuple[list[Block], dict[int, int]]:
    """The blocks of a page in order, and what elements say against theirs, by the elements' numbers. Unclosed and stray tags are
    taken as they come: an end tag closes the nearest open element of its name, or nothing; a nav that is still open where
    a section begins ends there. Text of controls is left out without breaking the block that they stand in."""
    out: list[Block] = []
    says: dict[int, int] = {}
    stack: list[tuple[str, int]] = [("", 0)]  # tag, number
    parts: list[str] = []
    count = links = breaks = articles = 0
    anchor = heading = False
    control = ""

    def close() -> None:
        nonlocal links, anchor, breaks
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, links, tuple(x[1] for x in stack), articles > 0, heading))
        parts.clear()
        links, breaks, anchor = 0, 0, False

    def say(raw: str) -> None:
        nonlocal links, breaks
        if raw and not control:
            text = entities.unescape(raw)
            parts.append(text)
            if text.strip():
                breaks = 0
                if anchor:
                    links += len("".join(text.split()))

    def leave(k: int) -> None:
        nonlocal articles
        articles -= sum(x[0] in ARTICLE for x in stack[k:])
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end = bool(m["end"] or m["end2"])
        if tag in CONTROLS or tag in ("option", "optgroup"):
            if tag in CONTROLS and (not end or tag == control):
                control = "" if end else tag
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                anchor = not end
            elif tag == "br":
                breaks += 1
                parts.append(" ")
                if breaks > 1:
                    close()
            continue
        control = ""
        close()
        if tag in VOID:
            continue
        if end:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), None)
            if k is not None:
                leave(k)
        else:
            if stack[-1][0] == "p" or tag == stack[-1][0] in ("li", "tr", "td", "dt", "dd"):
                stack.pop()
            if tag in SECTIONS:
                k = next((k for k in range(1, len(stack)) if stack[k][0] == "nav"), None)
                if k is not None:
                    leave(k)
            count += 1
            stack.append((tag, count))
            if told := _said(tag, m["attrs"] or "", articles > 0):
                says[count] = told
            articles += tag in ARTICLE
        heading = any(re.fullmatch("h[1-6]", x[0]) for x in stack[-2:])
    say(page[at:])
    close()
    return out, says


def _stop_words(found: list[list[str]]) -> tuple[frozenset[str], float, float]:
    """The stop words of a page, from the words of its blocks, and the two densities that blocks need: of a known language the
    listed ones; else the page's own most frequent words, or none needed on a page that is too short to tell."""
    n = Counter(w for words in found for w in words)
    total = sum(n.values())
    if sum(k for w, k in n.items() if w in STOP_WORDS) >= UNKNOWN * total:
        return STOP_WORDS, STOP_LOW, STOP_HIGH
    if total < OWN_WORDS:
        return frozenset(), 0.0, 0.0
    return frozenset(w for w, k in n.items() if k >= max(OWN_COUNT, OWN_SHARE * total)), OWN_LOW, OWN_HIGH


def by_density(found: list[Block]) -> list[bool | None]:
    """The first pass, each block by itself: much link text is bad; short ones and headings stay undecided, with links in them
    bad outside articles; ones of many stop words are good, middling ones if they aren't long; ones of few are bad, in an article
    undecided."""
    words = [_WORD.findall(b.text.lower()) for b in found]
    known, low, high = _stop_words([w for b, w in zip(found, words, strict=True) if b.links <= LINKS_MAX * len(b.text)])
    out: list[bool | None] = []
    for b, own in zip(found, words, strict=True):
        stops = sum(w in known for w in own) / len(own) if own else 0
        size = len(b.text)
        if b.links > (0.5 if b.article else LINKS_MAX) * size:
            out.append(False)
        elif size < LENGTH_LOW or b.heading:
            out.append(None)
        elif stops >= high or stops >= low and size <= LENGTH_HIGH:
            out.append(True)
        else:
            out.append(None if b.article or stops >= low else False)
    return out


def _overruled(found: list[Block], says: dict[int, int], first: list[bool | None]) -> set[int]:
    """Elements whose word against their content doesn't count, as no article stands outside them, and either they only sound so
    and hold more than half of the page's prose in several blocks (a wrapper named after its sidebar), or no prose is
    anywhere else. Where no block is prose, undecided ones are taken for it."""
    told = [{n for n in b.place if n in says} for b in found]
    wanted = True if True in first else None
    prose = [k for k, good in enumerate(first) if good is wanted]
    total = sum(len(found[k].text) for k in prose)
    size: Counter[int] = Counter()
    number: Counter[int] = Counter()
    for k in prose:
        size.update(dict.fromkeys(told[k], len(found[k].text)))
        number.update(told[k])
    apart = [told[k] for k, b in enumerate(found) if b.article]
    free = {n for n in size if all(n in x or any(says[y] != NAMED for y in x) for x in apart)}
    out = {n for n in free if says[n] == NAMED and 2 * size[n] > total and number[n] > 1}
    if all(told[k] - out for k in prose):
        out |= {n for n in free if says[n] in (NAMED, BESIDE)}
    return out


def classify(found: list[Block], says: dict[int, int]) -> list[bool]:
    """Which blocks are content.

    First each block by itself (by_density). What elements say against their content is a clue that makes blocks bad unless it is
    overruled; where an article holds most of the prose that is left, prose outside it is bad. Then undecided blocks
    take the label of the nearest decided block, counting only those that share the innermost common element first; at the
    same distance good wins inside an article and bad elsewhere. Where no block is good, undecided ones that
    no clue speaks against are: a page may consist of short blocks.
    """
    first = by_density(found)
    void = _overruled(found, says, first)
    against = [any(n in says and n not in void for n in b.place) for b in found]
    first = [False if bad else x for x, bad in zip(first, against, strict=True)]
    prose = [b for b, good in zip(found, first, strict=True) if good]
    if 2 * sum(len(b.text) for b in prose if b.article) > sum(len(b.text) for b in prose):
        first = [x and b.article if x else x for x, b in zip(first, found, strict=True)]
    if True not in first:
        within = any(b.article for b, x in zip(found, first, strict=True) if x is None)
        return [x is None and (b.article or not within) for b, x in zip(found, first, strict=True)]
    # the decided block before and after each one, and for an article those of the same article alone
    out = list(first)
    known = {k for k, x in enumerate(first) if x is not None and not against[k]}
    before: int | None = None
    left: list[int | None] = []
    for k in range(len(found)):
        left.append(before)
        if k in known:
            before = k
    after: int | None = None
    for k in range(len(found) - 1, -1, -1):
        if out[k] is None:
            out[k] = _inherit(found, first, k, left[k], after)
        if k in known:
            after = k
    return [bool(x) for x in out]


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _inherit(found: list[Block], first: list[bool | None], k: int, left: int | None, right: int | None) -> bool:
    near = [j for j in (left, right) if j is not None and (found[j].article == found[k].article)]
    if not near:
        return found[k].article
    best = max((_shared(found[j].place, found[k].place), -abs(j - k)) for j in near)
    labels = {first[j] for j in near if (_shared(found[j].place, found[k].place), -abs(j - k)) == best}
    return labels == {True} or found[k].article and True in labels


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by a newline; null counts as empty."""
    if not page:
        return ""
    found, says = blocks(page)
    return "\n".join(b.text for b, good in zip(found, classify(found, says), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html; text is empty if there is none.

    Pages are independent, so nothing is shuffled. Null html counts as empty; null ids and urls, repeated rows and empty
    tables pass through; further columns are ignored.
    """
    rows = pick(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            text = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
