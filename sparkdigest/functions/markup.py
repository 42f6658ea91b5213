"""Readable text, links and canonical links of HTML pages, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of a usable article, least and most; links of a mail and characters beside each.
LEAST, MOST, MOST_LINKS, NEARBY = 500, 30_000, 200, 400
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split())
# Elements and classes whose text is left out of articles, and of mails.
DROPPED = frozenset("script style noscript form nav footer aside iframe svg canvas template".split())
DROPPED_MAIL = frozenset("script style noscript form footer".split())
DROPPED_CLASSES = frozenset(["share", "sharing", "social", "advertisement", "ad"])
HEADING = re.compile("h[1-6]")
# Lines of a mail's footer, and links that lead to no article.
FOOTER_LINE = re.compile(r"(?:unsubscribe|manage preferences|privacy policy|取消訂閱)(?:\s*[|·/]\s*(?:unsubscribe|manage preferences|privacy policy|取消訂閱))*", re.I)
CONTROL_LABEL = re.compile(
    r"(?:unsubscribe(?: from (?:this|all) emails?)?|manage preferences|privacy policy|terms(?: of (?:service|use))?|view (?:this )?email"
    r"|view in browser|sign in|manage (?:your )?account|share(?: on \w+)?|follow us(?: on \w+)?|linkedin|twitter|facebook|instagram)",
    re.I,
)
MARKDOWN_LINK = re.compile(r"\[([^\]]+)\]\((https?://[^\s)]+)\)")
BARE_LINK = re.compile(r"https?://[^\s<>\"'\]]+")


class Node:
    """An element of a page: tag, attributes, children that are nodes or text."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack.extend(reversed(node.children))

    def text(self, sep: str) -> str:
        return sep.join(s for s in map(str.strip, self.strings()) if s)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.tag == "p" and tag in BLOCK and tag != "br" or tag == self.at.tag in ("li", "tr", "td", "a"):
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parsed(page: str) -> Node:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def _prune(root: Node, gone) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not gone(c)]
        stack.extend(c for c in node.children if isinstance(c, Node))


def _hidden(n: Node) -> bool:
    """By the attribute, or by a declaration of its style that doesn't show it."""
    said = {tuple(re.sub(r"\s|!important", "", d).lower().split(":", 1)) for d in n.attrs.get("style", "").split(";")}
    return "hidden" in n.attrs or not said.isdisjoint({("display", "none"), ("visibility", "hidden")})


def _lines(text: str) -> str:
    """Lines with text in them, white space inside a line as one space."""
    squeezed = [" ".join(re.split(r"[ \t]+", line.strip())) for line in text.splitlines()]
    return "\n".join(filter(None, squeezed))


def article(page: str | None) -> dict:
    """title, text, truncated and error of a page's readable article."""
    root = parsed(page or "")
    head = root.first("title")
    title = head.text(" ") if head else None
    _prune(root, lambda n: n.tag in DROPPED or _hidden(n) or not DROPPED_CLASSES.isdisjoint(n.attrs.get("class", "").split()))
    body = root.first("article") or root.first("main") or root.first("body") or root
    return {"title": title} | usable(_lines(body.text("\n")))


def usable(text: str) -> dict:
    if len(text) < LEAST:
        return {"text": None, "truncated": False, "error": "ARTICLE_NO_USABLE_TEXT"}
    return {"text": text[:MOST], "truncated": len(text) > MOST, "error": None}


def safe_link(url: str) -> str | None:
    try:
        p = urlsplit(url.strip())
        ok = p.scheme.lower() in ("http", "https") and p.hostname and not p.username and not p.password
    except ValueError:
        return None
    return urlunsplit(p._replace(scheme=p.scheme.lower(), fragment="")) if ok else None


def visible(page: str) -> Node:
    root = parsed(page)
    tiny = lambda n: n.tag == "img" and (n.attrs.get("width") in ("0", "1") or n.attrs.get("height") in ("0", "1"))
    _prune(root, lambda n: n.tag in DROPPED_MAIL or "hidden" in n.attrs or tiny(n))
    return root


def page_text(page: str | None) -> str:
    """Visible text with links as [label](url), up to the first footer line; at most one blank line between lines."""
    root = visible(page or "")
    for node in [n for n in root.walk() if n.tag == "a"]:
        label, url = node.text(" "), safe_link(node.attrs.get("href", ""))
        node.children = [f"[{label}]({url})" if label and url else label]
    kept: list[str] = []
    for line in (x.strip() for x in "\n".join(root.strings()).splitlines()):
        if FOOTER_LINE.fullmatch(line):
            break
        if line or kept and kept[-1]:
            kept.append(line)
    return "\n".join(kept).strip()


def link_candidates(plain: str | None, page: str | None, most: int | None = MOST_LINKS) -> tuple[list[dict], str | None]:
    """Links of a mail in order: anchors, Markdown links, bare links; each once, without those that only control the mail.

    A mail with more than `most` is refused. Pages have no such limit: None.
    """
    found: dict[str, dict] = {}
    beside: dict[Node, str] = {}  # the text of an element is put together once, however many links it has

    def add(url: str, anchor: str, nearby: str, kind: str) -> None:
        safe = safe_link(url)
        if safe and safe not in found and not CONTROL_LABEL.fullmatch(anchor.strip()):
            found[safe] = {"candidate_id": f"link-{len(found) + 1:04d}", "raw_url": safe, "anchor_text": anchor, "nearby_text": nearby, "position": len(found), "kind": kind}

    wanted: list[tuple] = []
    heading = ""
    for n in visible(page or "").walk():
        if HEADING.fullmatch(n.tag):
            heading = n.text(" ")
        elif n.tag == "a":
            if n.parent not in beside:
                beside[n.parent] = n.parent.text(" ")[:NEARBY] if n.parent is not None and n.parent.tag not in ("body", "html", "[document]") else ""
            around, label = beside[n.parent], n.text(" ")
            wanted.append((n.attrs.get("href", ""), label, " ".join(x for x in (heading, around) if x)[:NEARBY], "article" if label else "unknown"))
    text = plain or ""

    def line_at(at: int, url: str) -> str:
        end = text.find("\n", at)
        return text[text.rfind("\n", 0, at) + 1 : end if end >= 0 else len(text)].replace(url, "").strip(" -:()")[:NEARBY]

    wanted += [(m[2], m[1], line_at(m.start(), m[2]), "article") for m in MARKDOWN_LINK.finditer(text)]
    for m in BARE_LINK.finditer(text):
        url = m[0].rstrip(".,;:!?]}")
        while url.endswith(")") and url.count("(") < url.count(")"):
            url = url[:-1]
        wanted.append((url, line_at(m.start(), m[0]), line_at(m.start(), m[0]), "unknown"))
    for tried, one in enumerate(wanted, 1):
        if most is not None and tried > most:
            return [], "EMAIL_TOO_MANY_LINKS"
        add(*one)
    return list(found.values()), None


def canonical_link(page: str | None, url: str) -> str | None:
    """The page's own canonical link: link rel, else og:url, on the same host but for www, and not from https to http."""
    root = parsed(page or "")
    own = [n.attrs.get("href") for n in root.walk() if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split()]
    own += [n.attrs.get("content") for n in root.walk() if n.tag == "meta" and n.attrs.get("property", "").lower() == "og:url"]
    bare = lambda host: (host or "").lower().removeprefix("www.")
    for link in own:
        found = safe_link(urljoin(url, link or ""))
        if found and bare(urlsplit(found).hostname) == bare(urlsplit(url).hostname) and not (url.lower().startswith("https:") and found.startswith("http:")):
            return found
    return None


def _record(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


#: Pages that a worker holds as trees, or their texts, at once; links from which on it gives back those of fewer pages.
PAGES, LINKS = 64, 4096


def _slices(batch: pd.Series) -> Iterator[pd.Series]:
    """Stretches of a batch: Spark batches rows by their number, however long they are."""
    for at in range(0, len(batch), PAGES):
        yield batch.iloc[at : at + PAGES]


LINK = _record(candidate_id=T.StringType(), raw_url=T.StringType(), anchor_text=T.StringType(), nearby_text=T.StringType(), position=T.IntegerType(), kind=T.StringType())


@F.pandas_udf(_record(title=T.StringType(), text=T.StringType(), truncated=T.BooleanType(), error=T.StringType()))
def extract_article(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        for some in _slices(batch):
            yield pd.DataFrame([article(p) for p in some], columns=["title", "text", "truncated", "error"])


@F.pandas_udf(_record(text=T.StringType(), truncated=T.BooleanType(), error=T.StringType()))
def extract_post(posts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in posts:
        for some in _slices(batch):
            yield pd.DataFrame([usable(_lines(page_text(p))) for p in some], columns=["text", "truncated", "error"])


@F.pandas_udf(T.StringType())
def html_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        for some in _slices(batch):
            yield some.map(page_text)


@F.pandas_udf(_record(links=T.ArrayType(LINK)))
def extract_links(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """All links of a page, however many: the limit of link_candidates() is for mails."""
    for plain, page in parts:
        rows: list[list[dict]] = []
        for t, p in zip(plain, page, strict=True):
            rows.append(link_candidates(t, p, None)[0])
            if len(rows) == PAGES or sum(map(len, rows)) >= LINKS:
                yield pd.DataFrame({"links": rows})
                rows = []
        if rows:
            yield pd.DataFrame({"links": rows})


@F.pandas_udf(T.StringType())
def page_canonical(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for page, url in parts:
        yield pd.Series([canonical_link(p, u or "") for p, u in zip(page, url, strict=True)], dtype=object)
