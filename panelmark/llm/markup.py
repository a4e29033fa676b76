"""Blocks of text of an HTML page with the elements they stand in. A scanner, not a browser:
it knows which elements break text into blocks, which end tags may be left out, and which
elements hold no text for readers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select head title".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button".split()
)
#: Elements that a start tag of the same group ends, up to the nearest of the elements named.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
#: Elements, and words of class, id and role, of what surrounds an article.
AROUND = frozenset("nav aside footer form button dialog menu".split())
AROUND_WORDS = frozenset(
    "ad ads advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disclaimer "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion "
    "recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that say nothing of what an element with them holds.
PART_WORDS = frozenset("area bar block box button buttons container form group inner item items link links list outer panel section slot unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element stands in: an article, one named as around it, one that is around by its kind or hidden.
INSIDE, NAMED, AROUND_IT = 0, 1, 2
MAIN_WORDS = frozenset("article content entry main post story".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Za-z]+")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def digest(text: str) -> int:
    """A signed 64-bit fingerprint."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@dataclass
class Element:
    """An open element that breaks blocks."""

    name: str
    path: str
    around: int
    article: int  # the outermost article or main element it stands in, -1 outside
    parents: list[int] = field(default_factory=list)  # indices of the paths above it and its own
    loose: tuple[int, ...] = ()  # those of them whose name has a word of what stands around, below the article's start


@dataclass
class Page:
    paths: list[str] = field(default_factory=list)  # each distinct path once
    uses: list[int] = field(default_factory=list)  # how often an element with it was opened
    chars: list[int] = field(default_factory=list)  # characters of text outside links below it
    blocks: list[tuple] = field(default_factory=list)  # (path index, around: INSIDE, NAMED or AROUND_IT, article, text, characters in links, parents, loose)


def _marks(attributes: str) -> tuple[str, list[set[str]], set[str], bool]:
    """(class and id as part of a path, the words of each of their names and the role's, those of the id, hidden)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    shown = "".join(f"{sign}{re.sub('[0-9]+', '0', ' '.join(found[k].split()))}" for sign, k in ((".", "class"), ("#", "id")) if found.get(k))
    names = [{w.lower() for w in _WORD.findall(name)} for k in ("class", "role") for name in found.get(k, "").split()]
    own = {w.lower() for w in _WORD.findall(found.get("id", ""))}
    return shown, names, own, "hidden" in found or found.get("aria-hidden") == "true"


def scan(html: str) -> Page:
    page, index = Page(), {}
    stack: list[Element] = [Element("", "", INSIDE, -1, [])]
    text: list[str] = []
    links, in_link, articles, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                top = stack[-1]
                page.blocks.append((top.parents[-1] if top.parents else -1, top.around, top.article, words, links, top.parents, top.loose))
                for p in top.parents:
                    page.chars[p] += max(0, len(words) - links)
            text.clear()
        links = 0

    def close(names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in until:
                return
            if stack[k].name in names:
                del stack[k:]
                return

    while at < len(html):
        found = _TAG.search(html, at)
        end = found.start() if found else len(html)
        if end > at:
            part = html[at:end]
            text.append(part)
            if in_link:
                links += len(part.strip())
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                if name in ("head", "title"):  # their text is left out, their tags need not be closed
                    over = _CLOSE[name].search(html, at) or (re.compile(r"<body\b", re.I).search(html, at) if name == "head" else None)
                    at = (over.end() if over[0].startswith("</") else over.start()) if over else at
                else:
                    over = _CLOSE[name].search(html, at)
                    at = over.end() if over else len(html)
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        if closing:
            close((name,), ())
            continue
        if name == "hr":
            continue
        in_link = 0 if name in ("article", "main", "nav") else in_link
        close(("p",), ("button", "td", "th", "li", "article", "main", "section", "div", "body"))
        if name in _ENDS:
            close(*_ENDS[name])
        elif re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", stack[-1].name):
            stack.pop()
        top = stack[-1]
        shown, names, own, hidden = _marks(attributes) if attributes else ("", [], set(), False)
        path = f"{top.path}>{name}{shown}"
        article, around, loose, is_loose = top.article, top.around, top.loose, False
        names = names if name in HEADINGS else [*names, own]  # a heading's id is what it is linked by
        words = set().union(*names)
        if hidden or name in AROUND or name == "header" and article < 0:
            around = AROUND_IT
        elif name in ("article", "main"):
            if words & {"comment", "comments"}:
                around = AROUND_IT
            elif name == "main" and around == NAMED:
                around = INSIDE  # what holds the main element is not around it
            if article < 0 and around != AROUND_IT:
                article, articles, loose = articles, articles + 1, ()
        elif name not in ("html", "body"):
            if around == INSIDE and any(n & AROUND_WORDS and n <= AROUND_WORDS | PART_WORDS for n in names):
                around = NAMED
            is_loose = bool(words & AROUND_WORDS)
            if article < 0 and around == INSIDE and "main" in words and "role" in attributes:
                article, articles, loose, is_loose = articles, articles + 1, (), False
        if path not in index:
            index[path] = len(page.paths)
            page.paths.append(path)
            page.uses.append(0)
            page.chars.append(0)
        page.uses[index[path]] += 1
        loose = (*loose, index[path]) if is_loose else loose
        stack.append(Element(name, path, around, article, [*top.parents, index[path]], loose))
    flush()
    return page
