"""Flat text blocks of an HTML page, with the facts about each that tell main text from the rest."""

from __future__ import annotations

import html
import re

#: Names that begin or end a block (fixed by the markup language).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
#: Elements without end tags, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea|xmp|iframe|noembed|noframes|noscript"
#: Elements whose content is not shown as text of the page.
UNSHOWN = frozenset("head template select datalist object canvas svg math audio video button".split())
#: An open element of the first kind is closed by a start tag of the second.
CLOSED_BY = {
    "p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]), "option": frozenset(["option"]),
}
#: Elements beside the main text; those of the second line stay so whatever they hold, the first may wrap a page that has a main part.
ASIDE_TAGS = frozenset("form header".split())
APART_TAGS = frozenset("aside dialog footer menu nav search".split())
MAIN_TAGS = frozenset("article main".split())
#: Words of class, id, role and itemprop that tell the same of any element.
ASIDE_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert alertdialog announcement banner bottom breadcrumb breadcrumbs byline captcha complementary consent contentinfo cookie cookies copyright dialog disclaimer feedback form gdpr header login logo masthead message modal newsletter notice notices notification outbrain overlay pager pagination paywall popup privacy promo promoted promotion rss search share sharing signup skip skyscraper social sponsor sponsored sponsors subscribe taboola tags toc toolbar toolbox top topbar trending".split()
)
APART_WORDS = frozenset("aside comment commentlist comments discussion disqus foot footer menu menubar nav navbar navigation popular recommendations recommended related replies reply respond responses shoutbox sidebar teaser widget widgets".split())
MAIN_WORDS = frozenset("article articlebody blogpost body content entry entrybody hentry main maincontent post postbody postcontent prose story storybody text".split())
#: With one of these, an element's words tell what is there besides it (``with-sidebar``).
BESIDES = frozenset("has no with without".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>" + RAW + r")(?=[\s/>])(?:[^<>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>?|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/<>]*+)(?P<rest>(?:[^<>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_MARKS = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Open:
    """An open element: its name, whether it or what holds it is shown, and the innermost telling container's kind."""

    __slots__ = ("name", "shown", "kind", "inside", "form")

    def __init__(self, name: str, shown: bool, kind: int, inside: bool, form: bool = False):
        self.name, self.shown, self.kind, self.inside, self.form = name, shown, kind, inside, form


class Block:
    """Text of a block, its words and those in links, the element, and its place."""

    __slots__ = ("text", "words", "linked", "name", "kind", "inside")

    def __init__(self, text: str, words: int, linked: int, of: _Open):
        self.text, self.words, self.linked, self.name, self.kind, self.inside = text, words, linked, of.name, of.kind, of.inside


def _marks(rest: str) -> tuple[set[str], bool]:
    """Words of class, id, role and itemprop, lower-cased, and whether the element is hidden."""
    words, hidden = set(), bool(_STYLE.search(rest))
    for m in _MARKS.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden":
            hidden = hidden or name == "hidden" or value.lower() == "true"
        else:
            words.update(w.lower() for w in _WORDS.findall(value))
            words.update(value.lower().split())
    return words, hidden


def _opened(name: str, rest: str, outer: _Open) -> _Open:
    """Kinds: 0 nothing told, 1 main text, 2 beside it, 3 apart from it. The innermost container that tells decides, but nothing in a part apart is main.

    A header within the main text is its own, and a main element within one merely beside it (a form around the page) is main.
    """
    words, hidden = _marks(rest) if rest else (set(), False)
    if words & BESIDES:
        words = words - ASIDE_WORDS - APART_WORDS
    kind, inside, main = outer.kind, outer.inside, words & MAIN_WORDS
    if name == "body" or name == "html" or kind == 3:
        pass
    elif name in APART_TAGS or words & APART_WORDS:
        kind = 3
    elif name in MAIN_TAGS or (main and words & ASIDE_WORDS == {"header"} and name != "header"):
        kind, inside = 1, True
    elif name in ASIDE_TAGS or words & ASIDE_WORDS:
        kind = 1 if name == "header" and kind == 1 else 2
    elif main and (kind != 2 or outer.form):
        kind = 1
    form = kind == 2 and not words & ASIDE_WORDS and (name == "form" or outer.form)  # nothing but a form tells against it
    return _Open(name, outer.shown and not hidden and name not in UNSHOWN, kind, inside, form)


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order: what stands between the begins and ends of block elements, references decoded, white space made one blank.

    Comments, scripts, styles, titles and what is not shown give none. Tags that nothing closes, ends that close nothing, and
    pages that stop in the middle are taken as browsers do, roughly.
    """
    out: list[Block] = []
    stack = [_Open("", True, 0, False)]
    open_names: dict[str, int] = {}
    pieces: list[str] = []
    linked: list[str] = []
    link = False

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and stack[-1].shown:
                out.append(Block(text, text.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), stack[-1]))
            pieces.clear()
            linked.clear()

    def leave() -> None:
        open_names[stack.pop().name] -= 1

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and stack[-1].shown:
            pieces.append(page[at : m.start()])
            if link:
                linked.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"] and m["raw"].lower() in ("title", "textarea", "iframe"):
                close()
            continue
        if name == "a":
            link = not m["end"]
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCK or name in UNSHOWN:
            if name in BLOCK:
                close()
            if m["end"]:
                if open_names.get(name):
                    while stack[-1].name != name:
                        leave()
                    leave()
            elif name not in VOID:
                while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].name, ()):
                    leave()
                if not (name in UNSHOWN and m["rest"].endswith("/")):
                    stack.append(_opened(name, m["rest"], stack[-1]))
                    open_names[name] = open_names.get(name, 0) + 1
    if at < len(page) and stack[-1].shown:
        pieces.append(page[at:])
        if link:
            linked.append(page[at:])
    close()
    return out
