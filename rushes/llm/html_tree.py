"""Pages as trees of blocks: tolerant tokens, implied end tags, and the text of each block."""

from __future__ import annotations

import html
import re
from collections import Counter

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {  # an open element of the second kind ends before an element of the first, inside the third
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S
)
_ATTR = re.compile(r"(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NUMBER = re.compile(r"\d+")
#: Elements nested deeper than this make no blocks of their own; their text stays, in the last one that does.
DEEPEST = 200

# Elements that are not main text, and words of classes, ids and roles.
NOISE_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset iframe object canvas svg audio video map".split())
#: Words that say so wherever they stand.
NOISE_WORDS = frozenset(
    "ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comments consent contentinfo cookie cookies disqus footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter overlay pager pagination paywall popup promo promoted promotion "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that say so alone or beside words of layout: a share bar, not a share price.
NOISE_ALONE = frozenset(
    "ad byline comment copyright disclaimer feedback form hidden notice notices notification recommended related replies reply respond search share "
    "sharing skip tags toc".split()
)
LAYOUT = frozenset(
    "area articles bar block body bottom box btn button buttons cell col column container content count div element entry field fixed foot group head "
    "icon icons inline inner item items label large layout left legal line link links list main medium middle module outer page panel post posts rail "
    "region right row section side site slot small space stack sticky stories story strip text thread title tool tools top unit wrap wrapper zone".split()
)
_SPLIT = re.compile(r"[^a-z]+")


def noise_word(word: str) -> bool:
    """Whether a class, id or role says that its element is no main text."""
    parts = [p for p in _SPLIT.split(word) if p]
    if any(p in NOISE_WORDS for p in parts):
        return True
    return any(p in NOISE_ALONE for p in parts) and all(p in NOISE_ALONE or p in LAYOUT for p in parts)


def is_noise(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in NOISE_TAGS or any(map(noise_word, words))


class Node:
    """An element that makes a block, or text between such elements (``label`` is ``#``)."""

    __slots__ = ("label", "children", "text", "linked")

    def __init__(self, label: str, text: str = "", linked: int = 0):
        self.label, self.text, self.linked, self.children = label, text, linked, []


def label_of(name: str, attrs: str) -> str:
    """Name, classes, id and role of a start tag, numbers made alike: what a template repeats on all its pages."""
    words = []
    for m in _ATTR.finditer(attrs):
        if m[1].lower() == "hidden":
            words.append("hidden")
        else:
            words += _NUMBER.sub("0", (m[2] or m[3] or m[4] or "").lower()).split()
    return ".".join([name, *sorted(set(words))])


def parse(page: str) -> Node:
    """The tree of a page, ``DEEPEST`` blocks deep at most.

    Never fails: stray end tags and what cannot be read as a tag are passed over or stay text.  Inline elements that are
    noise by their class, id or role are left out, up to their end tag or that of the block around them.
    """
    root = Node("root")
    stack, names = [root], ["root"]
    open_names: Counter = Counter()
    buffer: list[str] = []
    links, linked = 0, 0
    noise, inside_noise = "", Counter()

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                stack[-1].children.append(Node("#", text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close(upto: int):
        flush()
        open_names.subtract(names[upto:])
        del stack[upto:], names[upto:]

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not noise:
            buffer.append(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in RAW and not m["end"]:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if noise:
            inside_noise[name] += -1 if m["end"] else name not in VOID
            if inside_noise[name] >= 0 and inside_noise[noise] > 0 or name in INLINE and name != noise:
                continue
            noise = ""
            if name in INLINE:
                continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if m["end"] else links + 1
            if not m["end"] and name not in VOID and m["attrs"].strip() and any(map(noise_word, label_of(name, m["attrs"]).split(".")[1:])):
                noise, inside_noise = name, Counter({name: 1})
            continue
        if m["end"]:
            links = 0
            if open_names[name] > 0:
                i = len(names) - 1
                while names[i] != name:
                    i -= 1
                close(i)
            else:
                buffer.append(" ")
            continue
        if name in VOID:
            buffer.append(" ")
            continue
        if name in CLOSES_P and names[-1] == "p":
            close(len(names) - 1)
        ends, inside = SELF_CLOSING.get(name, ((), ()))
        if any(open_names[e] > 0 for e in ends):
            for i in range(len(names) - 1, 0, -1):
                if names[i] in inside:
                    break
                if names[i] in ends:
                    close(i)
                    break
        flush()
        if len(stack) > DEEPEST:
            node = stack[-1]
        else:
            node = Node(label_of(name, m["attrs"]))
            stack[-1].children.append(node)
        if not m["attrs"].rstrip().endswith("/"):
            stack.append(node)
            names.append(name)
            open_names[name] += 1
    flush()
    return root
