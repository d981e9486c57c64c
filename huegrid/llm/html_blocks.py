"""Leaf blocks of a page: runs of text under the same block-level element, with their ancestors.

A tolerant scan, linear in the page: comments, declarations and the contents of
scripts, styles and the like are dropped, to the end of the page if no end tag
follows; those of templates, drawings, form fields, titles and noscript only up
to an end tag, without one the start tag alone goes.  Formulas and the fallback
of objects and canvases are text.  End tags that are missing are implied; a br
is white space; character references are decoded and white space becomes one
space.

Broken markup has defined results: a start that no ``>`` ends is text; where
quotes in a tag never close, that tag and all later ones end at the next ``>``;
elements nested deeper than DEPTH count as their ancestor at that depth, and
keep their text.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass

#: The rest of a tag, with quoted values; possessive, so a failure costs one pass.
_QUOTED = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REMARK_END = re.compile(r"--!?>")
DEPTH = 256
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s/>=\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_REMARK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_WORD = re.compile(r"[a-z]+")

RAW = frozenset("script style iframe noembed noframes xmp".split())
DROPPED = frozenset("template textarea title svg noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var button select option optgroup object canvas".split())
#: Formulas stand in the line, each element of theirs too.
INLINE |= frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split())
#: A start tag of a key closes an open element of its values, up to the listed fences.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set())}


def _displayed(style: str) -> bool:
    """Whether the display that counts in a style attribute, the last or the last important one, is not none."""
    counts: dict[bool, str] = {}
    for declaration in _REMARK.sub("", style).split(";"):
        name, _, value = declaration.partition(":")
        if name.strip().lower() == "display":
            value, important, _ = value.lower().partition("!")
            counts[bool(important)] = value.strip()
    return counts.get(True, counts.get(False)) != "none"


def hides(attributes: str) -> bool:
    """Whether a start tag's attributes hide its element: hidden (but until-found), display: none, or aria-hidden=true."""
    if not _MAY_HIDE.search(attributes):
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
    hidden = found.get("hidden")
    return (hidden is not None and hidden.strip().lower() != "until-found") or not _displayed(found.get("style", "")) or found.get("aria-hidden", "").strip().lower() == "true"


#: Elements that hold blocks of one purpose; the nearest one counts on its own.
_HOLDERS = frozenset("article main section aside nav header footer form div ul ol dl table figure blockquote pre details dialog body".split())


class Element:
    """An open element: its tag and names, and what holds of it and all its ancestors together."""

    __slots__ = ("tag", "names", "parent", "tags", "all_names", "holder", "hidden", "linked", "headed", "known")

    def __init__(self, tag: str, attributes: str = "", parent: "Element | None" = None):
        self.tag, self.parent = tag, parent
        self.names = [w for m in _NAMES.findall(attributes) for w in _WORD.findall("".join(m).lower())] if attributes else []
        none: frozenset[str] = frozenset()
        tags, names = (parent.tags, parent.all_names) if parent else (none, none)
        self.tags = tags if not tag or tag in tags else tags | {tag}
        self.all_names = names if names.issuperset(self.names) else names.union(self.names)
        self.holder = self if tag in _HOLDERS else parent.holder if parent else None
        self.hidden = bool(parent and parent.hidden) or (bool(attributes) and hides(attributes))
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.headed = tag == "head" or bool(parent and parent.headed)
        self.known = None  # room for what a model makes of it


@dataclass(slots=True)
class Block:
    text: str
    owner: Element  # innermost, with its ancestors
    linked: int  # characters inside links

    @property
    def hidden(self) -> bool:
        return self.owner.hidden


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; none for null, empty or text-free pages."""
    out: list[Block] = []
    stack = [Element("")]
    deeper: Counter = Counter()  # open elements below DEPTH
    parts: list[str] = []
    owner = stack[0]
    linked = 0
    unclosed: set[str] = set()  # without an end tag in the rest of the page

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not owner.headed:
                out.append(Block(text, owner, linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, owner
        text = _html.unescape(raw) if "&" in raw else raw
        if text.isspace():
            if parts:
                parts.append(" ")
            return
        if not parts:
            owner = stack[-1]
        parts.append(text)
        if stack[-1].linked:
            linked += len(text.strip())

    def cut(i: int) -> None:
        del stack[i:]
        deeper.clear()

    def close(tags: set[str], fences: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in fences:
                return
            if stack[i].tag in tags:
                cut(i)
                return

    page = page or ""
    at, end, last, quoted = 0, len(page), page.rfind(">"), True
    while at < end:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        two = page[start + 1 : start + 2]
        m = _TAG.match(page, start)
        if not m and two not in ("!", "?") or m and start > last:
            upto = page.find("<", start + 1)
            upto = end if upto < 0 or start > last else upto
            say(page[at:upto])
            at = upto
            continue
        if start > at:
            say(page[at:start])
        if not m:
            if page.startswith("<!--", start):
                found = _REMARK_END.search(page, start + 4)
                at = found.end() if found else end
            else:
                found = page.find(">", start)
                at = found + 1 if found >= 0 else end
            continue
        whole = _QUOTED.match(page, m.end()) if quoted else None
        if not whole:
            quoted = False
        at = whole.end() if whole else page.find(">", m.end()) + 1
        tag, attributes = m[2].lower(), page[m.end() : at - 1]
        if m[1]:
            if tag in RAW or tag in DROPPED or tag in VOID:
                if tag == "br":
                    say(" ")
                continue
            if tag not in INLINE:
                flush()
            if deeper[tag]:
                deeper[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # a stray inline end tag closes no block
            continue
        if tag == "br" or tag == "wbr":
            say(" " if tag == "br" else "")
            continue
        if tag in RAW or tag in DROPPED:
            if not attributes.endswith("/"):
                found = None if tag in unclosed else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                stop = page.find(">", found.end()) + 1 if found else 0
                if not stop:
                    unclosed.add(tag)
                at = stop or (end if tag in RAW else at)
            continue
        if tag not in INLINE:
            flush()
            if tag in VOID:
                continue
            close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "aside", "li", "body"} - {tag} if tag != "p" else {"table", "td", "th", "button"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in VOID:
            continue
        if len(stack) > DEPTH:
            deeper[tag] += 1
        else:
            stack.append(Element(tag, attributes, stack[-1]))
    flush()
    return out
