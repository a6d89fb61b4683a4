"""Leaf blocks of a page: their text, their tag path and their share of link text."""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
INLINE = frozenset(
    "svg g text tspan defs use path circle ellipse line rect polygon polyline symbol math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle semantics annotation "
    "object canvas audio video picture "
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select".split())


def _names(rest: str) -> tuple[str, ...]:
    if "=" not in rest:
        return ()
    found = []
    for m in NAMES.finditer(rest):
        found += [f"{m[1].lower()[0]}:{w}" for w in WORDS.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(found)


def blocks(html: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """``(text, path, link share)`` of every block with text, in page order.

    A block ends where a block-level tag opens or closes. Its text has character references decoded
    and white space turned into single spaces. Scripts, styles, comments and other markup have none.
    """
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, path, min(1.0, linked / max(1, len(text)))))
            parts.clear()
        linked = 0

    def add(text: str):
        nonlocal path, linked
        if not parts or not any(p.strip() for p in parts):
            path = tuple(t for tag, names in stack for t in (tag, *names))
        parts.append(text)
        if any(tag == "a" for tag, _ in stack):
            linked += len(text)

    at, html = 0, html or ""
    while m := TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m["close"]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag in RAW:  # up to its end tag, whatever stands between
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m["rest"].endswith("/"):
            if tag not in INLINE:
                _close_implied(stack, tag)
            stack.append((tag, _names(m["rest"])))
    if at < len(html):
        add(html[at:])
    flush()
    return out


def _close_implied(stack: list, tag: str) -> None:
    """A block-level tag ends an open paragraph, and items end items of their list or table."""
    ends = CLOSES_ITSELF.get(tag, set())
    for k in range(len(stack) - 1, -1, -1):
        name = stack[k][0]
        if name == "p" or name in ends:
            del stack[k:]
            return
        if name not in INLINE and (name in SCOPES or not ends):
            return
