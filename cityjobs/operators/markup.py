"""Tags and texts of HTML pages, from left to right in one pass, whatever the page's mistakes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: What a page consists of: (start, tag, attributes), (end, tag, none) or (text, "", none).
START, END, TEXT = range(3)
RAW = frozenset({"script", "style"})
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BLANK = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*")
VALUE = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")


class Finder:
    """str.find from the left, which looks no further once there is nothing left to find."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, {}

    def __call__(self, what: str, start: int) -> int:
        found = self.at.get(what, -2)
        if found == -1 or found >= start:
            return found
        found = self.at[what] = self.text.find(what, start)
        return found


def tokens(html: str) -> Iterator[tuple[int, str, list[tuple[str, str | None]]]]:
    """Start tags with their attributes (names in lower case, values without quotes, entities resolved), end tags, texts.

    Comments, declarations and processing instructions are left out. The insides of scripts and styles are text. A `<`
    that begins no tag is text, and so is all that follows the last `>`; a quote that is never closed is a letter like
    others. Every letter is read a bounded number of times.
    """
    find, at, start = Finder(html), 0, 0

    def text(end: int) -> Iterator[tuple[int, str, list]]:
        if end > start:
            yield TEXT, unescape(html[start:end]), []

    while True:
        at = find("<", at)
        if at < 0 or find(">", at) < 0:
            yield from text(len(html))
            return
        if html.startswith("<!--", at):
            end = find("-->", at + 4) if not html.startswith(("<!-->", "<!--->"), at) else find(">", at) - 2
            if end < 0 and find("-->", at + 4) < 0:
                yield from text(at)  # a comment that is never closed takes the rest
                return
            yield from text(at)
            at = start = end + 3
            continue
        mark = html[at + 1]
        if mark in "!?":
            yield from text(at)
            at = start = find(">", at) + 1
            continue
        name = NAME.match(html, at + 2 if mark == "/" else at + 1)
        if not name:
            at += 1
            continue
        yield from text(at)
        tag, at = name[0].lower(), name.end()
        if mark == "/":
            at = start = find(">", at) + 1
            yield END, tag, []
            continue
        found, at = attributes(html, at, find)
        yield START, tag, found
        start = at
        if tag in RAW:
            at = raw_end(html, tag, at, find)


def attributes(html: str, at: int, find: Finder) -> tuple[list[tuple[str, str | None]], int]:
    """A start tag's attributes, and the place behind its `>`."""
    found: list[tuple[str, str | None]] = []
    while True:
        at = BLANK.match(html, at).end()
        if at >= len(html):
            return found, at
        if html[at] == ">":
            return found, at + 1
        name = ATTRIBUTE.match(html, at)
        if not name:
            at += 1
            continue
        at, value = name.end(), None
        sign = VALUE.match(html, at)
        if sign:
            at = sign.end()
            quote = html[at : at + 1]
            end = find(quote, at + 1) if quote in ('"', "'") and quote else -1
            if end >= 0:
                value, at = html[at + 1 : end], end + 1
            else:
                bare = BARE.match(html, at)
                value, at = bare[0], bare.end()
        found.append((name[0].lower(), None if value is None else unescape(value)))


def raw_end(html: str, tag: str, at: int, find: Finder) -> int:
    """Where a script or style ends: before its end tag, or at the page's end."""
    end = at
    while True:
        end = find("</", end)
        if end < 0:
            return len(html)
        if html[end + 2 : end + 2 + len(tag)].lower() == tag and not html[end + 2 + len(tag) : end + 3 + len(tag)].isalnum():
            return end
        end += 2


def links(html: str) -> list[str]:
    """The href of every <a> in order, entities resolved."""
    return [dict(reversed(a))["href"] or "" for kind, tag, a in tokens(html) if kind == START and tag == "a" and any(k == "href" for k, _ in a)]
