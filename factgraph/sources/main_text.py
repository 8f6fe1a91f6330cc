"""The main text of a web page: what stands outside navigation, headers, forms and lists of links, read off the page's tree of elements."""

from __future__ import annotations

import re
from collections import Counter

#: Elements that are no part of the main text, and those whose content is no markup.
ASIDE = frozenset(("script", "style", "nav", "header", "footer", "aside", "form"))
RAW = frozenset(("script", "style"))
#: Elements that have no content, and those that make up blocks of text.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("article blockquote body dd div dl dt fieldset figure h1 h2 h3 h4 h5 h6 html li main ol p pre section table tbody td th tr ul".split()) | ASIDE
#: A block with this many links whose text makes up this part of its own is a list of links.
LINKS, LINKED = 3, 0.8
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>|<[^>]*>|[^<]+|<", re.DOTALL)


class _Element:
    """An open element: where what was kept of it begins, and how much of its text is in links."""

    def __init__(self, name: str, begin: int) -> None:
        self.name, self.begin, self.text, self.linked, self.links = name, begin, 0, 0, 0

    def is_links(self) -> bool:
        return self.links >= LINKS and self.linked >= LINKED * max(self.text, 1)


class _Page:
    """The open elements from the page down, how many of each name, and the text that was kept so far."""

    def __init__(self) -> None:
        self.path, self.kept, self.names = [_Element("", 0)], [], Counter()

    def open(self, name: str) -> None:
        self.kept.append(" ")
        self.path.append(_Element(name, len(self.kept)))
        self.names[name] += 1

    def close(self) -> None:
        """The last element ends: a left-out one or a list of links takes back what was kept of it, of others the sums go to the element around."""
        own = self.path.pop()
        self.names[own.name] -= 1
        if own.name in ASIDE or (own.name in BLOCK and own.is_links()):
            del self.kept[own.begin :]
            return
        around = self.path[-1]
        self.kept.append(" ")
        around.text += own.text
        around.linked += own.text if own.name == "a" else own.linked
        around.links += own.links + (own.name == "a")


def outside_boilerplate(html: str) -> str:
    """The page's text with a space for each tag, comment and left-out element.

    Elements nest as they are opened and closed: a closing tag ends the innermost open element of its name and all that
    are open inside it; one that has no open element is passed over. A left-out element that is never closed ends with the
    element around it, the latest with the page.
    """
    page, at = _Page(), 0
    while m := TOKEN.match(html, at):
        at = m.end()
        closing, name = m.group(1), (m.group(2) or "").lower()
        if not name:
            part = m.group()
            tag = part.startswith("<") and len(part) > 1
            page.kept.append(" " if tag else part)
            page.path[-1].text += 0 if tag else len(part.strip())
        elif closing:
            page.kept.append(" ")
            while page.names[name]:
                last = page.path[-1].name
                page.close()
                if last == name:
                    break
        elif name in EMPTY or m.group().endswith("/>"):
            page.kept.append(" ")
        else:
            page.open(name)
            if name in RAW:
                end = re.compile(rf"</{name}\b", re.IGNORECASE).search(html, at)
                at = end.start() if end else len(html)
    while len(page.path) > 1:
        page.close()
    return "".join(page.kept)
