"""HTML to markdown in a deterministic form: a small event-driven writer over the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from . import tables as T

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = set("p div section article main header ul ol table tr blockquote pre h1 h2 h3 h4 h5 h6 li dl dt dd figure body html form".split())


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.pre, self.links, self.lists = [], 0, [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        marked = any(n in f"{a.get('class', '')}" or n in a.get("id", "") for n in T.MARKDOWN_DROPPED_NAMES)
        if self.skip or tag in T.MARKDOWN_DROPPED_TAGS or tag == "head" or marked:
            if tag not in _VOID:
                self.skip.append(tag)
            return
        if tag in _BLOCK:
            self.out.append("\n\n" if tag not in ("li", "tr", "dt", "dd") else "\n")
        if tag[0] == "h" and tag[1:] in "123456" and len(tag) == 2:
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("  " * max(0, len(self.lists) - 1) + "- ")
        elif tag in ("ul", "ol"):
            self.lists.append(tag)
        elif tag == "pre":
            self.pre += 1
            self.out.append("```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.links.append(a.get("href"))
            self.out.append("[" if a.get("href") else "")
        elif tag in ("td", "th"):
            self.out.append("| ")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in _BLOCK and tag not in ("li", "tr"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def convert(page: str) -> str:
    w = _Writer()
    w.feed(page)
    w.close()
    text = "".join(w.out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()
