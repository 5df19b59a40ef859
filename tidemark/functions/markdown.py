"""HTML as Markdown, one page at a time, with the parser of the standard library."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Source code of documents that are Markdown already: their text isn't escaped again.
MARKDOWN_SOURCE = 8
SILENT = ("script", "style", "head", "title", "template")
BLOCKS = ("p", "div", "section", "article", "header", "footer", "main", "nav", "ul", "ol", "table", "blockquote", "pre", "form", "figure")
SPECIAL = re.compile(r"([\\*_`\[\]])")
MATH = re.compile(r"\$\$.+?\$\$|\$[^$\n]+\$", re.S)


def escaped(text: str) -> str:
    """Markdown's own signs with a backslash before them, but for spans of math."""
    out, at = [], 0
    for m in MATH.finditer(text):
        out += [SPECIAL.sub(r"\\\1", text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, SPECIAL.sub(r"\\\1", text[at:])])


class Writer(HTMLParser):
    def __init__(self, plain: bool):
        super().__init__(convert_charrefs=True)
        self.plain, self.out, self.silent, self.lists, self.links, self.cell, self.row, self.rows, self.math = plain, [], 0, [], [], None, None, None, False

    def put(self, text: str) -> None:
        (self.out if self.cell is None else self.cell).append(text)

    def block(self) -> None:
        if self.cell is None:
            self.out.append("\n\n")

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in SILENT:
            self.silent += 1
        elif re.fullmatch("h[1-6]", tag):
            self.block()
            self.put("#" * int(tag[1]) + " ")
        elif tag == "br":
            self.put("<br>" if self.cell is not None else "  \n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "code":
            self.put("`")
        elif tag == "a":
            self.links.append(attrs.get("href") or "")
            self.put("[")
        elif tag == "img":
            self.put(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            mark = "-"
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                mark = f"{self.lists[-1]}."
            self.put("\n" + "  " * depth + mark + " ")
        elif tag in ("ul", "ol"):
            if not self.lists:
                self.block()
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "table":
            self.block()
            self.rows = []
        elif tag in BLOCKS:
            self.block()

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "code":
            self.put("`")
        elif tag == "a" and self.links:
            self.put(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            if not self.lists:
                self.block()
        elif tag in ("td", "th") and self.cell is not None:
            text, self.cell = " ".join("".join(self.cell).split()).replace("|", "\\|"), None
            if self.row is not None:
                self.row.append(text)
        elif tag == "tr" and self.row is not None:
            if self.rows is not None:
                self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                wide = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
                self.put("\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]))
            self.block()
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            self.block()

    def handle_data(self, data):
        if self.silent:
            return
        text = re.sub(r"\s+", " ", data)
        if text.strip() or (self.out and not self.out[-1].endswith(("\n", " "))):
            self.put(text if self.plain else escaped(text))


def markdown(html: str | None, source_type: int | None = None) -> str | None:
    """ATX headings, lists, links, tables with ``<br>`` kept in cells; math spans and Markdown sources are not escaped."""
    if html is None:
        return None
    w = Writer(source_type == MARKDOWN_SOURCE)
    w.feed(html)
    w.close()
    text = "".join(w.out)
    text = re.sub(r"\$([^$\n]*)\$", lambda m: "$" + m[1].replace("\\_", "_").replace("\\*", "*") + "$", text)
    lines = [x.strip() if not re.match(r"\s*(?:-|\d+\.) ", x) and not x.endswith("  ") else x.rstrip("\n") for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
