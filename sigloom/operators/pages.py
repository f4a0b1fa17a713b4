"""Readable text of HTML pages, and what changed between versions of a page."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template", "svg", "form"}
_BLOCK = {"p", "div", "article", "section", "main", "li", "td", "h1", "h2", "h3", "blockquote", "body"}


class _Blocks(HTMLParser):
    """Text blocks with their tag and the length of their links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped, self.in_link = 0, 0
        self.blocks: list[list] = [["body", [], 0]]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skipped += 1
        elif tag == "a":
            self.in_link += 1
        elif tag in _BLOCK:
            self.blocks.append([tag, [], 0])

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "a":
            self.in_link = max(0, self.in_link - 1)
        elif tag in _BLOCK:
            self.blocks.append(["body", [], 0])

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if text and not self.skipped:
            self.blocks[-1][1].append(text)
            self.blocks[-1][2] += len(text) * bool(self.in_link)


def readable(html: str | None) -> str:
    """The blocks of a page that hold prose rather than links, a line each."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    lines = []
    for _, parts, linked in parser.blocks:
        text = " ".join(parts)
        if text and linked <= 0.5 * len(text):
            lines.append(text)
    return "\n".join(lines)


def readable_pages(pages: DataFrame) -> DataFrame:
    """page_id, text of every page (page_id, html)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"page_id": part["page_id"], "text": [readable(x) for x in part["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, text string")


def unified_diffs(versions: DataFrame) -> DataFrame:
    """key, no, added, removed: lines by a unified diff with one line around, of rows (key, no, old, new)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for old, new in zip(part["old"], part["new"], strict=True):
                lines = list(difflib.unified_diff((old or "").split(". "), (new or "").split(". "), n=1, lineterm=""))[2:]
                rows.append(([x[1:] for x in lines if x.startswith("+")], [x[1:] for x in lines if x.startswith("-")]))
            yield pd.DataFrame({"key": part["key"], "no": part["no"], "added": [r[0] for r in rows], "removed": [r[1] for r in rows]})

    return versions.select("key", F.col("no"), "old", "new").mapInPandas(run, "key bigint, no bigint, added array<string>, removed array<string>")


#: Elements without text that a monitor compares, and those that make a line.
_VOLATILE, _LINED = {"script", "style", "noscript", "svg", "time"}, {"a", "p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "span"}
_SHORT = {"div", "span"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_UNITS, _LEAST = "万kmw", 15


class _Lines(HTMLParser):
    """The texts of a page's links and blocks, by where each element's text begins and ends among the page's pieces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.spans: list[list] = []
        self.open: list[tuple[str, int | None]] = []
        self.volatile = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        lined = tag in _LINED and not self.volatile
        if lined:
            self.spans.append([tag, len(self.pieces), None, dict(attrs).get("href") or ""])
        self.open.append((tag, len(self.spans) - 1 if lined else None))
        self.volatile += tag in _VOLATILE

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            name, at = self.open.pop()
            self.volatile -= name in _VOLATILE
            if at is not None:
                self.spans[at][2] = len(self.pieces)
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if data.strip() and not self.volatile:
            self.pieces.append(data.strip())


def lines_of(html: str | None) -> list[str]:
    """LINK: and TEXT: lines of a page, each once, in order; counts and short loose texts are left out."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines: dict[str, None] = {}
    for tag, start, end, href in parser.spans:
        text = "".join(parser.pieces[start:end])
        count = text[:-1] if len(text) > 1 and text[-1] in _UNITS else text
        if not text or count.isdigit():
            continue
        if tag == "a":
            lines[f"LINK: {text} ({href})"] = None
        elif tag not in _SHORT or len(text) > _LEAST:
            lines[f"TEXT: {text}"] = None
    return list(lines)


def compared_lines(pages: DataFrame) -> DataFrame:
    """page_id, lines of every page (page_id, html); a null or empty page has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"page_id": part["page_id"], "lines": [lines_of(x) for x in part["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, lines array<string>")


#: Entries of a feed that a monitor compares, and what a feed without any reads.
ENTRIES, NO_ENTRIES = 10, "TEXT: No items found in feed."


def feed_lines(xml: str | None) -> list[str]:
    """A line for the title and one for the link of each of a feed's first ENTRIES entries, RSS or Atom; a feed that can't
    be read has none."""
    lines: list[str] = []
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return [NO_ENTRIES]
    entries = [x for x in root.iter() if x.tag.rsplit("}", 1)[-1] in ("item", "entry")]
    for entry in entries[:ENTRIES]:
        title = link = ""
        for part in entry:
            name = part.tag.rsplit("}", 1)[-1]
            if name == "title":
                title = " ".join("".join(part.itertext()).split())
            elif name == "link":
                link = link or part.get("href") or (part.text or "").strip()
        lines.append(f"TEXT: {title}")
        if link:
            lines.append(f"LINK: {title} ({link})")
    return lines or [NO_ENTRIES]


def scanned(rows: DataFrame) -> DataFrame:
    """page_id, feed, lines of every monitored address (page_id, feed, html): of a feed its entries, of a page its text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lines = [feed_lines(x) if feed else lines_of(x) for x, feed in zip(part["html"], part["feed"], strict=True)]
            yield pd.DataFrame({"page_id": part["page_id"], "feed": part["feed"], "lines": lines})

    return rows.select("page_id", "feed", "html").mapInPandas(run, "page_id bigint, feed boolean, lines array<string>")
