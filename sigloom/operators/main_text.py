"""The main text of pages: the block whose text scores best, by its length, paragraphs, commas, names and links.

A page is read once.  Each open element counts what stands inside it; when it closes, its counts go to the element around
it, so every block is scored from its own totals without walking its inside again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without text, elements of the frame around a text, blocks that are scored, names that speak
#: against and for a block, and the letters that a block has at least.
STRIPPED = ("script", "style", "noscript", "svg", "iframe", "form", "button")
FRAME = ("nav", "header", "footer", "aside")
BLOCKS = ("div", "article", "section", "main", "td")
AGAINST = re.compile(r"(nav|menu|sidebar|footer|header|comment|share|social|promo|banner|advert|cookie|popup|modal|related|recommend|subscribe|newsletter|breadcrumb|pagination|widget)", re.I)
FOR = re.compile(r"(article|content|post|entry|main|body|story|text)", re.I)
LEAST = 200

#: Elements that hold nothing, and those that end an open paragraph.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass
class _Open:
    tag: str
    name: str
    number: int
    first: int
    left_out: bool
    paragraphs: int = 0
    commas: int = 0
    linked: int = 0
    length: int = 0


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open = [_Open("", "", -1, 0, False)]
        self.number = 0
        #: score, its block's number with a minus, first piece and end.
        self.best: tuple[float, int, int, int] = (0.0, 0, 0, 0)
        self.body: tuple[int, int] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        if tag in _ENDS_PARAGRAPH and self.open[-1].tag == "p":
            self._close()
        given = dict(attrs)
        name = f"{given.get('class') or ''} {given.get('id') or ''}"
        named_out = len(self.open) > 1 and bool(name.strip()) and AGAINST.search(name) is not None and FOR.search(name) is None
        self.number += 1
        self.open.append(_Open(tag, name, self.number, len(self.pieces), self.open[-1].left_out or tag in STRIPPED or tag in FRAME or named_out))

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.open[1:]):
            while self.open[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.open[-1].left_out:
            self.pieces.append(data)
            self.open[-1].commas += data.count(",") + data.count("，")
            self.open[-1].length += len(data)

    def _close(self) -> None:
        e = self.open.pop()
        around = self.open[-1]
        if e.left_out:
            return
        if e.tag in BLOCKS and e.length >= LEAST:
            self._score(e)
        if e.tag == "body":
            self.body = (e.first, len(self.pieces))
        around.paragraphs += e.paragraphs + (e.tag == "p")
        around.commas += e.commas
        around.length += e.length
        around.linked += e.linked + (e.length if e.tag == "a" else 0)

    def _blank(self, places: Iterable[int], stripped: Callable[[str], str]) -> int:
        """Blanks before the first letter of these pieces."""
        out = 0
        for k in places:
            rest = len(stripped(self.pieces[k]))
            out += len(self.pieces[k]) - rest
            if rest:
                break
        return out

    def _score(self, e: _Open) -> None:
        inside = range(e.first, len(self.pieces))
        length = e.length - self._blank(inside, str.lstrip) - self._blank(reversed(inside), str.rstrip)
        if length < LEAST:
            return
        score = length / 100 + 3 * e.paragraphs + e.commas
        score *= 0.2 if AGAINST.search(e.name) else 1
        score *= 1.5 if FOR.search(e.name) else 1
        score *= 0.3 if e.linked / length > 0.5 else 1
        # Of equally good blocks the one that began first, though it closes last.
        self.best = max(self.best, (score, -e.number, e.first, len(self.pieces)))

    def text(self) -> str:
        while len(self.open) > 1:
            self._close()
        first, end = self.best[2:] if self.best[0] > 0 else self.body or (0, len(self.pieces))
        lines = (line.strip() for line in "".join(self.pieces[first:end]).splitlines())
        return "\n".join(line for line in lines if line)


def main_text(html: str | None) -> str:
    """The text of the best block with LEAST letters at least, else of the body, a line for each line that isn't blank."""
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.text()


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id and text of every row of ``pages`` (page_id, html); null pages have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, text string")
