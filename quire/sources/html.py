"""Blocks of HTML and XHTML pages, by the elements' default display."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements that are blocks, and those whose content is passed over; of the latter those without counted text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
REGIONS = frozenset("head title script style template noscript nav rt rp".split())
SILENT = frozenset({"head", "title"})
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What the start of one of these ends, where its end tag was left out.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "option": {"option"}}
NESTING = 256


class _Reader(HTMLParser):
    """Positions count every block of the page from 1, those in passed-over regions included."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None]] = []
        self.texts: dict[int, list[str]] = {}
        self.names: dict[int, str] = {}
        self.opened = 0
        self.regions: list[list] = []
        self.regions_not_read = 0
        self.outside = 0
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n", stated=True)
            return
        for shut in CLOSES.get(tag, ()) if not self.regions else ():
            if self.stack and self.stack[-1][0] == shut:
                self.handle_endtag(shut)
        if tag in REGIONS:
            self.regions.append([tag, False])
            self.stack.append((tag, None))
            return
        if tag in BLOCKS:
            self.opened += 1
            if tag in VOID or len(self.stack) >= NESTING:
                return
            self.stack.append((tag, None if self.regions else self.opened))
            self.names[self.opened] = tag
            self.pre += tag == "pre"
        elif tag not in VOID:
            self.stack.append((tag, None))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag != "br" and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, _ = self.stack.pop()
            self.pre -= t == "pre"
            if t in REGIONS and self.regions:
                _, held = self.regions.pop()
                self.regions_not_read += held and not self.regions
            if t == tag:
                return

    def handle_data(self, data, stated=False):
        if self.regions:
            if data.strip(" \t\n\r") and self.regions[-1][0] not in SILENT:
                for r in self.regions:
                    r[1] = True
            return
        block = next((n for _, n in reversed(self.stack) if n is not None), None)
        if block is None:
            self.outside += bool(data.strip(" \t\n\r"))
            return
        parts = self.texts.setdefault(block, [])
        if stated or self.pre:
            parts.append(data)
            return
        for c in data:  # white space collapses over element borders
            if c in " \t\n\r":
                if parts and parts[-1] and parts[-1][-1] not in " \n":
                    parts.append(" ")
            else:
                parts.append(c)


def read(page: str | None) -> tuple[list[tuple[int, str, str]], int, int]:
    """(ordinal, element, text) of blocks with text, regions passed over with text, and stretches outside of blocks."""
    r = _Reader()
    r.feed(page or "")
    r.close()
    out = [(n, r.names[n], "".join(t).strip(" ")) for n, t in sorted(r.texts.items())]
    return [b for b in out if b[2].strip(" \t\n\r")], r.regions_not_read, r.outside


def _blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ordinals, elements, texts = [], [], [], []
        for k, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for n, e, t in read(page.as_py())[0]:
                ids.append(k)
                ordinals.append(n)
                elements.append(e)
                texts.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(ordinals, pa.int64()), pa.array(elements, pa.string()), pa.array(texts, pa.string())], [key, "ordinal", "element", "text"])


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ordinal, element, text): the blocks of every page that hold text."""
    return pages.select(key, html).mapInArrow(lambda b: _blocks(b, key), f"`{key}` {dict(pages.dtypes)[key]}, ordinal bigint, element string, text string")


def _census(batches, key):
    for batch in batches:
        got = [read(p.as_py()) for p in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in ([len(b) for b, _, _ in got], [r for _, r, _ in got], [o for _, _, o in got]))], [key, "blocks", "regions_not_read", "text_outside_a_block"])


def census(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, blocks, regions_not_read, text_outside_a_block): what was read and what was passed over."""
    return pages.select(key, html).mapInArrow(lambda b: _census(b, key), f"`{key}` {dict(pages.dtypes)[key]}, blocks bigint, regions_not_read bigint, text_outside_a_block bigint")
