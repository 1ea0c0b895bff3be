"""Sections of HTML and Markdown texts, as blocks (section path, text)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Parts that hold no content, and headings that begin a section.
SKIPPED = {"script", "style", "head", "nav", "footer", "header", "aside", "noscript"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3}
_ATX = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


class _Sections(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.path: list[tuple[int, str]] = []
        self.title, self.skipping, self.level = "", 0, 0
        self.text: list[str] = []
        self.heading: list[str] = []

    def close_block(self) -> None:
        whole = " ".join(" ".join(self.text).split())
        if whole:
            self.blocks.append((" > ".join(t for _, t in self.path), whole))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
        elif tag in HEADINGS and not self.skipping:
            self.close_block()
            self.level, self.heading = HEADINGS[tag], []

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag in HEADINGS and self.level:
            name = " ".join("".join(self.heading).split())
            self.path = [p for p in self.path if p[0] < self.level] + ([(self.level, name)] if name else [])
            if name and self.level == 1 and not self.title:
                self.title = name
            self.level = 0

    def handle_data(self, data):
        if not self.skipping:
            (self.heading if self.level else self.text).append(data)


def html_sections(raw: str | None) -> tuple[str, list[tuple[str, str]]]:
    """(title, blocks): the first h1 is the title, since the head is skipped."""
    parser = _Sections()
    parser.feed(raw or "")
    parser.close()
    parser.close_block()
    return parser.title, parser.blocks


def markdown_sections(raw: str | None) -> tuple[str, list[tuple[str, str]]]:
    """(title, blocks) by ATX headings."""
    path: list[tuple[int, str]] = []
    blocks: list[tuple[str, str]] = []
    title, held = "", []

    def close() -> None:
        text = "\n".join(held).strip()
        if text:
            blocks.append((" > ".join(t for _, t in path), text))
        held.clear()

    for line in (raw or "").splitlines():
        if m := _ATX.match(line):
            close()
            level = len(m[1])
            path[:] = [p for p in path if p[0] < level] + [(level, m[2])]
            title = title or (m[2] if level == 1 else "")
        else:
            held.append(line)
    close()
    return title, blocks


_BLOCKS = "path string, title string, blocks array<struct<section string, text string>>"
#: Rows of a batch that are Python objects at once.
SLICE = 128


def _blocks(frame: DataFrame, key: str, raw: str, path: str, sections) -> DataFrame:
    kind = frame.schema[key].dataType.simpleString()

    def run(batches):
        parts = pa.list_(pa.struct([("section", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                found = [sections(x) for x in rows.column(1).to_pylist()]
                own = [[{"section": s, "text": x} for s, x in b] for _, b in found]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([t for t, _ in found], pa.string()), pa.array(own, parts)], [key, "path", "title", "blocks"])

    return frame.select(key, raw, path).mapInArrow(run, f"{key} {kind}, {_BLOCKS}")


def html_blocks(pages: DataFrame, key: str, raw: str, path: str) -> DataFrame:
    """(key, path, title, blocks) of HTML pages."""
    return _blocks(pages, key, raw, path, html_sections)


def markdown_blocks(files: DataFrame, key: str, raw: str, path: str) -> DataFrame:
    """(key, path, title, blocks) of Markdown texts."""
    return _blocks(files, key, raw, path, markdown_sections)
