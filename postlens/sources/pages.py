"""HTML events of landed pages: the one step that built-in functions lack.

Anchors, list items, headings, images and text lines come out as rows (page_id, kind, pos, text, href,
container); all rules on them are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, kind string, pos int, text string, href string, container string"
_ARROW = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("pos", pa.int32()), ("text", pa.string()), ("href", pa.string()), ("container", pa.string())])
#: Characters that a task gathers before it sends a batch, and those that an event counts for beside its text.
OUT_CHARS, EACH = 1 << 21, 100
_BLOCKS = {"p", "div", "li", "br", "tr", "td", "th", "h1", "h2", "h3", "h4", "article", "section", "ul", "ol", "table", "title"}
_KINDS = {"a", "li", "h1", "td", "tr"}


class _Events(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[str, int]] = []
        self.classes: list[tuple[str, str]] = []
        self.line: list[str] = []
        self.hidden = 0

    def _emit(self, kind: str, href: str | None = None) -> int:
        self.rows.append([kind, len(self.rows), "", href, self.classes[-1][1] if self.classes else ""])
        return len(self.rows) - 1

    def _flush(self) -> None:
        text = " ".join("".join(self.line).split())
        self.line = []
        if text:
            self.rows[self._emit("line")][2] = text

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in _BLOCKS:
            self._flush()
        if tag == "div":
            self.classes.append((tag, a.get("class") or ""))
        if tag == "img":
            self._emit("img", a.get("src") or "")
        elif tag in _KINDS and (tag != "a" or a.get("href")):
            self.open.append((tag, self._emit(tag, a.get("href"))))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self._flush()
        if tag == "div" and self.classes:
            self.classes.pop()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if not self.hidden:
            self.line.append(data)
            for _, at in self.open:
                self.rows[at][2] += data


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def page_events(pages: DataFrame, most: int = OUT_CHARS) -> DataFrame:
    """pages: page_id, html. Broken markup is read as far as it goes; null pages have no events.

    A task holds one page's events and some `most` characters of others, however many pages a batch has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for page_id, html in zip(batch.column(0), batch.column(1), strict=True):
                parser = _Events()
                parser.feed(html.as_py() or "")
                parser.close()
                parser._flush()
                for k, pos, text, href, box in parser.rows:
                    rows.append((page_id.as_py(), k, pos, " ".join(text.split()), href, box))
                    size += len(rows[-1][3]) + EACH
                    if size >= most:
                        yield _packed(rows)
                        rows, size = [], 0
        if rows:
            yield _packed(rows)

    return pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, SCHEMA)


def read_pages(pages: DataFrame, limits: dict[str, int], default: int = 30, site: str = "site") -> DataFrame:
    """pages (site, pos, ...): the first N of each site, N by site name, else the default."""
    from pyspark.sql import Window

    most = F.lit(default)
    for name, n in limits.items():
        most = F.when(F.col(site) == name, n).otherwise(most)
    w = Window.partitionBy(site).orderBy("pos")
    return pages.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= most).drop("_place")
