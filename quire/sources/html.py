"""Element events of web pages: start tags, end tags and text, in order, by the parser of the standard library."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

EVENTS = "page_id bigint, pos int, event string, tag string, depth int, attrs map<string,string>, text string"
ARROW = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("event", pa.string()), ("tag", pa.string()), ("depth", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.rows.append(("start", tag, len(self.open), {k: v or "" for k, v in dict(attrs).items()}, None))
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self.rows.append(("end", tag, len(self.open), {}, None))

    def handle_data(self, data):
        if data.strip():
            self.rows.append(("text", self.open[-1] if self.open else "", len(self.open), {}, data.strip()))


def events(html: str | None) -> list[tuple]:
    parser = _Events()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def page_events(pages: DataFrame) -> DataFrame:
    """page_id, pos, event, tag, depth, attrs and text of all elements; no shuffle, one page at a time in memory."""

    def run(batches):
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                rows = events(html)
                if rows:
                    kind, tag, depth, attrs, text = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([page_id] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(kind), pa.array(tag), pa.array(depth, pa.int32()), pa.array([list(a.items()) for a in attrs], ARROW.field("attrs").type), pa.array(text, pa.string())], schema=ARROW)

    return pages.select("page_id", "html").mapInArrow(run, EVENTS)
