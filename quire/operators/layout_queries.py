"""The layout operators applied to the fixture's books, one query each; the figures given here are parameters of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout as o
from quire.plans.book import kept, table


class Book:
    """The fixture's tables of one folder and what several queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.lines = table(spark, sf_dir, "book")
        self.spark, self.dir = spark, sf_dir

    @property
    def pages(self) -> DataFrame:
        return table(self.spark, self.dir, "book_pages")

    @property
    def geometry(self) -> DataFrame:
        return kept(self.spark, self.dir, "geometry", lambda: o.column_geometry(self.lines))

    @property
    def shifts(self) -> DataFrame:
        return kept(self.spark, self.dir, "shifts", lambda: o.page_shifts(self.lines, self.geometry))

    @property
    def styled(self) -> DataFrame:
        return o.line_styles(o.framed(self.lines, self.geometry, self.shifts))

    @property
    def strokes(self) -> DataFrame:
        """Quotations are underlined."""
        return self.lines.where("kind = 'quote'").select("doc_id", "page", "x0", F.col("y1").alias("y0"), "x1", "y1")

    @property
    def columns(self) -> DataFrame:
        """Every third page is set in two columns."""
        x0 = F.col("x0") + F.when((F.col("idx") % 2 == 0) & (F.col("page") % 3 == 0), 200).otherwise(0)
        return o.column_suspects(self.lines.withColumn("x0", x0), self.pages)

    @property
    def suspects(self) -> DataFrame:
        return o.structure_suspects(self.lines, self.pages, self.columns, o.ruled_pages(self.strokes))

    @property
    def notes(self) -> DataFrame:
        return o.footnote_census(self.lines, self.pages, self.geometry)

    @property
    def texts(self) -> DataFrame:
        t = self.lines.where("kind <> 'folio'").select("doc_id", (F.col("page") * 1000 + F.col("idx")).alias("para"), "text")
        return t.unionAll(self.lines.where("page % 7 = 3").select("doc_id", (-F.col("page")).alias("para"), F.concat(F.lit("proof.indd "), F.col("page").cast("string")).alias("text")).distinct())

    @property
    def files(self) -> DataFrame:
        """Each heading in a file with some words or a figure."""
        heads = self.lines.where("kind = 'head'").select("doc_id", ((F.col("page") - 1) * 1000 + F.col("idx")).alias("file"), "kind", "text", "page")
        rest = heads.withColumn("kind", F.when(F.col("page") % 3 == 0, "figure").otherwise("body")).withColumn("text", F.substring(F.col("text"), F.lit(1), (25 - 5 * (F.col("page") % 4)).cast("int")))
        return heads.unionAll(rest).drop("page")


def _witness(b: Book) -> DataFrame:
    """Suspects beside lines that a calibrated pass has taken (here: verse of even pages)."""
    v = o.verse_suspects(b.styled)
    taken = b.lines.where("kind = 'verse' and page % 2 = 0").select("doc_id", "page", "idx")
    return v.join(taken, (v.doc_id == taken.doc_id) & (v.page == taken.page) & (taken.idx >= v["first"]) & (taken.idx < v["first"] + v.n), "left_anti")


def _specs(b: Book) -> DataFrame:
    flagged, out = b.columns, None
    for spec in ("auto", "1,4-6+sample:2", "flagged", "all"):
        one = o.resolve_pages(spec, b.pages, flagged, b.suspects, o.sampled(b.pages)).select(F.lit(spec).alias("spec"), "doc_id", "page")
        out = one if out is None else out.unionAll(one)
    return out


NAMED: dict[str, Callable[[Book], DataFrame]] = {
    "column_geometry": lambda b: o.column_geometry(b.lines).drop("widest"),
    "page_shift": lambda b: o.page_shifts(b.lines, b.geometry),
    "line_style_key": lambda b: b.styled.select("doc_id", "page", "idx", "style"),
    "style_clusters": lambda b: o.style_clusters(b.styled),
    "style_samples": lambda b: o.style_samples(b.styled),
    "top_band": lambda b: o.top_band(b.lines),
    "furniture_templates": lambda b: o.furniture(b.lines),
    "printed_folio": lambda b: o.printed_folios(b.lines, b.pages),
    "folio_agreement": lambda b: o.folio_agreement(o.printed_folios(b.lines, b.pages), b.pages),
    "footnote_census": lambda b: b.notes,
    "joining_stats": lambda b: o.joining_stats(o.line_styles(o.framed(o.tallied(b.lines), b.geometry, b.shifts))),
    "column_suspects": lambda b: b.columns,
    "furniture_strip": lambda b: o.strip_furniture(b.lines, b.pages, o.furniture(b.lines), baseline=40.0),
    "furniture_leak": lambda b: o.furniture_leaks(b.texts, o.furniture(b.lines), title="Part of src3"),
    "image_only_pages": lambda b: o.image_only(b.lines, b.pages),
    "continues_block": lambda b: b.styled.where(o.continues_block()).select("doc_id", "page", "idx"),
    "structure_suspects": lambda b: b.suspects,
    "ruled_pages": lambda b: o.ruled_pages(b.strokes),
    "uncovered_images": lambda b: o.uncovered_images(b.pages, b.pages.where("page in (1, 5, 20)")),
    "left_stops": lambda b: o.left_stops(b.styled),
    "paragraph_geometry": lambda b: o.paragraph_geometry(b.lines.where("para >= 0")),
    "page_anchors": lambda b: o.body_anchors(b.lines, b.geometry),
    "dropcap_wrap_veto": lambda b: o.dropcap_veto(b.lines, b.geometry),
    "verse_suspects": lambda b: o.verse_suspects(b.styled),
    "verse_witness": _witness,
    "orphan_headings": lambda b: o.orphan_headings(b.files),
    "line_order": lambda b: o.line_order(b.lines),
    "render_queue": lambda b: o.render_queue([(b.columns, 4), (b.notes, 2), (o.ruled_pages(b.strokes), 0)], b.pages),
    "page_spec": _specs,
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda s, d, f=f: f(Book(s, d))) for name, f in NAMED.items()}
