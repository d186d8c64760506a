"""The operators of ``prose`` applied to the fixture's tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import seams
from quire.operators import prose as o
from quire.plans.book import table
from quire.plans.views import PRIVATE

ALLOW = ("ti.T", "en.A", "never there")
READINGS = {PRIVATE: " (peace)"}
CONFIG = {"cover": [1], "exclude": [2], "figures": [3, 4], "regions": [5], "columns": [6], "printed_toc": [7], "overrides": [(8, 1), (9, 3)], "drop_numeric": True}
ENTRIES = [(1, "pua-unmapped", None, "as printed"), (2, "image-only-page", 8, "a plate"), (3, "top-band-kept", 99, "a head"), (4, "pua-unmapped", 2, "seen"), (5, "flow-uncoded", None, "none")]
Tables = Callable[[str], DataFrame]


def _entries(t: Tables) -> DataFrame:
    return t("warnings").sparkSession.createDataFrame(ENTRIES, "entry int, code string, page long, note string")


def _resolved(t: Tables) -> DataFrame:
    return o.auto_resolve(t("warnings"), **CONFIG)


def _runs(t: Tables) -> DataFrame:
    return t("book").select("doc_id", F.col("page").alias("para"), F.col("idx").alias("k"), "text", "bold")


def _located(t: Tables) -> DataFrame:
    find = o.applied(lambda hay, needle: dict(zip(("a", "z"), o.find_fuzzy(hay, needle) or (-1, -1))), "struct<a: int, z: int>", pa.struct([("a", pa.int32()), ("z", pa.int32())]))
    return t("needles").select("doc_id", "para", find("text", "needle").alias("x")).select("doc_id", "para", F.col("x.a").alias("start"), F.col("x.z").alias("stop"))


def _excised(t: Tables) -> DataFrame:
    cut = o.applied(lambda hay, needle: dict(zip(("text", "n"), o.excise("3. " + hay, needle, "3"))), "struct<text: string, n: int>", pa.struct([("text", pa.string()), ("n", pa.int32())]))
    return t("needles").where("para % 4 in (0, 3)").select("doc_id", "para", cut("text", "needle").alias("x")).select("doc_id", "para", "x.text", "x.n")


def _covered(t: Tables) -> DataFrame:
    """A paragraph's copy lacks 40 characters in its middle."""
    copy = F.concat(F.substring("text", 1, 50), F.expr("substring(text, 91)"))
    match = o.applied(lambda a, b: dict(zip(("matched", "gaps"), o.coverage(a, b))), "struct<matched: int, gaps: int>", pa.struct([("matched", pa.int32()), ("gaps", pa.int32())]))
    return t("needles").select("doc_id", "para", match(F.substring("text", 1, 400), F.substring(copy, 1, 360)).alias("x")).select("doc_id", "para", "x.*")


def _assembled(t: Tables) -> DataFrame:
    join = o.applied(lambda rows: seams.assemble([r["text"] for r in rows])[0], "string", pa.string())
    return t("hyphened").groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("j", "text"))).alias("l")).select("doc_id", "para", join("l").alias("text"))


def _shifted(t: Tables) -> DataFrame:
    """Whole paragraphs whose characters lie 0x1D too low, mended."""
    low = "".join(chr(c - 0x1D) for c in range(0x20, 0x7B))
    down = F.translate("text", "".join(map(chr, range(0x20, 0x7B))), low)
    mend = o.applied(lambda x: seams.unshift(x)[0] if seams.is_shifted(x) else x, "string", pa.string())
    return t("paras").where("contains(text, ' ')").select("doc_id", "para", mend(down).alias("text"))


def _headings(t: Tables) -> DataFrame:
    return t("book").where("kind = 'head'").select("doc_id", "page", "idx", o.applied(o.fold_heading, "string", pa.string())("text").alias("folded"))


def _ncx(t: Tables) -> DataFrame:
    rows = t("book").where("kind = 'head'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((F.col("page") * 1000 + F.col("idx")).alias("pos"), (F.col("idx") % 3 + 1).cast("int").alias("level"), "text"))).alias("e"))
    make = o.applied(lambda doc, e: o.ncx(f"Book {doc}", f"urn:book:{doc}", [(x["level"], x["text"], f"p{x['pos']}.xhtml") for x in e]), "string", pa.string())
    return rows.select("doc_id", make("doc_id", "e").alias("ncx"))


def _note_texts(t: Tables) -> DataFrame:
    rows = t("book").where("kind = 'note'").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("l"))
    return rows.select("doc_id", "page", o.applied(lambda x: o.note_text([r["text"] for r in x], "1"), "string", pa.string())("l").alias("text"))


def _cross_runs(t: Tables) -> DataFrame:
    """Seams of runs, a paragraph cut behind its first stop and the space there lost."""
    runs = F.array(F.regexp_extract("text", r"^(.*?[.!?,;:]) ?(\S.*)$", 1), F.regexp_extract("text", r"^(.*?[.!?,;:]) ?(\S.*)$", 2))
    mend = o.applied(lambda r: dict(zip(("runs", "n"), o.mend_runs(r))), "struct<runs: array<string>, n: int>", pa.struct([("runs", pa.list_(pa.string())), ("n", pa.int32())]))
    return t("paras").where("text rlike '[.!?,;:] ?[^ ]'").select("doc_id", "para", mend(runs).alias("x")).where("x.n > 0").select("doc_id", "para", F.array_join("x.runs", "|").alias("runs"), "x.n")


NAMED: dict[str, Callable[[Tables], DataFrame]] = {
    "media_types": lambda t: t("names").select("name", o.media_type(F.col("name")).alias("media_type")),
    "css_class": lambda t: t("names").select("name", o.css_class(F.col("name")).alias("css_class")),
    "chunk_suffix": lambda t: t("paras").select("para").distinct().select("para", o.chunk_suffix(F.col("para")).alias("suffix")),
    "list_marker_patterns": lambda t: t("markers").select("doc_id", "para", o.list_marker(F.col("text")).alias("kind")).where("kind is not null"),
    "lost_space_defects": lambda t: o.lost_spaces(t("damaged"), ALLOW),
    "stale_allowances": lambda t: o.stale_allowances(t("damaged"), ALLOW),
    "garble_runs": lambda t: o.garble(t("damaged"), extra="³´«"),
    "pua_residue": lambda t: o.pua_residue(t("damaged")),
    "pua_decode": lambda t: t("damaged").where(F.col("text").rlike(o.PUA)).select("doc_id", "para", o.decode_private(F.col("text"), READINGS).alias("text")),
    "text_fix_chain": lambda t: o.fix_text(t("damaged").select("doc_id", "para", (F.col("para") % 40).alias("page"), "text"), {3: "on", 12: "on"}, READINGS),
    "page_break_html": lambda t: t("book_pages").where("label is not null").select("doc_id", "page", o.page_break(F.col("label")).alias("html")),
    "figure_html": lambda t: o.figure(t("figures")),
    "index_section": lambda t: o.index_sections(t("blocks")),
    "outline_targets": lambda t: o.outline_targets(t("outline")),
    "link_targets": lambda t: o.link_pages(t("links")),
    "link_census": lambda t: o.link_census(t("links")),
    "warning_resolve": lambda t: _resolved(t).select("doc_id", "warning", "resolved_by"),
    "warning_adjudication": lambda t: o.adjudicate(_resolved(t), _entries(t)).select("doc_id", "warning", "code", "note"),
    "stale_adjudications": lambda t: o.stale_entries(_resolved(t), _entries(t)),
    "adjudication_snippet": lambda t: t("warnings").where("page is not null").groupBy("code").agg(F.array_sort(F.collect_set("page")).alias("pages")).select("code", o.adjudication_snippet(F.col("code"), F.col("pages")).alias("snippet")),
    "reader_text": lambda t: o.reader_text(t("events")),
    "bold_ranges": lambda t: o.bold_ranges(_runs(t), t("ranges")),
    "toc_lines": lambda t: o.toc_entries(t("toc")),
    "fuzzy_find": _located,
    "note_excision": _excised,
    "global_coverage": _covered,
    "paragraph_fold": _assembled,
    "shifted_cmap_repair": _shifted,
    "heading_fold": _headings,
    "ncx": _ncx,
    "note_paragraphs": _note_texts,
    "cross_run_spaces_restored": _cross_runs,
}


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.containment(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda s, d, f=f: f(lambda n: table(s, d, n))) for name, f in NAMED.items()} | {"benchmark_containment": _benchmark}
