"""Operators whose rules SQL lacks: Arrow functions over strings, and folds over one document's sequence.

Those with a second entry in QUERIES have an oracle; the others are held against slow versions in tests.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import seams
from quire.plans.dialect import Duck
from quire.plans.views import dialect, prefix
from quire.sources.html import page_events

KINDS = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def mapped(function: Callable, kind: str, arrow_kind: pa.DataType | None = None):
    """Column function that applies ``function`` to the values of its columns; null if any of them is null."""

    @F.arrow_udf(kind)
    def apply(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([None if any(x is None for x in r) else function(*r) for r in rows], arrow_kind or KINDS[kind])

    return apply


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    return spark.sql(f"{prefix(dialect(spark, sf_dir), [name]).rstrip(',')} SELECT * FROM {name}")


def normalize_text(spark, sf_dir):
    r = view(spark, sf_dir, "damaged").select("doc_id", "para", mapped(seams.normalize, "string")("text").alias("text"))
    return r


def fold_titles(spark, sf_dir):
    return view(spark, sf_dir, "paras").select("doc_id", "para", mapped(seams.fold_title, "string")("text").alias("folded"))


def slugs(spark, sf_dir):
    return view(spark, sf_dir, "paras").select("doc_id", "para", mapped(seams.slugify, "string")("text").alias("slug"))


def inline_dehyphenate(spark, sf_dir):
    out = pa.struct([("fixed", pa.string()), ("n", pa.int32())])
    f = mapped(lambda t: dict(zip(("fixed", "n"), seams.dehyphenate(t))), "struct<fixed: string, n: int>", out)
    return view(spark, sf_dir, "damaged").select("doc_id", "para", f("text").alias("x")).select("doc_id", "para", "x.*").where("n > 0")


def engine_agreement(spark, sf_dir):
    """Indel likeness of every paragraph with its damaged copy, skipped only where both have under 40 characters."""
    d = view(spark, sf_dir, "damaged").where("length(text) >= 40 or length(original) >= 40")
    return d.select("doc_id", "para", F.round(mapped(seams.ratio, "double")("original", "text"), 3).alias("ratio"))


def fuzzy_titles(spark, sf_dir):
    """Outline titles against printed entries of the same document: the first with a partial likeness of 85."""
    lines = view(spark, sf_dir, "lines").where("size > 12")
    a = lines.select("doc_id", "line", F.lower("text").alias("title"))
    b = lines.select("doc_id", F.col("line").alias("entry"), F.concat(F.lower(F.expr("substring(text, 1, length(text) - 1)")), F.lit(" 12")).alias("printed"))
    score = a.join(b, "doc_id").withColumn("score", F.round(mapped(seams.partial_ratio, "double")("title", "printed"), 3)).where("score >= 85")
    return score.groupBy("doc_id", "line").agg(F.min("entry").alias("entry"))


def wrapped(spark, sf_dir):
    f = mapped(seams.wrap, "array<string>", pa.list_(pa.string()))
    return view(spark, sf_dir, "paras").select("doc_id", "para", F.posexplode(f("text")).alias("k", "row"))


def _folded(spark, sf_dir, value: str, function, name: str):
    """A fold over a document's paragraphs in order: one number a paragraph."""
    rows = view(spark, sf_dir, "paras").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", F.expr(value).alias("v")))).alias("r"))
    f = mapped(lambda r: [{"para": x["para"], "v": v} for x, v in zip(r, function([x["v"] for x in r]))], "array<struct<para: bigint, v: int>>", pa.list_(pa.struct([("para", pa.int64()), ("v", pa.int32())])))
    return rows.select("doc_id", F.explode(f("r")).alias("x")).select("doc_id", "x.para", F.col("x.v").alias(name))


def nav_nesting(spark, sf_dir):
    return _folded(spark, sf_dir, "cast(para % 4 + para % 3 as int)", seams.nest, "depth")


def packet_chunks(spark, sf_dir):
    return _folded(spark, sf_dir, "size(split(text, ' ')) * 40", seams.chunks, "chunk")


def duplicate_spans(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    docs = spark.table("documents").where("length(text) >= 800").select("doc_id", F.concat("text", F.expr("case when doc_id % 3 = 0 then substring(text, 50, 500) else '' end")).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("earlier", pa.int32()), ("n", pa.int32())]))
    f = mapped(lambda t: [dict(zip(("start", "earlier", "n"), s)) for s in seams.duplicate_spans(t)], "array<struct<start: int, earlier: int, n: int>>", kind)
    return docs.select("doc_id", F.explode(f("text")).alias("s")).select("doc_id", "s.*")


def _events(spark, sf_dir):
    return page_events(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def html_links(spark, sf_dir):
    return _events(spark, sf_dir).where("event = 'start' and tag = 'a'").select("page_id", "pos", F.col("attrs")["href"].alias("href"))


def html_outline(spark, sf_dir):
    return _events(spark, sf_dir).where("event = 'text' and tag rlike '^h[1-6]$'").select("page_id", "pos", F.substring("tag", 2, 1).cast("int").alias("level"), F.col("text").alias("title"))


def html_blocks(spark, sf_dir):
    """Text of paragraphs: inline pieces in order, by running number of the block's start."""
    e = _events(spark, sf_dir)
    from pyspark.sql import Window

    n = F.count(F.when(F.expr("event = 'start' and tag = 'p'"), 1)).over(Window.partitionBy("page_id").orderBy("pos"))
    return e.withColumn("block", n).where("event = 'text' and block > 0 and tag not in ('script', 'style')").groupBy("page_id", "block").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])).alias("text"))


def html_alt(spark, sf_dir):
    return _events(spark, sf_dir).where("event = 'start' and tag = 'img'").groupBy("page_id").agg(F.count_if(F.coalesce(F.col("attrs")["alt"], F.lit("")) == "").alias("missing_alt"), F.count("*").alias("images"))


def html_a11y(spark, sf_dir):
    e = _events(spark, sf_dir).where("event = 'start'")
    return e.groupBy("page_id").agg(F.max(F.expr("tag = 'html' and attrs['lang'] is not null")).alias("has_lang"), F.max(F.col("tag") == "h1").alias("has_h1"), F.max(F.col("tag") == "nav").alias("has_nav"))


def _d(names: list[str], rest: str) -> str:
    return f"{prefix(Duck(), names)} {rest}"


QUERIES = {
    "normalize_text": (normalize_text, _d(["damaged"], "r AS (SELECT doc_id, para, nfc_normalize(text) AS t FROM damaged), f AS (SELECT doc_id, para, translate(replace(replace(t, '­', ''), chr(65279), ''), '‘’“”–—', '''''\"\"--') AS t FROM r) SELECT doc_id, para, trim(regexp_replace(t, '[\\s\\x1c-\\x1f]+', ' ', 'g')) AS text FROM f")),
    "fold_titles": (fold_titles, _d(["paras"], "r AS (SELECT doc_id, para, lower(strip_accents(text)) AS t FROM paras) SELECT doc_id, para, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS folded FROM r")),
    "inline_dehyphenate": (inline_dehyphenate, None),
    "slugs": (slugs, None),
    "engine_agreement": (engine_agreement, None),
    "fuzzy_titles": (fuzzy_titles, None),
    "wrapped_packets": (wrapped, None),
    "nav_nesting": (nav_nesting, None),
    "packet_chunks": (packet_chunks, None),
    "duplicate_spans": (duplicate_spans, None),
    "html_links": (html_links, None),
    "html_outline": (html_outline, None),
    "html_blocks": (html_blocks, None),
    "html_alt": (html_alt, None),
    "html_a11y": (html_a11y, None),
}


def seam_spaces(spark, sf_dir):
    """Spaces lost between two runs of a paragraph, which no rule within one run can see."""
    from quire.operators.text import SPACE_RULES

    runs = view(spark, sf_dir, "paras").select("doc_id", "para", F.regexp_extract("text", r"^(.*?[.!?,;:]) ?(\S.*)$", 1).alias("a"), F.regexp_extract("text", r"^(.*?[.!?,;:]) ?(\S.*)$", 2).alias("b")).where("a <> ''")
    kind = pa.struct([("a", pa.string()), ("b", pa.string()), ("n", pa.int32())])
    f = mapped(lambda a, b: dict(zip("abn", seams.restore_seam(a, b, SPACE_RULES))), "struct<a: string, b: string, n: int>", kind)
    return runs.select("doc_id", "para", f("a", "b").alias("x")).where("x.n > 0").select("doc_id", "para", F.right("x.a", F.lit(4)).alias("head"), F.substring("x.b", 1, 4).alias("tail"))


def _best_heading(spark, sf_dir, tail: str):
    lines = view(spark, sf_dir, "lines").where("size > 12")
    heads = lines.select("doc_id", F.col("line").alias("heading"), F.col("page").alias("heading_page"), F.lower("text").alias("h"))
    entries = lines.select("doc_id", "line", "page", F.lower(F.expr(tail)).alias("e"))
    return entries.join(heads, "doc_id").withColumn("score", F.round(mapped(seams.partial_ratio, "double")("e", "h"), 3))


def contents_links(spark, sf_dir):
    """For each contents entry its likest heading of at least 85; ties prefer the entry's page, then the first."""
    scored = _best_heading(spark, sf_dir, "substring(text, 1, length(text) - 2)").where("score >= 85")
    best = F.max_by("heading", F.struct("score", F.col("page") == F.col("heading_page"), -F.col("heading")))
    return scored.groupBy("doc_id", "line").agg(best.alias("heading"), F.max("score").alias("score"))


def nav_agreement(spark, sf_dir):
    """Titles of the source that no navigation title is like; the navigation here lacks each fourth heading."""
    scored = _best_heading(spark, sf_dir, "text").withColumn("score", F.when(F.col("heading") % 4 == 0, 0).otherwise(F.col("score")))
    return scored.groupBy("doc_id", "line").agg(F.max("score").alias("score")).where("score < 85").select("doc_id", "line")


QUERIES |= {"seam_spaces": (seam_spaces, None), "contents_links": (contents_links, None), "nav_agreement": (nav_agreement, None)}
