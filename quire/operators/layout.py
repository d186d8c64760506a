"""Layout of a book's pages, as functions of DataFrames of physical lines and pages.

Lines have doc_id, page, idx (the place on the page), text, x0, x1, y0, y1, size, family, italic, bold, vertical; pages have
doc_id, page, label, n_images and the trim box. All work is by document, or by document and page, in built-in expressions.
Ties of the most common value go to the one seen first. The oracles in ``quire.oracles.layout`` are written apart from this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
ROMAN = "^[ivxlcdm]+$"
PLACE = "page * 100000 + idx"
FOLIO_BAND = 50.0
SLUGS = [r"\.indd\s", r"\d+/\d+/\d+\s+\d+:\d+\s*[AP]M", r"(?i)^Page [ivxlcdm\d]+$"]


def most_common(rows: DataFrame, keys: list[str], value: Column, weight: Column | None = None, seen: Column | None = None) -> DataFrame:
    """keys, value and n of the most common value (by weight), the first seen of equals."""
    each = rows.groupBy(*keys, value.alias("value")).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"), F.min(F.expr(PLACE) if seen is None else seen).alias("seen"))
    best = F.max_by(F.struct("value", "n"), F.struct(F.col("n"), -F.col("seen")))
    return each.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.value", F.col("best.n").cast("bigint").alias("n"))


def column_geometry(lines: DataFrame, wide: float = 0.55) -> DataFrame:
    """doc_id, col_left, col_right, body_size: modal edges of the lines of at least ``wide`` of the widest, size of most characters."""
    each = lines.groupBy("doc_id", "x0", "x1", "size").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.min(F.expr(PLACE)).alias("seen"))
    each = each.withColumn("widest", F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy("doc_id")))
    long = each.where((F.col("x1") - F.col("x0")) >= wide * F.col("widest"))
    left = most_common(long, ["doc_id"], F.rint("x0"), F.col("lines"), F.col("seen")).select("doc_id", F.col("value").alias("col_left"))
    right = most_common(long, ["doc_id"], F.rint("x1"), F.col("lines"), F.col("seen")).select("doc_id", F.col("value").alias("col_right"))
    size = most_common(each, ["doc_id"], F.col("size"), F.col("chars"), F.col("seen")).select("doc_id", F.col("value").alias("body_size"))
    return left.join(right, "doc_id").join(size, "doc_id").join(each.groupBy("doc_id").agg(F.max("widest").alias("widest")), "doc_id")


def page_shifts(lines: DataFrame, geometry: DataFrame, wide: float = 0.55, full: float = 10.0, least: float = 6.0, support: int = 3) -> DataFrame:
    """doc_id, page, shift of pages whose whole block slid: the modal left edge has ``support`` lines, one of them of full measure,
    lies ``least`` points off the column's, and fewer than ``support`` lines span the column itself."""
    long = lines.join(geometry, "doc_id").where((F.col("x1") - F.col("x0")) >= wide * F.col("widest"))
    measure = F.col("x1") - F.col("x0") >= F.col("col_right") - F.col("col_left") - full
    spans = (F.abs(F.col("x0") - F.col("col_left")) <= 2) & (F.col("x1") >= F.col("col_right") - full)
    edges = long.groupBy(*PAGE, "col_left", F.rint("x0").alias("edge")).agg(F.count("*").alias("n"), F.min(F.expr(PLACE)).alias("seen"), F.bool_or(measure).alias("full"), F.count_if(spans).alias("spans"))
    seen = edges.groupBy(*PAGE, "col_left").agg(F.max_by(F.struct("edge", "n", "full"), F.struct(F.col("n"), -F.col("seen"))).alias("best"), F.sum("spans").alias("spans"))
    shift = F.col("col_left") - F.col("best.edge")
    return seen.where((F.col("best.n") >= support) & F.col("best.full") & (F.abs(shift) >= least) & (F.col("spans") < support)).select(*PAGE, shift.alias("shift"))


def framed(lines: DataFrame, geometry: DataFrame, shifts: DataFrame) -> DataFrame:
    """lines with the column's edges on their own page (left, right), the body's size, the page's shift and the line before."""
    before = Window.partitionBy(PAGE).orderBy("idx")
    slid = shifts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "shift"))).alias("shifts"))
    frame = geometry.join(slid, "doc_id", "left")  # a row a document, so that lines are shuffled once and never for their page's sake
    rows = lines.join(frame.hint("shuffle_hash"), "doc_id").withColumn("shift", F.coalesce(F.try_element_at("shifts", "page"), F.lit(0.0))).drop("shifts")
    rows = rows.withColumn("left", F.col("col_left") - F.col("shift")).withColumn("right", F.col("col_right") - F.col("shift"))
    return rows.withColumn("prev", F.lag(F.struct("x0", "x1", "y0")).over(before))


def continues_block() -> Column:
    """Of framed lines: the line before has the same left edge, reaches the right margin and stands one leading above."""
    gap = F.col("y0") - F.col("prev.y0")
    return F.coalesce((F.abs(F.col("prev.x0") - F.col("x0")) <= 2) & (F.col("prev.x1") >= F.col("right") - 6) & (gap > 0) & (gap <= 2 * F.greatest("size", F.lit(8.0))), F.lit(False))


def line_styles(rows: DataFrame, tolerance: float = 10.0, inset: float = 10.0) -> DataFrame:
    """Framed lines with ``style``, family@size, and /center where a line is centred clear of both edges and is no last line of a block."""
    body = (F.col("body_size") > 0) & (F.col("size") <= F.col("body_size") + 1)
    clear = F.when(body, F.greatest(F.lit(inset), 0.12 * (F.col("col_right") - F.col("col_left")))).otherwise(inset)
    middle = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("left") + F.col("right")) / 2) <= tolerance
    centred = middle & (F.col("x0") >= F.col("left") + clear) & (F.col("x1") <= F.col("right") - clear) & ~(body & continues_block())
    size = F.regexp_replace(F.col("size").cast("string"), r"\.0$", "")
    return rows.withColumn("centred", centred).withColumn("style", F.concat("family", F.lit("@"), size, F.when(centred, "/center").otherwise("")))


def style_clusters(rows: DataFrame) -> DataFrame:
    """Lines, characters, pages and a proposed role of every style of styled lines."""
    each = rows.groupBy("doc_id", "style", "centred", "size").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.countDistinct("page").alias("n_pages"), F.min("page").alias("first_page"), F.min(F.expr(PLACE)).alias("seen"))
    main = each.groupBy("doc_id").agg(F.max_by(F.struct("style", "size"), F.struct(F.col("n_chars"), -F.col("seen"))).alias("main"))
    ratio = F.col("size") / F.col("main.size")
    role = (
        F.when(F.col("style") == F.col("main.style"), "p").when(ratio >= 1.8, "title-page").when(ratio >= 1.35, "h1").when((ratio >= 1.03) & F.col("centred"), "h2")
        .when(F.col("centred") & (ratio >= 0.97), "h3").when((ratio <= 0.85) & (F.col("n_lines") >= 10), "footnote").otherwise("p")
    )
    return each.join(main, "doc_id").select("doc_id", "style", "n_lines", "n_chars", "n_pages", "first_page", role.alias("role"))


def style_samples(rows: DataFrame, most: int = 3, over: int = 15, under: int = 90) -> DataFrame:
    """The first ``most`` lines of each style that are neither short nor long."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "style").orderBy("page", "idx"))
    some = rows.where((F.length("text") > over) & (F.length("text") < under)).withColumn("k", nth.cast("bigint"))
    return some.where(F.col("k") <= most).select("doc_id", "style", "k", F.trim("text").alias("text"))


def top_band(lines: DataFrame, share: float = 0.8, gap: float = 6.0) -> DataFrame:
    """doc_id and top_band: 4 pt below the ``share`` quantile of first lines that stand apart, 0 if too few pages have one."""
    ys = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list("y0")).alias("ys"))
    each = ys.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.when((F.size("ys") >= 3) & (F.col("ys")[1] - F.col("ys")[0] >= gap), F.col("ys")[0]))).alias("firsts"))
    enough = F.size("firsts") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 10))
    at = F.floor(F.size("firsts") * share).cast("int") + 1
    return each.select("doc_id", F.when(enough, F.round(F.try_element_at("firsts", at) + 4, 1)).otherwise(0.0).alias("top_band"))


def normal(text: Column) -> Column:
    """Canonical spelling of a line for comparisons: quotes and dashes plain, spaces single."""
    spaced = lambda x: F.trim(F.when(x.rlike(r"(?U)[\s&&[^ ]]|  "), F.regexp_replace(x, r"(?U)\s+", " ")).otherwise(x))
    return once(F.translate(text, "‘’“”–—­﻿", "''\"\"--"), spaced)


def once(x: Column, function) -> Column:
    """``function`` of a value that it names several times but that is made once."""
    return F.transform(F.array(x), function)[0]


def template(text: Column) -> Column:
    """Digits become #, and roman numerals at either edge."""
    digits = lambda x: F.when(x.rlike(r"\d"), F.regexp_replace(x, r"\d+", "#")).otherwise(x)
    edges = lambda x: F.trim(F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike("(?i)[ivxlcdm]"), F.regexp_replace(x, "(?i)^[ivxlcdm]+|[ivxlcdm]+$", "#")).otherwise(x))
    return once(once(normal(text), digits), edges)


def is_folio(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^(\d{1,4}|[ivxlcdm]+)$")


def plausible(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), (F.length(text) <= 9) & (text.try_cast("int") > 0) & (text.try_cast("int") < 1000)).otherwise(F.lower(text).rlike(ROMAN) & (F.length(text) <= 8))


def furniture(lines: DataFrame, least: int = 3, longest: int = 60) -> DataFrame:
    """Templates of the first two lines of pages and of last lines that are folios, which occur ``least`` times, with their first 8 pages."""
    last = lines.groupBy(*PAGE).agg(F.max("idx").alias("idx"))
    top = lines.where("idx <= 1").select("doc_id", "page", "idx", F.lit("top").alias("band"), template(F.col("text")).alias("template"))
    folios = lines.where(F.col("text").rlike(r"(?U)^[\s\u00ad\ufeff0-9ivxlcdmIVXLCDM]+$")).where(is_folio(normal(F.col("text")))).select("doc_id", "page", "idx", F.lit("bottom").alias("band"), template(F.col("text")).alias("template"))
    bottom = folios.join(last, [*PAGE, "idx"], "left_semi")
    some = top.unionAll(bottom).where((F.col("template") != "") & (F.col("template") != "#") & (F.length("template") <= longest))
    each = some.groupBy("doc_id", "template").agg(F.count("*").alias("n"), F.min_by("band", F.struct("page", "idx", F.col("band") == "bottom")).alias("band"), F.array_sort(F.collect_set("page")).alias("pages"))
    return each.where(F.col("n") >= least).select("doc_id", "template", "n", "band", F.array_join(F.slice("pages", 1, 8), " ").alias("pages"))


def printed_folios(lines: DataFrame, pages: DataFrame, band: float = FOLIO_BAND) -> DataFrame:
    """doc_id, page, folio: a folio line among a page's first and last within the bands, or digits fused to such a line's edge."""
    last = lines.groupBy(*PAGE).agg(F.max("idx").alias("n"))
    t = F.trim("text")
    fused = F.coalesce(F.nullif(F.regexp_extract(t, r"^(\d{1,3})\D", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"\D(\d{1,3})$", 1), F.lit("")))
    folio = F.when(is_folio(t) & plausible(t), t).when(plausible(fused), fused)
    digit = F.left(t, F.lit(1)).between("0", "9") | F.right(t, F.lit(1)).between("0", "9")
    some = lines.where(digit | F.lower(t).rlike(ROMAN)).select(*PAGE, "idx", "y0", "y1", folio.alias("folio")).where("folio is not null")  # few lines have one, so that no others are shuffled
    rows = some.join(last, PAGE).where("idx = 0 or idx = n").join(pages.select(*PAGE, "trim_y0", "trim_y1"), PAGE)
    found = rows.where((F.col("y0") <= F.col("trim_y0") + band) | (F.col("y1") >= F.col("trim_y1") - band))
    return found.groupBy(*PAGE).agg(F.min_by("folio", "idx").alias("folio"))


def folio_agreement(folios: DataFrame, pages: DataFrame, trust: float = 97.0) -> DataFrame:
    """Agreement in percent of printed folios with page labels, and which of the two to take labels from."""
    both = pages.join(folios, PAGE, "left")
    same = F.lower(normal(F.col("folio"))) == F.lower(normal(F.col("label")))
    each = both.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count("folio").alias("printed"), F.count("label").alias("labels"), F.count_if(F.col("folio").isNotNull() & F.col("label").isNotNull()).alias("total"), F.count_if(same).alias("agree"))
    pct = F.round(100 * F.col("agree") / F.col("total"), 1)
    source = (
        F.when((F.col("total") > 0) & (pct >= trust), "pdf-page-labels").when((F.col("total") > 0) & (F.col("printed") >= F.floor(F.col("pages") / 3)), "printed-folios").when(F.col("total") > 0, "synthetic")
        .when(F.col("printed") > 0, "printed-folios").when(F.col("labels") > 0, "pdf-page-labels").otherwise("synthetic")
    )
    return each.select("doc_id", "printed", "total", F.when(F.col("total") > 0, pct).alias("agreement"), source.alias("label_source"))


def footnote_census(lines: DataFrame, pages: DataFrame, geometry: DataFrame, smaller: float = 1.5, least: int = 30) -> DataFrame:
    """doc_id, page, n_chars, marker of pages that end in small type, folio lines in the bottom band passed over."""
    up = Window.partitionBy(PAGE).orderBy(F.desc("idx"))
    frame = pages.select(*PAGE, "trim_y1").join(geometry.select("doc_id", "body_size"), "doc_id")
    rows = lines.join(frame.hint("shuffle_hash"), PAGE)
    folio = (F.col("y1") >= F.col("trim_y1") - FOLIO_BAND) & is_folio(normal(F.col("text")))
    rows = rows.withColumn("skip", F.min(folio).over(up)).where("not skip")
    region = rows.withColumn("small", F.min((F.col("size") <= F.col("body_size") - smaller) & ~F.col("vertical")).over(up)).where("small")
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " "))
    notes = region.groupBy(*PAGE).agg(text.alias("t")).where(F.length("t") > least)
    marker = F.when(F.col("t").rlike(r"^\d{1,3}[.)]\s"), "digits").when(F.col("t").rlike("^[*†‡]"), "asterisk")
    return notes.select(*PAGE, F.length("t").cast("bigint").alias("n_chars"), marker.alias("marker"))


def joining_stats(rows: DataFrame) -> DataFrame:
    """Of the style of most characters: upper median of the leading, hyphens at line ends, spaces lost, and the threshold of an indent."""
    rows = rows if "chars" in rows.columns else tallied(rows)
    gap = F.col("y0") - F.lag("y0").over(Window.partitionBy(*PAGE, "style").orderBy("idx"))
    edges = rows.withColumn("gap", gap).groupBy("doc_id", "style", F.rint("x0").alias("v")).agg(
        F.count("*").alias("n"), F.min(F.expr(PLACE)).alias("seen"), F.sum("chars").alias("chars"), F.sum("eol").alias("eol"), F.sum("lost").alias("lost"), F.collect_list(F.when((F.col("gap") > 5) & (F.col("gap") < 40), F.col("gap"))).alias("gaps")
    )
    each = edges.groupBy("doc_id", "style").agg(F.sum("chars").alias("chars"), F.min("seen").alias("first"), F.sum("eol").alias("eol"), F.sum("lost").alias("lost"), F.flatten(F.collect_list("gaps")).alias("gaps"), F.collect_list(F.struct("n", (-F.col("seen")).alias("before"), "v")).alias("edges"))
    body = each.groupBy("doc_id").agg(F.max_by(F.struct("eol", "lost", "gaps", "edges"), F.struct(F.col("chars"), -F.col("first"))).alias("b")).select("doc_id", "b.*")
    body = body.withColumn("g", F.array_sort("gaps")).withColumn("base", F.array_max("edges")["v"])
    off = lambda e: e["v"] - F.col("base")
    steps = body.withColumn("steps", F.filter("edges", lambda e: (off(e) > 2) & (off(e) < 60))).withColumn("top", F.array_max(F.transform("steps", lambda e: e["n"])))
    indent = F.array_min(F.transform(F.filter("steps", lambda e: e["n"] >= F.col("top") * 0.5), off))
    lead = F.try_element_at("g", F.floor(F.size("g") / 2).cast("int") + 1)
    return steps.select("doc_id", F.round(lead, 1).alias("leading"), F.round(indent * 0.75, 1).alias("indent"), F.col("eol").alias("eol_hyphens"), F.col("lost").cast("bigint").alias("lost_spaces"))


def tallied(lines: DataFrame) -> DataFrame:
    """Lines with what ``joining_stats`` counts in their text instead of the text: chars, eol (a hyphen at the end), lost (spaces)."""
    t = F.rtrim("text")
    return lines.withColumns({"chars": F.length("text"), "eol": t.rlike("[A-Za-z]-$").cast("bigint"), "lost": F.regexp_count(t, F.lit('[a-z][.!?,;:]["”’]?[A-Z“"]'))}).drop("text")


def column_suspects(lines: DataFrame, pages: DataFrame, least: int = 12, side: int = 6, apart: float = 30.0) -> DataFrame:
    """Pages on which many lines start on either side of the middle, with a gap between."""
    rows = lines.join(pages, PAGE).where("y0 > trim_y0 + 60 and y0 < trim_y1 - 60")
    wide, mid = F.col("trim_x1") - F.col("trim_x0"), (F.col("trim_x0") + F.col("trim_x1")) / 2
    each = rows.groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(F.col("x0") < mid - 0.1 * wide).alias("n_left"), F.count_if(F.col("x0") > mid + 0.05 * wide).alias("n_right"), F.bool_or("vertical").alias("v"), F.min(F.when(F.col("x0") > mid, F.col("x0"))).alias("r"), F.coalesce(F.max(F.when(F.col("x0") <= mid, F.col("x0"))), F.min("trim_x0")).alias("l"))
    return each.where((F.col("n") >= least) & (F.col("n_left") >= side) & (F.col("n_right") >= side) & ~F.col("v") & (F.col("r") - F.col("l") > apart)).select(*PAGE, "n_left", "n_right")


def strip_furniture(lines: DataFrame, pages: DataFrame, found: DataFrame, band: float = FOLIO_BAND, baseline: float | None = None) -> DataFrame:
    """doc_id, page, idx, reason of every line: folio, head or baseline for furniture, kept for others.

    Only the first and last two lines of a page within the bands are tried; ``baseline`` is where heads stand.
    """
    rows = lines.withColumn("n", F.max("idx").over(Window.partitionBy(PAGE))).join(pages.select(*PAGE, "trim_y0", "trim_y1"), PAGE)
    edge = (F.col("idx") <= 1) | (F.col("idx") >= F.col("n") - 1)
    near = (F.col("y0") <= F.col("trim_y0") + band) | (F.col("y1") >= F.col("trim_y1") - band)
    rows = rows.withColumn("template", template(F.col("text"))).join(found.select("doc_id", "template", F.lit(True).alias("known")), ["doc_id", "template"], "left")
    on_line = (F.abs(F.col("y0") - baseline) <= 3) & F.col("template").rlike("^#|#$") if baseline is not None else F.lit(False)
    reason = F.when(~(edge & near), "kept").when(is_folio(normal(F.col("text"))), "folio").when(F.col("known"), "head").when(on_line, "baseline").otherwise("kept")
    return rows.select(*PAGE, "idx", reason.alias("reason"))


def fold_title(text: Column) -> Column:
    """Lower case without marks: decomposed letters can't be had from built-ins, so marks that stand alone are what goes."""
    return F.regexp_replace(F.lower(normal(text)), "[^a-z0-9 ]+", "")


def furniture_leaks(texts: DataFrame, found: DataFrame, title: str = "", longest: int = 120) -> DataFrame:
    """Paragraphs (doc_id, para, text) that are running heads or printers' slugs; one equal to the book's title is exempt."""
    t = F.trim("text")
    rows = texts.where((t != "") & (F.length(t) <= longest)).withColumn("template", template(t))
    if title:
        rows = rows.where(fold_title(t) != fold_title(F.lit(title)))
    known = rows.join(found.select("doc_id", "template").distinct().withColumn("known", F.lit(True)), ["doc_id", "template"], "left")
    slug = F.lit(False)
    for s in SLUGS:
        slug = slug | t.rlike(s)
    return known.where(F.coalesce("known", F.lit(False)) | slug).select("doc_id", "para", F.substring(t, 1, 80).alias("leak"), F.coalesce("known", F.lit(False)).alias("is_head"))


def image_only(lines: DataFrame, pages: DataFrame, under: int = 20) -> DataFrame:
    """Pages with an image and fewer than ``under`` characters."""
    chars = lines.groupBy(*PAGE).agg(F.sum(F.length("text")).cast("bigint").alias("n_chars"))
    return pages.join(chars, PAGE, "left").withColumn("n_chars", F.coalesce("n_chars", F.lit(0))).where((F.col("n_chars") < under) & (F.col("n_images") >= 1)).select(*PAGE, "n_chars")


def structure_suspects(lines: DataFrame, pages: DataFrame, columns: DataFrame, ruled: DataFrame, narrow: float = 0.4, least: int = 8) -> DataFrame:
    """Pages that may hold a table or figure, with every reason: columns, images, rules, or ``least`` lines narrower than ``narrow`` of the trim."""
    short = lines.join(pages, PAGE).where((F.col("trim_x1") > F.col("trim_x0")) & (F.col("x1") - F.col("x0") < narrow * (F.col("trim_x1") - F.col("trim_x0")))).groupBy(*PAGE).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    reasons = [(columns, "columns"), (pages.where("n_images > 0"), "image"), (ruled, "rules"), (short, "narrow lines")]
    every = None
    for rows, why in reasons:
        one = rows.select(*PAGE, F.lit(why).alias("why"))
        every = one if every is None else every.unionAll(one)
    return every.groupBy(*PAGE).agg(F.array_join(F.array_sort(F.collect_set("why")), ", ").alias("why"))


def ruled_pages(strokes: DataFrame, rules: int = 3, length: float = 30.0) -> DataFrame:
    """Pages of strokes (doc_id, page, x0, y0, x1, y1) with ``rules`` parallel lines of at least ``length``, at places a point apart."""
    flat = (F.abs(F.col("y0") - F.col("y1")) < 1) & (F.abs(F.col("x0") - F.col("x1")) >= length)
    tall = (F.abs(F.col("x0") - F.col("x1")) < 1) & (F.abs(F.col("y0") - F.col("y1")) >= length)
    each = strokes.groupBy(*PAGE).agg(F.countDistinct(F.when(flat, F.rint("y0"))).alias("rows"), F.countDistinct(F.when(tall & ~flat, F.rint("x0"))).alias("columns"))
    return each.where((F.col("rows") >= rules) | (F.col("columns") >= rules))


def uncovered_images(pages: DataFrame, covered: DataFrame) -> DataFrame:
    """Pages with images that no figure or cover page of ``covered`` (doc_id, page) takes in."""
    return pages.where("n_images > 0").join(covered.select(*PAGE), PAGE, "left_anti").select(*PAGE, F.col("n_images").cast("bigint").alias("n_images"))


def left_stops(rows: DataFrame, least: int = 3, deep: float = 18.0, share: float = 0.10, veto: float = 2.0) -> DataFrame:
    """Of framed lines: left edges, in the column's own frame, at which ``least`` lines that reach its right edge start, short of a deep inset."""
    cap = F.col("col_left") + F.greatest(F.lit(deep), share * (F.col("col_right") - F.col("col_left"))) - veto
    at = F.col("x0") + F.col("shift")
    some = rows.where((F.col("x1") >= F.col("right") - 6) & (at < cap)).groupBy("doc_id", F.rint(at).alias("stop")).agg(F.count("*").alias("n"))
    return some.where(F.col("n") >= least)


def paragraph_geometry(lines: DataFrame) -> DataFrame:
    """Of each paragraph (doc_id, para): the size of most characters, the smaller of equals, and its letters, italic and bold ones."""
    letters = F.regexp_count("text", F.lit(r"[\p{L}&&[\x{0}-\x{2E7F}]]"))
    sizes = lines.groupBy("doc_id", "para", "size").agg(F.sum(F.length("text")).alias("n"), F.sum(letters).alias("letters"), F.sum(F.when(F.col("italic") | F.col("family").rlike("(?i)italic|oblique"), letters).otherwise(0)).alias("i"), F.sum(F.when(F.col("bold") | F.col("family").rlike("(?i)bold|black|heavy"), letters).otherwise(0)).alias("b"), F.min("page").alias("page"))
    return sizes.groupBy("doc_id", "para").agg(F.min("page").alias("first_page"), F.max_by("size", F.struct(F.col("n"), -F.col("size"))).alias("size"), F.sum("letters").cast("bigint").alias("letters"), F.sum("i").cast("bigint").alias("italic"), F.sum("b").cast("bigint").alias("bold"))


def body_anchors(lines: DataFrame, geometry: DataFrame, off: float = 2.0, left_off: float = 3.0, least: float = 100.0) -> DataFrame:
    """doc_id, page, left, right: the least x0 and, of lines that start there, the greatest x1 which two lines of body size share."""
    rows = lines.join(geometry.select("doc_id", "body_size"), "doc_id").where((F.abs(F.col("size") - F.col("body_size")) <= 2) & ~F.col("vertical"))
    near = lambda by: F.expr(f"count(*) over (partition by doc_id, page order by {by} range between {off}D preceding and {off}D following)")
    left = F.min(F.when(F.col("n") >= 2, F.col("x0"))).over(Window.partitionBy(*PAGE))
    ends = rows.withColumn("n", near("x0")).withColumn("left", left).where(F.abs(F.col("x0") - F.col("left")) <= left_off).withColumn("n", near("x1"))
    page = ends.groupBy(*PAGE, "left").agg(F.coalesce(F.max(F.when(F.col("n") >= 2, F.col("x1"))), F.max("x1")).alias("right"))
    return page.where(F.col("right") - F.col("left") >= least).select(*PAGE, "left", "right")


def dropcap_veto(lines: DataFrame, geometry: DataFrame, beside: float = 6.0) -> DataFrame:
    """doc_id, page, idx of lines that stand beside an initial: it is twice the body's size, one or two letters, and ends where they start."""
    sized = lines.join(geometry.select("doc_id", "body_size"), "doc_id")
    caps = sized.where((F.col("size") >= 2 * F.col("body_size")) & F.trim("text").rlike(r"^\p{L}{1,2}$")).select(*PAGE, F.col("idx").alias("cap"), F.col("y0").alias("top"), F.col("y1").alias("bottom"), F.col("x1").alias("edge"))
    near = lines.join(caps, PAGE).where((F.col("idx") != F.col("cap")) & (F.col("y0") < F.col("bottom")) & (F.col("y1") > F.col("top")) & (F.abs(F.col("x0") - F.col("edge")) <= beside))
    return near.select(*PAGE, "idx").distinct()


def verse_suspects(rows: DataFrame, floor: float = 18.0, share: float = 0.06, cluster: float = 2.0, apart: float = 6.0, ragged: float = 6.0) -> DataFrame:
    """Runs of styled lines that look like verse though nothing was calibrated, as evidence: doc_id, page, first, n, base, levels.

    Short lines inside the column and not above the body's size: three or more at two levels of indent, the first at the base one, or four
    at one inset; both inset by ``apart`` and with ragged ends.
    """
    short = F.greatest(F.lit(floor), share * F.greatest(F.lit(1.0), F.col("right") - F.col("left")))
    fit = ~F.col("centred") & ~F.col("vertical") & (F.col("size") <= F.col("body_size") + 1) & (F.col("x0") >= F.col("left") - 2) & (F.col("x1") <= F.col("right") - short)
    own = rows.withColumn("run", F.col("idx") - F.row_number().over(Window.partitionBy(*PAGE, fit).orderBy("idx"))).where(fit)
    off = F.col("x0") - F.col("left")
    runs = own.groupBy(*PAGE, "run").agg(F.min("idx").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(off)).alias("offs"), F.min_by(off, "idx").alias("opens"), (F.max("x1") - F.min("x1")).alias("spread"))
    # a level is an offset over ``cluster`` above the level before
    levels = F.aggregate("offs", F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > cluster), F.concat(acc, F.array(x))).otherwise(acc))
    runs = runs.where("n >= 3").withColumn("levels", levels).withColumn("base", F.col("levels")[0])
    two = (F.size("levels") >= 2) & (F.try_element_at("levels", F.lit(2)) - F.col("base") >= apart) & (F.col("base") >= apart) & (F.col("opens") <= F.col("base") + cluster)
    one = (F.size("levels") == 1) & (F.col("n") >= 4) & (F.col("base") >= apart)
    return runs.where((two | one) & (F.col("spread") >= ragged)).select(*PAGE, "first", "n", F.round("base", 1).alias("base"), F.size("levels").cast("bigint").alias("levels"))


def orphan_headings(files: DataFrame, under: int = 20) -> DataFrame:
    """Files (doc_id, file, kind, text) with a heading, no figure, and fewer than ``under`` characters besides headings."""
    each = files.groupBy("doc_id", "file").agg(F.bool_or(F.col("kind") == "head").alias("heading"), F.bool_or(F.col("kind") == "figure").alias("figure"), F.sum(F.when(F.col("kind").isin("head", "figure"), 0).otherwise(F.length("text"))).cast("bigint").alias("chars"))
    return each.where(F.col("heading") & ~F.col("figure") & (F.col("chars") < under)).select("doc_id", "file", "chars")


def line_order(fragments: DataFrame) -> DataFrame:
    """Reading order of a page's fragments: by the top to a tenth of a point, then from the left."""
    w = Window.partitionBy(PAGE).orderBy(F.expr("round(y0, 1)"), "x0", "idx")
    return fragments.select(*PAGE, "idx", F.row_number().over(w).cast("bigint").alias("position"))


def render_queue(heads: list[tuple[DataFrame, int]], pages: DataFrame) -> DataFrame:
    """Pages to look at: the first rows of each list of evidence (0: all of them) and page 1, within the book."""
    every = pages.where("page = 1").select(*PAGE)
    for rows, most in heads:
        one = rows.select(*PAGE).distinct()
        if most:
            one = one.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("k") <= most).drop("k")
        every = every.unionAll(one)
    return every.distinct().join(pages.select(*PAGE), PAGE, "left_semi")


def resolve_pages(spec: str, pages: DataFrame, flagged: DataFrame, suspects: DataFrame, samples: DataFrame) -> DataFrame:
    """Pages that a spec names: all, flagged, auto (flagged and suspects), or numbers and ranges as 1,4-6; ``+sample:N`` adds N sampled ones."""
    spec, _, more = spec.partition("+sample:")
    if spec == "all":
        rows = pages
    elif spec == "flagged":
        rows = flagged
    elif spec == "auto":
        rows = flagged.select(*PAGE).unionAll(suspects.select(*PAGE))
    else:
        test = F.lit(False)
        for part in spec.split(","):
            a, _, b = part.strip().partition("-")
            test = test | F.col("page").between(int(a), int(b or a))
        rows = pages.where(test)
    rows = rows.select(*PAGE)
    if more:
        rows = rows.unionAll(samples.where(F.col("k") <= int(more)).select(*PAGE))
    return rows.distinct().join(pages.select(*PAGE), PAGE, "left_semi")


def sampled(pages: DataFrame, seed: int = 7) -> DataFrame:
    """pages with k, their place in a seeded order."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("page").cast("string")).cast("binary"))
    return pages.select(*PAGE, F.row_number().over(Window.partitionBy("doc_id").orderBy(key)).cast("bigint").alias("k"))
