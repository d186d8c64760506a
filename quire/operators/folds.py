"""Order-dependent operators: one document's sequence is folded by one call, whole documents in Arrow batches.

``FOLDS`` holds the plain functions over tuples; each query groups a view by document, sorts it and applies one of them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import seams
from quire.operators.arrow import view
from quire.plans.dialect import Duck
from quire.plans.views import dialect, prefix, row_lines


def baselines(lines: list[dict], tolerance: float = 2.0) -> list[dict]:
    """Fragments whose y is within the tolerance of the first of the group form one line."""
    out, top, group = [], None, -1
    for r in sorted(lines, key=lambda r: (r["page"], r["y0"], r["x0"])):
        key = (r["page"], r["y0"])
        if top is None or key[0] != top[0] or key[1] - top[1] > tolerance:
            top, group = key, group + 1
        out.append({"line": r["line"], "v": group})
    return out


def right_runs(lines: list[dict], near: float = 3.0, same: float = 2.0) -> list[dict]:
    """Right margin of each run of lines that start where the run started: the largest end shared by enough of them."""
    out, run = [], []

    def close() -> None:
        if run:
            need = max(2, -(-4 * len(run) // 10))
            shared = [r["x1"] for r in run if sum(abs(r["x1"] - q["x1"]) <= same for q in run) >= need]
            out.extend({"line": r["line"], "v": int(max(shared)) if shared else -1} for r in run)

    for r in lines:
        if run and (r["page"] != run[0]["page"] or abs(r["x0"] - run[0]["x0"]) > near):
            close()
            run = []
        run.append(r)
    close()
    return out


def note_sequence(lines: list[dict]) -> list[dict]:
    """Notes of a page region: a digit marker starts a note only if it follows the last one accepted on the page."""
    out, page, last = [], None, 0
    for r in lines:
        if r["page"] != page:
            page, last = r["page"], 0
        m = re.match(r"(\d{1,3})[ .]", r["text"])
        if m and (last == 0 or int(m[1]) == last + 1):
            last = int(m[1])
            out.append({"line": r["line"], "v": last})
    return out


def wrap_merge(lines: list[dict]) -> list[dict]:
    """Small lines of a page; a first group without a marker belongs to the page before's last note."""
    out, note, page = [], 0, None
    for r in lines:
        starts = bool(re.match(r"[*†‡\d]", r["text"]))
        if r["size"] < 10:
            note += starts or (page is None)
            out.append({"line": r["line"], "v": note})
            page = r["page"]
    return out


def note_queue(lines: list[dict]) -> list[dict]:
    """Notes queue by page; a marker in the body takes the head of the queue if its note stands on that page or the next."""
    queue, out = [], []
    for r in lines:
        if r["size"] < 10:
            queue.append(r)
    for r in lines:
        if r["size"] >= 10 and "*" in r["text"] and queue and r["page"] <= queue[0]["page"] <= r["page"] + 1:
            out.append({"line": r["line"], "v": queue.pop(0)["line"]})
    body = [r["line"] for r in lines if r["size"] >= 10]
    return out + [{"line": body[-1], "v": n["line"]} for n in queue if body]


def claim_headings(lines: list[dict]) -> list[dict]:
    """Contents entries claim headings once each: equal titles first, then the likest of at least 85, nearest page on ties."""
    heads = [r for r in lines if r["size"] > 12]
    entries = [(k, r["text"][:-1] if k % 3 else r["text"], r["page"] + k % 2) for k, r in enumerate(heads)]
    free, out = list(range(len(heads))), []
    for exact in (True, False):
        for k, title, page in entries:
            if any(o["v"] == k for o in out):
                continue
            scored = [(100.0 if heads[h]["text"] == title else 0.0 if exact else seams.partial_ratio(heads[h]["text"].lower(), title.lower()), -abs(heads[h]["page"] - page), -h) for h in free]
            if scored and max(scored)[0] >= (100 if exact else 85):
                h = -max(scored)[2]
                free.remove(h)
                out.append({"line": heads[h]["line"], "v": k})
    return out


def verse_groups(lines: list[dict], levels: tuple[float, ...] = (72.0, 90.0), tolerance: float = 2.0) -> list[dict]:
    """Stanzas: runs of short lines at calibrated insets; a stanza cut by a page turn goes on if the next page opens with one."""
    out, group, before = [], 0, None
    for r in lines:
        fits = r["x1"] - r["x0"] < 300 and any(abs(r["x0"] - x) <= tolerance for x in levels)
        if not fits:
            before = None
            continue
        if before is None or (r["page"] != before["page"] and r["page"] != before["page"] + 1):
            group += 1
        out.append({"line": r["line"], "v": group})
        before = r
    return out


def list_pass(lines: list[dict]) -> list[dict]:
    """Items of lists: an indented line opens one, lines at the hanging stop continue it; the item is carried over pages."""
    out, item = [], 0
    for r in lines:
        if r["x0"] > 80:
            item += 1
        if item:
            out.append({"line": r["line"], "v": item})
    return out


def page_fidelity(lines: list[dict]) -> list[dict]:
    """Recall in percent of each page in its copy's window of one page either side; copies lack every seventh line."""
    pages: dict[int, list[str]] = {}
    copies: dict[int, list[str]] = {}
    for r in lines:
        pages.setdefault(r["page"], []).append(r["text"])
        if r["line"] % 7:
            copies.setdefault(r["page"], []).append(r["text"])
    out = []
    for p, rows in pages.items():
        text, window = " ".join(rows), " ".join(" ".join(copies.get(q, [])) for q in (p - 1, p, p + 1))
        if len(text) >= 60:
            out.append({"line": p, "v": 100 * seams.lcs(text, window) // len(text)})
    return out


def paged_coverage(lines: list[dict]) -> list[dict]:
    """Characters of each page that its copy has in order, by matching blocks of words from a cursor that only moves on.

    The window begins at the cursor or where a probe from the page is found; blocks of under 20 characters don't count.
    """
    pages: dict[int, list[str]] = {}
    for r in lines:
        pages.setdefault(r["page"], []).append(r["text"])
    signs: dict[str, str] = defaultdict(lambda: chr(len(signs)))  # a character for each word, so that words are sought as characters

    def coded(words: list[str]) -> str:
        return "".join(map(signs.__getitem__, words))

    copy = coded(" ".join(t for p, rows in pages.items() for k, t in enumerate(rows) if (p + k) % 9).split())
    at, out = 0, []
    for p, rows in pages.items():
        words = " ".join(rows).split()
        text, upto = coded(words), [0, *accumulate(len(w) + 1 for w in words)]
        probes = (copy.find(text[o : o + 4], at) if len(text) >= o + 4 else -1 for o in (0, len(words) // 4, len(words) // 2, 3 * len(words) // 4))
        best, end = 0, at
        for s in sorted({at, *(i for i in probes if i >= 0)}):
            window = copy[s : s + len(words)]
            there = set(window)
            if best and sum(upto[k + 1] - upto[k] for k, c in enumerate(text) if c in there) <= best:
                continue  # not even all words that the window has would be more
            blocks = seams.matching_blocks(text, window)
            sizes = [(upto[a + n] - upto[a] - 1, s + b + n) for a, b, n in blocks if n]
            n = sum(c for c, _ in sizes if c >= 20)
            if n > best:
                best, end = n, max(e for c, e in sizes if c >= 20)
        at = max(at, end)
        out.append({"line": p, "v": best})
    return out


FOLDS: dict[str, tuple[Callable, str, str]] = {
    # query: the fold, the name of its number, lines that take part
    "baseline_groups": (baselines, "baseline", "true"),
    "right_margin_runs": (right_runs, "right_edge", "true"),
    "note_sequence": (note_sequence, "note", "true"),
    "note_wrap_merge": (wrap_merge, "note", "true"),
    "note_attach": (note_queue, "note_line", "true"),
    "heading_claims": (claim_headings, "entry", "size > 12"),
    "verse_groups": (verse_groups, "stanza", "true"),
    "list_pass": (list_pass, "item", "true"),
    "page_fidelity": (page_fidelity, "recall", "true"),
    "paged_coverage": (paged_coverage, "matched", "true"),
}
COLUMNS = ["line", "page", "x0", "x1", "y0", "size", "text"]


def fold(function: Callable[[list[dict]], list[dict]]):
    """Column function: a document's rows to struct<line, v>."""
    kind = pa.list_(pa.struct([("line", pa.int64()), ("v", pa.int64())]))

    @F.arrow_udf("array<struct<line: bigint, v: bigint>>")
    def apply(rows: pa.Array) -> pa.Array:
        every = rows.flatten()
        names = [f.name for f in every.type]
        dicts = [dict(zip(names, r)) for r in zip(*(c.to_pylist() for c in every.flatten()))]
        ends = list(accumulate(n or 0 for n in pc.list_value_length(rows).to_pylist()))
        return pa.array([function(dicts[a:z]) for a, z in zip([0, *ends], ends)], kind)

    return apply


def by_document(lines: DataFrame, function: Callable, name: str) -> DataFrame:
    """doc_id, line (or page) and the fold's number; one shuffle by document."""
    return _folded(lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*COLUMNS))).alias("r")), function, name)


def _folded(rows: DataFrame, function: Callable, name: str) -> DataFrame:
    return rows.select("doc_id", F.explode(fold(function)("r")).alias("x")).select("doc_id", "x.line", F.col("x.v").alias(name))


def _query(function: Callable, name: str, where: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = dialect(spark, sf_dir)
        if d.keyed and function in (page_fidelity, paged_coverage):  # the document's row has all its lines, so that nothing is shuffled
            own = F.expr(f"transform({row_lines(d)}, r -> struct(r.line AS line, r.line DIV 40 + 1 AS page, r.text AS text))")
            return _folded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", own.alias("r")), function, name)
        lines = view(spark, sf_dir, "lines").where(where)
        if name in ("note", "note_line"):  # the documents have no notes of their own
            marked = F.expr("case when idx >= 37 then concat(idx - 36, ' ', text) when line % 11 = 0 then concat(text, '*') else text end")
            lines = lines.withColumn("text", marked).withColumn("size", F.expr("case when idx >= 37 then 9.0 else size end"))
        return by_document(lines, function, name)

    return run


QUERIES = {k: (_query(*v), None) for k, v in FOLDS.items()}


def epub_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packages, written and read again: the spine in order, without the navigation."""
    from quire.sources.epub import packed, read_packages, write_packages

    if dialect(spark, sf_dir).keyed:
        own = F.expr("filter(transform(split(text, '\\n'), (x, i) -> struct(CAST(i AS BIGINT) AS para, x AS text)), p -> trim(p.text) <> '')")
        packages = packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", own.alias("r")))
    else:
        packages = write_packages(view(spark, sf_dir, "paras"))
    return read_packages(packages).where("pos >= 0 and not is_nav").select("doc_id", "pos", "href", "title", "n_blocks", F.length("text").cast("bigint").alias("n_chars"))


EPUB_SQL = """s AS (SELECT doc_id, para, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS k FROM paras)
SELECT doc_id, (k // 10)::INTEGER AS pos, printf('c%04d.xhtml', k // 10 + 1) AS href, 'Part ' || (k // 10 + 1) AS title, count(*)::INTEGER AS n_blocks, (sum(length(text)) + count(*) - 1)::BIGINT AS n_chars FROM s GROUP BY doc_id, k // 10"""
QUERIES["epub_spine"] = (epub_spine, f"{prefix(Duck(), ['paras'])} {EPUB_SQL}")
