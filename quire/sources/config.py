"""Book configurations: a closed grammar, checked on the driver, whose page lists become small DataFrames.

A configuration is a mapping (from JSON, or whatever parser the caller has). Everything that isn't in the grammar is an error.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.seams import normalize

VERSION = 1
GRAMMAR = {
    line.split(":")[0]: frozenset(line.split(":")[1].split())
    for line in """
source: sha256 pdf folder
metadata: accessibility_summary additional_languages cover cover_render cover_synthesize creators date identifier isbn_epub isbn_print language publisher released subtitle title
pages: back body cover exclude front label_overrides label_source role_overrides
furniture: extra keep repeat_min_pages top_band
styles: body_pstyle charstyles fail_on_unmapped pstyle_map unmapped_role
flow: columns dehyphenate gap_factor indent_threshold join_center_lines keep_hyphens overrides reattach_dropcaps restore_spaces
footnotes:* toc:* glyphs:* fonts:* languages:* split:* images:* output:* qa:* blocks:* imprint:* adjudications:* schema_version:*
""".replace(":* ", ":*\n").strip().splitlines()
}
CHOICES = {("pages", "label_source"): ("synthetic", "printed-folios", "pdf-page-labels"), ("flow", "dehyphenate"): ("off", "lower-only")}
ACTIONS = frozenset(["break", "class:list", "class:prose", "class:quote", "class:verse", "drop", "join", "keep"])
PLACEHOLDER = "TODO"


class ConfigError(ValueError):
    pass


def need(condition: Any, message: str) -> None:
    if not condition:
        raise ConfigError(message)


def placeholders(value: Any, at: str = "") -> list[str]:
    """Paths of values that are still placeholders."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in placeholders(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, list):
        return [p for k, v in enumerate(value) for p in placeholders(v, f"{at}[{k}]")]
    return [at] if isinstance(value, str) and value.strip().startswith(PLACEHOLDER) else []


def page_list(items: list) -> list[int]:
    """Numbers and "a-b" texts, both ends included."""
    out: list[int] = []
    for x in items:
        a, dash, b = str(x).partition("-")
        out += range(int(a), int(b if dash else a) + 1)
    return out


@dataclass
class Config:
    data: dict
    sha256: str
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)
    cover: list[int] = field(default_factory=list)
    exclude: list[int] = field(default_factory=list)

    def pages_out(self, spark: SparkSession) -> DataFrame:
        """Pages that aren't in the flow."""
        return spark.createDataFrame([(p,) for p in sorted({*self.cover, *self.exclude})], "page int")


def load(raw: bytes | str, complete: bool = True) -> Config:
    raw = raw.encode() if isinstance(raw, str) else raw
    data = json.loads(raw)
    need(isinstance(data, dict), "not a mapping")
    for section, body in data.items():
        need(section in GRAMMAR, f"unknown section {section}")
        allowed = GRAMMAR[section]
        if isinstance(body, dict) and "*" not in allowed:
            need(not (extra := set(body) - allowed), f"{section}: unknown {sorted(extra)}")
    need(not (left := placeholders(data)), f"placeholders left: {left}")
    version = data.get("schema_version", None if complete else VERSION)
    need(type(version) is int and version == VERSION, f"schema_version must be {VERSION}")
    meta = data.get("metadata", {})
    if complete:
        for key in ("title", "creators", "language"):
            need(meta.get(key), f"metadata.{key} is required")
    for key in ("folder", "pdf"):
        need(data.get("source", {}).get(key), f"source.{key} is required")
    if meta.get("released") is not None:
        try:
            date.fromisoformat(str(meta["released"]))
        except ValueError:
            raise ConfigError("metadata.released is no date") from None
    for (section, key), choices in CHOICES.items():
        value = data.get(section, {}).get(key, choices[-1])
        need(value in choices, f"{section}.{key}: {value}")
    for o in data.get("flow", {}).get("overrides", []):
        need(o.get("action") in ACTIONS or str(o.get("action")).startswith("role:"), f"flow.overrides: {o}")
    for c in data.get("flow", {}).get("columns", []):
        need(int(c["count"]) > 1 and page_list(c["pages"]), f"flow.columns: {c}")
    pages = data.get("pages", {})
    config = Config(data, sha256(raw).hexdigest(), cover=page_list(pages.get("cover", [])), exclude=page_list(pages.get("exclude", [])))
    end = 0
    for name in ("front", "body", "back"):
        if name in pages:
            first, last = map(int, pages[name])
            need(end < first <= last, f"pages.{name}: {first}-{last} after {end}")
            config.ranges[name], end = (first, last), last
    return config


KINDS = "absent block_present order present".split()
CELL = frozenset("boundary note page pno text text2 type".split())
LEAST = 4


def assertions(entries: list) -> list[dict]:
    """Checked cells of an assertion file: what a page must or must not say."""
    need(isinstance(entries, list), "assertions are a list")
    for k, e in enumerate(entries):
        need(isinstance(e, dict) and CELL.issuperset(e), f"{k}: unknown keys")
        need(e.get("type") in KINDS, f"{k}: type")
        for key in ("page", "note", "text"):
            need(isinstance(e.get(key), str) and normalize(e[key]), f"{k}: {key} must be a text, quoted")
        a, b = normalize(e["text"]), normalize(e.get("text2", ""))
        need(bool(b) == (e["type"] == "order"), f"{k}: text2 belongs to order alone")
        need(not b or (a not in b and b not in a), f"{k}: one text holds the other")
        need(e.get("boundary") in (None, True, False) and (e.get("pno") is None or type(e["pno"]) is int), f"{k}: boundary or pno")
        need(e.get("boundary") or all(len(x) >= LEAST for x in (a, b) if x), f"{k}: short texts need a boundary")
    return [{"text2": "", "boundary": None, "pno": None} | e for e in entries]


def in_flow(pages: DataFrame, config: Config) -> DataFrame:
    """Pages of the flow: neither cover nor excluded."""
    return pages.join(F.broadcast(config.pages_out(pages.sparkSession)), "page", "left_anti")  # as many as the configuration names
