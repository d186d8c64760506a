"""Repairs by the places of glyphs: signs that close a right-to-left run go behind it, and page labels in hexadecimal."""

from __future__ import annotations

import re

RTL = re.compile("[֐-ࣿיִ-﷿ﹰ-﻿]")


def reorder_closing(glyphs: list[tuple[str, float, float]], slack: float = 0.5) -> tuple[list[tuple[str, float, float]], int]:
    """Glyphs (sign, left, right) of a line in reading order, and how many moved.

    Signs drawn at or beyond a right-to-left run's right edge, but stored just before it, belong behind it, from left to right.
    """
    out: list = []
    run: list = []
    moved = 0

    def flush() -> None:
        nonlocal moved, run
        if run:
            edge = max(g[2] for g in run) - slack
            keep = len(out)
            while keep and out[keep - 1][1] >= edge:
                keep -= 1
            behind = sorted(out[keep:], key=lambda g: g[1])
            out[keep:] = run + behind
            moved += len(behind)
            run = []

    for g in glyphs:
        if RTL.match(g[0]):
            run.append(g)
        else:
            flush()
            out.append(g)
    flush()
    return out, moved


def decode_label(label: str) -> str:
    """Hexadecimal UTF-16 texts within a page label decoded; what can't be decoded stays."""

    def one(m: re.Match) -> str:
        try:
            raw = bytes.fromhex(m[1])
            return raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else m[0]
        except ValueError:
            return m[0]

    return re.sub(r"<((?:[0-9A-Fa-f]{2})+)>", one, label)
