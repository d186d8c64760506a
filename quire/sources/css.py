"""Style sheets: rules of at most one ancestor, and which of them wins for an element."""

from __future__ import annotations

import re
from typing import NamedTuple

SIMPLE = re.compile(r"([a-z][a-z0-9]*)?((?:\.[\w-]+)*)$", re.I)


class Simple(NamedTuple):
    tag: str
    classes: frozenset[str]

    def fits(self, tag: str, classes: frozenset[str]) -> bool:
        return self.tag in ("", tag) and self.classes <= classes


class Rule(NamedTuple):
    above: Simple | None
    subject: Simple
    props: dict[str, str]
    order: int

    @property
    def weight(self) -> tuple[int, int, int]:
        both = [s for s in (self.above, self.subject) if s]
        return sum(len(s.classes) for s in both), sum(bool(s.tag) for s in both), self.order


def _simple(text: str) -> Simple | None:
    m = SIMPLE.match(text)
    return Simple(m[1] or "", frozenset(filter(None, m[2].split(".")))) if m and m[0] else None


def parse(text: str) -> list[Rule]:
    """Rules in order; comments, at-rules and selectors with more than one ancestor or any other sign are left out."""
    text = re.sub(r"@[^{;]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})", " ", re.sub(r"/\*.*?\*/", " ", text, flags=re.S))
    out: list[Rule] = []
    for selectors, body in (x.rsplit("{", 1) for x in text.split("}") if "{" in x):
        props = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in body.split(";")) if k.strip() and v.strip()}
        for selector in selectors.split(",") if props else ():
            chain = [_simple(x) for x in selector.split()]
            if 0 < len(chain) < 3 and all(chain):
                out.append(Rule(chain[0] if len(chain) == 2 else None, chain[-1], props, len(out)))
    return out


def resolve(rules: list[Rule], path: list[tuple[str, frozenset[str]]]) -> dict[str, str]:
    """Properties of the last element of a path from the root; of rules that set one, the heaviest wins."""
    *above, (tag, classes) = path
    won: dict[str, tuple[tuple, str]] = {}
    for r in rules:
        if r.subject.fits(tag, classes) and (r.above is None or any(r.above.fits(*a) for a in above)):
            for k, v in r.props.items():
                won[k] = max(won.get(k, ((-1, 0, 0), "")), (r.weight, v))
    return {k: v for k, (_, v) in won.items()}


def font_size(rules: list[Rule], path: list[tuple[str, frozenset[str]]]) -> float:
    """The em sizes of all elements of the path multiplied."""
    size = 1.0
    for k in range(1, len(path) + 1):
        m = re.fullmatch(r"([\d.]+)em", resolve(rules, path[:k]).get("font-size", ""))
        size *= float(m[1]) if m else 1.0
    return size
