"""Operator 5, chat formatting with role repair of minimum cost.

A legal conversation is: optionally one system turn, then user and assistant turns by turns, beginning with the user and
ending with the assistant. Dynamic programming over the states of that automaton reads the turns in order. At each turn it
may first insert empty turns (each costs ``insert``), then take the turn under its own role (free) or another one
(``relabel``), as a turn of its own or merged into the turn before if that has the same role (``merge``). The cheapest way
to the end is unique: of equal costs the one with fewer relabels, then merges, then inserts, then the first in the order
of the steps. The repaired turns are rendered with one template.

Cases: turns are ordered by turn, then role and text, nulls first; a null or unknown role has no own role, so that any costs
a relabel; a null text is an empty one; repeated rows are turns of their own; rows without conv_id form one conversation;
an empty table has no rows. A conversation of empty turns is repaired like any other.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
COSTS = {"merge": 1.0, "relabel": 2.0, "insert": 1.5}
NEXT = {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
"""States are named by the role of the last turn."""
END = "assistant"
JOINT = "\n\n"


@lru_cache(1 << 16)
def repair(roles: tuple[str, ...], merge: float = COSTS["merge"], relabel: float = COSTS["relabel"], insert: float = COSTS["insert"]) -> tuple[float, tuple[tuple[str, int], ...]]:
    """Cost and steps: ("insert:<role>", -1), ("turn:<role>", i) or ("merge:<role>", i), i the index of a turn."""

    def insertions(best: dict) -> dict:
        best = dict(best)
        for _ in range(len(ROLES)):  # longer runs of empty turns only come back to a state
            for state, (cost, path) in list(best.items()):
                for role, to in NEXT[state].items():
                    new = (cost[0] + insert, cost[1], cost[2], cost[3] + 1)
                    if to not in best or new < best[to][0]:
                        best[to] = (new, (path, (f"insert:{role}", -1)))
        return best

    best: dict = {"start": ((0.0, 0, 0, 0), None)}
    for i, own in enumerate(roles):
        after: dict = {}
        for state, (cost, path) in insertions(best).items():
            steps = [(role, to, "turn") for role, to in NEXT[state].items()] + ([(state, state, "merge")] if state != "start" else [])
            for role, to, kind in steps:
                new = (cost[0] + relabel * (role != own) + merge * (kind == "merge"), cost[1] + (role != own), cost[2] + (kind == "merge"), cost[3])
                if to not in after or new < after[to][0]:
                    after[to] = (new, (path, (f"{kind}:{role}", i)))
        best = after
    cost, path = insertions(best)[END]
    out = []
    while path is not None:
        path, step = path
        out.append(step)
    return cost[0], tuple(reversed(out))


def apply(steps: tuple[tuple[str, int], ...], texts: list[str]) -> list[tuple[str, str]]:
    turns: list[tuple[str, str]] = []
    for step, i in steps:
        kind, role = step.split(":")
        if kind == "merge":
            turns[-1] = (role, turns[-1][1] + JOINT + texts[i])
        else:
            turns.append((role, texts[i] if kind == "turn" else ""))
    return turns


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def _formatter(costs: dict[str, float]):
    @F.arrow_udf("struct<cost: double, n_turns: int, merges: int, relabels: int, inserts: int, roles: string, text: string>")
    def chat_format(turns: pa.Array) -> pa.Array:
        out = []
        for conversation in turns.to_pylist():
            roles = tuple((t["role"] or "").strip().lower() for t in conversation)
            cost, steps = repair(roles, **costs)
            fixed = apply(steps, [t["text"] or "" for t in conversation])
            kinds = [s.split(":") for s, _ in steps]
            relabels = sum(i >= 0 and k[1] != roles[i] for k, (_, i) in zip(kinds, steps))
            out.append({"cost": cost, "n_turns": len(fixed), "merges": sum(k[0] == "merge" for k in kinds), "relabels": relabels, "inserts": sum(k[0] == "insert" for k in kinds), "roles": " ".join(r for r, _ in fixed), "text": render(fixed)})
        kinds = [pa.float64(), *[pa.int32()] * 4, pa.string(), pa.string()]
        return pa.array(out, pa.struct(list(zip(("cost", "n_turns", "merges", "relabels", "inserts", "roles", "text"), kinds))))

    return chat_format


def format_conversations(conversations: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    """conv_id, cost, n_turns, merges, relabels, inserts, roles and text of every conversation.

    One shuffle by conv_id; a conversation is one row from then on, as it is one training example.
    """
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", _formatter(costs)("turns").alias("x")).select("conv_id", "x.*")
