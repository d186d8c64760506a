from itertools import product

import pytest

from quire.llm import chat

LEGAL = [s + ("user", "assistant") * n for s in ((), ("system",)) for n in range(1, 5)]
COST = chat.COSTS


def brute(roles):
    """Least cost over legal target sequences: each turn goes to a target turn, in order; targets without one are inserted."""
    best = 1e9
    for target in LEGAL:
        for places in product(range(len(target)), repeat=len(roles)):
            if all(a <= b for a, b in zip(places, places[1:])):
                cost = sum(COST["relabel"] for r, p in zip(roles, places) if r != target[p])
                cost += sum(COST["merge"] for a, b in zip(places, places[1:]) if a == b) + COST["insert"] * (len(target) - len(set(places)))
                best = min(best, cost)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_cost_equals_brute_force(n):
    for roles in product(("system", "user", "assistant", "x"), repeat=n):
        cost, steps = chat.repair(roles)
        assert cost == brute(roles), roles
        turns = chat.apply(steps, [str(i) for i in range(n)])
        assert tuple(r for r, _ in turns) in LEGAL
        assert [int(c) for _, t in turns for c in t if c.isdigit()] == list(range(n))  # no text is lost or moved


def test_rows(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yo", "x"), (2, 1, "assistant", None, "x"), (2, 0, None, "q", "x"), (None, 0, "user", "a", "x"), (None, 0, "user", "a", "x"), (3, 0, "assistant", "w " * 100000, "x")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")).collect()}
    assert out[1]["cost"] == 0 and out[1]["text"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n"
    assert (out[2]["relabels"], out[2]["roles"]) == (1, "user assistant")
    assert (out[None]["cost"], out[None]["relabels"], out[None]["roles"]) == (2, 1, "user assistant")  # cheaper than to merge and insert
    assert out[3]["inserts"] == 1 and len(out[3]["text"]) > 200000
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty).count() == 0
