"""Budgets against a plain recursive filler, and the whole mixing against documents taken one by one."""

import random

import pytest

from cohortloom.llm import mixing

LEAVES = "domain string, lang string, source string, tokens bigint"
WEIGHTS = "domain string, lang string, source string, weight double"


def fill(budget, children):
    """Shares of (weight, room): by weight, and what the full ones leave goes to the others."""
    got, left = [0.0] * len(children), budget
    open_ = [i for i, (w, room) in enumerate(children) if w > 0]
    while open_:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if children[i][1] <= left * children[i][0] / total + 1e-9]
        if not full:
            for i in open_:
                got[i] = left * children[i][0] / total
            break
        for i in full:
            got[i] = children[i][1]
        left -= sum(children[i][1] for i in full)
        open_ = [i for i in open_ if i not in full]
    return got


def filler(leaves, weights, budget, epochs):
    named = {tuple(w[:3]): w[3] for w in weights}

    def weight(path):
        return 1.0 if path[-1] is None else named.get((*path, *[None] * (3 - len(path))), 1.0)

    def room(path):
        if weight(path) <= 0:
            return 0.0
        if len(path) == 3:
            return epochs * sum(n for *p, n in leaves if tuple(p) == path)
        return sum(room(c) for c in {tuple(p[: len(path) + 1]) for *p, _ in leaves if tuple(p[: len(path)]) == path})

    out = {}

    def pour(path, amount):
        if len(path) == 3:
            out[path] = amount
            return
        children = sorted({tuple(p[: len(path) + 1]) for *p, _ in leaves if tuple(p[: len(path)]) == path}, key=repr)
        for c, share in zip(children, fill(amount, [(weight(c), room(c)) for c in children])):
            pour(c, share)

    pour((), budget * sum(n for *_, n in leaves))
    return out, sum(room(c) for c in {(d,) for d, *_ in leaves})


def shares(spark, leaves, weights, budget, epochs):
    got = mixing.budgets(spark.createDataFrame(leaves, LEAVES), spark.createDataFrame(weights, WEIGHTS), budget, epochs)
    return {(r["domain"], r["lang"], r["source"]): r["share"] for r in got.collect()}


def test_budget_does_not_go_where_it_cannot_be_spent(spark):
    leaves = [("a", "en", "x", 10), ("a", "de", "x", 100), ("b", "en", "x", 100)]
    got = shares(spark, leaves, [("a", "de", None, 0.0)], 0.5, 1)
    assert got == {("a", "en", "x"): 10, ("a", "de", "x"): 0, ("b", "en", "x"): 95}


def test_weights_of_inner_nodes_are_not_those_of_leaves_without_a_name(spark):
    leaves = [("a", None, None, 100), ("a", None, "x", 100)]
    got = shares(spark, leaves, [("a", None, None, 9.0)], 0.4, 1)
    assert got == {("a", None, None): 40, ("a", None, "x"): 40}


@pytest.mark.parametrize("seed", range(5))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    names = ["p", "q", "r", None]
    leaves = list({(rng.choice(names), rng.choice(names), rng.choice(names)): None for _ in range(rng.randint(2, 30))})
    leaves = [(*p, rng.choice([0, 1, 7, 50, 1000])) for p in leaves]
    if not sum(n for *_, n in leaves):
        leaves[0] = (*leaves[0][:3], 10)
    weights = {}
    for d, lang, s, _ in leaves:
        for path in ((d, None, None), (d, lang, None), (d, lang, s)):
            depth = max((i + 1 for i, v in enumerate(path) if v is not None), default=0)
            if depth and rng.random() < 0.6:
                weights[path] = rng.choice([0.0, 0.5, 1.0, 3.0, -1.0])
    weights = [(*k, w) for k, w in weights.items()]
    budget, epochs = rng.choice([0.1, 0.5, 1.0, 5.0]), rng.choice([1, 2])
    want, usable = filler(leaves, weights, budget, epochs)
    got = shares(spark, leaves, weights, budget, epochs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)
    assert abs(sum(got.values()) - min(budget * sum(n for *_, n in leaves), usable)) <= len(leaves)
