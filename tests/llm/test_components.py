"""Connected components against a plain union-find."""

import random

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm.components import components  # noqa: E402


def least_reachable(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {(x, root(x)) for x in up}


DRAW = random.Random(5)
CASES = {
    "none": [],
    "loops and nulls": [(1, 1), (None, 2), (3, None)],
    "stars already": [(1, 5), (1, 6), (5, 1), (2, 9), (2, 9)],
    "hub that is not the least": [(50, i) for i in range(50)] + [(50, 50 + i) for i in range(1, 40)],
    "child that is a centre": [(1, 2), (2, 3), (2, 4)],
    "path": [(i, i + 1) for i in range(70)],
    "shuffled path": [(a, b) for s in [DRAW.sample(range(90), 90)] for a, b in zip(s, s[1:], strict=False)],
    "cliques": [(10 * c + i, 10 * c + j) for c in range(6) for i in range(9) for j in range(i)],
    "random": [(DRAW.randrange(400), DRAW.randrange(400)) for _ in range(260)],
}


@pytest.mark.parametrize("name", CASES)
def test_components_against_union_find(spark, name):
    rows = components(spark.createDataFrame(CASES[name], "a long, b long")).collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == least_reachable(CASES[name])
