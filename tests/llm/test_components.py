"""Connected components against union-find."""

import random

import pytest

from tidemark.llm.components import components


def by_hand(edges):
    label = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
            x, y = sorted((label[a], label[b]))
            label = {n: x if v == y else v for n, v in label.items()}
    return label


@pytest.mark.parametrize("edges", [[], [(3, 1), (1, 3), (2, 2), (None, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(random.Random(i).randrange(80), random.Random(i + 999).randrange(80)) for i in range(70)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["label"] for r in components(df).collect()} == by_hand(edges)
