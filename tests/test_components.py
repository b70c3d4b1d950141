"""Components against union-find: chains, rings, random graphs, repeated and empty links, contracted in one batch and in many."""

import numpy as np
import pytest

from sparkloom.operators import components

RNG = np.random.default_rng(0)
CASES = {
    "chains": [("a", i, i + 1) for i in range(600)] + [("b", i, i + 1) for i in range(5)],
    "sparse": [("k", int(a), int(b)) for a, b in RNG.integers(0, 900, (700, 2))],
    "loop": [("k", 1, 1)],
    "empty": [],
    "repeated": [("k", 5, 2)] * 4 + [("k", 2, 5), ("k", None, 3), (None, 1, 2)],
    "keys": [(str(k), int(a), int(b)) for k, a, b in zip(RNG.integers(0, 4, 3000), RNG.integers(0, 2000, 3000), RNG.integers(0, 2000, 3000))],
    "paths": [("p", int(a), int(b)) for a, b in zip(RNG.permutation(2000)[:-1], RNG.permutation(2000)[1:])],
    "hub": [("h", 0, i) for i in range(1, 900)],
}


def _plain(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, a, b in links:
        if k is not None and a is not None and b is not None and a != b:
            x, y = root((k, a)), root((k, b))
            parent[max(x, y)] = min(x, y)
    return {n: root(n)[1] for n in list(parent)}


@pytest.mark.parametrize("together", [1 << 18, 4])
@pytest.mark.parametrize("name", sorted(CASES))
def test_components(spark, monkeypatch, name, together):
    monkeypatch.setattr(components, "TOGETHER", together)
    links = CASES[name]
    df = spark.createDataFrame(links, "k string, a long, b long").repartition(5)
    assert {(r.k, r.id): r.label for r in components.components(df, ["k"]).collect()} == _plain(links)
    flat = [("", a, b) for _, a, b in links]
    assert {("", r.id): r.label for r in components.components(df.drop("k")).collect()} == _plain(flat)
