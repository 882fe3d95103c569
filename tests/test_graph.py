import random

import pytest
from pyspark.sql import functions as F

from weftwork.operators import graph


@pytest.fixture(params=["one block", "many blocks"])
def mode(request, monkeypatch):
    if request.param == "many blocks":
        monkeypatch.setattr(graph, "EDGES_A_BLOCK", 3)
    return request.param


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def brute_scc(pairs):
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)

    def reach(a):
        seen, stack = set(), [a]
        while stack:
            for b in to.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        return seen

    nodes = {x for p in pairs for x in p}
    far = {n: reach(n) for n in nodes}
    return {n: min(m for m in far[n] if n in far[m]) for n in nodes if any(m != n and n in far[m] for m in far[n])}


def test_components_equal_brute_force(spark, mode):
    rng = random.Random(3)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(16)]
    got = {r.node: r.scc for r in graph.scc(edges_of(spark, pairs)).collect()}
    assert got == brute_scc(pairs)
    # Several components that the first cuts part, on names instead of numbers.
    rings = [(f"n{k:02}{i}", f"n{k:02}{(i + 1) % 4}") for k in range(6) for i in range(4)] + [(f"n{k:02}1", f"n{k + 1:02}2") for k in range(5)]
    got = {r.node: r.scc for r in graph.scc(spark.createDataFrame(rings, "src string, dst string")).collect()}
    assert got == brute_scc(rings) and len(set(got.values())) == 6


def test_reach_and_layers(spark, mode):
    edges = edges_of(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 3), (3, 5)])
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.hops for r in graph.reach(edges, start).collect()} == {1: 0, 2: 1, 0: 2, 3: 2, 5: 3}
    layered, residue = graph.layers(edges)
    assert {r.node: r.layer for r in layered.collect()} == {4: 0} and residue.count() > 0
    layered, residue = graph.layers(edges.where("src < dst"))
    assert {r.node: r.layer for r in layered.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 5: 4} and residue.isEmpty()


def test_empty_and_self_loops(spark, mode):
    none = edges_of(spark, [(0, 1)]).limit(0)
    assert graph.scc(none).count() == 0 and not graph.has_cycle(none)
    assert graph.has_cycle(edges_of(spark, [(1, 1)])) and graph.scc(edges_of(spark, [(1, 1)])).count() == 0


def test_load_order_puts_dependencies_first(spark):
    edges = edges_of(spark, [(1, 2), (2, 3), (3, 2), (1, 4)])
    ranks = spark.createDataFrame([(n, n) for n in (1, 2, 3, 4)], "node long, rank long")
    at = {r.node: (r.layer, r.group) for r in graph.load_order(edges, ranks).collect()}
    assert at[2] == at[3] and at[1][0] > at[2][0] and at[1][0] > at[4][0]
    assert graph.reach_pairs(edges).where(F.col("src") == 1).count() == 3
