"""The closure as bits, against brute force; parts of all sizes, cycles, names and nulls."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftwork.operators import closure, graph


def brute(pairs):
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    out = set()
    for a in to:
        stack = [a]
        while stack:
            new = to.get(stack.pop(), set()) - {y for x, y in out if x == a}
            out |= {(a, b) for b in new}
            stack += new
    return out


def some_pairs(seed, nodes=24, edges=30):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)})


def closed(spark, pairs, kind="long"):
    rows = [tuple(r) for r in graph.reach_pairs(spark.createDataFrame(pairs, f"src {kind}, dst {kind}")).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_a_long_path_takes_no_round_a_hop(spark, monkeypatch):
    """Each hop once cost a round of joins, which wrote the whole closure anew."""
    tables = []
    for name in ("measured", "stored"):
        monkeypatch.setattr(graph, name, lambda *a, f=getattr(graph, name), **k: tables.append(f) or f(*a, **k))
    n = 12
    assert closed(spark, [(i, i + 1) for i in range(n)]) == {(a, b) for a in range(n) for b in range(a + 1, n + 1)}
    assert len(tables) <= 3


@pytest.mark.parametrize("held", [2_000_000, 6, 1])
def test_parts_held_dealt_and_joined(spark, monkeypatch, held):
    """All edges in one task; small parts dealt to tasks and larger ones joined; nearly all joined."""
    monkeypatch.setattr(graph, "EDGES_HELD", held)
    monkeypatch.setattr(graph, "EDGES_A_BLOCK", 8)
    pairs = [*some_pairs(5), *((100 + 3 * i + a, 100 + 3 * i + b) for i in range(4) for a, b in ((0, 1), (1, 2), (i % 3, 0))), (200, 200)]
    assert closed(spark, pairs) == brute(pairs)


def test_names_nulls_and_no_edges(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "d")]
    odd = [("c", None), (None, "a"), (None, None)]
    assert closed(spark, [*pairs, *pairs, *odd], "string") == brute(pairs) | set(odd)
    assert graph.reach_pairs(spark.createDataFrame([], "src long, dst long")).collect() == []


@pytest.mark.parametrize("limits", [(1, 1, 0, 1, 1), (5, 7, 0, 100, 60), (50, 10**6, 2, 10**6, 10**6)])
def test_shares_give_each_pair_once(monkeypatch, limits):
    for name, value in zip(("UNIT_NODES", "SHARE_PAIRS", "EDGE_PAIRS", "HELD_BITS", "SPREAD_BITS"), limits, strict=True):
        monkeypatch.setattr(closure, name, value)
    for seed in range(30):
        pairs = some_pairs(seed, nodes=(3, 24, 130)[seed % 3])
        if seed % 2:
            pairs = [p for p in pairs if p[0] < p[1]]
        units, got = closure.units(pa.table({"src": [a for a, _ in pairs], "dst": [b for _, b in pairs]})), []
        for batch in units.to_batches():
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                for share in range(row.column("shares")[0].as_py()):
                    for out in closure.expand([row.append_column("share", pa.array([share], pa.int32()))]):
                        got += [(a, b) for a, bs in zip(*(c.to_pylist() for c in out.columns), strict=True) for b in bs]
        assert len(got) == len(set(got)) and set(got) == brute(pairs)


def test_large_parts_are_neither_joined_nor_shuffled_a_share(spark, monkeypatch):
    """A part of over 2,000,000 edges was closed by joins, which stored its pairs; a unit was shuffled once for each of its shares."""
    monkeypatch.setattr(graph, "_joined_pairs", None)
    ids = spark.range(1450)
    wide = graph.reach_pairs(ids.select(F.col("id").alias("src")).crossJoin(ids.select((F.col("id") + 10_000).alias("dst"))))
    assert wide.count() == 1450**2
    n = 6000
    path = graph.reach_pairs(spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert "Exchange" not in path._jdf.queryExecution().executedPlan().toString()
    got = path.agg(F.count("*"), F.sum(F.col("dst") - F.col("src"))).first()
    assert tuple(got) == (n * (n + 1) // 2, n * (n + 1) * (n + 2) // 6)
