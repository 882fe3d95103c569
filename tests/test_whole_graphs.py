"""Graph queries over the whole chain of lineitem, against brute force on the smallest tables."""

import pytest

from weftwork.plans import graphs, registry

from test_graph import brute_scc


@pytest.fixture(scope="module")
def pairs(spark, sf):
    """All pairs of parts on consecutive lines of an order, made without the plans."""
    parts = {}  # a line number may stand more than once in an order
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        parts.setdefault((r.l_orderkey, r.l_linenumber), set()).add(r.l_partkey)
    return {(a, b) for (o, n), own in parts.items() for a in own for b in parts.get((o, n + 1), ())}


@pytest.fixture(scope="module")
def routed(spark, sf):
    parts = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        parts.setdefault((r.l_orderkey, r.l_linenumber, r.l_linestatus, r.l_discount), set()).add(r.l_partkey)
    return {(a, b) for (o, n, m, f), own in parts.items() for a in own for b in parts.get((o, n + 1, m, f), ())}


def ran(spark, sf, name):
    return registry.QUERIES[name](spark, sf).collect()


def longest(pairs):
    layer = {n: 0 for p in pairs for n in p}
    for a, b in sorted(pairs):  # forward edges, by source
        layer[b] = max(layer[b], layer[a] + 1)
    return layer


def reached(pairs, start):
    hops, frontier = {start: 0}, [start]
    for a in frontier:
        for x, b in pairs:
            if x == a and b not in hops:
                hops[b] = hops[a] + 1
                frontier.append(b)
    return hops


def test_components_and_cycles_of_all_routes(spark, sf, routed):
    pairs = routed
    scc = brute_scc(pairs)
    assert {r.node: r.scc for r in ran(spark, sf, "strong_components")} == scc
    groups = {}
    for n, c in scc.items():
        groups.setdefault(c, []).append(n)
    assert {tuple(r) for r in ran(spark, sf, "circular_groups")} == {(c, len(m), max(m)) for c, m in groups.items()}
    named = {(scc.get(a, a), scc.get(b, b)) for a, b in pairs}
    assert {(r.src, r.dst) for r in ran(spark, sf, "condensed_edges")} == {p for p in named if p[0] != p[1]}
    assert {tuple(r) for r in ran(spark, sf, "has_cycle")} == {("routes", bool(scc) or any(a == b for a, b in pairs)), ("forward", False)}


def test_order_of_the_whole_chain(spark, sf, pairs):
    forward = {p for p in pairs if p[0] < p[1]}
    assert {r.node: r.layer for r in ran(spark, sf, "topo_layers")} == longest(forward)
    to, far = {}, {}
    for a, b in forward:
        to.setdefault(a, set()).add(b)
    for a in sorted(to, reverse=True):
        far[a] = to[a].union(*(far.get(b, set()) for b in to[a]))
    assert {(r.src, r.dst) for r in ran(spark, sf, "closure")} == {(a, b) for a, bs in far.items() for b in bs}
    scc, at = brute_scc(pairs), {r.node: (r.layer, r.group) for r in ran(spark, sf, "load_order")}
    assert set(at) == {n for p in pairs for n in p}
    assert all(at[n][1] == scc.get(n, n) for n in at)
    assert all(at[a][0] > at[b][0] for a, b in pairs if scc.get(a, a) != scc.get(b, b))


def test_flagship_over_the_whole_chain(spark, sf, pairs):
    forward = {p for p in pairs if p[0] < p[1]}
    hops = reached(forward, min(a for a, _ in forward))
    layer = longest({p for p in forward if p[0] in hops})
    assert {r.node: (r.hops, r.layer) for r in graphs.flagship(spark, sf).collect()} == {n: (h, layer[n]) for n, h in hops.items()}
